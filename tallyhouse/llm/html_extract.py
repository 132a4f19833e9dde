"""Main-text extraction: flat blocks, classified by a decision tree on their own and their
neighbours' word counts and link densities.

A page is cut into flat blocks at block-level tags; inline tags join the text around them.  Each
block has its word count and link density (share of words inside ``a``), those of the block
before and of the block after it, and four facts of its place: inside an article, a heading,
inside an element that plainly names page furniture (``nav``, ``class="cookie-notice"``), and
inside one whose name merely contains such a word (``class="share-your-story"``).  The names are
features like the others; the tree decides.  It is grown on the blocks of ``labelled_pages``,
pages made by rule whose furniture is marked on some and not on others, so that word counts and
densities come first.

What a browser never shows as text is no block: scripts, styles, titles, comments, form
controls, embedded objects, hidden elements.

Nulls, empties and ties: a null or empty page has an empty text; an empty table gives no rows;
repeated pages give repeated rows; further columns of ``pages`` are not read.  Tags left open end
with their parent or the page, an unfinished tag at the end is no text, and a script or style
that never ends hides the rest, as in browsers.  The parse takes linear time, whatever is left
open; nothing is cut off by length.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names by their part in a page.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style title textarea iframe xmp noembed noframes".split())
UNSEEN_TAGS = frozenset("noscript template select button svg math object canvas audio video datalist".split())
FURNITURE_TAGS = frozenset("nav header footer aside form dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in a class, id or role that name page furniture.
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments complementary consent "
    "contentinfo cookie cookies dialog disclaimer disqus footer header legal masthead menu modal nav navbar navigation newsletter notice "
    "notices overlay pagination pager paywall popup privacy promo promotion related reply replies respond search share sharing sidebar "
    "signup social sponsor sponsored subscribe tagcloud tags toolbar widget".split()
)
ARTICLE_NAMES = frozenset("article articlebody content entry hentry main post story body text".split())
#: Parts of a compound name that say what an element has, lacks or is styled by, not what it is.
MODIFIERS = frozenset("no non not with without has have hide show is on theme layout style skin".split())
#: A block of so many words, with at most so large a share of them linked, is text whatever its element is called.
LONG_WORDS, UNLINKED = 20, 0.34

FEATURES = ("words", "density", "words before", "density before", "words after", "density after", "article", "heading", "named", "hinted")

_TAG = re.compile(r"<(?:!--|!\[CDATA\[|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|([^\s=>/][^\s=>/]*|=)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?)""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_IMPLIED = frozenset("p li dd dt tr td th".split())
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _furniture(name: str, attributes: dict[str, str]) -> tuple[bool, bool, bool]:
    """Whether an element plainly names furniture, only hints at it, and names an article."""
    named, hinted, article, called = name in FURNITURE_TAGS, False, name in ("article", "main"), False
    for key in ("class", "id", "role"):
        for token in attributes.get(key, "").split():
            parts = [p.lower() for p in _PART.findall(token)]
            if not parts:
                continue
            mine = [p in FURNITURE_NAMES for p in parts]
            # the last part says what a compound name is: "main-menu" is a menu, "share-your-story" a story; "with-sidebar" is neither
            plain = not any(p in MODIFIERS for p in parts)
            called = called or (plain and (mine[-1] or all(mine)))
            hinted = hinted or any(mine)
            article = article or (plain and parts[-1] in ARTICLE_NAMES) or (parts[0] in ARTICLE_NAMES and not (plain and any(mine)))
    # an element that is called an article as well as something else is an article
    return named or (called and not article), hinted, article


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from a position behind a tag's name, and the position behind the tag (-1: it never ends)."""
    out: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(page, at)
        if m is None:
            return out, -1
        at = m.end()
        if m[1]:
            return out, at
        out.setdefault(m[2].lower(), m[3] or m[4] or m[5] or "")


class _Open:
    """An open element and what holds for the text in it."""

    __slots__ = ("name", "block", "article", "heading", "named", "hinted", "unseen", "link", "splits")

    def __init__(self, name: str, above: _Open | None):
        self.name, self.block, self.splits = name, name in BLOCK_TAGS, False
        self.article = self.heading = self.named = self.hinted = self.unseen = self.link = False
        if above is not None:
            self.article, self.heading, self.named, self.hinted = above.article, above.heading, above.named, above.hinted
            self.unseen, self.link = above.unseen, above.link


def page_blocks(page: str) -> list[tuple[str, int, int, int, int, int, int]]:
    """(text, words, linked words, in an article, a heading, named, hinted) of each block, in page order."""
    blocks: list[tuple] = []
    parts: list[str] = []
    linked = 0
    stack: list[_Open] = [_Open("", None)]
    opened: dict[str, int] = {}  # how many elements of a name are open
    endless: set[str] = set()  # raw elements that have no end behind here
    state = stack[0]

    def close() -> None:
        nonlocal parts, linked
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                blocks.append((" ".join(words), len(words), min(linked, len(words)), int(state.article), int(state.heading), int(state.named), int(state.hinted)))
        parts, linked = [], 0

    def pop() -> None:
        gone = stack.pop()
        opened[gone.name] -= 1
        if gone.splits:
            close()

    def text(piece: str) -> None:
        nonlocal state, linked
        now = stack[-1]
        if piece and not now.unseen:
            if not parts:
                state = now
            parts.append(piece)
            if now.link:
                linked += len(html.unescape(piece).split())

    at, end = 0, len(page)
    while at < end:
        tag = _TAG.search(page, at)
        if tag is None:
            text(page[at:])
            break
        text(page[at : tag.start()])
        at = tag.end()
        if not tag[3]:
            closing = "-->" if tag[0] == "<!--" else "]]>" if tag[0] == "<![CDATA[" else ">"
            found = page.find(closing, at)
            at = found + len(closing) if found >= 0 else end
            continue
        name = tag[3].lower()
        attributes: dict[str, str] = {}
        if page.startswith(">", at):
            at += 1
        else:
            attributes, at = _attributes(page, at)
            if at < 0:
                break  # an unfinished tag
        block = name in BLOCK_TAGS
        if block:
            close()
        if name in VOID_TAGS:
            continue
        if tag[2]:
            if opened.get(name):
                while stack[-1].name != name:
                    pop()
                pop()
            continue
        if name in RAW_TAGS:
            found = None if name in endless else re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            if found is not None:
                at = page.find(">", found.end() - 1) + 1 or end
            elif name in ("script", "style"):
                break
            else:
                endless.add(name)
            continue
        if name in _IMPLIED:
            # these end one that was left open, with the inline tags in it
            k = len(stack) - 1
            while k and not stack[k].block:
                k -= 1
            if k and stack[k].name == name:
                while len(stack) > k:
                    pop()
        above = stack[-1]
        one = _Open(name, above)
        one.link = one.link or name == "a"
        one.heading = one.heading or name in HEADINGS
        one.unseen = one.unseen or name in UNSEEN_TAGS
        if attributes or name in FURNITURE_TAGS or name in ("article", "main"):
            named, hinted, article = _furniture(name, attributes)
            if name == "header" and above.article:
                named = hinted  # an article's own header holds its title
            if name in ("html", "body"):
                named = hinted = article = False
            if article and not named and name in ("article", "main"):
                # an article does not stand inside a menu or page header that was left open before it
                one.named = one.named and not any(opened.get(n) for n in ("nav", "header", "menu"))
            one.article = one.article or (article and block)
            one.splits = not block and (named or hinted)
            one.named, one.hinted = one.named or named, one.hinted or hinted
            style = attributes.get("style", "")
            if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or (style and _NOT_SHOWN.search(style)):
                one.unseen = name not in ("html", "body") or above.unseen
        if one.splits:
            close()
        stack.append(one)
        opened[name] = opened.get(name, 0) + 1
    close()
    return blocks


def features(blocks: list[tuple]) -> list[tuple]:
    """``FEATURES`` of each block; beyond a page's ends stand blocks without words."""
    sizes = [(0, 0.0), *((b[1], b[2] / b[1]) for b in blocks), (0, 0.0)]
    return [(*sizes[i + 1], *sizes[i], *sizes[i + 2], *b[3:]) for i, b in enumerate(blocks)]


# -- the tree ---------------------------------------------------------------------------------


def grow_tree(rows: np.ndarray, labels: np.ndarray, depth: int = 9, least: int = 5):
    """A binary tree by Gini impurity: a label, or (feature, limit, tree up to it, tree above it)."""
    n, ones = len(labels), int(labels.sum())
    if depth and 0 < ones < n:
        best = None
        for f in range(rows.shape[1]):
            order = np.argsort(rows[:, f], kind="stable")
            value, upto = rows[order, f], np.cumsum(labels[order])
            k = np.flatnonzero(value[1:] > value[:-1]) + 1
            k = k[(k >= least) & (n - k >= least)]
            if len(k):
                low, high = upto[k - 1], ones - upto[k - 1]
                score = low * (1 - low / k) + high * (1 - high / (n - k))
                i = int(score.argmin())
                if best is None or score[i] < best[0] - 1e-9:
                    best = (float(score[i]), f, float(value[k[i] - 1] + value[k[i]]) / 2)
        if best is not None:
            _, f, limit = best
            under = rows[:, f] <= limit
            low, high = grow_tree(rows[under], labels[under], depth - 1, least), grow_tree(rows[~under], labels[~under], depth - 1, least)
            return low if low == high and isinstance(low, int) else (f, limit, low, high)
    return int(2 * ones >= n)


def classify(tree, row: tuple) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def labelled_pages(seed: int, pages: int) -> Iterator[tuple[str, list[int]]]:
    """Pages made by rule, each with one label a block (1: main text).

    A third marks its furniture by elements, a sixth by class names, half not at all; some
    articles stand in elements whose names hint at furniture, and some pages hold nothing else.
    """
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join(["word"] * rng.randint(low, high))

    def link(low: int, high: int) -> str:
        return f"<a href=x>{words(low, high)}</a>"

    for _ in range(pages):
        style = rng.choice(("element", "element", "class", "none", "none", "none"))
        bare = rng.random() < 0.15  # nothing but an article, without a title
        out, labels = [], []

        def put(piece: str, label: int, out=out, labels=labels) -> None:
            out.append(piece)
            labels.append(label)

        def furniture(element: str, names: tuple[str, ...], inner: list[str], out=out, style=style, put=put) -> None:
            name = rng.choice(names)
            start, stop = {"element": (f"<{element}>", f"</{element}>"), "class": (f"<div class='{name}'>", "</div>"), "none": ("<div>", "</div>")}[style]
            if element == "div" and style == "element":
                start = f"<div class='{name}'>"
            out.append(start)
            for piece in inner:
                put(f"<div>{piece}</div>", 0)
            out.append(stop)

        if not bare and rng.random() < 0.3:
            furniture("header", ("site-header", "masthead", "banner"), [rng.choice((words, link))(1, 4)])
        if not bare and rng.random() < 0.85:
            furniture("nav", ("nav", "main-menu", "navbar", "widget-list"), [link(1, 3) for _ in range(rng.randint(2, 9))])
        if not bare and rng.random() < 0.7:
            furniture("div", ("ad", "advert", "promo-box", "cookie-notice"), [words(2, 16) if rng.random() < 0.8 else link(2, 12)])
        start = {"element": rng.choice(("<article>", "<main>")), "class": rng.choice(("<div class=post-content>", "<div class='share-your-story'>", "<div class=story>", "<div class='header-news-item'>")), "none": "<div>"}[style]
        out.append(start)
        if not bare:
            put(f"<h1>{words(2, 16)}</h1>", 1)
        elif style != "none":
            put(f"<p>{words(1, 40)}</p>", 1)
        for k in range(rng.randint(1, 10)):
            kind = rng.random()
            if kind < 0.12 and k:
                put(f"<h2>{words(1, 9)}</h2>", 1)
                put(f"<p>{words(20, 120)}</p>", 1)
            elif kind < 0.35 and k:
                put(f"<p>{words(1, 12)}</p>", 1)
                if rng.random() < 0.3:
                    put(f"<p>{words(1, 12)}</p>", 1)
                put(f"<p>{words(12, 120)}</p>", 1)
            elif kind < 0.45:
                put(f"<p>{words(10, 60)} {link(1, 9)} {words(3, 30)}</p>", 1)
            elif kind < 0.5 and k:
                put(f"<p>{link(2, 14)}</p>", 1)
                put(f"<p>{words(20, 90)}</p>", 1)
            elif kind < 0.56 and k:
                for _ in range(rng.randint(3, 6)):
                    put(f"<li>{link(1, 6)}</li>", 0)
                put(f"<p>{words(20, 120)}</p>", 1)
            elif kind < 0.68 and style != "none":  # verse, dialogue
                for _ in range(rng.randint(2, 9)):
                    put(f"<p>{words(1, 12)}</p>", 1)
            elif kind < 0.72 and style != "none":
                furniture("aside", ("sidebar", "ad", "related"), [words(2, 40)])
                put(f"<p>{words(20, 120)}</p>", 1)
            else:
                put(f"<p>{words(12, 150)}</p>", 1)
        if style != "none" and rng.random() < 0.6:
            for _ in range(rng.randint(1, 3)):
                put(f"<p>{words(1, 30)}</p>", 1)
        out.append("</article>" if start == "<article>" else "</main>" if start == "<main>" else "</div>")
        if style != "none" and rng.random() < 0.35:
            furniture("aside", ("comments", "reader-comments", "comment"), [words(2, 90) for _ in range(rng.randint(1, 4))])
        if rng.random() < 0.3:
            furniture("aside", ("related", "widget", "tag-list-widget"), [link(1, 9) for _ in range(rng.randint(2, 6))])
        if rng.random() < 0.2 and style != "none":
            furniture("form", ("newsletter-signup", "search", "subscribe"), [words(2, 25)])
        if not bare and rng.random() < 0.8:
            furniture("footer", ("footer", "site-footer", "legal"), [words(3, 14) if rng.random() < 0.6 else f"{words(1, 4)} {link(1, 4)}" for _ in range(rng.randint(1, 2))])
        yield "<html><body>" + "".join(out) + "</body></html>", labels


def labelled_table(seed: int = 3, pages: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of :func:`labelled_pages`, as this module's own parser sees them."""
    rows, labels = [], []
    for page, marks in labelled_pages(seed, pages):
        rows += features(page_blocks(page))
        labels += marks
    return np.array(rows, float), np.array(labels, np.int64)


@cache
def default_tree():
    return grow_tree(*labelled_table())


def _chosen(blocks: list[tuple], tree) -> list[tuple]:
    return [b for b, row in zip(blocks, features(blocks), strict=True) if classify(tree, row)]


def main_text(page: str | None, tree=None) -> str:
    """The blocks that the tree takes for main text, joined by one space.

    A page of which nothing is taken, though it has text, is judged once more: without names where it has long unlinked blocks (its
    article stands in an element with a misleading name), else by taking its unlinked blocks outside all furniture (it is too short for a judgement by sizes).
    """
    if not page:
        return ""
    tree = default_tree() if tree is None else tree
    blocks = page_blocks(page)
    found = _chosen(blocks, tree)
    if not found and any(b[1] >= LONG_WORDS and b[2] <= UNLINKED * b[1] for b in blocks):
        found = _chosen([(*b[:5], 0, 0) for b in blocks], tree)
    if not found:
        found = [b for b in blocks if b[2] <= UNLINKED * b[1] and not b[5] and not b[6]]
    return " ".join(b[0] for b in found)


def _extractor(tree):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), tree) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return extract


def extract_main_text(pages: DataFrame, tree=None) -> DataFrame:
    """``pages(page_id, url, html)`` to page_id, url, text, n_chars: one row per page.

    ``tree``: a tree of :func:`grow_tree` over ``FEATURES``, for other labelled tables than the default.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extractor(default_tree() if tree is None else tree), "page_id long, url string, text string, n_chars long")
