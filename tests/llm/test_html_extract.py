"""Extraction: flat blocks against another parser, the tree and its densities, odd pages."""

import html
import random
import re
import time
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest

from tallyhouse.llm import html_extract as he
from tallyhouse.llm import queries

SF = "/root/testdata/sf0.01"
PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>More</a></li></ul></nav>
<!-- no --><div class="cookie-notice"><p>We use cookies on this site to make it better for all of you</p></div><div class="ad">Buy this now and you will never regret it again</div>
<article><h1>A &lt;b&gt; &amp; c</h1><p>wor<b>d</b>&nbsp; one&#33;<p>two <script>x("</p>")</script> three<form>Search <input> here</form><table><tr><td>cell</table>
<aside>Side words that are not of the article at all</aside></article><div id="comments"><p>What a great post this is, thank you so much for it</p></div>
<footer>&copy; me</footer></body></html>"""


class Flat(HTMLParser):
    """(text, linked words) of the flat blocks of a well-formed page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.parts, self.links, self.unseen = [], [], 0, 0

    def cut(self):
        text = " ".join("".join(p for p, _ in self.parts).split())
        if text:
            self.blocks.append((text, sum(len(p.split()) for p, linked in self.parts if linked)))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in he.BLOCK_TAGS:
            self.cut()
        self.links += tag == "a"
        self.unseen += tag in he.RAW_TAGS | he.UNSEEN_TAGS

    def handle_endtag(self, tag):
        if tag in he.BLOCK_TAGS:
            self.cut()
        self.links -= tag == "a"
        self.unseen -= tag in he.RAW_TAGS | he.UNSEEN_TAGS

    def handle_data(self, data):
        if not self.unseen:
            self.parts.append((data, self.links > 0))


def flat_blocks(page):
    parser = Flat()
    parser.feed(page)
    parser.close()
    parser.cut()
    return parser.blocks


def test_blocks_against_another_parser():
    pages = [r[0] for r in duckdb.sql(f"select html from '{SF}/pages.parquet'").fetchall()] + [p for p, _ in he.labelled_pages(9, 60)]
    for page in pages:
        assert [(b[0], b[2]) for b in he.page_blocks(page)] == flat_blocks(page)


def test_text_of_all_given_pages_is_their_article(spark):
    rows = queries.op1_html_extraction(spark, SF).collect()
    pages = dict(duckdb.sql(f"select page_id, html from '{SF}/pages.parquet'").fetchall())
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(t for t, _ in flat_blocks(article)) and r["n_chars"] == len(r["text"])


def test_the_tree_on_pages_it_was_not_grown_on():
    rows, labels = he.labelled_table(seed=77, pages=150)
    assert len(rows) >= 300
    found = np.array([he.classify(he.default_tree(), tuple(r)) for r in rows.tolist()])
    assert (found == labels).mean() >= 0.985


def used(tree):
    return set() if isinstance(tree, int) else {he.FEATURES[tree[0]]} | used(tree[2]) | used(tree[3])


def test_the_tree_uses_the_neighbours_and_their_densities_change_texts():
    tree = he.default_tree()
    assert {"words", "density", "density before", "density after"} <= used(tree)
    rng, changed = random.Random(3), dict.fromkeys(("words", "density", "density before", "density after"), 0)
    pages = [he.features(he.page_blocks(p)) for p, _ in he.labelled_pages(5, 120)]
    for name in changed:
        k = he.FEATURES.index(name)
        for rows in pages:
            column = [r[k] for r in rows]
            rng.shuffle(column)
            other = [(*r[:k], x, *r[k + 1 :]) for r, x in zip(rows, column, strict=True)]
            changed[name] += [he.classify(tree, r) for r in rows] != [he.classify(tree, r) for r in other]
    assert all(changed.values()), changed


def test_pages_without_any_names_are_told_by_density():
    menu = "".join(f"<div><a href=x>{w}</a></div>" for w in ("One", "Two things", "Three"))
    story = "<div>A fine headline</div>" + "".join(f"<div>{'some words here ' * n}</div>" for n in (20, 9, 30))
    page = f"<div>{menu}</div><div>A short advert line</div>{story}<div>All rights kept</div>"
    text = he.main_text(page)
    assert "Three" not in text and "rights" not in text and text.count("some words here") == 59


def test_extraction_keeps_the_article_only():
    assert he.main_text(PAGE) == "A <b> & c word one! two three cell"
    assert he.main_text(PAGE[: PAGE.index(" three")]) == "A <b> & c word one! two"
    for odd in (None, "", " ", "<", "<p", "plain " * 30, "<p>" * 3000 + "x", "<![CDATA[x]]>", "<!-- open", "</p></p>", "<script>never closed", "<p a='", '<p a="b', "<p =>", "<!", "<a href=x"):
        he.main_text(odd)


def test_marks_on_inline_elements_unclosed_objects_and_stray_quotes():
    long = "plain words of an article " * 8
    page = f"<article><p>{long}<span class='advert'>Buy this</span> <span style='display: none'>secret</span> <i hidden>unseen</i> {long}</p></article>"
    assert he.main_text(page) == " ".join((long + long).split())
    for tag in ("iframe", "svg", "button", "select", "object", "canvas"):
        assert he.main_text(f"<article><p>{long}</p><div>x <{tag}></div><p>{long}</p></article>").count("article") == 16
    assert he.main_text(f"<article><p title=it's>{long}</p><p>{long}</p></article>").count("article") == 16
    assert he.main_text(f"<main><div class='share-your-story'><p>{long}</p><p>{long}</p></div></main>").count("article") == 16
    assert "sidebar" not in he.main_text(f"<main><p>{long}</p><div class='left-sidebar'>the sidebar has a good many words too</div><p>{long}</p></main>")


def test_open_tags_take_linear_time():
    for make in (lambda n: "<div>" * n + "</p>" * n, lambda n: "<b>" * n + "<p>" * n, lambda n: "<iframe>" * n + "<article>" * n, lambda n: "<p title='>" * n, lambda n: "<p/><i>" * n, lambda n: "<" * n, lambda n: "<!--" * n):
        started = time.process_time()
        he.page_blocks(make(100_000))
        assert time.process_time() - started < 15


def test_odd_rows(spark):
    rows = [(1, "u", None, "a", 1), (2, None, "", "b", 2), (None, "u", PAGE, "c", 3), (3, "u", PAGE, "c", 4), (3, "u", PAGE, "c", 4), (4, "w", "<article>" + "<p>many words are here again and again</p>" * 20_000, None, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = sorted((tuple(r) for r in he.extract_main_text(pages).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert [r[:2] for r in got] == [(1, "u"), (2, None), (3, "u"), (3, "u"), (4, "w"), (None, "u")]
    assert got[0][2:] == ("", 0) == got[1][2:] and got[2] == got[3] and got[2][2] == got[5][2] == html.unescape("A &lt;b&gt; &amp; c word one! two three cell")
    assert got[4][3] == 20_000 * 36 - 1
    assert he.extract_main_text(pages.where("false")).collect() == []


WRAPPERS = ("with-sidebar", "no-sidebar", "content has-comments", "post no-header", "page-with-toolbar", "hentry tags", "article-with-ads", "theme-social", "layout-footer", "header-nav")


@pytest.mark.parametrize("name", WRAPPERS)
def test_an_article_in_a_misleadingly_named_element_stays(name):
    article = "".join(f"<p>{'word ' * 30}end{k}</p>" for k in range(4))
    page = f"<html><body><nav><a href=x>home</a><a href=y>about us</a></nav><div class='{name}'><h1>Title of it</h1>{article}</div><footer>Copyright 2020</footer></body></html>"
    text = he.main_text(page)
    assert text.startswith("Title of it") and all(f"end{k}" in text for k in range(4)) and "home" not in text and "Copyright" not in text


def test_very_short_pages_and_pages_of_furniture():
    assert he.main_text("<p>Hello there.</p>") == "Hello there."
    assert he.main_text("<nav><a href=x>a b c</a></nav><footer>c</footer>") == ""
    assert he.main_text("<div class='cookie-notice'>We use cookies.</div>") == ""
