"""Language identification by cross-parsing entropy.

A suffix automaton is built on labelled text of each language.  A document is parsed with each
automaton into longest matches (every phrase is the longest text from its start that occurs in
the language's sample).  Longer samples give longer matches, by the logarithm of their length,
so phrases are normalised: a phrase costs log2 of the sample's length, for its place, and log2 of the number of letters,
for the one that it could not match.  That cost per letter is the cross-parsing estimate of entropy, and the
language with the least of it wins; a label with a few letters pays a letter for every phrase, one without any is never predicted.

The automata are tables of transitions in which a failed step already leads where the next
phrase starts.  Blocks of ``BLOCK`` letters of all texts step through them together, each from a
phrase start of its own; then every block's parse is carried on into the next block until both
start a phrase at the same letter, from where they are the same.  So the counts are those of one
parse of the whole text.  Every letter of the samples has a transition: a language's ``DENSE``
most frequent letters in a table, all others in a sorted list.

Only the training sample is bounded: ``pieces`` pieces of ``PIECE_CHARS`` characters a language,
drawn by hash from all pieces of all labelled texts.  Languages are the non-null values of the
label column.

Nulls, empties and ties: a null or empty text, or one without any letter, is ``und`` with score
0; equal entropies go to the language that sorts first; repeated rows get equal answers; if
nothing is labelled, everything is ``und``.  The score is the winner's lead over the next
language, as a share of the latter's entropy (1 when only one language is known).  Texts of any
length are parsed whole.  An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.kernels import slices, text_buffers

BLOCK = 256
#: Bytes of text that step through the automata together.
PARSE_BYTES = 1_500_000
#: Blocks that are followed one by one rather than together.
FEW = 32
SAMPLE_PIECES = 24
PIECE_CHARS = 1000
DENSE = 62
#: A text is in none of the languages if its best entropy is over this many times the upper quartile of what labelled
#: texts need that are not in the sample.
FOREIGN = 2.0
UNDETERMINED = "und"
_SPACE, _ABSENT = 0, 1
_NEW = np.int32(1 << 30)  # the step began a new phrase


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings, by state; state 0 is the start."""
    goes: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for s in symbols:
        new = len(goes)
        goes.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in goes[p]:
            goes[p][s] = new
            p = link[p]
        if p >= 0:
            q = goes[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(goes)
                goes.append(dict(goes[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and goes[p].get(s) == q:
                    goes[p][s] = twin
                    p = link[p]
        last = new
    return goes


class Automaton:
    """One language's transitions: a state is its row's start in the table of frequent letters."""

    def __init__(self, sample: np.ndarray, symbols: int, dense: int = DENSE):
        counts = Counter(sample.tolist())
        counts.pop(_SPACE, None)
        letters = sorted(counts, key=lambda s: (-counts[s], s))
        column = {_SPACE: 0} | {s: i + 2 for i, s in enumerate(letters)}
        self.column = np.ones(symbols, np.int32)  # of every symbol; letters that the sample lacks share one
        self.column[list(column)] = list(column.values())
        self.width = w = 2 + min(len(letters), dense)
        goes = suffix_automaton([column[s] for s in sample.tolist()])
        # one more state, where nothing is matched yet: the start, and after a letter that the sample lacks
        self.start = start = np.int32(len(goes) * w)
        anew = np.full(2 + len(letters), start + _NEW, np.int32)
        for s, to in goes[0].items():
            anew[s] = to * w + _NEW
        table = np.repeat(anew[None, :w], len(goes) + 1, axis=0)
        rare: list[tuple[int, int]] = []
        self.span = max(1, len(letters) - dense)
        for state, arcs in enumerate(goes):
            for s, to in arcs.items():
                if s < w:
                    table[state, s] = to * w
                else:
                    rare.append((state * self.span + s - w, to * w))
        rare.sort()
        self.table, self.anew = table.ravel(), anew
        self.rare_key, self.rare_to = np.array([k for k, _ in rare], np.int64), np.array([t for _, t in rare], np.int32)
        # a phrase says where in the sample it is, and which letter it ended before
        self.bits = math.log2(1 + len(sample)) + math.log2(max(2, symbols))

    def step(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Next states, plus ``_NEW`` where a phrase begins."""
        if not len(self.rare_key):
            return self.table[state + column]
        went = self.table[state + np.minimum(column, self.width - 1)]
        rare = np.flatnonzero(column >= self.width)
        if len(rare):
            key = (state[rare] // self.width).astype(np.int64) * self.span + column[rare] - self.width
            at = np.minimum(np.searchsorted(self.rare_key, key), len(self.rare_key) - 1)
            went[rare] = np.where(self.rare_key[at] == key, self.rare_to[at], self.anew[column[rare]])
        return went

    def follow(self, state: int, columns: list[int], began: list[bool]) -> tuple[int, int, int, bool]:
        """Steps of one block until it starts a phrase where ``began`` says so too: state, own phrases, theirs, and if that came."""
        mine = theirs = 0
        for c, other in zip(columns, began, strict=True):
            if c < self.width:
                went = self.table.item(state + c)
            else:
                went = self.step(np.array([state], np.int32), np.array([c], np.int32)).item()
            theirs += other
            if went >= 1 << 30:
                state, mine = went - (1 << 30), mine + 1
                if other:
                    return state, mine, theirs, True
            else:
                state = went
        return state, mine, theirs, False


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray  # of every code point
    automata: list[Automaton]
    limit: float  # entropy beyond which a text is in none of the languages


def letter_case_fold(text: str) -> np.ndarray:
    """Code points of the lower-cased text."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _symbols(codes: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    out = symbol[codes]
    if len(out) > 1:  # runs of anything but letters are one separator
        keep = np.ones(len(out), bool)
        keep[1:] = (out[1:] != _SPACE) | (out[:-1] != _SPACE)
        out = out[keep]
    return out


def fit(samples: dict[str, list[str]], dense: int = DENSE) -> Model:
    """A model from labelled texts."""
    samples = {k: v for k, v in samples.items() if any(c.isalpha() for t in v for c in t)}
    languages = sorted(samples)
    symbol = np.fromiter((_ABSENT if chr(c).isalpha() else _SPACE for c in range(0x110000)), np.int32, 0x110000)
    letters = sorted({c for texts in samples.values() for text in texts for c in text.lower() if c.isalpha()})
    symbol[[ord(c) for c in letters]] = np.arange(2, len(letters) + 2)

    def build(part: dict[str, list[str]]) -> Model:
        automata = []
        for language in languages:
            pieces = [np.append(np.int32(_SPACE), _symbols(letter_case_fold(t), symbol)) for t in part[language]]
            automata.append(Automaton(np.concatenate(pieces) if pieces else np.zeros(0, np.int32), len(letters) + 2, dense))
        return Model(languages, symbol, automata, math.inf)

    model = build(samples)
    # what labelled text needs that is not in the sample: every fourth piece, parsed with the others
    apart = {k: v[3::4] for k, v in samples.items()}
    if any(apart.values()):
        rest = build({k: [t for i, t in enumerate(v) if i % 4 != 3] for k, v in samples.items()})
        own = _entropies([_symbols(letter_case_fold(t), symbol) for v in apart.values() for t in v], rest).min(axis=1)
        model.limit = FOREIGN * float(np.quantile(own, 0.75)) or math.inf
    return model


def phrase_counts(texts: list[np.ndarray], model: Model) -> np.ndarray:
    """Phrases that each language needs for each sequence of symbols: texts x languages."""
    lengths = np.array([len(t) for t in texts], np.int64)
    blocks = -(-lengths // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    lanes = int(first[-1])
    out = np.zeros((len(texts), len(model.languages)), np.int64)
    if not lanes or not model.languages:
        return out
    grid = np.zeros(lanes * BLOCK, np.int32)
    for i, text in enumerate(texts):
        at = first[i] * BLOCK
        grid[at : at + len(text)] = text
    lane_length = np.minimum(np.repeat(lengths, blocks) - (np.arange(lanes) - np.repeat(first[:-1], blocks)) * BLOCK, BLOCK)
    follows = np.ones(lanes, bool)
    full = np.flatnonzero(blocks)
    follows[first[:-1][full]] = False
    order = np.argsort(-lane_length, kind="stable")  # those still running are always the first ones
    place = np.empty(lanes, np.int64)
    place[order] = np.arange(lanes)
    symbols = np.ascontiguousarray(grid.reshape(lanes, BLOCK)[order].T)
    length = lane_length[order]
    later = order[follows[order]]  # blocks that carry a parse on, as lanes in the order of texts
    for k, automaton in enumerate(model.automata):
        phrases, _ = _parsed(automaton, automaton.column[symbols], length, place[later], place[later - 1])
        out[full, k] = np.add.reduceat(phrases[place], first[:-1][full])
    return out


def _parsed(automaton: Automaton, steps: np.ndarray, length: np.ndarray, later: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that begin in each block of a parse of the whole texts, and the state at its end.

    ``steps`` has blocks as columns, longest first; ``before`` is the block that precedes each of ``later``.
    """
    lanes = len(length)
    running = np.searchsorted(-length, -np.arange(BLOCK), side="left")
    state, alone = np.full(lanes, automaton.start, np.int32), np.zeros(lanes, np.int32)
    began = np.zeros((BLOCK, lanes), bool)
    for j in range(BLOCK):
        m = running[j]
        if not m:
            break
        went = automaton.step(state[:m], steps[j, :m])
        new = went >> 30
        began[j, :m] = new
        alone[:m] += new
        state[:m] = went - (new << 30)
    phrases, end, used = alone.copy(), state.copy(), np.full(lanes, -1, np.int32)
    while True:
        # blocks whose predecessor ends otherwise than their parse was last begun with
        which = np.flatnonzero(used[later] != end[before])
        if not len(which):
            return phrases, end
        lane = later[which]
        now = end[before[which]]
        used[lane] = now
        mine, own = np.zeros(len(lane), np.int32), np.zeros(len(lane), np.int32)
        j, shortest = 0, int(length[lane].min())
        while len(lane) > FEW and j < BLOCK:
            if j >= shortest:
                over = length[lane] <= j
                phrases[lane[over]], end[lane[over]] = mine[over], now[over]  # the block ends before both agree
                lane, now, mine, own = (x[~over] for x in (lane, now, mine, own))
                shortest = int(length[lane].min()) if len(lane) else BLOCK
                continue
            went = automaton.step(now, steps[j, lane])
            new = went >> 30
            theirs = began[j, lane]
            mine += new
            own += theirs
            now = went - (new << 30)
            same = theirs & (new > 0)
            if same.any():
                at = lane[same]
                phrases[at], end[at] = alone[at] - own[same] + mine[same], state[at]
                lane, now, mine, own = (x[~same] for x in (lane, now, mine, own))
            j += 1
        # the last few one by one
        for i, at in enumerate(lane.tolist()):
            to = int(length[at])
            found, more, theirs, agree = automaton.follow(int(now[i]), steps[j:to, at].tolist(), began[j:to, at].tolist())
            phrases[at] = alone[at] - own[i] - theirs + mine[i] + more if agree else mine[i] + more
            end[at] = state[at] if agree else found


def _entropies(texts: list[np.ndarray], model: Model) -> np.ndarray:
    """Normalised phrases per symbol: texts x languages; the two phrases cut by a text's ends do not count against it."""
    counts = phrase_counts(texts, model)
    bits = np.array([a.bits for a in model.automata])
    return np.maximum(counts - 2, 0) * bits[None, :] / np.maximum(1, [len(t) for t in texts])[:, None]


def _answers(column: pa.Array, model: Model) -> tuple[list[str], list[float], list[bool]]:
    """Language, score, and whether the text is in that language at all."""
    raw, offsets = text_buffers(column)
    names, scores, held = [], [], []
    bits = np.array([a.bits for a in model.automata])
    for a, b in slices(offsets, PARSE_BYTES):
        texts = [_symbols(letter_case_fold(str(raw[offsets[i] : offsets[i + 1]], "utf-8")), model.symbol) for i in range(a, b)]
        counts = phrase_counts(texts, model)
        for text, row in zip(texts, counts, strict=True):
            if not len(row) or not (text != _SPACE).any():
                names.append(UNDETERMINED)
                scores.append(0.0)
                held.append(False)
                continue
            normal = row * bits
            best = int(normal.argmin())
            others = np.delete(normal, best)
            names.append(model.languages[best])
            scores.append(float(1 - normal[best] / others.min()) if len(others) and others.min() > 0 else float(not len(others)))
            held.append(max(0, int(row[best]) - 2) * float(bits[best]) / len(text) <= model.limit)
    return names, scores, held


def _predictor(held):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, _ = _answers(batch.column("text"), held.value)
            columns = [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    return predict


def _keeper(held, languages: frozenset[str] | None):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, _, inside = _answers(batch.column("text"), held.value)
            kept = [i and (languages is None or n in languages) for n, i in zip(names, inside, strict=True)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return keep


def training_sample(labelled: DataFrame, pieces: int = SAMPLE_PIECES, chars: int = PIECE_CHARS) -> dict[str, list[str]]:
    """At most ``pieces`` pieces of ``chars`` characters a language, chosen by hash from all of ``labelled(doc_id, text, lang)``."""
    known = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    # the pieces of a text are only cut out where their hash is among the small ones
    places = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chars).cast("int"))
    cut = known.select("lang", "text", F.xxhash64("doc_id", "text").alias("doc"), F.explode(places).alias("k"))
    cut = cut.select("lang", F.xxhash64("doc", "k").alias("key"), "text", "k")
    counts = known.groupBy("lang").agg(F.sum(F.floor((F.length("text") - 1) / chars) + 1).alias("n")).collect()  # one row a language
    if not counts:
        return {}
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 4.0 * pieces / r["n"]))])
    near = cut.where(F.pmod("key", F.lit(1_000_003)) < F.element_at(shares, F.col("lang")) * 1_000_003)
    near = near.select("lang", "key", F.substring("text", F.col("k") * chars + 1, F.lit(chars)).alias("text"))
    ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("key", "text"))).where(F.col("place") <= pieces)
    sample: dict[str, list[str]] = {}
    for r in ranked.orderBy("lang", "place").collect():
        sample.setdefault(r["lang"], []).append(r["text"])
    return sample


def train(labelled: DataFrame, pieces: int = SAMPLE_PIECES, chars: int = PIECE_CHARS) -> Model:
    return fit(training_sample(labelled, pieces, chars))


def predict_language(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, lang_pred, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # some 12 MB a language, bounded by the sample
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_predictor(held), "doc_id long, lang_pred string, score double")


def keep_languages(docs: DataFrame, model: Model, languages: list[str] | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a learned language, or in one of ``languages`` if those are given.

    A text goes if it has no letter, or if even the best language needs more normalised phrases per
    letter than ``FOREIGN`` times what labelled texts outside the sample need.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keeper(held, frozenset(languages) if languages is not None else None), docs.schema)


def held_out(doc_id: Column) -> Column:
    """Whether CRC-32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
