"""Periodic runs of words, found with an enhanced suffix array and the branching-tandem test.

A run is a stretch of words with smallest period q, at least ``max(min_words, 2 * q)`` long, that no
neighbouring word extends with that period.

1. Words are numbered exactly.  The suffix array of all texts of a batch is built by prefix doubling; a
   suffix never matches one of another text.  The ranks of each doubling step are kept: two stretches of
   2**k words are equal if and only if their ranks at step k are.
2. The array of longest common prefixes follows from those ranks.  Each of its values d splits the interval
   of suffixes that share d words into the part before and the part after it.  For every suffix i of the
   smaller part, the inverse suffix array tells whether i + d or i - d lies in the other part: then d words
   from i repeat at once and the next word differs, a branching square.  The smaller parts of all intervals
   hold O(n log n) suffixes; there are no tree nodes.
3. A run's last square is branching, so each run is met.  Squares are rotated to the left as far as the words
   allow (by the ranks, O(log n) a square) and squares of one stretch are merged: the smallest period is its own.

Nulls, empties and ties: a null or empty text, or one without words, has no runs and an empty collapsed
text; rows are independent of each other, so repeated rows, repeated ids and null ids simply give a row each;
runs are listed by start, then period.  A text is held whole by one task, at some 200 bytes a word plus 4 a word for
each doubling step; its cost is O(n log n) whatever its words are.  Further columns, of whatever name, are not
read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.kernels import slices, text_buffers
from tallyhouse.llm.words import word_numbers, word_spans

#: The shortest stretch that counts as a run.
MIN_WORDS = 12
#: Suffixes of smaller parts that are checked at once.
_CHECKS = 2_000_000

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def suffix_array(numbers: np.ndarray, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and for k = 0, 1, … the ranks of all stretches of 2**k words, with -1 behind the last.

    ``numbers`` are the words, ``text`` which text each belongs to, ``ends`` where that text ends.
    """
    n = len(numbers)
    place = np.arange(n)
    key = text * (int(numbers.max(initial=0)) + 1) + numbers
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    starts = np.flatnonzero(new)
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = starts[np.cumsum(new) - 1]
    levels, step = [rank], 1
    alone = new.copy()
    alone[:-1] &= new[1:]
    open_ = order[~alone]
    while len(open_):
        ahead = open_ + step
        second = np.where(ahead < ends[open_], rank[np.minimum(ahead, n)], -1).astype(np.int64) + 1
        first = rank[open_].astype(np.int64)
        sort = np.argsort(first * (n + 1) + second, kind="stable")
        open_, first, second = open_[sort], first[sort], second[sort]
        group = np.ones(len(open_), bool)
        group[1:] = first[1:] != first[:-1]
        finer = group.copy()
        finer[1:] |= second[1:] != second[:-1]
        here = place[: len(open_)]
        begun = here[group][np.cumsum(group) - 1]
        order[first + here - begun] = open_
        rank = rank.copy()
        rank[open_] = first + here[finer][np.cumsum(finer) - 1] - begun
        levels.append(rank)
        step *= 2
        alone = finer.copy()
        alone[:-1] &= finer[1:]
        open_ = open_[~alone]
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many words each suffix shares with the one before it in the order."""
    shared = np.zeros(len(order), np.int64)
    at = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1 if len(order) else np.zeros(0, np.int64)
    a, b = order[at - 1].copy(), order[at].copy()
    found = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        equal = levels[k][a] == levels[k][b]
        step = equal.astype(np.int64) << k
        a += step
        b += step
        found += step
    shared[at] = found
    return shared


def _nearest(values: np.ndarray, strict: bool) -> np.ndarray:
    """For each place the nearest one to its left with a smaller (or, if not strict, no larger) value; -1 if there is none."""
    found = np.arange(-1, len(values) - 1)
    left = np.arange(len(values))
    while len(left):
        at = found[left]
        on = np.flatnonzero((at >= 0) & ((values[at] >= values[left]) if strict else (values[at] > values[left])))
        left = left[on]
        found[left] = found[at[on]]
    return found


def branching_squares(order: np.ndarray, shared: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of the squares whose next word differs from the one a period before it.

    ``starts`` and ``ends`` say for each word where its text begins and ends.
    """
    n = len(order)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    left = _nearest(shared, strict=True)
    right = n - 1 - _nearest(shared[::-1], strict=False)[::-1]
    # a square of this period must fit into the text
    cut = np.flatnonzero((shared > 0) & (2 * shared <= (ends - starts)[order])) if n else np.zeros(0, np.int64)
    low, high = np.maximum(left[cut], 0), right[cut]
    before = cut - low <= high - cut
    first, size = np.where(before, low, cut), np.where(before, cut - low, high - cut)
    other_low, other_high = np.where(before, cut, low), np.where(before, high, cut)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    upto = np.cumsum(size)
    a = 0
    while a < len(cut):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + _CHECKS, side="right")))
        many = size[a:b]
        which = np.repeat(np.arange(a, b), many)
        i = order[first[which] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        d = shared[cut[which]]
        for j, at, inside in ((i + d, i, i + d < ends[i]), (i - d, i - d, i - d >= starts[i])):
            which_in, where = which[inside], inverse[j[inside]]
            hit = (where >= other_low[which_in]) & (where < other_high[which_in])
            found.append((at[inside][hit], d[inside][hit]))
        a = b
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def merged_runs(square: np.ndarray, period: np.ndarray, levels: list[np.ndarray], starts: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of the runs: squares rotated to the left, the least period of each stretch, in order."""
    at = square.copy()
    if len(square):
        floor = starts[square]
        for k in range(len(levels) - 1, -1, -1):
            back = at - (1 << k)
            fits = back >= floor
            equal = fits & (levels[k][np.where(fits, back, 0)] == levels[k][np.where(fits, back + period, 1)])
            at -= equal.astype(np.int64) << k
    end = square + 2 * period
    order = np.lexsort((period, end, at))
    at, end, period = at[order], end[order], period[order]
    keep = np.ones(len(at), bool)
    keep[1:] = (at[1:] != at[:-1]) | (end[1:] != end[:-1])
    keep &= end - at >= min_words
    at, end, period = at[keep], end[keep], period[keep]
    order = np.lexsort((period, at))
    return at[order], end[order], period[order]


def _finder(min_words: int):
    def found(raw: np.ndarray, offsets: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
        start, end, text = word_spans(raw, offsets)
        numbers, _ = word_numbers(raw, start, end)
        texts, n = len(offsets) - 1, len(numbers)
        first = np.searchsorted(text, np.arange(texts + 1))
        starts, ends = first[text], first[text + 1]
        order, levels = suffix_array(numbers, text, ends)
        square, period = branching_squares(order, common_prefixes(order, levels), starts, ends)
        run, stop, period = merged_runs(square, period, levels, starts, min_words)
        # words behind the first period of any run
        depth = np.zeros(n + 1, np.int64)
        np.add.at(depth, run + period, 1)
        np.add.at(depth, stop, -1)
        kept = np.cumsum(depth[:-1]) == 0
        # of the kept words but a text's last, the byte behind them is white space of the same text: it becomes the one space
        bytes_, marks = np.append(raw, np.uint8(32)), np.zeros(len(raw) + 2, np.int32)
        place = np.flatnonzero(kept)
        last = np.ones(len(place), bool)
        last[:-1] = text[place[1:]] != text[place[:-1]]
        bytes_[end[place[~last]]] = 32
        np.add.at(marks, start[place], 1)
        np.add.at(marks, end[place] + ~last, -1)
        taken = np.cumsum(marks[:-1]) > 0
        edges = np.concatenate([[0], np.cumsum(taken)])[offsets]
        collapsed = pa.Array.from_buffers(pa.large_string(), texts, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(bytes_[taken]))])
        of = text[run] if len(run) else np.zeros(0, np.int64)
        spans = pa.StructArray.from_arrays([pa.array(run - first[of]), pa.array(stop - run), pa.array(period)], fields=list(_RUNS.value_type))
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(texts + 1)), pa.int32()), spans)
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(first)), lists, collapsed.cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            for a, b in slices(offsets):
                yield found(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], batch.column("doc_id").slice(a, b - a))

    return run


def find_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, n_words, the runs (start, length, period; word numbers from 0) and the collapsed text.

    The collapsed text holds the words joined by one space, without those that a run has behind its first period.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_finder(min_words), _SCHEMA)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with every tenth text (by the CRC-32 of its id) made periodic from some word on.

    Of the n words of such a text, each word i >= a becomes word a + (i - a) % p; a and p follow from the id and n.
    A null id plants nothing.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    split = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).alias("words"), F.floor(h / 10).alias("g"))
    sized = split.withColumn("n", F.coalesce(F.size("words"), F.lit(0)).cast("long"))
    placed = sized.withColumn("a", F.when(F.col("n") > 0, F.pmod("g", "n")))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.pmod(F.col("g"), F.lit(8)))))

    def part(of, first, size):
        return F.slice(of, first.cast("int"), size.cast("int"))

    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    repeated = F.flatten(F.array_repeat(part("words", F.col("a") + 1, F.col("p")), times))
    whole = part(F.concat(part("words", F.lit(1), F.col("a")), repeated), F.lit(1), F.col("n"))
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))
