"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are lower-cased, and everything but letters and digits becomes one
space.  If an item of m characters occurs with at most k edits, at least m + 1 - q (k + 1) of
its q-grams occur unchanged, on diagonals (text position minus item position) at most k apart.
So q-grams shared with an item are counted in overlapping bands of diagonals; bands that meet
the bound are kept and verified by an alignment limited to the band.

q-grams that many items share (openings like "which of the following") are left out of an item's
index as long as its bound, less one for each, stays at a quarter: the rarer ones decide, and
nothing is lost.  The pairs of a text and the index are counted a bounded number at a time.  The
alignment goes by diagonals (how far each gets with 0, 1, 2, ... edits), so it costs little where
few edits are needed.

The benchmark is taken in blocks of a bounded size: each block's q-gram index is broadcast and
meets all documents in one more pass, so a benchmark of any size is searched.

Nulls, empties and ties: null or empty texts contain nothing, and empty items (or items without
letters and digits) are found nowhere; items with fewer than ``EXACT_CHARS`` characters are found
unedited and as whole words only; equal items are found each by its own id; a repeated document
gives repeated rows; of overlapping finds of one item in one document the best (then the first)
is returned.  Texts and items of any length are searched whole, a text in the memory of one task.
No documents or no items give no rows; further columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.kernels import mix, slices, text_buffers

Q = 10
EDIT_SHARE = 0.05
#: Items under this length are found unedited, as whole words.
EXACT_CHARS = 20
#: A q-gram with more places in the items is common; pairs of places in a text and in items that are counted at once.
COMMON = 64
PAIRS = 1_000_000
BLOCK_CHARS = 4_000_000
_FOUND = "doc_id long, item_id long, start long, end long, distance int, item_chars int"
_BASE = np.uint64(0x9E3779B97F4A7C15)


@cache
def _kept() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(1 << 16)])


def normalised(text: str) -> np.ndarray:
    """Code points of the lower-cased letters and digits, with one space for every run of others between them."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    good = _kept()[np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        good[high] = [chr(c).isalnum() for c in codes[high].tolist()]
    keep = good.copy()
    keep[1:] |= good[:-1]  # the first of other characters after a kept one
    out = np.where(good, codes, 32)[keep]
    return out[:-1] if len(out) and out[-1] == 32 else out


def q_grams(codes: np.ndarray, q: int) -> np.ndarray:
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = codes.astype(np.uint64)
    h = wide[:n].copy()
    for j in range(1, q):
        h *= _BASE
        h += wide[j : j + n]
    return mix(h)


def _hash(windows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(windows), np.uint64)
    for j in range(windows.shape[1]):
        h *= _BASE
        h += windows[:, j].astype(np.uint64)
    return mix(h)


class ItemIndex:
    """The q-grams of one block of items, with a bitmap that turns most others away."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, share: float = EDIT_SHARE, least: int = 1):
        self.q, every = q, [(i, c) for i, t in items if len(c := normalised(t or "")) >= max(least, 1)]
        exact = max(EXACT_CHARS, q)
        self.short: dict[int, tuple[np.ndarray, list[tuple[int, np.ndarray]]]] = {}
        for size in sorted({len(c) for _, c in every if len(c) < exact}):
            same = [(i, c) for i, c in every if len(c) == size]
            hashes = _hash(np.stack([c for _, c in same]))
            order = np.argsort(hashes, kind="stable")
            self.short[size] = hashes[order], [same[k] for k in order.tolist()]
        kept = [(i, c) for i, c in every if len(c) >= exact]
        self.ids = [i for i, _ in kept]
        self.codes = [c for _, c in kept]
        self.size = np.array([len(c) for c in self.codes], np.int64)
        # an item so short that k edits could touch all its q-grams gets a smaller budget
        self.budget = np.minimum((self.size * share).astype(np.int64), np.maximum(0, self.size // q - 1))
        self.need = np.maximum(1, self.size + 1 - q * (self.budget + 1))
        grams = [q_grams(c, q) for c in self.codes]
        found = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        _, which, places = np.unique(found, return_inverse=True, return_counts=True)
        rare = self._without_common(places[which] if len(found) else np.zeros(0, np.int64), [len(g) for g in grams])
        found, item, at = found[rare], item[rare], at[rare]
        order = np.argsort(found, kind="stable")
        self.gram, self.item, self.at = found[order], item[order], at[order]
        self.bits = max(16, min(26, int(len(found) * 16).bit_length()))
        self.bitmap = np.zeros(1 << self.bits, bool)
        self.bitmap[(self.gram >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def _without_common(self, places: np.ndarray, sizes: list[int]) -> np.ndarray:
        """Which q-grams are indexed; every one left out lowers its item's need by one, to a quarter at least."""
        kept, start = np.ones(len(places), bool), 0
        for k, n in enumerate(sizes):
            own = places[start : start + n]
            spare = int(self.need[k]) - max(1, -(-int(self.need[k]) // 4))
            out = np.argsort(-own, kind="stable")[:spare]
            out = out[own[out] > COMMON]
            kept[start + out] = False
            self.need[k] -= len(out)
            start += n
        return kept

    def find(self, codes: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item id, start, end, distance, item length) in one normalised text."""
        out = self._exact(codes)
        best: dict[int, list[tuple[int, int, int]]] = {}
        for k, band in self._bands(codes):
            if (hit := self._verify(codes, k, band * int(self.budget[k] + 1))) is not None:
                best.setdefault(k, []).append(hit)
        for k, hits in sorted(best.items()):
            starts: list[int] = []
            ends: list[int] = []
            for distance, start, end in sorted(set(hits)):
                i = bisect_left(starts, start)  # what is taken does not overlap, so both lists are in order
                if (i == len(starts) or end <= starts[i]) and (not i or ends[i - 1] <= start):
                    starts.insert(i, start)
                    ends.insert(i, end)
                    out.append((self.ids[k], start, end, distance, int(self.size[k])))
        return out

    def _exact(self, codes: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Unedited short items that stand in the text as whole words."""
        out: list[tuple[int, int, int, int, int]] = []
        if not self.short or not len(codes):
            return out
        first = np.flatnonzero(np.append(True, codes[:-1] == 32))
        last = np.zeros(len(codes) + 1, bool)
        last[np.append(np.flatnonzero(codes == 32), len(codes))] = True
        for size, (hashes, items) in self.short.items():
            at = first[first + size <= len(codes)]
            at = at[last[at + size]]
            if len(at):
                found = _hash(codes[at[:, None] + np.arange(size)])
                low, high = np.searchsorted(hashes, found, "left"), np.searchsorted(hashes, found, "right")
                for i in np.flatnonzero(high > low).tolist():
                    for item_id, item in items[low[i] : high[i]]:
                        start = int(at[i])
                        if (codes[start : start + size] == item).all():
                            out.append((item_id, start, start + size, 0, size))
        return out

    def _bands(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, band of diagonals) in which enough q-grams are shared."""
        grams = q_grams(codes, self.q)
        if not len(grams) or not len(self.gram):
            return
        place = np.flatnonzero(self.bitmap[(grams >> np.uint64(64 - self.bits)).astype(np.int64)])
        low = np.searchsorted(self.gram, grams[place], side="left")
        high = np.searchsorted(self.gram, grams[place], side="right")
        keep = high > low
        place, low, high = place[keep], low[keep], high[keep]
        if int((high - low).sum()) <= PAIRS:
            yield from self._counted(place, low, high)
            return
        # items in ranges of few pairs each; within one q-gram the index is in order of items
        meets = np.zeros(len(self.gram) + 1, np.int64)
        np.add.at(meets, low, 1)
        np.add.at(meets, high, -1)
        pairs = np.cumsum(np.bincount(self.item, weights=np.cumsum(meets[:-1]), minlength=len(self.ids)).astype(np.int64))
        a = 0
        while a < len(self.ids):
            b = max(a + 1, int(np.searchsorted(pairs, (pairs[a - 1] if a else 0) + PAIRS, side="right")))
            under, inside = (np.concatenate([[0], np.cumsum(self.item < x)]) for x in (a, b))
            first, end = low + under[high] - under[low], low + inside[high] - inside[low]
            some = end > first
            if some.any():
                yield from self._counted(place[some], first[some], end[some])
            a = b

    def _counted(self, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int]]:
        upto, a = np.cumsum(high - low), 0
        bands, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while a < len(place):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, side="right")))
            many = (high - low)[a:b]
            row = np.repeat(low[a:b], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            item = self.item[row]
            band = (np.repeat(place[a:b], many) - self.at[row]) // (self.budget[item] + 1) + (1 << 39)
            key = np.concatenate([bands, item * (1 << 40) + band, item * (1 << 40) + band - 1])
            bands, which = np.unique(key, return_inverse=True)
            count = np.bincount(which, weights=np.concatenate([count, np.ones(2 * len(row), np.int64)]), minlength=len(bands)).astype(np.int64)
            a = b
        for key in bands[count >= self.need[bands >> 40]].tolist():
            yield key >> 40, (key & ((1 << 40) - 1)) - (1 << 39)

    def _verify(self, codes: np.ndarray, k: int, first: int) -> tuple[int, int, int] | None:
        """(distance, start, end) of the best alignment of item k on diagonals of the band, within its budget.

        ``reach`` is how much of the item each diagonal has behind it after some number of edits.
        """
        item, budget = self.codes[k], int(self.budget[k])
        m, n = len(item), len(codes)
        low, high = max(first - budget, -m), min(first + 2 * (budget + 1) + budget, n)
        diagonal = np.arange(low, high + 1)
        reach = np.where(diagonal >= 0, 0, -1)
        origin = diagonal.copy()
        for edits in range(budget + 1):
            if edits:
                before = np.append(-1, reach[:-1])  # a character more in the text
                behind = np.append(reach[1:], -1)  # one less
                other = np.where(reach >= 0, reach + 1, -1)  # another one
                behind = np.where(behind >= 0, behind + 1, -1)
                best = np.maximum(np.maximum(other, behind), before)
                origin = np.where(best == other, origin, np.where(best == behind, np.append(origin[1:], 0), np.append(0, origin[:-1])))
                reach = np.minimum(best, np.minimum(m, n - diagonal))
                reach = np.where(reach + diagonal < 0, -1, reach)
            self._extend(codes, item, diagonal, reach)
            done = np.flatnonzero(reach >= m)
            if len(done):
                j = int(done[0])
                return edits, int(origin[j]), m + int(diagonal[j])
        return None

    @staticmethod
    def _extend(codes: np.ndarray, item: np.ndarray, diagonal: np.ndarray, reach: np.ndarray) -> None:
        """Moves every diagonal's reach over the equal characters that follow."""
        live, width = np.flatnonzero(reach >= 0), 8
        while len(live):
            further = []
            for part in np.array_split(live, 1 + len(live) * width // PAIRS):
                at = reach[part][:, None] + np.arange(width)
                there = at + diagonal[part][:, None]
                same = (at < len(item)) & (there < len(codes))
                same &= item[np.minimum(at, len(item) - 1)] == codes[np.clip(there, 0, len(codes) - 1)]
                all_same = same.all(axis=1)
                reach[part] += np.where(all_same, width, same.argmin(axis=1))
                further.append(part[all_same])
            live, width = np.concatenate(further), min(4096, 4 * width)


def _finder(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = held.value
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            ids, rows = batch.column("doc_id").to_pylist(), []
            for a, b in slices(offsets):
                for i in range(a, b):
                    if offsets[i + 1] > offsets[i]:
                        rows += [(ids[i], *hit) for hit in index.find(normalised(str(raw[offsets[i] : offsets[i + 1]], "utf-8")))]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "start", "end", "distance", "item_chars"])

    return run


def find_benchmark_passages(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = EDIT_SHARE, least: int = 1, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Where items of ``benchmark(item_id, text)`` occur in ``docs(doc_id, text)``, up to ``share`` edits a character.

    Columns: doc_id, item_id, start, end (in the normalised text), distance, item_chars.  ``least``
    leaves out items of fewer normalised characters, for benchmarks with one-word items.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = benchmark.where(F.length("text") > 0).select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    chars = items.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    blocks, found = max(1, -(-chars * 2 // block_chars)), None
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        index = ItemIndex([(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()], q, share, least)
        one = rows.mapInArrow(_finder(spark.sparkContext.broadcast(index)), _FOUND)
        found = one if found is None else found.unionByName(one)
    return found


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no item occurs; all columns are kept."""
    found = find_benchmark_passages(docs, benchmark, **options).select(F.col("doc_id").alias("contaminated_id")).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["contaminated_id"]), "left_anti")
