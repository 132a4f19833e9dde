"""Best-fit packing of documents into token sequences by a configuration linear program.

Documents are tokenized, cut into pieces only if longer than a sequence, and counted by length.
The driver sees nothing but that histogram (at most ``capacity`` numbers).  A configuration is a
multiset of lengths that fits one sequence; the program asks for the fewest configurations that
cover the histogram.  Multiplicative weights solve it: an unbounded-knapsack dynamic program
prices, for every length, the best configuration with it, and lengths that are covered early
get cheaper, so those that lag behind get heavier.  Prices over the best configuration's worth
are feasible in the dual program and bound any packing from below.

The solution is rounded as it is taken: at the best prices a share of what is left goes, in
whole numbers, to the configurations that are worth nearly as much as the best one, and the
weights go on following what is left.  Pieces whose counts no such configuration can use any
more (a fraction of a percent, see ``Packing.residual``) are placed best fit decreasing, first
into room that is still open.  More rounds and other steps follow while the sequences exceed the
bound by more than ``GAP``.  Spark then deals the numbered pieces of each length to the places
that the configurations hold for it.

Nulls, empties and ties: a null or empty text is one piece holding just the end token; rows with
equal ids are kept as documents of their own; pieces of one length are numbered by id and piece.
Very long texts are tokenized whole, in the memory of one task.  Further columns are not read.
An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.tables import partitions, written

SEQUENCE_TOKENS = 2048
END_TOKEN = 0
#: Share by which the sequences may exceed the dual bound when the program ends before its last trial.
GAP = 0.0005
#: Trials, in turn: further rounds of the prices, the share taken of what is left, the step of the weights,
#: and how far below the best worth a configuration may be.
TRIALS = ((20, 0.05, 0.1, 0.01), (100, 0.2, 0.1, 0.002), (300, 0.05, 0.05, 0.002))
#: The same splitting rule as the vocabulary's own, with possessive repeats, which are faster.
_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _fast_tokenizer(path: str):
    """The same byte-level merges in the library that returns ids as an array; special strings apart."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    special = {t["content"]: t["id"] for t in held.get("added_tokens", [])}
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = [b for b in range(256) if b not in set(letters)]
    byte_of = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(spare)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}), tuple(special)


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of a whole text as the vocabulary's tokenizer gives them without special tokens added."""
    fast, special = _fast_tokenizer(path)
    if any(s in text for s in special):
        return np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    try:
        return np.frombuffer(fast._core_bpe.encode_to_tiktoken_buffer(text, set()), dtype=np.uint32) if text else np.zeros(0, np.uint32)
    except ValueError:  # its splitting rule gives up on about a million blanks in a row
        return np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def _cutter(path: str, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_of, out = batch.column(0).to_pylist(), ([], [], [], [], [])
            for doc_id, text in zip(ids_of, batch.column(1), strict=True):
                ids = np.append(token_ids(text.as_py() or "", path), np.uint32(END_TOKEN)).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    for column, value in zip(out, (doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (of little-endian 32-bit ids)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cutter(path or vocabulary_path(), capacity), _PIECES)


# -- the program over the histogram ---------------------------------------------------------


def _knapsack(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best worth for every room up to the capacity, and the item (or -1) taken first at each."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        n = upto[room]
        if n:
            value = best[room - lengths[:n]] + worth[:n]
            k = int(value.argmax())
            if value[k] > best[room - 1]:
                best[room], taken[room] = value[k], k
                continue
        best[room] = best[room - 1]
        taken[room] = -2 if room else -1
    return best, taken


def _filling(room: int, lengths: list[int], taken: list[int]) -> list[int]:
    items = []
    while room > 0:
        k = taken[room]
        if k == -2:
            room -= 1
        elif k < 0:
            break
        else:
            items.append(k)
            room -= lengths[k]
    return items


@dataclass
class Packing:
    """Configurations that hold exactly a histogram: (how often, {length: copies}), and how they came about."""

    chosen: list[tuple[int, dict[int, int]]]
    bound: float  # no packing needs fewer sequences
    residual: float  # share of the pieces that no configuration of the program holds

    @property
    def sequences(self) -> int:
        return sum(times for times, _ in self.chosen)


class _Prices:
    """The dual half of the program: prices of the lengths by multiplicative weights."""

    def __init__(self, demand: dict[int, int], capacity: int):
        self.capacity = capacity
        self.lengths = np.array(sorted(demand), np.int64)
        self.need = np.array([demand[k] for k in self.lengths.tolist()], float)
        self.now = self.best = self.lengths / capacity
        self.bound, self.step = 0.0, 0.3

    def improve(self, rounds: int) -> None:
        for _ in range(rounds):
            worth, taken = _knapsack(self.lengths, self.now, self.capacity)
            bound = float((self.need * self.now).sum() / worth[self.capacity])
            if bound > self.bound:
                self.bound, self.best = bound, self.now / worth[self.capacity]
            gained = np.zeros(len(self.lengths))
            for items in _configurations(self.lengths, self.now, worth, taken, self.capacity, 0.02):
                share = min(self.need[i] / c for i, c in items.items())
                for i, c in items.items():
                    gained[i] += c * share / self.need[i]
            self.now = self.now * np.exp(-self.step * gained / gained.max())
            self.now /= self.now.max()
            self.step *= 0.985


def _configurations(lengths: np.ndarray, price: np.ndarray, worth: np.ndarray, taken: np.ndarray, capacity: int, slack: float) -> Iterator[dict[int, int]]:
    """For every length, long ones first, the best configuration with it, if worth ``1 - slack`` of the best of all."""
    size, steps = lengths.tolist(), taken.tolist()
    for k in np.flatnonzero(price + worth[capacity - lengths] >= (1 - slack) * worth[capacity])[::-1].tolist():
        items = {k: 1}
        for i in _filling(capacity - size[k], size, steps):
            items[i] = items.get(i, 0) + 1
        yield items


def _rounded(demand: dict[int, int], capacity: int, prices: np.ndarray, share: float, step: float, slack: float) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int]]:
    """Configurations in whole numbers that never exceed the demand, and the pieces that none of them holds."""
    price = dict(zip(sorted(demand), prices.tolist(), strict=True))
    left, rest = dict(demand), {}
    chosen: dict[tuple[tuple[int, int], ...], int] = {}
    while left:
        lengths = np.array(sorted(left), np.int64)
        size, now = lengths.tolist(), np.array([price[k] for k in sorted(left)])
        worth, taken = _knapsack(lengths, now, capacity)
        before = [left[k] for k in size]
        after, lacking = list(before), set()
        for items in _configurations(lengths, now, worth, taken, capacity, slack):
            times = min(after[i] // c for i, c in items.items())
            if times < 1:
                lacking.update(i for i, c in items.items() if c > before[i])
                continue
            times = max(1, int(times * share))
            key = tuple(sorted((size[i], c) for i, c in items.items()))
            chosen[key] = chosen.get(key, 0) + times
            for i, c in items.items():
                after[i] -= times * c
        if after == before:  # too few are left of these for any configuration worth taking
            for i in lacking:
                rest[size[i]] = left.pop(size[i])
            continue
        gained = 1 - np.array(after) / np.array(before)
        for k, factor in zip(size, np.exp(-step * gained / gained.max()).tolist(), strict=True):
            price[k] *= factor
        left = {k: n for k, n in zip(size, after, strict=True) if n}
    return [(times, dict(key)) for key, times in chosen.items()], rest


def solve(histogram: dict[int, int], capacity: int, gap: float = GAP) -> Packing:
    """The fewest sequences of all ``TRIALS``, or of the first ones that come within ``gap`` of the dual bound.

    Where none comes that near, best fit over the whole histogram is tried too and taken if it needs fewer.
    """
    demand = {int(k): int(n) for k, n in sorted(histogram.items()) if n > 0}
    if not demand:
        return Packing([], 0.0, 0.0)
    prices, best = _Prices(demand, capacity), None
    for rounds, share, step, slack in TRIALS:
        prices.improve(rounds)
        chosen, rest = _rounded(demand, capacity, prices.best, share, step, slack)
        found = Packing(_best_fit(rest, capacity, chosen), prices.bound, sum(rest.values()) / sum(demand.values()))
        if best is None or found.sequences < best.sequences:
            best = found
        if best.sequences <= math.ceil(prices.bound - 1e-6) * (1 + gap):
            break
    else:
        plain = Packing(_best_fit(demand, capacity), prices.bound, 1.0)
        if plain.sequences < best.sequences:
            best = plain
    return Packing(best.chosen, prices.bound, best.residual)


def configurations(histogram: dict[int, int], capacity: int, gap: float = GAP) -> list[tuple[int, dict[int, int]]]:
    """(how often, {length: copies}) that together hold exactly the histogram."""
    return solve(histogram, capacity, gap).chosen


def _best_fit(left: dict[int, int], capacity: int, opened: list[tuple[int, dict[int, int]]] = ()) -> list[tuple[int, dict[int, int]]]:
    """Best fit decreasing over the histogram, into ``opened`` bins too: equal pieces and equal bins move together."""
    bins: dict[int, list[list]] = {}  # room left: [how many, content]
    rooms = np.zeros(capacity + 1, np.int64)
    for many, content in opened:
        room = capacity - sum(k * c for k, c in content.items())
        bins.setdefault(room, []).append([many, content])
        rooms[room] += many
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                room = length + int(fits[0])
                many, content = bins[room].pop()
            else:
                room, many, content = capacity, n, {}
                per = capacity // length
                many = -(-n // per)
            if room == capacity:
                # open as few as hold them all, filled as far as they go
                per = capacity // length
                full, rest = divmod(n, per)
                for times, copies in ((full, per), (1 if rest else 0, rest)):
                    if times:
                        bins.setdefault(capacity - copies * length, []).append([times, {length: copies}])
                        rooms[capacity - copies * length] += times
                n = 0
                continue
            used = min(n, many)
            rooms[room] -= many
            if used < many:
                bins[room].append([many - used, content])
                rooms[room] += many - used
            bins.setdefault(room - length, []).append([used, content | {length: content.get(length, 0) + 1}])
            rooms[room - length] += used
            n -= used
    return [(many, content) for held in bins.values() for many, content in held if many]


# -- places -----------------------------------------------------------------------------------


def _places(chosen: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For each length, in order, ranks and where they go: rank r at first + i is in sequence base + i // copies."""
    rows, base, seen = [], 0, {}
    for times, items in chosen:
        offset = 0
        for length in sorted(items, reverse=True):
            copies = items[length]
            rows.append((length, seen.get(length, 0), base, copies, offset))
            seen[length] = seen.get(length, 0) + times * copies
            offset += copies * length
        base += times
    rows.sort()
    names = ("length", "first", "base", "copies", "offset")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def _placer(held):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = held.value
        stride = np.int64(1 << 44)
        keys = at["length"] * stride + at["first"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
            e = np.searchsorted(keys, length * stride + rank, side="right") - 1
            i = rank - at["first"][e]
            columns = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(at["base"][e] + i // at["copies"][e]), pa.array(at["offset"][e] + i % at["copies"][e] * length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def pack_pieces(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to the rows of :func:`token_pieces`."""
    spark = pieces.sparkSession
    pieces = written(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # at most `capacity` lengths, and a number of configurations that does not depend on the input
    held = spark.sparkContext.broadcast(_places(configurations(histogram, capacity)))
    rows = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(partitions(spark))).cast("int"))
    counts = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("place", F.row_number().over(inside)).join(starts, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("place") - 1).cast("long").alias("rank"))
    return ranked.mapInArrow(_placer(held), _PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` with their places in as few sequences as can be found."""
    return pack_pieces(token_pieces(docs, path, capacity), capacity)
