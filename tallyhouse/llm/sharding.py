"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts) are never split.  Sorted by size, each enters the bin with the tightest
remaining capacity that holds it, found in a balanced tree.  Groups of one size are the same to
the packing, and so are bins with the same room: the tightest bin stays the tightest until a
size no longer fits, so it takes as many of them as it holds at once.  The packing therefore
needs no more than the histogram of group sizes, and all groups are packed, one by one in
effect.  Spark counts the histogram, numbers the groups of each size in many parts at once, and
looks up the bin of each number.

Nulls, empties and ties: a null text has size 1 and CRC 0, and all null texts are one group of
their own (empty texts are another).  Groups of one size are numbered by the hash of their text.
Rows with equal or null ids are kept, each with its own slot.  Very long texts count whole.  An
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.tables import materialised, partitions, unsigned_crc32

#: Groups of more than this share of all bytes (so at most as many) are looked up by a broadcast, away from the join of the others.
LARGE = 1 / 8192
#: Entries of the table of places that are broadcast at once (32 bytes each).
ENTRIES = 4_000_000


class RoomTree:
    """A treap of the remaining capacities that open bins have."""

    def __init__(self, seed: int = 7):
        self._random, self._root = random.Random(seed), None

    def _split(self, node, room):
        if node is None:
            return None, None
        if node[0] < room:
            node[2], right = self._split(node[2], room)
            return node, right
        left, node[1] = self._split(node[1], room)
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[3] > b[3]:
            a[2] = self._merge(a[2], b)
            return a
        b[1] = self._merge(a, b[1])
        return b

    def add(self, room: int) -> None:
        left, right = self._split(self._root, room)
        self._root = self._merge(self._merge(left, [room, None, None, self._random.random()]), right)

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity of at least ``size``."""
        node, best = self._root, None
        while node is not None:
            if node[0] >= size:
                best, node = node[0], node[1]
            else:
                node = node[2]
        return best

    def remove(self, room: int) -> None:
        left, rest = self._split(self._root, room)
        _, right = self._split(rest, room + 1)
        self._root = self._merge(left, right)


def best_fit_decreasing(histogram: dict[int, int], capacity: int, at_most: int | None = None) -> tuple[int, list[tuple[int, int, int, int]]] | None:
    """Bins needed, and (size, first, bin, copies): of that size, number ``first + i`` is in bin ``bin + i // copies``.

    Each entry holds up to the next one of its size.  None if a size exceeds the capacity, or more
    than ``at_most`` bins are needed.
    """
    tree, places, bins = RoomTree(), [], 0
    held: dict[int, list[tuple[int, int]]] = {}  # room: ranges of bins (first, how many) that have it

    def put(room: int, first: int, many: int) -> None:
        if many:
            if room not in held:
                held[room] = []
                tree.add(room)
            held[room].append((first, many))

    for size in sorted(histogram, reverse=True):
        n, done = histogram[size], 0
        if size > capacity:
            return None
        while done < n:
            room = tree.tightest(size)
            if room is None:
                room, first = capacity, bins
                many = -(-(n - done) // (capacity // size))
                bins += many
                if at_most is not None and bins > at_most:
                    many -= bins - at_most
                    bins = at_most
                    if many <= 0:
                        return None
            else:
                first, many = held[room].pop()
                if not held[room]:
                    del held[room]
                    tree.remove(room)
            copies = min(room // size, n - done)
            full = min(many, (n - done) // copies)
            places.append((size, done, first, copies))
            put(room - copies * size, first, full)
            done += full * copies
            if full < many and done < n:
                places.append((size, done, first + full, n - done))
                put(room - (n - done) * size, first + full, 1)
                full, done = full + 1, n
            put(room, first + full, many - full)
    return bins, places


def pack_into(histogram: dict[int, int], shards: int) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Best fit into at most ``shards`` bins of a capacity that exceeds the average by as little as will do, in steps."""
    total = sum(k * n for k, n in histogram.items())
    least, slack = max([-(-total // shards), *histogram]) if histogram else 1, 0
    while (found := best_fit_decreasing(histogram, least + slack, shards)) is None:
        slack = max(1, least // 100_000, 2 * slack)
    return found


def _placer(held):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, bin_, copies = held.value
        starts = np.append(np.flatnonzero(np.append(True, size[1:] != size[:-1])), len(size))
        for batch in batches:
            bytes_, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("bytes", "rank"))
            which = np.searchsorted(size[starts[:-1]], bytes_)
            low, high = starts[which], starts[which + 1]  # the last entry of the size that begins at or before the rank
            while (open_ := high - low > 1).any():
                middle = (low + high) // 2
                after = first[np.minimum(middle, len(first) - 1)] <= rank
                low, high = np.where(open_ & after, middle, low), np.where(open_ & ~after, middle, high)
            shard = bin_[low] + (rank - first[low]) // copies[low]
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("bytes"), pa.array(shard, pa.int64())], ["grp", "bytes", "shard"])

    return place


def _placed(groups: DataFrame, places: list[tuple[int, int, int, int]]) -> DataFrame:
    """(grp, bytes, shard) of all groups."""
    spark = groups.sparkSession
    if not places:
        return groups.select("grp", "bytes", F.lit(0).cast("long").alias("shard"))
    ranked = _numbered(groups, ["bytes"], ["grp"]).withColumnRenamed("number", "rank")
    table, out = np.array(sorted(places), np.int64).reshape(-1, 4), None
    a = 0
    while a < len(table):
        # whole sizes together
        b = len(table) if len(table) - a <= ENTRIES else int(np.searchsorted(table[:, 0], table[a + ENTRIES, 0]))
        b = b if b > a else int(np.searchsorted(table[:, 0], table[a, 0], side="right"))
        part = ranked if b - a == len(table) else ranked.where(F.col("bytes").between(int(table[a, 0]), int(table[b - 1, 0])))
        held = spark.sparkContext.broadcast(tuple(np.ascontiguousarray(table[a:b, k]) for k in range(4)))
        one = part.select("grp", "bytes", "rank").mapInArrow(_placer(held), "grp binary, bytes long, shard long")
        out = one if out is None else out.unionByName(one)
        a = b
    return out


def shard_documents(docs: DataFrame, shards: int | None = 8, capacity: int | None = None) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard).

    Give ``shards`` to get as many shards of near equal bytes, or ``capacity`` (bytes) to get as
    few shards of that size as best fit finds; a group larger than the capacity is an error.
    """
    rows = materialised(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            unsigned_crc32(F.col("text")).alias("text_crc32"),
            F.unhex(F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit(""))).alias("grp"),
        )
    )
    groups = materialised(rows.groupBy("grp").agg(F.sum("size").alias("bytes")))
    # distinct sizes only: d of them make d * (d + 1) / 2 bytes at least
    counted = groups.groupBy("bytes").agg(F.count("*").alias("n")).toArrow()
    histogram = dict(zip(counted.column("bytes").to_pylist(), counted.column("n").to_pylist(), strict=True))
    found = pack_into(histogram, shards) if capacity is None else best_fit_decreasing(histogram, capacity)
    if found is None:
        raise ValueError("a group is larger than the capacity")
    placed = materialised(_placed(groups, found[1]))
    total = sum(k * n for k, n in histogram.items())
    large = F.broadcast(placed.where(F.col("bytes") > int(total * LARGE)).select("grp", "shard"))
    small = placed.where(F.col("bytes") <= int(total * LARGE)).select("grp", "shard")
    both = rows.join(large, "grp").unionByName(rows.join(large, "grp", "left_anti").join(small, "grp"))
    return numbered(both.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard")))


def _numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds number: 0, 1, ... among the rows with equal keys, numbered in many parts at once."""
    parts = partitions(rows.sparkSession)
    rows = rows.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = rows.groupBy(*keys, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*keys, "part").orderBy(*order)
    placed = rows.withColumn("place", F.row_number().over(inside)).join(starts, [*keys, "part"])
    return placed.withColumn("number", (F.col("base") + F.col("place") - 1).cast("long")).drop("part", "place", "base")


def numbered(rows: DataFrame) -> DataFrame:
    """Adds slot: 0, 1, ... within each shard."""
    return _numbered(rows, ["shard"], ["doc_id", "text_crc32"]).select("doc_id", "size", "text_crc32", "shard", F.col("number").alias("slot"))
