"""URL filters: ordered rules, and a Bloom filter cascade for exact membership of listed keys.

Level 0 of the cascade encodes the listed keys; level 1 the unlisted keys of the corpus that
level 0 wrongly accepts; level 2 the listed keys that level 1 wrongly accepts; and so on until
a level accepts nothing wrongly.  Over the key universe it was built on, the first level that
rejects a key decides it, so lookups are exact and need no join.

Keys are dealt by hash into segments, each with a cascade of its own of at most
``SEGMENT_BYTES``.  Spark aggregates the bitmaps and keeps them in a table; the driver and the
executors hold the filters of one round (``BROADCAST_BYTES``) at a time, and every key is probed
in the one round that has its segment.

Nulls, empties and ties: a null URL, or one without ``://``, has an empty host and path and is
never listed unless the empty key itself is.  Repeated URLs give repeated rows, and further
columns of ``pages`` are not read.  Very long URLs count whole.  An empty list gives a cascade
without levels (nothing is listed); an empty universe gives the same, an empty table no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.kernels import mix
from tallyhouse.llm.tables import materialised

#: The rules of the URL query as (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Host labels whose hosts are on the block list that is taken where no table of listed hosts is given.
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")

#: Filters that are broadcast together, and of one segment at most.
BROADCAST_BYTES = 64 << 20
SEGMENT_BYTES = 8 << 20
_BITMAP_BITS = 32768  # of one value of bitmap_construct_agg


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null when none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, on, under in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(under)
        rule, verdict = F.when(fits, F.lit(on + under)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int


def _positions(first: np.ndarray, second: np.ndarray, level: int, hashes: int, bits: np.ndarray | int) -> np.ndarray:
    """Bit positions, keys x hashes, in a level's filter."""
    salt = np.uint64(level * 2 + 1) * np.uint64(0x9E3779B97F4A7C15)
    a, b = mix(first ^ salt), mix(second ^ salt) | np.uint64(1)
    bits = np.asarray(bits, np.uint64).reshape(-1, 1)
    return (mix(a[:, None] + np.arange(hashes, dtype=np.uint64)[None, :] * b[:, None]) % bits).astype(np.int64)


def _hashed(key: Column, segments: int) -> list[Column]:
    return [
        F.pmod(F.xxhash64(key, F.lit("segment")), F.lit(segments)).cast("int").alias("segment"),
        F.xxhash64(key, F.lit("first")).alias("first"),
        F.xxhash64(key, F.lit("second")).alias("second"),
    ]


class Cascade:
    """Filters by segment of the key space, kept in a table (segment, level, bucket, bitmap)."""

    def __init__(self, levels: dict[int, list[Level]], segments: int, bitmaps: list[DataFrame]):
        self.levels, self.segments, self.bitmaps = levels, segments, bitmaps

    @property
    def size_bytes(self) -> int:
        return sum(level.bits // 8 + 1 for levels in self.levels.values() for level in levels)

    def _rounds(self, limit: int) -> Iterator[list[int]]:
        one, held = [], 0
        for k, levels in sorted(self.levels.items()):
            size = sum(level.bits // 8 + 1 for level in levels)
            if one and held + size > limit:
                yield one
                one, held = [], 0
            one.append(k)
            held += size
        if one:
            yield one

    def _filters(self, part: list[int]) -> dict[int, list[tuple[int, int, np.ndarray]]]:
        held = {k: [(v.bits, v.hashes, np.zeros((v.bits // _BITMAP_BITS + 1) * _BITMAP_BITS // 8, np.uint8)) for v in self.levels[k]] for k in part}
        for table in self.bitmaps:
            for r in table.where(F.col("segment").isin(part)).toLocalIterator():
                at = (r["bucket"] - 1) * _BITMAP_BITS // 8
                held[r["segment"]][r["level"]][2][at : at + len(r["bitmap"])] = np.frombuffer(r["bitmap"], np.uint8)
        return held

    def mark(self, rows: DataFrame, key: str, into: str, limit: int = BROADCAST_BYTES) -> DataFrame:
        """``rows`` with a boolean column that says whether the key is listed."""
        context = rows.sparkSession.sparkContext
        parts = list(self._rounds(limit))
        if not parts:
            return rows.withColumn(into, F.lit(False))
        hashed = rows.select("*", F.struct(*_hashed(F.col(key), self.segments)).alias(into))
        out = hashed.where(~F.col(into)["segment"].isin(sorted(self.levels))).withColumn(into, F.lit(False)) if len(self.levels) < self.segments else None
        for part in parts:
            held = context.broadcast(self._filters(part))
            mine = hashed if len(part) == self.segments else hashed.where(F.col(into)["segment"].isin(part))
            test = _prober(held)
            probed = mine.withColumn(into, test(F.col(into)["segment"], F.col(into)["first"], F.col(into)["second"]))
            if len(parts) > 1:
                probed = materialised(probed)
                held.destroy()
            out = probed if out is None else out.unionByName(probed)
        return out


def _prober(held):
    @F.arrow_udf(T.BooleanType())
    def probe(segment: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        which = segment.to_numpy(zero_copy_only=False)
        a, b = (x.to_numpy(zero_copy_only=False).view(np.uint64) for x in (first, second))
        out = np.zeros(len(which), bool)
        for k in np.unique(which).tolist():
            levels = held.value[k]
            rows = np.flatnonzero(which == k)
            for i, (bits, hashes, bitmap) in enumerate(levels):
                if not len(rows):
                    break
                at = _positions(a[rows], b[rows], i, hashes, bits)
                inside = ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
                out[rows[~inside]] = i % 2 == 1
                rows = rows[inside]
            out[rows] = len(levels) % 2 == 1
        return pa.array(out)

    return probe


def _setter(level: int, sizes: dict[int, Level]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segment, first, second = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            hashes = next(iter(sizes.values())).hashes
            bits = np.array([sizes[k].bits for k in segment.tolist()], np.uint64)
            at = _positions(first.view(np.uint64), second.view(np.uint64), level, hashes, bits) + 1 if len(segment) else np.zeros((0, hashes), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(segment, hashes), pa.int32()), pa.array(at.ravel())], ["segment", "at"])

    return run


def build_cascade(keys: DataFrame, segment_bytes: int = SEGMENT_BYTES, max_levels: int = 64, limit: int = BROADCAST_BYTES) -> Cascade:
    """A cascade over ``keys(key string, listed boolean)``, the complete universe.

    A key that is listed once is listed, however often it occurs.
    """
    keys = materialised(keys.groupBy(F.coalesce("key", F.lit("")).alias("key")).agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed")))
    sizes = {r["listed"]: r["n"] for r in keys.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    r, s = sizes.get(True, 0), sizes.get(False, 0)
    if not r:
        return Cascade({}, 1, [])
    rate = min(0.5, math.sqrt(0.5) * r / s) if s else 0.5
    segments = max(1, math.ceil(1.5 * r * math.log2(1 / rate) * 1.44 / (8 * segment_bytes)))
    levels: dict[int, list[Level]] = {}
    cascade = Cascade(levels, segments, [])
    hashed = keys.select("key", "listed", *_hashed(F.col("key"), segments))
    side, others = hashed.where("listed"), hashed.where("not listed")
    for level in range(max_levels):
        counts = {x["segment"]: x["n"] for x in side.groupBy("segment").agg(F.count("*").alias("n")).collect()}
        if not counts:
            return cascade
        hashes = max(1, round(math.log2(1 / (rate if level == 0 else 0.5))))
        new = {k: Level(max(64, math.ceil(n * hashes / math.log(2))), hashes) for k, n in counts.items()}
        at = side.select("segment", "first", "second").mapInArrow(_setter(level, new), "segment int, at long")
        bitmaps = at.groupBy("segment", F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
        cascade.bitmaps.append(materialised(bitmaps.withColumn("level", F.lit(level))))
        for k, one in new.items():
            levels.setdefault(k, []).append(one)
        # those of the other side that all levels so far accept are encoded next
        wrong = cascade.mark(others.where(F.col("segment").isin(sorted(new))), "key", "accepted", limit).where(F.col("accepted") if level % 2 == 0 else ~F.col("accepted"))
        side, others = materialised(wrong.drop("accepted")), side
    raise ValueError("the cascade does not converge")


def listed_hosts(hosts: DataFrame, labels=LISTED_LABELS) -> DataFrame:
    """``hosts(key)`` that have one of the labels."""
    return hosts.where(F.arrays_overlap(F.split("key", r"\."), F.array(*[F.lit(x) for x in labels])))


def judge_urls(pages: DataFrame, listed: DataFrame | None = None, rules=RULES, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A verdict for every row of ``pages(page_id, url)``.

    The longest fitting rule decides; without one, a page is blocked if its host is a key of
    ``listed(key)``, a table of any size (default: :func:`listed_hosts` of the corpus), which the
    cascade answers.  Columns: page_id, url, host, path, rule, verdict, listed.
    """
    rows = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    hosts = rows.select(F.col("host").alias("key")).distinct()
    if listed is None:
        listed = listed_hosts(hosts)
    on = listed.select(F.coalesce(F.col("key"), F.lit("")).alias("key"), F.lit(True).alias("listed"), F.lit(False).alias("seen"))
    # only keys of the corpus are asked for, so listed ones that it lacks need no place in the filters
    universe = hosts.select("key", F.lit(False).alias("listed"), F.lit(True).alias("seen")).unionByName(on)
    known = universe.groupBy("key").agg(F.max("listed").alias("listed"), F.max("seen").alias("seen")).where("seen").select("key", "listed")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = build_cascade(known, limit=limit).mark(rows.withColumns({"rule": rule, "says": verdict}), "host", "listed", limit)
    return rows.select("page_id", "url", "host", "path", "rule", F.coalesce("says", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
