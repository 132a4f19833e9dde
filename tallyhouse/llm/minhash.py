"""Near-duplicates by MinHash: many universal hash minima, banding, signature verification, star components.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of word shingles.

1. Each set has ``MINIMA`` minima of universal hash functions ``(a * x + b) mod 2**64 >> 32``.  Rows of a band are as many as
   leave a linked pair without a common band with a chance of at most ``MISSED`` (for 85 %: 32 bands of 4 rows, 6e-11).
2. Equal sets are one document from here on.
3. All documents of a bucket (a band with the same minima) are compared with its head, the one that shares buckets
   with most others, so a family of n copies makes n pairs.  Signatures that agree less than ``SIGMAS`` deviations under the threshold
   are out (a chance of 1e-10 at the threshold); the others are confirmed on their full sets.
4. Where a head's documents are in several components by then, those outside the largest one are compared with all others of other
   components in the same way, in groups of bounded size that report no more links than join their components.
5. Components follow by alternating large-star and small-star.

Shingles are compared by keyed 64-bit hashes (two sets of 10,000 shingles have one false common shingle with a chance of 5e-12), equal sets by 128
bits.

Nulls, empties and ties: a null or empty text, or one without words, has an empty set and is linked with nothing; a text of fewer words than a
shingle is one shingle; a row with a null id is linked with nothing, has a null component and is not kept; ids are taken as unique (rows
that share an id count as linked through it).  Very long texts are shingled whole, in the memory of one task.  Further columns, of
whatever name, are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.kernels import blobs, mix, slices, text_buffers
from tallyhouse.llm.stars import star_components
from tallyhouse.llm.tables import materialised, written
from tallyhouse.llm.words import lowered, shingle_sets

MINIMA = 128
#: The chance that a pair at the threshold has no common band, at most.
MISSED = 1e-9
#: Standard deviations that the signatures' agreement may lie under the threshold.
SIGMAS = 6.5
#: Shingles of the documents that a group compares, and of those that they are compared with, on average at most.
SHINGLES = 2_000_000

_FACTORS = np.random.Generator(np.random.PCG64(8675309)).integers(1, 2**64 - 1, (2, 4096), dtype=np.uint64)


def banding(percent: int, minima: int = MINIMA) -> tuple[int, int]:
    """(bands, rows): the most rows for which a linked pair misses all bands with a chance of ``MISSED`` at most, or one row."""
    p = percent / 100
    rows = max((r for r in range(1, minima + 1) if (1 - p**r) ** (minima // r) <= MISSED), default=1)
    return minima // rows, rows


def least_agreement(percent: int, minima: int = MINIMA) -> int:
    p = percent / 100
    return max(1, math.floor(minima * p - SIGMAS * math.sqrt(minima * p * (1 - p))))


# -- signatures -------------------------------------------------------------------------------


_SIGNED = "doc_id long, n int, set_a long, set_b long, signature binary"


def _sets(batch: pa.RecordBatch, words: int, lower: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, offsets = text_buffers(batch.column("text"))
    for a, b in slices(offsets):
        part = raw[offsets[a] : offsets[b]]
        yield a, b, *shingle_sets(lowered(part) if lower else part, offsets[a : b + 1] - offsets[a], words)


def signatures_of(starts: np.ndarray, shingles: np.ndarray, minima: int = MINIMA) -> np.ndarray:
    """A row of minima for each set that is not empty."""
    begins = starts[:-1][np.diff(starts) > 0]
    out = np.empty((len(begins), minima), np.uint32)
    if len(begins):
        for k in range(minima):
            out[:, k] = np.minimum.reduceat((shingles * (_FACTORS[0, k] | np.uint64(1)) + _FACTORS[1, k]) >> np.uint64(32), begins)
    return out


def _signer(words: int, lower: bool, minima: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, starts, shingles in _sets(batch, words, lower):
                n = np.diff(starts)
                full, sums = np.flatnonzero(n), np.zeros((2, b - a), np.uint64)
                if len(full):
                    for k, salt in enumerate((0x51ED270B0A1F39C1, 0x2545F4914F6CDD1D)):
                        sums[k, full] = np.add.reduceat(mix(shingles ^ np.uint64(salt)), starts[:-1][full])
                lengths = np.where(n > 0, minima, 0)
                columns = [batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int32()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, blobs(signatures_of(starts, shingles, minima).ravel(), np.concatenate([[0], np.cumsum(lengths)]))], ["doc_id", "n", "set_a", "set_b", "signature"])

    return run


def signatures(docs: DataFrame, words: int = 5, lower: bool = True, minima: int = MINIMA) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, n (size of its set), a 128-bit hash of the set, and its minima (4 bytes each; empty without words)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_signer(words, lower, minima), _SIGNED)


def _buckets(signed: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, doc_id): a row for each band of a signature."""
    key = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.xxhash64(j, F.substring(F.col("signature"), j * (4 * rows) + 1, F.lit(4 * rows))))
    return signed.select("doc_id", F.explode(key).alias("key"))


def _neighbours(signed: DataFrame, bands: int, rows: int) -> DataFrame:
    """(head, doc_id): every document with the heads of its buckets."""
    keyed = _buckets(signed, bands, rows)
    counts = keyed.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    shared = written(keyed.join(counts, "key"))
    weights = shared.groupBy("doc_id").agg(F.sum("many").alias("weight"))
    heads = shared.join(weights, "doc_id").groupBy("key").agg(F.max_by("doc_id", F.struct("weight", -F.col("doc_id"))).alias("head"))
    return written(shared.join(heads, "key").where("doc_id <> head").select("head", "doc_id").distinct())


# -- verification -----------------------------------------------------------------------------


_SETS = "doc_id long, n int, signature binary, shingles binary"


def _set_maker(words: int, lower: bool, minima: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, starts, shingles in _sets(batch, words, lower):
                n = np.diff(starts)
                edges = np.concatenate([[0], np.cumsum(np.where(n > 0, minima, 0))])
                columns = [batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int32()), blobs(signatures_of(starts, shingles, minima).ravel(), edges), blobs(shingles, starts)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "signature", "shingles"])

    return run


class _Joined:
    """Union of components, for the links found in one group."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def joins(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _opener(percent: int, minima: int, cells: int = 32_000_000):
    """Compares the asking documents of a group with its members in other components: signatures first, then the full sets.

    The links that it gives join the components; of links between joined ones there is one.
    """
    least = least_agreement(percent, minima)

    def open_group(table: pa.Table) -> pa.Table:
        ids, n, comp, asks = (table.column(c).to_numpy() for c in ("doc_id", "n", "comp", "asks"))
        n = n.astype(np.int64)
        grid = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(len(ids), minima)
        sets = table.column("shingles")
        members, asking = np.flatnonzero(asks == 0), np.flatnonzero(asks == 1)
        joined, links = _Joined(), []
        a = 0
        while a < len(members):
            # members a few at a time, so that the table of shingles and members stays small
            size = np.cumsum(n[members[a:]])
            b = a + max(1, int(np.searchsorted(size * np.arange(1, len(size) + 1), cells, side="right")))
            part, a = members[a:b], b
            tokens, at = np.unique(np.concatenate([np.frombuffer(sets[int(i)].as_py(), np.uint64) for i in part]), return_inverse=True)
            has = np.zeros((len(tokens), len(part)), np.uint8)
            has[at, np.repeat(np.arange(len(part)), n[part])] = 1
            for i in asking:
                fits = np.flatnonzero((comp[part] != comp[i]) & (np.minimum(n[part], n[i]) * 100 >= np.maximum(n[part], n[i]) * percent))
                fits = fits[(grid[part[fits]] == grid[i]).sum(axis=1) >= least]
                if not len(fits):
                    continue
                mine = np.frombuffer(sets[int(i)].as_py(), np.uint64)
                where = np.searchsorted(tokens, mine)
                where[where == len(tokens)] = 0
                both = has[np.ix_(where[tokens[where] == mine], fits)].sum(axis=0, dtype=np.int64)
                for k in fits[both * (100 + percent) >= percent * (n[part[fits]] + n[i])]:
                    if joined.joins(int(comp[i]), int(comp[part[k]])):
                        links.append((int(ids[i]), int(ids[part[k]])))
        pairs = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return open_group


def _opened(routed: DataFrame, sets: DataFrame, percent: int, minima: int) -> DataFrame:
    """Links found in the groups (head, block, turn) that ``routed`` sends documents to."""
    rows = routed.join(sets, "doc_id").select("head", "block", "turn", "doc_id", "comp", "asks", "n", "signature", "shingles")
    return materialised(rows.groupBy("head", "block", "turn").applyInArrow(_opener(percent, minima), "a long, b long"))


def _with_heads(near: DataFrame, sets: DataFrame, percent: int, minima: int) -> DataFrame:
    """Links of documents with their heads; a head meets its documents in groups of ``SHINGLES`` shingles."""
    sized = near.join(sets.select("doc_id", "n"), "doc_id")
    groups = sized.groupBy("head").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    none = F.lit(0).alias("turn")
    asking = near.join(groups, "head").select("head", block.alias("block"), none, "doc_id", F.col("doc_id").alias("comp"), F.lit(1).alias("asks"))
    heads = groups.select("head", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), none, F.col("head").alias("doc_id"), F.col("head").alias("comp"), F.lit(0).alias("asks"))
    return _opened(asking.unionByName(heads), sets, percent, minima)


def _with_each_other(near: DataFrame, sets: DataFrame, links: DataFrame, percent: int, minima: int) -> DataFrame | None:
    """Links of a head's documents that are in different components: those outside the largest one with all others, in blocks."""
    comps = star_components(links).withColumnRenamed("node", "doc_id")
    labelled = materialised(near.join(comps, "doc_id", "left").join(sets.select("doc_id", "n"), "doc_id").select("head", "doc_id", F.coalesce("component", "doc_id").alias("comp"), "n"))
    each = labelled.groupBy("head", "comp").agg(F.count("*").alias("many"), F.sum("n").alias("size"))
    largest = F.max_by(F.struct("comp", "size"), F.struct("many", -F.col("comp")))
    mixed = each.groupBy("head").agg(largest.alias("main"), F.sum("size").alias("size"), F.count("*").alias("comps")).where("comps > 1")
    mixed = materialised(
        mixed.select("head", F.col("main.comp").alias("main"), F.ceil(F.col("size") / SHINGLES).cast("int").alias("blocks"), F.ceil((F.col("size") - F.col("main.size")) / SHINGLES).cast("int").alias("turns"))
    )
    if mixed.isEmpty():
        return None
    rows = labelled.join(mixed, "head")
    block, turn = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("doc_id"), F.col("turns")).cast("int")
    kept = ["head", "block", "turn", "doc_id", "comp", "asks"]
    members = rows.withColumns({"block": block, "asks": F.lit(0)}).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).select(*kept)
    asking = rows.where("comp <> main").withColumns({"turn": turn, "asks": F.lit(1)}).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*kept)
    return _opened(members.unionByName(asking), sets, percent, minima)


def _links(docs: DataFrame, signed: DataFrame, words: int, percent: int, lower: bool, minima: int) -> DataFrame:
    """Links (a, b) that connect all linked documents; ``signed`` holds each set once."""
    near = _neighbours(signed, *banding(percent, minima))
    # sets of documents that share a bucket, made once: only then are texts read again
    wanted = written(near.select(F.explode(F.array("head", "doc_id")).alias("doc_id")).distinct())
    sets = written(docs.join(wanted, "doc_id", "left_semi").mapInArrow(_set_maker(words, lower, minima), _SETS).where("n > 0"))
    links = _with_heads(near, sets, percent, minima)
    more = _with_each_other(near, sets, links, percent, minima)
    return links if more is None else links.unionByName(more)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, lower: bool = True, minima: int = MINIMA) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, n_shingles, component_id (the least doc_id reachable by links) and kept (it is its own component's)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = written(signatures(rows, words, lower, minima))
    known = signed.where("n > 0 and doc_id is not null")
    classes = materialised(known.groupBy("set_a", "set_b", "n").agg(F.min("doc_id").alias("rep")))
    reps = written(known.join(classes.select(F.col("rep").alias("doc_id"), "set_a", "set_b"), ["doc_id", "set_a", "set_b"], "left_semi").select("doc_id", "n", "signature"))
    found = star_components(_links(rows, reps, words, percent, lower, minima))
    named = materialised(classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", "n", F.coalesce("component", "rep").alias("component")))
    linked = signed.select("doc_id", "n", "set_a", "set_b").join(named, ["set_a", "set_b", "n"], "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return linked.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
