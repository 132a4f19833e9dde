"""N-gram Jaccard join with a token-group matrix.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of word shingles.

1. A counting sketch of fixed size orders all shingles, rare before frequent; the order only
   steers the work, never the result.  Of each set, the first shingles in that order (its
   prefix) are enough to meet any linked set's prefix.
2. Equal sets are one document from here on.
3. Similar documents are put into groups of bounded size: of a document's four least hashes the
   one that most documents share names its group, so a family of near copies fills few groups.
   Where more documents share it than a group holds, all are compared with the family's head first,
   the one that shares most.  Documents that share enough with the head are one family, whose
   groups do not meet in the matrix: two of them link by what they do not have in common with the
   head, so prefixes of these differences meet in a matrix of their own, and those that link
   with the head are linked with each other already.
   The token-group matrix holds the union of each group's prefixes.  A document's prefix is
   counted against it; the count bounds its overlap with anything in the group, and only groups
   whose bound reaches the threshold are opened.
4. In an opened group the whole sets are intersected exactly.  Each opened group reports a
   spanning forest of the links it found, not all pairs; components follow from the forests.

Nulls, empties and ties: a null or empty text, or one without words, has an empty set and is
linked with nothing; a text of fewer words than a shingle is one shingle; a row with a null id
is linked with nothing and has a null component; ids are taken as unique (rows that share an id
count as linked through it).  Very long texts are shingled whole, in the memory of one task.
Further columns, of whatever name, are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.graph import components
from tallyhouse.llm.kernels import blobs, chunks, list_array, mix
from tallyhouse.llm.tables import materialised, partitions, written

#: The counting sketch has 2**SKETCH_BITS counters, whatever the input holds; its classes are one byte each.
SKETCH_BITS = 22
_SKETCH_BLOCKS = 256
#: Members of a group, and queries that one task opens a group for, on average at most.
GROUP_MEMBERS = 1024
GROUP_QUERIES = 512
_KEY_SALTS = (0x8CB92BA72F3D8DD7, 0x4CF5AD432745937F, 0x38B34AE5A1E38B93)


def _needed(n, percent: int):
    """The least overlap that a set of n shingles has with a linked set."""
    return -(-n * percent // 100)


def _overlap(total, percent: int):
    """The least overlap of two linked sets whose sizes sum up to ``total``."""
    return -(-total * percent // (100 + percent))


def _familiar(n, percent: int):
    """The least overlap with a family's head that makes a set of n shingles one of the family: that of sets linked with one set, or less."""
    return np.maximum(1, 2 * _needed(n, percent) - n)


def _apart(total, percent: int):
    """The most shingles that only one of two linked sets has, whose sizes sum up to ``total``."""
    return total - 2 * _overlap(total, percent)


# -- the order of shingles --------------------------------------------------------------------


def _sketcher(words: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(1 << SKETCH_BITS, np.int64), [], 0

        def add() -> None:
            nonlocal held, size
            if held:
                np.add(counts, np.bincount(np.concatenate(held), minlength=1 << SKETCH_BITS), out=counts)
            held, size = [], 0

        for batch in batches:
            for _, _, w in chunks(batch.column(0), lower):
                _, found = w.shingle_sets(words)
                held.append((found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64))
                size += len(found)
                if size > 2_000_000:
                    add()
        add()
        each = counts.reshape(_SKETCH_BLOCKS, -1)
        full = np.flatnonzero(each.any(axis=1))
        if len(full):
            packed = [zlib.compress(each[k].astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for k in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(packed, pa.binary())], ["block", "counts"])

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the blocks of one part as they come, however many tasks have sent one."""
    size, total = (1 << SKETCH_BITS) // _SKETCH_BLOCKS, {}
    for batch in batches:
        for block, blob in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
            counts = np.frombuffer(zlib.decompress(blob.as_py()), np.uint8).reshape(4, -1).T
            held = total.setdefault(block, np.zeros(size, np.int64))
            np.add(held, np.ascontiguousarray(counts).view(np.uint32).ravel(), out=held)
    classes = [np.minimum(255, np.round(8 * np.log2(1 + held))).astype(np.uint8).tobytes() for held in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(classes, pa.binary())], ["block", "classes"])


def shingle_classes(docs: DataFrame, words: int, lower: bool) -> np.ndarray:
    """How frequent the shingles of each sketch cell are, in steps of an eighth of a power of two."""
    parts = docs.select(F.col("text").cast("string")).mapInArrow(_sketcher(words, lower), "block int, counts binary")
    rows = parts.repartition(min(_SKETCH_BLOCKS, partitions(docs.sparkSession)), "block").mapInArrow(_sum_blocks, "block int, classes binary").collect()
    out = np.zeros((_SKETCH_BLOCKS, (1 << SKETCH_BITS) // _SKETCH_BLOCKS), np.uint8)
    for r in rows:
        out[r["block"]] = np.frombuffer(r["classes"], np.uint8)
    return out.ravel()


# -- sets and prefixes ------------------------------------------------------------------------

_SIGNED = "doc_id long, n int, set_a long, set_b long, keys array<long>, central int, prefix array<long>"


def _signer(held, words: int, percent: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = held.value
        for batch in batches:
            for a, b, w in chunks(batch.column("text"), lower):
                starts, found = w.shingle_sets(words)
                n = np.diff(starts)
                full = np.flatnonzero(n)
                sums = np.zeros((2, b - a), np.uint64)
                least = np.zeros((b - a, 1 + len(_KEY_SALTS)), np.uint64)
                if len(full):
                    for k, salt in enumerate((0x51ED270B0A1F39C1, 0x2545F4914F6CDD1D)):
                        sums[k, full] = np.add.reduceat(mix(found ^ np.uint64(salt)), starts[:-1][full])
                    least[full, 0] = found[starts[:-1][full]]
                    for k, salt in enumerate(_KEY_SALTS, 1):
                        least[full, k] = np.minimum.reduceat(mix(found ^ np.uint64(salt)), starts[:-1][full])
                classes = order[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                central = np.zeros(b - a, np.int64)  # how frequent a set's shingles are, on average
                if len(full):
                    central[full] = 100 * np.add.reduceat(classes.astype(np.int64), starts[:-1][full]) // n[full]
                prefixes, edges = [], [0]
                for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    take = y - x - _needed(y - x, percent) + 1 if y > x else 0
                    if take:
                        prefixes.append(found[x:y][np.argsort(classes[x:y], kind="stable")[:take]])
                    edges.append(edges[-1] + take)
                prefix = np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(n, pa.int32()),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        list_array(least.view(np.int64).ravel(), np.arange(b - a + 1) * least.shape[1], pa.int64()),
                        pa.array(central, pa.int32()),
                        list_array(prefix.view(np.int64), np.array(edges), pa.int64()),
                    ],
                    ["doc_id", "n", "set_a", "set_b", "keys", "central", "prefix"],
                )

    return run


# -- the matrix -------------------------------------------------------------------------------


def _dealer(buckets: int):
    """The matrix in parts: one row for each batch and bucket of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            tokens = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            bucket = ((tokens >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(edges))
            edges = np.append(edges[full], len(order))
            tokens, row = tokens[order], row[order]
            # a document's number, group and size stand once for all its tokens of a bucket
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (bucket[order][1:] != bucket[order][:-1])
            at = np.flatnonzero(new)
            owners = np.searchsorted(at, edges)
            columns = {"tokens": blobs(tokens, edges), "repeats": blobs(np.diff(np.append(at, len(row))).astype(np.uint32), owners)}
            for name in ("doc_id", "gid", "star", "n"):
                columns[name] = blobs(batch.column(name).to_numpy(zero_copy_only=False)[row[at]], owners)
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *columns.values()], ["bucket", *columns])

    return run


_DEALT = "bucket int, tokens binary, repeats binary, doc_id binary, gid binary, star binary, n binary"
_MET = "doc_id long, gid long, n int, hits int, lo int, hi int"


def _meeter(percent: int, pairs_at_once: int = 1_000_000):
    """Counts, for the tokens of one part, how often a document meets its own group or one that comes before it.

    Groups of one star (a family, or a side of it) come one after another and do not meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list] = {k: [] for k in ("tokens", "repeats", "doc_id", "gid", "star", "n")}
        kinds = {"tokens": np.uint64, "repeats": np.uint32, "doc_id": np.int64, "gid": np.int64, "star": np.int64, "n": np.int32}
        for batch in batches:
            for name, kind in kinds.items():
                parts[name] += [np.frombuffer(x.as_py(), kind) for x in batch.column(name)]
        if not parts["tokens"]:
            return
        flat = {k: np.concatenate(v) for k, v in parts.items()}
        owner = np.repeat(np.arange(len(flat["repeats"])), flat["repeats"])
        # only tokens that at least two documents hold
        order = np.argsort(flat["tokens"], kind="stable")
        token, owner = flat["tokens"][order], owner[order]
        shared = np.zeros(len(token), bool)
        shared[1:] = token[1:] == token[:-1]
        shared[:-1] |= shared[1:].copy()
        token, owner = token[shared], owner[shared]
        doc, gid, star, n = flat["doc_id"][owner], flat["gid"][owner], flat["star"][owner], flat["n"][owner]
        order = np.lexsort((n, gid, star, token))
        token, doc, gid, star, n = token[order], doc[order], gid[order], star[order], n[order]
        # rows of the matrix: (token, group), with the sizes of its members that hold the token
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (star[1:] != star[:-1]) | (gid[1:] != gid[:-1])
        row = np.flatnonzero(new)
        low, high = n[row], n[np.append(row[1:], len(n)) - 1] if len(row) else n[:0]
        mine = np.cumsum(new) - 1
        first_of_token = np.ones(len(token), bool)
        first_of_token[1:] = token[1:] != token[:-1]
        starts = mine[np.maximum.accumulate(np.where(first_of_token, np.arange(len(token)), 0))] if len(token) else mine
        several = np.diff(np.append(row, len(token))) > 1
        in_star = star != 0
        opens = first_of_token | ~in_star  # where the groups end that a document of a star meets
        opens[1:] |= star[1:] != star[:-1]
        before = mine[np.maximum.accumulate(np.where(opens, np.arange(len(token)), 0))] if len(token) else mine
        many = before - starts + (several[mine] & ~in_star)  # groups of the same token that come before, and its own if another member is there
        a = 0
        while a < len(token):
            b = max(a + 1, int(np.searchsorted(np.cumsum(many[a:]), pairs_at_once)) + a)
            copies = many[a:b]
            who = np.repeat(np.arange(a, b), copies)
            which = np.repeat(starts[a:b], copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            fits = (n[who] * percent <= high[which].astype(np.int64) * 100) & (low[which] * percent <= n[who].astype(np.int64) * 100)
            who, which = who[fits], which[fits]
            if len(who):
                d, g, size = doc[who], gid[row[which]], n[who]
                order = np.lexsort((g, d))
                d, g, size, lo, hi = d[order], g[order], size[order], low[which][order], high[which][order]
                cut = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (g[1:] != g[:-1])))
                hits = np.diff(np.append(cut, len(d)))
                columns = [pa.array(d[cut]), pa.array(g[cut]), pa.array(size[cut], pa.int32()), pa.array(hits, pa.int32())]
                columns += [pa.array(np.minimum.reduceat(lo, cut), pa.int32()), pa.array(np.maximum.reduceat(hi, cut), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "gid", "n", "hits", "lo", "hi"])
            a = b

    return run


def _reaches(percent: int):
    """Whether the bound on the overlap with anything in the group reaches what a link needs."""

    def least(total):
        return F.ceil(total * percent / F.lit(100 + percent))

    def suffix(n):
        return F.ceil(n * percent / F.lit(100)) - 1

    n, lo, hi, hits = F.col("n"), F.greatest("lo", F.ceil(F.col("n") * percent / F.lit(100))), F.least("hi", F.floor(F.col("n") * 100 / F.lit(percent))), F.col("hits")
    smaller = (lo <= n) & (hits + suffix(n) >= least(n + lo))
    # rounding makes suffix(m) - least(n + m) fall by one here and there; unrounded it grows by percent**2 / (100 * (100 + percent))
    # a member, so only sizes this near to hi can lie above hi's own
    near = 100 * (100 + percent) // percent**2
    first = F.greatest(lo, n.cast("long"), hi - near)
    larger = F.when(first <= hi, F.exists(F.sequence(first, hi), lambda m: hits + suffix(m) >= least(n + m))).otherwise(F.lit(False))
    return smaller | larger


# -- opening groups ---------------------------------------------------------------------------


_ROUTED = "gid long, chunk int, doc_id long, member int, asks int, shingles binary"


def _set_maker(words: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in chunks(batch.column("text"), lower):
                starts, found = w.shingle_sets(words)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in ("gid", "chunk", "doc_id", "member", "asks")), blobs(found, starts)], ["gid", "chunk", "doc_id", "member", "asks", "shingles"])

    return run


class _Forest:
    """Union by smallest, for the links found in one opened group."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((a, b))


def _opener(percent: int, cells: int = 32_000_000):
    def open_group(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
        owners, asking = np.flatnonzero(table.column("member").to_numpy()), np.flatnonzero(table.column("asks").to_numpy())
        forest = _Forest()
        # members a few at a time, so that the table of tokens and members stays small
        a = 0
        while a < len(owners):
            b, size = a, 0
            while b < len(owners) and (b == a or (size + len(sets[owners[b]])) * (b - a + 1) <= cells):
                size += len(sets[owners[b]])
                b += 1
            part = owners[a:b]
            held = np.concatenate([sets[i] for i in part])
            tokens, at = np.unique(held, return_inverse=True)
            grid = np.zeros((len(tokens), b - a), np.uint8)
            grid[at, np.repeat(np.arange(b - a), [len(sets[i]) for i in part])] = 1
            sizes = np.array([len(sets[i]) for i in part])
            for i in asking:
                if not len(tokens) or not len(sets[i]):
                    continue
                where = np.searchsorted(tokens, sets[i])
                where[where == len(tokens)] = 0
                where = where[tokens[where] == sets[i]]
                both = grid[where].sum(axis=0, dtype=np.int64)
                for k in np.flatnonzero((both * (100 + percent) >= percent * (sizes + len(sets[i]))) & (both > 0)):
                    forest.link(int(ids[i]), int(ids[part[k]]))
            a = b
        pairs = np.array(forest.links, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return open_group


def _groups(distinct: DataFrame) -> DataFrame:
    """(doc_id, gid, head): each document in the group of the key that most documents share.

    ``head`` is null where a group holds all that share the key; else it is the document, of all that have the key, whose keys are
    shared most, and of equal ones that with the most frequent shingles.  It has the other keys of a family of near copies too, so all of these keys have one head.
    """
    keyed = distinct.select("doc_id", "central", F.explode("keys").alias("key"))
    crowds = materialised(keyed.groupBy("key").agg(F.count("*").alias("crowd")).where("crowd > 1"))
    counted = keyed.join(crowds, "key", "left").select("doc_id", F.struct(F.coalesce("crowd", F.lit(1)).alias("crowd"), "key").alias("one"))
    best = materialised(counted.groupBy("doc_id").agg(F.max("one").alias("best"), F.sum("one.crowd").alias("weight")))
    holders = keyed.join(crowds.where(F.col("crowd") > GROUP_MEMBERS).select("key"), "key").join(best.select("doc_id", "weight"), "doc_id")
    heads = holders.groupBy("key").agg(F.max_by("doc_id", F.struct("weight", "central", -F.col("doc_id"))).alias("head"))
    sub = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("best.crowd") / GROUP_MEMBERS))
    grouped = best.select("doc_id", F.xxhash64("best.key", sub).alias("gid"), F.col("best.key").alias("key"))
    return materialised(grouped.join(heads, "key", "left").select("doc_id", "gid", "head"))


def _sets_of(docs: DataFrame, routed: DataFrame, words: int, lower: bool) -> DataFrame:
    """The sets of the documents that ``routed`` sends to a (gid, chunk)."""
    whole = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(routed, "doc_id")
    return whole.select("gid", "chunk", "doc_id", "member", "asks", "text").mapInArrow(_set_maker(words, lower), _ROUTED)


def _difference_prefixes(n: int, x: int, head: int, percent: int) -> tuple[int, int]:
    """How many of the x shingles in which a set of n differs from the head's set must be looked up, for partners that do not link with the head and for those that do.

    Two sets differ by at most ``_apart`` of their sizes if they link, so what their differences from the head have in
    common is at least half of what these exceed that by.  This is 1 or more unless both link with the head: then only one of them
    could be as near to the head as that.
    """
    m = np.arange(_needed(n, percent), n * 100 // percent + 1)
    both, other = _apart(n + m, percent), _apart(m + head, percent)
    least = np.maximum(np.maximum(x - both, np.abs(m - head)), 0)

    def length(least: np.ndarray, most: np.ndarray) -> int:
        fits = least <= np.minimum(most, x + both)
        return max(0, x + 1 - int((x + least[fits] - both[fits] + 1).min()) // 2) if fits.any() else 0

    return length(np.maximum(least, other + 1), m + head - 2 * _familiar(m, percent)), length(least, other)


#: What a row of differences is looked up for.
_APART_ONLY, _LINKED, _APART, _FAR = 0, 1, 2, 3
_DIFFERENT = "doc_id long, head long, side int, n int, prefix array<long>"


def _differ(held, percent: int):
    """Compares the documents of a family with its head: rows of (doc_id, head, side, n, prefix of the difference).

    Side 1: linked with the head; 0 and 2: of its family, to be met with each other (0) and with those of side 1 (2); 3: others.
    """

    def run(table: pa.Table) -> pa.Table:
        order = held.value
        ids = table.column("doc_id").to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
        head = int(table.column("gid")[0].as_py())
        base = np.sort(max((sets[i] for i in np.flatnonzero(table.column("member").to_numpy())), key=lambda one: (len(one), one.tobytes())))
        salt = mix(mix(np.array([head], np.int64).view(np.uint64)) + np.arange(2, dtype=np.uint64))
        rows: list[tuple] = []

        def add(i: int, side: int, tokens: np.ndarray) -> None:
            rows.append((int(ids[i]), side, len(sets[i]), mix(tokens ^ salt[0 if side == _APART_ONLY else 1])))

        none = np.zeros(0, np.uint64)
        for i in np.flatnonzero(table.column("asks").to_numpy()):
            mine = sets[i]
            if not len(mine):
                continue
            where = np.minimum(np.searchsorted(base, mine), len(base) - 1)
            common = base[where] == mine
            if common.sum() < _familiar(len(mine), percent):
                add(i, _FAR, none)
                continue
            gone = np.ones(len(base), bool)
            gone[where[common]] = False
            # what the head lacks is rarer among its family than what it has
            parts = [np.sort(mine[~common]), base[gone]]
            different = np.concatenate([part[np.argsort(order[(part >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")] for part in parts])
            apart, linked = _difference_prefixes(len(mine), len(different), len(base), percent)
            if len(different) <= _apart(len(mine) + len(base), percent):
                add(i, _LINKED, different[:apart])
            else:
                add(i, _APART_ONLY, different[:apart])
                add(i, _APART, different[:linked])
        found, sides, sizes, tokens = zip(*rows, strict=True) if rows else ((), (), (), ())
        edges = np.cumsum([0, *map(len, tokens)])
        flat = np.concatenate([none, *tokens]).view(np.int64)
        columns = [pa.array(found, pa.int64()), pa.array([head] * len(rows), pa.int64()), pa.array(sides, pa.int32()), pa.array(sizes, pa.int32()), list_array(flat, edges, pa.int64())]
        return pa.Table.from_arrays(columns, ["doc_id", "head", "side", "n", "prefix"])

    return run


def _differences(docs: DataFrame, grouped: DataFrame, order, words: int, percent: int, lower: bool) -> DataFrame:
    """The documents that share a key with more than a group holds, compared with the heads of these keys."""
    crowded = grouped.where("head is not null")
    parts = crowded.groupBy("head").agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("parts"))
    heads = parts.select(F.col("head").alias("gid"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("chunk"), F.col("head").alias("doc_id"), F.lit(1).alias("member"), F.lit(0).alias("asks"))
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    asking = crowded.join(parts, "head").select(F.col("head").alias("gid"), part.alias("chunk"), "doc_id", F.lit(0).alias("member"), F.lit(1).alias("asks"))
    # a table, so that Spark knows its size: texts are only shuffled for crowds too large to broadcast their ids
    sets = _sets_of(docs, written(heads.unionByName(asking)), words, lower)
    return written(sets.groupBy("gid", "chunk").applyInArrow(_differ(order, percent), _DIFFERENT))


def _starred(grouped: DataFrame, different: DataFrame) -> DataFrame:
    """(doc_id, gid, star): documents of a family under its number, those that link with its head in groups of their own; 0 for the others."""
    family = different.groupBy("doc_id").agg(F.max("side").alias("most"), F.min("side").alias("least"), F.xxhash64(F.first("head")).alias("family")).where(F.col("most") < _FAR)
    both = grouped.join(family, "doc_id", "left").select("doc_id", "gid", F.coalesce("family", F.lit(0)).alias("star"), "least")
    return both.select("doc_id", F.when(F.col("star") == 0, F.col("gid")).otherwise(F.xxhash64("gid", "star", "least")).alias("gid"), "star")


def _meetings(tokens: DataFrame, percent: int) -> DataFrame:
    """A row for each document and group that it meets, with how many tokens of its prefix the group holds."""
    parts = partitions(tokens.sparkSession)
    dealt = tokens.select("doc_id", "gid", "star", "n", "prefix").mapInArrow(_dealer(4 * parts), _DEALT)
    met = dealt.repartition(parts, "bucket").mapInArrow(_meeter(percent), _MET)
    return met.groupBy("doc_id", "gid").agg(F.first("n").alias("n"), F.sum("hits").alias("hits"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _met(signed: DataFrame, grouped: DataFrame, percent: int) -> DataFrame:
    """The meetings of all documents but those of one family."""
    return _meetings(signed.select("doc_id", "n", "prefix").join(grouped, "doc_id"), percent)


def _met_in_families(different: DataFrame, grouped: DataFrame, percent: int) -> DataFrame:
    """The meetings of documents of one family, by their differences from its head."""
    sides = different.where(F.size("prefix") > 0).withColumn("star", F.col("side").cast("long"))
    return _meetings(sides.join(grouped.select("doc_id", "gid"), "doc_id"), percent)


def _links(docs: DataFrame, signed: DataFrame, distinct: DataFrame, order, words: int, percent: int, lower: bool) -> DataFrame:
    """A forest (a, b) that connects all linked documents with different sets."""
    grouped = _groups(distinct)
    different = _differences(docs, grouped, order, words, percent, lower)
    stars = different.where((F.col("side") == _LINKED) & (F.col("doc_id") != F.col("head"))).select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    grouped = materialised(_starred(grouped, different))
    met = _met(signed, grouped, percent).where(_reaches(percent)).select("doc_id", "gid")
    asked = materialised(met.unionByName(_met_in_families(different, grouped, percent).select("doc_id", "gid")).distinct())
    opened = materialised(asked.groupBy("gid").agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("chunks")))

    # where each document has to be: members in every chunk of their group (asking in one at most), queries in one chunk
    chunk = F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")
    home = grouped.select("doc_id", "gid")
    members = home.join(opened, "gid").join(asked.withColumn("asking", F.lit(True)), ["doc_id", "gid"], "left").withColumn("own", F.when(F.col("asking"), chunk))
    members = members.select("gid", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "doc_id", F.lit(1).alias("member"), "own")
    members = members.withColumn("asks", F.coalesce((F.col("chunk") == F.col("own")).cast("int"), F.lit(0))).drop("own")
    queries = asked.join(home, ["doc_id", "gid"], "left_anti").join(opened, "gid").select("gid", chunk.alias("chunk"), "doc_id", F.lit(0).alias("member"), F.lit(1).alias("asks"))
    routed = materialised(members.unionByName(queries))
    found = _sets_of(docs, routed, words, lower).groupBy("gid", "chunk").applyInArrow(_opener(percent), "a long, b long")
    return found.unionByName(stars)


def linked_documents(docs: DataFrame, words: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, n_shingles and component_id, the least doc_id reachable by links."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = spark.sparkContext.broadcast(shingle_classes(rows, words, lower))  # 2**SKETCH_BITS bytes
    signed = written(rows.mapInArrow(_signer(order, words, percent, lower), _SIGNED))
    known = signed.where("n > 0 and doc_id is not null")
    classes = materialised(known.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")))
    distinct = known.select("doc_id", "keys", "central").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    found = components(_links(rows, signed, distinct, order, words, percent, lower))
    named = materialised(
        classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    )
    ids = signed.select("doc_id", "n", "set_a", "set_b")
    linked = ids.join(named, ["set_a", "set_b"], "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return linked.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def one_of_each_group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with the least doc_id of their near-duplicate group; all columns are kept."""
    groups = linked_documents(docs, words, percent)
    others = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("repeated_id")).distinct()
    return docs.join(others, docs["doc_id"].cast("long") == others["repeated_id"], "left_anti")
