"""Substring deduplication by level-wise doubling of repeated word windows.

A window of n words can only repeat if the shorter windows inside it repeat.  So a short length
is tested first, and only what repeats there is extended to twice that length, level by level,
until the wanted length is reached or no candidate survives.  On the way only anchors are tested:
of all windows of the level's length inside each wanted window the one with the least hash, which
is the same in every copy.  The last level finds, for every surviving window, the least document
that holds it; a word is removed if a window over it also starts in a document with a smaller id.

Documents are laid out once in small cells (a bucketed table), so that the levels read them
again without another shuffle; between the levels only window hashes and bit masks move.  A
window is sent once a cell, however often the cell holds it, so that a passage of all documents
makes no large group.

Nulls, empties and ties: null or empty texts have no words; a null id counts as larger than any
other, and rows with equal or null ids are never removed on account of each other; windows that
repeat within one document only are kept; documents shorter than a window keep all words;
repeated rows (same id and text) are each judged.  Very long texts are
handled whole, in the memory of one task.  Further columns may have any name.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.kernels import Words, blobs, text_buffers
from tallyhouse.llm.tables import materialised, partitions, written

_NO_ID = np.int64(2**63 - 1)
#: The first level's windows have about so many words.
START_WORDS = 8
_ANCHORS = "bucket int, cell int, hashes binary, several binary"
_WINDOWS = "bucket int, cell int, hashes binary, docs binary"
_MASKS = "cell int, level int, bucket int, bits binary"


def level_lengths(window: int, start: int = START_WORDS) -> list[int]:
    """Window lengths of the levels, each at most twice the one before, the last one ``window``."""
    lengths = [window]
    while lengths[0] > start and lengths[0] > 1:
        lengths.insert(0, -(-lengths[0] // 2))
    return lengths


def _least_positions(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the position of its least one (the first of equals)."""
    at = np.arange(len(values))
    span = 1
    while span < width:
        step = min(span, width - span)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        span += step
    return at


class _Cell:
    """The documents of one cell in a fixed order, with what each level needs of them."""

    def __init__(self, table: pa.Table, lengths: list[int], buckets: int):
        self.lengths, self.window, self.buckets = lengths, lengths[-1], buckets
        self.table = table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")]))
        raw, offsets = text_buffers(self.table.column("text"))
        self.words = Words(raw, offsets)
        self.ids = pc.fill_null(self.table.column("doc_id").cast(pa.int64()), _NO_ID).to_numpy()
        self.start, self.found = self.words.windows(self.window)  # wanted windows: first words and hashes

    def anchors(self, level: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes of the anchors of wanted windows, which of them each window has, and whether one stands at several places."""
        length = self.lengths[level]
        at, found = self.words.windows(length)
        inside = self.window - length + 1
        if not len(start):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
        # the windows of a level follow each other inside a wanted one, so its first one's place is enough
        least = _least_positions(found, inside)[np.searchsorted(at, start)]
        hashes, which = np.unique(found[least], return_inverse=True)
        low, high = np.full(len(hashes), len(found)), np.full(len(hashes), -1)
        np.minimum.at(low, which, least)
        np.maximum.at(high, which, least)
        return hashes, which, low < high

    def dealt(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order by bucket, the buckets present, and their edges in that order."""
        bucket = ((hashes >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        full = np.flatnonzero(np.diff(edges))
        return order, full, np.append(edges[full], len(order))

    def marked(self, hashes: np.ndarray, masks: pa.Table, level: int) -> np.ndarray:
        """The masks of one level, back in the order of ``hashes``."""
        order, full, edges = self.dealt(hashes)
        out = np.zeros(len(hashes), bool)
        place = {b: i for i, b in enumerate(full.tolist())}
        for one, bucket, bits in zip(masks.column("level").to_pylist(), masks.column("bucket").to_pylist(), masks.column("bits"), strict=True):
            if one == level:
                a, b = edges[place[bucket]], edges[place[bucket] + 1]
                out[order[a:b]] = np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=b - a).astype(bool)
        return out

    def survivors(self, level: int, masks: pa.Table) -> np.ndarray:
        """Places of the wanted windows whose anchors repeat at all levels before this one."""
        alive = np.arange(len(self.start))
        for k in range(level):
            hashes, which, _ = self.anchors(k, self.start[alive])
            alive = alive[self.marked(hashes, masks, k)[which]] if len(alive) else alive
        return alive

    def windows(self, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes of these wanted windows, their least documents, which hash each has, and its document."""
        hashes, which = np.unique(self.found[alive], return_inverse=True)
        docs = self.ids[self.words.doc[self.start[alive]]]
        least = np.full(len(hashes), _NO_ID)
        np.minimum.at(least, which, docs)
        return hashes, least, which, docs

    def removed(self, masks: pa.Table) -> np.ndarray:
        """Whether each word goes."""
        last = len(self.lengths) - 1
        alive = self.survivors(last, masks)
        hashes, least, which, docs = self.windows(alive)
        elsewhere = self.marked(hashes, masks, last)
        gone = self.start[alive[elsewhere[which] | (docs > least[which])]] if len(alive) else alive
        change = np.zeros(len(self.words.hash) + 1, np.int64)
        np.add.at(change, gone, 1)
        np.add.at(change, gone + self.window, -1)
        return np.cumsum(change[:-1]) > 0


def _level(level: int, lengths: list[int], buckets: int, cell_name: str):
    """What a cell sends at a level: distinct hashes, and whether it holds several or their least document."""
    last = level == len(lengths) - 1
    schema = pa.schema([("bucket", pa.int32()), ("cell", pa.int32()), ("hashes", pa.binary()), ("docs" if last else "several", pa.binary())])

    def run(table: pa.Table, masks: pa.Table | None = None) -> pa.Table:
        if not len(table):
            return schema.empty_table()
        cell = _Cell(table, lengths, buckets)
        alive = cell.survivors(level, masks) if level else np.arange(len(cell.start))
        if last:
            hashes, more, _, _ = cell.windows(alive)
        else:
            hashes, _, more = cell.anchors(level, cell.start[alive])
        order, full, edges = cell.dealt(hashes)
        sent = hashes[order] if last else hashes[order].astype(np.uint32)
        columns = [pa.array(full, pa.int32()), pa.array([table.column(cell_name)[0].as_py()] * len(full), pa.int32()), blobs(sent, edges), blobs(more[order], edges)]
        return pa.Table.from_arrays(columns, schema=schema)

    return (lambda table: run(table)) if not level else run


def _repeated(level: int):
    """Which hashes of a bucket several cells, or one cell several times, hold."""

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("hashes")]
        several = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("several")])
        _, which = np.unique(np.concatenate(parts), return_inverse=True)
        return _masks(table, level, np.bincount(which, weights=1 + several)[which] > 1, [len(p) for p in parts])

    return run


def _held_before(level: int):
    """Which windows of a bucket start in a document with a smaller id than any of their cell."""

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")]
        docs = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("docs")])
        hashes, which = np.unique(np.concatenate(parts), return_inverse=True)
        least = np.full(len(hashes), _NO_ID)
        np.minimum.at(least, which, docs)
        return _masks(table, level, docs > least[which], [len(p) for p in parts])

    return run


def _masks(table: pa.Table, level: int, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    edges = np.concatenate([[0], np.cumsum(sizes)])
    bits = [np.packbits(flags[a:b]).tobytes() if flags[a:b].any() else None for a, b in zip(edges[:-1], edges[1:], strict=True)]
    kept = [i for i, b in enumerate(bits) if b is not None]
    return pa.table(
        {
            "cell": table.column("cell").take(pa.array(kept, pa.int64())).cast(pa.int32()),
            "level": pa.array([level] * len(kept), pa.int32()),
            "bucket": table.column("bucket").take(pa.array(kept, pa.int64())).cast(pa.int32()),
            "bits": pa.array([bits[i] for i in kept], pa.binary()),
        }
    )


def _kept_texts(cell: _Cell, masks: pa.Table, rejoined: bool) -> tuple[list[bytes], np.ndarray]:
    """Each document's text without its removed words, and how many went.

    ``rejoined``: kept words joined by one space; else the text around them stays as it was.
    """
    words, raw = cell.words, cell.words.raw.tobytes()
    gone = cell.removed(masks)
    lost = np.bincount(words.doc[gone], minlength=words.documents)
    _, offsets = text_buffers(cell.table.column("text"))
    out = []
    for i in range(words.documents):
        a, b = int(words.first[i]), int(words.first[i + 1])
        text = raw[offsets[i] : offsets[i + 1]]
        if not lost[i]:
            out.append(b" ".join(text.split()) if rejoined else text)
            continue
        kept = np.flatnonzero(~gone[a:b]) + a
        if rejoined:
            # ends of runs of kept words, so that a run is joined at once
            out.append(b" ".join(raw[words.start[k] : words.end[k]] for k in kept.tolist()))
            continue
        edges = np.append(words.start[a + 1 : b], offsets[i + 1])  # a word goes with the space behind it
        lead = text[: int(words.start[a] - offsets[i])]
        out.append(lead + b"".join(raw[words.start[k] : edges[k - a]] for k in kept.tolist()))
    return out, lost


def _digest(lengths: list[int], buckets: int):
    def run(table: pa.Table, masks: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string())})
        cell = _Cell(table, lengths, buckets)
        texts, lost = _kept_texts(cell, masks, rejoined=True)
        return pa.table(
            {
                "doc_id": cell.table.column("doc_id"),
                "n_words": pa.array(cell.words.count, pa.int64()),
                "n_removed": pa.array(lost, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            }
        )

    return run


def _cleaned(lengths: list[int], buckets: int, names: list[str]):
    def run(table: pa.Table, masks: pa.Table) -> pa.Table:
        if not len(table):
            return table.select(names)
        cell = _Cell(table, lengths, buckets)
        texts, lost = _kept_texts(cell, masks, rejoined=False)
        out = cell.table
        old = out.column("text")
        changed = lost > 0
        new = [t.decode() if c else x.as_py() for t, c, x in zip(texts, changed, old, strict=True)]
        out = out.set_column(out.column_names.index("text"), "text", pa.array(new, old.type))
        if "n_chars" in names:
            chars = [len(t) if c else x.as_py() for t, c, x in zip(new, changed, out.column("n_chars"), strict=True)]
            out = out.set_column(out.column_names.index("n_chars"), "n_chars", pa.array(chars, out.column("n_chars").type))
        return out.select(names)

    return run


def _free_name(docs: DataFrame) -> str:
    """A column name that ``docs`` does not have."""
    name, taken = "layout_cell", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _through_levels(docs: DataFrame, window: int, finish, schema, keep) -> DataFrame:
    spark, lengths, name = docs.sparkSession, level_lengths(window), _free_name(docs)
    buckets = partitions(spark)
    cells = 4 * buckets  # several to a bucket of the table, which evens its sizes out
    table = f"cells_{uuid.uuid4().hex}"
    laid = docs.withColumn(name, F.pmod(F.xxhash64("doc_id", "text"), F.lit(cells)).cast("int"))
    laid.repartition(buckets, name).write.bucketBy(buckets, name).sortBy(name).saveAsTable(table)
    by_cell = spark.table(table)
    slim = by_cell.select(name, "doc_id", "text").groupBy(name)
    last, masks = len(lengths) - 1, spark.createDataFrame([], _MASKS)
    try:
        for level in range(len(lengths)):
            run = _level(level, lengths, buckets, name)
            sent = slim.applyInArrow(run, _WINDOWS if level == last else _ANCHORS) if not level else slim.cogroup(masks.groupBy("cell")).applyInArrow(run, _WINDOWS if level == last else _ANCHORS)
            found = materialised(sent.groupBy("bucket").applyInArrow(_held_before(level) if level == last else _repeated(level), _MASKS))
            masks = found if not level else masks.unionByName(found)
            if level < last and found.isEmpty():
                break  # no candidate survives
        return keep(by_cell.groupBy(name).cogroup(masks.groupBy("cell")).applyInArrow(finish(lengths, buckets), schema))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def repeated_words_digest(docs: DataFrame, window: int = 13) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _through_levels(rows, window, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string", materialised)


def without_repeated_words(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` with its words in repeated windows removed from ``text``; ``n_chars`` follows, other columns stay."""
    names = docs.columns
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    return _through_levels(docs, window, lambda lengths, buckets: _cleaned(lengths, buckets, names), schema, written)
