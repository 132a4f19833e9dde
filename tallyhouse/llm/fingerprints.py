"""Document fingerprints by consistent weighted sampling.

Terms are words (runs of bytes other than ASCII white space), weighted by how often they occur.
For each of ``SAMPLES`` draws a term of weight w gets, from its hash alone, r and c from
Gamma(2, 1) and b from the unit interval; with t = floor(ln w / r + b) and ln y = r (t - b), the
term with the least ln c - ln y - r is drawn, and the pair (term, t) is the sample.  Two texts
draw the same pair with a probability equal to their generalised Jaccard similarity.  Gamma
values come from tables of 2**16 quantiles.  A fingerprint holds four hex digits a draw.

Nulls, empties and ties: a null text counts as empty; a text without words has the empty
fingerprint, which is like another empty one (1.0) and unlike any other (0.0).  Documents are
ordered by id, null ids last, equal ids by text; a repeated row is a document of its own.  An
empty table gives no rows.  A frequent id, or null ids, are dealt to several tasks by text.
Very long texts are handled whole, in the memory of one task; further columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.kernels import Words, mix
from tallyhouse.llm.tables import partitions

SAMPLES = 64
#: Characters of a sampled text that opens a range within a frequent id.
SPLIT_CHARS = 1000
_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


@cache
def _gamma_tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) at the middles of 2**16 equal steps, and their logarithms."""
    want = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.linspace(0, 30, 2_000_001)
    values = np.interp(want, 1 - np.exp(-x) * (1 + x), x)
    return values.astype(np.float32), np.log(values).astype(np.float32)


@cache
def _draw_seeds(samples: int) -> np.ndarray:
    return mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _keys(terms: np.ndarray, weights: np.ndarray, samples: int) -> np.ndarray:
    """For each weighted term and draw: the value to be least, ordered, above 16 bits that name (term, t)."""
    out = np.empty((len(terms), samples), np.uint64)
    for a in range(0, len(terms), 512):  # so few at once stay in the processor's cache
        out[a : a + 512] = _block_keys(terms[a : a + 512], weights[a : a + 512], samples)
    return out


def _block_keys(terms: np.ndarray, weights: np.ndarray, samples: int) -> np.ndarray:
    gamma, log_gamma = _gamma_tables()
    bits = mix(terms[:, None] ^ _draw_seeds(samples)[None, :])
    parts = bits.view(np.uint16).reshape(len(terms), samples, 4)  # r, c, b and the name, 16 bits each
    r = gamma[parts[:, :, 0]]
    log_c = log_gamma[parts[:, :, 1]]
    b = parts[:, :, 2] * np.float32(1 / 65536)
    value, name = log_c + r * (b - 1), parts[:, :, 3].astype(np.uint64)  # of weight 1, where t is 0
    heavy = np.flatnonzero(weights > 1)
    if len(heavy):
        r, b = r[heavy], b[heavy]
        t = np.floor(np.log(weights[heavy]).astype(np.float32)[:, None] / r + b)
        value[heavy] = log_c[heavy] - r * (t - b) - r
        name[heavy] = np.where(t == 0, name[heavy], mix(bits[heavy] + t.astype(np.int64).astype(np.uint64)) >> np.uint64(48))
    raw = value.view(np.int32)
    ordered = (raw ^ ((raw >> 31) | np.int32(-(1 << 31)))).view(np.uint32)
    return (ordered.astype(np.uint64) << np.uint64(32)) | name


def signatures(texts: list[bytes], samples: int = SAMPLES, limit: int = 1_000_000) -> np.ndarray:
    """texts x samples names of the drawn (term, t); a row of a text without words is all -1.

    Texts that share terms are best put side by side: each weighted term of a chunk is drawn for once.
    """
    out = np.full((len(texts), samples), -1, np.int32)
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and b - a < 4096 and (b == a or size + len(texts[b]) <= limit):
            size += len(texts[b])
            b += 1
        raw = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        words = Words(raw, np.concatenate([[0], np.cumsum([len(t) for t in texts[a:b]])]))
        if len(words.hash):
            # the text's number within the chunk above 52 bits of the word's hash
            ordered = np.sort((words.doc.astype(np.uint64) << np.uint64(52)) | (words.hash >> np.uint64(12)))
            at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            weight = np.diff(np.append(at, len(ordered)))
            term, doc = ordered[at] & np.uint64((1 << 52) - 1), (ordered[at] >> np.uint64(52)).astype(np.int64)
            pair = mix(term + weight.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            by = np.argsort(pair)
            first = np.append(True, pair[by][1:] != pair[by][:-1])
            which = np.empty(len(by), np.int64)
            which[by] = np.cumsum(first) - 1
            keys = _keys(term[by[first]], weight[by[first]], samples)
            starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            # a few texts' terms are gathered at a time, so that the table stays small
            edges = [0, *starts[np.flatnonzero(np.diff(starts // 2000)) + 1].tolist(), len(doc)]
            for x, y in zip(edges, edges[1:], strict=False):
                inner = starts[(starts >= x) & (starts < y)]
                if len(inner):
                    least = np.minimum.reduceat(keys[which[x:y]], inner - x, axis=0)
                    out[a + doc[inner]] = (least & np.uint64(0xFFFF)).astype(np.int32)
        a = b
    return out


def fingerprint_text(signature: np.ndarray) -> str:
    return "" if signature[0] < 0 else signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal draws, row by row."""
    return (a == b).mean(axis=1)


def _fingerprinter(samples: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fingerprint_text(s) for s in signatures(texts, samples)], pa.string())], ["doc_id", "fingerprint"])

    return run


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id and fingerprint."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_fingerprinter(samples), "doc_id long, fingerprint string")


class _Ranges:
    """Ranges of (id, text) in the order of documents, null ids last.

    ``splits`` are ids that open a range; within a frequent id, and within null ids, texts open
    further ranges: ``texts`` of the id, of which the first is the empty one.
    """

    def __init__(self, splits: list[int], texts: dict[int | None, list[str]]):
        self.texts = texts
        self.ids = np.array(sorted(set(splits) | {v for v in texts if v is not None}), np.int64)
        sizes = np.array([len(texts.get(v, (0,))) for v in self.ids.tolist()], np.int64)
        self.upto = np.concatenate([[0], np.cumsum(sizes)])

    def place(self, ids: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The range of each row, and which rows are of a frequent or null id."""
        none = ids.is_null().to_numpy(zero_copy_only=False)
        values = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        part = self.upto[np.searchsorted(self.ids, values, side="right")]
        hot = none.copy()
        for v, opened in self.texts.items():
            here = np.flatnonzero(none if v is None else (values == v) & ~none)
            hot[here] = True
            start = self.upto[-1] if v is None else self.upto[np.searchsorted(self.ids, v)]
            part[here] = [start + bisect_right(opened, texts[int(i)].as_py()) for i in here]
        return part, hot


def _first_of_ranges(held):
    """The range and id of every row, with the text where the id is a frequent one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            part, hot = held.value.place(ids, texts)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), ids, pc.if_else(pa.array(hot), texts, pa.scalar(None, pa.string()))], ["part", "doc_id", "text"])

    return run


def _parter(held):
    """Rows with their range; the first rows of a range also go to the range before it, marked.

    Of equal rows of a frequent id, those of one batch are sent once, with their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, first, before = held.value
        for batch in batches:
            ids, texts, hashes = (batch.column(n) for n in ("doc_id", "text", "hash"))
            part, hot = ranges.place(ids, texts)
            copies, keep, seen = np.ones(len(part), np.int64), np.ones(len(part), bool), {}
            for i in np.flatnonzero(hot).tolist():
                held_by = seen.setdefault((ids[i].as_py(), texts[i].as_py()), i)
                if held_by != i:
                    copies[held_by] += 1
                    keep[i] = False
            at = np.flatnonzero(keep)
            opens = [first[p] == (v, h if x else None) for p, v, h, x in zip(part[at].tolist(), ids.take(pa.array(at)).to_pylist(), hashes.take(pa.array(at)).to_pylist(), hot[at].tolist(), strict=True)]
            back = at[np.array(opens, bool)]
            rows = pa.array(np.concatenate([at, back]))
            to = np.concatenate([part[at], np.array([before[p] for p in part[back].tolist()], np.int64)])
            columns = [pa.array(to, pa.int32()), pa.array(np.repeat([0, 1], [len(at), len(back)]), pa.int32()), pa.array(np.concatenate([copies[at], copies[back]]))]
            yield pa.RecordBatch.from_arrays([*columns, ids.take(rows), texts.take(rows)], ["part", "after", "copies", "doc_id", "text"])

    return run


def _edit_part(samples: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(
            zip(*(table.column(n).to_pylist() for n in ("after", "doc_id", "text", "copies")), strict=True),
            key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2]),
        )
        # equal rows follow each other: all but the last are followed by one of their own
        rows = [one for r in rows for one in ((*r[:3], r[3] - 1), (*r[:3], 1)) if one[3]]
        own = sum(1 for r in rows if not r[0])
        texts = [r[2] for r in rows[: own + 1]]
        if len(texts) == own and own:
            texts.append(texts[0])  # a lone part follows itself
        n_chars = [len(t) for t in texts[:own]]
        edited = [t[: n - n // 2] + after[: n // 2] for t, n, after in zip(texts, n_chars, texts[1:], strict=False)]
        edited = [t.encode() for t in edited[:own]]
        both: list[bytes] = []
        for i, text in enumerate(texts):
            both += [text.encode(), edited[i]] if i < own else [text.encode()]
        found = signatures(both, samples)
        plain, changed = found[0::2], found[1::2]
        return pa.table(
            {
                "doc_id": pa.array([r[1] for r in rows[:own]], pa.int64()),
                "n_chars": pa.array(n_chars, pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()),
                "fingerprint": pa.array([fingerprint_text(s) for s in plain[:own]], pa.string()),
                "edited_fingerprint": pa.array([fingerprint_text(s) for s in changed], pa.string()),
                "near_edited": pa.array(likeness(plain[:own], changed), pa.float64()),
                "near_next": pa.array(likeness(plain[:own], plain[1 : own + 1]), pa.float64()),
                "copies": pa.array([r[3] for r in rows[:own]], pa.int64()),
            }
        )

    return run


def fingerprint_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, in which the last half of the characters gives way to
    the beginning of the next document (by id; the first follows the last)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    context, ranges = spark.sparkContext, _ranges(rows, 4 * partitions(spark))
    placed = rows.mapInArrow(_first_of_ranges(context.broadcast(ranges)), "part int, doc_id long, text string")
    # the least id of each range, and its least text if the id is a frequent one: a row a range
    least = placed.groupBy("part").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.xxhash64("text"), "text").alias("hash")).collect()
    first = {r["part"]: (r["doc_id"], r["hash"] if r["doc_id"] in ranges.texts else None) for r in least}
    filled = sorted(first)
    held = context.broadcast((ranges, first, {p: filled[i - 1] for i, p in enumerate(filled)}))
    dealt = rows.withColumn("hash", F.xxhash64("text")).mapInArrow(_parter(held), "part int, after int, copies long, doc_id long, text string")
    found = dealt.groupBy("part").applyInArrow(_edit_part(samples), f"{_EDITED}, copies long")
    return found.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("copies", "copy")


def _ranges(rows: DataFrame, parts: int) -> _Ranges:
    """Some ``parts`` ranges that hold about as many rows each; frequent ids are split by a sample of their texts."""
    found = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts), F.count("*"), F.count("doc_id")).collect()[0] if parts > 1 else (None, 0, 0)
    splits = found[0] or []
    share = {v: n for v, n in Counter(splits).items() if n > 1}
    if found[1] > found[2]:
        share[None] = -(-parts * (found[1] - found[2]) // found[1])
    texts = {v: [""] for v in share}
    wanted = [v for v, n in share.items() if n > 1]
    if wanted:
        # texts in the order of their hashes are a fair sample, whatever the order of rows
        sample = rows.where(F.col("doc_id").isin([v for v in wanted if v is not None]) | (F.col("doc_id").isNull() & F.lit(None in wanted)))
        held = sample.select("doc_id", F.substring("text", 1, SPLIT_CHARS).alias("text"), F.xxhash64("doc_id", "text").alias("hash")).orderBy("hash").limit(16 * parts).collect()
        for v in wanted:
            own = sorted({r["text"] for r in held if r["doc_id"] == v} - {""})
            n = min(share[v], len(own) + 1)
            texts[v] += sorted({own[i * len(own) // n] for i in range(1, n)}) if own else []
    if parts == 1:
        texts[None] = [""]
    return _Ranges(splits, texts)
