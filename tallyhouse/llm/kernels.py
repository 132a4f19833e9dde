"""Array kernels shared by the text operators; they run inside Spark tasks on Arrow batches.

A word is a maximal run of bytes other than space and ``\\x09-\\x0D``.  Words have mixed 64-bit
hashes; runs of ``n`` words are hashed with polynomial prefix sums over them, so that a window of any length
costs one subtraction; documents are never cut, and no window crosses two documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyhouse.llm.words import lowered, mix, quick_hashes, word_spans

#: Bytes handled at once; a longer document is handled alone, whole.
CHUNK_BYTES = 500_000

_WORD_BASE = 0xD1342543DE82EF95 | 1


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self._base = base
        self._inverse = pow(base, -1, 2**64)
        self._up = self._down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, 2 * len(self._up))

            def powers(base: int) -> np.ndarray:
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                return np.multiply.accumulate(steps)

            self._up, self._down = powers(self._base), powers(self._inverse)
        return self._up[:n], self._down[:n]


_WORD_POWERS = _Powers(_WORD_BASE)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows behind one another, and the n + 1 row offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, end
        row = end


def _words_of(raw: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First bytes, ends, document numbers and hashes of the words."""
    if lower:
        raw = lowered(raw)
    start, end, doc = word_spans(raw, offsets)
    return start, end, doc, quick_hashes(raw, start, end)


class Words:
    """The words of some documents: byte ranges, document numbers and hashes, in order."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False):
        offsets = offsets - offsets[0]
        self.raw, self.documents = raw, len(offsets) - 1
        # the arrays as long as the text are only made for a part of it at a time
        parts = [_words_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower) for a, b in slices(offsets)]
        bounds = list(slices(offsets))
        self.start, self.end, self.doc, self.hash = (
            np.concatenate([p[k] + shift[k] if k < 3 else p[k] for p, shift in zip(parts, ((offsets[a], offsets[a], a) for a, _ in bounds), strict=True)]) if parts else np.zeros(0, kind)
            for k, kind in enumerate((np.int64, np.int64, np.int64, np.uint64))
        )
        self.count = np.bincount(self.doc, minlength=self.documents).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``n`` words of one document."""
        total = len(self.hash)
        if total < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        up, down = _WORD_POWERS.upto(total + 1)
        sums = np.zeros(total + 1, dtype=np.uint64)
        np.cumsum(self.hash * up[:total], out=sums[1:])
        at = np.flatnonzero(self.doc[: total - n + 1] == self.doc[n - 1 :])
        return at, mix((sums[at + n] - sums[at]) * down[at] + np.uint64(n))

    def _whole(self, docs: np.ndarray) -> np.ndarray:
        """Hash of the whole word sequence of each of these documents."""
        up, down = _WORD_POWERS.upto(len(self.hash) + 1)
        sums = np.zeros(len(self.hash) + 1, dtype=np.uint64)
        np.cumsum(self.hash * up[: len(self.hash)], out=sums[1:])
        a, b = self.first[docs], self.first[docs + 1]
        return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))

    def shingle_sets(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes of runs of n words, sorted within each document: row starts (documents + 1), hashes.

        A document of 1 to n - 1 words has its whole sequence as one shingle.
        """
        at, found = self.windows(n)
        edges = np.searchsorted(self.doc[at], np.arange(self.documents + 1))
        short = np.flatnonzero((self.count > 0) & (self.count < n))
        alone = dict(zip(short.tolist(), self._whole(short), strict=True))
        sets, starts = [], [0]
        for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            if b > a:
                one = np.sort(found[a:b])
                if b - a > 1:
                    one = one[np.append(True, one[1:] != one[:-1])]
                sets.append(one)
                starts.append(starts[-1] + len(one))
            elif i in alone:
                sets.append(np.array([alone[i]], np.uint64))
                starts.append(starts[-1] + 1)
            else:
                starts.append(starts[-1])
        return np.array(starts, np.int64), np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def chunks(column: pa.Array, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for the rows of a string column, a few megabytes at a time."""
    raw, offsets = text_buffers(column)
    for a, b in slices(offsets, limit):
        yield a, b, Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1], lower)


def list_array(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and row starts."""
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values, kind))


def blobs(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary column: row i holds the bytes of values[starts[i]:starts[i + 1]]."""
    values = np.ascontiguousarray(values)
    offsets = (starts * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])
