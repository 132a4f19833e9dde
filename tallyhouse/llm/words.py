"""Words of many texts at once: byte ranges, exact numbers for equal words, and strong 64-bit hashes.

A word is a maximal run of bytes other than space and ``\\x09-\\x0D``.  Words are numbered through a
dictionary of the batch, so two words have one number if and only if they are equal; hashes are keyed
SipHash values of the dictionary's entries, for which no texts are known that collide on purpose.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: SipHash keys have 16 letters; a second key gives an independent hash.
HASH_KEYS = ("tally-words-no-1", "tally-words-no-2")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lowered(raw: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return _LOWER[raw]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes, ends and text numbers of the words of texts that lie behind one another in ``raw``."""
    letters = np.zeros(len(raw) + 1, np.int8)
    letters[:-1] = ~_SPACE[raw]
    # a text's first byte never continues the word that the text before ends with
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    begins = letters[:-1].astype(bool)
    begins[1:] &= (letters[:-2] == 0) | first[1:-1]
    ends = letters[:-1].astype(bool)
    ends &= (letters[1:] == 0) | first[1:]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, side="right") - 1


def word_numbers(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, equal for equal words, and the different words in the order of their numbers."""
    if not len(start):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    # words and the gaps between them are neighbouring values of one array; every second one is a word
    edges = np.empty(2 * len(start), np.int64)
    edges[0::2], edges[1::2] = start, end
    spans = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(raw))])
    coded = spans.take(pa.array(np.arange(0, len(edges) - 1, 2))).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def word_hashes(dictionary: pa.Array, key: str = HASH_KEYS[0]) -> np.ndarray:
    """A keyed 64-bit hash of each entry."""
    return pd.util.hash_array(np.array(dictionary.to_pylist() + [b""], dtype=object), hash_key=key, categorize=False)[:-1]


#: Words of more bytes are hashed one by one.
_LONG_WORD = 1024
_KEYS = np.array([0x8F1BBCDC6ED9EBA1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)


def quick_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time; each step is mixed, so the hash is not linear in the bytes."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eights = np.ndarray((len(raw) + 1,), np.dtype("<u8"), padded, strides=(1,))  # the eight bytes from each place
    size = end - start
    out = mix(size.astype(np.uint64) * _KEYS[1] + _KEYS[0])
    at = np.flatnonzero(size <= _LONG_WORD)
    done = 0
    while len(at):
        left = np.minimum(size[at] - done, 8).astype(np.uint64)
        part = eights[start[at] + done] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * left))
        out[at] = mix(out[at] * _KEYS[1] + mix(part ^ _KEYS[2]))
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > _LONG_WORD):
        out[i] = int.from_bytes(blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def sequence_hashes(hashes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each place in ``at``; mixed word by word, so it is not linear in the words."""
    out = np.full(len(at), length, np.uint64)
    for k in range(length):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k])
    return out


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes of runs of ``words`` words, sorted within each text: where each text's begin (texts + 1), hashes.

    A text of 1 to ``words`` - 1 words has its whole sequence as one shingle.
    """
    start, end, text = word_spans(raw, offsets)
    numbers, dictionary = word_numbers(raw, start, end)
    hashes = word_hashes(dictionary)[numbers]
    texts = len(offsets) - 1
    first = np.searchsorted(text, np.arange(texts + 1))
    count = np.diff(first)
    at = np.flatnonzero(text[: max(0, len(text) - words + 1)] == text[words - 1 :])
    found, owner = [sequence_hashes(hashes, at, words)], [text[at]]
    for few in range(1, words):
        short = np.flatnonzero(count == few)
        found.append(sequence_hashes(hashes, first[short], few))
        owner.append(short)
    one, of = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((one, of))
    one, of = one[order], of[order]
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (of[1:] != of[:-1])
    return np.searchsorted(of[new], np.arange(texts + 1)), one[new]
