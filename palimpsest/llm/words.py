"""Words of texts as hashed numpy arrays, for operators on shingles.

Words are the maximal runs of Unicode letters or digits (categories L and N), lower-cased.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_WORD = re.compile(r"[^\W_]+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def words(text: str) -> list[str]:
    """The words of a text, in order."""
    if "İ" in text:  # its lower case has a mark, which would split the word
        return [w.lower() for w in _WORD.findall(text)]
    return _WORD.findall(text.lower())


def small_batches(batch: pa.RecordBatch, column: int, chars: int = 4_000_000):
    """Slices of a batch holding about so many bytes of text each, at least a row."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    block = np.cumsum(lengths) // chars
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def word_hashes(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of all texts in a row, number of words of each text)."""
    flat: list[str] = []
    for t in texts:
        flat += t
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    if not flat:
        return np.zeros(0, np.uint64), counts
    coded = pa.array(flat, pa.string()).dictionary_encode()
    table = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    return table[coded.indices.to_numpy()], counts


class WordSet:
    """A set of words as sorted 64-bit hashes, 8 bytes a word, for a broadcast of known size."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes.astype(np.int64).view(np.uint64))

    def __contains__(self, word: str) -> bool:
        h = np.uint64(xxhash.xxh64_intdigest(word, seed=42))  # as the built-in xxhash64 has it
        i = self.hashes.searchsorted(h)
        return i < len(self.hashes) and self.hashes[i] == h


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit over all bits."""
    h = (h ^ (h >> np.uint64(33))) * _MIX[1]
    h = (h ^ (h >> np.uint64(29))) * _MIX[2]
    return h ^ (h >> np.uint64(32))


def shingle_hashes(h: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of `size` words within a text, number of them in each text)."""
    n = np.maximum(counts - size + 1, 0)
    if len(h) < size:
        return np.zeros(0, np.uint64), n
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = out * _MIX[0] + mix(h[k : len(h) - size + 1 + k] + np.uint64(k))
    ends = np.cumsum(counts)
    starts = ends - counts
    index = np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)
    return mix(out[index]), n
