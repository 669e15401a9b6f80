"""Words of texts looked up in tables, in Arrow batches.

A table of words is broadcast as sorted 64-bit hashes with its values, 8 bytes each, if it has
at most WORD_LIMIT rows; the callers join larger tables instead. Words are hashed as the
built-in xxhash64 does, so tables are hashed in the JVM and words in Python.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a word table that are broadcast; with three values that is 64 MB.
WORD_LIMIT = 2_000_000
_TOKEN = re.compile(r"[a-z]+(?:'[a-z]+)*")


def detector_words(text: str) -> list[str]:
    """Lower-case words of a-z with inner apostrophes, as functions.text.word_tokens has them."""
    return _TOKEN.findall(text.lower().replace("’", "'").replace("‘", "'"))


def slices(batch: pa.RecordBatch, column: int, size: int = 4_000_000):
    """Slices of a batch of about so many bytes of text each, at least a row."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    block = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def flat_words(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, place of every word of all texts in them, number of words of each text)."""
    lists = [detector_words(t) if t else [] for t in texts]
    flat = [w for x in lists for w in x]
    coded = pa.array(flat, pa.string()).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), np.fromiter(map(len, lists), np.int64, len(lists))


class WordTable:
    """Sorted hashes of words with one array of values for each column."""

    def __init__(self, hashes: np.ndarray, values: list[np.ndarray]):
        h = hashes.view(np.uint64)
        order = np.argsort(h)
        self.hashes, self.values = h[order], [v[order] for v in values]

    def places(self, words: list[str]) -> np.ndarray:
        """The place of each word in the table; -1 for words it lacks."""
        h = np.fromiter((xxhash.xxh64_intdigest(w, seed=42) for w in words), np.uint64, len(words))
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


def word_table(table: DataFrame, word: str, *values: str) -> WordTable | None:
    """The table (one row a word) for a broadcast; None if it has more than WORD_LIMIT rows."""
    cols = [F.xxhash64(F.col(word)).alias("h"), *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)]]
    t = table.filter(F.col(word).isNotNull()).select(*cols).limit(WORD_LIMIT + 1).toArrow()
    if t.num_rows > WORD_LIMIT:
        return None
    return WordTable(t.column(0).to_numpy(), [t.column(i + 1).to_numpy() for i in range(len(values))])


def sums_by_text(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of x over the words of each text."""
    total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0, dtype=np.float64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
