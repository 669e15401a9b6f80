"""Problem 8: encoding a whole corpus with a public byte-level BPE vocabulary.

Each Arrow batch is split into pre-tokens; the distinct pre-tokens not met before by this
worker are merged together in length-bucketed padded numpy matrices: in every round each
row merges its leftmost pair of minimum rank (found by a hashed pair table) and is
compacted. Pre-tokens of more than LONG bytes would move too much in each round; their
pairs lie in a heap by rank and place, which merges the same pairs in the same order. Texts are then put together from the cached pieces by one ragged gather.

Null and empty texts give an empty list. No special tokens: their strings are plain text.
"""

from __future__ import annotations

import base64
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import spread, table

VOCAB_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens a worker remembers; the cache is emptied beyond that.
CACHE_LIMIT = 400_000
#: Bytes of a pre-token from which on its pairs are kept in a heap.
LONG = 1024
#: The split pattern published with the vocabulary, for the regex module.
SPLIT_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: The same for the re module, on texts where isalnum() splits into L and Nd only.
_FAST = re.compile(
    r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
)
#: Characters outside of which the two patterns may differ (No, Nl, separators, marks, other scripts).
_ODD = re.compile(
    "[^\\x09-\\x0d\\x20-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-ɏΑ-ΡΣ-Ͽ"
    "Ѐ-ҁ‐-‧‰-⁞₠-₿™─-◿ﬀ-ﬆ�]"
)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, in order; together they are the text."""
    if _ODD.search(text) is None:
        return _FAST.findall(text)
    import regex

    return regex.findall(SPLIT_PATTERN, text)


class PairTable:
    """Open-addressing hash table from (left id, right id) to the rank of their union."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, rank = [], [], []
        for tok, r in ranks.items():
            for i in range(1, len(tok)):
                a, b = ranks.get(tok[:i]), ranks.get(tok[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        key = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.bits = max(4, int(len(key) * 4).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, np.iinfo(np.uint64).max, np.uint64)
        self.vals = np.zeros(size, np.int32)
        self.none = np.iinfo(np.int32).max
        todo, step = np.arange(len(key)), 0
        home = (key * _MULT) >> np.uint64(64 - self.bits)
        while len(todo):
            at = (home[todo] + np.uint64(step)) & np.uint64(size - 1)
            free = self.keys[at] == np.iinfo(np.uint64).max
            # of several keys wanting one slot, the first takes it
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[at[put]] = key[todo[put]]
            self.vals[at[put]] = np.array(rank, np.int32)[todo[put]]
            todo = np.delete(todo, put)
            step += 1
        self.probes = step

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a value above all ranks."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        flat = key.ravel()
        home = (flat * _MULT) >> np.uint64(64 - self.bits)
        out = np.full(len(flat), self.none, np.int32)
        todo = np.arange(len(flat))
        empty = np.iinfo(np.uint64).max
        for step in range(self.probes):
            at = (home[todo] + np.uint64(step)) & np.uint64(len(self.keys) - 1)
            found = self.keys[at]
            hit = found == flat[todo]
            out[todo[hit]] = self.vals[at[hit]]
            todo = todo[~hit & (found != empty)]
            if not len(todo):
                break
        return out.reshape(key.shape)


class Encoder:
    """Encodes batches of texts; holds the pair table and the pieces met so far."""

    def __init__(self, vocab: bytes):
        self.ranks = {
            base64.b64decode(a): int(b) for a, b in (x.split() for x in vocab.splitlines() if x.strip())
        }
        self.pairs = PairTable(self.ranks)
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.whole = {}
        for tok, r in self.ranks.items():
            try:
                self.whole[tok.decode()] = r
            except UnicodeDecodeError:
                pass
        self.cache: dict[str, np.ndarray] = {}

    def _merge(self, raw: list[bytes]) -> list[np.ndarray]:
        """Ids of each byte string, by rounds over padded matrices of similar lengths."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(raw)
        by: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            if len(b) > LONG:
                out[i] = self._long(b)
            else:
                by.setdefault((len(b) - 1).bit_length(), []).append(i)
        for bucket, rows in by.items():
            # at most about a million cells in a matrix, whatever the lengths
            step = max(1, (1 << 20) >> bucket)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self._matrix([raw[i] for i in part]), strict=True):
                    out[i] = ids
        return out

    def _long(self, raw: bytes) -> np.ndarray:
        """Ids of one long byte string: its pairs from a heap, least rank first, then leftmost."""
        n, ranks, none = len(raw), self.ranks, self.pairs.none
        ids = self.byte_id[np.frombuffer(raw, np.uint8)]
        first = self.pairs.rank_of(ids[:-1], ids[1:])
        heap = [(r, i) for i, r in enumerate(first.tolist()) if r != none]
        heapify(heap)
        rank = [*first.tolist(), none]  # of the pair that begins at a place; none where no token begins
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        token = ids.tolist()
        while heap:
            r, i = heappop(heap)
            if rank[i] != r:
                continue
            token[i], gone = r, after[i]
            rank[gone], after[i] = none, after[gone]
            end = after[i]
            if end < n:
                before[end] = i
                rank[i] = ranks.get(raw[i : after[end]], none)
                if rank[i] != none:
                    heappush(heap, (rank[i], i))
            else:
                rank[i] = none
            p = before[i]
            if p >= 0:
                rank[p] = ranks.get(raw[p:end], none)
                if rank[p] != none:
                    heappush(heap, (rank[p], p))
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = after[i]
        return np.array(out, np.int32)

    def _matrix(self, raw: list[bytes]) -> list[np.ndarray]:
        n, width = len(raw), max(map(len, raw))
        size = np.array([len(b) for b in raw])
        m = np.zeros((n, width), np.int32)
        inside = np.arange(width) < size[:, None]
        m[inside] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        if width == 1:
            return [m[i, :1] for i in range(n)]
        none = self.pairs.none
        rank = self.pairs.rank_of(m[:, :-1], m[:, 1:])
        rank[np.arange(width - 1) >= (size - 1)[:, None]] = none
        live = np.arange(n)
        done: list[np.ndarray | None] = [None] * n
        while len(live):
            at = rank.argmin(1)
            row = np.arange(len(live))
            best = rank[row, at]
            stop = best == none
            if stop.any():
                for i in np.flatnonzero(stop):
                    done[live[i]] = m[i, : size[i]].copy()
                keep = ~stop
                live, m, rank, size, at, best = live[keep], m[keep], rank[keep], size[keep], at[keep], best[keep]
                if not len(live):
                    break
                row = np.arange(len(live))
            # the merged id takes the left cell, all to its right move one cell left
            m[row, at] = best
            cols = np.arange(m.shape[1] - 1)
            src = cols + (cols > at[:, None])
            m = np.take_along_axis(m, src, 1)
            size = size - 1
            cols = np.arange(m.shape[1] - 1)
            if len(cols) == 0:
                for i in range(len(live)):
                    done[live[i]] = m[i, : size[i]].copy()
                break
            rank = np.take_along_axis(rank, cols + (cols >= at[:, None] + 0) * 1, 1)
            # only the pairs beside the merged cell are new
            for shift in (-1, 0):
                p = at + shift
                ok = (p >= 0) & (p + 1 < size)
                bad = (p >= 0) & (p < len(cols)) & ~ok
                rank[row[bad], p[bad]] = none
                r, c = row[ok], p[ok]
                rank[r, c] = self.pairs.rank_of(m[r, c], m[r, c + 1])
        return done  # type: ignore[return-value]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each text)."""
        pieces: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                p = pretokens(t)
                pieces += p
                counts[i] = len(p)
        if not pieces:
            return np.zeros(0, np.int32), counts
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        cache, whole = self.cache, self.whole
        if len(cache) > CACHE_LIMIT:
            cache.clear()
        fresh = []
        for w in words:
            if w not in cache:
                r = whole.get(w)
                if r is None:
                    fresh.append(w)
                else:
                    cache[w] = np.array([r], np.int32)
        if fresh:
            cache.update(zip(fresh, self._merge([w.encode() for w in fresh]), strict=True))
        ids = [cache[w] for w in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        start = np.cumsum(size) - size
        flat = np.concatenate(ids)
        use = coded.indices.to_numpy()
        n = size[use]
        ends = np.cumsum(n)
        index = np.arange(ends[-1]) + np.repeat(start[use] - (ends - n), n)
        per_text = np.zeros(len(texts), np.int64)
        total = np.concatenate([[0], ends])
        stop = np.cumsum(counts)
        per_text = total[stop] - total[stop - counts]
        return flat[index], per_text


def small_batches(batch: pa.RecordBatch, column: str, chars: int = 4_000_000):
    """Slices of a batch holding about so many bytes of text each, at least a row."""
    col = batch.column(column)
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0))
    block = np.cumsum(lengths) // chars
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _vocab(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast value: under a megabyte, of fixed size."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(vocab: bytes) -> Encoder:
    """One encoder a worker and vocabulary; the cache lives on between tasks."""
    key = hash(vocab)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocab)
    return _ENCODERS[key]


def encode_column(df: DataFrame, key: str, text: str = "text", vocab_path: str = VOCAB_PATH) -> DataFrame:
    """(key, ids ARRAY<INT>): one row for each row of df; other columns are left out.

    Null, empty: empty list. Rows repeat as in df; a null key stays null.
    """
    vocab = _vocab(df.sparkSession, vocab_path)

    def run(batches):
        enc = encoder_of(vocab.value)
        for whole in batches:
            for b in small_batches(whole, "t"):
                flat, n = enc.encode(b.column("t").to_pylist())
                off = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column("k"), pa.ListArray.from_arrays(off, pa.array(flat, pa.int32()))], ["k", "ids"]
                )

    src = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return src.mapInArrow(run, "k long, ids array<int>").select(F.col("k").alias(key), "ids")


def token_counts(df: DataFrame, key: str, text: str = "text", vocab_path: str = VOCAB_PATH) -> DataFrame:
    """(key, n_tokens LONG) of each row of df, by the same encoder; null and empty: 0."""
    vocab = _vocab(df.sparkSession, vocab_path)

    def run(batches):
        enc = encoder_of(vocab.value)
        for whole in batches:
            for b in small_batches(whole, "t"):
                _, n = enc.encode(b.column("t").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(n, pa.int64())], ["k", "n_tokens"])

    src = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return src.mapInArrow(run, "k long, n_tokens long").select(F.col("k").alias(key), "n_tokens")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ids of every document by byte_bpe_50k."""
    return encode_column(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id")


QUERIES = {"p8_ids": p8_ids}
ORACLE: dict[str, str] = {}
