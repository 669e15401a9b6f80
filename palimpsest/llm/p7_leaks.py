"""Problem 7: held-out items that occur, in whole or in part, in the texts of a corpus.

Items and texts are cut into windows of `width` words (whole items where they are shorter);
where edited windows are asked for, whole items are windows too, whatever their length.
A window's SimHash is the sign of the summed bits of its words and word pairs. The items'
fingerprints lie in a multi-index of BLOCKS blocks: two fingerprints within RADIUS bits
(fewer than BLOCKS) agree in a block, and two within NEAR_RADIUS differ in some block by a
BLOCKS-th of that at most, so each item window stands under all such values of its blocks
and looking up each block finds all of them. All candidates are verified exactly by the
weighted similarity of their shingles (words and word pairs, weighted by rarity among the
items); similarity 1 with equal word order, which is checked last, is a leak in the problem's
sense.

The weight of words and word pairs that no item has bounds the similarity a window can
reach; windows with too much of it get no fingerprint. The query set is fixed: it is broadcast
in blocks of ITEM_BLOCK windows, SCAN_BLOCKS of which share a scan of the texts; more items
take further scans. A worker builds the index of a block once.

Null and empty items and texts leak nothing. An item repeated under another id leaks by both.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from functools import reduce
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import spread, table
from .words import mix, small_batches, word_hashes, words

WIDTH = 8
#: A fingerprint's blocks of 16 bits, and the Hamming radius they guarantee.
BLOCKS, RADIUS = 4, 3
#: The radius for edited windows: of item windows with a word replaced by a common one and a
#: similarity of 0.8 or more, 444 of 446 of eight words and 21,446 of 21,446 whole items lie within it.
NEAR_RADIUS = 19
#: Item windows that are broadcast at a time (about 200 bytes each), and where edited windows
#: are asked for (about 40 KB each, in the multi-index).
ITEM_BLOCK, NEAR_BLOCK = 50_000, 5_000
#: Blocks that share a scan of the texts; with edited windows each has a scan of its own.
SCAN_BLOCKS = 8
#: So few item windows of a width are compared with every text window instead of looked up.
FEW = 128


def _pair_hashes(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + mix(h[1:]))


def _window_prints(h: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """SimHash of the windows of `width` word hashes that begin at the places `at`."""
    out = np.zeros(len(at), np.uint64)
    for k in range(0, len(at), 100_000):
        w = h[at[k : k + 100_000, None] + np.arange(width)]
        feats = mix(w)
        if width > 1:
            pair = mix(w[:, :-1] * np.uint64(0x9E3779B97F4A7C15) + mix(w[:, 1:]))
            feats = np.concatenate([feats, pair], axis=1)
        n = feats.shape[1]
        bits = np.unpackbits(np.ascontiguousarray(feats).view(np.uint8).reshape(len(w), n, 8), axis=2, bitorder="little")
        ones = bits.sum(1, dtype=np.uint8)
        out[k : k + len(w)] = np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


class ItemIndex:
    """The windows of a bounded set of items, by width, with their multi-index."""

    def __init__(self, items: list[tuple[int, list[str]]], width: int, least: float = 1.0):
        by: dict[int, list[tuple[int, list[str]]]] = defaultdict(list)
        for id_, w in items:
            k = min(width, len(w))
            for s in range(len(w) - k + 1):
                by[k].append((id_, w[s : s + k]))
            if least < 1 and len(w) > width:
                by[len(w)].append((id_, w))
        self.radius = RADIUS if least >= 1 else NEAR_RADIUS
        df = Counter(x for _, w in items for x in {*w, *zip(w, w[1:], strict=False)})
        self.weight = {x: math.log(1 + len(items) / n) for x, n in df.items()}
        self.top = max(self.weight.values(), default=1.0)
        self.vocab, self.word_weight = self._by_hash([x for x in self.weight if isinstance(x, str)])
        self.pairs, self.pair_weight = self._by_hash([x for x in self.weight if isinstance(x, tuple)])
        self.widths, self.windows, self.word_weights = {}, {}, {}
        masks = np.array([m for m in range(1 << 16) if m.bit_count() <= self.radius // BLOCKS], np.uint16)
        for k, windows in by.items():
            h, _ = word_hashes([w for _, w in windows])
            prints = _window_prints(h, np.arange(len(windows)) * k, k)
            index = []
            for b in range(BLOCKS) if least >= 1 or len(windows) > FEW else ():
                part = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint16)
                part = (part[:, None] ^ masks).ravel()
                order = np.argsort(part, kind="stable")
                start = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=65536))])
                index.append(((order // len(masks)).astype(np.int32), start))
            self.widths[k] = (np.array([i for i, _ in windows]), h.reshape(-1, k), prints, index)
            self.windows[k] = [w for _, w in windows]
            one = np.array([[self.weight[x] for x in w] for _, w in windows])
            two = np.array([[self.weight[x] for x in zip(w, w[1:], strict=False)] for _, w in windows]).reshape(len(windows), k - 1)
            self.word_weights[k] = (one, two)

    def _by_hash(self, shingles: list) -> tuple[np.ndarray, np.ndarray]:
        """(hashes in order, their weights) of words or word pairs."""
        h, _ = word_hashes([[x] if isinstance(x, str) else [*x] for x in shingles])
        h = _pair_hashes(h)[::2] if shingles and isinstance(shingles[0], tuple) else h
        order = np.argsort(h)
        return h[order], np.array([self.weight[x] for x in shingles])[order]

    def reach(self, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Running weights of word hashes: known words, all words, known pairs, all pairs."""
        out = []
        for x, vocab, weight in ((h, self.vocab, self.word_weight), (_pair_hashes(h), self.pairs, self.pair_weight)):
            if not len(vocab):
                known, w = np.zeros(len(x), bool), 0.0
            else:
                at = np.minimum(np.searchsorted(vocab, x), len(vocab) - 1)
                known, w = vocab[at] == x, weight[at]
            for part in (np.where(known, w, 0.0), np.where(known, w, self.top)):
                out.append(np.concatenate([[0.0], np.cumsum(part)]))
        return tuple(out)

    def near(self, prints: np.ndarray, k: int):
        """(text windows, item windows) within the radius, each pair once, in parts."""
        _, _, own, index = self.widths[k]
        for low in range(0, len(prints), 2_000):
            own_part = prints[low : low + 2_000]
            if not index:
                x, y = np.nonzero(np.bitwise_count(own_part[:, None] ^ own) <= self.radius)
                yield x + low, y
                continue
            left, right = [], []
            for b, (order, start) in enumerate(index):
                part = ((own_part >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
                n = start[part + 1] - start[part]
                x = np.repeat(np.arange(len(own_part)), n)
                y = order[np.arange(n.sum()) + np.repeat(start[part] - (np.cumsum(n) - n), n)]
                close = np.bitwise_count(own_part[x] ^ own[y]) <= self.radius
                left.append(x[close])
                right.append(y[close])
            x, y = np.concatenate(left), np.concatenate(right)
            one = np.unique(x.astype(np.int64) * len(own) + y)
            yield one // len(own) + low, one % len(own)

    def may_reach(self, text_words: np.ndarray, y: np.ndarray, k: int, least: float) -> np.ndarray:
        """Which pairs can be similar enough, by the weight of item words that the text lacks."""
        _, item_words, _, _ = self.widths[k]
        one, two = (w[y] for w in self.word_weights[k])
        out = np.zeros(len(y), bool)
        for low in range(0, len(y), 20_000):
            at = slice(low, low + 20_000)
            miss = ~(item_words[y[at], :, None] == text_words[at, None, :]).any(2)
            lost = (one[at] * miss).sum(1) + (two[at] * (miss[:, 1:] | miss[:, :-1])).sum(1)
            whole = one[at].sum(1) + two[at].sum(1)
            out[at] = whole - lost >= least * whole - 1e-9
        return out


def similarity(a: tuple, b: tuple, weight: dict) -> float:
    """Weighted Jaccard of the words and word pairs of two windows."""
    x, y = Counter([*a, *zip(a, a[1:], strict=False)]), Counter([*b, *zip(b, b[1:], strict=False)])
    top = max(weight.values(), default=1.0)
    w = lambda s: weight.get(s, top)
    both = sum(w(s) * min(x[s], y[s]) for s in x.keys() & y.keys())
    return both / sum(w(s) * max(x[s], y[s]) for s in x.keys() | y.keys())


def leaks(
    docs: DataFrame, key: str, items: DataFrame, item_key: str, text: str = "text", query: str = "query",
    width: int = WIDTH, least: float = 1.0,
) -> DataFrame:
    """(key, item_key, similarity): the texts that hold a window of an item.

    least = 1 asks for the same words in the same order; lower values also give edited
    windows of at least that weighted similarity within the Hamming radius.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item_key).cast("long").alias("i"), F.col(query).alias("q")).filter("q is not null")
    rows = sorted((r.i, words(r.q)) for r in rows.toLocalIterator())
    blocks: list[list] = [[]]
    room = block = ITEM_BLOCK if least >= 1 else NEAR_BLOCK
    for i, w in rows:
        if not w:
            continue
        if room < len(w) and blocks[-1]:
            blocks.append([])
            room = block
        blocks[-1].append((i, w))
        room -= len(w)
    src = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).filter("t is not null")
    some = SCAN_BLOCKS if least >= 1 else 1
    parts = [_search(spark, src, blocks[k : k + some], width, least) for k in range(0, len(blocks), some)]
    return reduce(DataFrame.unionByName, parts).select(
        F.col("k").alias(key), F.col("i").alias(item_key), "similarity"
    )


_BUILT: dict[str, ItemIndex] = {}


def _index(name: str, items, width: int, least: float) -> ItemIndex:
    """The index of a broadcast block of items, built once a worker."""
    if name not in _BUILT:
        if len(_BUILT) >= (SCAN_BLOCKS if least >= 1 else 1):
            _BUILT.clear()
        _BUILT[name] = ItemIndex(items.value, width, least)
    return _BUILT[name]


def _search(spark: SparkSession, src: DataFrame, blocks: list[list], width: int, least: float) -> DataFrame:
    shared = [(uuid4().hex, spark.sparkContext.broadcast(b)) for b in blocks]

    def run(batches):
        for whole in batches:
            for b in small_batches(whole, 1, 2_000_000):
                keys = np.asarray(b.column(0))
                ws = [words(t) for t in b.column(1).to_pylist()]
                h, counts = word_hashes(ws)
                found: dict[tuple[int, int], float] = {}
                for name, items in shared if len(h) else ():
                    _find(_index(name, items, width, least), ws, h, counts, least, found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[[d for d, _ in found]] if found else [], pa.int64()),
                        pa.array([i for _, i in found], pa.int64()),
                        pa.array(list(found.values()), pa.float64()),
                    ],
                    ["k", "i", "similarity"],
                )

    return src.mapInArrow(run, "k long, i long, similarity double")


def _find(index: ItemIndex, ws: list, h: np.ndarray, counts: np.ndarray, least: float, found: dict) -> None:
    """Enter (text, item) -> the best similarity of their windows into `found`."""
    if not len(index.vocab):
        return
    at = np.minimum(np.searchsorted(index.vocab, h), len(index.vocab) - 1)
    known = np.concatenate([[0], np.cumsum(index.vocab[at] == h)])
    reach = index.reach(h) if least < 1 else ()
    doc = np.repeat(np.arange(len(ws)), counts)
    ends = np.cumsum(counts)
    for k, (ids, item_words, _, _) in index.widths.items():
        if len(h) < k:
            continue
        s = np.arange(len(h) - k + 1)
        ok = s + k <= ends[doc[s]]
        if least >= 1:
            ok &= known[s + k] - known[s] >= k
        else:
            kw, aw, kp, ap = reach
            some = kw[s + k] - kw[s] + kp[s + k - 1] - kp[s]
            ok &= some >= least * (aw[s + k] - aw[s] + ap[s + k - 1] - ap[s]) - 1e-6
        s = s[ok]
        for x, y in index.near(_window_prints(h, s, k), k):
            text_words = h[s[x, None] + np.arange(k)]
            same = (text_words == item_words[y]).all(1)
            close = index.may_reach(text_words, y, k, least)
            for a, c, order in zip(s[x[close]].tolist(), y[close].tolist(), same[close].tolist(), strict=True):
                d, i = int(doc[a]), int(ids[c])
                if found.get((d, i)) == 1.0:
                    continue
                begin = int(ends[d] - counts[d])
                v = similarity(tuple(ws[d][a - begin : a - begin + k]), tuple(index.windows[k][c]), index.weight)
                if v >= least - 1e-9 and (order or least < 1) and v > found.get((d, i), 0):
                    found[(d, i)] = 1.0 if order else v


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """rec_id, item_id, similarity of every text with a window like an item's (0.8 or more)."""
    return leaks(spread(table(spark, folder, "docvalue").select("rec_id", "text")), "rec_id", table(spark, folder, "copa"), "item_id", least=0.8)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """rec_id, item_id: the text has eight words in a row of the item's query."""
    out = leaks(spread(table(spark, folder, "docvalue").select("rec_id", "text")), "rec_id", table(spark, folder, "copa"), "item_id")
    return out.select("rec_id", "item_id")


QUERIES = {"p7_found": p7_found, "p7_leaks": p7_leaks}
ORACLE = {
    "p7_found": r"""
with w as (select item_id, regexp_extract_all(lower(query), '[\p{L}\p{N}]+') as w from copa where query is not null),
s as (select item_id, least(8, len(w)) as k, w[i:i + 7] as s from (select item_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) as i from w where len(w) > 0)),
l as (select distinct k from s),
d as (select rec_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from docvalue where text is not null),
t as (select rec_id, k, w[i:i + k - 1] as s from (select rec_id, k, w, unnest(range(1, len(w) - k + 2)) as i from d, l where len(w) >= k))
select distinct rec_id, item_id from t join s using (k, s)"""
}
