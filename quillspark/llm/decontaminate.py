"""Benchmark decontamination: windows of each item's size are fingerprinted by SimHash, a multi-index over blocks of the
fingerprint yields every item within the radius, and exact weighted-shingle similarity decides.

A window is as many words as the item has; a text of fewer words is one window. Its shingles of `words` words carry
their number of occurrences as weights; the similarity of two multisets is the sum of the smaller over the sum of the
larger weights. At a similarity s of equally large windows at least 2s/(1+s) of a window's shingles occur in an item, so
only windows with that many are fingerprinted: no other can pass. The fingerprint's 8 blocks of 8 bits are looked up
in sorted tables of the items near each value (within radius // 8 bits), which by the pigeonhole principle miss nothing
within the radius.

Items go to the executors in blocks of at most ITEM_BYTES bytes; a larger benchmark takes several passes over documents.

Cases: null texts and items are empty and match nothing. Items of fewer than `words` words have one shingle, the whole
item. Equal items each get their rows. Repeated rows are kept. Empty tables give an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import words as W
from quillspark.llm.common import tidy

ITEM_BYTES = 8 << 20
#: Pairs of windows and items that a block table may give at once.
PAIRS = 1 << 20
#: With 64 bits and a similarity of 0.8 two fingerprints differ in about 10 bits, with a standard deviation of 3.
RADIUS = 22


class Items:
    """The items of one word count: their shingles, fingerprints and the block tables."""

    def __init__(self, ids: list, hashes: list[np.ndarray], words: int, shingle: int, radius: int):
        self.ids, self.words, self.shingle, self.radius = ids, words, shingle, radius
        self.count = len(hashes[0])
        self.weights = [dict(zip(*(x.tolist() for x in np.unique(h, return_counts=True)), strict=True)) for h in hashes]
        self.fp = W.majority(np.concatenate(hashes), np.arange(len(hashes) + 1) * self.count)
        self.tables = [self.table(k, radius // 8) for k in range(8)]

    def table(self, k: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Items sorted by the values that their block k is near to: the items of value v stand at begin[v] to begin[v + 1]."""
        values = np.arange(256, dtype=np.uint8)
        own = (self.fp >> np.uint64(8 * k)).astype(np.uint8)
        kinds, where = np.unique(own, return_inverse=True)
        near = np.bitwise_count(values[:, None] ^ kinds[None, :]) <= radius
        lists = [np.flatnonzero(near[v][where]) for v in range(256)]
        return np.concatenate([[0], np.cumsum([len(x) for x in lists])]), np.concatenate(lists).astype(np.int32)

    def candidates(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item) within the radius: what the block tables give, compared on the whole fingerprint."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        step = max(1, PAIRS // max(1, len(self.ids)))
        for low in range(0, len(fp), step):
            some, pairs = fp[low : low + step], []
            for k, (begin, items) in enumerate(self.tables):
                value = (some >> np.uint64(8 * k)).astype(np.uint8).astype(np.intp)
                n = begin[value + 1] - begin[value]
                window = np.repeat(np.arange(len(some)), n)
                item = items[np.repeat(begin[value], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                close = np.bitwise_count(some[window] ^ self.fp[item]) <= self.radius
                pairs.append(window[close] * len(self.ids) + item[close])
            found = np.unique(np.concatenate(pairs))
            out.append((found // len(self.ids) + low, found % len(self.ids)))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def similarity(self, window: np.ndarray, item: int) -> float:
        theirs, shared = self.weights[item], 0
        values, counts = np.unique(window, return_counts=True)
        for v, c in zip(values.tolist(), counts.tolist(), strict=True):
            shared += min(c, theirs.get(v, 0))
        return shared / (len(window) + self.count - shared)


class Index:
    """All items of a block, by size."""

    def __init__(self, items: list[tuple[object, str]], words: int, similarity: float, radius: int):
        self.similarity, self.words = similarity, words
        by_size: dict[int, list[tuple[object, np.ndarray]]] = defaultdict(list)
        b = W.split(pa.array([t or "" for _, t in items], pa.string()))
        start, end, first = W.shingles(b, words)
        h = W.xxh64(b.data, start, end)
        for k, n in enumerate(np.diff(b.first).tolist()):
            if n:
                by_size[n].append((items[k][0], h[first[k] : first[k + 1]]))
        self.sizes = [Items([i for i, _ in x], [y for _, y in x], n, min(words, n), radius) for n, x in sorted(by_size.items())]
        self.known: dict[int, np.ndarray] = {}
        for k in {s.shingle for s in self.sizes}:
            self.known[k] = np.unique(np.concatenate([np.array(list(w), dtype=np.uint64) for s in self.sizes if s.shingle == k for w in s.weights]))
        self.maybe = {}
        for k, known in self.known.items():
            self.maybe[k] = np.zeros(1 << 22, dtype=bool)
            self.maybe[k][(known & np.uint64((1 << 22) - 1)).astype(np.intp)] = True

    def search(self, b: W.Batch) -> list[tuple[int, object, float, int, int]]:
        """(text, item id, similarity, first word, words) of the best window of each text and item that reaches the similarity."""
        best: dict[tuple[int, int, int], tuple[float, int, int]] = {}
        for k, known in self.known.items():
            start, end, first = W.shingles(b, k)
            h = W.xxh64(b.data, start, end)
            hit = np.flatnonzero(self.maybe[k][(h & np.uint64((1 << 22) - 1)).astype(np.intp)])
            hit = hit[np.isin(h[hit], known)]
            if not len(hit):
                continue
            seen = np.zeros(len(h) + 1, dtype=np.int64)
            seen[hit + 1] = 1
            seen = np.cumsum(seen)
            doc = np.searchsorted(first, hit, side="right") - 1
            for g, size in enumerate(self.sizes):
                if size.shingle != k:
                    continue
                last = np.maximum(first[doc + 1] - size.count, first[doc])  # the last window of the text
                low = np.minimum(np.maximum(hit - size.count + 1, first[doc]), last)
                high = np.minimum(hit, last)
                spans = np.unique(np.stack([low, high, first[doc + 1]]), axis=1)
                n = spans[1] - spans[0] + 1
                at = np.repeat(spans[0], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                stop = np.minimum(at + size.count, np.repeat(spans[2], n))
                at, kept = np.unique(at, return_index=True)
                stop = stop[kept]
                total = stop - at + size.count
                enough = (seen[stop] - seen[at]) * (1 + self.similarity) >= self.similarity * total - 1e-9
                at, stop = at[enough], stop[enough]
                for part in range(0, len(at), 4096):  # bounds the windows' hashes held at once
                    a, s = at[part : part + 4096], stop[part : part + 4096]
                    edges = np.concatenate([[0], np.cumsum(s - a)])
                    inside = np.repeat(a, s - a) + np.arange(edges[-1]) - np.repeat(edges[:-1], s - a)
                    fp = W.majority(h[inside], edges)
                    for w, i in zip(*(x.tolist() for x in size.candidates(fp)), strict=True):
                        value = size.similarity(h[a[w] : s[w]], i)
                        if value >= self.similarity - 1e-12:
                            text = int(np.searchsorted(first, a[w], side="right") - 1)
                            key, begin = (text, g, i), int(a[w] - first[text])
                            if key not in best or (-value, begin) < (-best[key][0], best[key][1]):
                                best[key] = (value, begin, int(min(size.words, b.first[text + 1] - b.first[text])))
        return [(text, self.sizes[g].ids[i], *found) for (text, g, i), found in sorted(best.items())]


def item_blocks(benchmark: DataFrame, item_id: str, item_text: str, item_bytes: int) -> Iterator[list[tuple[object, str]]]:
    """The items, in blocks of about item_bytes bytes."""
    total = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    blocks = max(1, -(-int(total) // item_bytes))
    for k in range(blocks):
        own = benchmark.where(F.pmod(F.xxhash64(item_id, item_text), F.lit(blocks)) == k) if blocks > 1 else benchmark
        yield sorted(((r[0], r[1]) for r in own.select(item_id, item_text).where(f"`{item_text}` is not null").toLocalIterator()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """A row for each row of docs and item with a window that reaches the similarity: the ids, the best similarity, and where its (first) window lies in words."""
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, `{item_id}` {dict(benchmark.dtypes)[item_id]}, similarity double, first_word int, n_words int"
    found = None
    for items in item_blocks(benchmark, item_id, item_text, item_bytes):

        @tidy
        def run(batches: Iterator[pa.RecordBatch], items: list = items) -> Iterator[pa.RecordBatch]:
            index = Index(items, words, similarity, radius)
            for batch in batches:
                at = 0
                for part in W.chunks(batch.column(1)):
                    rows = index.search(W.split(part)) if index.sizes else []
                    ids = batch.column(0).slice(at, len(part))
                    at += len(part)
                    if rows:
                        cols = list(zip(*rows, strict=True))
                        kinds = [None, pa.float64(), pa.int32(), pa.int32()]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0]))] + [pa.array(c, type=t) for c, t in zip(cols[1:], kinds, strict=True)], names=[id_col, item_id, "similarity", "first_word", "n_words"])

        part = docs.select(id_col, text_col).mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = RADIUS, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Whole rows of docs in which no window reaches the similarity to an item."""
    at_text = docs.columns.index(text_col)
    for items in item_blocks(benchmark, item_id, item_text, item_bytes):

        @tidy
        def run(batches: Iterator[pa.RecordBatch], items: list = items) -> Iterator[pa.RecordBatch]:
            index = Index(items, words, similarity, radius)
            for batch in batches:
                at = 0
                for part in W.chunks(batch.column(at_text)):
                    hit = np.zeros(len(part), dtype=bool)
                    hit[[r[0] for r in index.search(W.split(part))] if index.sizes else []] = True
                    yield batch.slice(at, len(part)).filter(pa.array(~hit))
                    at += len(part)

        docs = docs.mapInArrow(run, docs.schema)
    return docs
