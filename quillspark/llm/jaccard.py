"""Pairs of texts by the exact Jaccard similarity of their sets of shingles, by prefix filtering.

The shingles of every text are put in one order for all texts, the rare ones first. Two sets of a similarity s or more
share a shingle among the first n - ceil(s n) + 1 of each (n: the set's size), so sets meet under these shingles only.
At the first shingle that two sets share, their sizes and its places bound what else they can share, and a bitmap of each
set bounds in how many shingles they differ at least; pairs within the bounds are verified on whole sets. Which shingles
are common is read off about ORDER_SAMPLE texts; any order gives the same pairs, so the sample sets the cost, never the
result. Near copies share one shingle of their prefixes after the other; a pair whose shingles before are the same has met
there and is passed over. A group with more possible pairs than sets goes on as its sets, whose pairs the bitmaps judge in
other tasks, so no more rows than sets leave a group. A large one goes through its task as a stream and is compared block by
block; two blocks of one root, or of sizes too far apart, don't meet. Pairs are verified where they met, so that a set is
sent once for each shingle and block, not once for each pair.

Cases: texts without words have the empty set, and equal sets are one node. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import words as W
from quillspark.llm.common import drop_materialized, materialize, tidy

ORDER_SAMPLE, COMMON = 8192, 1 << 18
#: Pairs of a group that are compared at once.
SQUARE = 1 << 20
#: Bits of the map of wanted sets.
SLOTS = 1 << 24
#: Words of 64 bits of a set's bitmap.
PARITY = 16
#: A group of more sets than this under one shingle is split into blocks, and the blocks' pairs are dealt out.
BLOCK = 2048


def least_shared(similarity: float, sizes: np.ndarray) -> np.ndarray:
    """How many shingles sets of these sizes together share at least, to be so similar."""
    return np.ceil(similarity * sizes / (1 + similarity) - 1e-9)


def sets(b: W.Batch, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's shingles, in ascending order, and where each text's begin (with their number at last)."""
    start, end, first = W.shingles(b, shingle)
    h, doc = W.xxh64(b.data, start, end), np.repeat(np.arange(b.docs), np.diff(first))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(b.docs + 1))


def nodes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(h), dtype=np.uint64)])
    return W.mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def parities(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bitmaps of the sets: each bit tells whether an odd number of shingles falls on it. Two bitmaps differ in at most as many bits as the sets differ in shingles."""
    out = np.zeros((len(first) - 1, PARITY), dtype=np.uint64)
    at = W.mix(h ^ np.uint64(0x5851F42D4C957F2D))
    np.bitwise_xor.at(out, (np.repeat(np.arange(len(first) - 1), np.diff(first)), (at >> np.uint64(6) & np.uint64(PARITY - 1)).astype(np.intp)), np.uint64(1) << (at & np.uint64(63)))
    return out


def bitmaps(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A row of words for each bitmap."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, PARITY)


def within(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these bitmaps, and of these sizes together, can be so similar."""
    return np.bitwise_count(x ^ y).sum(axis=1) <= sizes - 2 * least_shared(similarity, sizes)


def close(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose bitmaps allow the similarity, with their other columns. known: node, size and parity of the sets."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    kinds = dict(pairs.dtypes)

    @tidy
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            x, y = (bitmaps(batch.column(c)) for c in (4, 5))
            hit = within(x, y, size, similarity)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *batch.columns[6:]], names=["a", "b", *rest]).filter(pa.array(hit))

    one = known.select("node", "size", "parity")
    both = pairs.join(one.toDF("a", "n", "__x"), "a").join(one.toDF("b", "m", "__y"), "b").select("a", "b", "n", "m", "__x", "__y", *rest)
    return both.mapInArrow(check, ", ".join(f"{c} {kinds[c]}" for c in ["a", "b", *rest]))


def common(docs: DataFrame, shingle: int, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Shingles (hashes, ascending) that several texts of a sample have, and how many have each."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(sets(W.split(part), shingle)[0].view(np.int64))], names=["h"])

    some = docs.select(text_col).where(F.pmod(F.xxhash64(text_col), F.lit(max(1, docs.count() // ORDER_SAMPLE))) == 0)
    rows = some.mapInArrow(run, "h long").groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(COMMON).collect()
    h, count = np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64), np.array([r[1] for r in rows], dtype=np.uint64)
    order = np.argsort(h)
    return h[order], count[order]


def prefixes(h: np.ndarray, first: np.ndarray, known: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each set's prefix, in order, and where each set's begin. A key is how common the shingle is, then its hash."""
    key, size = W.mix(h) >> np.uint64(16), np.diff(first)
    if len(known[0]):
        at = np.minimum(np.searchsorted(known[0], h), len(known[0]) - 1)
        key |= np.where(known[0][at] == h, np.minimum(known[1][at], np.uint64(0x7FFF)), np.uint64(0)) << np.uint64(48)
    doc = np.repeat(np.arange(len(size)), size)
    key = key[np.lexsort((key, doc))]
    long = np.where(size > 0, size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1, 0)
    return key[np.arange(len(key)) - first[doc] < long[doc]], np.concatenate([[0], np.cumsum(long)])


def verified(pairs: DataFrame, docs: DataFrame, shingle: int, similarity: float, text_col: str = "text") -> DataFrame:
    """The pairs a, b (nodes of docs) whose sets have the similarity. A column cell says which pairs are verified together: a set is sent once for each cell. Without it each pair is one."""

    @tidy
    def all_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch.column(0)):
                h, first = sets(W.split(part), shingle)
                node = nodes(h, first)
                slot = node & (SLOTS - 1)
                at = np.flatnonzero(marks[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1))
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array([h[first[k] : first[k + 1]].tobytes() for k in at], pa.binary())], names=["node", "shingles"])

    @tidy
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell, in each the sets (b is null) before the pairs."""
        cell, held = None, {}
        for batch in batches:
            a, b, hit = *(batch.column(c).to_pylist() for c in (1, 2)), np.zeros(batch.num_rows, dtype=bool)
            for k, own in enumerate(batch.column(0).to_pylist()):
                if own != cell:
                    cell, held = own, {}
                if b[k] is None:
                    held[a[k]] = np.frombuffer(batch.column(3)[k].as_py(), np.uint64)
                    continue
                x, y = held[a[k]], held[b[k]]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                hit[k] = shared + 1e-9 >= similarity * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2)], names=["a", "b"]).filter(pa.array(hit))

    cell = F.col("cell") if "cell" in pairs.columns else F.xxhash64(F.least("a", "b"), F.greatest("a", "b"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), cell.alias("cell")).where("a <> b")
    pairs = materialize(pairs.groupBy("a", "b").agg(F.min("cell").alias("cell")), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # a bitmap keeps most sets that no pair needs out of the shuffle; the join drops the rest
    slot = F.col("node").bitwiseAND(F.lit(SLOTS - 1))
    marks = np.zeros(SLOTS // 64, np.uint64)
    for r in wanted.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(node & 63 as int))")).alias("bits")).collect():
        marks[r["at"]] = r["bits"] & 0xFFFFFFFFFFFFFFFF
    whole = docs.select(text_col).mapInArrow(all_sets, "node long, shingles binary").join(wanted, "node", "left_semi")
    whole = materialize(whole.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    members = pairs.select("cell", F.explode(F.array("a", "b")).alias("node")).distinct().join(whole, "node")
    dealt = members.select("cell", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "shingles").union(pairs.select("cell", "a", "b", F.lit(None).cast("binary")))
    out = materialize(dealt.repartition("cell").sortWithinPartitions("cell", F.col("b").isNotNull()).mapInArrow(check, "a long, b long"), "verified")
    for done in (pairs, whole):
        drop_materialized(done)
    return out


def possible(size: np.ndarray, at: np.ndarray, root: np.ndarray, prev: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether rows x and y that share a shingle, of different roots, can be so similar: by their sizes and the shingle's places. Rows whose keys before it (prev, -1 for none) are the same have met under that key."""
    most = 1 + np.minimum(size[x] - at[x], size[y] - at[y]) - 1
    return (root[x] != root[y]) & ((prev[x] != prev[y]) | (prev[x] < 0)) & (np.minimum(most, np.minimum(size[x], size[y])) >= least_shared(similarity, size[x] + size[y]))


def meet(key: np.ndarray, size: np.ndarray, at: np.ndarray, root: np.ndarray, prev: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Possible pairs (row numbers) among rows of equal key; key is sorted. Within the largest root of a group nothing is compared."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    sizes = np.diff(edge)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.flatnonzero(np.repeat((sizes <= 8) & (sizes > 1), sizes))
    for d in range(1, 8):
        if len(small) > d:
            same = np.flatnonzero(key[small[d:]] == key[small[:-d]])
            x, y = small[same], small[same + d]
            hit = possible(size, at, root, prev, x, y, similarity)
            a.append(x[hit])
            b.append(y[hit])
    for g in np.flatnonzero(sizes > 8):
        rows = np.arange(edge[g], edge[g + 1])
        values, number, count = np.unique(root[rows], return_inverse=True, return_counts=True)
        apart = rows[number != np.argmax(count)]
        step = max(1, SQUARE // len(rows))
        for part in (apart[i : i + step] for i in range(0, len(apart), step)):
            x, y = np.repeat(part, len(rows)), np.tile(rows, len(part))
            hit = possible(size, at, root, prev, x, y, similarity)
            a.append(x[hit])
            b.append(y[hit])
    return np.concatenate(a), np.concatenate(b)


def block_pair(key: tuple, group: pa.Table, similarity: float) -> pa.Table:
    """Possible pairs a, b, with the key, x and y, between the rows of block x and those of block y of one group (within the block where x is y), by their bitmaps too. key: the group's key, x, y."""
    node, root, prev, place, block = (group.column(c).to_numpy() for c in ("node", "root", "prev", "place", "block"))
    bits, size, at = bitmaps(group.column("parity")), place >> 32, place & 0xFFFFFFFF
    one, other = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, SQUARE // 8 // max(1, len(other)))
    for part in (one[i : i + step] for i in range(0, len(one), step)):
        x, y = np.repeat(part, len(other)), np.tile(other, len(part))
        hit = np.flatnonzero(possible(size, at, root, prev, x, y, similarity))
        x, y = x[hit], y[hit]
        hit = within(bits[x], bits[y], size[x] + size[y], similarity)
        a.append(node[x[hit]])
        b.append(node[y[hit]])
    a, b = np.concatenate(a), np.concatenate(b)
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)} | {c: np.full(len(a), k.as_py(), np.int64) for c, k in zip(("key", "x", "y"), key, strict=True)})


def candidates(known: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """known: node, root, size, parity and prefix (keys as bytes) of distinct sets. Returns pairs a, b of nodes of different roots that can have the similarity, none that has it is missing, and the cell in which each is to be verified."""

    @tidy
    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                keys = [np.frombuffer(x, np.int64) for x in part.column(3).to_pylist()]
                n = np.array([len(k) for k in keys], dtype=np.int64)
                who = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
                size = part.column(2).to_numpy()[who].astype(np.int64)
                key = np.concatenate([np.zeros(0, np.int64), *keys])
                prev = np.where(place > 0, np.concatenate([key[:0], [-1], key[:-1]])[: len(key)], -1)
                node, root = (part.column(i).to_numpy()[who] for i in (0, 1))
                # a root that is the set itself is written as zero, which takes less in the shuffle
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, prev, node, root ^ node, size << 32 | place)], names=["key", "prev", "node", "root", "place"])

    names = ["a", "b", "key", "prev", "node", "root", "place", "block"]

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key. A group beyond one block, or with more possible pairs than rows in them, goes on as rows, with its key and a block number."""
        held = np.zeros((5, 0), np.int64)  # rows of the last key, whose group may go on
        number = 0  # blocks of that group passed on so far

        def passed(rows: np.ndarray, number: int) -> pa.RecordBatch:
            key, prev, node, root, place = rows
            none = pa.nulls(rows.shape[1], pa.int64())
            return pa.RecordBatch.from_arrays([none, none, *map(pa.array, (key, prev, node, root ^ node, place)), pa.array(np.full(rows.shape[1], number))], names=names)

        def settled(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            key, prev, node, root, place = rows
            a, b = meet(key, place >> 32, place & 0xFFFFFFFF, root ^ node, prev, similarity)
            group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
            paired = np.zeros(len(key), dtype=bool)
            paired[a] = paired[b] = True
            dense = np.bincount(group[a], minlength=group[-1] + 1) > np.bincount(group, paired)
            one, other = a[~dense[group[a]]], b[~dense[group[a]]]
            pairs = np.unique(np.stack([np.minimum(node[one], node[other]), np.maximum(node[one], node[other]), key[one]]), axis=1)
            none = pa.nulls(pairs.shape[1], pa.int64())
            yield pa.RecordBatch.from_arrays([*map(pa.array, pairs), *[none] * 5], names=names)
            yield passed(rows[:, paired & dense[group]], 0)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([held, np.stack([batch.column(i).to_numpy() for i in range(5)])], axis=1)
            edge = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1], [True]]))
            large = np.diff(edge) > block
            large[-1] = True
            large[0] |= number > 0
            small = np.repeat(~large, np.diff(edge))
            for i in np.flatnonzero(large).tolist():
                start, end = int(edge[i]), int(edge[i + 1])
                if i:
                    number = 0
                while end - start > block:
                    yield passed(rows[:, start : start + block], number)
                    start, number = start + block, number + 1
                if end == rows.shape[1]:
                    held = rows[:, start:end]
                elif number:
                    yield passed(rows[:, start:end], number)
                else:
                    small[start:end] = True
            if small.any():
                yield from settled(rows[:, small])
        if held.shape[1]:
            yield from [passed(held, number)] if number else settled(held)

    filed = known.select("node", "root", "size", "prefix").mapInArrow(file, "key long, prev long, node long, root long, place long")
    met = materialize(filed.repartition("key").sortWithinPartitions("key", F.expr("root ^ node"), "place").mapInArrow(compare, ", ".join(f"{n} long" for n in names)), "met")
    whole = F.lit(-1).cast("long")
    found = met.where("a is not null").select("a", "b", "key", whole.alias("x"), whole.alias("y"))
    once = lambda pairs: pairs.groupBy("a", "b").agg(F.min(F.struct("key", "x", "y")).alias("at")).select("a", "b", F.xxhash64("at.key", "at.x", "at.y").alias("cell"))  # noqa: E731  near copies share their rarest shingles, so few cells hold most of their pairs
    large = met.where("a is null").drop("a", "b")
    if not large.limit(1).count():
        return once(found)
    size = F.shiftright("place", 32)
    stats = large.groupBy("key", "block").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.min(size).alias("short"), F.max(size).alias("long"))
    one, other = (stats.select("key", *(F.col(c).alias(f"{c}_{n}") for c in stats.columns[1:])) for n in ("x", "y"))
    apart = "not (least_x = most_x and least_y = most_y and least_x = least_y)"
    overlap = f"long_x >= {similarity} * short_y - 1e-9 and long_y >= {similarity} * short_x - 1e-9"
    pairs = one.join(other, "key").where("block_x <= block_y").where(apart).where(overlap).select("key", F.col("block_x").alias("x"), F.col("block_y").alias("y"))
    ends = pairs.select("key", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    dealt = large.join(ends, ["key", "block"]).join(known.select("node", "parity"), "node")
    more = dealt.select("key", "x", "y", "block", "node", "root", "prev", "place", "parity").groupBy("key", "x", "y").applyInArrow(lambda key, group: block_pair(key, group, similarity), "a long, b long, key long, x long, y long")
    return once(found.union(more))
