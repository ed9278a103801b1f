"""Suffix-array dedup of byte strings that occur more than once.

What is removed: every byte covered by a string of `length` bytes that also starts anywhere else, judged on the input.
With `report`, a smaller number, the bytes covered by repeated strings of that many bytes are counted as well.

The suffix order comes from the difference-cover algorithm: triples at positions that aren't multiples of three are
sorted and named, the string of names is ordered in the same way, and the remaining suffixes are merged in; then the
prefixes of adjacent suffixes are compared. To deal the work out, windows of the least length are grouped by the least
hash of the substrings of `seed` bytes inside: equal windows have equal least hashes, so they meet in one group. A run of
consecutive windows of a group, with the bytes that follow it up to the greatest length, is one snippet. Snippets of a
group whose hash occurs nowhere else are settled; equal snippets are kept once, with their number; the others of some
groups at a time make one text, whose suffixes are ordered as above. So only text that shares substrings with other text
is ordered, and a passage in a million documents once.

A group with more than GROUP_BYTES of different snippets (a passage that stands in very many different surroundings) is
ordered by the distributed form of the same algorithm (llm/cover.py): Spark sorts the triples by range. Where such groups
have more than TRIM_BYTES together, their snippets are trimmed first, for each length, to the starts whose string has a
rolling hash that another start has too: a string of another hash begins nowhere else. Without their surroundings most
snippets are equal, and equal ones are ordered once; what is left is ordered as before, so a chance hash adds work only.

Cases: null texts count as empty; texts shorter than `length` lose nothing. Equal rows are documents like others, so
both lose what they share. Repetition inside one document counts, overlaps too. Empty tables give empty ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import cover
from quillspark.llm.common import drop_materialized, input_bytes, materialize, tidy
from quillspark.llm.order import suffix_order
from quillspark.llm.words import mix

#: Bytes hashed for grouping, and a quarter of the least length at most.
SEED = 50
#: Bytes of snippets whose suffixes are ordered at a time, and of one group at most.
BATCH_BYTES, GROUP_BYTES = 1 << 20, 2 << 20
#: Bytes of snippets of large groups that are ordered without being trimmed.
TRIM_BYTES = 2 << 20
_ODD = 0x9E3779B97F4A7C15


def repeated(data: np.ndarray, order: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Of the starts (sorted) those whose next `length` bytes also begin at another start. data: bytes, 0 between texts. order: of its suffixes."""
    wanted = np.zeros(len(data), dtype=bool)
    wanted[starts] = True
    order = order[wanted[order]]
    if not len(order):
        return order
    wide = np.ndarray((len(data) + 1,), dtype="<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    same = np.arange(len(order) - 1)
    steps = [*range(0, length - 7, 8), length - 8] if length >= 8 else []
    for at in steps:
        same = same[wide[order[same] + at] == wide[order[same + 1] + at]]
    for at in range(length if length < 8 else 0):
        same = same[data[order[same] + at] == data[order[same + 1] + at]]
    return np.unique(np.concatenate([order[same], order[same + 1]]))


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 17)
        _POWERS[:] = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def runs(text: bytes, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least hash, first and last window of every run of windows with the same least hash, and whether it stands at several places there, so that the run may repeat itself."""
    n = len(text)
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    least = every = mix((sums[seed:] - sums[:-seed]) * down[: n - seed + 1])
    reach, width = 1, length - seed + 1
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    begin = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([begin[1:] - 1, [len(least) - 1]])
    value = least[begin]
    several = [np.count_nonzero(every[a : b + width] == v) > 1 for v, a, b in zip(value, begin.tolist(), last.tolist(), strict=True)]
    return value, begin, last, np.array(several)


def text_key(data: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(data)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def utf8(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, the text's key (k1, k2), n_bytes and the digest of the whole text."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                texts = utf8(part.column(1))
                keys = [text_key(x) for x in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())], names=["id", "k1", "k2", "n_bytes", "whole"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, k1 long, k2 long, n_bytes long, whole string")


def snippets(docs: DataFrame, text_col: str, length: int, reach: int, seed: int) -> DataFrame:
    """Rows (hash, digest, k1, k2, lo, hi, stop, several): runs of windows of `length` bytes, where their snippet stops (`reach` bytes after the last start, or at the text's end) and its digest."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                cols: list[list] = [[], [], [], [], [], [], [], []]
                for text in utf8(part.column(0)):
                    h, lo, hi, several = runs(text, length, seed)
                    if len(h):
                        k1, k2 = text_key(text)
                        stop = np.minimum(hi + reach, len(text))
                        digest = np.array([xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(lo.tolist(), stop.tolist(), strict=True)], dtype=np.uint64)
                        for c, x in zip(cols, (h.view(np.int64), digest.view(np.int64), np.full(len(h), k1), np.full(len(h), k2), lo, hi, stop, several.astype(np.int64)), strict=True):
                            c.append(x)
                none = np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *c]), pa.int64()) for c in cols], names=["hash", "digest", "k1", "k2", "lo", "hi", "stop", "several"])

    return docs.select(text_col).mapInArrow(run, "hash long, digest long, k1 long, k2 long, lo long, hi long, stop long, several long")


def ranges(at: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    return list(zip(at[np.concatenate([[0], cut + 1])].tolist(), at[np.concatenate([cut, [len(at) - 1]])].tolist(), strict=True))


#: A run of starts, as offsets in a snippet, whose strings of `size` bytes are repeated.
RUNS = "array<struct<from:long,to:long,size:int>>"
_RUNS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("size", pa.int32())]))


def ordered(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """rows: (hash, digest, data, starts), sorted by hash within each partition. Per snippet with repeated strings of one of the sizes: hash, digest, and the runs of their starts."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes, int]] = []

        def settle(some: list[tuple[int, int, bytes, int]]) -> Iterator[pa.RecordBatch]:
            if not some:
                return
            data = np.frombuffer(b"\0".join(x[2] for x in some) + b"\0", np.uint8)
            long = np.array([len(x[2]) for x in some])
            first = np.concatenate([[0], np.cumsum(long + 1)])
            order = suffix_order(data.astype(np.int64) + 1)
            found: list[list] = [[] for _ in some]
            for size in sizes:
                n = np.maximum(0, np.minimum([x[3] for x in some], long - size + 1))  # starts with so many bytes after them
                starts = np.repeat(first[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                hits = repeated(data, order, starts, size)
                edges = np.searchsorted(hits, first)
                for i in np.flatnonzero(np.diff(edges)):
                    found[i] += [{"from": a, "to": b, "size": size} for a, b in ranges(hits[edges[i] : edges[i + 1]] - first[i])]
            which = [i for i, x in enumerate(found) if x]
            yield pa.RecordBatch.from_arrays([pa.array([some[i][0] for i in which], pa.int64()), pa.array([some[i][1] for i in which], pa.int64()), pa.array([found[i] for i in which], _RUNS)], names=["hash", "digest", "runs"])

        size = 0
        for batch in batches:
            for h, d, data, n in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if size > BATCH_BYTES and h != held[-1][0]:
                    yield from settle(held)
                    held, size = [], 0
                if not held or held[-1][:2] != (h, d):  # the same snippet can come from equal rows
                    held.append((h, d, data, n))
                    size += len(data)
        yield from settle(held)

    return rows.mapInArrow(run, f"hash long, digest long, runs {RUNS}")


def ordered_by_spark(pieces: DataFrame, sizes: list[int]) -> DataFrame:
    """As ordered(), for snippets of groups that are too large for one task: their concatenation is ordered by cover.ordered(), once for all sizes."""
    spark = pieces.sparkSession
    own = materialize(pieces.dropDuplicates(["hash", "digest"]), "large")
    total = own.agg(F.count("*"), F.sum(F.length("data") + 1)).first()
    if not total[0]:
        return spark.createDataFrame([], f"hash long, digest long, runs {RUNS}")
    # places: each snippet's first place comes from running sums over ranges of (hash, digest)
    parts = max(1, -(-total[1] // (64 << 20)))
    ranged = materialize(own.repartitionByRange(parts, "hash", "digest").withColumn("pid", F.spark_partition_id()), "large-ranged")
    below, at = [], 0
    for pid, n in ranged.groupBy("pid").agg(F.sum(F.length("data") + 1)).orderBy("pid").collect():
        below.append((pid, at))
        at += n
    offset = F.broadcast(spark.createDataFrame(below, "pid int, base long"))
    before = F.sum(F.length("data") + 1).over(Window.partitionBy("pid").orderBy("hash", "digest").rowsBetween(Window.unboundedPreceding, -1))
    placed = materialize(ranged.join(offset, "pid").select("hash", "digest", "data", "starts", (F.coalesce(before, F.lit(0)) + F.col("base")).alias("first")), "large-placed")

    @tidy
    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = np.concatenate([np.frombuffer(data, np.uint8).astype(np.int64) + 2, [1]])
                yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(len(text))), pa.array(text)], names=["place", "symbol"])

    text = materialize(placed.select("data", "first").mapInArrow(symbols, "place long, symbol long"), "large-text")
    ranks = cover.ordered(text, int(total[1]))  # one order for all sizes
    out = None

    @tidy
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places come sorted; runs of them that stay within a block of places."""
        for batch in batches:
            at = batch.column(0).to_numpy()
            cut = np.flatnonzero((np.diff(at) > 1) | (at[1:] % cover.NEAR == 0))
            yield pa.RecordBatch.from_arrays([pa.array(at[np.concatenate([[0], cut + 1])[: len(at)]]), pa.array(at[np.concatenate([cut, [len(at) - 1]])[: len(at)]])], names=["from", "to"])

    for size in sizes:

        @tidy
        def digests(batches: Iterator[pa.RecordBatch], size: int = size) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data, starts, first in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                    n = max(0, min(starts, len(data) - size + 1))
                    keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[p : p + size]) for p in range(n)), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(n)), pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=["place", "d1", "d2"])

        starts = placed.select("data", "starts", "first").mapInArrow(digests, "place long, d1 long, d2 long")
        hits = cover.repeated(ranks, int(total[1]), starts)
        # back from places to snippets: runs of places meet the snippets of their block
        block = lambda c: F.floor(F.col(c) / F.lit(cover.NEAR))
        some = hits.repartition(block("place")).sortWithinPartitions("place").mapInArrow(joined, "from long, to long").withColumn("block", block("from"))
        spans = placed.select("hash", "digest", F.col("first"), (F.col("first") + F.col("starts") - 1).alias("last"))
        spans = spans.withColumn("block", F.explode(F.sequence(block("first"), block("last"))))
        found = some.join(spans, "block").where("from between first and last")
        one = found.select("hash", "digest", F.struct((F.col("from") - F.col("first")).alias("from"), (F.col("to") - F.col("first")).alias("to"), F.lit(size).cast("int").alias("size")).alias("run"))
        out = one if out is None else out.union(one)
    out = materialize(out.groupBy("hash", "digest").agg(F.collect_list("run").alias("runs")), "large-verdicts")
    for done in (own, ranged, placed, text, ranks):
        drop_materialized(done)
    return out


def trimmed(own: DataFrame, sizes: list[int]) -> DataFrame:
    """own: sid (a number), hash, digest, data, starts of distinct snippets. Returns the runs of starts whose string of a size may begin at another start: hash, size, digest of the bytes it needs, these bytes (data), starts, and the snippet's digest (of) and where in it the run begins (at)."""

    @tidy
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Starts that share a key here are known to stay: they go on by sid, with a negative place, and two rows without a sid tell the others of the key. So few rows meet under a common key."""
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                cols: list[list] = [[np.zeros(0, np.int64)] for _ in range(3)]
                for sid, data, starts in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                    up, down = powers(len(data) + 1)
                    sums = np.zeros(len(data) + 1, dtype=np.uint64)
                    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
                    for k, size in enumerate(sizes):
                        n = min(starts, len(data) - size + 1)
                        if n > 0:
                            key = mix((sums[size : size + n] - sums[:n]) * down[:n]) ^ mix(np.uint64([size]))
                            for c, x in zip(cols, (key.view(np.int64), np.full(n, sid), np.arange(n) * len(sizes) + k), strict=True):
                                c.append(x)
                key, who, place = map(np.concatenate, cols)
                _, number, count = np.unique(key, return_inverse=True, return_counts=True)
                stay = count[number] > 1
                told = np.repeat(np.unique(key[stay]), 2)
                none = np.full(len(told), -1)
                rows = np.concatenate([key, told]), np.concatenate([who, none]), np.concatenate([np.where(stay, -1 - place, place), none * 0])
                rows[0][: len(key)][stay] = who[stay]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["key", "sid", "place"])

    @tidy
    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; those that aren't alone under theirs."""
        held, kept = np.zeros((3, 0), np.int64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([held, np.stack([batch.column(i).to_numpy() for i in range(3)])], axis=1)
            same = rows[0, 1:] == rows[0, :-1]
            keep = np.concatenate([[kept], same]) | np.concatenate([same, [False]])
            yield found(rows[:, :-1], keep[:-1])
            held, kept = rows[:, -1:], bool(keep[-1])
        yield found(held, np.full(held.shape[1], kept))

    def found(rows: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
        _, sid, place = rows[:, (keep | (rows[2] < 0)) & (rows[1] >= 0)]
        return pa.RecordBatch.from_arrays([pa.array(sid), pa.array(np.where(place < 0, -1 - place, place))], names=["sid", "place"])

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                out: list[tuple] = []
                for h, d, data, places in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                    places = np.sort(np.array(places, dtype=np.int64))
                    for k, size in enumerate(sizes):
                        for a, b in ranges(places[places % len(sizes) == k] // len(sizes)):
                            some = data[a : b + size]
                            out.append((h, size, np.uint64(xxhash.xxh3_64_intdigest(some)).view(np.int64), some, b - a + 1, d, a))
                cols = list(zip(*out, strict=True)) or [()] * 7
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["hash", "size", "digest", "data", "starts", "of", "at"])

    filed = own.select("sid", "data", "starts").mapInArrow(keys, "key long, sid long, place long")
    several = filed.repartition("key").sortWithinPartitions("key").mapInArrow(twice, "sid long, place long").groupBy("sid").agg(F.collect_list("place").alias("places"))
    return own.join(several, "sid").select("hash", "digest", "data", "places").mapInArrow(cut, "hash long, size int, digest long, data binary, starts long, of long, at long")


def ordered_large(pieces: DataFrame, sizes: list[int], group_bytes: int) -> DataFrame:
    """As ordered(), for snippets of groups of more than group_bytes."""
    own = materialize(pieces.dropDuplicates(["hash", "digest"]).withColumn("sid", F.monotonically_increasing_id()), "large-own")
    if own.agg(F.sum(F.length("data"))).first()[0] <= TRIM_BYTES:
        return ordered_by_spark(own.drop("sid"), sizes)
    some = materialize(trimmed(own, sizes), "trimmed")
    each = materialize(some.groupBy("hash", "size", "digest").agg(F.count("*").alias("n"), F.first("data").alias("data"), F.first("starts").alias("starts")), "trimmed-classes")
    large = materialize(each.groupBy("hash", "size").agg(F.sum(F.length("data")).alias("bytes")).where(F.col("bytes") > group_bytes).select("hash", "size", F.lit(True).alias("large")), "trimmed-large")
    still = {r.size_ for r in large.select(F.col("size").alias("size_")).distinct().collect()}
    parts = max(12, input_bytes(each) // (8 << 20))
    run = F.struct(F.lit(0).cast("long").alias("from"), (F.col("starts") - 1).alias("to"), F.col("size"))
    verdicts = each.where("n > 1").select("hash", "digest", "size", F.array(run).alias("runs"))
    for size in sizes:
        these = each.where(F.col("size") == size).join(large, ["hash", "size"], "left").select("hash", "digest", "data", "starts", "large")
        found = ordered(these.where("large is null").drop("large").repartition(parts, "hash").sortWithinPartitions("hash", "digest"), [size])
        if size in still:
            found = found.union(ordered_by_spark(these.where("large").drop("large"), [size]))
        verdicts = verdicts.union(found.select("hash", "digest", F.lit(size).alias("size"), "runs"))
    verdicts = materialize(verdicts, "trimmed-verdicts")
    back = some.select("hash", "digest", "size", "of", "at").join(verdicts, ["hash", "digest", "size"])
    moved = F.transform("runs", lambda r: F.struct((r["from"] + F.col("at")).alias("from"), (r["to"] + F.col("at")).alias("to"), r["size"].alias("size")))
    out = back.select("hash", F.col("of").alias("digest"), moved.alias("runs")).groupBy("hash", "digest").agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs"))
    out = materialize(out, "large-verdicts")
    for done in (own, some, each, large, verdicts):
        drop_materialized(done)
    return out


def join_spans(spans: list[dict]) -> list[dict]:
    """Sorted spans as disjoint ones."""
    merged: list[dict] = []
    for s in spans:
        if merged and s["start"] <= merged[-1]["end"]:
            merged[-1]["end"] = max(merged[-1]["end"], s["end"])
        else:
            merged.append({"start": s["start"], "end": s["end"]})
    return merged


def removed(docs: DataFrame, length: int, report: int | None, seed: int, id_col: str, text_col: str, rows: DataFrame, group_bytes: int) -> DataFrame:
    """Per text that has something repeated: k1, k2, the sorted, disjoint spans of bytes to remove, and how many bytes stand in repeated strings of `report` bytes."""
    sizes = sorted({length, report or length})
    least, reach = sizes[0], sizes[-1]
    found = materialize(snippets(docs, text_col, least, reach, seed), "snippets")
    # what the joins look up is written first, so that Spark can split the hot keys of the other side
    shared = materialize(found.groupBy("hash").agg(F.count("*").alias("n"), ((F.min("digest") != F.max("digest")) | (F.max("several") > 0)).alias("mixed")).where("n > 1 or mixed").select("hash", "mixed"), "groups")
    again = materialize(found.join(shared, "hash"), "shared")
    classes = materialize(again.groupBy("hash", "digest").agg(F.count("*").alias("n"), F.first("mixed").alias("mixed"), F.min(F.struct("k1", "k2", "lo", "hi", "stop")).alias("one")), "classes")
    large = materialize(classes.where("mixed").groupBy("hash").agg(F.sum(F.col("one.stop") - F.col("one.lo")).alias("bytes")).where(F.col("bytes") > group_bytes).select("hash", F.lit(True).alias("large")), "large")
    asked = classes.where("mixed").join(large, "hash", "left")
    asked = asked.groupBy("one.k1", "one.k2").agg(F.collect_list(F.struct("hash", "digest", F.col("one.lo").alias("lo"), F.col("one.hi").alias("hi"), F.col("one.stop").alias("stop"), F.coalesce("large", F.lit(False)).alias("large"))).alias("asked"))
    where = rows.groupBy("k1", "k2").agg(F.min("id").alias("of"))
    asked = asked.join(where, ["k1", "k2"])

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                out: list[tuple] = []
                for text, k1, k2, some in zip(utf8(part.column(0)), *(part.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                    if text_key(text) == (k1, k2):  # else another row of the same id
                        out += [(x["hash"], x["digest"], text[x["lo"] : x["stop"]], x["hi"] - x["lo"] + 1, x["large"]) for x in some]
                cols = list(zip(*out, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["hash", "digest", "data", "starts", "large"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(asked, F.col("id").eqNullSafe(F.col("of"))).select("text", "k1", "k2", "asked")
    pieces = materialize(texts.mapInArrow(cut, "hash long, digest long, data binary, starts long, large boolean"), "pieces")
    parts = max(12, input_bytes(pieces) // (8 << 20))
    verdicts = ordered(pieces.where("not large").select("hash", "digest", "data", "starts").repartition(parts, "hash").sortWithinPartitions("hash", "digest"), sizes)
    whole = lambda k: F.struct(F.lit(0).cast("long").alias("from"), F.least(F.col("one.hi") - F.col("one.lo"), F.col("one.stop") - F.col("one.lo") - k).alias("to"), F.lit(k).cast("int").alias("size"))
    verdicts = verdicts.union(classes.where("n > 1").select("hash", "digest", F.filter(F.array(*map(whole, sizes)), lambda r: r["to"] >= 0).alias("runs")))
    if large.limit(1).count():
        verdicts = verdicts.union(ordered_large(pieces.where("large").drop("large"), sizes, group_bytes))
    verdicts = materialize(verdicts, "verdicts")
    hits = again.select("hash", "digest", "k1", "k2", "lo").join(verdicts, ["hash", "digest"])
    hits = hits.select("k1", "k2", F.explode(F.transform("runs", lambda r: F.struct(r["size"].alias("size"), (F.col("lo") + r["from"]).alias("start"), (F.col("lo") + r["to"] + r["size"]).alias("end")))).alias("span"))
    gathered = hits.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("span")).alias("spans"))

    @tidy
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, marked = [], []
            for spans in batch.column(2).to_pylist():
                own.append(join_spans([s for s in spans if s["size"] == length]))
                marked.append(sum(s["end"] - s["start"] for s in join_spans([s for s in spans if s["size"] == (report or length)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(marked, pa.int64())], names=["k1", "k2", "removed", "n_repeated"])

    out = materialize(gathered.mapInArrow(join, "k1 long, k2 long, removed array<struct<start:long,end:long>>, n_repeated long"), "spans")
    for done in (found, shared, again, classes, large, pieces, verdicts):
        drop_materialized(done)
    return out


def dedup(docs: DataFrame, length: int = 400, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES, keep_bytes: bool = False, report: int | None = None) -> DataFrame:
    """Per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, with report the bytes in repeated strings of so many bytes (n_repeated), and with keep_bytes the remaining bytes (null where nothing goes)."""
    seed = min(seed, max(1, min(length, report or length) // 4))
    rows = materialize(keyed(docs, id_col, text_col), "texts")
    spans = removed(docs, length, report, seed, id_col, text_col, rows, group_bytes)
    where = spans.where("size(removed) > 0").join(rows.groupBy("k1", "k2").agg(F.min("id").alias("of")), ["k1", "k2"])

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                out: list[tuple] = []
                for text, k1, k2, gone in zip(utf8(part.column(0)), *(part.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                    if text_key(text) != (k1, k2):
                        continue
                    kept, at = [], 0
                    for s in gone:
                        kept.append(text[at : s["start"]])
                        at = s["end"]
                    left = b"".join([*kept, text[at:]])
                    out.append((k1, k2, len(text) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left if keep_bytes else None))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 6, kinds, strict=True)], names=["k1", "k2", "n_removed", "n_spans", "kept_sha256", "kept"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(where, F.col("id").eqNullSafe(F.col("of"))).select("text", "k1", "k2", "removed")
    done = texts.mapInArrow(cut, "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept binary").dropDuplicates(["k1", "k2"])
    if report:
        done = done.join(spans.select("k1", "k2", "n_repeated"), ["k1", "k2"], "full")
    found = rows.join(done, ["k1", "k2"], "left")
    number = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    cols = [F.col("id").alias(id_col), "n_bytes", number("n_removed"), number("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), *([number("n_repeated")] if report else [])]
    return found.select(*cols, *(["k1", "k2", "kept"] if keep_bytes else []))


def cut_text(docs: DataFrame, length: int = 400, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """Whole rows of docs with the repeated strings cut from their texts. Where a cut goes through a character, its other bytes go too; a count of code points in chars_col follows the text."""
    seed = min(seed, max(1, length // 4))
    rows = materialize(keyed(docs, id_col, text_col), "texts")
    spans = removed(docs, length, None, seed, id_col, text_col, rows, GROUP_BYTES)
    lost = rows.join(spans, ["k1", "k2"]).select(F.col("id").alias("__loser"), F.struct("k1", "k2", "removed").alias("lost")).groupBy("__loser").agg(F.collect_set("lost").alias("__lost"))
    joined = docs.join(lost, F.col(id_col).eqNullSafe(F.col("__loser")), "left").drop("__loser")
    names = docs.columns
    at_text = names.index(text_col)
    at_chars = names.index(chars_col) if chars_col in names else None

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                texts = part.column(at_text).to_pylist()
                counts = part.column(at_chars).to_pylist() if at_chars is not None else []
                for i, lost in enumerate(part.column(part.num_columns - 1).to_pylist()):
                    if not lost:
                        continue
                    data = (texts[i] or "").encode()
                    own = next((x["removed"] for x in lost if (x["k1"], x["k2"]) == text_key(data)), [])
                    if own:
                        kept, at = [], 0
                        for s in own:
                            kept.append(data[at : s["start"]].decode(errors="ignore"))
                            at = s["end"]
                        texts[i] = "".join([*kept, data[at:].decode(errors="ignore")])
                        if counts:
                            counts[i] = len(texts[i])
                cols = list(part.columns[:-1])
                cols[at_text] = pa.array(texts, pa.string())
                if at_chars is not None:
                    cols[at_chars] = pa.array(counts, cols[at_chars].type)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.select(*docs.columns, "__lost").mapInArrow(run, docs.schema)
