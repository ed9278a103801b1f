"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link where they differ in at most `radius` bits. The bits are grouped into parts, correlated
bits together; dynamic programming gives each part a threshold of its own, so that the thresholds plus one sum to
radius + 1 and the estimated work is least. Two fingerprints within the radius then agree on at least one part up to
that part's threshold: each is filed under its part's value with up to that many set bits cleared, where such a pair
meets. What meets is verified on all 64 bits. Only distinct fingerprints are compared, and a group of fingerprints
that meet gives a spanning forest of its links, not all pairs, so exact copies and large clusters stay cheap. The
plan is estimated from a bounded sample of fingerprints (PLAN_SAMPLE); it sets the cost, never the result.

Cases: texts without words have fingerprint 0 and link like any others. Null texts count as empty. Repeated rows and
ids are kept, each with its row. A null id takes no part in a smallest id. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import jaccard as J
from quillspark.llm import words as W
from quillspark.llm.common import drop_materialized, materialize, tidy
from quillspark.llm.components import components

PLAN_SAMPLE = 4096
#: What verifying a pair costs, in keys filed, dealt out and sorted, as measured.
PAIR_COST = 0.003
#: Into how many shares the members of a component are dealt where its smallest id is joined to them.
SALTS = 16
#: Keys that a task compares, about.
TASK_KEYS = 400_000
#: A group of up to this many fingerprints is compared at once, all with all, as long as few of them are near.
SQUARE = 1024
#: A group of more fingerprints than this under one key is split into blocks, and the blocks' pairs are dealt out.
BLOCK = 20_000
#: Into how many groups likely_links() splits a word's bits; bits by which a word may differ beyond its share of the total.
BANDS, SLACK = 5, 4


def fingerprints(docs: DataFrame, shingle: int, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and w0, w1, ... (64 bits each, as signed longs) of whole texts: w0 from the shingles' XXH64, the others from other hashes of it."""
    names = [f"w{k}" for k in range(words)]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in W.chunks(batch.column(1)):
                b = W.split(part)
                start, end, first = W.shingles(b, shingle)
                h = W.xxh64(b.data, start, end)
                fp = [W.majority(W.mix(h ^ np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))) if k else h, first) for k in range(words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *(pa.array(f.view(np.int64)) for f in fp)], names=[id_col, *names])
                at += len(part)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, " + ", ".join(f"{n} long" for n in names))


@dataclass
class Plan:
    """parts: the bit numbers of each part. limits: each part's threshold, -1 where it isn't probed."""

    parts: list[list[int]]
    limits: list[int]


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Split the 64 bits into parts of equal size, each grown from a free bit by adding the bits that correlate with it most."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    near = np.zeros((64, 64))
    if len(sample) > 1:
        with np.errstate(invalid="ignore", divide="ignore"):
            near = np.nan_to_num(np.abs(np.corrcoef(bits.T)))
    free, out = list(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        own = [free.pop(0)]
        while len(own) < size:
            own.append(free.pop(int(np.argmax(near[np.ix_(free, own)].sum(axis=1)))))
        out.append(sorted(own))
    return out


def within(ones: np.ndarray, most: int) -> np.ndarray:
    """The chance that two fingerprints differ in at most 0, 1, ... most bits of a part, from its bits' shares of ones."""
    chance = np.zeros(most + 1)
    chance[0] = 1.0
    for p in ones:
        differ = 2 * p * (1 - p)
        chance = chance * (1 - differ) + np.concatenate([[0.0], chance[:-1]]) * differ
    return np.cumsum(chance)


def allocate(cost: np.ndarray, total: int) -> tuple[float, list[int]]:
    """Thresholds t of -1 and up with sum(t + 1) = total that make sum(cost[part, t + 1]) least, by dynamic programming."""
    parts, choices = cost.shape
    best = np.full((parts + 1, total + 1), np.inf)
    best[0, 0] = 0.0
    took = np.zeros((parts + 1, total + 1), dtype=int)
    for i in range(parts):
        for have in range(total + 1):
            for t in range(min(choices - 1, total - have) + 1):
                if best[i, have] + cost[i, t] < best[i + 1, have + t]:
                    best[i + 1, have + t], took[i + 1, have + t] = best[i, have] + cost[i, t], t
    limits, have = [], total
    for i in range(parts, 0, -1):
        limits.append(int(took[i, have]) - 1)
        have -= took[i, have]
    return float(best[parts, total]), limits[::-1]


def make_plan(sample: np.ndarray, n: int, radius: int, most: int = 2) -> Plan:
    """The parts and thresholds of least estimated work for n fingerprints: keys filed plus pairs verified."""
    best: tuple[float, Plan] | None = None
    for m in range(1, radius + 2):
        if m * (most + 1) < radius + 1:
            continue
        parts = group_bits(sample, m)
        cost = np.zeros((m, most + 2))
        for i, bits in enumerate(parts):
            ones = np.array([((sample >> np.uint64(b)) & np.uint64(1)).mean() if len(sample) else 0.5 for b in bits])
            pairs = within(ones, most) * n * max(n - 1, 0) / 2
            keys = np.cumsum([n * float(np.prod([ones.sum() - x for x in range(t)]) / max(1, np.prod(np.arange(1, t + 1)))) for t in range(most + 1)])
            cost[i, 1:] = keys + PAIR_COST * pairs
        total, limits = allocate(cost, radius + 1)
        if np.isfinite(total) and (best is None or total < best[0]):
            best = (total, Plan(parts, limits))
    assert best
    return best[1]


def file_keys(fp: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which each fingerprint is filed: each part's value with up to its threshold of set bits cleared."""
    keys, who = [], []
    everyone = np.arange(len(fp))
    for i, (bits, limit) in enumerate(zip(plan.parts, plan.limits, strict=True)):
        mask = np.uint64(sum(1 << b for b in bits))
        for cleared in range(limit + 1):
            for some in combinations(bits, cleared):
                off = np.uint64(sum(1 << b for b in some))
                has = everyone[(fp & off) == off]
                keys.append(W.mix((fp[has] & mask & ~off) ^ W.mix(np.uint64([i + 1]))[0]))
                who.append(has)
    return (np.concatenate(keys), np.concatenate(who)) if keys else (np.zeros(0, np.uint64), np.zeros(0, int))


@dataclass
class Rule:
    """Fingerprints (rows of words) link if the word `probe` differs in at most radius bits and all words together in at most total."""

    probe: int
    radius: int
    total: int

    def near(self, words: np.ndarray, other: np.ndarray) -> np.ndarray:
        hit = np.bitwise_count(words[:, self.probe] ^ other[..., self.probe]) <= self.radius
        if words.shape[1] > 1 and hit.any():
            at = np.flatnonzero(hit)
            hit[at] = np.bitwise_count(words[at] ^ (other[at] if other.ndim == 2 else other)).sum(axis=1) <= self.total
        return hit


def forest(words: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Links (row numbers) that connect what is connected within the group: each row reached is compared with those not yet reached."""
    if len(words) <= SQUARE:
        near = np.bitwise_count(words[:, rule.probe][:, None] ^ words[:, rule.probe][None, :]) <= rule.radius
        if np.count_nonzero(near) <= 8 * len(words):
            x, y = np.nonzero(near)
            x, y = x[x < y], y[x < y]
            kept = rule.near(words[x], words[y])
            return x[kept], y[kept]
    a, b, left = [], [], np.arange(len(words))
    while len(left):
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            at = stack.pop()
            near = rule.near(words[left], words[at])
            if near.any():
                hit = left[near]
                left = left[~near]
                a.append(np.full(len(hit), at))
                b.append(hit)
                stack.extend(hit.tolist())
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def meet(key: np.ndarray, words: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Links (row numbers) among rows of equal key; key is sorted. Small groups are compared for all keys at once."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    sizes = np.diff(edge)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.flatnonzero(np.repeat(sizes <= 8, sizes))
    k = key[small]
    for d in range(1, 8):
        if len(k) > d:
            at = np.flatnonzero(k[d:] == k[:-d])
            hit = at[rule.near(words[small[at]], words[small[at + d]])] if len(at) else at
            a.append(small[hit])
            b.append(small[hit + d])
    for g in np.flatnonzero(sizes > 8):
        x, y = forest(words[edge[g] : edge[g + 1]], rule)
        a.append(x + edge[g])
        b.append(y + edge[g])
    return np.concatenate(a), np.concatenate(b)


def sampled(fps: DataFrame, names: list[str]) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and a bounded sample of their words."""
    some = fps.select(*names).orderBy(F.xxhash64(*names)).limit(PLAN_SAMPLE).collect()
    return fps.count(), np.array([tuple(r) for r in some], dtype=np.int64).view(np.uint64).reshape(-1, len(names))


def links(fps: DataFrame, radius: int, total: int | None = None, probes: int = 1, block: int = BLOCK) -> DataFrame:
    """fps: distinct fingerprints, a number `node` and words w0, w1, ... Returns links a, b (nodes) that connect all that lie near each other.

    Near means: one of the first `probes` words differs in at most radius bits, and all words together in at most total.
    """
    names = [c for c in fps.columns if c.startswith("w")]
    n, sample = sampled(fps, names)
    found = None
    for probe in range(probes):
        plan = make_plan(sample[:, probe], n, radius)
        keys = n * len(file_keys(sample[:, probe], plan)[0]) // max(1, len(sample))
        some = _links(fps, plan, Rule(probe, radius, radius if total is None else total), names, max(12, keys // TASK_KEYS), block)
        found = some if found is None else found.union(some)
    return found


def likely_links(fps: DataFrame, total: int, block: int = BLOCK) -> DataFrame:
    """Links as links() gives them, of fingerprints that differ in at most total bits and have one of BANDS groups of bits of a word in common. A pair can be missed, so an exact way must find the rest.

    No bits are cleared, so a fingerprint is filed words * BANDS times whatever the size of the table.
    """
    names = [c for c in fps.columns if c.startswith("w")]
    n, sample = sampled(fps, names)
    found = None
    for probe in range(len(names)):
        plan = make_plan(sample[:, probe], n, BANDS - 1, most=0)
        some = _links(fps, plan, Rule(probe, total // len(names) + SLACK, total), names, max(12, n * BANDS // TASK_KEYS), block)
        found = some if found is None else found.union(some)
    return found


def _links(fps: DataFrame, plan: Plan, rule: Rule, names: list[str], parts: int, block: int) -> DataFrame:
    fields = "node long, " + ", ".join(f"{c} long" for c in names)

    def matrix(batch: pa.RecordBatch | pa.Table, first: int) -> np.ndarray:
        return np.stack([batch.column(first + i).to_numpy() for i in range(len(names))], axis=1).view(np.uint64) if batch.num_rows else np.zeros((0, len(names)), np.uint64)

    @tidy
    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                words = matrix(part, 1)
                key, who = file_keys(words[:, rule.probe], plan)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(c.take(pa.array(who)) for c in part.columns)], names=["key", "node", *names])

    def rows(a: np.ndarray, b: np.ndarray, words: np.ndarray | None = None, key: int | None = None, number: int = 0) -> pa.RecordBatch:
        extra = [pa.array(words[:, i].view(np.int64)) if words is not None else pa.nulls(len(a), pa.int64()) for i in range(len(names))]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([key] * len(a), pa.int64()), pa.array(np.full(len(a), number), pa.int32()), *extra], names=["a", "b", "key", "block", *names])

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key. A group beyond one block goes on as rows with its key and a block number."""
        key, node, words = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(names)), np.uint64)
        large, number = None, 0

        def settled(end: int) -> pa.RecordBatch:
            a, b = meet(key[:end], words[:end], rule)
            return rows(node[a], node[b])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = np.concatenate([key, batch.column(0).to_numpy()]), np.concatenate([node, batch.column(1).to_numpy()])
            words = np.concatenate([words, matrix(batch, 2)])
            if large is not None:  # the group goes on from the batch before
                end = len(key) if key[-1] == large else int(np.argmax(key != large))
                for at in range(0, end, block):
                    yield rows(node[at : min(end, at + block)], node[at : min(end, at + block)], words[at : min(end, at + block)], large, number)
                    number += 1
                key, node, words = key[end:], node[end:], words[end:]
                if not len(key):
                    continue
                large = None
            cut = int(np.argmax(key == key[-1]))
            if cut:
                yield settled(cut)
                key, node, words = key[cut:], node[cut:], words[cut:]
            if len(key) > block:
                large, number = int(key[-1]), 0
                for at in range(0, len(key), block):
                    yield rows(node[at : at + block], node[at : at + block], words[at : at + block], large, number)
                    number += 1
                key, node, words = key[:0], node[:0], words[:0]
        if len(key):
            yield settled(len(key))

    def block_pair(_: tuple, group: pa.Table) -> pa.Table:
        node = group.column("a").to_numpy()
        a, b = forest(np.stack([group.column(c).to_numpy() for c in names], axis=1).view(np.uint64), rule)
        return pa.table({"a": node[a], "b": node[b]})

    filed = fps.select("node", *names).mapInArrow(file, "key long, " + fields)
    met = materialize(filed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long, key long, block int, " + ", ".join(f"{c} long" for c in names)), "met")
    found = met.where("key is null").select("a", "b")
    large = met.where("key is not null")
    if large.limit(1).count():
        count = large.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
        pairs = large.join(count, "key").select("key", "a", *names, "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        pairs = pairs.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "a", *names)
        found = found.union(pairs.groupBy("key", "x", "y").applyInArrow(block_pair, "a long, b long"))
    return found


def classes(fps: DataFrame, radius: int, total: int | None = None, probes: int = 1, id_col: str = "doc_id") -> DataFrame:
    """fps: id and words w0, ... by row. Adds component_id, the smallest id reachable over links. Fingerprints of several words are known by a 64-bit hash of them."""
    names = [c for c in fps.columns if c.startswith("w")]
    marked = fps.withColumn("node", F.col("w0") if len(names) == 1 else F.xxhash64(*names))
    distinct = materialize(marked.groupBy("node", *names).agg(F.min(id_col).alias("least")), "fps")
    of = component_ids(distinct, components(links(distinct.drop("least"), radius, total, probes)))
    return marked.join(of, "node", "left")


def component_ids(known: DataFrame, roots: DataFrame) -> DataFrame:
    """known: node and its least id. roots: node and root, of nodes with links. Returns node and component_id, the least id of its component.

    Only linked nodes are joined to their component's id, in SALTS shares, so that one large component is no single task.
    """
    every = roots.select(F.col("node").alias("of"), "root").union(roots.select(F.col("root").alias("of"), "root")).distinct()
    linked = materialize(known.select("node", "least").join(every, F.col("node") == F.col("of")).select("node", "least", "root"), "linked")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    smallest = materialize(smallest.select("root", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "smallest")
    found = linked.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(smallest, ["root", "salt"]).select(F.col("node").alias("member"), "component_id")
    return known.select("node", "least").join(found, F.col("node") == F.col("member"), "left").select("node", F.coalesce("component_id", "least").alias("component_id"))


def bits_at(similarity: float, bits: int) -> int:
    """Bits in which two fingerprints differ on average, if their shingle sets are of equal size and have this Jaccard similarity."""
    return int(bits * np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def described(docs: DataFrame, shingle: int, similarity: float, words: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, the node of its set of shingles, the set's size, prefix and bitmap (see jaccard), and w0, w1, ... as fingerprints() gives them."""
    known = J.common(docs, shingle, text_col)
    names = [f"w{k}" for k in range(words)]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in W.chunks(batch.column(1)):
                h, first = J.sets(W.split(part), shingle)
                key, begin = J.prefixes(h, first, known, similarity)
                prefix = pa.array([key[x:y].tobytes() for x, y in zip(begin[:-1], begin[1:], strict=True)], pa.binary())
                bitmap = pa.array([x.tobytes() for x in J.parities(h, first)], pa.binary())
                fp = [W.majority(W.mix(h ^ np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))) if k else h, first) for k in range(words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(J.nodes(h, first)), pa.array(np.diff(first).astype(np.int32)), prefix, bitmap, *(pa.array(f.view(np.int64)) for f in fp)], names=["id", "node", "size", "prefix", "parity", *names])
                at += len(part)

    return docs.select(id_col, text_col).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, node long, size int, prefix binary, parity binary, " + ", ".join(f"{n} long" for n in names))


def fewer(pairs: DataFrame) -> DataFrame:
    """Of links a, b each node's to its least and its greatest neighbour: two a node at most, whatever the group's size. It can part what all links connect, so an exact way must find the rest."""
    ends = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    chosen = ends.groupBy("a").agg(F.min("b").alias("x"), F.max("b").alias("y"))
    return chosen.select("a", F.explode(F.array("x", "y")).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def thin(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole rows of docs, one document of each group of near-duplicates, that of the smallest id. Near-duplicates are texts whose sets of shingles have this Jaccard similarity, exactly, and what such pairs connect.

    SimHash (`words` fingerprints of 64 bits, of sets) finds most links cheaply, each fingerprint filed as often in any table,
    of which two a set at most are used; a prefix join finds all that they leave out. Every link is verified on whole sets before components are formed.

    Rows of one id stand or fall together; of equal rows one stays. Rows with a null id stay.
    """
    rows = materialize(described(docs, shingle, similarity, words, id_col, text_col), "described")
    names = [f"w{k}" for k in range(words)]
    known = rows.groupBy("node").agg(F.min("id").alias("least"), *(F.first(c).alias(c) for c in ("size", "prefix", "parity", *names)))
    known = materialize(known, "known")
    whole, rows = rows, materialize(rows.select("id", "node"), "nodes")
    drop_materialized(whole)
    total = bits_at(similarity, 64 * words)
    near = J.verified(fewer(J.close(likely_links(known.select("node", *names), total), known, similarity)), docs, shingle, similarity, text_col)
    rooted = known.join(components(near).withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").withColumn("root", F.coalesce("root", "node"))
    maybe = J.close(J.candidates(rooted, similarity), known, similarity)
    every = near.union(J.verified(maybe, docs, shingle, similarity, text_col))
    found = rows.select("id", "node").join(component_ids(known, components(every)), "node")
    # ids that go, and ids of several rows, which alone are looked through for equal rows
    marks = found.groupBy("id").agg(F.max(F.col("id") != F.col("component_id")).alias("__gone"), (F.count("*") > 1).alias("__several")).where("__gone or __several").withColumnRenamed("id", "__of")
    left = docs.join(marks, docs[id_col] == marks["__of"], "left").where("not coalesce(__gone, false)")
    once = left.where("not coalesce(__several, false)").select(*docs.columns)
    place = Window.partitionBy(id_col, text_col).orderBy(F.lit(0))
    several = left.where("__several").withColumn("__place", F.row_number().over(place)).where("__place = 1").select(*docs.columns)
    return once.union(several)


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, its fingerprint in hexadecimal digits, and component_id."""
    fps = materialize(fingerprints(docs, shingle, 1, id_col, text_col), "fingerprints")
    found = classes(fps, radius, id_col=id_col)
    return found.select(id_col, F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")
