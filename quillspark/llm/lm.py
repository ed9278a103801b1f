"""Language-model scores by deleted interpolation.

Word trigrams, bigrams and unigrams have maximum-likelihood estimates from the training texts; a token's probability is
l3 c(uvw)/c(uv) + l2 c(vw)/c(v) + l1 c(w)/N + l0/(V+1), where the weights depend on the bucket of the context's frequency
(powers of two): of c(uv), or where that is 0, of c(v). The weights are learned by expectation-maximisation on the tokens
of a deleted part of the training texts (every tenth by a hash of the id) with estimates from the other part; the final
estimates count all training texts. Tokens are words and one end per text; a text's first word stands after two ends. A
token not in training has the unigram estimate 0; the uniform part gives it, as a class of its own, 1/(V+1).

How it runs: texts are tokenised once, into blocks of about BLOCK_TOKENS tokens that are written to the shared folder. A
block asks for the counts of its distinct n-grams, each once, with its own counts of them: sorted hashes, packed, dealt
by range of hash. Each range adds up and answers every block in the order asked. Blocks and answers meet by the block's
key, first those of the deleted part for the weights, then all of them for the scores. No n-gram is sent more often than
once per block, however frequent it is, and what is held at a time is one block or one range. Words are known by 64 bits
of XXH64, n-grams by 56 bits.

For the weights, the ratios of the estimates are rounded to 1/4 of a power of two and counted; so what the driver learns
is a grid whose size doesn't depend on the corpus.

Cases: null and empty texts are one end token. Repeated rows count as texts of their own. With no training text the
score is 0 for every text. Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from quillspark.llm import words as W
from quillspark.llm.common import input_bytes, materialize

BLOCK_TOKENS = 1_500_000
END = W.mix(np.uint64([0x5BD1E995]))[0]
BUCKETS = 40
HELD_OUT, RETAINED, DELETED = 0, 1, 2
STEPS, NONE = 4, -(1 << 15)
#: Unigrams, bigrams, trigrams, and by how much their hashes are shifted down.
KINDS, SHIFT = (1, 2, 3), np.uint64(8)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as planes of their bytes, as many as the largest needs."""
    wide = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return bytes([width]) + wide[:, :width].T.tobytes()


def unpack(data: bytes, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    """The n values that begin at data[at], and where they end."""
    width = data[at]
    planes = np.frombuffer(data, np.uint8, width * n, at + 1).reshape(width, n)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = planes.T
    return wide.view("<u8").reshape(-1).astype(np.uint64), at + 1 + width * n


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    steps, at = unpack(data, n, at)
    return np.cumsum(steps, dtype=np.uint64), at


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def follow(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Hash of what stands before and a token after it."""
    with np.errstate(over="ignore"):
        return W.mix(before * _ODD + W.mix(token))


class Block:
    """Hashes of all tokens of some texts. sizes: tokens of each text. grams: by kind the distinct n-grams; at: by kind the number of each token's n-gram, which ends with it."""

    def __init__(self, ids: list, parts: np.ndarray, tokens: np.ndarray, sizes: np.ndarray):
        self.ids, self.parts, self.sizes = ids, parts, sizes
        self.first = np.cumsum(sizes) - sizes
        self.grams, self.at = {}, {}
        self.grams[1], self.at[1] = np.unique(tokens, return_inverse=True)
        self.end = int(np.searchsorted(self.grams[1], END))
        before = np.concatenate([np.full(min(1, len(tokens)), END), tokens[:-1]])  # each text ends with an end
        pairs = follow(before, tokens)
        self.grams[2], self.at[2] = np.unique(pairs >> SHIFT, return_inverse=True)
        context = np.concatenate([pairs[:1], pairs[:-1]])
        context[self.first] = follow(END, np.full(1, END))[0]
        self.grams[3], self.at[3] = np.unique(follow(context, tokens) >> SHIFT, return_inverse=True)

    @property
    def key(self) -> int:
        return xxhash.xxh3_64_intdigest(self.grams[1][self.at[1]].tobytes() + repr(self.ids).encode() + self.sizes.tobytes()) - (1 << 63)

    def contexts(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often the token before each token occurs, and the two before it, from counts of unigrams and bigrams. Two ends stand before every text."""
        last = np.concatenate([np.full(min(1, len(self.at[1])), self.end), self.at[1][:-1]])
        pair = two[np.concatenate([self.at[2][:1], self.at[2][:-1]])]
        pair[self.first] = one[self.end] if len(one) else 0
        return one[last], pair

    def counts(self, kind: int) -> list[np.ndarray]:
        """Occurrences of the n-grams in retained and in deleted texts."""
        part = np.repeat(self.parts, self.sizes)
        return [np.bincount(self.at[kind][part == p], minlength=len(self.grams[kind])).astype(np.uint64) for p in (RETAINED, DELETED)]

    def pack(self) -> bytes:
        return squeeze(pack_sorted(self.grams[1]) + pack(self.at[1].astype(np.uint64)) + pack(self.sizes.astype(np.uint64)) + pack(self.parts.astype(np.uint64)))

    @classmethod
    def unpack(cls, ids: list, data: bytes, unigrams: int, tokens: int) -> Block:
        data = unsqueeze(data)
        values, at = unpack_sorted(data, unigrams)
        where, at = unpack(data, tokens, at)
        sizes, at = unpack(data, len(ids), at)
        parts, at = unpack(data, len(ids), at)
        return cls(ids, parts.astype(np.int64), values[where.astype(np.int64)], sizes.astype(np.int64))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of a task's rows (id, text, part). Texts of the deleted part make blocks of their own."""
    held: dict[bool, list] = {True: [], False: []}
    total = {True: 0, False: 0}

    def flush(which: bool) -> Block:
        ids = [i for x in held[which] for i in x[0]]
        block = Block(ids, *(np.concatenate([x[k] for x in held[which]]) for k in (1, 2, 3)))
        held[which], total[which] = [], 0
        return block

    for batch in batches:
        part = batch.column(2).to_numpy()
        for which in (True, False):
            rows = batch.filter(pa.array((part == DELETED) == which))
            at = 0
            for column in W.chunks(rows.column(1)):
                b = W.split(column)
                words = W.xxh64(b.data, b.start, b.end)
                tokens = np.full(len(words) + b.docs, END)
                tokens[np.arange(len(words)) + b.doc] = words
                own = rows.slice(at, len(column))
                at += len(column)
                held[which].append((own.column(0).to_pylist(), own.column(2).to_numpy().astype(np.int64), tokens, np.diff(b.first) + 1))
                total[which] += len(tokens)
                if total[which] >= BLOCK_TOKENS:
                    yield flush(which)
    for which in (True, False):
        if held[which]:
            yield flush(which)


def packed(docs: DataFrame) -> DataFrame:
    """The blocks of docs (id, text, part): block, ids, unigrams, tokens, deleted, data."""
    id_type = docs.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            kind = pa.list_(pa.int64()) if id_type == "bigint" else None
            yield pa.RecordBatch.from_arrays([pa.array([b.key], pa.int64()), pa.array([b.ids], kind), pa.array([len(b.grams[1])], pa.int32()), pa.array([len(b.at[1])], pa.int32()), pa.array([bool((b.parts == DELETED).any())]), pa.array([b.pack()], pa.binary())], names=["block", "ids", "unigrams", "tokens", "deleted", "data"])

    return docs.mapInArrow(run, f"block long, ids array<{id_type}>, unigrams int, tokens int, deleted boolean, data binary")


def each(rows: pa.Table | pa.RecordBatch) -> Iterator[Block]:
    """Blocks from rows of packed()."""
    for ids, n, m, data in zip(*(rows.column(c) for c in ("ids", "unigrams", "tokens", "data")), strict=True):
        yield Block.unpack(ids.as_py(), data.as_py(), n.as_py(), m.as_py())


def ask(found: DataFrame, ranges: int) -> DataFrame:
    """Rows (kind, range, block, deleted, n, data) of what the blocks ask, by kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, key, deleted_one in zip(each(batch), batch.column("block").to_pylist(), batch.column("deleted").to_pylist(), strict=True):
                for kind in KINDS:
                    values, (retained, deleted) = block.grams[kind], block.counts(kind)
                    of = ((values >> np.uint64(32 if kind == 1 else 24)) * np.uint64(ranges)) >> np.uint64(32)
                    edges = np.searchsorted(of, np.arange(ranges + 1))
                    some = np.flatnonzero(np.diff(edges))
                    data = [squeeze(pack_sorted(values[a:b]) + pack(retained[a:b]) + pack(deleted[a:b])) for a, b in zip(edges[some], edges[some + 1], strict=True)]
                    n = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(some.astype(np.int32)), pa.array(np.full(n, key, np.int64)), pa.array([deleted_one] * n, pa.bool_()), pa.array(np.diff(edges)[some].astype(np.int32)), pa.array(data, pa.binary())], names=["kind", "range", "block", "deleted", "n", "data"])

    return found.mapInArrow(run, "kind int, range int, block long, deleted boolean, n int, data binary")


def answer(asked: DataFrame, parts: int) -> DataFrame:
    """Rows (kind, range, block, deleted, n, data): totals in retained and deleted texts, in the order asked. For each range of unigrams also a row without block: its types and tokens, of all training texts and of retained ones."""

    def run(group: pa.Table) -> pa.Table:
        kind, number = group.column("kind")[0].as_py(), group.column("range")[0].as_py()
        values, retained, deleted, sizes = [], [], [], group.column("n").to_pylist()
        for n, data in zip(sizes, group.column("data"), strict=True):
            data = unsqueeze(data.as_py())
            v, at = unpack_sorted(data, n)
            r, at = unpack(data, n, at)
            d, at = unpack(data, n, at)
            values.append(v)
            retained.append(r)
            deleted.append(d)
        types, where = np.unique(np.concatenate(values), return_inverse=True)
        # sums stay below 2**53, where floating point counts exactly
        sums = [np.bincount(where, np.concatenate(x).astype(np.float64), len(types)).astype(np.uint64) for x in (retained, deleted)]
        edges = np.concatenate([[0], np.cumsum(sizes)])
        data = [squeeze(pack(sums[0][where[a:b]]) + pack(sums[1][where[a:b]])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        keys, one = group.column("block").to_pylist(), kind == 1
        every = sums[0] + sums[1]
        rows = len(keys) + one
        extra = lambda x: [None] * len(keys) + [int(x)] * one
        return pa.table({"kind": pa.array([kind] * rows, pa.int32()), "range": pa.array([number] * rows, pa.int32()), "block": pa.array(keys + [None] * one, pa.int64()), "deleted": pa.array(group.column("deleted").to_pylist() + [None] * one, pa.bool_()), "n": pa.array(sizes + [0] * one, pa.int32()), "data": pa.array(data + [None] * one, pa.binary()), "types": pa.array(extra((every > 0).sum()), pa.int64()), "tokens": pa.array(extra(every.sum()), pa.int64()), "retained": pa.array(extra(sums[0].sum()), pa.int64())})

    return asked.repartition(parts, "kind", "range").groupBy("kind", "range").applyInArrow(run, "kind int, range int, block long, deleted boolean, n int, data binary, types long, tokens long, retained long")


def counts(block: Block, answers: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By kind: totals in retained and in deleted texts of the block's n-grams."""
    out = {}
    for kind in KINDS:
        rows = {}
        for k, number, n, data in zip(*(answers.column(c).to_pylist() for c in ("kind", "range", "n", "data")), strict=True):
            if k == kind:
                rows[number] = (n, data)  # equal blocks get equal answers
        pieces = []
        for number in sorted(rows):
            n, data = rows[number][0], unsqueeze(rows[number][1])
            r, at = unpack(data, n)
            pieces.append((r, unpack(data, n, at)[0]))
        got = tuple(np.concatenate([np.zeros(0, np.uint64), *(p[i] for p in pieces)]) for i in (0, 1))
        if len(got[0]) != len(block.grams[kind]):
            raise ValueError(f"a block asked for {len(block.grams[kind])} n-grams and has answers for {len(got[0])}")
        out[kind] = got
    return out


def bucket(last: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Of the counts of the contexts: 0 where none was seen, below BUCKETS for words alone, above for pairs; powers of two apart."""
    step = lambda c: np.minimum(np.floor(np.log2(np.maximum(c, 1))) + 1, BUCKETS - 1)
    return np.where(pair > 0, BUCKETS + step(pair), np.where(last > 0, step(last), 0)).astype(np.int64)


def estimates(block: Block, one: np.ndarray, two: np.ndarray, three: np.ndarray, tokens: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each token: the bucket of its context, and the estimates of the trigram, the bigram and the unigram (0 where there is no such context)."""
    last, pair = (x.astype(np.float64) for x in block.contexts(one, two))
    return bucket(last, pair), np.stack([three[block.at[3]] / np.maximum(pair, 1), two[block.at[2]] / np.maximum(last, 1), one[block.at[1]] / max(tokens, 1)], axis=1)


def mixed(weights: np.ndarray, where: np.ndarray, p: np.ndarray, uniform: float, tokens: float) -> np.ndarray:
    """Probabilities from estimates; weights of estimates without a context go to the others."""
    w = weights[where]
    w[:, 0] = np.where(where >= BUCKETS, w[:, 0], 0)
    w[:, 1] = np.where(where > 0, w[:, 1], 0)
    w[:, 2] = w[:, 2] if tokens else 0
    return ((w[:, :3] * p).sum(axis=1) + w[:, 3] * uniform) / w.sum(axis=1)


def learn(rows: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights of the trigram, bigram, unigram and uniform estimates for each bucket. rows: bucket, log ratios of the three estimates to the uniform one, and how many tokens have them."""
    rows = np.asarray(rows, dtype=np.int64).reshape(-1, 5)
    rows = rows[np.lexsort(rows.T)]
    p = np.ones((len(rows), 4))
    for k in range(3):
        p[:, k] = np.where(rows[:, k + 1] == NONE, 0, 2.0 ** (rows[:, k + 1] / STEPS))
    n = rows[:, 4].astype(np.float64)

    def maximise(which: np.ndarray, start: np.ndarray, prior: np.ndarray) -> np.ndarray:
        w, p_own, n_own = start, p[which], n[which]
        for _ in range(rounds):
            share = p_own * w
            got = (share * (n_own / share.sum(axis=1))[:, None]).sum(axis=0) + prior
            w = got / got.sum()
        return w

    even = np.full(4, 1 / 4)
    common = maximise(np.arange(len(rows)), even, even)
    return np.stack([maximise(np.flatnonzero(rows[:, 0] == b), common, common) for b in range(2 * BUCKETS)])


def score(docs: DataFrame, learning: Column, id_col: str = "doc_id", text_col: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """Scores of all rows of docs. learning: the rows to learn from. weights: those of learn(); learned where none are given.

    Returns id, n_tokens, n_known, train_tokens, base_score (add-half unigrams) and score, log10 probabilities.
    """
    draw = F.pmod(F.xxhash64(F.lit("deleted"), F.col(id_col)), F.lit(10))
    part = F.when(~learning, HELD_OUT).when(draw == 0, DELETED).otherwise(RETAINED).cast("int")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), part.alias("part"))
    ranges = max(16, input_bytes(docs) // (4 << 20))
    found = materialize(packed(rows), "blocks", "uncompressed")
    size = found.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    answered = materialize(answer(ask(found, ranges), max(12, size[1] // BLOCK_TOKENS)), "answers", "uncompressed")
    types, tokens, retained = answered.where("block is null").agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("retained"), F.lit(0))).first()
    answers = answered.where("block is not null").select("kind", "range", "block", "deleted", "n", "data")
    uniform = 1 / (types + 1)
    tasks = max(12, size[0])  # about a block for each task

    def meet(deleted_only: bool) -> PandasCogroupedOps:
        some = [x.where("deleted") if deleted_only else x for x in (found, answers)]
        left, right = (x.drop("deleted").repartition(tasks, "block").groupBy("block") for x in some)
        return left.cogroup(right)

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for block in each(left):
            got = counts(block, right)
            where, p = estimates(block, *(got[k][0] for k in KINDS), retained)
            with np.errstate(divide="ignore"):
                logs = np.where(p > 0, np.round(STEPS * np.log2(p / uniform)), NONE).astype(np.int64)
            cells, n = np.unique(np.concatenate([where[:, None], logs], axis=1), axis=0, return_counts=True)
            out.append(pa.table({"bucket": cells[:, 0], "three": cells[:, 1], "two": cells[:, 2], "one": cells[:, 3], "n": n.astype(np.int64)}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("bucket", "three", "two", "one", "n")})

    if weights is None:
        cells = meet(True).applyInArrow(weigh, "bucket long, three long, two long, one long, n long")
        grid = cells.groupBy("bucket", "three", "two", "one").agg(F.sum("n").alias("n")).toArrow()
        weights = learn(np.stack([c.to_numpy() for c in grid.columns], axis=1))
    given = weights

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for block in each(left):
            got = counts(block, right)
            one, two, three = (got[k][0] + got[k][1] for k in KINDS)
            where, p = estimates(block, one, two, three, tokens)
            p = mixed(given, where, p, uniform, tokens)
            seen = one[block.at[1]].astype(np.float64)
            base = np.log10((seen + 0.5) / (tokens + 0.5 * (types + 1)))
            add = lambda x, f=block.first: np.add.reduceat(x, f)
            out.append(pa.table({"id": block.ids, "n_tokens": block.sizes, "n_known": add((seen > 0).astype(np.int64)), "train_tokens": np.full(len(block.ids), tokens, np.int64), "base_score": add(base), "score": add(np.log10(p))}))
        return pa.concat_tables(out) if out else empty

    id_type = rows.schema["id"].dataType.simpleString()
    kind = pa.int64() if id_type == "bigint" else pa.string() if id_type == "string" else pa.int32()
    empty = pa.table({"id": pa.array([], kind), **{c: pa.array([], pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")}, **{c: pa.array([], pa.float64()) for c in ("base_score", "score")}})
    return meet(False).applyInArrow(rate, f"id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)
