"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least hash of its s-mers lies at its first or last s-mer; that depends
on the k-mer alone, so equal passages give equal anchors wherever they stand. A fingerprint holds all distinct anchors
of the text, each with its first position. The likeness of two fingerprints is the share of anchors that they have in
common on the commonest shift of positions.

Cases: a text without anchors (shorter than k) has its own hash as its only anchor. Null texts count as empty. Equal
fingerprints have likeness 1. Ids are numbers. Documents of equal id are ordered by text; a null id comes after all
others. One document is its own next. No rows give no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import input_bytes, tidy
from quillspark.llm.words import mix

K, S = 16, 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def anchors(texts: list[str], k: int = K, s: int = S) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes (32 bits, distinct) and first positions of each text's closed syncmers."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    ends = np.cumsum([len(c) for c in codes])
    c = np.concatenate([*codes, np.zeros(0, "<u4")]).astype(np.uint64)
    found_at, found = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(c) >= k:
        with np.errstate(over="ignore"):
            h = np.zeros(len(c) - s + 1, dtype=np.uint64)
            for j in range(s):
                h = h * _ODD + c[j : j + len(h)]
            h = mix(h)
            least, reach, width = h, 1, k - s + 1
            while reach < width:
                step = min(reach, width - reach)
                least = np.minimum(least[:-step], least[step:])
                reach += step
            n = len(least)
            at = np.flatnonzero((h[:n] == least) | (h[width - 1 : width - 1 + n] == least))
            doc = np.searchsorted(ends, at, side="right")
            at = at[at + k <= ends[doc]]
            value = np.zeros(len(at), dtype=np.uint64)
            for j in range(k):
                value = value * _ODD + c[at + j]
            found_at, found = at, mix(value) >> np.uint64(32)
    out = []
    edges = np.searchsorted(found_at, np.concatenate([[0], ends]))
    for i, t in enumerate(texts):
        a, h = found_at[edges[i] : edges[i + 1]] - (ends[i - 1] if i else 0), found[edges[i] : edges[i + 1]]
        if not len(a):
            a, h = np.zeros(1, np.int64), np.array([int.from_bytes(hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()[:4], "little")], dtype=np.uint64)
        h, first = np.unique(h, return_index=True)
        out.append((h, a[first]))
    return out


def encode(h: np.ndarray, at: np.ndarray) -> str:
    """Anchors in order of their hashes, hash and position of each as big-endian 32-bit numbers, in Base64."""
    return base64.b64encode(np.stack([h, at.astype(np.uint64)], axis=1).astype(">u4").tobytes()).decode()


def parse(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(base64.b64decode(fingerprint), ">u4").reshape(-1, 2)
    return pairs[:, 0].astype(np.uint64), pairs[:, 1].astype(np.int64)


def likeness(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1, of two texts' anchors (hashes in ascending order, positions)."""
    shared, i, j = np.intersect1d(one[0], other[0], assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    if len(shared) == len(one[0]) == len(other[0]) and np.array_equal(one[1], other[1]):
        return 1.0
    shifts = np.unique(one[1][i].astype(np.int64) - other[1][j].astype(np.int64), return_counts=True)[1]
    return float(shifts.max() / (len(one[0]) + len(other[0]) - len(shared)))


def with_next(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = 16 << 20, most: int = 1 << 16) -> tuple[DataFrame, int]:
    """Rows dealt to blocks of neighbouring ids, each with a copy of the rows that follow its last one (role 1).

    Blocks are ranges of ids between approximate quantiles, so that outlying ids don't matter; what the driver learns is
    the largest id of each block. `most` bounds the number of blocks, which are read as streams, not what they hold.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = int(min(most, max(12, input_bytes(docs) // block_bytes)))
    place = F.col("id").cast("double")
    cuts = rows.agg(F.percentile_approx(place, [k / blocks for k in range(1, blocks)], 20 * blocks)).first()[0] or []
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    rows = Bucketizer(splits=splits, inputCol="place", outputCol="block", handleInvalid="keep").transform(rows.withColumn("place", place)) if len(splits) > 2 else rows.withColumn("block", F.when(F.col("id").isNotNull(), 0))
    rows = rows.withColumn("block", F.when(F.col("id").isNull(), -1).otherwise(F.col("block")).cast("int")).drop("place")
    tops = sorted(((r[0], r[1]) for r in rows.groupBy("block").agg(F.max("id")).collect()), reverse=True)
    feeds = [(b, top, tops[i - 1][0]) for i, (b, top) in enumerate(tops)]  # the first rows of a block follow the last of the one above it
    top = docs.sparkSession.createDataFrame(feeds, f"block int, top {kind}, feeds int")
    joined = rows.join(F.broadcast(top), "block")
    own = F.struct("block", F.lit(0).alias("role"))
    copy = F.struct(F.col("feeds").alias("block"), F.lit(1).alias("role"))
    dealt = joined.select("id", "text", F.explode(F.when(F.col("id").eqNullSafe(F.col("top")), F.array(own, copy)).otherwise(F.array(own))).alias("to"))
    dealt = dealt.select("to.block", "to.role", "id", "text").repartition(blocks, "block")
    return dealt.sortWithinPartitions("block", "role", F.desc_nulls_last("id"), "text"), blocks


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: fingerprints of the text and of the text whose last third is replaced by the start of the next document (descending ids), and likenesses."""
    kind = dict(docs.dtypes)[id_col]

    def work(ids: list, texts: list[str], after: list[str], kinds: pa.DataType) -> pa.RecordBatch:
        """after: the text that follows each of texts."""
        edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, after, strict=True)]
        prints = anchors([*texts, after[-1], *edited])
        n = len(texts)
        own, then, changed = prints[:n], prints[1 : n + 1], prints[n + 1 :]
        return pa.RecordBatch.from_arrays([pa.array(ids, kinds), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array([encode(*x) for x in own]), pa.array([encode(*x) for x in changed]), pa.array([likeness(a, b) for a, b in zip(own, changed, strict=True)]), pa.array([likeness(a, b) for a, b in zip(own, then, strict=True)])], names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        chars, block, done = 0, None, False
        for batch in batches:
            kinds = batch.column(2).type
            for k in range(batch.num_rows):
                b, role, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(3)[k].as_py()
                if b != block:
                    block, done = b, False
                if done:
                    continue
                if role == 1:  # what follows the block's last row
                    if texts:
                        yield work(ids, texts, [*texts[1:], text], kinds)
                    ids, texts, chars, done = [], [], 0, True
                    continue
                if chars > 1 << 19:
                    yield work(ids, texts, [*texts[1:], text], kinds)
                    ids, texts, chars = [], [], 0
                ids.append(batch.column(2)[k].as_py())
                texts.append(text)
                chars += len(text)

    dealt, _ = with_next(docs, id_col, text_col)
    return dealt.mapInArrow(run, f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
