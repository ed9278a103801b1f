"""The difference-cover suffix order as Spark jobs, for text that is too much for one task.

The text is a table of places and symbols. Triples at places that aren't multiples of three are sorted by range and
named; while names repeat, the string of names is ordered in the same way; then the other suffixes are merged in by counting,
in two sorts, how many stand below each. A string that fits one task is ordered there, by the same algorithm in numpy. The
driver learns a few numbers for each partition.

Cases: an empty text gives no rows. Places are 0, 1, ... without gaps; symbols are positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import drop_materialized, materialize, tidy
from quillspark.llm.order import suffix_order

#: Rows that a task sorts, about; neighbouring places that are looked at together.
TASK_ROWS, NEAR = 2_000_000, 1 << 16
#: Symbols of a string that one task orders.
WHOLE = 2_500_000


def numbered(df: DataFrame, n: int, keys: list[str], rest: list[str], tag: str) -> DataFrame:
    """df sorted by range of keys (longs), with name (dense, from 1, equal for equal keys), and how many rows of kind 0 (zeros) and of other kinds (others) stand before each. df has a column kind."""
    parts = max(1, -(-n // TASK_ROWS))
    fields = "pid int, name long, zeros long, others long, kind int, " + ", ".join(f"{c} long" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, name, zeros, others = None, 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy() for i in range(len(keys))])
            new = np.ones(batch.num_rows, dtype=np.int64)
            new[1:] = np.any(key[:, 1:] != key[:, :-1], axis=0)
            new[0] = last is None or bool(np.any(key[:, 0] != last))
            zero = (batch.column(len(keys)).to_numpy() == 0).astype(np.int64)
            names, seen = name + np.cumsum(new), np.cumsum(zero) - zero
            before = np.arange(batch.num_rows) - seen
            yield pa.RecordBatch.from_arrays([batch.column(batch.num_columns - 1), pa.array(names), pa.array(zeros + seen), pa.array(others + before), *batch.columns[len(keys) : -1]], names=["pid", "name", "zeros", "others", "kind", *rest])
            last, name, zeros, others = key[:, -1].copy(), int(names[-1]), zeros + int(zero.sum()), others + int(batch.num_rows - zero.sum())

    ranged = df.select(*keys, "kind", *rest).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("pid", F.spark_partition_id())
    local = materialize(ranged.mapInArrow(run, fields), tag)
    sums = local.groupBy("pid").agg(F.max("name"), F.count(F.when(F.col("kind") == 0, 1)), F.count("*")).orderBy("pid").collect()
    below, at = [], (0, 0, 0)
    for pid, names, zeros, rows in sums:
        below.append((pid, *at))
        at = (at[0] + names, at[1] + zeros, at[2] + rows - zeros)
    offsets = F.broadcast(df.sparkSession.createDataFrame(below, "pid int, n0 long, z0 long, o0 long"))
    return local.join(offsets, "pid").select(*((F.col(a) + F.col(b)).alias(a) for a, b in (("name", "n0"), ("zeros", "z0"), ("others", "o0"))), "kind", *rest)


def with_next(df: DataFrame, place: str, cols: list[str], steps: int) -> DataFrame:
    """df with the cols of the rows that follow by 1 to steps places (0 past the end), as c1, c2, ... A block of neighbouring places gets copies of the rows after it."""
    block = F.floor(F.col(place) / F.lit(NEAR))
    copied = F.when(F.pmod(F.col(place), F.lit(NEAR)) < steps, F.array(block, block - 1)).otherwise(F.array(block))
    dealt = df.withColumn("__block", F.explode(copied))
    order = Window.partitionBy("__block").orderBy(place)
    ahead = [F.coalesce(F.lead(c, k).over(order), F.lit(0)).cast("long").alias(f"{c}{k}") for k in range(1, steps + 1) for c in cols]
    return dealt.select("*", *ahead).where(F.col("__block") == block).drop("__block")


def ordered_at_once(text: DataFrame, n: int) -> DataFrame:
    """As ordered(), in one task."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = np.zeros(n, dtype=np.int64)
        for batch in batches:
            symbols[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
        order = suffix_order(symbols)
        for at in range(0, n, NEAR):
            some = order[at : at + NEAR]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.arange(at + 1, at + 1 + len(some)))], names=["place", "rank"])

    return materialize(text.select("place", "symbol").coalesce(1).mapInArrow(run, "place long, rank long"), "cover-ranks")


def ordered(text: DataFrame, n: int, whole: int | None = None) -> DataFrame:
    """text: place and symbol, n rows. Returns place and rank: 1, 2, ... in the order of the suffixes. whole: symbols of a string that one task orders (WHOLE)."""
    whole = WHOLE if whole is None else whole
    if 0 < n <= whole:
        return ordered_at_once(text, n)
    if n % 3 == 1:  # the last suffix of the first class needs something after it
        text = text.union(text.sparkSession.createDataFrame([(n, 0)], "place long, symbol long"))
    size = n + (n % 3 == 1)
    ones = (size + 1) // 3
    text = materialize(with_next(text, "place", ["symbol"], 2), "cover-text")
    sample = text.where("place % 3 <> 0").withColumn("kind", F.lit(1))
    names = numbered(sample, size, ["symbol", "symbol1", "symbol2"], ["place"], "cover-names")
    state = names.agg(F.max("name"), F.count("*")).first()
    if state[0] is None:
        return text.select("place", F.lit(1).cast("long").alias("rank")).where(F.col("place") < n)
    if state[0] < state[1]:
        shorter = names.select(F.when(F.col("place") % 3 == 1, F.expr("place div 3")).otherwise(F.expr("place div 3") + ones).alias("place"), F.col("name").alias("symbol"))
        ranks = ordered(shorter, state[1], whole)
        ranks = ranks.select(F.when(F.col("place") < ones, F.col("place") * 3 + 1).otherwise((F.col("place") - ones) * 3 + 2).alias("at"), "rank")
    else:
        ranks = names.select(F.col("place").alias("at"), F.col("name").alias("rank"))
    known = text.select("place", "symbol").join(ranks, F.col("place") == F.col("at"), "left").select("place", "symbol", F.coalesce("rank", F.lit(0)).cast("long").alias("rank"))
    known = materialize(with_next(known, "place", ["symbol", "rank"], 2).withColumn("kind", (F.col("place") % 3).cast("int")), "cover-known")
    first = numbered(known.where("kind <> 2"), size, ["symbol", "rank1"], ["place", "rank"], "cover-first")
    second = numbered(known.where("kind <> 1"), size, ["symbol", "symbol1", "rank2"], ["place", "rank"], "cover-second")
    # a rank counts what stands below: of its own class and of the others
    merged = first.where("kind = 1").select("place", (F.col("rank") + F.col("zeros")).alias("rank")).union(second.where("kind = 2").select("place", (F.col("rank") + F.col("zeros")).alias("rank")))
    rest = first.where("kind = 0").select("place", (F.col("zeros") + F.col("others") + 1).alias("x")).join(second.where("kind = 0").select("place", F.col("others").alias("y")), "place").select("place", (F.col("x") + F.col("y")).alias("rank"))
    every = merged.union(rest).where(F.col("place") < n)
    out = materialize(every.withColumn("rank", F.col("rank") - (size - n)), "cover-ranks")  # what was added at the end stands below all others
    for done in (text, names, ranks, known, first, second):
        drop_materialized(done)
    return out


def repeated(ranks: DataFrame, n: int, starts: DataFrame) -> DataFrame:
    """ranks: what ordered() gives. starts: place, and the digest (d1, d2) of the string that begins there and is compared. Returns the places whose string also begins at another of them."""
    ranked = starts.join(ranks, "place").withColumn("kind", F.lit(1))
    row = numbered(ranked, n, ["rank", "place"], ["place", "d1", "d2"], "cover-order").select(F.col("others").alias("row"), "place", "d1", "d2")
    pairs = with_next(row, "row", ["place", "d1", "d2", "row"], 1).where("row1 = row + 1 and d1 = d11 and d2 = d21")
    return pairs.select(F.explode(F.array("place", "place1")).alias("place")).distinct()
