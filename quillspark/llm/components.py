"""Connected components of a link table, by alternating large-star and small-star rounds; each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import drop_materialized, materialize


def components(links: DataFrame) -> DataFrame:
    """links: two columns a, b. Returns node and root, the smallest node that it reaches; nodes without links are absent.

    Rounds go on until one changes nothing; their number grows as the square of the logarithm of the nodes at most.
    Loops and repeated links are harmless; a link with a null end is none. An empty table gives an empty one.
    """
    edges = materialize(links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, old = state, edges
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select("m", F.explode(F.array("a", "b")).alias("b")).where("m <> b")
        edges = materialize(small.select(F.col("m").alias("a"), "b").distinct(), "links")
        drop_materialized(old)
    return edges.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")
