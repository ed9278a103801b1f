"""The incremental index: files that arrive are converted once, and each paper's latest result is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators import convert as K


def latest(rows: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The newest row of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))
    return rows.withColumn("place", place).where("place = 1").drop("place")


def index_batch(path: str) -> Callable[[DataFrame, int], None]:
    """Appends a batch under its own number, so a batch that runs again after a failure replaces itself; readers take the latest row of each id."""

    def write(batch: DataFrame, number: int) -> None:
        done = K.convert(batch, "content", ("typst", "warnings", "has_error"))
        done.select("id", F.lit(number).alias("version"), F.length("typst").alias("chars"), F.size("warnings").alias("n_warnings"), "has_error").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def start(spark: SparkSession, source: str, path: str, checkpoint: str) -> StreamingQuery:
    """Watches a folder of JSON rows (id, content)."""
    rows = spark.readStream.schema("id long, content string").json(source)
    return rows.writeStream.foreachBatch(index_batch(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    return latest(spark.read.parquet(path))
