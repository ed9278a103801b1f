"""Keys that are passed on once, however many files carry them: the set of known keys is the stream's state, so runs go on where the last one ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def start(spark: SparkSession, source: str, schema: T.StructType, keys: list[str], sink: str, log: str, known: DataFrame | None = None) -> StreamingQuery:
    """Read JSON files that arrive in source, a few at a time, and write to sink the first row of each key; log holds the state. Rows whose keys stand in known are skipped."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).json(source)
    if known is not None:
        rows = rows.join(known.select(*keys).distinct(), keys, "left_anti")
    return rows.dropDuplicates(keys).writeStream.format("parquet").option("path", sink).option("checkpointLocation", log).trigger(availableNow=True).start()
