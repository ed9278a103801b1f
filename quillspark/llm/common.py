"""What the operators share: tables, the shared folder, sizes and Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or where that is unset one in the warehouse; on one machine (local mode) a temporary folder, which goes away with the process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if not at and not spark.sparkContext.master.startswith("local["):
        at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.quillspark-{spark.sparkContext.applicationId}"
    if not at:
        own = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = _OWN[spark.sparkContext.applicationId] = "file://" + own
    return at.rstrip("/")


def materialize(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size in bytes, for choosing partition counts; where it has none, the strings' length."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < 1 << 55:
        return size
    texts = [F.sum(F.octet_length(c)) for c, kind in df.dtypes if kind in ("string", "binary")]
    return sum(x or 0 for x in df.agg(*texts).first()) if texts else 0


def remainder(col: str | Column, n: int = 5) -> Column:
    """crc32 of the id as text, mod n: the folds that the contracts name. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of an Arrow column; null becomes empty."""
    return [x or "" for x in column.to_pylist()]


def filled(column: pa.Array) -> pa.Array:
    return pc.fill_null(column, "")


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, after which the worker process gives free memory back, since it waits for other tasks beside further ones."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return run
