"""All queries of the library by name, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import kernel, papers, relational, survey


assert papers and survey  # their queries are registered with the relational ones


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**relational.QUERIES, **kernel.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**relational.ORACLES, **kernel.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel.kernel_histogram(spark, sf_dir)
