"""The document kernel over DataFrames: one Arrow batch of sources at a time, one kernel call per document.

A document that can't be converted whole still gives a row: what was dropped is in its warnings, what didn't close sets
has_error. Null sources count as empty. Macros and assets of a project's other files come in as columns, so a project is
resolved by joins before, not inside, the kernel.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WARNING = "struct<kind:string,name:string,reason:string,severity:string,message:string,snippet:string,start_line:int,start_col:int,end_line:int,end_col:int,byte_start:int,byte_end:int>"
FIELDS = {
    "typst": "string",
    "warnings": f"array<{WARNING}>",
    "source_map": "array<struct<src_start:int,src_end:int,output:string>>",
    "has_error": "boolean",
    "headings": "array<struct<level:int,title:string>>",
    "labels": "array<string>",
    "citations": "array<string>",
    "references": "array<string>",
    "macros": "array<struct<name:string,params:int,body:string>>",
    "metadata": "map<string,string>",
}


def convert(docs: DataFrame, source: str = "content", fields: tuple[str, ...] = ("typst", "warnings", "has_error"), macros: str | None = None) -> DataFrame:
    """Adds the kernel's fields to the rows of docs; only what is asked for crosses from Python. macros: a column of map<name, struct<params, body>> with the project's definitions."""
    kept = [c for c in docs.columns if c not in fields]
    out = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(f, T._parse_datatype_string(FIELDS[f])) for f in fields)])
    arrow = [_arrow(out[f].dataType) for f in fields]
    at, seeds_at = kept.index(source), kept.index(macros) if macros else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillspark.functions.latex.convert import convert as kernel

        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                seeds = part.column(seeds_at).to_pylist() if seeds_at is not None else [None] * part.num_rows
                made = [kernel(text or "", {k: (v["params"], None, v["body"]) for k, v in seed or ()}) for text, seed in zip(part.column(at).to_pylist(), seeds, strict=True)]
                cols = [pa.array([getattr(r, f) if f != "metadata" else list(r.metadata.items()) for r in made], t) for f, t in zip(fields, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*kept, *fields])

    return docs.select(*kept).mapInArrow(run, out)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def warnings(converted: DataFrame, *keys: str) -> DataFrame:
    """A row for each warning, in order."""
    return converted.select(*keys, F.posexplode("warnings").alias("pos", "w")).select(*keys, "pos", "w.*")


def explain(docs: DataFrame, source: str = "content", *keys: str) -> DataFrame:
    """Which source span made which output; blank output and empty spans are left out."""
    spans = convert(docs, source, ("source_map",)).select(*keys, source, F.explode("source_map").alias("s"))
    return spans.where("s.src_end > s.src_start and trim(s.output) <> ''").select(*keys, "s.src_start", "s.src_end", F.expr(f"decode(substring(encode({source}, 'UTF-8'), s.src_start + 1, s.src_end - s.src_start), 'UTF-8')").alias("source"), "s.output").distinct()


def buckets(docs: DataFrame, source: str = "content") -> DataFrame:
    """Documents in all, clean, with warnings and with parse errors."""
    c = convert(docs, source)
    bad = F.col("has_error")
    return c.agg(F.count("*").alias("total"), F.count_if(~bad & (F.size("warnings") == 0)).alias("clean"), F.count_if(~bad & (F.size("warnings") > 0)).alias("warnings"), F.count_if(bad).alias("parse_error"))


def projects(files: DataFrame) -> DataFrame:
    """Converts each project's entry file with the macros of its other files, the last definition in path order first. files: project, path, content. Returns project, entry, error, typst, warnings."""
    from quillspark.operators.corpus import entry_files, last_wins

    entry = entry_files(files)
    found = convert(files.where(F.lower("path").rlike(r"\.(tex|sty|cls)$")), "content", ("macros",)).select("project", "path", F.posexplode("macros").alias("pos", "m"))
    table = last_wins(found.select("project", "path", "pos", F.col("m.name").alias("name"), F.struct("m.params", "m.body").alias("definition")), ["project", "name"], ["path", "pos"], "definition")
    seeds = table.groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct("name", "definition"))).alias("seeds"))
    source = files.select(F.col("project").alias("p"), "path", "content")
    joined = entry.join(source, (F.col("project") == F.col("p")) & (F.col("entry") == F.col("path")), "left").drop("p", "path").join(seeds, "project", "left")
    return convert(joined, "content", ("typst", "warnings"), "seeds").select("project", "entry", "error", F.when(F.col("entry").isNotNull(), F.col("typst")).alias("typst"), "warnings")


def register(spark: SparkSession) -> None:
    """SQL functions: latex_convert(source) gives the Typst text, latex_warnings(source) the warning kinds and names as a table."""

    @F.pandas_udf("string")
    def latex_convert(source: pd.Series) -> pd.Series:
        from quillspark.functions.latex.convert import convert as kernel

        return source.map(lambda x: kernel(x or "").typst)

    @F.udtf(returnType="kind string, name string, byte_start int, byte_end int")
    class LatexWarnings:
        def eval(self, source: str) -> Iterator[tuple]:
            from quillspark.functions.latex.convert import convert as kernel

            for w in kernel(source or "").warnings:
                yield w["kind"], w["name"], w["byte_start"], w["byte_end"]

    spark.udf.register("latex_convert", latex_convert)
    spark.udtf.register("latex_warnings", LatexWarnings)
