"""Sources and sinks: project trees, fenced Markdown, verdict lines, metadata; flat and project output, append logs and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("tex", "sty", "cls", "bib", "bbl")
VERDICTS = ("PASS", "CONVERT_FAIL", "INPUT_BROKEN", "UNATTRIBUTED", "SKIP")


def read_projects(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """project (first folder below root), path (relative), ext and content of all source files; hidden and build folders are left out, and what isn't UTF-8 has null content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.*").load(root)
    below = F.regexp_replace("path", "^.*?" + root.rstrip("/").rsplit("/", 1)[-1].replace(".", r"\.") + "/", "")
    files = raw.select(below.alias("below"), F.lower(F.element_at(F.split("path", r"\."), -1)).alias("ext"), F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("content"))
    files = files.where(F.col("ext").isin(*extensions) & ~F.col("below").rlike(r"(^|/)(\.|target/|node_modules/)"))
    return files.select(F.split("below", "/")[0].alias("project"), F.regexp_replace("below", "^[^/]*/", "").alias("path"), "ext", "content")


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """verdict and id of lines such as `PASS 12:`; others are ignored."""
    pattern = rf"^({'|'.join(VERDICTS)})\s+(\S+?):?(\s.*)?$"
    lines = spark.read.text(path)
    return lines.select(F.regexp_extract("value", pattern, 1).alias("verdict"), F.regexp_extract("value", pattern, 2).alias("id")).where("verdict <> ''")


def read_toplevel(spark: SparkSession, path: str) -> DataFrame:
    """The top-level source named by each paper's metadata JSON; papers without one are left out."""
    meta = spark.read.schema("sources array<struct<usage:string,filename:string>>, spec_version int").option("multiLine", True).json(path)
    top = F.try_element_at(F.filter("sources", lambda s: s["usage"] == "toplevel"), F.lit(1))
    return meta.select(F.input_file_name().alias("file"), top["filename"].alias("entry")).where("entry is not null")


def write_flat(converted: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One text file row per document and, beside it, its warnings as JSON, also where there are none."""
    converted.select("typst").write.mode(mode).text(f"{path}/typst", lineSep="\f\n")
    converted.drop("typst").write.mode(mode).json(f"{path}/warnings")


def write_projects(files: DataFrame, base: str, force: bool = False) -> DataFrame:
    """Writes project, path, content below base, a partition per project; rows whose path would leave the project are skipped and returned."""
    safe = ~F.col("path").rlike(r"(^/)|(^|/)\.\.(/|$)")
    files.where(safe).write.mode("overwrite" if force else "errorifexists").partitionBy("project").parquet(base)
    return files.where(~safe)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def upsert(current: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of new replace those of the same key."""
    return current.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def inline(spark: SparkSession, source: str) -> DataFrame:
    """One source given as text: a table of one row."""
    return spark.createDataFrame([("-", source)], "path string, content string")


def read_folder(spark: SparkSession, root: str, extension: str = "tex") -> DataFrame:
    """path and content of the files that lie in root itself, sorted by path; what isn't UTF-8 is an error."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").load(root)
    return raw.select("path", F.validate_utf8(F.col("content").cast("string")).alias("content")).orderBy("path")


# The JSON files that runs leave behind.
DOCUMENTS = {
    "warnings": "array<struct<category:struct<kind:string,name:string,reason:string>,severity:string,message:string,snippet:string>>",
    "baseline": "struct<score:double,papers:array<struct<id:string,status:string,word_recall:double,heading_recall:double,page_ratio:double,mean_ssim:double>>>",
    "findings": "array<struct<paper:string,dimension:string,verdict:string,severity:int>>",
}


def read_documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """path and value of JSON files of a kind, one document each; those that don't parse have a null value."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return text.select("path", F.from_json("value", DOCUMENTS[kind]).alias("value"))


def write_sidecars(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Diagnostics or doctor results, a JSON object for each document."""
    rows.write.mode(mode).json(path)


def write_report(buckets: DataFrame, by_category: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object with the buckets' counts and the warnings by kind, keys sorted. buckets: one row. by_category: kind, n."""
    kinds = by_category.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("by_category"))
    whole = buckets.withColumn("one", F.lit(1)).join(kinds.withColumn("one", F.lit(1)), "one").drop("one")
    whole.select(*sorted(whole.columns)).coalesce(1).write.mode(mode).json(path)
