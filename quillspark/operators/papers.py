"""Papers as rows: kinds and venues, assets found by candidate paths, ordered state, merged metadata, compiler output, briefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Document kinds in the order in which an id is searched for them, and conference packages in order of precedence.
DOC_TYPES = ("beamer", "thesis", "report", "book")
VENUES = ("neurips", "icml", "iclr")
IMAGE_TYPES = ("", ".pdf", ".png", ".jpg", ".jpeg", ".svg", ".gif")


def doc_type(paper_id: Column) -> Column:
    """The first kind whose name the id contains, else article."""
    out = F.lit("article")
    for kind in reversed(DOC_TYPES):
        out = F.when(F.contains(F.lower(paper_id), F.lit(kind)), kind).otherwise(out)
    return out


def venue(source: Column) -> Column:
    """The document class; article and report are refined by a conference's package."""
    name = F.regexp_extract(source, r"\\documentclass(?:\[[^\]]*\])?\{([^{}]*)\}", 1)
    packages = F.array_join(F.regexp_extract_all(source, F.lit(r"\\usepackage(?:\[[^\]]*\])?\{([^{}]*)\}"), 1), ",")
    refined = name
    for v in reversed(VENUES):
        refined = F.when(F.contains(packages, F.lit(v)), v).otherwise(refined)
    return F.when(name == "", F.lit("unknown")).when(name.isin("article", "report"), refined).otherwise(name)


def probe_assets(assets: DataFrame, files: DataFrame, types: tuple[str, ...] = IMAGE_TYPES) -> DataFrame:
    """Each asset's file: the first candidate path that exists, literal first; null where none does. assets: project, asset. files: project, path. An equi join on the candidates."""
    tried = assets.select("project", "asset", F.posexplode(F.transform(F.array(*map(F.lit, types)), lambda t: F.concat(F.col("asset"), t))).alias("pos", "path"))
    found = tried.join(files.select("project", "path"), ["project", "path"]).groupBy("project", "asset").agg(F.min_by("path", "pos").alias("path"))
    return assets.join(found, ["project", "asset"], "left")


def running_state(events: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The last value set before or at each row, by key: an active style, or a flag's state at use."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("active", F.last(value, ignorenulls=True).over(w))


def mean_similarity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per document the mean of pages present on both sides, each rounded to three places; 0 where there are none. left: doc, page, value; right: doc, page, value."""
    both = left.alias("a").join(right.alias("b"), ["doc", "page"]).select("doc", F.round(1 - F.abs(F.col("a.value") - F.col("b.value")), 3).alias("s"))
    mean = both.groupBy("doc").agg(F.avg("s").alias("mean"))
    return left.select("doc").distinct().join(mean, "doc", "left").select("doc", F.coalesce("mean", F.lit(0.0)).alias("mean_ssim"))


def merge_metadata(parts: DataFrame, fields: list[str], order: str = "pos", ties: tuple[str, ...] = ()) -> DataFrame:
    """First value of each field by project in order of files; of equal places that which comes first by the columns ties. parts: project, order, ties, fields. Rows without a place take no part."""
    place = F.struct(order, *ties)
    return parts.groupBy("project").agg(*[F.min_by(f, F.when(F.col(f).isNotNull() & F.col(order).isNotNull(), place)).alias(f) for f in fields])


def compiler_errors(runs: DataFrame, text: str = "stderr") -> DataFrame:
    """message, line (from 1) and column (from 0) of each error in a compiler's output; errors without a place are left out."""
    pattern = F.lit(r"error: ([^\n]*)\n[^\n]*?:(\d+):(\d+)")
    cols = F.arrays_zip(*[F.regexp_extract_all(F.col(text), pattern, g).alias(n) for g, n in ((1, "message"), (2, "line"), (3, "col"))])
    return runs.select("doc", F.posexplode(cols).alias("pos", "e")).select("doc", "pos", "e.message", F.col("e.line").cast("int").alias("line"), F.col("e.col").cast("int").alias("col"))


def brief(warnings: DataFrame) -> DataFrame:
    """A Markdown brief for each paper: its warning kinds, most frequent first, then by name. warnings: paper, kind."""
    counts = warnings.groupBy("paper", "kind").agg(F.count("*").alias("n"))
    ordered = counts.groupBy("paper").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "kind"))).alias("x"))
    lines = F.transform("x", lambda s: F.concat(F.lit("- "), s["kind"], F.lit(": "), (-s["less"]).cast("string")))
    return ordered.select("paper", F.concat(F.lit("# Warnings\n\n"), F.array_join(lines, "\n")).alias("brief"))


def replace_block(text: Column, name: str, body: Column) -> Column:
    """text with what stands between the markers of a block replaced; text without markers stays as it is."""
    begin, end = f"<!-- {name}:begin -->", f"<!-- {name}:end -->"
    head, tail = F.substring_index(text, begin, 1), F.substring_index(text, end, -1)
    whole = F.contains(text, F.lit(begin)) & F.contains(text, F.lit(end))
    return F.when(whole, F.concat(head, F.lit(begin + "\n"), body, F.lit("\n" + end), tail)).otherwise(text)
