"""Corpus analytics: histograms, audits, harvested labels, citations, bibliographies, includes, diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.shared import written

# The warning kinds and the guide that explains each.
GUIDES = {"unsupported_command": "unsupported-commands", "unsupported_environment": "environments", "custom_macro": "macros", "ambiguous_math": "math", "drop_only": "dropped-commands", "needs_manual_review": "manual-review", "parse_error": "parse-errors"}

#: The column specification of a table.
COLUMN_SPEC = r"\\begin\{(?:tabular[*x]?|array)\}\s*(?:\[[^\]]*\])?\s*(?:\{[^}]*\})?\{([^}]*)\}"

# Source constructs that are lost silently: cluster, label, pattern, and whether it is counted in column specifications only.
SILENT_GAPS = [
    ("float-sizing/tables", "resizebox", r"\\resizebox\b", False),
    ("float-sizing/tables", "column widths", r"[pmb]\{", True),
    ("float-sizing/tables", "column decorators", r"[><@!]\{", True),
    ("float-sizing/tables", "cmidrule", r"\\cmidrule\b", False),
    ("color/spacing", "textcolor", r"\\textcolor\b", False),
    ("color/spacing", "colorbox", r"\\f?colorbox\b", False),
    ("color/spacing", "definecolor", r"\\definecolor\b", False),
    ("color/spacing", "vspace/hspace", r"\\[vh]space\*?\b", False),
    ("color/spacing", "skips", r"\\(?:small|med|big)skip\b", False),
    ("lists/theorems", "item label", r"\\item\s*\[", False),
    ("lists/theorems", "enumerate style", r"\\begin\{enumerate\}\s*\[", False),
    ("lists/theorems", "labelenum", r"\\renewcommand\s*\{\\labelenum", False),
    ("lists/theorems", "theorem note", r"\\begin\{(?:theorem|lemma|corollary|proposition|definition|remark|example|claim|conjecture|proof)\}\s*\[", False),
]


def histogram(warnings: DataFrame) -> DataFrame:
    """Warnings by kind, with the kind's guide; most frequent first. warnings: kind."""
    guide = F.create_map(*[F.lit(x) for pair in GUIDES.items() for x in pair])
    return warnings.groupBy("kind").agg(F.count("*").alias("n")).withColumn("guide", guide[F.col("kind")]).orderBy(F.desc("n"), "kind")


def severity_and_kind(warnings: DataFrame) -> DataFrame:
    """Counts by severity and, apart, by kind, in one pass; missing values count as unknown."""
    w = warnings.select(F.coalesce("severity", F.lit("unknown")).alias("severity"), F.coalesce("kind", F.lit("unknown")).alias("kind"))
    return w.groupingSets([[F.col("severity")], [F.col("kind")]], F.col("severity"), F.col("kind")).agg(F.count("*").alias("n"))


def audit(warnings: DataFrame, top: int = 40) -> DataFrame:
    """The constructs that touch most papers: distinct papers and occurrences by (kind, name)."""
    return warnings.groupBy("kind", "name").agg(F.countDistinct("paper").alias("papers"), F.count("*").alias("occurrences")).orderBy(F.desc("papers"), F.desc("occurrences"), "kind", "name").limit(top)


def silent_gaps(sources: DataFrame, text: str = "content") -> DataFrame:
    """How many sources hold each construct that is dropped without a word, and how often."""
    specs = F.array_join(F.regexp_extract_all(F.col(text), F.lit(COLUMN_SPEC), 1), " ")
    counts = [(c, label, F.regexp_count(specs if inside else F.col(text), F.lit(p))) for c, label, p, inside in SILENT_GAPS]
    found = F.explode(F.array(*[F.struct(F.lit(c).alias("cluster"), F.lit(label).alias("label"), n.alias("n")) for c, label, n in counts]))
    return sources.select(found.alias("x")).select("x.*").where("n > 0").groupBy("cluster", "label").agg(F.count("*").alias("papers"), F.sum("n").alias("occurrences"))


def first_wins(entries: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first entry of each key in order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return entries.withColumn("place", place).where("place = 1").drop("place")


def last_wins(definitions: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The last definition of each key in order; needs no sort, only one aggregate."""
    return definitions.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def undefined(used: DataFrame, defined: DataFrame, keys: list[str]) -> DataFrame:
    """Keys in use that nothing defines; a project without any definition isn't checked."""
    checked = defined.select(keys[0]).distinct()
    return used.join(checked, keys[0], "left_semi").join(defined.select(*keys).distinct(), keys, "left_anti")


def dangling(used: DataFrame, labels: DataFrame, bib: DataFrame, keys: list[str]) -> DataFrame:
    """References that neither a label nor a bibliography entry resolves."""
    return used.select(*keys).distinct().join(labels, keys, "left_anti").join(bib, keys, "left_anti")


def alias(labels: Column, referenced: Column) -> Column:
    """The first label that is referenced, else the first one."""
    hit = F.filter(labels, lambda x: F.array_contains(referenced, x))
    return F.coalesce(F.try_element_at(hit, F.lit(1)), F.try_element_at(labels, F.lit(1)))


def entry_files(files: DataFrame) -> DataFrame:
    """Each project's entry: the one file with a document class; none and several are errors with their candidates. files: project, path, content."""
    declares = F.exists(F.split("content", "\n"), lambda line: ~F.startswith(F.ltrim(line), F.lit("%")) & F.contains(line, F.lit("\\documentclass")))
    found = files.groupBy("project").agg(F.array_sort(F.collect_list(F.when(declares, F.col("path")))).alias("candidates"))
    kind = F.when(F.size("candidates") == 0, "no_entry_file").when(F.size("candidates") > 1, "ambiguous_entry_file")
    return found.select("project", F.when(F.size("candidates") == 1, F.element_at("candidates", 1)).alias("entry"), kind.alias("error"), F.array_join("candidates", ",").alias("candidates"))


def include_closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Files reached from each root over includes, with the least depth; cycles end because a file is taken once. edges: parent, child. roots: root.

    Rounds go on until one reaches nothing new; each is written, so that long chains don't lengthen the lineage.
    """
    front = written(roots.select("root", F.col("root").alias("file"), F.lit(0).alias("depth")), "includes")
    rounds, level = [front], 0
    while not front.isEmpty():
        level += 1
        reached = reduce(DataFrame.unionByName, rounds)
        new = front.join(edges, F.col("file") == F.col("parent")).select("root", F.col("child").alias("file"), F.lit(level).alias("depth")).distinct()
        front = written(new.join(reached.select("root", "file"), ["root", "file"], "left_anti"), "includes")
        rounds.append(front)
        if len(rounds) > 16:
            rounds = [written(reduce(DataFrame.unionByName, rounds), "includes")]
    return reduce(DataFrame.unionByName, rounds)


def pages(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pages of both sides by number; the longer side's pages stay. left, right: doc, page, and a value each."""
    return left.join(right, ["doc", "page"], "full_outer")


def overlapping(spans: DataFrame, warnings: DataFrame, width: int = 1024) -> DataFrame:
    """For each span the guide of its first overlapping warning (in order). Both sides are dealt to buckets of offsets, so the join is an equi join."""
    def bucketed(df: DataFrame, a: str, b: str) -> DataFrame:
        low, high = F.floor(F.col(a) / width), F.floor((F.greatest(F.col(b), F.col(a) + 1) - 1) / width)
        return df.withColumn("bucket", F.explode(F.sequence(low, high)))

    s, w = bucketed(spans, "start", "end"), bucketed(warnings, "w_start", "w_end")
    hit = s.join(w, ["doc", "bucket"]).where("w_start < end and w_end > start")
    return hit.groupBy("doc", "start", "end").agg(F.min_by("guide", F.struct("pos", "guide")).alias("guide"), F.min("pos").alias("pos"))


def leaks(lines: DataFrame) -> DataFrame:
    """Commands that leaked into output, once per name and line, outside of fences and comment lines. lines: doc, line, content."""
    fence = F.startswith(F.ltrim("content"), F.lit("```"))
    before = F.sum(fence.cast("int")).over(Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = lines.withColumn("open", F.coalesce(before, F.lit(0)) % 2).where(~fence & (F.col("open") == 0) & ~F.startswith(F.ltrim("content"), F.lit("//")))
    names = F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?:^|[^\\])\\([A-Za-z]{2,})"), 1))
    return inside.select("doc", "line", F.explode(names).alias("name"))


def indent(lines: DataFrame) -> DataFrame:
    """Running indent of pseudocode: what all lines before added for the next, plus the line's own change. lines: doc, line, own, next."""
    before = F.sum("next").over(Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    return lines.select("doc", "line", F.greatest(F.lit(0), F.coalesce(before, F.lit(0)) + F.col("own")).alias("indent"))


def fences(files: DataFrame) -> DataFrame:
    """Fenced LaTeX blocks of Markdown, numbered in order. files: doc, content. Bodies of blanks only are skipped."""
    found = files.select("doc", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?ms)^[ \t]*```[ \t]*(?:[lL][aA][tT][eE][xX](?:-[\w-]*)?|[tT][eE][xX])[ \t]*\n(.*?)^[ \t]*```"), 1)).alias("pos", "body")).where(F.col("body").rlike(r"\S"))
    number = F.row_number().over(Window.partitionBy("doc").orderBy("pos")) - 1
    return found.select("doc", F.format_string("c%04d.tex", number).alias("path"), "body")


def errors_to_spans(errors: DataFrame, spans: DataFrame) -> DataFrame:
    """The span that produced each erroneous line. errors: doc, error, token and, where it is known, line. spans: doc, pos, start, end, output.

    First an output that contains the line's token (three characters or more), else one that contains the whole line,
    else one of three characters or more that the line contains, blanks squeezed; of several the shortest, then the first.
    """
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    line = plain(F.col("line")) if "line" in errors.columns else F.lit(None).cast("string")
    output = plain(F.col("output"))
    step = F.when((F.length("token") >= 3) & F.contains("output", F.col("token")), 1).when((line != "") & F.contains(output, line), 2).when((F.length(output) >= 3) & F.contains(line, output), 3)
    hit = errors.join(spans, "doc").withColumn("step", step).where("step is not null")
    best = hit.groupBy("doc", "error").agg(F.min_by(F.struct("start", "end"), F.struct("step", F.length("output"), F.col("pos"))).alias("at"))
    return errors.join(best, ["doc", "error"], "left").select("doc", "error", "at.start", "at.end")
