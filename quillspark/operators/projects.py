"""Project rules as columns and joins: strict entry files, packages without effect, partial rules, row occupancy, dollar parity, affiliations, paths, JSON in free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Packages whose loading has no effect on the output.
NOOP_PACKAGES = """amsmath amssymb amsfonts amsthm amsopn mathtools mathrsfs dsfont stmaryrd bm bbm physics accents nicefrac siunitx rsfso graphicx graphics
xcolor color tikz geometry microtype fancyhdr setspace indentfirst adjustbox float wrapfig placeins subfigure subcaption lineno rotating subfig booktabs
array tabularx longtable arydshln colortbl multirow makecell inputenc fontenc lmodern times helvet courier mathptmx newtxtext newtxmath fontspec babel T1
utf8 cite natbib biblatex hyperref url cleveref varioref nameref backref footmisc verbatim fancyvrb listings minted ulem algorithm algorithmic algorithmicx
algpseudocode enumitem etoolbox xparse ifthen ifpdf iftex textcomp lipsum blindtext authblk caption tcolorbox framed mdframed epstopdf pgf pgfplots comment
xspace pifont xurl xr xr-hyper xfrac type1cm titlesec soul multicol makeidx dirtytalk changepage afterpage ragged2e xstring calc currfile kvoptions fp
thmtools thm-restate ntheorem enumerate paralist mdwlist parskip parskip2 doi gensymb esint mathdots yhmath extarrows extpfeil dutchcal cancel tabulary
tabularray diagbox cellspace cmap fontawesome5 pdfrender ifxetex ifluatex standalone titletoc etoc todonotes overpic numprint totcount neurips_2022
neurips_2023 neurips_2024 neurips_2025 neurips_2026 iclr2024_conference iclr2025_conference iclr_conference icml2024 icml2025 icml2026 acmart IEEEtran
spconf acl acl_natbib imakeidx nomencl tocbibind hyphenat emptypage subfiles import layout mwe pict2e hologo luacolor lua-ul marginnote scrlayer-scrpage
polyglossia xeCJK luatexja arabtex glossaries markdown luaotfload noto bookman tgbonum alphabeta unicode-math lastpage emoji epigraph shellesc""".split()


def is_toplevel(content: Column) -> Column:
    """A document class and the document's beginning, both outside of comments."""
    plain = F.regexp_replace(content, r"(?m)(^|[^\\])%.*$", "$1")
    return plain.rlike(r"\\documentclass\s*(\[[^\]]*\])?\s*\{") & F.contains(plain, F.lit("\\begin{document}"))


def packages(sources: DataFrame, text: str = "content") -> DataFrame:
    """doc and name of every package that is loaded, once."""
    lists = F.regexp_extract_all(F.col(text), F.lit(r"\\(?:usepackage|RequirePackage)\s*(?:\[[^\]]*\])?\s*\{([^{}]*)\}"), 1)
    names = F.transform(F.split(F.array_join(lists, ","), ","), lambda x: F.trim(x))
    return sources.select("doc", F.explode(F.array_distinct(names)).alias("name")).where("name <> ''")


def effective_packages(used: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Packages that aren't known to be without effect. known: name; the fixed list where none is given."""
    if known is None:
        known = used.sparkSession.createDataFrame([(x,) for x in NOOP_PACKAGES], "name string")
    return used.join(F.broadcast(known) if known.count() < 10_000 else known, "name", "left_anti")


def scoreable(papers: DataFrame) -> DataFrame:
    """Papers that can be scored: those whose truth didn't render only if they are known failures. papers: status, known_fail."""
    return papers.where("not (status <=> 'truth_render_failed') or known_fail")


def by_file_name(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files of two folders that have the same name. Both: path and value."""
    name = F.element_at(F.split("path", "/"), -1)
    a, b = (x.select(name.alias("file"), F.col("path").alias(f"path_{n}"), F.col("value").alias(f"value_{n}")) for x, n in ((before, "before"), (after, "after")))
    return a.join(b, "file")


def affiliations(marks: DataFrame, legend: DataFrame) -> DataFrame:
    """Each author's affiliations in order of their marks, joined; null without one. marks: paper, author, pos, mark. legend: paper, mark, place."""
    found = marks.join(legend, ["paper", "mark"], "left").groupBy("paper", "author").agg(F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("pos", "place")))).alias("x"))
    return found.select("paper", "author", F.when(F.size("x") > 0, F.array_join(F.transform("x", lambda s: s["place"]), "; ")).alias("places"))


def uses_chapters(files: DataFrame) -> DataFrame:
    """Whether any file of a project has a chapter. files: project, content."""
    return files.groupBy("project").agg(F.bool_or(F.coalesce(F.col("content"), F.lit("")).rlike(r"(?m)^[^%\n]*\\chapter\*?\s*[\[{]")).alias("chapters"))


def occupancy(rows: Column) -> Column:
    """The most columns that any row of a table takes, cells from above included. rows: array of arrays of struct<colspan, rowspan>."""
    zero = F.lit(0)
    deepest = F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform(F.flatten(rows), lambda c: c["rowspan"])), F.lit(1)))
    start = F.struct(F.array_repeat(zero, deepest).alias("carry"), zero.alias("most"))

    def step(state: Column, row: Column) -> Column:
        own = F.aggregate(row, zero, lambda n, c: n + c["colspan"])
        carry = F.transform(F.sequence(zero, deepest - 1), lambda k: F.coalesce(F.try_element_at(state["carry"], k + 2), zero) + F.aggregate(row, zero, lambda n, c: n + F.when(c["rowspan"] - 1 > k, c["colspan"]).otherwise(zero)))
        return F.struct(carry.alias("carry"), F.greatest(state["most"], own + F.element_at(state["carry"], 1)).alias("most"))

    return F.aggregate(rows, start, step, lambda s: s["most"])


def partial_rules(tables: DataFrame, text: str = "body") -> DataFrame:
    """Partial rules of a table's body: the row that they stand below (line breaks so far less one, at least 0), first column from 0 and the one after the last."""
    pieces = tables.select("doc", F.posexplode(F.split(F.col(text), r"\\\\")).alias("breaks", "piece"))
    pattern = F.lit(r"\\cmidrule\s*(?:(?:\([^)]*\)|\[[^\]]*\])\s*)*\{\s*(\d+)\s*-\s*(\d+)\s*\}")
    found = F.arrays_zip(*[F.regexp_extract_all("piece", pattern, g).alias(n) for g, n in ((1, "a"), (2, "b"))])
    return pieces.select("doc", F.greatest(F.col("breaks") - 1, F.lit(0)).alias("row"), F.explode(found).alias("r")).select("doc", "row", F.greatest(F.col("r.a").cast("int") - 1, F.lit(0)).alias("first"), F.col("r.b").cast("int").alias("stop"))


def inside_math(lines: DataFrame) -> DataFrame:
    """Whether a line begins inside a formula: the number of dollars before it, escaped ones apart, is odd. lines: doc, line, content."""
    dollars = F.length(F.regexp_replace(F.regexp_replace("content", r"\\.", ""), r"[^$]", ""))
    before = F.sum(dollars).over(Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    return lines.select("doc", "line", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("inside"))


def display_leaks(lines: DataFrame) -> DataFrame:
    """Lines with an escaped bracket that is a leak: one that never closes, one around a formula, or around a mark without letters or blanks. lines: doc, line, content."""
    inner = F.regexp_extract_all("content", F.lit(r"(?<!\\)\\\[(.*?)\\\]"), 1)
    mark = F.exists(inner, lambda x: x.rlike(r"[\\^_]") | x.rlike(r"^[^\s\p{L}]+$"))
    opened = F.regexp_count("content", F.lit(r"(?<!\\)\\\["))
    return lines.where(~F.startswith(F.ltrim("content"), F.lit("//")) & (mark | (opened > F.size(inner)))).select("doc", "line")


def relative(target: Column, base: Column) -> Column:
    """target as seen from base, both absolute or both relative to one folder."""
    split = lambda c: F.filter(F.split(c, "/"), lambda x: (x != "") & (x != "."))
    t, b = split(target), split(base)
    places = F.sequence(F.lit(0), F.greatest(F.size(t), F.size(b)))
    differs = F.filter(places, lambda k: ~F.coalesce(F.get(t, k) == F.get(b, k), F.lit(False)))
    common = F.element_at(differs, 1)
    parts = F.concat(F.array_repeat(F.lit(".."), F.size(b) - common), F.slice(t, common + 1, F.size(t)))
    return F.when(F.size(parts) == 0, ".").otherwise(F.array_join(parts, "/"))


def within(path: Column) -> Column:
    """Whether a relative path stays in its folder."""
    depth = F.aggregate(F.split(path, "/"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda s, x: F.struct((s["at"] + F.when(x == "..", -1).when((x == "") | (x == "."), 0).otherwise(1)).alias("at"), F.least(s["low"], s["at"] + F.when(x == "..", -1).otherwise(0)).alias("low")))
    return ~F.startswith(path, F.lit("/")) & (depth["low"] >= 0)


def parent(path: Column) -> Column:
    """The folder of a path, a dot where it has none."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def report(text: Column, schema: str) -> Column:
    """A JSON object out of free text: the whole, else the last fenced block that holds one, else what lies between the first and the last brace; null where nothing parses."""
    whole = F.trim(text)
    read = lambda c: F.when(F.startswith(c, F.lit("{")), F.from_json(c, schema))
    valid = lambda c: F.when(F.get_json_object(c, "$").isNotNull(), read(c))
    fences = F.reverse(F.transform(F.split(whole, "```"), lambda x: F.trim(F.regexp_replace(F.trim(x), "^json", ""))))
    fenced = F.try_element_at(F.filter(fences, lambda x: F.startswith(x, F.lit("{")) & F.get_json_object(x, "$").isNotNull()), F.lit(1))
    sliced = F.regexp_extract(whole, r"(?s)(\{.*\})", 1)
    return F.coalesce(valid(whole), valid(fenced), valid(sliced))
