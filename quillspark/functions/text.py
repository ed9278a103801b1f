"""Column builders for text: tokens, label keys, comments, counters, recall and sequence scores. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def word_tokens(text: ColumnOrName) -> Column:
    """ASCII words of three letters or more, lower-cased; null gives an empty list."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit("[a-z]{3,}"), 0)


def label_key(key: ColumnOrName) -> Column:
    """Characters other than letters, digits and _ : . - become a dash, runs of dashes one, outer dashes go."""
    dashed = F.regexp_replace(F.regexp_replace(_c(key), r"[^\p{L}\p{N}_:.\-]", "-"), "-+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def strip_comments(source: ColumnOrName) -> Column:
    """Drop what follows an unescaped percent sign on each line."""
    return F.regexp_replace(_c(source), r"((?:^|[^\\])(?:\\\\)*)%[^\n]*", "$1")


def set_recall(truth: ColumnOrName, found: ColumnOrName) -> Column:
    """Share of truth's distinct words in found; 0 where truth is empty."""
    want = F.array_distinct(_c(truth))
    return F.when(F.size(want) > 0, F.size(F.array_intersect(want, _c(found))) / F.size(want)).otherwise(F.lit(0.0))


def jaccard(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Shared over all distinct words; 0 where both are empty."""
    either = F.size(F.array_union(_c(a), _c(b)))
    return F.when(either > 0, F.size(F.array_intersect(_c(a), _c(b))) / either).otherwise(F.lit(0.0))


def safe_ratio(found: ColumnOrName, truth: ColumnOrName) -> Column:
    """found / truth, null where truth is 0."""
    return F.when(_c(truth) != 0, _c(found) / _c(truth))


def closeness(ratio: ColumnOrName) -> Column:
    """min(r, 1/r); null where r isn't positive."""
    r = _c(ratio)
    return F.when(r > 0, F.least(r, 1 / r))


def heading_key(heading: ColumnOrName) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(heading)), r"[^a-z0-9]+", " "))


def heading_recall(truth: ColumnOrName, found: ColumnOrName) -> Column:
    """Share of truth's headings that contain, or are contained in, one that was found; 1 where truth is empty."""
    keys = F.transform(_c(found), heading_key)
    hits = F.filter(F.transform(_c(truth), heading_key), lambda t: F.exists(keys, lambda f: F.contains(f, t) | F.contains(t, f)))
    return F.when(F.size(_c(truth)) > 0, F.size(hits) / F.size(_c(truth))).otherwise(F.lit(1.0))


def sequence_score(truth: ColumnOrName, found: ColumnOrName) -> Column:
    """Longest common subsequence over truth's length, by folding one row of the table over the other; 1 where truth is empty."""
    zeros = F.transform(F.sequence(F.lit(0), F.size(_c(found))), lambda _: F.lit(0))

    def row(before: Column, t: Column) -> Column:
        def cell(made: Column, f: Column, i: Column) -> Column:
            diagonal, above, left = F.element_at(before, i), F.element_at(before, i + 1), F.element_at(made, -1)
            return F.concat(made, F.array(F.when(F.equal_null(t, f), diagonal + 1).otherwise(F.greatest(above, left))))

        pairs = F.transform(_c(found), lambda f, i: F.struct(f.alias("f"), (i + 1).cast("int").alias("i")))
        return F.aggregate(pairs, F.array(F.lit(0)), lambda made, p: cell(made, p["f"], p["i"]))

    best = F.element_at(F.aggregate(_c(truth), zeros, row), -1)
    return F.when(F.size(_c(truth)) > 0, best / F.size(_c(truth))).otherwise(F.lit(1.0))


def year(date: ColumnOrName) -> Column:
    """The first number of four digits from 1000 to 2999, else null."""
    found = F.regexp_extract(_c(date), "([12][0-9]{3})", 1)
    return F.when(found != "", found)


def color(model: ColumnOrName, spec: ColumnOrName) -> Column:
    """A colour of one of the models HTML, RGB, rgb, gray and cmyk in the target's notation; a null for others."""
    m, s = _c(model), F.regexp_replace(_c(spec), " ", "")
    parts = F.split(s, ",")
    hexa = [F.conv(F.substring(s, i, 2), 16, 10) for i in (1, 3, 5)]

    def percent(x: Column) -> Column:
        return F.concat(F.round(x.try_cast("double") * 100, 0).cast("int").cast("string"), F.lit("%"))

    def each(n: int) -> list[Column]:
        return [percent(F.try_element_at(parts, F.lit(i + 1))) for i in range(n)]

    return (
        F.when(m == "HTML", F.concat(F.lit("rgb("), F.concat_ws(", ", *hexa), F.lit(")")))
        .when(m == "RGB", F.concat(F.lit("rgb("), F.array_join(parts, ", "), F.lit(")")))
        .when(m == "rgb", F.concat(F.lit("rgb("), F.concat_ws(", ", *each(3)), F.lit(")")))
        .when(m == "gray", F.concat(F.lit("luma("), percent(s), F.lit(")")))
        .when(m == "cmyk", F.concat(F.lit("cmyk("), F.concat_ws(", ", *each(4)), F.lit(")")))
    )


def packed_width(widths: ColumnOrName, limit: float = 1.05) -> Column:
    """Columns of the widest row when items are packed greedily; a null width breaks a row; at least 1."""
    start = F.struct(F.lit(1).alias("most"), F.lit(0).alias("n"), F.lit(0.0).alias("w"))

    def step(s: Column, w: Column) -> Column:
        joins = s["w"] + w <= limit
        n = F.when(w.isNull(), 0).when(joins, s["n"] + 1).otherwise(1)
        total = F.when(w.isNull(), 0.0).when(joins, s["w"] + w).otherwise(w)
        return F.struct(F.greatest(s["most"], n).alias("most"), n.alias("n"), total.alias("w"))

    return F.aggregate(_c(widths), start, step, lambda s: s["most"])
