"""Gates and regressions: verdict projections, baseline comparison, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

# Fixed values of the gates.
WEIGHTS = {"word_recall": 0.35, "heading_recall": 0.25, "mean_ssim": 0.2, "page_closeness": 0.2}
STRUCTURE = {"page_ratio": (0.70, 1.30), "word_jaccard": 0.55, "word_recall": 0.65, "heading_recall": 0.60}
SCORE_TOLERANCE, RECALL_TOLERANCE, DOGFOOD_FLOOR, DOGFOOD_EPSILON = 0.02, 0.05, 0.75, 1e-3


def fail_reasons() -> Column:
    """Which structural thresholds a row of metrics misses; null metrics miss none."""
    low, high = STRUCTURE["page_ratio"]
    rules = [F.when(~F.col("page_ratio").between(low, high), F.lit("page_ratio"))]
    rules += [F.when(F.col(c) < F.lit(STRUCTURE[c]), F.lit(c)) for c in ("word_jaccard", "word_recall", "heading_recall")]
    return F.array_compact(F.array(*rules))


def composite() -> Column:
    """Weighted fidelity of a complete row of metrics; null where one is missing."""
    parts = {**{c: F.col(c) for c in ("word_recall", "heading_recall", "mean_ssim")}, "page_closeness": T.closeness("page_ratio")}
    total = None
    for name, weight in WEIGHTS.items():
        part = parts[name] * F.lit(weight)
        total = part if total is None else total + part
    return total


def doctor_verdict(input_compiles: Column, output_compiles: Column) -> Column:
    """Two nullable booleans to one of four verdicts."""
    return (
        F.when(input_compiles.isNull(), "tectonic_unavailable")
        .when(~input_compiles, "input_broken")
        .when(F.coalesce(~output_compiles, F.lit(False)), "converter_bug")
        .otherwise("ok")
    )


def acceptance(verdicts: DataFrame, baseline: DataFrame) -> DataFrame:
    """verdicts: id, verdict. baseline: id, known ('pass' or 'fail'). Ids that regressed, were fixed, or fail anew, each with its class."""
    failed = verdicts.where("verdict = 'CONVERT_FAIL'").select("id").distinct()
    passed = verdicts.where("verdict = 'PASS'").select("id").distinct()
    known = {k: baseline.where(F.col("known") == k).select("id").distinct() for k in ("pass", "fail")}
    return (
        known["pass"].intersect(failed).withColumn("class", F.lit("regression"))
        .unionByName(known["fail"].intersect(passed).withColumn("class", F.lit("fixed")))
        .unionByName(failed.join(baseline.select("id"), "id", "left_anti").withColumn("class", F.lit("new_failure")))
    )


def fidelity_diff(run: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rows present in both whose score or recalls fell beyond the tolerances, and whether they did. Both: id, score, word_recall, heading_recall."""
    both = run.alias("r").join(baseline.alias("b"), "id")
    drop = {c: F.col(f"b.{c}") - F.col(f"r.{c}") for c in ("score", "word_recall", "heading_recall")}
    bad = (drop["score"] > SCORE_TOLERANCE) | (drop["word_recall"] > RECALL_TOLERANCE) | (drop["heading_recall"] > RECALL_TOLERANCE)
    return both.select("id", *(d.alias(f"{c}_drop") for c, d in drop.items()), F.coalesce(bad, F.lit(False)).alias("regressed"))


def findings_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Full outer on (paper, dimension); a missing side is a match of severity 0."""
    keys = ["paper", "dimension"]
    a, b = (x.select(*keys, F.col("verdict").alias(f"verdict_{n}"), F.col("severity").alias(f"severity_{n}")) for x, n in ((before, "before"), (after, "after")))
    both = a.join(b, keys, "full_outer")
    for n in ("before", "after"):
        both = both.withColumn(f"verdict_{n}", F.coalesce(f"verdict_{n}", F.lit("match"))).withColumn(f"severity_{n}", F.coalesce(f"severity_{n}", F.lit(0)))
    change = F.col("severity_after") - F.col("severity_before")
    return both.withColumn("change", F.when(change > 0, "regressed").when(change < 0, "improved").otherwise("same"))


def rank_candidates(papers: DataFrame) -> DataFrame:
    """Hardest first: known failures, then structure failures, then the rest, each by recall (null as 0.5) and id. papers: id, known_fail, structure_ok, word_recall."""
    tier = F.when(F.col("known_fail"), 0).when(~F.col("structure_ok"), 1).otherwise(2)
    return papers.select("id", tier.alias("tier"), F.coalesce("word_recall", F.lit(0.5)).alias("recall")).orderBy("tier", "recall", "id")


def dogfood_verdict() -> Column:
    """Ordered rules over compiled, stuck (count), recall_before, recall_after, mismatch."""
    after, before = F.col("recall_after"), F.col("recall_before")
    return (
        F.when(~F.col("compiled"), "not_compiled")
        .when(F.col("mismatch"), "self_report_mismatch")
        .when(after.isNull(), "unscored")
        .when(after < before - DOGFOOD_EPSILON, "regressed")
        .when(after < DOGFOOD_FLOOR, "below_floor")
        .when(F.col("stuck") > 0, "stuck")
        .otherwise("clean")
    )
