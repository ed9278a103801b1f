"""Queries over papers as rows, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import papers as P
from quillspark.plans.relational import WARNINGS, query, table, warnings


@query("SELECT p_partkey, CASE WHEN contains(lower(p_type || p_brand), 'beamer') THEN 'beamer' WHEN p_partkey % 3 = 0 THEN 'thesis' WHEN p_partkey % 3 = 1 THEN 'book' ELSE 'article' END AS kind FROM part")
def doc_type_infer(spark, sf_dir):
    name = F.concat("p_type", F.element_at(F.array(*map(F.lit, ["-Thesis-book", "-BOOK", ""])), (F.pmod("p_partkey", F.lit(3)) + 1).cast("int")), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", P.doc_type(name).alias("kind"))


@query("SELECT p_partkey, ['icml', 'llncs', 'unknown', 'article'][p_partkey % 4 + 1] AS venue FROM part")
def venue_label(spark, sf_dir):
    sources = ["\\documentclass[11pt]{article}\\usepackage{x}\\usepackage[a]{icml2026,y}", "\\documentclass{llncs}\\usepackage{neurips}", "no class", "\\documentclass{article}"]
    source = F.element_at(F.array(*map(F.lit, sources)), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", P.venue(source).alias("venue"))


@query("SELECT DISTINCT l_orderkey AS project, 'fig' || l_linenumber AS asset, CASE l_linenumber % 3 WHEN 0 THEN 'fig' || l_linenumber WHEN 1 THEN 'fig' || l_linenumber || '.pdf' END AS path FROM lineitem")
def asset_probe(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project"), F.concat(F.lit("fig"), "l_linenumber").alias("asset"), (F.col("l_linenumber") % 3).alias("r")).distinct()
    found = F.when(F.col("r") == 0, F.array(F.lit(""), F.lit(".png"))).when(F.col("r") == 1, F.array(F.lit(".png"), F.lit(".pdf"))).otherwise(F.array(F.lit(".eps")))
    files = lines.select("project", F.explode(F.transform(found, lambda x: F.concat(F.col("asset"), x))).alias("path"))
    return P.probe_assets(lines.select("project", "asset"), files)


@query("""SELECT user_id, event_id, last_value(CASE WHEN event_id % 4 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS active FROM events""")
def theorem_style(spark, sf_dir):
    """The style that is active at each use, in document order."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("style"))
    return P.running_state(events, ["user_id"], ["ts", "event_id"], "style").select("user_id", "event_id", "active")


@query("""WITH t AS (SELECT conv_id AS doc, turn // 2 AS page, turn % 2 AS side, max(length(text) % 100)::DOUBLE / 100 AS v FROM conversations GROUP BY ALL)
SELECT doc, round(coalesce(avg(s), 0), 6) AS mean_ssim FROM (SELECT a.doc, CASE WHEN b.v IS NOT NULL THEN round(1 - abs(a.v - b.v), 3) END AS s FROM t a LEFT JOIN t b ON b.doc = a.doc AND b.page = a.page AND b.side = 1 WHERE a.side = 0) GROUP BY doc""")
def mean_similarity(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc"), F.expr("turn div 2").alias("page"), (F.col("turn") % 2).alias("side")).agg((F.max(F.length("text") % 100).cast("double") / 100).alias("value"))
    left, right = (t.where(F.col("side") == k).select("doc", "page", "value") for k in (0, 1))
    return P.mean_similarity(left, right).select("doc", F.round("mean_ssim", 6).alias("mean_ssim"))


@query("""SELECT l_orderkey AS project, arg_min(l_returnflag || l_partkey, l_linenumber * 100000 + l_partkey) FILTER (WHERE l_returnflag = 'R') AS title, arg_min(l_linestatus || l_partkey, l_linenumber * 100000 + l_partkey) FILTER (WHERE l_linestatus = 'O') AS author FROM lineitem GROUP BY l_orderkey""")
def metadata_merge(spark, sf_dir):
    """Two lines of an order can have the same place; then the one that the table has first counts."""
    row = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("pos"), *row, F.when(F.col("l_returnflag") == "R", F.concat("l_returnflag", "l_partkey")).alias("title"), F.when(F.col("l_linestatus") == "O", F.concat("l_linestatus", "l_partkey")).alias("author"))
    return P.merge_metadata(lines, ["title", "author"], ties=("file", "row"))


@query("SELECT doc_id AS doc, 0 AS pos, 'unknown variable: x' || doc_id AS message, (doc_id % 90 + 1)::INT AS line, 4 AS col FROM documents UNION ALL SELECT doc_id, 1, 'expected comma', 7, 0 FROM documents WHERE doc_id % 2 = 0")
def compiler_errors(spark, sf_dir):
    text = F.concat(F.lit("warning: odd\n  a.typ:1:1\nerror: unknown variable: x"), "doc_id", F.lit("\n  ┌─ a.typ:"), F.col("doc_id") % 90 + 1, F.lit(":4\n"), F.when(F.col("doc_id") % 2 == 0, "error: expected comma\n  ┌─ b.typ:7:0\n").otherwise("error: no place\n"))
    return P.compiler_errors(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), text.alias("stderr")))


@query(WARNINGS + "SELECT paper, '# Warnings' || chr(10) || chr(10) || string_agg('- ' || kind || ': ' || n, chr(10) ORDER BY n DESC, kind) AS brief FROM (SELECT paper, kind, count(*) AS n FROM w GROUP BY ALL) GROUP BY paper")
def agent_brief(spark, sf_dir):
    return P.brief(warnings(spark, sf_dir))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a<!-- s:begin -->' || chr(10) || 'N' || doc_id || chr(10) || '<!-- s:end -->z' ELSE 'plain' END AS text FROM documents")
def marked_block(spark, sf_dir):
    text = F.when(F.col("doc_id") % 2 == 0, "a<!-- s:begin -->\nold\n<!-- s:end -->z").otherwise("plain")
    return table(spark, sf_dir, "documents").select("doc_id", P.replace_block(text, "s", F.concat(F.lit("N"), "doc_id")).alias("text"))
