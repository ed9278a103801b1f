"""Queries over project rules, each beside its DuckDB twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.operators import projects as P
from quillspark.plans.relational import query, table
from quillspark.sources import shared
from quillspark.streaming import dedup


def pick(column: str, *values: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(column, F.lit(len(values))) + 1).cast("int"))


@query("SELECT doc_id, doc_id % 3 = 0 AS toplevel FROM documents")
def toplevel_strict(spark, sf_dir):
    head = pick("doc_id", "\\documentclass[a]{article}\n\\begin{document}", "% \\documentclass{article}\n\\begin{document}", "\\documentclass{article}\n% \\begin{document}")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("content"))
    return docs.select("doc_id", P.is_toplevel(F.col("content")).alias("toplevel"))


@query("SELECT doc_id AS doc, 'own' || doc_id % 7 AS name FROM documents UNION ALL SELECT doc_id, 'mystyle' FROM documents WHERE doc_id % 2 = 0")
def noop_packages(spark, sf_dir):
    head = F.concat(F.lit("\\usepackage[x]{amsmath, own"), F.col("doc_id") % 7, F.lit("}\\usepackage{booktabs}"), F.when(F.col("doc_id") % 2 == 0, "\\RequirePackage{mystyle}\\usepackage{mystyle,tikz}").otherwise(""))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.concat(head, F.coalesce("text", F.lit(""))).alias("content"))
    return P.effective_packages(P.packages(docs)).select("doc", "name")


@query("SELECT doc_id AS id, CASE WHEN quality = 0 THEN 'truth_render_failed' WHEN quality = 1 THEN 'ok' END AS status FROM (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY doc_id) WHERE quality IS NULL OR quality <> 0 OR toxic = 1")
def scoreable_papers(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    papers = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, "truth_render_failed").when(F.col("quality") == 1, "ok").alias("status"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("known_fail"))
    return P.scoreable(papers).select("id", "status")


@query("SELECT 'f' || d.doc_id || '.json' AS file, d.n_chars AS value_before, strlen(coalesce(p.html, ''))::BIGINT AS value_after FROM documents d JOIN pages p ON p.page_id = d.doc_id")
def findings_by_file(spark, sf_dir):
    name = lambda folder, key: F.concat(F.lit(folder), key, F.lit(".json"))
    before = table(spark, sf_dir, "documents").select(name("a/f", F.col("doc_id")).alias("path"), F.col("n_chars").alias("value"))
    after = table(spark, sf_dir, "pages").select(name("b/c/f", F.col("page_id")).alias("path"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("value"))
    return P.by_file_name(before, after).select("file", "value_before", "value_after")


@query("""WITH m AS (SELECT l_orderkey AS paper, l_suppkey AS author, l_linenumber AS pos, l_partkey % 5 AS mark FROM lineitem), g AS (SELECT DISTINCT paper, mark, 'Place ' || mark AS place FROM m WHERE mark > 0)
SELECT paper, author, string_agg(place, '; ' ORDER BY pos, place) AS places FROM m LEFT JOIN g USING (paper, mark) GROUP BY ALL""")
def affiliation_marks(spark, sf_dir):
    marks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_suppkey").alias("author"), F.col("l_linenumber").alias("pos"), F.pmod("l_partkey", F.lit(5)).alias("mark"))
    legend = marks.where("mark > 0").select("paper", "mark", F.concat(F.lit("Place "), "mark").alias("place")).distinct()
    return P.affiliations(marks, legend)


@query("SELECT doc_id // 4 AS project, bool_or(doc_id % 5 = 0) AS chapters FROM documents GROUP BY 1")
def chapter_use(spark, sf_dir):
    head = F.when(F.col("doc_id") % 5 == 0, "text \\chapter{A}\n").otherwise("% \\chapter{A}\n\\chaptermark{x}\n")
    files = table(spark, sf_dir, "documents").select(F.expr("doc_id div 4").alias("project"), F.concat(head, F.coalesce("text", F.lit(""))).alias("content"))
    return P.uses_chapters(files)


@query("SELECT p_partkey, greatest(2 + p_size % 3, 2 + CASE WHEN p_size % 2 = 0 THEN 1 + p_size % 3 ELSE 0 END)::INT AS columns FROM part")
def row_occupancy(spark, sf_dir):
    """Two rows: a plain cell and one over some columns, which in every second table covers the row below; and two plain cells."""
    cell = lambda c, r: F.struct(c.cast("int").alias("colspan"), r.cast("int").alias("rowspan"))
    one, size = F.lit(1), F.col("p_size")
    rows = F.array(F.array(cell(one, one), cell(1 + size % 3, F.when(size % 2 == 0, 2).otherwise(1))), F.array(cell(one, one), cell(one, one)))
    return table(spark, sf_dir, "part").select("p_partkey", P.occupancy(rows).alias("columns"))


@query("SELECT doc_id AS doc, 0 AS \"row\", 0 AS first, 2 AS stop FROM documents UNION ALL SELECT doc_id, 1, 1, (3 + doc_id % 4)::INT FROM documents")
def partial_rules(spark, sf_dir):
    body = F.concat(F.lit("a & b \\\\ \\cmidrule(lr){1-2} "), F.translate(F.coalesce("text", F.lit("")), "\\", "/"), F.lit(" \\\\ \\cmidrule[1pt](r){2-"), 3 + F.col("doc_id") % 4, F.lit("} c"))
    return P.partial_rules(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), body.alias("body")))


@query(r"""WITH l AS (SELECT doc_id AS doc, unnest(string_split(coalesce(text, ''), chr(10))) AS content, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents),
m AS (SELECT doc, line, content || CASE line % 3 WHEN 0 THEN ' $ x' WHEN 1 THEN ' \$ \\$' ELSE '' END AS content FROM l)
SELECT doc, line::INT AS line, coalesce(sum(length(regexp_replace(regexp_replace(content, '\\.', '', 'g'), '[^$]', '', 'g'))) OVER (PARTITION BY doc ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM m""")
def dollar_parity(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "content")).withColumn("line", F.col("pos") + 1)
    tail = F.when(F.col("line") % 3 == 0, " $ x").when(F.col("line") % 3 == 1, " \\$ \\\\$").otherwise("")
    return P.inside_math(lines.withColumn("content", F.concat("content", tail)))


@query("SELECT doc_id AS doc, (1 + k)::INT AS line FROM documents, (SELECT unnest([0, 2, 4]) AS k)")
def display_leak_scan(spark, sf_dir):
    text = F.concat(F.array(*map(F.lit, ["a \\[1\\] b", "a \\[dB\\] b", "a \\[x^2 + y\\]", "see \\[fig 1\\]", "\\[ open", "// \\[1\\]"])), F.split(F.coalesce("text", F.lit("")), "\n"))
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(text).alias("pos", "content")).withColumn("line", F.col("pos") + 1)
    return P.display_leaks(lines)


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '../b/f' || doc_id WHEN 1 THEN '.' WHEN 2 THEN 'c/d' || doc_id ELSE '../../x' END AS seen, doc_id % 4 <> 3 AS inside, CASE doc_id % 4 WHEN 0 THEN '/a/b' WHEN 1 THEN '/a' WHEN 2 THEN '/a/c' ELSE '/' END AS folder FROM documents")
def path_rules(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(F.concat(F.lit("/a/b/f"), i), F.lit("/a/e"), F.concat(F.lit("/a/c/d"), i), F.lit("/x")), (F.pmod("doc_id", F.lit(4)) + 1).cast("int")).alias("target"), pick("doc_id", "/a/e", "/a/e", "/a", "/a/b").alias("base"), pick("doc_id", "a/../b", "./c", "d//e", "a/../../b").alias("path"))
    folder = P.parent(F.when(F.col("target") == "/x", F.lit("//x")).otherwise(F.col("target")))
    return rows.select("doc_id", P.relative(F.col("target"), F.col("base")).alias("seen"), P.within(F.col("path")).alias("inside"), folder.alias("folder"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN 'v' || doc_id END AS verdict FROM documents")
def report_json(spark, sf_dir):
    body = F.concat(F.lit('{"verdict": "v'), "doc_id", F.lit('"}'))
    said = F.regexp_replace(F.coalesce("text", F.lit("")), "[`{}]", "")
    text = F.when(F.col("doc_id") % 4 == 0, body).when(F.col("doc_id") % 4 == 1, F.concat(said, F.lit("\n```json\n"), body, F.lit("\n```\nbye"))).when(F.col("doc_id") % 4 == 2, F.concat(said, F.lit(" so "), body, F.lit(" end"))).otherwise(said)
    return table(spark, sf_dir, "documents").select("doc_id", P.report(text, "verdict string")["verdict"].alias("verdict"))


@query("SELECT DISTINCT user_id AS project, event_type AS key FROM events")
def stream_first_seen(spark, sf_dir):
    """Keys that arrive in files, passed on when they are first seen."""
    root = f"{shared.folder(spark)}/seen-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("project"), F.col("event_type").alias("key"))
    rows.repartition(4).write.json(f"{root}/in")
    dedup.start(spark, f"{root}/in", rows.schema, ["project", "key"], f"{root}/out", f"{root}/log").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/out")
