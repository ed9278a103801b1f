"""The relational queries over the driver's tables, each beside its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import corpus as C
from quillspark.operators import gates as G

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document and of the one after it, as truth and candidate."""
    words = table(spark, sf_dir, "documents").select("doc_id", T.word_tokens("text").alias("words"))
    after = words.select((F.col("doc_id") - 1).alias("doc_id"), F.col("words").alias("found"))
    return words.join(after, "doc_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))


PAIRS = """WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}') AS words FROM documents),
p AS (SELECT a.doc_id, a.words, coalesce(b.words, []) AS found FROM w a LEFT JOIN w b ON b.doc_id = a.doc_id + 1),
m AS (SELECT doc_id, len(words) AS n, len(found) AS k, len(list_distinct(words)) AS d, len(list_distinct(found)) AS e, len(list_intersect(list_distinct(words), list_distinct(found))) AS s FROM p)
"""


@query("SELECT doc_id, len(w)::INT AS n_tokens, len(list_distinct(w))::INT AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}') AS w FROM documents)")
def word_tokens(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", T.word_tokens("text").alias("w"))
    return words.select("doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"))


@query(PAIRS + "SELECT doc_id, CASE WHEN d > 0 THEN s::DOUBLE / d ELSE 0.0::DOUBLE END AS recall, CASE WHEN d + e - s > 0 THEN s::DOUBLE / (d + e - s) ELSE 0.0::DOUBLE END AS jaccard FROM m")
def word_recall(spark, sf_dir):
    return pairs(spark, sf_dir).select("doc_id", T.set_recall("words", "found").alias("recall"), T.jaccard("words", "found").alias("jaccard"))


@query(PAIRS + "SELECT doc_id, CASE WHEN n > 0 THEN k::DOUBLE / n END AS ratio FROM m")
def word_count_ratio(spark, sf_dir):
    return pairs(spark, sf_dir).select("doc_id", T.safe_ratio(F.size("found"), F.size("words")).alias("ratio"))


LABEL = r"trim(regexp_replace(regexp_replace({0}, '[^\p{{L}}\p{{N}}_:.\-]', '-', 'g'), '-+', '-', 'g'), '-')"


@query("SELECT p_partkey, " + LABEL.format("'fig: ' || p_name || ' (' || p_brand || ')'") + " AS label FROM part")
def label_key_sanitize(spark, sf_dir):
    key = F.concat(F.lit("fig: "), "p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", T.label_key(key).alias("label"))


@query(r"SELECT doc_id, md5(regexp_replace(coalesce(text, '') || ' 50\% kept % gone' || chr(10) || '% all gone', '((?:^|[^\\])(?:\\\\)*)%[^\n]*', '\1', 'g')) AS stripped FROM documents")
def comment_strip(spark, sf_dir):
    source = F.concat(F.coalesce("text", F.lit("")), F.lit(" 50\\% kept % gone\n% all gone"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(T.strip_comments(source), "UTF-8")).alias("stripped"))


#: Metrics of a document pair, as a stand-in for a paper and its conversion.
def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    shape = p.select("doc_id", T.set_recall("words", "found").alias("word_recall"), T.jaccard("words", "found").alias("word_jaccard"), T.safe_ratio(F.size("found"), F.size("words")).alias("page_ratio"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    heading = F.pmod("doc_id", F.lit(11)) / 10.0
    return shape.join(labels, "doc_id", "left").select("*", heading.alias("heading_recall"), F.when(F.col("quality").isNotNull(), F.pmod(F.col("doc_id") * 7, F.lit(10)) / 9.0).alias("mean_ssim"))


METRICS = PAIRS + """, l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT m.doc_id, CASE WHEN d > 0 THEN s::DOUBLE / d ELSE 0.0 END AS word_recall, CASE WHEN d + e - s > 0 THEN s::DOUBLE / (d + e - s) ELSE 0.0 END AS word_jaccard,
  CASE WHEN n > 0 THEN k::DOUBLE / n END AS page_ratio, (m.doc_id % 11)::DOUBLE / 10.0::DOUBLE AS heading_recall, CASE WHEN quality IS NOT NULL THEN ((m.doc_id * 7) % 10)::DOUBLE / 9.0::DOUBLE END AS mean_ssim, quality, toxic
  FROM m LEFT JOIN l ON l.doc_id = m.doc_id),
y AS (SELECT *, (0.35::DOUBLE * word_recall + 0.25::DOUBLE * heading_recall) + 0.2::DOUBLE * mean_ssim + 0.2::DOUBLE * CASE WHEN page_ratio > 0 THEN least(page_ratio, 1 / page_ratio) END AS score FROM x)
"""


@query(METRICS + """SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT page_ratio BETWEEN 0.7::DOUBLE AND 1.3::DOUBLE THEN 'page_ratio' END, CASE WHEN word_jaccard < 0.55::DOUBLE THEN 'word_jaccard' END, CASE WHEN word_recall < 0.65::DOUBLE THEN 'word_recall' END, CASE WHEN heading_recall < 0.6::DOUBLE THEN 'heading_recall' END], lambda r: r IS NOT NULL), ',') AS reasons FROM x""")
def structure_gate(spark, sf_dir):
    return metrics(spark, sf_dir).select("doc_id", F.array_join(G.fail_reasons(), ",").alias("reasons"))


@query(METRICS + "SELECT count(*) AS papers, count(score) AS complete, round(avg(score), 6) AS composite FROM y")
def fidelity_composite(spark, sf_dir):
    scored = metrics(spark, sf_dir).select(G.composite().alias("score"))
    return scored.agg(F.count("*").alias("papers"), F.count("score").alias("complete"), F.round(F.avg("score"), 6).alias("composite"))


@query(METRICS + """, b AS (SELECT doc_id AS id, score + (doc_id % 5) * 0.01::DOUBLE AS score, word_recall + (doc_id % 3) * 0.04::DOUBLE AS word_recall, heading_recall FROM y WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT y.doc_id AS id, round(b.score - y.score, 6) AS score_drop, coalesce(b.score - y.score > 0.02::DOUBLE OR b.word_recall - y.word_recall > 0.05::DOUBLE OR b.heading_recall - y.heading_recall > 0.05::DOUBLE, false) AS regressed FROM y JOIN b ON b.id = y.doc_id""")
def fidelity_gate_diff(spark, sf_dir):
    run = metrics(spark, sf_dir).select(F.col("doc_id").alias("id"), G.composite().alias("score"), "word_recall", "heading_recall")
    mod = lambda n: F.pmod("id", F.lit(n))
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct()
    baseline = run.join(known, "id", "left_semi").select("id", (F.col("score") + mod(5) * F.lit(0.01)).alias("score"), (F.col("word_recall") + mod(3) * F.lit(0.04)).alias("word_recall"), "heading_recall")
    return G.fidelity_diff(run, baseline).select("id", F.round("score_drop", 6).alias("score_drop"), "regressed")


@query("""WITH v AS (SELECT doc_id AS id, CASE WHEN max(toxic) = 1 THEN 'CONVERT_FAIL' ELSE 'PASS' END AS verdict FROM labels GROUP BY doc_id),
k AS (SELECT doc_id AS id, CASE WHEN max(quality) = 1 THEN 'pass' ELSE 'fail' END AS known FROM labels WHERE doc_id IN (SELECT page_id FROM pages) GROUP BY doc_id)
SELECT v.id, CASE WHEN known = 'pass' AND verdict = 'CONVERT_FAIL' THEN 'regression' WHEN known = 'fail' AND verdict = 'PASS' THEN 'fixed' ELSE 'new_failure' END AS "class"
FROM v LEFT JOIN k ON k.id = v.id WHERE (known = 'pass' AND verdict = 'CONVERT_FAIL') OR (known = 'fail' AND verdict = 'PASS') OR (known IS NULL AND verdict = 'CONVERT_FAIL')""")
def acceptance_gate(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    verdicts = labels.groupBy(F.col("doc_id").alias("id")).agg(F.when(F.max("toxic") == 1, "CONVERT_FAIL").otherwise("PASS").alias("verdict"))
    pages = table(spark, sf_dir, "pages").select("page_id").distinct()
    baseline = labels.join(pages, F.col("doc_id") == F.col("page_id"), "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.when(F.max("quality") == 1, "pass").otherwise("fail").alias("known"))
    return G.acceptance(verdicts, baseline)


def findings(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.pmod("event_id", F.lit(2)) == odd)
    severity = F.max(F.floor(F.col("value")).cast("long") % 4).cast("int")
    return events.groupBy(F.col("user_id").alias("paper"), F.col("event_type").alias("dimension")).agg(severity.alias("severity")).withColumn("verdict", F.when(F.col("severity") > 1, "differs").otherwise("match"))


@query("""WITH f AS (SELECT user_id AS paper, event_type AS dimension, event_id % 2 AS half, max(floor("value")::BIGINT % 4)::INT AS severity FROM events GROUP BY ALL),
a AS (SELECT * FROM f WHERE half = 0), b AS (SELECT * FROM f WHERE half = 1)
SELECT coalesce(a.paper, b.paper) AS paper, coalesce(a.dimension, b.dimension) AS dimension, CASE WHEN a.severity > 1 THEN 'differs' ELSE 'match' END AS verdict_before, coalesce(a.severity, 0) AS severity_before,
 CASE WHEN b.severity > 1 THEN 'differs' ELSE 'match' END AS verdict_after, coalesce(b.severity, 0) AS severity_after,
 CASE WHEN coalesce(b.severity, 0) > coalesce(a.severity, 0) THEN 'regressed' WHEN coalesce(b.severity, 0) < coalesce(a.severity, 0) THEN 'improved' ELSE 'same' END AS change
FROM a FULL OUTER JOIN b ON a.paper = b.paper AND a.dimension = b.dimension""")
def findings_diff(spark, sf_dir):
    return G.findings_diff(findings(spark, sf_dir, 0), findings(spark, sf_dir, 1))


#: Events as warnings: the type gives the kind, the value the severity, the user the paper.
KINDS = list(C.GUIDES)


def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod("event_id", F.lit(len(KINDS))) + 1).cast("int"))
    severity = F.when(F.col("value") < 10, "info").when(F.col("value") < 50, "warning").when(F.col("value").isNotNull() & (F.pmod("event_id", F.lit(5)) != 0), "error")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("paper"), kind.alias("kind"), F.col("event_type").alias("name"), severity.alias("severity"), "event_id")


WARNINGS = f"""WITH w AS (SELECT user_id AS paper, {KINDS!r}[event_id % {len(KINDS)} + 1] AS kind, event_type AS name, CASE WHEN "value" < 10 THEN 'info' WHEN "value" < 50 THEN 'warning' WHEN "value" IS NOT NULL AND event_id % 5 <> 0 THEN 'error' END AS severity, event_id FROM events)
"""


@query(WARNINGS + "SELECT kind, count(*) AS n, CASE kind " + " ".join(f"WHEN '{k}' THEN '{g}'" for k, g in C.GUIDES.items()) + " END AS guide FROM w GROUP BY kind")
def warning_histogram(spark, sf_dir):
    return C.histogram(warnings(spark, sf_dir))


@query(WARNINGS + "SELECT severity, kind, count(*) AS n FROM (SELECT coalesce(severity, 'unknown') AS severity, coalesce(kind, 'unknown') AS kind FROM w) GROUP BY GROUPING SETS ((severity), (kind))")
def severity_kind_sets(spark, sf_dir):
    return C.severity_and_kind(warnings(spark, sf_dir))


@query(WARNINGS + "SELECT kind, name, count(DISTINCT paper) AS papers, count(*) AS occurrences FROM w GROUP BY kind, name ORDER BY papers DESC, occurrences DESC, kind, name LIMIT 40")
def audit_top40(spark, sf_dir):
    return C.audit(warnings(spark, sf_dir), 40)


@query(WARNINGS + "SELECT kind, count(*) AS n, arg_min(name, event_id) AS first_name FROM w GROUP BY kind")
def brief_histogram(spark, sf_dir):
    return warnings(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.min_by("name", "event_id").alias("first_name")).orderBy(F.desc("n"), "kind")


@query("""WITH s AS (SELECT doc_id, 1 + doc_id % 3 AS a, doc_id % 2 AS b FROM documents)
SELECT cluster, label, count(*) AS papers, sum(n)::BIGINT AS occurrences FROM (SELECT 'color/spacing' AS cluster, 'vspace/hspace' AS label, a AS n FROM s UNION ALL SELECT 'color/spacing', 'textcolor', a FROM s UNION ALL SELECT 'color/spacing', 'skips', b FROM s
  UNION ALL SELECT 'float-sizing/tables', 'column widths', b FROM s UNION ALL SELECT 'float-sizing/tables', 'column decorators', b FROM s UNION ALL SELECT 'lists/theorems', 'item label', 1 FROM s UNION ALL SELECT 'lists/theorems', 'theorem note', b FROM s) WHERE n > 0 GROUP BY ALL""")
def silent_gaps(spark, sf_dir):
    n, odd = F.pmod("doc_id", F.lit(3)).cast("int") + 1, F.pmod("doc_id", F.lit(2)).cast("int")
    content = F.concat(F.coalesce("text", F.lit("")), F.repeat(F.lit("\\vspace{1em}\\textcolor{red}{x} p{2cm}"), n), F.repeat(F.lit("\\bigskip \\begin{tabular}{lp{2cm}}\\end{tabular}\\begin{array}{@{}l}\\end{array}\\begin{lemma}[N]"), odd), F.lit("\\item[a] b"))
    return C.silent_gaps(table(spark, sf_dir, "documents").select(content.alias("content")))


@query("SELECT lang, count(*) AS total, round_even(100.0 * count(*) FILTER (WHERE length(text) % 3 <> 0) / count(*), 0) AS pass_rate FROM documents GROUP BY lang")
def pass_rate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("total"), F.bround(100.0 * F.count_if(F.length("text") % 3 != 0) / F.count("*"), 0).alias("pass_rate"))


@query("""WITH f AS (SELECT o_custkey AS project, 'f' || o_orderkey || '.tex' AS path, o_orderkey % 4 = 0 AS declares FROM orders),
g AS (SELECT project, coalesce(list(path ORDER BY path) FILTER (WHERE declares), []) AS c FROM f GROUP BY project)
SELECT project, CASE WHEN len(c) = 1 THEN c[1] END AS entry, CASE WHEN len(c) = 0 THEN 'no_entry_file' WHEN len(c) > 1 THEN 'ambiguous_entry_file' END AS error, array_to_string(c, ',') AS candidates FROM g""")
def entry_file_rule(spark, sf_dir):
    content = F.when(F.pmod("o_orderkey", F.lit(4)) == 0, "text\n  \\documentclass{article}").otherwise("% \\documentclass{article}\ntext")
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.concat(F.lit("f"), "o_orderkey", F.lit(".tex")).alias("path"), content.alias("content"))
    return C.entry_files(files)


@query("SELECT p_partkey, p_type, coalesce(nullif(list_position(['beamer', 'thesis', 'report', 'book', 'article'], ['article', 'book', 'report', 'thesis', 'beamer', 'other'][p_size % 6 + 1]), 0), 99)::BIGINT AS place FROM part")
def gallery_order(spark, sf_dir):
    order = F.array(*map(F.lit, ["beamer", "thesis", "report", "book", "article"]))
    kind = F.element_at(F.array(*map(F.lit, ["article", "book", "report", "thesis", "beamer", "other"])), (F.pmod("p_size", F.lit(6)) + 1).cast("int"))
    place = F.coalesce(F.nullif(F.array_position(order, kind), F.lit(0)), F.lit(99)).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", "p_type", place.alias("place")).orderBy("place", "p_partkey")


@query(METRICS + "SELECT doc_id AS id, round(word_recall, 3) AS word_recall, round(heading_recall, 3) AS heading_recall, round(mean_ssim, 3) AS mean_ssim FROM x")
def baseline_trim(spark, sf_dir):
    return metrics(spark, sf_dir).select(F.col("doc_id").alias("id"), *(F.round(c, 3).alias(c) for c in ("word_recall", "heading_recall", "mean_ssim")))


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 'unverified' WHEN quality = 1 THEN 'ok' ELSE 'failed' END AS truth, (quality IS NULL OR quality = 1) AS accepted FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)")
def truth_gate(spark, sf_dir):
    quality = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    truth = F.when(F.col("quality").isNull(), "unverified").when(F.col("quality") == 1, "ok").otherwise("failed")
    return table(spark, sf_dir, "documents").select("doc_id").join(quality, "doc_id", "left").select("doc_id", truth.alias("truth"), (truth != "failed").alias("accepted"))


@query(METRICS + "SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'not_compiled' WHEN doc_id % 7 = 0 THEN 'self_report_mismatch' WHEN r IS NULL THEN 'unscored' WHEN r < 0.2::DOUBLE - 0.001::DOUBLE THEN 'regressed' WHEN r < 0.75::DOUBLE THEN 'below_floor' WHEN doc_id % 2 > 0 THEN 'stuck' ELSE 'clean' END AS verdict FROM (SELECT doc_id, CASE WHEN quality IS NULL THEN NULL ELSE 2 * word_recall END AS r FROM x)")
def dogfood_verdict(spark, sf_dir):
    mod = lambda n: F.pmod("doc_id", F.lit(n))
    runs = metrics(spark, sf_dir).select("doc_id", (mod(13) != 0).alias("compiled"), (mod(7) == 0).alias("mismatch"), F.when(F.col("quality").isNotNull(), 2 * F.col("word_recall")).alias("recall_after"), F.lit(0.2).alias("recall_before"), mod(2).alias("stuck"))
    return runs.select("doc_id", G.dogfood_verdict().alias("verdict"))


@query(METRICS + "SELECT doc_id AS id, (CASE WHEN toxic = 1 THEN 0 WHEN NOT (word_jaccard >= 0.05::DOUBLE) THEN 1 ELSE 2 END)::INT AS tier, coalesce(CASE WHEN quality IS NOT NULL THEN word_recall END, 0.5::DOUBLE) AS recall FROM x")
def rank_candidates(spark, sf_dir):
    papers = metrics(spark, sf_dir).select(F.col("doc_id").alias("id"), (F.coalesce("toxic", F.lit(0)) == 1).alias("known_fail"), (F.col("word_jaccard") >= 0.05).alias("structure_ok"), F.when(F.col("quality").isNotNull(), F.col("word_recall")).alias("word_recall"))
    return G.rank_candidates(papers)


@query("""WITH t AS (SELECT conv_id AS doc, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS page FROM conversations WHERE role IN ('user', 'assistant'))
SELECT coalesce(a.doc, b.doc) AS doc, coalesce(a.page, b.page)::INT AS page, a.n::DOUBLE AS left_chars, b.n::DOUBLE AS right_chars FROM (SELECT * FROM t WHERE role = 'user') a FULL OUTER JOIN (SELECT * FROM t WHERE role = 'assistant') b ON a.doc = b.doc AND a.page = b.page""")
def page_pairs(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn", "text"))
    t = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant")).select(F.col("conv_id").alias("doc"), "role", F.length("text").cast("double").alias("n"), place.alias("page"))
    left, right = (t.where(F.col("role") == r).select("doc", "page", F.col("n").alias(c)) for r, c in (("user", "left_chars"), ("assistant", "right_chars")))
    return C.pages(left, right)


@query("""WITH o AS (SELECT l_orderkey, list('k' || l_partkey ORDER BY l_linenumber, 'k' || l_partkey) AS labels, list('k' || l_partkey) FILTER (WHERE l_returnflag = 'R') AS refs FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, coalesce(list_filter(labels, lambda x: list_contains(coalesce(refs, []), x))[1], labels[1]) AS label FROM o""")
def label_alias_pick(spark, sf_dir):
    key = F.concat(F.lit("k"), "l_partkey")
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", key.alias("key")))).alias("x"), F.collect_list(F.when(F.col("l_returnflag") == "R", key)).alias("refs"))
    return o.select("l_orderkey", C.alias(F.transform("x", lambda s: s["key"]), F.col("refs")).alias("label"))


@query("""WITH d AS (SELECT DISTINCT l_orderkey AS project, l_suppkey % 20 AS k FROM lineitem WHERE l_linestatus = 'F'), u AS (SELECT DISTINCT l_orderkey AS project, l_partkey % 20 AS k FROM lineitem)
SELECT u.project, 'k' || u.k AS key FROM u WHERE u.project IN (SELECT project FROM d) AND NOT EXISTS (SELECT 1 FROM d WHERE d.project = u.project AND d.k = u.k)""")
def undefined_citations(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    key = lambda c: F.concat(F.lit("k"), F.pmod(c, F.lit(20)))
    defined = lines.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("project"), key("l_suppkey").alias("key"))
    used = lines.select(F.col("l_orderkey").alias("project"), key("l_partkey").alias("key")).distinct()
    return C.undefined(used, defined, ["project", "key"])


@query("""WITH u AS (SELECT DISTINCT l_orderkey AS project, l_partkey % 30 AS k FROM lineitem), d AS (SELECT l_orderkey AS project, l_suppkey % 30 AS k FROM lineitem), b AS (SELECT l_orderkey AS project, l_linenumber AS k FROM lineitem)
SELECT project, 'k' || k AS key FROM (SELECT * FROM u EXCEPT SELECT * FROM d EXCEPT SELECT * FROM b)""")
def dangling_refs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    keys = lambda c: lines.select(F.col("l_orderkey").alias("project"), F.concat(F.lit("k"), c).alias("key"))
    return C.dangling(keys(F.pmod("l_partkey", F.lit(30))), keys(F.pmod("l_suppkey", F.lit(30))), keys(F.col("l_linenumber")), ["project", "key"])


@query("SELECT l_orderkey AS project, l_suppkey % 3 AS key, l_linenumber AS pos, l_partkey AS entry FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY l_linenumber, l_partkey) = 1")
def bib_first_wins(spark, sf_dir):
    entries = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project"), F.pmod("l_suppkey", F.lit(3)).alias("key"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("entry"))
    return C.first_wins(entries, ["project", "key"], ["pos", "entry"])


@query("SELECT l_orderkey AS project, l_suppkey % 3 AS name, arg_max(l_partkey, struct_pack(a := l_linenumber, b := l_partkey)) AS body FROM lineitem GROUP BY ALL")
def macro_last_wins(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project"), F.pmod("l_suppkey", F.lit(3)).alias("name"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("body"))
    return C.last_wins(d, ["project", "name"], ["pos", "body"], "body")


@query("""WITH RECURSIVE c AS (SELECT s_suppkey AS root, s_suppkey AS file, 0 AS depth FROM supplier UNION ALL SELECT root, file // 2, depth + 1 FROM c WHERE file > 1)
SELECT root, file, depth::INT AS depth FROM c""")
def include_closure(spark, sf_dir):
    ids = table(spark, sf_dir, "supplier").select("s_suppkey")
    edges = ids.where("s_suppkey > 1").select(F.col("s_suppkey").alias("parent"), F.expr("s_suppkey div 2").alias("child"))
    return C.include_closure(edges, ids.select(F.col("s_suppkey").alias("root")))


@query("""WITH s AS (SELECT l_orderkey AS doc, l_linenumber AS pos, (l_partkey % 900)::BIGINT AS a, (l_partkey % 900 + l_quantity)::BIGINT AS b, l_suppkey AS k FROM lineitem)
SELECT s.doc, s.a AS "start", s.b AS "end", min(w.pos) AS pos, arg_min('g' || w.k, struct_pack(a := w.pos, b := 'g' || w.k)) AS guide FROM (SELECT DISTINCT doc, a, b FROM s) s JOIN s w ON w.doc = s.doc AND w.a + 5 < s.b AND w.b + 5 > s.a GROUP BY ALL""")
def span_warning_overlap(spark, sf_dir):
    start, stop = F.col("l_partkey") % 900, (F.col("l_partkey") % 900 + F.col("l_quantity")).cast("long")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), start.alias("start"), stop.alias("end"), "l_suppkey")
    w = lines.select("doc", "pos", (F.col("start") + 5).alias("w_start"), (F.col("end") + 5).alias("w_end"), F.concat(F.lit("g"), "l_suppkey").alias("guide"))
    return C.overlapping(lines.select("doc", "start", "end").distinct(), w)


@query(r"""WITH l AS (SELECT doc_id AS doc, unnest(['a \vspace b \vspace', '// \skip', '```', '\inside', '```', '\\double \textbf{x}']) AS content, unnest([1, 2, 3, 4, 5, 6]) AS line FROM documents)
SELECT doc, line::INT AS line, CASE line WHEN 1 THEN 'vspace' ELSE 'textbf' END AS name FROM l WHERE line IN (1, 6)""")
def leak_scan(spark, sf_dir):
    text = F.concat(F.array(*map(F.lit, ["a \\vspace b \\vspace", "// \\skip", "```", "\\inside", "```", "\\\\double \\textbf{x}"])), F.split(F.coalesce("text", F.lit("")), "\n"))
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(text).alias("line", "content")).withColumn("line", F.col("line") + 1)
    return C.leaks(lines)


@query("SELECT doc_id AS doc, 'c0000.tex' AS path, 'x' || doc_id || chr(10) AS body FROM documents UNION ALL SELECT doc_id, 'c0001.tex', 'y' || chr(10) FROM documents WHERE doc_id % 2 = 0")
def fence_harvest(spark, sf_dir):
    md = F.concat(F.lit("# t\n"), F.coalesce("text", F.lit("")), F.lit("\n```latex\nx"), "doc_id", F.lit("\n```\n```python\nz\n```\n```tex\n\n```\n"), F.when(F.col("doc_id") % 2 == 0, "```LaTeX-demo\ny\n```\n").otherwise(""))
    return C.fences(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), md.alias("content")))


@query("""SELECT doc_id, CASE WHEN quality IS NULL THEN 'tectonic_unavailable' WHEN quality = 0 THEN 'input_broken' WHEN toxic = 1 THEN 'converter_bug' ELSE 'ok' END AS verdict FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)""")
def doctor_verdict(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    return docs.select("doc_id", G.doctor_verdict(F.col("quality") == 1, F.col("toxic") == 0).alias("verdict"))


@query("""SELECT CASE WHEN quality IS NULL THEN 'UNATTRIBUTED' WHEN quality = 0 THEN 'INPUT_BROKEN' WHEN toxic = 1 THEN 'CONVERT_FAIL' ELSE 'PASS' END AS verdict, count(*) AS n FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY 1""")
def sweep_tally(spark, sf_dir):
    verdict = F.when(F.col("verdict") == "input_broken", "INPUT_BROKEN").when(F.col("verdict") == "tectonic_unavailable", "UNATTRIBUTED").when(F.col("verdict") == "converter_bug", "CONVERT_FAIL").otherwise("PASS")
    return doctor_verdict(spark, sf_dir).groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, nullif(regexp_extract('c. ' || o_orderkey || '/' || strftime(o_orderdate, '%Y') || '?', '([12][0-9]{3})', 1), '') AS year FROM orders")
def date_normalize(spark, sf_dir):
    date = F.concat(F.lit("c. "), "o_orderkey", F.lit("/"), F.year("o_orderdate"), F.lit("?"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.year(date).alias("year"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'rgb(' || p_size || ', 0, 255)' WHEN 1 THEN 'luma(' || p_size || '%)' WHEN 2 THEN 'rgb(' || (p_partkey % 256) || ', 16, 255)' ELSE 'cmyk(' || p_size || '%, 0%, 50%, 100%)' END AS color FROM part""")
def color_spec(spark, sf_dir):
    p, size = F.pmod("p_partkey", F.lit(4)), F.col("p_size")
    share = F.format_string("0.%02d", size)
    model = F.element_at(F.array(*map(F.lit, ["RGB", "gray", "HTML", "cmyk"])), (p + 1).cast("int"))
    spec = F.when(p == 0, F.concat(size, F.lit(",0,255"))).when(p == 1, share).when(p == 2, F.concat(F.lpad(F.hex(F.pmod("p_partkey", F.lit(256))), 2, "0"), F.lit("10FF"))).otherwise(F.concat(share, F.lit(",0,0.5,1")))
    return table(spark, sf_dir, "part").select("p_partkey", T.color(model, spec).alias("color"))


@query("SELECT doc_id, [2, 1, 3][doc_id % 3 + 1]::INT AS packed FROM documents")
def width_packing(spark, sf_dir):
    rows = F.array(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.9)), F.array(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0.3)), F.array(F.lit(0.3), F.lit(0.3), F.lit(0.4)))
    return table(spark, sf_dir, "documents").select("doc_id", T.packed_width(F.element_at(rows, (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))).alias("packed"))


@query("""WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 0 END AS own, CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN -1 ELSE 0 END AS nxt FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL))
SELECT doc, line, greatest(0, coalesce(sum(nxt) OVER (PARTITION BY doc ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + own)::BIGINT AS indent FROM l""")
def algo_indent(spark, sf_dir):
    flag = F.col("flag")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line")).agg(F.max("l_returnflag").alias("flag"))
    lines = lines.select("doc", "line", F.when(flag == "R", -1).otherwise(0).alias("own"), F.when(flag == "A", 1).when(flag == "R", -1).otherwise(0).alias("next"))
    return C.indent(lines)


@query("""WITH s AS (SELECT p_partkey AS pos, p_name || ' ' || p_brand AS output, (p_partkey // 100)::BIGINT AS doc FROM part), e AS (SELECT p_partkey AS error, substr(p_brand, 1, 8) AS token, (p_partkey // 100)::BIGINT AS doc FROM part)
SELECT e.doc, e.error, x.pos AS "start", x.pos + 1 AS "end" FROM e LEFT JOIN LATERAL (SELECT pos FROM s WHERE s.doc = e.doc AND contains(s.output, e.token) AND length(e.token) >= 3 ORDER BY length(output), pos LIMIT 1) x ON true""")
def error_to_span(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("doc", F.expr("p_partkey div 100"))
    spans = part.select("doc", F.col("p_partkey").alias("pos"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + 1).alias("end"), F.concat_ws(" ", "p_name", "p_brand").alias("output"))
    errors = part.select("doc", F.col("p_partkey").alias("error"), F.substring("p_brand", 1, 8).alias("token"))
    return C.errors_to_spans(errors, spans)


@query("SELECT doc_id, [1.0, 0.5, 0.0][doc_id % 3 + 1]::DOUBLE AS recall, [0.75, 0.5, 0.0][doc_id % 3 + 1]::DOUBLE AS sequence FROM documents")
def heading_sequence(spark, sf_dir):
    """Four headings against a re-ordered list, against half of them, and against none."""
    truth = F.array(*map(F.lit, ["intro", "method", "results", "end"]))
    found = F.array(F.array(*map(F.lit, ["intro", "results", "method", "end"])), F.array(*map(F.lit, ["intro", "end"])), F.array().cast("array<string>"))
    mine = F.element_at(found, (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", T.heading_recall(truth, mine).alias("recall"), T.sequence_score(truth, mine).alias("sequence"))


@query("SELECT doc_id, (1 + doc_id % 3)::INT AS figures, (doc_id % 2)::INT AS tables, CASE WHEN doc_id % 2 > 0 THEN (1 + doc_id % 3)::DOUBLE / (doc_id % 2) END AS ratio FROM documents")
def float_counts(spark, sf_dir):
    content = F.concat(F.repeat(F.lit("\\begin{figure*}\n"), F.pmod("doc_id", F.lit(3)).cast("int") + 1), F.repeat(F.lit("\\begin{table}[h]"), F.pmod("doc_id", F.lit(2)).cast("int")))
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(content, F.lit(r"\\begin\{figure\*?\}")).alias("figures"), F.regexp_count(content, F.lit(r"\\begin\{table\*?\}")).alias("tables"))
    return d.select("*", T.safe_ratio(F.col("figures").cast("double"), "tables").alias("ratio"))
