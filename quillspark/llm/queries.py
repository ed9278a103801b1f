"""The operators over their whole tables, as the contracts ask, by query name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, chat, decontaminate, linededup, lm, simhash, suffixes, syncmers, toxicity, warc
from quillspark.llm.common import remainder, table


def vocabulary() -> str:
    """Where the public word-end vocabulary lies; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score(table(spark, sf_dir, "documents"), learning=remainder("doc_id") != 1)
    return found.withColumn("held_out", remainder("doc_id") == 1)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup(table(spark, sf_dir, "documents"), min_words=1, sentence_words=8)
    spans = F.transform("removed", lambda x: F.concat_ws("-", x["start"], x["end"]))
    return found.withColumn("removed", F.array_join(spans, ","))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = toxicity.classify(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", "threshold", "flagged")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary(), keep_ids=False)


def op6_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.format_and_read(turns, public_tokenizers.path("byte_bpe_50k.json"))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # n_repeated counts strings of 200 bytes: passages of over 50 words need not have 400
    return suffixes.dedup(table(spark, sf_dir, "documents"), length=400, report=200)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


#: The same rows as op8_chat's, by string functions: a turn is its header, the escaped text and the end.
OP8_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length('### ' || role || ': ' || replace(replace(replace(text, '\\', '\\\\'), '### ', '\\### '), '</turn>', '\\</turn>') || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

#: The same rows as op3_lines's. DuckDB's splitting keeps no offsets, so they come from running sums.
OP3_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS n, len(parts) AS m FROM cut
), lined AS (
  SELECT doc_id, line || CASE WHEN n < m THEN chr(10) ELSE '' END AS line, n,
    sum(length(line) + (n < m)::INT) OVER (PARTITION BY doc_id ORDER BY n) AS stop FROM lines
), placed AS (
  SELECT doc_id, line, n, stop - length(line) AS start, stop, regexp_extract_all(line, '[^.!?。！？]+[.!?。！？]*|[.!?。！？]+') AS pieces FROM lined
), pieces AS (
  SELECT doc_id, n, start AS base, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM placed WHERE len(pieces) > 1
), sentences AS (
  SELECT doc_id, n, piece, base + sum(length(piece)) OVER (PARTITION BY doc_id, n ORDER BY k) AS stop FROM pieces
), units AS (
  SELECT doc_id, n, start, stop, line AS unit, true AS whole FROM placed
  UNION ALL SELECT doc_id, n, stop - length(piece), stop, piece, false FROM sentences
), normal AS (
  SELECT doc_id, n, start, stop, whole, trim(regexp_replace(lower(unit), '\s+', ' ', 'g')) AS unit FROM units
), sized AS (
  SELECT *, CASE WHEN unit = '' THEN 0 ELSE len(string_split(unit, ' ')) END AS words,
    max(CASE WHEN whole THEN CASE WHEN unit = '' THEN 0 ELSE len(string_split(unit, ' ')) END END) OVER (PARTITION BY doc_id, n) AS line_words FROM normal
), ranked AS (
  SELECT doc_id, start, stop, row_number() OVER (PARTITION BY unit ORDER BY doc_id, start, stop) > 1 AS gone, count(*) OVER (PARTITION BY unit) AS copies
  FROM sized WHERE (whole AND words >= 1) OR (NOT whole AND words >= 8 AND words < line_words)
), repeated AS (
  SELECT * FROM ranked WHERE copies > 1
), runs AS (
  SELECT kind, doc_id, start, stop, coalesce(start > max(stop) OVER (PARTITION BY kind, doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh
  FROM (SELECT 'gone' AS kind, doc_id, start, stop FROM repeated WHERE gone UNION ALL SELECT 'any', doc_id, start, stop FROM repeated)
), numbered AS (
  SELECT *, sum(fresh::INT) OVER (PARTITION BY kind, doc_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM runs
), islands AS (
  SELECT kind, doc_id, island, min(start) AS start, max(stop) AS stop FROM numbered GROUP BY ALL
), longest AS (
  SELECT doc_id, max(stop - start) AS longest FROM islands WHERE kind = 'any' GROUP BY doc_id
), counted AS (
  SELECT doc_id, count(*) AS n FROM repeated WHERE gone GROUP BY doc_id
), gaps AS (
  SELECT doc_id, start, stop, lag(stop, 1, 0) OVER (PARTITION BY doc_id ORDER BY start) AS before FROM islands WHERE kind = 'gone'
), kept AS (
  SELECT g.doc_id, sum(stop - start) AS removed_chars, string_agg(start::INT || '-' || stop::INT, ',' ORDER BY start) AS removed,
    string_agg(substr(text, before::BIGINT + 1, (start - before)::BIGINT), '' ORDER BY start) || substr(any_value(text), max(stop)::BIGINT + 1) AS kept
  FROM gaps g JOIN cut USING (doc_id) GROUP BY g.doc_id
)
SELECT c.doc_id, length(c.text)::INT AS n_chars, coalesce(counted.n, 0)::INT AS n_removed, coalesce(removed_chars, 0)::INT AS removed_chars,
  coalesce(removed, '') AS removed, coalesce(longest, 0)::INT AS longest_repeat, coalesce(kept, c.text) AS kept, sha256(coalesce(kept, c.text)) AS kept_sha256
FROM cut c LEFT JOIN kept USING (doc_id) LEFT JOIN longest USING (doc_id) LEFT JOIN counted USING (doc_id)
"""

#: The same rows as op7_warc's. Base32 comes from 20 bits (five hexadecimal digits) at a time.
OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
h AS (SELECT *, sha1(html) AS hex FROM p),
g AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, 5 * i + 1, 5))::BIGINT) AS v FROM h)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> b) & 31)::BIGINT + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_lines": OP3_SQL, "op7_warc": OP7_SQL, "op8_chat": OP8_SQL}
