"""Substring dedup by hashing lines or paragraphs, and sentences inside them.

Units are normalised (lower case, blanks squeezed), hashed to 128 bits and grouped over all documents; the occurrence
that ranks first by (id, start, end) stays, the rest are removed. Lines (or paragraphs) count from min_words words on. A
passage that stands inside longer lines is found by its sentences: pieces up to a run of full stops or other end signs,
of sentence_words words or more; 0 turns them off. A piece that is a whole line is no unit of its own. Offsets refer to
the original text in code points.

Cases: null texts count as empty. Units without a word are never removed. Rows with the same id count as one document:
the same unit at the same place of the same id is one occurrence. A null id ranks before others. Empty tables give empty
ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import drop_materialized, materialize, strings

#: What ends a unit.
BREAKS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[\t \r]*(?:\n[\t \r]*)+")}
#: A sentence with its end signs.
SENTENCE = re.compile(r"[^.!?。！？]+[.!?。！？]*|[.!?。！？]+")
SPANS = "array<struct<start:int,end:int>>"


def spans(text: str, unit: str) -> Iterator[tuple[int, int]]:
    """Start and end of every unit; what separates two units belongs to the one before it."""
    at = 0
    for m in BREAKS[unit].finditer(text):
        yield at, m.end()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def found_in(text: str, unit: str, min_words: int, sentence_words: int) -> Iterator[tuple[int, int, str]]:
    """Start, end and normalised form of the units of a text that are long enough."""
    for a, b in spans(text, unit):
        line = text[a:b]
        words = line.lower().split()
        if len(words) >= max(1, min_words):
            yield a, b, " ".join(words)
        if sentence_words and len(words) > sentence_words:
            cuts = [m.span() for m in SENTENCE.finditer(line)]
            for x, y in cuts if len(cuts) > 1 else ():
                piece = line[x:y].lower().split()
                if sentence_words <= len(piece) < len(words):
                    yield a + x, a + y, " ".join(piece)


def units(docs: DataFrame, unit: str = "line", min_words: int = 1, sentence_words: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each unit: its digest (two longs), document and span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                high, low, row, start, end = [], [], [], [], []
                for k, text in enumerate(strings(part.column(1))):
                    for a, b, words in found_in(text, unit, min_words, sentence_words):
                        digest = xxhash.xxh3_128_digest(words.encode("utf-8", "surrogatepass"))
                        high.append(int.from_bytes(digest[:8], "little", signed=True))
                        low.append(int.from_bytes(digest[8:], "little", signed=True))
                        row.append(k)
                        start.append(a)
                        end.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(high, pa.int64()), pa.array(low, pa.int64()), part.column(0).take(pa.array(row, pa.int32())), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["high", "low", "id", "start", "end"])

    return docs.select(id_col, text_col).mapInArrow(run, f"high long, low long, id {dict(docs.dtypes)[id_col]}, start int, end int")


def join_spans(found: list[dict]) -> list[dict]:
    """Sorted spans as disjoint ones; those that touch become one."""
    out: list[dict] = []
    for s in found:
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append({"start": s["start"], "end": s["end"]})
    return out


def removals(docs: DataFrame, unit: str = "line", min_words: int = 1, sentence_words: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For documents with a unit that occurs more than once: id, n_removed (units), the sorted spans to remove, and longest_repeat, the code points of the longest stretch of such units, the kept first occurrences included."""
    every = materialize(units(docs, unit, min_words, sentence_words, id_col, text_col), "units")
    place = F.struct("id", "start", "end")
    # written first, so that Spark can split a digest that very many rows have
    first = materialize(every.groupBy("high", "low").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("high", "low", "first"), "first-units")
    repeated = every.join(first, ["high", "low"]).select("id", F.struct("start", "end", (~place.eqNullSafe(F.col("first"))).alias("gone")).alias("unit"))
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            count, gone, longest = [], [], []
            for found in batch.column(1).to_pylist():
                own = [x for x in found if x["gone"]]
                count.append(len(own))
                gone.append(join_spans(own))
                longest.append(max(x["end"] - x["start"] for x in join_spans(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int32()), pa.array(gone, pairs), pa.array(longest, pa.int32())], names=["id", "n_removed", "removed", "longest_repeat"])

    out = materialize(repeated.groupBy("id").agg(F.array_sort(F.collect_set("unit")).alias("units")).mapInArrow(run, f"id {kind}, n_removed int, removed {SPANS}, longest_repeat int"), "removals")
    for done in (every, first):
        drop_materialized(done)
    return out


def dedup(docs: DataFrame, unit: str = "line", min_words: int = 1, sentence_words: int = 8, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Per row of docs: the id, n_chars, n_removed (units), removed_chars, removed (spans as start and end), longest_repeat, kept_sha256, and with keep_text the kept text."""
    out = removals(docs, unit, min_words, sentence_words, id_col, text_col)
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(out.withColumnRenamed("id", "of"), F.col("id").eqNullSafe(F.col("of")), "left")
    none = F.array().cast(SPANS)
    kept = cut(F.coalesce("text", F.lit("")), F.coalesce("removed", none))
    lost = F.coalesce(F.aggregate("removed", F.lit(0), lambda n, x: n + x["end"] - x["start"]), F.lit(0))
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    shown = joined.select(F.col("id").alias(id_col), F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), number("n_removed"), lost.alias("removed_chars"), F.coalesce("removed", none).alias("removed"), number("longest_repeat"), kept.alias("kept"))
    shown = shown.withColumn("kept_sha256", F.sha2(F.encode("kept", "UTF-8"), 256))
    return shown if keep_text else shown.drop("kept")


def cut(text: Column, removed: Column) -> Column:
    """text without the spans, by built-in functions."""
    n = F.size(removed)
    starts = F.concat(F.array(F.lit(0)), F.transform(removed, lambda x: x["end"]))
    ends = F.concat(F.transform(removed, lambda x: x["start"]), F.array(F.length(text)))
    return F.when(n <= 0, text).otherwise(F.concat_ws("", F.zip_with(starts, ends, lambda a, b: F.substring(text, a + 1, b - a))))
