"""Bibliography files: entries of .bib sources, tolerant of what doesn't parse."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

HEAD = re.compile(r"@\s*(\w+)\s*[{(]\s*", re.S)
FIELD = re.compile(r"\s*([\w-]+)\s*=\s*", re.S)


def value(text: str, at: int, strings: dict[str, str]) -> tuple[str, int]:
    """A field's value from text[at]: braces, quotes, numbers and @string names, joined by #."""
    parts = []
    while at < len(text):
        c = text[at]
        if c in '{"':
            depth, end = 0, at
            while end < len(text):
                if text[end] == "\\":
                    end += 2
                    continue
                if c == '"' and text[end] == '"' and end > at and depth == 0:
                    break
                depth += {"{": 1, "}": -1}.get(text[end], 0)
                if c == "{" and depth == 0:
                    break
                end += 1
            parts.append(text[at + 1 : end])
            at = end + 1
        else:
            m = re.compile(r"[^,#{}()\"\s]+").match(text, at)
            if not m:
                break
            parts.append(strings.get(m[0].lower(), m[0]))
            at = m.end()
        m = re.compile(r"\s*#\s*").match(text, at)
        if not m:
            break
        at = m.end()
    return re.sub(r"\s+", " ", "".join(parts)).strip(), at


def entries(text: str) -> Iterator[dict]:
    """type, key and fields of each entry, in order; @string is applied, @comment and @preamble are skipped."""
    strings: dict[str, str] = {}
    at = 0
    while m := HEAD.search(text, at):
        kind, at = m[1].lower(), m.end()
        if kind in ("comment", "preamble"):
            continue
        key = ""
        if kind != "string":
            k = re.compile(r"([^,\s{}()]+)\s*,?").match(text, at)
            if not k:
                continue
            key, at = k[1], k.end()
        fields: dict[str, str] = {}
        while f := FIELD.match(text, at):
            fields.setdefault(f[1].lower(), "")
            got, at = value(text, f.end(), strings)
            fields[f[1].lower()] = fields[f[1].lower()] or got
            comma = re.compile(r"\s*,").match(text, at)
            if not comma:
                break
            at = comma.end()
        if kind == "string":
            strings |= fields
        else:
            yield {"type": kind, "key": key, "fields": list(fields.items())}


def bib_entries(files: DataFrame, source: str = "content", *keys: str) -> DataFrame:
    """A row for each entry of each file: the keys, pos, type, key and fields."""
    schema = "".join(f"`{k}` {dict(files.dtypes)[k]}, " for k in keys) + "pos int, type string, key string, fields map<string,string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, p, e) for i, text in enumerate(batch.column(len(keys)).to_pylist()) for p, e in enumerate(entries(text or ""))]
            kept = [batch.column(k).take(pa.array([r[0] for r in rows], pa.int32())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2]["type"] for r in rows], pa.string()), pa.array([r[2]["key"] for r in rows], pa.string()), pa.array([r[2]["fields"] for r in rows], pa.map_(pa.string(), pa.string()))], names=[*keys, "pos", "type", "key", "fields"])

    return files.select(*keys, source).mapInArrow(run, schema)
