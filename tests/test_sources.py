"""Sources and sinks."""

import pytest

from quillspark.operators import convert as K
from quillspark.sources import files as S


def test_projects(spark, tmp_path):
    root = tmp_path / "papers"
    for path, text in {"p/main.tex": "\\documentclass{article}\\hi", "p/.x/a.tex": "no", "p/sub/m.sty": "\\newcommand{\\hi}{Hi}", "q/a.txt": "no", "q/b.TEX": "x"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    got = S.read_projects(spark, str(root))
    assert sorted((r.project, r.path) for r in got.collect()) == [("p", "main.tex"), ("p", "sub/m.sty"), ("q", "b.TEX")]
    made = {r.project: r for r in K.projects(got).collect()}
    assert made["p"].typst.endswith("Hi\n") and made["q"].error == "no_entry_file" and made["q"].typst is None


def test_verdicts(spark, tmp_path):
    (tmp_path / "v.txt").write_text("PASS 1.2\nCONVERT_FAIL 3.4: broken\nother line\nSKIP x\n")
    assert sorted(map(tuple, S.read_verdicts(spark, str(tmp_path / "v.txt")).collect())) == [("CONVERT_FAIL", "3.4"), ("PASS", "1.2"), ("SKIP", "x")]


def test_sinks(spark, tmp_path):
    files = spark.createDataFrame([("p", "a", "x"), ("p", "../b", "y")], "project string, path string, content string")
    skipped = S.write_projects(files, str(tmp_path / "out"))
    assert [r.path for r in skipped.collect()] == ["../b"]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    with pytest.raises(Exception):
        S.write_projects(files, str(tmp_path / "out"))
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), spark.createDataFrame([(2, "c")], "id long, v string")
    assert sorted(map(tuple, S.upsert(old, new).collect())) == [(1, "a"), (2, "c")]


def test_sql(spark):
    K.register(spark)
    assert spark.sql(r"SELECT latex_convert(r'\emph{a}')").first()[0] == "_a_\n"
    assert spark.sql(r"SELECT kind, name FROM latex_warnings(r'\odd')").first()[:] == ("unsupported_command", "odd")


def test_folders_and_inline(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("b.tex", "a.tex", "c.txt", "sub/d.tex"):
        (tmp_path / name).write_text(name)
    assert [r.content for r in S.read_folder(spark, str(tmp_path)).collect()] == ["a.tex", "b.tex"]
    assert K.convert(S.inline(spark, "\\emph{a}")).first().typst == "_a_\n"
    (tmp_path / "bad.tex").write_bytes(b"\xff")
    with pytest.raises(Exception):
        S.read_folder(spark, str(tmp_path)).collect()


def test_json_documents_and_reports(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.json").write_text('[{"paper": "p", "dimension": "d", "verdict": "match", "severity": 0}]')
    (tmp_path / "f/b.json").write_text("no json")
    got = {r.path.rsplit("/", 1)[1]: r.value for r in S.read_documents(spark, str(tmp_path / "f"), "findings").collect()}
    assert got["a.json"][0].paper == "p" and not got["b.json"]
    docs = spark.createDataFrame([("a",), ("\\odd",), ("{",)], "content string")
    kinds = K.warnings(K.convert(docs)).groupBy("kind").count().withColumnRenamed("count", "n")
    S.write_report(K.buckets(docs), kinds, str(tmp_path / "report"))
    line = spark.read.text(str(tmp_path / "report")).first()[0]
    assert line == '{"by_category":{"unsupported_command":1},"clean":1,"parse_error":1,"total":3,"warnings":1}'


def test_long_include_chain(spark):
    from quillspark.operators import corpus as C

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(40, 0)], "parent int, child int")
    got = {r.file: r.depth for r in C.include_closure(edges, spark.createDataFrame([(0,)], "root int")).collect()}
    assert got == {i: i for i in range(41)}


def test_errors_find_spans_in_three_steps(spark):
    from quillspark.operators import corpus as C

    errors = spark.createDataFrame([(1, 1, "tok", "x"), (1, 2, "zzz", "a  whole line"), (1, 3, "q", "see (part) here"), (1, 4, "none", "nothing")], "doc int, error int, token string, line string")
    spans = spark.createDataFrame([(1, 0, 0, 5, "a token"), (1, 1, 5, 9, "with a whole line in it"), (1, 2, 9, 12, "part")], "doc int, pos int, start int, end int, output string")
    got = {r.error: (r.start, r.end) for r in C.errors_to_spans(errors, spans).collect()}
    assert got == {1: (0, 5), 2: (5, 9), 3: (9, 12), 4: (None, None)}


def test_stream_goes_on_with_known_keys(spark, tmp_path):
    from quillspark.streaming import dedup

    rows = lambda *keys: spark.createDataFrame([(k,) for k in keys], "id string")
    run = lambda: dedup.start(spark, str(tmp_path / "in"), rows("a").schema, ["id"], str(tmp_path / "out"), str(tmp_path / "log"), known=rows("old")).awaitTermination()
    for keys in (("a", "b", "old"), ("b", "c")):
        rows(*keys).write.mode("append").json(str(tmp_path / "in"))
        run()
    assert sorted(r.id for r in spark.read.schema("id string").parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
