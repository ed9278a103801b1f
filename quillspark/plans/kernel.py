"""Queries that run the document kernel over LaTeX built from the driver's tables; their twins build the expected output in closed form."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.bib import bib_entries as read_bib
from quillspark.operators import convert as K
from quillspark.operators import corpus as C
from quillspark.streaming import index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str, content: Column) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", content.alias("content"))


def joined(*parts: object) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def ident() -> Column:
    return F.col("doc_id").cast("string")


def flat() -> Column:
    """The whole text on one line: blanks squeezed, runs of hyphens and quotes single."""
    out = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x09-\x0D ]+", " ")
    for run, one in (("--+", "-"), ("''+", "'"), ("``+", "`")):
        out = F.regexp_replace(out, run, one)
    return F.trim(out)


def latex() -> Column:
    """flat() with everything escaped that LaTeX reads as markup."""
    out = F.regexp_replace(flat(), r"([{}$&#_%])", r"\\$1")
    for sign, shown in (("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}"), ("[", "{[}"), ("]", "{]}")):
        out = F.replace(out, F.lit(sign), F.lit(shown))
    return out


SQL_FLAT = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\\x09-\\x0D ]+', ' ', 'g'), '--+', '-', 'g'), chr(39) || chr(39) || '+', chr(39), 'g'), '``+', '`', 'g'))"
#: What the kernel makes of latex().
SQL_TYPST = f"replace(regexp_replace({SQL_FLAT}, '([*_#@<`\\[\\]$])', '\\\\\\1', 'g'), '~', '\\~')"
D = f"(SELECT doc_id, {SQL_TYPST} AS t FROM documents)"


def clean_words() -> Column:
    return F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " "))


def typst(spark: SparkSession, sf_dir: str, content: Column) -> DataFrame:
    return K.convert(docs(spark, sf_dir, content), "content", ("typst",)).select("doc_id", "typst")


@query(f"SELECT doc_id, md5('= Doc ' || doc_id || ' <sec:d-' || doc_id || '>' || chr(10) || chr(10) || ltrim(t || ' _end_') || chr(10)) AS typst, 0 AS n_warnings FROM {D}")
def convert_document(spark, sf_dir):
    content = joined("\\section{Doc ", ident(), "}\\label{sec:d ", ident(), "}\n\n", latex(), " \\emph{end} % gone")
    made = K.convert(docs(spark, sf_dir, content), "content", ("typst", "warnings"))
    return made.select("doc_id", F.md5("typst").alias("typst"), F.size("warnings").alias("n_warnings"))


@query(f"SELECT doc_id, 1 AS pos, 1 AS level, rtrim('Part ' || doc_id || ' ' || t) AS title FROM {D} UNION ALL SELECT doc_id, 2, 2, 'More' FROM documents UNION ALL SELECT doc_id, 3, 3, 'Deep *x*' FROM documents")
def source_headings(spark, sf_dir):
    content = joined("\\section{Part ", ident(), " ", latex(), "} a \\subsection*{More} b \\subsubsection[s]{Deep \\textbf{x}}")
    made = K.convert(docs(spark, sf_dir, content), "content", ("headings",))
    return made.select("doc_id", F.posexplode("headings").alias("p", "h")).select("doc_id", (F.col("p") + 1).alias("pos"), "h.level", "h.title")


@query(f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '= ' || a WHEN 1 THEN '== ' || a ELSE '#heading(level: 3, numbering: none)[' || a || ']' END || chr(10) AS typst FROM (SELECT doc_id, rtrim('A ' || t) AS a FROM {D})")
def section_levels(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ["section", "subsection", "subsubsection*"])), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    return typst(spark, sf_dir, joined("\\", name, "{A ", latex(), "}"))


SYMBOLS = {"alpha": "alpha", "sum": "sum", "leq": "<=", "cup": "union", "Leftarrow": "arrow.l.double", "nrightarrow": "arrow.r.not", "varphi": "phi.alt", "bigotimes": "times.o.big", "succnsim": "succ.ntilde", "hookleftarrow": "arrow.l.hook", "mid": "divides"}


@query(f"SELECT doc_id, ltrim(t || ' $' || (['" + "', '".join(SYMBOLS.values()) + f"'])[doc_id % {len(SYMBOLS)} + 1] || '$' || chr(10)) AS typst FROM {D}")
def math_symbols(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, SYMBOLS)), (F.pmod("doc_id", F.lit(len(SYMBOLS))) + 1).cast("int"))
    return typst(spark, sf_dir, joined(latex(), " $\\", name, "$"))


@query(f"SELECT doc_id, '*A' || doc_id || ' ' || t || '*: b, c' || chr(10) AS typst FROM {D}")
def macro_expand(spark, sf_dir):
    return typst(spark, sf_dir, joined("\\newcommand{\\two}[2][b]{\\textbf{#2}: #1}\\def\\c{, c}\\two{A", ident(), " ", latex(), "}\\c"))


@query(f"SELECT doc_id, '*z' || t || '* (' || doc_id || ')' || chr(10) AS typst FROM {D}")
def macro_forms(spark, sf_dir):
    """A built-in under another name, and a macro whose argument ends at a sign."""
    return typst(spark, sf_dir, joined("\\let\\strong\\textbf\\def\\paren#1;{(#1)}\\strong{z", latex(), "} \\paren ", ident(), ";"))


@query(f"""SELECT doc_id, ltrim(t || ' @k' || doc_id || ' @m[p. 3] #cite(<k1>, form: "prose") (@eq:' || doc_id || ')') || chr(10) AS typst, 'k' || doc_id || ',m,k1' AS citations FROM {D}""")
def cite_forms(spark, sf_dir):
    content = joined(latex(), " \\cite[p. 3]{k", ident(), ", m} \\citet{k1} \\eqref{eq:", ident(), "}")
    made = K.convert(docs(spark, sf_dir, content), "content", ("typst", "citations"))
    return made.select("doc_id", "typst", F.array_join("citations", ",").alias("citations"))


@query(f"SELECT doc_id, '#table(' || chr(10) || '  columns: 2,' || chr(10) || '  align: (left, right),' || chr(10) || '  stroke: none,' || chr(10) || '  [a], [' || rtrim(doc_id || ' ' || t) || '],' || chr(10) || '  [c], [],' || chr(10) || ')' || chr(10) AS typst FROM {D}")
def table_convert(spark, sf_dir):
    return typst(spark, sf_dir, joined("\\begin{tabular}{l|r}a & ", ident(), " ", latex(), " \\\\ c\\end{tabular}"))


@query(f"SELECT doc_id, '#table(' || chr(10) || '  columns: 3,' || chr(10) || '  align: (left, left, left),' || chr(10) || '  stroke: none,' || chr(10) || '  table.cell(rowspan: 2)[a], table.cell(colspan: 2)[' || rtrim(doc_id || ' ' || t) || '],' || chr(10) || '  [b], [c],' || chr(10) || '  [d], [], [],' || chr(10) || ')' || chr(10) AS typst FROM {D}")
def table_spans(spark, sf_dir):
    """A cell that covers the row below, and one that covers two columns."""
    return typst(spark, sf_dir, joined("\\begin{tabular}{lll}\\multirow{2}{*}{a} & \\multicolumn{2}{c}{", ident(), " ", latex(), "} \\\\ & b & c \\\\ d\\end{tabular}"))


@query(f"SELECT doc_id, '- ' || rtrim('a' || doc_id || ' ' || t) || chr(10) || '- b' || chr(10) || '  + c' || chr(10) || chr(10) || '/ t: d' || chr(10) AS typst FROM {D}")
def list_convert(spark, sf_dir):
    content = joined("\\begin{itemize}\\item a", ident(), " ", latex(), "\\item b\\begin{enumerate}\\item c\\end{enumerate}\\end{itemize}\n\n\\begin{description}\\item[t] d\\end{description}")
    return typst(spark, sf_dir, content)


@query(f"SELECT doc_id, '#text(fill: red)[x' || t || '] #highlight(fill: rgb(255, 128, 0))[b] #text(fill: luma(50%))[c]' || chr(10) AS typst FROM {D}")
def color_forms(spark, sf_dir):
    return typst(spark, sf_dir, joined("\\definecolor{mine}{HTML}{FF8000}\\textcolor{red}{x", latex(), "} \\colorbox{mine}{b} \\textcolor[gray]{0.5}{c}"))


@query(f"SELECT doc_id, '*x' || t || '* _y_ z' || chr(10) AS typst FROM {D}")
def font_switches(spark, sf_dir):
    return typst(spark, sf_dir, joined("{\\bf x", latex(), "} {\\itshape y} z"))


@query("SELECT doc_id, '#bibliography(\"a' || doc_id || '.bib\", style: \"' || (['ieee', 'apa', 'springer-basic', 'elsevier-harvard'])[doc_id % 4 + 1] || '\")' || chr(10) AS typst FROM documents")
def bib_styles(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ["plain", "plainnat", "splncs04", "elsarticle-harv"])), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    return typst(spark, sf_dir, joined("\\bibliographystyle{", name, "}\\bibliography{a", ident(), "}"))


BOX = "#box(width: 1.7em)[#text(size: 0.85em)["


@query(f"SELECT doc_id, '#block(width: 100%, stroke: (top: 0.8pt, bottom: 0.8pt), inset: (y: 4pt))[#align(left)[{BOX}1.]]#strong[for] i' || doc_id || ' #strong[do] \\' || chr(10) || '  {BOX}2.]]#h(1.2em)' || 's' || t || ' \\' || chr(10) || '  {BOX}3.]]#strong[end for]]]' || chr(10) AS typst FROM {D}")
def pseudocode(spark, sf_dir):
    return typst(spark, sf_dir, joined("\\begin{algorithmic}[1]\n\\For{i", ident(), "}\n\\State s", latex(), "\n\\EndFor\n\\end{algorithmic}"))


@query(f"SELECT doc_id, 'Ann#super[1], Bob' || doc_id || '#super[2], Cid#super[1]' AS author, '#super[1] One #linebreak() #super[2] Two' AS affiliations, rtrim('Words ' || t) AS abstract FROM {D}")
def front_matter(spark, sf_dir):
    """Authors with marks and their legend, and the abstract."""
    content = joined("\\documentclass{article}\\author{Ann\\textsuperscript{1} \\and Bob", ident(), "$^{2}$ \\and Cid\\textsuperscript{1} \\\\ \\textsuperscript{1}One \\\\ $^2$Two}\\begin{document}\\begin{abstract}Words ", latex(), "\\end{abstract}x\\end{document}")
    made = K.convert(docs(spark, sf_dir, content), "content", ("metadata",))
    return made.select("doc_id", *(F.col("metadata")[c].alias(c) for c in ("author", "affiliations", "abstract")))


SPEC = "CASE doc_id % 3 WHEN 0 THEN '  align: (left, center, right),' WHEN 1 THEN '  align: (center, center, center),' ELSE '  align: (left, left),' END"


@query(f"SELECT doc_id, '#table(' || chr(10) || '  columns: ' || CASE WHEN doc_id % 3 < 2 THEN 3 ELSE 2 END || ',' || chr(10) || {SPEC} || chr(10) || '  stroke: none,' || chr(10) || '  [' || rtrim('1 ' || t) || '], [2]' || CASE WHEN doc_id % 3 < 2 THEN ', [3]' ELSE '' END || ',' || chr(10) || ')' || chr(10) AS typst FROM {D}")
def colspec_parse(spark, sf_dir):
    spec = F.element_at(F.array(*map(F.lit, ["l|c|r", "*{3}{c}", "@{}p{3cm}>{\\bf}X@{}"])), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    return typst(spark, sf_dir, joined("\\begin{tabular}{", spec, "}1 ", latex(), " & 2", F.when(F.pmod("doc_id", F.lit(3)) < 2, " & 3").otherwise(""), "\\end{tabular}"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 4 IN (0, 1)) AS clean, count(*) FILTER (WHERE doc_id % 4 = 2) AS warnings, count(*) FILTER (WHERE doc_id % 4 = 3) AS parse_error FROM documents")
def corpus_buckets(spark, sf_dir):
    tail = F.element_at(F.array(*map(F.lit, ["", " \\emph{b}", " \\strange{c}", " \\begin{center}"])), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    return K.buckets(docs(spark, sf_dir, joined(clean_words(), tail)))


@query("SELECT kind, count(*) AS n, guide FROM (SELECT 'unsupported_command' AS kind, 'unsupported-commands' AS guide FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'unsupported_environment', 'environments' FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'ambiguous_math', 'math' FROM documents WHERE doc_id % 5 = 0) GROUP BY kind, guide")
def kernel_histogram(spark, sf_dir):
    part = lambda n, text: F.when(F.pmod("doc_id", F.lit(n)) == 0, text).otherwise("")
    content = joined(clean_words(), part(2, " \\strange{x}"), part(3, " \\begin{odd}y\\end{odd}"), part(5, " $\\unknown$"))
    made = K.convert(docs(spark, sf_dir, content), "content", ("warnings",))
    return C.histogram(K.warnings(made, "doc_id"))


@query(f"""WITH d AS (SELECT doc_id, doc_id::VARCHAR AS i, t, {SQL_FLAT} AS f FROM documents JOIN {D} USING (doc_id)), e AS (SELECT *, strlen(i) AS n FROM d)
SELECT doc_id, 0 AS src_start, (12 + n)::INT AS src_end, '\\section{{A ' || i || '}}' AS source, '= A ' || i || chr(10) || chr(10) AS output FROM e
UNION ALL SELECT doc_id, 9, (11 + n)::INT, 'A ' || i, 'A ' || i FROM e
UNION ALL SELECT doc_id, (12 + n)::INT, (16 + n)::INT, ' é ', ' é ' FROM e
UNION ALL SELECT doc_id, (16 + n)::INT, (26 + n)::INT, '\\textbf{{b}}', '*b*' FROM e
UNION ALL SELECT doc_id, (24 + n)::INT, (25 + n)::INT, 'b', 'b' FROM e
UNION ALL SELECT doc_id, (27 + n)::INT, (32 + n)::INT, '$a^2$', '$a^2$' FROM e""")
def explain_rows(spark, sf_dir):
    return K.explain(docs(spark, sf_dir, joined("\\section{A ", ident(), "} é \\textbf{b} $a^2$")), "content", "doc_id")


RULES = "'#set page(paper: \"us-letter\", margin: 1in, numbering: \"1\")' || chr(10) || '#set text(size: 10pt)' || chr(10) || '#set par(justify: true)' || chr(10) || '#set heading(numbering: \"1.\")' || chr(10) || chr(10)"


@query(f"SELECT doc_id // 3 AS project, CASE WHEN count(*) > 1 OR min(doc_id % 3) = 0 THEN 'f0.tex' END AS entry, {RULES} || CASE WHEN max(doc_id % 3) = 2 THEN '_Project ' || doc_id // 3 || '_' WHEN max(doc_id % 3) = 1 THEN 'old' ELSE '' END || chr(10) AS typst FROM documents GROUP BY doc_id // 3")
def project_convert(spark, sf_dir):
    part = F.pmod("doc_id", F.lit(3))
    content = F.when(part == 0, "\\input{x}").otherwise("")
    entry = joined("% \\documentclass{no}\n\\name{", F.floor(F.col("doc_id") / 3).cast("string"), "}")
    content = F.when(part == 0, entry).when(part == 1, "\\newcommand{\\name}[1]{old}").otherwise("\\newcommand{\\name}[1]{\\emph{Project #1}}")
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.floor(F.col("doc_id") / 3).alias("project"), joined("f", part.cast("string"), F.when(part == 0, ".tex").otherwise(".sty")).alias("path"), content.alias("content"))
    # the class line makes f0.tex the entry
    files = files.withColumn("content", F.when(F.col("path") == "f0.tex", F.concat(F.lit("\\documentclass{article}\n"), F.col("content"))).otherwise(F.col("content")))
    return K.projects(files).select("project", "entry", "typst")


@query("SELECT doc_id, 0 AS pos, 'article' AS type, 'k' || doc_id AS key, 'T ' || doc_id AS title, 'J. Stat' AS journal FROM documents")
def bib_entries(spark, sf_dir):
    content = joined('@string{js = "J. Stat"}\n@comment{x}\n@article{k', ident(), ",\n title = {T ", ident(), "},\n journal = js, year = 2020}\n")
    made = read_bib(docs(spark, sf_dir, content), "content", "doc_id")
    return made.select("doc_id", "pos", "type", "key", F.col("fields")["title"].alias("title"), F.col("fields")["journal"].alias("journal"))


@query("SELECT doc_id AS id, 1 AS n_warnings, length('_a_ ' || doc_id || chr(10)) AS chars FROM documents")
def incremental_index(spark, sf_dir):
    """Files that arrive in a watched folder, converted by a stream."""
    root = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/") + f"/index-{uuid.uuid4().hex}"
    docs(spark, sf_dir, joined("\\emph{a} ", ident(), "\\strange")).select(F.col("doc_id").alias("id"), "content").write.json(f"{root}/in")
    index.start(spark, f"{root}/in", f"{root}/out", f"{root}/log").awaitTermination()
    return index.read(spark, f"{root}/out").select("id", "n_warnings", F.col("chars").cast("long").alias("chars"))
