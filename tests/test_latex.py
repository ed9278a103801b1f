"""The document kernel: exact output of small inputs, and that no input makes it fail."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.functions.bib import entries
from quillspark.functions.latex.convert import convert

CASES = [
    (r"\section{Intro}\label{sec:a b} Hi", "= Intro <sec:a-b>\n\nHi\n", []),
    (r"\subsection*{S}", "#heading(level: 2, numbering: none)[S]\n", []),
    (r"\emph{a} \textbf{b} \texttt{c} \underline{d} \textsc{e}", '_a_ *b* #raw("c") #underline[d] #smallcaps[e]\n', []),
    ("50\\% kept % gone\nnext", "50% kept next\n", []),
    (r"$a^2+b^{n+1}$", "$a^2+b^(n+1)$\n", []),
    (r"\[\sum_{i=1}^{n} mc\]", "$ sum_(i=1)^(n) m c $\n", []),
    (r"{\bf b} {\it c d} e", "*b* _c d_ e\n", []),
    (r"\textcolor[RGB]{1,2,3}{x} {\color{navy} y}", "#text(fill: rgb(1, 2, 3))[x] #text(fill: navy)[y]\n", []),
    (r"\let\x\textbf \x{a}", "*a*\n", []),
    (r"\def\y#1.{(#1)}\y ab. c", "(ab) c\n", []),
    (r"\begin{tabular}{ll}\multirow{2}{*}{a} & b\\ & c\\d & e\end{tabular}", "#table(\n  columns: 2,\n  align: (left, left),\n  stroke: none,\n  table.cell(rowspan: 2)[a], [b],\n  [c],\n  [d], [e],\n)\n", []),
    (r"$\nleq \varphi \longrightarrow \models$", "$lt.eq.not phi.alt arrow.r.long models$\n", []),
    (r"\begin{thebibliography}{9}\bibitem{k} A\end{thebibliography}", '#figure(kind: "bibitem", supplement: none, []) <k>  A\n', []),
    (r"$\frac{x}{y}$ $\sqrt[3]{x}$", "$(x) / (y)$ $root(3, x)$\n", []),
    (r"$\begin{pmatrix}a&b\\c&d\end{pmatrix}$", "$mat(a, b; c, d)$\n", []),
    (r"\cite{a,b} \ref{x} \eqref{e}", "@a @b @x (@e)\n", []),
    (r"\begin{itemize}\item a\item b\end{itemize}", "- a\n- b\n", []),
    (r"\begin{description}\item[t] d\end{description}", "/ t: d\n", []),
    (r"\newcommand{\R}[2][x]{#1#2}\R{y}\R[z]{w}", "xyzw\n", []),
    (r"\strange{x} y", " y\n", ["unsupported_command"]),
    (r"\begin{odd}y\end{odd}", "y\n", ["unsupported_environment"]),
    (r"$\nosuch$", '$"nosuch"$\n', ["ambiguous_math"]),
    (r"\def\x{\x}\x", "", ["custom_macro"]),
    (r"\newpage", "", ["drop_only"]),
    (r"\input{a}", "", ["needs_manual_review"]),
    (r"\verb|a_b| x", '#raw("a_b") x\n', []),
    (r"\'e \c{c} \"u", "é ç ü\n", []),
    (r"\begin{figure}\includegraphics[width=0.5\textwidth]{a.png}\caption{C}\label{f}\end{figure}", '#figure(\n  image("a.png", width: 50%),\n  caption: [C],\n) <f>\n', []),
    (r"\begin{proof}x\end{proof}", "*Proof.* x #h(1fr) $square$\n", []),
    (r"\bibliography{a,b}", '#bibliography(("a.bib", "b.bib"))\n', []),
    (r"\SI{3}{\kilo\meter\per\second\squared} \ang{45} \num{7}", "3\u202fkm/s² 45° 7\n", []),
    (r"\newif\ifdraft \draftfalse\ifdraft a\else b\fi \drafttrue\ifdraft c\else d\fi", "b  c\n", []),
    (r"\begin{tabular}{ll}\multicolumn{2}{c}{x}\\a&b\end{tabular}", "#table(\n  columns: 2,\n  align: (left, left),\n  stroke: none,\n  table.cell(colspan: 2)[x],\n  [a], [b],\n)\n", []),
    (r"\thepage \ensuremath{x_1}", "#context counter(page).display() $x_1$\n", []),
    (r"$\xrightarrow{f} \nicefrac{1}{2}$", "$attach(->, t: f) 1 slash 2$\n", []),
    (r"\begin{frame}{T}x\end{frame}", "#pagebreak(weak: true)\n== T\n\nx\n", []),
    (r"\vspace{1em}a\hspace{\fill}", "#v(1em)a\n", []),
]


@pytest.mark.parametrize("source,typst,kinds", CASES)
def test_golden(source, typst, kinds):
    r = convert(source)
    assert r.typst.strip() == typst.strip()
    assert [w["kind"] for w in r.warnings] == kinds


def test_label_is_defined_once():
    r = convert(r"\section{A}\label{k} \section{B}\label{k}")
    assert r.typst.count("<k>") == 1 and r.labels == ["k"]


def test_places_are_bytes():
    w = convert("é\n\\strange")
    assert (w.warnings[0]["byte_start"], w.warnings[0]["byte_end"], w.warnings[0]["start_line"]) == (3, 11, 2)


def test_spans_are_bytes():
    r = convert("é \\emph{ü}")
    assert [(x["src_start"], x["src_end"], x["output"]) for x in r.source_map] == [(0, 3, "é "), (9, 11, "ü"), (3, 12, "_ü_")]


def test_many_macro_calls_and_warnings():
    assert convert("\\newcommand{\\a}{x}" + "\\a " * 6000).typst.count("x") == 6000
    r = convert("é\\odd\n" * 20000)  # linear in the number of warnings
    assert len(r.warnings) == 20000 and r.warnings[-1]["byte_end"] == 20000 * 7 - 1


def test_recursive_macros_end():
    assert convert(r"\def\x{\x\x}\x").warnings[0]["kind"] == "custom_macro"
    assert convert(r"\def\x{a\y\y}\def\y{\x\x}\x").typst


def test_authors():
    r = convert(r"\documentclass{article}\title{T}\author{Ann \\ Lab \and Bob\thanks{x} \\ Lab}\begin{document}\maketitle x\end{document}")
    assert r.metadata["author"] == "Ann#super[1], Bob#super[1]" and r.metadata["affiliations"] == "#super[1] Lab"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1 \t\n\\{}[]()$_^&%#~", max_size=200))
def test_never_fails(source):
    r = convert(source)
    size = len(source.encode())
    assert all(0 <= w["byte_start"] <= w["byte_end"] <= size for w in r.warnings)


def test_deep_nesting():
    assert convert("{" * 5000).has_error
    convert(r"\begin{center}" * 3000)


def test_bib():
    got = list(entries('@string{j="J"} @article{a, title={T {x}}, journal=j # " B", year=2020} @book{b, title="Q"'))
    assert [(e["key"], dict(e["fields"])) for e in got] == [("a", {"title": "T {x}", "journal": "J B", "year": "2020"}), ("b", {"title": "Q"})]
