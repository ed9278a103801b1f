"""Conversion of parsed LaTeX to Typst, with warnings and the source spans that made each piece of output."""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np

from quillspark.functions.latex import styles
from quillspark.functions.latex import symbols as S
from quillspark.functions.latex.parse import Node, parse

LEVELS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
#: How deeply expansions nest. A macro that reached it is recursive and isn't expanded inside itself any more.
EXPANSIONS = 24
#: Declarations that hold to the end of their group.
SWITCHES = {"bf": "*{}*", "bfseries": "*{}*", "it": "_{}_", "itshape": "_{}_", "em": "_{}_", "sl": "_{}_", "slshape": "_{}_", "sc": "#smallcaps[{}]", "scshape": "#smallcaps[{}]"}
ESCAPED = re.compile(r"([*_#@<`\[\]$])")
WRAPS = {"emph": "_{}_", "textit": "_{}_", "textsl": "_{}_", "textbf": "*{}*", "underline": "#underline[{}]", "uline": "#underline[{}]", "sout": "#strike[{}]", "textsc": "#smallcaps[{}]", "textsuperscript": "#super[{}]", "textsubscript": "#sub[{}]", "footnote": "#footnote[{}]", "thanks": "#footnote[{}]", "mbox": "{}", "fbox": "{}", "textrm": "{}", "textup": "{}", "textnormal": "{}", "text": "{}", "textsf": "{}", "centerline": "{}"}
LITERAL = {"ldots": "…", "dots": "…", "textellipsis": "…", "LaTeX": "LaTeX", "TeX": "TeX", "S": "§", "P": "¶", "copyright": "©", "textendash": "–", "textemdash": "—", "textbackslash": "\\\\", "textasciitilde": "\\~", "textasciicircum": "^", "ss": "ß", "ae": "æ", "oe": "œ", "o": "ø", "aa": "å", "i": "ı", "quad": "#h(1em)", "qquad": "#h(2em)", "par": "\n\n", "dag": "†", "ddag": "‡", "pounds": "£"}
ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "u": "\u0306", "v": "\u030c", "H": "\u030b", "c": "\u0327", "r": "\u030a", "k": "\u0328"}
SILENT = {"centering": 0, "noindent": 0, "indent": 0, "maketitle": 0, "newline": 0, "small": 0, "large": 0, "Large": 0, "LARGE": 0, "huge": 0, "tiny": 0, "footnotesize": 0, "normalsize": 0, "scriptsize": 0, "rm": 0, "tt": 0, "ttfamily": 0, "sffamily": 0, "rmfamily": 0, "and": 0, "raggedright": 0, "frontmatter": 0, "mainmatter": 0, "backmatter": 0, "makeatletter": 0, "makeatother": 0, "toprule": 0, "midrule": 0, "bottomrule": 0, "hline": 0, "smallskip": 0, "medskip": 0, "bigskip": 0, "hfill": 0, "vfill": 0, "protect": 0, "sloppy": 0, "setlength": 2, "setcounter": 2, "addtocounter": 2, "pagestyle": 1, "thispagestyle": 1, "pagenumbering": 1, "hypersetup": 1, "captionsetup": 1, "graphicspath": 1, "phantom": 1, "vphantom": 1, "hphantom": 1, "cmidrule": 1, "cline": 1, "index": 1, "nocite": 1, "usetikzlibrary": 1, "allowdisplaybreaks": 0, "theoremstyle": 1, "date": 1, "title": 1, "author": 1}
DROP_WARNED = {"newpage", "clearpage", "pagebreak", "cleardoublepage"}
TRANSPARENT = {"center", "flushleft", "flushright", "quote", "quotation", "minipage", "titlepage", "multicols", "subequations", "small", "document", "landscape", "framed", "mdframed"}
THEOREMS = {"theorem": "Theorem", "lemma": "Lemma", "corollary": "Corollary", "proposition": "Proposition", "definition": "Definition", "remark": "Remark", "example": "Example"}
CITES = {"cite": "", "citep": "", "parencite": "", "autocite": "", "citet": "prose", "textcite": "prose", "citeauthor": "author", "citeyear": "year"}
REFS = {"ref", "cref", "Cref", "autoref", "eqref", "pageref", "nameref", "vref"}
# Units by name, prefixes by name.
UNITS = {"meter": "m", "metre": "m", "second": "s", "gram": "g", "kilogram": "kg", "ampere": "A", "kelvin": "K", "mole": "mol", "candela": "cd", "hertz": "Hz", "newton": "N", "pascal": "Pa", "joule": "J", "watt": "W", "volt": "V", "ohm": "Ω", "tesla": "T", "liter": "L", "litre": "L", "degree": "°", "celsius": "°C", "percent": "%", "electronvolt": "eV", "bit": "bit", "byte": "B", "hour": "h", "minute": "min", "day": "d"}
PREFIXES = {"nano": "n", "micro": "µ", "milli": "m", "centi": "c", "kilo": "k", "mega": "M", "giga": "G", "tera": "T"}
LIMITS = {"sum", "prod", "coprod", "int", "iint", "iiint", "oint", "bigcup", "bigcap", "lim"}
COUNTERS = {"thepage": "page", "thesection": "heading", "thefigure": "figure", "thetable": "figure.where(kind: table)", "theequation": "math.equation"}
#: Python frames that the deepest nesting which the parser takes needs.
FRAMES = 30_000
LENGTH = re.compile(r"-?[\d.]+\s*(?:pt|em|cm|mm|in)")


def label_key(key: str) -> str:
    return re.sub("-+", "-", re.sub(r"[^\w:.\-]", "-", key.strip())).strip("-")


@dataclass
class Result:
    typst: str
    warnings: list[dict]
    source_map: list[dict]
    has_error: bool
    headings: list[dict] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    citations: list[str] = field(default_factory=list)
    references: list[str] = field(default_factory=list)
    macros: list[dict] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)


class Stream:
    """Nodes with a place to read on from."""

    def __init__(self, nodes: list[Node], grouped: bool = False):
        self.nodes, self.at, self.grouped = nodes, 0, grouped

    def blanks(self) -> int:
        at = self.at
        while at < len(self.nodes) and (self.nodes[at].kind == "comment" or self.nodes[at].kind == "text" and not self.nodes[at].text.strip()):
            at += 1
        return at

    def argument(self) -> list[Node] | None:
        """The next group's nodes, or the next single token."""
        at = self.blanks()
        if at >= len(self.nodes) or self.nodes[at].kind == "par":
            return None
        n = self.nodes[at]
        self.at = at + 1
        if n.kind == "group":
            return n.children
        if n.kind == "text":
            lead = len(n.text) - len(n.text.lstrip())
            first, rest = n.text[lead], n.text[lead + 1 :]
            if rest:
                self.nodes = [*self.nodes[: self.at], Node("text", n.start + lead + 1, n.end, rest), *self.nodes[self.at :]]
            return [Node("text", n.start + lead, n.start + lead + 1, first)]
        return [n]

    def option(self) -> list[Node] | None:
        """What stands in brackets next, if anything."""
        at = self.blanks()
        if at >= len(self.nodes) or self.nodes[at].kind != "open":
            return None
        depth, end = 0, at
        while end < len(self.nodes):
            depth += {"open": 1, "close": -1}.get(self.nodes[end].kind, 0)
            if not depth:
                inside, self.at = self.nodes[at + 1 : end], end + 1
                return inside
            end += 1
        return None


class Converter:
    def __init__(self, source: str, seeds: dict[str, tuple[int, str | None, str]] | None = None):
        self.source = source
        self.macros = dict(seeds or {})
        self.r = Result("", [], [], False)
        self.seen: set[str] = set()
        self.flags: dict[str, bool] = {}
        self.depth = 0
        self.active: list[str] = []  # macros being expanded
        self.recursive: set[str] = set()
        self.aliases: dict[str, str] = {}
        self.delimiters: dict[str, list[str]] = {}
        self.colors: dict[str, str] = {}
        self.bib_style: str | None = None
        self.offsets: np.ndarray | None = None
        self.base = 0  # where an expansion stands in the source
        self.whole = False
        self.theorems = dict(THEOREMS)
        self.lines: list[int] | None = None

    # -- places and warnings

    def span(self, node: Node) -> tuple[int, int]:
        return (self.base, self.base) if self.depth else (node.start, node.end)

    @property
    def bytes(self) -> np.ndarray:
        """The byte at which each character begins, and the number of bytes at last."""
        if self.offsets is None:
            self.offsets = byte_offsets(self.source)
        return self.offsets

    def place(self, at: int) -> tuple[int, int, int]:
        """Byte, line from 1 and byte column from 1 of a character."""
        if self.lines is None:
            self.lines = [0, *(m.end() for m in re.finditer("\n", self.source))]
        line = bisect_right(self.lines, at)
        return int(self.bytes[at]), line, 1 + int(self.bytes[at] - self.bytes[self.lines[line - 1]])

    def warn(self, node: Node, kind: str, name: str | None = None, reason: str | None = None, severity: str = "warning") -> None:
        a, b = self.span(node)
        (x, l1, c1), (y, l2, c2) = self.place(a), self.place(b)
        shown = {"unsupported_command": f"\\{name} isn't supported", "unsupported_environment": f"environment {name} isn't supported"}.get(kind, f"{kind}: {reason or name}")
        self.r.warnings.append({"kind": kind, "name": name, "reason": reason, "severity": severity, "message": shown, "snippet": self.source[a:b], "start_line": l1, "start_col": c1, "end_line": l2, "end_col": c2, "byte_start": x, "byte_end": y})

    # -- text

    def text(self, nodes: list[Node], grouped: bool = False) -> str:
        s, out = Stream(nodes, grouped), []
        while s.at < len(s.nodes):
            n = s.nodes[s.at]
            s.at += 1
            made = self.one(n, s)
            if made and n.kind not in ("par", "comment"):
                if not self.depth:
                    self.r.source_map.append({"src_start": n.start, "src_end": s.nodes[s.at - 1].end, "output": made})
            out.append(made)
        return "".join(out)

    def one(self, n: Node, s: Stream) -> str:
        if n.kind == "text":
            return self.typography(n.text)
        if n.kind == "par":
            return "\n\n"
        if n.kind == "comment":
            if s.at < len(s.nodes) and s.nodes[s.at].kind == "text" and s.nodes[s.at].text == "\n":
                s.at += 1
            return ""
        if n.kind == "group":
            return self.text(n.children, grouped=True)
        if n.kind == "math":
            return self.formula(n)
        if n.kind == "raw":
            return self.raw(n)
        if n.kind == "env":
            return self.environment(n)
        if n.kind in ("open", "close"):
            return "\\" + n.text
        if n.kind == "sign":
            return "~" if n.text == "~" else "" if n.text == "&" else "\\" + n.text
        return self.command(n, s)

    def typography(self, text: str) -> str:
        text = re.sub(r"``|''", '"', text)
        return ESCAPED.sub(r"\\\1", text)

    def flat(self, nodes: list[Node] | None) -> str:
        """The source of an argument, as for keys and lengths."""
        return "".join(n.text if n.kind in ("text", "sign", "open", "close") else "\\" + n.text if n.kind == "command" else "{" + self.flat(n.children) + "}" if n.kind == "group" else "" for n in nodes or [])

    def label(self, key: str) -> str:
        key = label_key(key)
        if not key or key in self.seen:
            return ""
        self.seen.add(key)
        self.r.labels.append(key)
        return f"<{key}>"

    def command(self, n: Node, s: Stream) -> str:
        if n.text in self.aliases and n.text not in self.macros:
            n = replace(n, text=self.aliases[n.text])
        name = n.text
        if name in self.macros:
            return self.expand(n, s, self.text)
        plain = name.rstrip("*")
        if name in SWITCHES or name == "color":
            return self.switch(name, s)
        if plain in LEVELS:
            return self.section(n, s)
        if name in WRAPS:
            s.option()
            body = self.text(s.argument() or [])
            return WRAPS[name].format(body) if body or "[" in WRAPS[name] else ""
        if name in ("texttt", "path"):
            body = self.flat(s.argument()).replace("\\", "\\\\").replace('"', '\\"')
            return f'#raw("{body}")'
        if name in LITERAL:
            return LITERAL[name]
        if name in ("\\", "newline", "tabularnewline", "\\*"):
            s.option()
            return "\\\n"
        if name in ("%", "{", "}"):
            return name
        if name in ("&", "_", "#", "$"):
            return "&" if name == "&" else "\\" + name
        if name in (" ", "\n", ",", ";", ":", "!", "/", "-", "@"):
            return " " if name in (" ", "\n", ",", ";", ":") else ""
        if name in ACCENTS:
            body = self.text(s.argument() or [])
            return unicodedata.normalize("NFC", body[:1].replace("ı", "i") + ACCENTS[name]) + body[1:] if body else ""
        if name == "label":
            return self.label(self.flat(s.argument()))
        if name in CITES or name.rstrip("*") in CITES:
            return self.cite(CITES[name.rstrip("*")], s)
        if plain in REFS:
            keys = [label_key(k) for k in self.flat(s.argument()).split(",")]
            self.r.references += keys
            shown = " ".join(f"@{k}" for k in keys if k)
            if name == "pageref":
                self.warn(n, "needs_manual_review", reason="page references show the element's number", severity="info")
            return f"({shown})" if name == "eqref" else shown
        if name in ("url", "href"):
            target = self.flat(s.argument()).replace('"', "%22")
            return f'#link("{target}")' if name == "url" else f'#link("{target}")[{self.text(s.argument() or [])}]'
        if name in ("vspace", "hspace", "vspace*", "hspace*"):
            length = self.flat(s.argument()).strip()
            return f"#{name[0]}({length.replace(' ', '')})" if LENGTH.fullmatch(length) else ""
        if name in ("newcommand", "renewcommand", "providecommand", "newcommand*", "renewcommand*", "providecommand*", "DeclareMathOperator", "DeclareMathOperator*", "def", "let"):
            return self.define(name.rstrip("*"), s)
        if name == "newtheorem" or name == "newtheorem*":
            kind = self.flat(s.argument())
            s.option()
            self.theorems[kind] = self.flat(s.argument())
            s.option()
            return ""
        if name == "author":
            s.option()
            self.authors(s.argument() or [])
            return ""
        if name in ("title", "date", "subtitle", "keywords"):
            s.option()
            self.r.metadata[name] = self.text(s.argument() or []).strip()
            return ""
        if name in ("documentclass", "usepackage"):
            s.option()
            value = self.flat(s.argument())
            if name == "documentclass":
                self.whole, self.r.metadata["class"] = True, value
            return ""
        if name == "includegraphics":
            return self.graphics(s)
        if name in ("bibliography", "addbibresource"):
            paths = [p.strip() + ("" if p.strip().endswith(".bib") else ".bib") for p in self.flat(s.argument()).split(",")]
            style = f', style: "{self.bib_style}"' if self.bib_style else ""
            return f'#bibliography("{paths[0]}"{style})' if len(paths) == 1 else "#bibliography((" + ", ".join(f'"{p}"' for p in paths) + f"){style})"
        if name in ("multicolumn", "multirow"):
            count = self.flat(s.argument()).strip()
            s.argument()
            span = "colspan" if name == "multicolumn" else "rowspan"
            return f"table.cell({span}: {count if count.isdigit() else 1})[{self.text(s.argument() or []).strip()}]"
        if name in ("SI", "qty", "si", "unit", "num", "ang"):
            s.option()
            number = self.flat(s.argument()) if name not in ("si", "unit") else ""
            unit = self.units(s.argument() or []) if name in ("SI", "qty", "si", "unit") else "°" * (name == "ang")
            return number + ("\u202f" if number and unit and unit != "°" else "") + unit
        if name in COUNTERS:
            return f"#context counter({COUNTERS[name]}).display()"
        if name == "newif":
            flag = self.flat(s.argument()).removeprefix("\\if")
            self.flags[flag] = False
            return ""
        if name.endswith(("true", "false")) and re.sub("(true|false)$", "", name) in self.flags:
            self.flags[re.sub("(true|false)$", "", name)] = name.endswith("true")
            return ""
        if name.startswith("if") and name[2:] in self.flags:
            return self.text(self.branch(s, self.flags[name[2:]]))
        if name == "makecell":
            s.option()
            return self.text(s.argument() or [])
        if name == "ensuremath":
            return f"${self.math(s.argument() or []).strip()}$"
        if name == "DeclarePairedDelimiter":
            called, left, right = self.flat(s.argument()).lstrip("\\"), self.flat(s.argument()), self.flat(s.argument())
            self.macros[called] = (1, None, f"{left} #1 {right}")
            return ""
        if name == "frametitle":
            return f"== {self.text(s.argument() or []).strip()}\n\n"
        if name in ("textcolor", "colorbox", "fcolorbox"):
            fill = self.color(s)
            if name == "fcolorbox":
                fill = self.color(s)
            body = self.text(s.argument() or [])
            return body if fill is None else f"#text(fill: {fill})[{body}]" if name == "textcolor" else f"#highlight(fill: {fill})[{body}]"
        if name in ("definecolor", "colorlet"):
            called = self.flat(s.argument()).strip()
            model, spec = (self.flat(s.argument()).strip() if name == "definecolor" else "named"), self.flat(s.argument())
            found = styles.color(model, spec) or self.colors.get(spec.strip())
            if found:
                self.colors[called] = found
            return ""
        if name == "bibliographystyle":
            self.bib_style = styles.BIB_STYLE_OF.get(self.flat(s.argument()).strip())
            return ""
        if name == "bibitem":
            s.option()
            key = label_key(self.flat(s.argument()))
            return f'\n\n#figure(kind: "bibitem", supplement: none, []) {self.label(key)} '
        if name in ("input", "include"):
            self.warn(n, "needs_manual_review", name=self.flat(s.argument()), reason="the file isn't part of the project")
            return ""
        if name in DROP_WARNED:
            self.warn(n, "drop_only", name=name)
            return ""
        if name in SILENT or plain in SILENT:
            s.option()
            for _ in range(SILENT.get(name, SILENT.get(plain, 0))):
                s.argument()
            return ""
        if S.symbol(name):
            return f"${S.symbol(name)}$"
        self.warn(n, "unsupported_command", name=name)
        s.option()
        while s.at < len(s.nodes) and s.nodes[s.at].kind == "group":
            s.at += 1
        return ""

    def color(self, s: Stream) -> str | None:
        """The color of the next argument: by the model in brackets, else by a name defined here or a common one."""
        model = s.option()
        spec = self.flat(s.argument()).strip()
        if model is not None:
            return styles.color(self.flat(model).strip(), spec)
        return self.colors.get(spec) or styles.COLORS.get(spec.lower())

    def switch(self, name: str, s: Stream) -> str:
        """A declaration holds for the rest of its group; outside of groups and across paragraphs it is dropped."""
        fill = self.color(s) if name == "color" else None
        wrap = SWITCHES.get(name) or (f"#text(fill: {fill})[{{}}]" if fill else None)
        if wrap is None or not s.grouped or any(x.kind in ("par", "env") for x in s.nodes[s.at :]):
            return ""
        rest, s.at = s.nodes[s.at :], len(s.nodes)
        body = self.text(rest, grouped=True)
        inner = body.strip()
        if not inner:
            return body
        tail = body[len(body.rstrip()) :]
        return wrap.format(inner) + tail

    def authors(self, nodes: list[Node]) -> None:
        """Names and affiliations: people are divided by \\and; what follows a name's first line break is its affiliation; a superscript mark stands for the affiliation with the same mark."""
        people: list[list[Node]] = [[]]
        for n in nodes:
            if n.kind == "command" and n.text.lower() in ("and", "quad", "qquad") and (n.text.lower() == "and" or any(x.kind == "command" and x.text == "textbf" for x in people[-1])):
                people.append([])
            else:
                people[-1].append(n)
        found: list[tuple[str, list[str], str | None]] = []
        legend: dict[str, str] = {}
        for one in people:
            lines: list[list[Node]] = [[]]
            for n in one:
                if n.kind == "command" and n.text in ("\\", "\\*"):
                    lines.append([])
                else:
                    lines[-1].append(n)
            name, marks = self.marked(lines[0])
            rest = []
            for line in lines[1:]:
                text, mark = self.marked(line)
                if mark and text:
                    legend |= dict.fromkeys(mark, text)
                elif text:
                    rest.append(text)
            if name:
                found.append((name, marks, ", ".join(rest) or None))
        places: list[str] = []
        shown = []
        for name, marks, own in found:
            of = [legend[m] for m in marks if m in legend] or ([own] if own else [])
            places += [x for x in of if x not in places]
            numbers = ",".join(str(places.index(x) + 1) for x in of)
            shown.append(name + (f"#super[{numbers}]" if numbers else ""))
        self.r.metadata["author"] = ", ".join(shown)
        self.r.metadata["affiliations"] = " #linebreak() ".join(f"#super[{i + 1}] {x}" for i, x in enumerate(places))

    def marked(self, nodes: list[Node]) -> tuple[str, list[str]]:
        """Text without its superscript marks and notes, and the marks."""
        kept, marks, s = [], [], Stream(nodes)
        while s.at < len(s.nodes):
            n = s.nodes[s.at]
            s.at += 1
            if n.kind == "command" and n.text in ("textsuperscript", "footnotemark"):
                marks += re.findall(r"\w+", self.flat(s.option() if n.text == "footnotemark" else s.argument()))
            elif n.kind == "command" and n.text in ("thanks", "orcidlink", "orcidID"):
                s.argument()
            elif n.kind == "math" and n.children and n.children[0].kind == "sign" and n.children[0].text == "^":
                marks += re.findall(r"\w+", self.flat(n.children[1:]))
            elif n.kind == "command" and n.text in ("textbf", "textit", "textrm", "texttt"):
                text, own = self.marked(s.argument() or [])
                kept.append(Node("text", n.start, n.end, text))
                marks += own
            else:
                kept.append(n)
        return re.sub(r"\s+", " ", self.text(kept)).strip(" ,"), marks

    def pseudocode(self, s: Stream) -> str:
        """Numbered lines of an algorithmic body, indented by the blocks that are open."""
        s.option()
        lines: list[tuple[int, str, str, list[Node]]] = []
        depth = 0
        while s.at < len(s.nodes):
            n = s.nodes[s.at]
            s.at += 1
            rule = styles.PSEUDOCODE.get(n.text.lower()) if n.kind == "command" else None
            if rule is None:
                if lines:
                    lines[-1][3].append(n)
                continue
            shown, closing, own, after = rule
            at = s.blanks()
            given = [s.nodes[at]] if at < len(s.nodes) and s.nodes[at].kind == "group" else []
            s.at = at + 1 if given else s.at
            lines.append((max(0, depth + own), shown, closing, given))
            depth = max(0, depth + after)
        out = []
        for i, (level, shown, closing, nodes) in enumerate(lines):
            body = re.sub(r"\s+", " ", self.text(nodes)).strip()
            parts = [f"#strong[{shown}]"] * bool(shown) + [body] * bool(body) + [f"#strong[{closing}]"] * bool(closing)
            out.append(f"#box(width: 1.7em)[#text(size: 0.85em)[{i + 1}.]]" + "#h(1.2em)" * level + " ".join(parts))
        return "block(width: 100%, stroke: (top: 0.8pt, bottom: 0.8pt), inset: (y: 4pt))[#align(left)[" + " \\\n  ".join(out) + "]]"

    def units(self, nodes: list[Node]) -> str:
        """Names of units joined; \\per starts what is divided by, \\squared and \\cubed are exponents."""
        out, prefix = "", ""
        for n in nodes:
            if n.kind == "text":
                out += n.text
            elif n.kind == "command":
                if n.text in PREFIXES:
                    prefix = PREFIXES[n.text]
                elif n.text in ("per", "squared", "cubed"):
                    out += {"per": "/", "squared": "²", "cubed": "³"}[n.text]
                else:
                    space = " " if out and out[-1] not in "/ " else ""
                    out += space + prefix + UNITS.get(n.text, n.text)
                    prefix = ""
        return out

    def branch(self, s: Stream, taken: bool) -> list[Node]:
        """The nodes of the branch that is taken, up to the matching \\fi."""
        depth, kept, active = 0, [], taken
        while s.at < len(s.nodes):
            n = s.nodes[s.at]
            s.at += 1
            if n.kind == "command":
                if n.text.startswith("if") and (n.text[2:] in self.flags or n.text in ("ifnum", "ifx", "ifdim", "iftrue", "iffalse")):
                    depth += 1
                elif n.text == "fi":
                    if not depth:
                        return kept
                    depth -= 1
                elif n.text == "else" and not depth:
                    active = not taken
                    continue
            if active:
                kept.append(n)
        return kept

    def section(self, n: Node, s: Stream) -> str:
        level, starred = LEVELS[n.text.rstrip("*")], n.text.endswith("*")
        s.option()
        title = self.text(s.argument() or []).strip()
        keep, label = s.at, ""
        at = s.blanks()
        if at < len(s.nodes) and s.nodes[at].kind == "command" and s.nodes[at].text == "label":
            s.at = at + 1
            label = self.label(self.flat(s.argument()))
        else:
            s.at = keep
        self.r.headings.append({"level": level, "title": title})
        if starred:
            rule = "(..n) => none" if label else "none"
            head = f"#heading({f'level: {level}, ' if level > 1 else ''}numbering: {rule})[{title}]"
        else:
            head = f"{'=' * level} {title}"
        return f"{head} {label}".rstrip() + "\n\n"

    def cite(self, form: str, s: Stream) -> str:
        notes = [x for x in (s.option(), s.option()) if x is not None]
        keys = [label_key(k) for k in self.flat(s.argument()).split(",") if label_key(k)]
        self.r.citations += keys
        note = self.text(notes[-1]) if notes else ""
        out = []
        for i, k in enumerate(keys):
            extra = f"[{note}]" if note and i == len(keys) - 1 else ""
            out.append(f'#cite(<{k}>, form: "{form}"{f", supplement: {extra}" if extra else ""})' if form else f"@{k}{extra}")
        return " ".join(out)

    def graphics(self, s: Stream) -> str:
        options = self.flat(s.option())
        path = self.flat(s.argument()).strip()
        m = re.search(r"width\s*=\s*([\d.]*)\\(?:textwidth|linewidth|columnwidth|hsize)", options)
        if m:
            width = f", width: {round(100 * float(m[1] or 1))}%"
        else:
            m = re.search(r"width\s*=\s*([\d.]+\s*(?:cm|mm|in|pt|em))", options)
            width = f", width: {m[1].replace(' ', '')}" if m else ""
        inner = f'image("{path}"{width})'
        return inner if self.in_figure else f"#{inner}"

    in_figure = False

    def raw(self, n: Node) -> str:
        body = n.children[0].text
        if n.text == "inline":
            quoted = body.replace("\\", "\\\\").replace('"', '\\"')
            return f'#raw("{quoted}")'
        if n.text.rstrip("*") == "comment":
            return ""
        if n.text == "tikzpicture":
            self.warn(n, "unsupported_environment", name="tikzpicture")
            return ""
        body = re.sub(r"^\s*\[[^\]]*\]", "", body) if n.text == "lstlisting" else re.sub(r"^(?:\s*\[[^\]]*\])?\s*\{[^}]*\}", "", body) if n.text == "minted" else body
        fence = "```" + "`" * ("```" in body)
        return f"{fence}\n{body.strip(chr(10))}\n{fence}\n"

    # -- macros

    def define(self, kind: str, s: Stream) -> str:
        if kind == "let":
            name = self.flat(s.argument()).lstrip("\\")
            at = s.blanks()
            if at < len(s.nodes) and s.nodes[at].kind == "text" and s.nodes[at].text.lstrip().startswith("="):
                s.at = at + 1
            other = self.flat(s.argument())
            called = self.aliases.get(other[1:], other[1:]) if other.startswith("\\") else ""
            if called in self.macros:
                self.macros[name] = self.macros[called]
            elif called:
                self.aliases[name] = called
                self.macros.pop(name, None)
            else:
                self.macros[name] = (0, None, other)
            return ""
        name = self.flat(s.argument()).lstrip("\\").strip()
        arity, default = 0, None
        if kind == "DeclareMathOperator":
            body = f'\\operatorname{{{self.flat(s.argument())}}}'
        else:
            if kind == "def":
                count = ""
                while s.at < len(s.nodes) and s.nodes[s.at].kind == "text":
                    count += s.nodes[s.at].text
                    s.at += 1
                arity = count.count("#")
                delimiters = [re.sub(r"^\d", "", x) for x in count.split("#")[1:]]
                self.delimiters.pop(name, None)
                if any(x.strip() for x in delimiters):
                    self.delimiters[name] = delimiters
            else:
                digits = self.flat(s.option()).strip()
                arity = int(digits) if digits.isdigit() else 0
                default = s.option()
                default = None if default is None else self.source_of(default)
            body = self.source_of(s.argument() or [])
        if name and not (kind == "providecommand" and (name in self.macros or name in WRAPS)):
            self.macros[name] = (arity, default, body)
            self.r.macros.append({"name": name, "params": arity, "body": body})
        return ""

    def source_of(self, nodes: list[Node]) -> str:
        return self.current[nodes[0].start : nodes[-1].end] if nodes else ""

    @property
    def current(self) -> str:
        return self.texts[-1] if self.texts else self.source

    texts: tuple[str, ...] = ()

    def expand(self, n: Node, s: Stream, convert: Callable[[list[Node]], str]) -> str:
        name = n.text
        arity, default, body = self.macros[name]
        if name in self.recursive and name in self.active:
            return ""
        if self.depth >= EXPANSIONS:
            self.recursive |= set(self.active)
            self.warn(n, "custom_macro", name=name, reason="expansions are nested too deeply")
            return ""
        given: list[str] = []
        if default is not None:
            option = s.option()
            given.append(default if option is None else self.source_of(option))
        for delimiter in self.delimiters.get(name, [""] * (arity - len(given)))[: max(0, arity - len(given))]:
            argument = self.until(delimiter, s) if delimiter.strip() else s.argument()
            if argument is None:
                break
            given.append(self.source_of(argument) if isinstance(argument, list) else argument)
        filled = re.sub(r"#(\d)", lambda m: given[int(m[1]) - 1] if 0 < int(m[1]) <= len(given) else m[0], body)
        if not self.depth:
            self.base = n.start
        self.depth += 1
        self.active.append(name)
        self.texts = (*self.texts, filled)
        try:
            return convert(parse(filled).nodes)
        finally:
            self.depth -= 1
            self.active.pop()
            self.texts = self.texts[:-1]

    def until(self, delimiter: str, s: Stream) -> str:
        """The source up to a delimiter, which is passed over; all that is left where it doesn't come."""
        begun, want = s.at, delimiter.strip()
        while s.at < len(s.nodes):
            n = s.nodes[s.at]
            if n.kind == "text" and want in n.text:
                cut = n.start + n.text.index(want)
                head = self.current[s.nodes[begun].start : cut].lstrip()
                left = n.text[n.text.index(want) + len(want) :]
                s.nodes = [*s.nodes[: s.at], Node("text", cut + len(want), n.end, left), *s.nodes[s.at + 1 :]]
                return head
            s.at += 1
        return self.source_of(s.nodes[begun:])

    # -- environments

    def environment(self, n: Node) -> str:
        name = n.text.rstrip("*")
        s = Stream(n.children)
        if name in ("itemize", "enumerate", "description"):
            s.option()
            return self.items(s, {"itemize": "-", "enumerate": "+", "description": "/"}[name])
        if name in ("tabular", "tabularx", "longtable", "array", "tabulary"):
            return "#" * (not self.in_figure) + self.table(name, s) + "\n" * (not self.in_figure)
        if name in ("algorithmic", "algpseudocode"):
            return "#" * (not self.in_figure) + self.pseudocode(s) + "\n" * (not self.in_figure)
        if name == "abstract":
            body = self.text(s.nodes).strip()
            self.r.metadata["abstract"] = body
            return "\n" + styles.abstract_block(styles.ABSTRACTS.get(self.r.metadata.get("class", "")), body) + "\n"
        if name in ("figure", "table", "wrapfigure", "algorithm", "subfigure"):
            return self.figure(n, name, s)
        if name in self.theorems:
            return self.theorem(name, s)
        if name == "proof":
            option = s.option()
            head = self.text(option) if option else "Proof"
            return f"*{head}.* {self.text(s.nodes[s.at:]).strip()} #h(1fr) $square$\n\n"
        if name == "frame":
            s.option()
            title = s.argument() if s.blanks() < len(s.nodes) and s.nodes[s.blanks()].kind == "group" else None
            head = f"== {self.text(title).strip()}\n\n" if title else ""
            return f"#pagebreak(weak: true)\n{head}{self.text(s.nodes[s.at :]).strip()}\n\n"
        if name == "thebibliography":
            s.argument()
            return self.text(s.nodes[s.at :])
        if name in TRANSPARENT:
            if name in ("minipage", "multicols"):
                s.option()
                s.argument()
            return self.text(s.nodes[s.at :], grouped=name != "document")
        self.warn(n, "unsupported_environment", name=n.text)
        return self.text(n.children)

    def items(self, s: Stream, mark: str) -> str:
        out, current, term, begun = [], [], "", False

        def close() -> None:
            if begun:
                body = re.sub(r"\n\n+", "\n\n", self.text(current).strip()).replace("\n", "\n  ")
                out.append(f"{mark} {term}: {body}" if mark == "/" else f"{mark} {body}")

        while s.at < len(s.nodes):
            n = s.nodes[s.at]
            s.at += 1
            if n.kind == "command" and n.text == "item":
                close()
                option = s.option()
                term = self.text(option) if option else ""
                current, begun = [], True
            else:
                current.append(n)
        close()
        return "\n" + "\n".join(out) + "\n"

    def split(self, nodes: list[Node], convert: Callable[[list[Node]], str]) -> list[list[str]]:
        rows: list[list[list[Node]]] = [[[]]]
        s = Stream(nodes)
        while s.at < len(s.nodes):
            n = s.nodes[s.at]
            s.at += 1
            if n.kind == "command" and n.text in ("\\", "tabularnewline", "cr", "\\*"):
                s.option()
                rows.append([[]])
            elif n.kind == "sign" and n.text == "&":
                rows[-1].append([])
            else:
                rows[-1][-1].append(n)
        made = [[convert(cell).strip() for cell in row] for row in rows]
        return [row for row in made if len(row) > 1 or row[0]]

    def columns(self, spec: str) -> list[str]:
        spec = re.sub(r"\*\{(\d+)\}\{([^{}]*)\}", lambda m: m[2] * int(m[1]), spec)
        spec = re.sub(r"[@!><]\{(?:[^{}]|\{[^{}]*\})*\}", "", spec)
        kinds = re.findall(r"[lcrX]|[pmb]\{[^{}]*\}", spec)
        return [{"c": "center", "r": "right"}.get(k[0], "left") for k in kinds]

    def table(self, name: str, s: Stream) -> str:
        s.option()
        if name in ("tabularx", "tabulary"):
            s.argument()
        aligns = self.columns(self.flat(s.argument()))
        rules = any(n.kind == "command" and n.text in ("hline", "toprule", "midrule", "bottomrule") for n in s.nodes)
        inside, self.in_figure = self.in_figure, False
        rows = self.split(s.nodes[s.at :], self.text)
        self.in_figure = inside
        width = max([1, *(sum(int(m[1]) if (m := re.match(r"table\.cell\(colspan: (\d+)\)", c)) else 1 for c in row) for row in rows)])
        aligns = (aligns + ["left"] * width)[:width]
        lines = [f"  columns: {width},", f"  align: ({', '.join(aligns)},)," if width == 1 else f"  align: ({', '.join(aligns)}),", "  stroke: none,"]
        carried = [0] * width  # rows for which a cell above still covers each column
        for i, row in enumerate(rows):
            if rules and i < 2:
                lines.append("  table.hline(),")
            shown, at, after = [], 0, [max(0, c - 1) for c in carried]
            for cell in row:
                if at < width and carried[at] and not cell:  # the empty cell that the source gives for a covered place
                    at += 1
                    continue
                spans = {kind: int(n) for kind, n in re.findall(r"(colspan|rowspan): (\d+)", cell[: cell.find("[")])} if cell.startswith("table.cell(") else {}
                for k in range(at, min(width, at + spans.get("colspan", 1))):
                    after[k] = max(after[k], spans.get("rowspan", 1) - 1)
                shown.append(cell if cell.startswith("table.cell(") else f"[{cell}]")
                at += spans.get("colspan", 1)
            shown += ["[]" for k in range(at, width) if not carried[k]]
            carried = after
            lines.append("  " + ", ".join(shown) + ",")
        if rules and rows:
            lines.append("  table.hline(),")
        return "table(\n" + "\n".join(lines) + "\n)"

    def figure(self, n: Node, name: str, s: Stream) -> str:
        s.option()
        if name in ("wrapfigure", "subfigure"):
            s.argument()
        caption, labels, body = "", [], []
        inner = s.nodes[s.at :]
        f = Stream(inner)
        while f.at < len(f.nodes):
            x = f.nodes[f.at]
            f.at += 1
            if x.kind == "command" and x.text in ("caption", "caption*"):
                f.option()
                caption = self.text(f.argument() or []).strip()
            elif x.kind == "command" and x.text == "label":
                if label := self.label(self.flat(f.argument())):
                    labels.append(label)
            else:
                body.append(x)
        self.in_figure = True
        try:
            pieces = [self.one(x, g).strip() for g in [Stream(body)] for x in self.walk(g)]
        finally:
            self.in_figure = False
        pieces = [p for p in pieces if p]
        code = [p for p in pieces if p.startswith(("image(", "table(", "block("))]
        content = code[0] if len(pieces) == 1 and code else "[" + " ".join("#" + p if p in code else p for p in pieces) + "]"
        lines = [f"  {content},"] + [f"  caption: [{caption}],"] * bool(caption)
        out = "#figure(\n" + "\n".join(lines) + "\n)" + (f" {labels[0]}" if labels else "")
        for extra in labels[1:]:
            out += f"\n#hide[#figure([]) {extra}]"
        return out + "\n"

    @staticmethod
    def walk(s: Stream):
        while s.at < len(s.nodes):
            n = s.nodes[s.at]
            s.at += 1
            yield n

    def theorem(self, name: str, s: Stream) -> str:
        option = s.option()
        note = f"caption: [{self.text(option)}], " if option else ""
        label, body = "", []
        b = Stream(s.nodes[s.at :])
        while b.at < len(b.nodes):
            x = b.nodes[b.at]
            b.at += 1
            if x.kind == "command" and x.text == "label" and not label:
                label = self.label(self.flat(b.argument()))
            else:
                body.append(x)
        return f'#figure(kind: "{name}", supplement: [{self.theorems[name]}], {note}[{self.text(body).strip()}]) {label}'.rstrip() + "\n\n"

    # -- math

    def formula(self, n: Node) -> str:
        labels: list[str] = []
        kept, s = [], Stream(n.children)
        if n.text.startswith("alignat"):
            s.argument()
        while s.at < len(s.nodes):
            x = s.nodes[s.at]
            s.at += 1
            if x.kind == "command" and x.text == "label":
                if label := self.label(self.flat(s.argument())):
                    labels.append(label)
            elif x.kind == "command" and x.text in ("tag", "tag*"):
                s.argument()
                self.warn(x, "drop_only", name="tag")
            elif x.kind == "command" and x.text in ("notag", "nonumber"):
                self.warn(x, "drop_only", name=x.text)
            else:
                kept.append(x)
        body = self.math(kept).strip()
        if n.text == "inline" or n.text == "math":
            return f"${body}$"
        rest = "".join(f'\n#hide[#figure(kind: "equation", supplement: none, []) {x}]' for x in labels[1:])
        return f"\n$ {body} $" + (f" {labels[0]}" if labels else "") + rest + "\n"

    def math(self, nodes: list[Node]) -> str:
        s, out = Stream(nodes), []
        while s.at < len(s.nodes):
            n = s.nodes[s.at]
            s.at += 1
            out.append(self.math_one(n, s))
        joined = ""
        for piece in filter(None, out):
            if joined and (joined[-1].isalnum() and (piece[0].isalnum() or piece[0] == '"') or joined[-1] == '"' and piece[0].isalnum()):
                joined += " "
            joined += piece
        return re.sub(r" +", " ", joined)

    def math_one(self, n: Node, s: Stream) -> str:
        if n.kind == "text":
            return self.letters(n.text)
        if n.kind in ("par", "comment"):
            return " "
        if n.kind == "group":
            return self.math(n.children)
        if n.kind == "sign":
            if n.text in "^_":
                body = self.math(s.argument() or []).strip()
                operator = s.at and any(x.kind == "command" and x.text in LIMITS for x in self.before(n, s))
                return n.text + (body if len(body) == 1 and not operator else f"({body})")
            return " " if n.text == "~" else " & "
        if n.kind in ("open", "close"):
            return n.text
        if n.kind == "math":
            return self.math(n.children)
        if n.kind == "raw":
            return '"' + n.children[0].text.replace('"', "") + '"'
        if n.kind == "env":
            return self.math_environment(n)
        return self.math_command(n, s)

    @staticmethod
    def before(n: Node, s: Stream) -> list[Node]:
        """The operator that a script belongs to: the node before the scripts that end with n."""
        at = next(i for i, x in enumerate(s.nodes) if x is n)
        while at >= 2 and s.nodes[at - 2].kind == "sign" and s.nodes[at - 2].text in "^_":
            at -= 2
        return s.nodes[at - 1 : at]

    def letters(self, text: str) -> str:
        text = re.sub(r"(?<=[A-Za-z])(?=[A-Za-z])", " ", text)
        text = re.sub(r"(?<=\d)(?=[A-Za-z])|(?<=[A-Za-z])(?=\d)", " ", text)
        return re.sub(r'(["#])', r"\\\1", text)

    def two(self, s: Stream) -> tuple[str, str]:
        return self.math(s.argument() or []).strip(), self.math(s.argument() or []).strip()

    def math_command(self, n: Node, s: Stream) -> str:
        if n.text in self.aliases and n.text not in self.macros:
            n = replace(n, text=self.aliases[n.text])
        name = n.text
        if name in self.macros:
            return self.expand(n, s, self.math)
        if name in ("frac", "dfrac", "tfrac", "cfrac"):
            a, b = self.two(s)
            return f"({a}) / ({b})"
        if name in ("binom", "dbinom", "tbinom"):
            a, b = self.two(s)
            return f"binom({a}, {b})"
        if name == "sqrt":
            index = s.option()
            body = self.math(s.argument() or []).strip()
            return f"root({self.math(index).strip()}, {body})" if index else f"sqrt({body})"
        if name in ("overset", "stackrel", "underset"):
            a, b = self.two(s)
            return f"attach({b}, {'b' if name == 'underset' else 't'}: {a})"
        if name in ("text", "textrm", "textbf", "mbox", "textit", "textnormal"):
            return '"' + self.flat(s.argument()).replace('"', '\\"') + '"'
        if name in ("operatorname", "operatorname*"):
            body = self.flat(s.argument())
            return f'op("{body}"{", limits: #true" if name.endswith("*") else ""})'
        if name in S.CALLS:
            body = self.math(s.argument() or []).strip()
            return f"{S.CALLS[name]}({body})".replace(";", '";"')
        if name in S.SPACES:
            return f" {S.SPACES[name]} "
        if name in ("\\", "\\*"):
            s.option()
            return " \\\n"
        if name in ("{", "}"):
            return name
        if name in ("|",):
            return "||"
        if name in ("%", "&", "_", "#", "$"):
            return "\\" + name
        if name in ("phantom", "hphantom", "vphantom"):
            s.argument()
            return ""
        if name == "substack":
            return " \\\n".join(" ".join(row) for row in self.split(s.argument() or [], self.math))
        if name in ("nicefrac", "sfrac"):
            a, b = self.two(s)
            return f"{a} slash {b}"
        if name in ("xrightarrow", "xleftarrow"):
            s.option()
            return f'attach({"->" if name == "xrightarrow" else "<-"}, t: {self.math(s.argument() or []).strip()})'
        if name in ("ensuremath",):
            return self.math(s.argument() or [])
        if name.startswith("if") and name[2:] in self.flags:
            return self.math(self.branch(s, self.flags[name[2:]]))
        if name in S.DROPPED:
            return ""
        if shown := S.symbol(name):
            return f" {shown} " if not shown.isalpha() else shown
        self.warn(n, "ambiguous_math", name=name, reason=f"unknown command {name} in math")
        return f'"{name}"'

    def math_environment(self, n: Node) -> str:
        name = n.text.rstrip("*")
        s = Stream(n.children)
        if name in S.MATRICES or name == "array":
            if name == "array":
                s.option()
                s.argument()
            rows = self.split(s.nodes[s.at :], self.math)
            inner = "; ".join(", ".join(row) for row in rows)
            delim = S.MATRICES.get(name, "#none")
            return f"mat({inner})" if name == "pmatrix" else f"mat(delim: {delim}, {inner})"
        if name in ("cases", "dcases"):
            return "cases(" + ", ".join(" & ".join(row) for row in self.split(s.nodes, self.math)) + ")"
        if name in ("aligned", "split", "gathered", "alignedat"):
            return self.math(n.children)
        self.warn(n, "unsupported_environment", name=n.text)
        return self.math(n.children)


def byte_offsets(text: str) -> np.ndarray:
    """The byte at which each character begins, and the number of bytes at last."""
    if text.isascii():
        return np.arange(len(text) + 1)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.concatenate([[0], np.cumsum(1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF))])


def finish(r: Result, body: str, whole: bool) -> str:
    """Line ends tidied; a whole document gets page, text and heading rules and its title block."""
    body = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", body)).strip("\n ")
    body = re.sub(r"\n\n[ \t]+(?=[^ \t])", "\n\n", body)
    body = re.sub(r"(?<![-\\])---(?!-)", "—", re.sub(r"(?<![-])--(?!-)", "–", body))
    if not whole:
        return body + "\n" if body else ""
    rules = ['#set page(paper: "us-letter", margin: 1in, numbering: "1")', "#set text(size: 10pt)", "#set par(justify: true)", '#set heading(numbering: "1.")']
    size = styles.TITLE_SIZES.get(r.metadata.get("class", ""), "17pt")
    title = [f"#align(center)[#text(size: {size})[{r.metadata['title']}]]"] if r.metadata.get("title") else []
    author = [f"#align(center)[{r.metadata['author']}]"] if r.metadata.get("author") else []
    author += [f"#align(center)[#text(size: 0.9em)[{r.metadata['affiliations']}]]"] if r.metadata.get("affiliations") else []
    return "\n".join([*rules, *title, *author, "", body]) + "\n"


def convert(source: str, seeds: dict[str, tuple[int, str | None, str]] | None = None) -> Result:
    """Convert one document. Never raises: what can't be converted is dropped with a warning. Places are bytes."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), FRAMES))
    tree = parse(source)
    c = Converter(source, seeds)
    body = c.text(tree.nodes)
    c.r.has_error = tree.has_error
    if not source.isascii():
        for x in c.r.source_map:
            x["src_start"], x["src_end"] = int(c.bytes[x["src_start"]]), int(c.bytes[x["src_end"]])
    c.r.typst = finish(c.r, body, c.whole)
    return c.r
