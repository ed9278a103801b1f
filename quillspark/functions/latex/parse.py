"""A tolerant LaTeX parser. It never raises: what doesn't close is marked as an error and read as far as it goes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

RAW = ("verbatim", "Verbatim", "lstlisting", "minted", "comment", "tikzpicture")
MATH = ("equation", "align", "gather", "multline", "eqnarray", "displaymath", "math", "alignat", "flalign")
NAME = re.compile(r"\\([A-Za-z@]+\*?|.|\n)", re.S)
TEXT = re.compile(r"[^\\{}$%\[\]^_&~\n]+")
BREAK = re.compile(r"[ \t]*\n(?:[ \t]*\n)+[ \t]*")
#: Deeper nesting is an error and is read flat; it bounds the stack, not the document.
MAX_DEPTH = 1000
STRAY = re.compile(r"\}|\$\$|\$|\\end\s*\{[^{}]*\}|\\[\])]|.", re.S)


@dataclass
class Node:
    """kind: text, par, comment, command, group, env, math, raw, sign, open, close. text: the name or the characters."""

    kind: str
    start: int
    end: int
    text: str = ""
    children: list[Node] = field(default_factory=list)


@dataclass
class Tree:
    nodes: list[Node]
    has_error: bool


class Parser:
    def __init__(self, source: str):
        self.source, self.at, self.error = source, 0, False

    def run(self) -> Tree:
        nodes: list[Node] = []
        while self.at < len(self.source):
            nodes += self.until(None, 0)
            if self.at < len(self.source):  # a closer that nothing opened
                self.error = True
                self.at = STRAY.match(self.source, self.at).end()
        return Tree(nodes, self.error)

    def closes(self, closer: str | None) -> bool:
        s, at = self.source, self.at
        return s[at] == "}" or s.startswith("\\end", at) and not s[at + 4 : at + 5].isalpha() or s.startswith(("\\]", "\\)"), at) or closer in ("$", "$$") and s[at] == "$"

    def until(self, closer: str | None, depth: int) -> list[Node]:
        """Nodes up to what closes the construct; self.at is then at the closer."""
        out, s = [], self.source
        while self.at < len(s) and not self.closes(closer):
            at, c = self.at, s[self.at]
            if c == "%":
                end = s.find("\n", at)
                end = len(s) if end < 0 else end
                out.append(self.node("comment", end, s[at + 1 : end]))
            elif c == "\\":
                out.append(self.command(depth))
            elif c == "{":
                out.append(self.nested("group", 1, "}", depth))
            elif c == "$":
                mark = "$$" if s.startswith("$$", at) else "$"
                out.append(self.nested("math", len(mark), mark, depth, "display" if mark == "$$" else "inline"))
            elif m := BREAK.match(s, at):
                out.append(self.node("par", m.end()))
            elif c in "[]":
                out.append(self.node("open" if c == "[" else "close", at + 1, c))
            elif c in "^_&~":
                out.append(self.node("sign", at + 1, c))
            elif c == "\n":
                out.append(self.node("text", at + 1, "\n"))
            else:
                m = TEXT.match(s, at)
                end = m.end()
                out.append(self.node("text", end, m[0]))
        return out

    def node(self, kind: str, end: int, text: str = "", children: list[Node] | None = None) -> Node:
        node = Node(kind, self.at, end, text, children or [])
        self.at = end
        return node

    def nested(self, kind: str, skip: int, closer: str, depth: int, text: str = "") -> Node:
        begin = self.at
        self.at += skip
        if depth > MAX_DEPTH:
            self.error = True
            return Node("text", begin, self.at, "")
        children = self.until(closer, depth + 1)
        if self.source.startswith(closer, self.at):
            self.at += len(closer)
        else:
            self.error = True
        return Node(kind, begin, self.at, text, children)

    def command(self, depth: int) -> Node:
        s, at = self.source, self.at
        m = NAME.match(s, at)
        if not m:
            self.error = True
            return self.node("text", at + 1, "")
        name = m[1]
        if name in ("(", "["):
            return self.nested("math", 2, "\\)" if name == "(" else "\\]", depth, "inline" if name == "(" else "display")
        if name == "begin" and (b := re.compile(r"\s*\{([^{}]*)\}").match(s, m.end())):
            return self.environment(b[1].strip(), b.end(), depth)
        if name in ("verb", "verb*", "lstinline") and m.end() < len(s) and not s[m.end()].isspace():
            close = {"{": "}"}.get(s[m.end()], s[m.end()])
            end = s.find(close, m.end() + 1)
            if end >= 0 and "\n" not in s[m.end() : end]:
                return self.node("raw", end + 1, "inline", [Node("text", m.end() + 1, end, s[m.end() + 1 : end])])
        return self.node("command", m.end(), name)

    def environment(self, name: str, body: int, depth: int) -> Node:
        s, begin = self.source, self.at
        closer = f"\\end{{{name}}}"
        if name.rstrip("*") in RAW:
            end = s.find(closer, body)
            if end < 0:
                self.error, end = True, len(s)
            self.at = min(len(s), end + len(closer))
            return Node("raw", begin, self.at, name, [Node("text", body, end, s[body:end])])
        self.at = body
        if depth > MAX_DEPTH:
            self.error = True
            return Node("text", begin, body, "")
        children = self.until(closer, depth + 1)
        m = re.compile(r"\\end\s*\{\s*" + re.escape(name) + r"\s*\}").match(s, self.at)
        if m:
            self.at = m.end()
        else:
            self.error = True
        return Node("math" if name.rstrip("*") in MATH else "env", begin, self.at, name, children)


def parse(source: str) -> Tree:
    return Parser(source).run()
