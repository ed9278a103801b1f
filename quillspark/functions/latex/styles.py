"""Dimension data of colors, bibliography styles, document classes and pseudocode, as fixed values of the target's notation."""

from __future__ import annotations

import re

# Color names.
COLORS = {
    "red": "red", "green": "green", "blue": "blue", "black": "black", "white": "white", "yellow": "yellow", "orange": "orange", "purple": "purple",
    "teal": "teal", "olive": "olive", "lime": "lime", "navy": "navy", "maroon": "maroon", "aqua": "aqua", "fuchsia": "fuchsia", "silver": "silver",
    "eastern": "eastern", "gray": "gray", "grey": "gray", "cyan": "aqua", "magenta": "fuchsia", "violet": "purple", "pink": "fuchsia",
    "darkgray": "gray", "darkgrey": "gray", "lightgray": "silver", "lightgrey": "silver",
}

# Names of bibliography styles by the style that stands for them.
BIB_STYLES = {
    "ieee": "plain alpha abbrv unsrt ieeetr IEEEtran ieee siamplain siam",
    "springer-basic": "splncs04 spmpsci spbasic spphys",
    "association-for-computing-machinery": "ACM-Reference-Format acmnumeric acm acmauthoryear",
    "apa": "plainnat abbrvnat unsrtnat apa apalike apacite chicago chicagoa chicago-author-date agsm dcu",
    "mla": "mla",
    "elsevier-with-titles": "elsarticle-num elsarticle-num-names",
    "elsevier-harvard": "elsarticle-harv",
}
BIB_STYLE_OF = {name: style for style, names in BIB_STYLES.items() for name in names.split()}

# What stands before and after a line of pseudocode, by command: shown, closing, change of its own depth and of the next line's.
PSEUDOCODE = {
    "state": ("", "", 0, 0), "statex": ("", "", 0, 0), "require": ("Require:", "", 0, 0), "ensure": ("Ensure:", "", 0, 0), "input": ("Input:", "", 0, 0),
    "output": ("Output:", "", 0, 0), "return": ("return", "", 0, 0), "print": ("print", "", 0, 0), "for": ("for", "do", 0, 1), "forall": ("for", "do", 0, 1),
    "endfor": ("end for", "", -1, -1), "while": ("while", "do", 0, 1), "endwhile": ("end while", "", -1, -1), "if": ("if", "then", 0, 1),
    "elsif": ("else if", "then", -1, 0), "elseif": ("else if", "then", -1, 0), "else": ("else", "", -1, 0), "endif": ("end if", "", -1, -1),
    "loop": ("loop", "", 0, 1), "endloop": ("end loop", "", -1, -1), "repeat": ("repeat", "", 0, 1), "until": ("until", "", -1, -1),
    "procedure": ("procedure", "", 0, 1), "endprocedure": ("end procedure", "", -1, -1), "function": ("function", "", 0, 1),
    "endfunction": ("end function", "", -1, -1), "comment": ("▷", "", 0, 0),
}

# How a class sets its abstract, and the size of its title.
ABSTRACTS = {"article": "centered", "IEEEtran": "run-in", "llncs": "bold run-in", "svmult": "bold run-in", "acmart": "heading"}
TITLE_SIZES = {"article": "1.728em", "IEEEtran": "2.4em", "llncs": "1.44em", "svmult": "1.44em", "acmart": "1.728em"}


def color(model: str, spec: str) -> str | None:
    """A color of a model in the target's notation; None where the spec doesn't fit the model."""
    spec = spec.strip()
    if model.lower() == "html":
        m = re.fullmatch(r"#?([0-9A-Fa-f]{2})([0-9A-Fa-f]{2})([0-9A-Fa-f]{2})", spec)
        return f"rgb({', '.join(str(int(x, 16)) for x in m.groups())})" if m else None
    if model.lower() == "named":
        return COLORS.get(spec.lower())
    try:
        values = [float(x) for x in spec.split(",")]
    except ValueError:
        return None
    call = {"rgb": ("rgb", 3), "gray": ("luma", 1), "cmyk": ("cmyk", 4)}.get(model.lower())
    if call is None or len(values) != call[1]:
        return None
    shown = (str(int(v)) for v in values) if model == "RGB" else (f"{v * 100:.0f}%" for v in values)
    return f"{call[0]}({', '.join(shown)})"


def abstract_block(kind: str | None, body: str) -> str:
    """An abstract as its class sets it."""
    head = '#align(center)[#text(weight: "bold")[Abstract]]\n#v(0.4em)\n'
    if kind == "centered":
        return f"#v(1em)\n#text(size: 0.9em)[\n{head}#pad(x: 2.5em)[\n  {body}]\n]\n#v(0.6em)\n"
    if kind == "run-in":
        return f'#text(size: 0.9em, weight: "bold")[#emph[Abstract]---{body}]\n#v(0.5em)\n'
    if kind == "bold run-in":
        return f"#pad(x: 1cm)[#text(size: 0.9em)[*Abstract.* {body}]]\n#v(0.5em)\n"
    if kind == "heading":
        return f'#v(0.075in)\n#align(center)[#text(size: 1.2em, weight: "bold")[Abstract]]\n#v(0.5em)\n#pad(x: 1em)[\n  {body}]\n#v(1em)\n'
    return f"#v(1em)\n{head}#pad(x: 2em)[\n  {body}]\n#v(0.6em)\n"
