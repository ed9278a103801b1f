"""Dimension data of the math kernel, as fixed values of the target's notation. Names that follow a rule are made by it."""

from __future__ import annotations

# Names that are the same in both notations.
SAME = """alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi chi psi omega digamma
Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega times div equiv approx bullet angle perp parallel top bot in subset supset
forall exists sum lim sup inf max min partial nabla ell degree dagger prime Re Im aleph beth gimel daleth backslash sin cos tan cot sec
csc arcsin arccos arctan sinh cosh tanh coth log ln lg exp det dim ker arg deg hom Pr gcd liminf limsup quad prec succ models therefore
because complement multimap checkmark yen frown smile""".split()

# Relations and operators.
RELATIONS = {
    "leq": "<=", "le": "<=", "geq": ">=", "ge": ">=", "neq": "!=", "ne": "!=", "sim": "tilde.op", "simeq": "tilde.eq", "cong": "tilde.equiv",
    "asymp": "≍", "propto": "prop", "varpropto": "prop", "coloneqq": "colon.eq", "coloneq": "colon.eq", "eqqcolon": "eq.colon", "doteq": "eq.dots",
    "bowtie": "join", "notin": "in.not", "ni": "in.rev", "owns": "in.rev", "subseteq": "subset.eq", "supseteq": "supset.eq", "subsetneq": "subset.neq",
    "supsetneq": "supset.neq", "sqsubseteq": "subset.eq.sq", "sqsupseteq": "supset.eq.sq", "Subset": "subset.double", "Supset": "supset.double",
    "preceq": "prec.eq", "succeq": "succ.eq", "ll": "lt.double", "gg": "gt.double", "lll": "lt.triple", "ggg": "gt.triple", "vdash": "tack.r",
    "dashv": "tack.l", "Vdash": "tack.r.double", "vDash": "tack.r.double", "mid": "divides", "shortmid": "divides", "shortparallel": "parallel",
    "approxeq": "approx.eq", "backsim": "tilde.rev", "backsimeq": "tilde.rev.eq", "eqcirc": "eq.o", "backepsilon": "in.rev", "geqq": "gt.equiv",
    "leqq": "lt.equiv", "geqslant": "gt.eq.slant", "leqslant": "lt.eq.slant", "gtrless": "gt.lt", "lessgtr": "lt.gt", "gtreqless": "gt.eq.lt",
    "lesseqgtr": "lt.eq.gt", "gneq": "gt.nequiv", "lneq": "lt.nequiv", "preccurlyeq": "prec.curly.eq", "succcurlyeq": "succ.curly.eq",
    "triangleleft": "lt.tri", "vartriangleleft": "lt.tri", "triangleright": "gt.tri", "vartriangleright": "gt.tri", "trianglelefteq": "lt.tri.eq",
    "trianglerighteq": "gt.tri.eq", "lhd": "lt.tri.eq", "rhd": "gt.tri.eq", "nexists": "exists.not",
}
# Operators, letters, marks and brackets.
OPERATORS = {
    "cdot": "dot.c", "cdotp": "dot.c", "centerdot": "dot.c", "pm": "plus.minus", "mp": "minus.plus", "circ": "circle.small", "star": "star.op",
    "ast": "ast.op", "otimes": "times.o", "oplus": "plus.o", "ominus": "minus.o", "odot": "dot.o", "oslash": "slash.o", "boxtimes": "times.square",
    "boxplus": "plus.square", "boxminus": "minus.square", "boxdot": "dot.square", "circleddash": "minus.o", "circledast": "ast.op.o",
    "circledcirc": "compose.o", "rtimes": "times.r", "ltimes": "times.l", "leftthreetimes": "times.three.l", "rightthreetimes": "times.three.r",
    "divideontimes": "times.div", "dotplus": "plus.dot", "wr": "wreath", "uplus": "union.plus", "sqcup": "union.sq", "sqcap": "inter.sq",
    "cup": "union", "cap": "inter", "Cup": "union.double", "Cap": "inter.double", "setminus": "without", "smallsetminus": "without", "neg": "not",
    "lnot": "not", "land": "and", "wedge": "and", "lor": "or", "vee": "or", "implies": "==>", "iff": "<==>", "prod": "product", "coprod": "product.co",
    "int": "integral", "smallint": "integral", "iint": "integral.double", "iiint": "integral.triple", "oint": "integral.cont", "infty": "infinity",
    "emptyset": "nothing", "varnothing": "emptyset", "hbar": "planck", "hslash": "planck", "imath": "dotless.i", "jmath": "dotless.j", "flat": "♭",
    "sharp": "♯", "natural": "♮", "clubsuit": "♣", "spadesuit": "♠", "heartsuit": "♥", "diamondsuit": "diamond", "Diamond": "diamond",
    "diamond": "diamond", "Box": "square", "square": "square", "triangle": "triangle", "bigtriangleup": "triangle", "bigtriangledown": "triangle.b",
    "vartriangle": "triangle.t", "triangledown": "triangle.b", "blacktriangle": "triangle.filled.t", "blacktriangledown": "triangle.filled.b",
    "blacksquare": "square.filled", "bigstar": "star.filled", "lozenge": "lozenge.stroked", "blacklozenge": "lozenge.filled",
    "sphericalangle": "angle.spheric", "measuredangle": "angle.arc", "backprime": "prime.rev", "ddagger": "dagger.double", "dag": "dagger",
    "ddag": "dagger.double", "dots": "dots.h", "ldots": "dots.h", "mathellipsis": "dots.h", "cdots": "dots.c", "vdots": "dots.v", "ddots": "dots.down",
    "pmod": "mod", "bmod": "mod", "colon": ":", "vcentcolon": "colon", "lbrace": "{", "rbrace": "}", "vert": "|", "lvert": "|", "rvert": "|",
    "Vert": "||", "lVert": "||", "rVert": "||", "langle": "chevron.l", "rangle": "chevron.r", "lceil": "ceil.l", "rceil": "ceil.r",
    "lfloor": "floor.l", "rfloor": "floor.r", "llbracket": "bracket.l.stroked", "rrbracket": "bracket.r.stroked", "imageof": "image", "origof": "original",
}
# Arrows that follow no rule.
ARROWS = {
    "to": "arrow.r", "gets": "arrow.l", "mapsto": "arrow.r.bar", "longmapsto": "arrow.r.bar.long", "leadsto": "arrow.r.squiggly",
    "rightsquigarrow": "arrow.r.squiggly", "Lsh": "arrow.l.hook", "Rsh": "arrow.r.hook", "Lleftarrow": "arrow.l.triple", "Rrightarrow": "arrow.r.triple",
    "updownarrow": "arrow.t.b", "Updownarrow": "arrows.tb", "uparrow": "arrow.t", "downarrow": "arrow.b", "Uparrow": "arrow.t.double",
    "Downarrow": "arrow.b.double", "upuparrows": "arrows.tt", "downdownarrows": "arrows.bb", "leftrightarrows": "arrows.lr", "leftleftarrows": "arrows.ll",
    "rightrightarrows": "arrows.rr", "rightleftarrows": "harpoons.rtlb", "rightleftharpoons": "harpoons.rtlb", "leftrightharpoons": "harpoons.ltrb",
    "restriction": "harpoon.tr",
}


def by_rule() -> dict[str, str]:
    """Names whose target follows from their parts."""
    out = {f"var{x}": f"{x}.alt" for x in ("epsilon", "theta", "pi", "rho", "sigma", "phi", "kappa")}
    for word, side in (("left", "l"), ("right", "r"), ("leftright", "l.r")):
        out |= {f"{word}arrow": f"arrow.{side}", f"{word.capitalize()}arrow": f"arrow.{side}.double", f"long{word}arrow": f"arrow.{side}.long", f"Long{word}arrow": f"arrow.{side}.double.long", f"n{word}arrow": f"arrow.{side}.not", f"n{word.capitalize()}arrow": f"arrow.{side}.double.not"}
    for word, side in (("left", "l"), ("right", "r")):
        out |= {f"hook{word}arrow": f"arrow.{side}.hook", f"twohead{word}arrow": f"arrow.{side}.twohead", f"{word}arrowtail": f"arrow.{side}.tail", f"looparrow{word}": f"arrow.{side}.loop", f"curvearrow{word}": f"arrow.{side}.curve", f"dash{word}arrow": f"arrow.{side}.dashed"}
        out |= {f"{word}harpoonup": f"harpoon.{side}t", f"{word}harpoondown": f"harpoon.{side}b", f"upharpoon{word}": f"harpoon.t{side}", f"downharpoon{word}": f"harpoon.b{side}", f"blacktriangle{word}": f"triangle.filled.{side}"}
    out |= {f"{a}{b}arrow": f"arrow.{x}{y}" for a, x in (("n", "t"), ("s", "b")) for b, y in (("e", "r"), ("w", "l"))}
    out |= {f"big{word}": f"{target}.big" for word, target in (("cup", "union"), ("cap", "inter"), ("vee", "or"), ("wedge", "and"), ("oplus", "plus.o"), ("otimes", "times.o"), ("odot", "dot.o"))}
    for word, base in (("prec", "prec"), ("succ", "succ"), ("gtr", "gt"), ("less", "lt")):
        out |= {f"{word}sim": f"{base}.tilde", f"{word}approx": f"{base}.approx"}
    for word, base in (("prec", "prec"), ("succ", "succ"), ("g", "gt"), ("l", "lt")):
        out |= {f"{word}napprox": f"{base}.napprox", f"{word}nsim": f"{base}.ntilde"}
    out |= {"gtrdot": "gt.dot", "lessdot": "lt.dot", "precneqq": "prec.nequiv", "succneqq": "succ.nequiv"}
    for word, base in (("geq", "gt.eq"), ("leq", "lt.eq"), ("gtr", "gt"), ("less", "lt"), ("sim", "tilde"), ("equiv", "equiv"), ("mid", "divides"), ("parallel", "parallel"), ("shortparallel", "parallel"), ("subseteq", "subset.eq"), ("supseteq", "supset.eq"), ("prec", "prec"), ("succ", "succ"), ("preceq", "prec.eq"), ("succeq", "succ.eq"), ("triangleleft", "lt.tri"), ("triangleright", "gt.tri"), ("trianglelefteq", "lt.tri.eq"), ("trianglerighteq", "gt.tri.eq"), ("vdash", "tack.r"), ("vDash", "tack.r.double")):
        out[f"n{word}"] = f"{base}.not"
    return out | {"ncong": "tilde.nequiv", "nVdash": "tack.r.not.double", "nVDash": "tack.r.double.not.double"}


TABLE = {**{x: x for x in SAME}, **by_rule(), **RELATIONS, **OPERATORS, **ARROWS}

# Alphabets, accents and other calls with one argument.
CALLS = {"mathbb": "bb", "mathcal": "cal", "mathfrak": "frak", "mathbf": "bold", "boldsymbol": "bold", "bm": "bold", "mathrm": "upright", "mathsf": "sans", "mathtt": "mono", "mathit": "italic", "hat": "hat", "widehat": "hat", "bar": "macron", "overline": "overline", "underline": "underline", "vec": "arrow", "dot": "dot", "ddot": "dot.double", "tilde": "tilde", "widetilde": "tilde", "acute": "acute", "grave": "grave", "breve": "breve", "check": "caron", "underbrace": "underbrace", "overbrace": "overbrace", "cancel": "cancel", "pmb": "bold", "mathscr": "cal"}
SPACES = {",": "thin", "thinspace": "thin", ":": "med", ">": "med", "medspace": "med", ";": "thick", "thickspace": "thick", "quad": "quad", "qquad": "quad quad", " ": "space", "!": "", "negthinspace": ""}
MATRICES = {"matrix": "#none", "pmatrix": '"("', "bmatrix": '"["', "Bmatrix": '"{"', "vmatrix": '"|"', "Vmatrix": '"||"', "smallmatrix": "#none"}
DROPPED = {"displaystyle", "textstyle", "scriptstyle", "limits", "nolimits", "left", "right", "big", "Big", "bigg", "Bigg", "bigl", "bigr", "Bigl", "Bigr", "biggl", "biggr", "Biggl", "Biggr", "bigm", "Bigm", "middle", "nonumber"}


def symbol(name: str) -> str | None:
    """The target's name of a command, or None."""
    return TABLE.get(name)
