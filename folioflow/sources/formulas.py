"""Formulas of Word files as LaTeX."""

from __future__ import annotations

from collections.abc import Callable

from folioflow.functions.latex import ACCENTS, OPERATORS, SPECIAL, SYMBOLS

#: Formulas nested deeper give their visible text.
MAX_DEPTH = 64

#: LaTeX of formula parts, with the names of the children that stand in it.
FORMS = {
    "f": r"\frac{<num>}{<den>}", "sSub": "{<e>}_{<sub>}", "sSup": "{<e>}^{<sup>}", "sSubSup": "{<e>}_{<sub>}^{<sup>}", "sPre": "{}_{<sub>}^{<sup>}{<e>}",
    "limLow": "{<e>}_{<lim>}", "limUpp": "{<e>}^{<lim>}", "borderBox": r"\boxed{<e>}", "phant": r"\phantom{<e>}", "brk": r"\\",
}
#: Elements that only say how others look.
LOOKS = {"chr", "pos", "begChr", "endChr", "sepChr", "type", "grow", "degHide", "subHide", "supHide", "ctrlPr"}

_CHARS = str.maketrans(SPECIAL | {c: f"\\{name} " for c, name in SYMBOLS.items()})


class _TooDeep(ValueError):
    pass


def _local(node) -> str:
    return node.tag.rpartition("}")[2]


class _Part:
    """An element of a formula: its children as LaTeX, its properties."""

    def __init__(self, node, depth: int):
        if depth > MAX_DEPTH:
            raise _TooDeep
        self.node, self.name, self.depth = node, _local(node), depth

    def each(self, name: str) -> list[str]:
        return [_latex(c, self.depth + 1) for c in self.node if _local(c) == name]

    def one(self, name: str) -> str:
        return next((_latex(c, self.depth + 1) for c in self.node if _local(c) == name), "")

    def value(self, name: str, default: str | None = None) -> str | None:
        """The value of a property; default where the property or its value is missing."""
        for looks in (c for c in self.node if _local(c) == self.name + "Pr"):
            for p in (c for c in looks if _local(c) == name):
                return next((v.strip() for k, v in p.attrib.items() if k.rpartition("}")[2] == "val" and v.strip()), default)
            break
        return default

    def has(self, name: str) -> bool:
        return self.value(name, "on").lower() not in ("0", "false", "off") and any(_local(p) == name for c in self.node if _local(c) == self.name + "Pr" for p in c)


def _root(p: _Part) -> str:
    degree = p.one("deg")
    return rf"\sqrt[{degree}]{{{p.one('e')}}}" if degree and not p.has("degHide") else rf"\sqrt{{{p.one('e')}}}"


def _large(p: _Part) -> str:
    sign = p.value("chr", "∫")
    bounds = "".join(f"{mark}{{{x}}}" for mark, x in (("_", p.one("sub")), ("^", p.one("sup"))) if x)
    return f"{OPERATORS.get(sign) or sign.translate(_CHARS)}{bounds}{{{p.one('e')}}}"


def _fenced(p: _Part) -> str:
    mark = lambda c: "\\" + c if c in "{}" else c
    return rf"\left{mark(p.value('begChr', '('))}{p.value('sepChr', '|').translate(_CHARS).join(p.each('e'))}\right{mark(p.value('endChr', ')'))}"


def _matrix(p: _Part) -> str:
    rows = [" & ".join(_Part(r, p.depth + 1).each("e")) for r in p.node if _local(r) == "mr"]
    return r"\begin{matrix}" + r" \\ ".join(rows) + r"\end{matrix}"


def _function(p: _Part) -> str:
    name = p.one("fName").strip()
    return rf"\operatorname{{{name}}}{{{p.one('e')}}}" if name else p.one("e")


def _over(p: _Part) -> str:
    above = p.value("pos", "bot").lower() == "top" or p.value("chr", "⏟") == "⏞"
    return rf"\{'over' if above else 'under'}brace{{{p.one('e')}}}"


BUILT: dict[str, Callable[[_Part], str]] = {
    "rad": _root, "nary": _large, "d": _fenced, "m": _matrix, "func": _function, "groupChr": _over,
    "eqArr": lambda p: r"\begin{aligned}" + r" \\ ".join(p.each("e")) + r"\end{aligned}",
    "bar": lambda p: rf"\{'under' if p.value('pos', 'top').lower() == 'bot' else 'over'}line{{{p.one('e')}}}",
    "acc": lambda p: f"{ACCENTS.get(p.value('chr', 'ˆ'), chr(92) + 'hat')}{{{p.one('e')}}}",
}


def _latex(node, depth: int) -> str:
    part = _Part(node, depth)
    if part.name == "t":
        return (node.text or "").translate(_CHARS)
    if part.name in BUILT:
        return BUILT[part.name](part)
    if part.name in FORMS:
        pieces = FORMS[part.name].replace(">", "<").split("<")
        return "".join(part.one(piece) if k % 2 else piece for k, piece in enumerate(pieces))
    if part.name.endswith("Pr") or part.name in LOOKS:
        return ""
    own = node.text if node.text and node.text.strip() else ""
    return own.translate(_CHARS) + "".join(_latex(c, depth + 1) for c in node)


def latex(node) -> str:
    """A formula's element as LaTeX; its visible text where it is empty as LaTeX or nested too deep."""
    try:
        said = _latex(node, 0).strip()
    except _TooDeep:
        said = ""
    return said or "".join(t.text or "" for t in node.iter() if _local(t) == "t").strip()
