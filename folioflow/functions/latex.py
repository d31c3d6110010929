"""Characters of formulas as LaTeX."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: LaTeX of characters that stand for themselves nowhere, and of letters and signs of formulas.
SPECIAL = {"_": r"\_", "#": r"\#", "%": r"\%", "&": r"\&", "$": r"\$", "{": r"\{", "}": r"\}", "\\": r"\backslash{}"}
SYMBOLS = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "θ": "theta", "λ": "lambda", "μ": "mu", "π": "pi", "σ": "sigma", "φ": "phi", "ω": "omega",
    "Γ": "Gamma", "Δ": "Delta", "Θ": "Theta", "Λ": "Lambda", "Π": "Pi", "Σ": "Sigma", "Φ": "Phi", "Ω": "Omega",
    "≤": "leq", "≥": "geq", "≠": "neq", "≈": "approx", "±": "pm", "×": "times", "÷": "div", "∞": "infty", "∂": "partial", "∇": "nabla", "∈": "in", "∉": "notin",
}
#: Commands of large operators, and of accents over what follows.
OPERATORS = {"∫": r"\int", "∬": r"\iint", "∭": r"\iiint", "∮": r"\oint", "∑": r"\sum", "∏": r"\prod", "∐": r"\coprod", "⋂": r"\bigcap", "⋃": r"\bigcup", "⨀": r"\bigodot", "⨂": r"\bigotimes", "⨁": r"\bigoplus"}
ACCENTS = {"¯": r"\bar", "̅": r"\bar", "→": r"\vec", "⃗": r"\vec", "˙": r"\dot", "̇": r"\dot", "¨": r"\ddot", "̈": r"\ddot", "˜": r"\tilde", "~": r"\tilde"}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def escape(text: Column) -> Column:
    """A text as part of a formula: special characters escaped, letters and signs as commands."""
    known = _map(SPECIAL | {c: f"\\{name} " for c, name in SYMBOLS.items()})
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(known[c], c)), "")


def limits(lower: Column, upper: Column) -> Column:
    """Bounds below and above; an empty or null one is left out."""
    part = lambda sign, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(sign + "{"), x, F.lit("}"))).otherwise("")
    return F.concat(part("_", lower), part("^", upper))


def large_operator(sign: Column) -> Column:
    return F.coalesce(_map(OPERATORS)[sign], escape(sign))


def delimiter(sign: Column) -> Column:
    """A sign as it stands after left or right: braces escaped, a dot for none."""
    return F.when(sign == "{", r"\{").when(sign == "}", r"\}").when(F.coalesce(sign, F.lit("")) == "", ".").otherwise(sign)


def accent(sign: Column) -> Column:
    """The command of an accent, a hat for what is not known."""
    return F.coalesce(_map(ACCENTS)[sign], F.lit(r"\hat"))
