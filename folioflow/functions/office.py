"""Column expressions over parts, references, metadata and code of office documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import WHITE, is_blank, strip

#: Canonical names of programming languages by alias.
LANGUAGES = {
    "ada": "Ada", "awk": "Awk", "bash": "Bash", "sh": "Bash", "shell": "Bash", "bc": "bc", "c": "C", "c#": "C#", "csharp": "C#", "c++": "C++", "cpp": "C++", "cmake": "CMake", "cobol": "COBOL", "css": "CSS",
    "ceylon": "Ceylon", "clojure": "Clojure", "crystal": "Crystal", "cuda": "Cuda", "cython": "Cython", "d": "D", "dart": "Dart", "dc": "dc", "dockerfile": "Dockerfile", "elixir": "Elixir", "erlang": "Erlang",
    "fortran": "FORTRAN", "forth": "Forth", "go": "Go", "golang": "Go", "html": "HTML", "haskell": "Haskell", "haxe": "Haxe", "java": "Java", "javascript": "JavaScript", "js": "JavaScript", "json": "JSON",
    "julia": "Julia", "kotlin": "Kotlin", "latex": "Latex", "lisp": "Lisp", "lua": "Lua", "matlab": "Matlab", "moonscript": "MoonScript", "nim": "Nim", "ocaml": "OCaml", "objectivec": "ObjectiveC",
    "objective-c": "ObjectiveC", "octave": "Octave", "php": "PHP", "pascal": "Pascal", "perl": "Perl", "prolog": "Prolog", "python": "Python", "py": "Python", "racket": "Racket", "ruby": "Ruby", "rust": "Rust",
    "sml": "SML", "sql": "SQL", "scala": "Scala", "scheme": "Scheme", "swift": "Swift", "tikz": "Tikz", "typescript": "TypeScript", "ts": "TypeScript", "visualbasic": "VisualBasic", "visual-basic": "VisualBasic",
    "xml": "XML", "yaml": "YAML", "yml": "YAML",
}
#: Words for a comment's state.
RESOLVED, UNRESOLVED = ("resolved", "closed", "done", "1", "true", "on"), ("active", "open", "0", "false", "off")
#: Classes of embedded objects by kind.
OBJECTS = {"smartart": "smartart", "wordart": "wordart", "shape": "shape", "ole": "embedded_object", "embedded_object": "embedded_object"}


def _map(values: Mapping[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def code_language(name: Column) -> Column:
    """The canonical name of a programming language, unknown for none that is known."""
    return F.coalesce(_map(LANGUAGES)[F.lower(strip(name))], F.lit("unknown"))


def resolved(state: Column) -> Column:
    """Whether a comment's state says that it is settled; null for a state that says neither."""
    said = F.lower(strip(state))
    return F.when(said.isin(*RESOLVED), True).when(said.isin(*UNRESOLVED), False)


def object_class(kind: Column) -> Column:
    return F.coalesce(_map(OBJECTS)[F.lower(kind)], F.lit("office_object"))


def object_caption(text: Column, name: Column, program: Column, target: Column, kind: Column) -> Column:
    """What an embedded object is found by: its visible text, else its name, program, file name or class."""
    said = lambda x: F.nullif(strip(x), F.lit(""))
    return F.coalesce(said(text), said(name), F.nullif(program, F.lit("")), F.nullif(F.substring_index(target, "/", -1), F.lit("")), object_class(kind))


def comment_meta(fields: Mapping[str, Column]) -> Column:
    """A comment's fields that say something, as a map of strings."""
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in fields.items()))
    return F.map_from_entries(F.filter(entries, lambda e: F.coalesce(e["value"], F.lit("")) != ""))


def merged_meta(extra: Column, known: Column) -> Column:
    """Two maps of names to raw JSON as one JSON object by name. The second wins where it says something; its blank and null values are left out. Null for two nulls."""
    none = F.create_map().cast("map<string,string>")
    said = F.map_filter(F.coalesce(known, none), lambda _, v: ~F.trim(F.coalesce(v, F.lit(""))).isin("", "null"))
    kept = F.map_filter(F.coalesce(extra, none), lambda k, v: v.isNotNull() & ~F.array_contains(F.map_keys(said), k))
    pairs = F.transform(F.array_sort(F.map_entries(F.map_concat(kept, said))), lambda e: F.concat(F.regexp_extract(F.to_json(F.array(e["key"])), r"(?s)^\[(.*)\]$", 1), F.lit(":"), e["value"]))
    return F.when(extra.isNotNull() | known.isNotNull(), F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))


def flag(meta: Column, key: str) -> Column:
    """Whether a flag of JSON metadata is set to true, as for headings without a level of their own."""
    return F.coalesce(F.get_json_object(meta, f"$.{key}") == "true", F.lit(False))


def safe_member(name: Column) -> Column:
    """Whether an archive member's name stays inside the archive: neither empty, absolute, on a drive, nor up the tree."""
    n = F.replace(name, F.lit("\\"), F.lit("/"))
    return F.coalesce((n != "") & ~n.startswith("/") & (F.substr(n, F.lit(2), F.lit(1)) != ":") & ~F.array_contains(F.split(n, "/"), ".."), F.lit(False))


def part_path(folder: Column, target: Column) -> Column:
    """A relationship's target as a path from the archive's root: absolute ones drop the slash, others start in folder, dots are followed."""
    whole = F.when(target.startswith("/"), target).otherwise(F.concat(folder, F.lit("/"), target))
    steps = F.filter(F.split(whole, "/"), lambda p: ~p.isin("", "."))
    walk = F.aggregate(steps, F.array().cast("array<string>"), lambda done, p: F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))))
    return F.array_join(walk, "/")


def reference(kind: Column, idx: Column) -> Column:
    """#/kind/idx; #/kind for the roots, which have no number."""
    return F.when(idx.isNull(), F.concat(F.lit("#/"), kind)).otherwise(F.concat(F.lit("#/"), kind, F.lit("/"), idx.cast("string")))


def parsed_reference(ref: Column) -> Column:
    """(kind, idx) of a reference; nulls for what is none."""
    form = r"^#/(\w+)(?:/(\d+))?$"
    part = lambda k: F.nullif(F.regexp_extract(ref, form, k), F.lit(""))
    return F.struct(part(1).alias("kind"), part(2).cast("long").alias("idx"))


def item_text(kind: Column, text: Column, image_caption: Column, image_footnote: Column, table_caption: Column, table_body: Column, table_footnote: Column, latex: Column) -> Column:
    """What an item says in its own way: lines of an image or a table, a formula's source, else its text."""
    lines = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), "\n")
    return F.when(kind == "image", lines(image_caption, text, image_footnote)).when(kind == "table", lines(table_caption, table_body, table_footnote)).when((kind == "equation") & (F.coalesce(latex, F.lit("")) != ""), latex).otherwise(F.coalesce(text, F.lit("")))


def goes_multimodal(kind: Column, source: Column, own: str, opted: bool = False) -> Column:
    """Whether an item goes to retrieval by text: images, tables and equations of the own reader only if opted in."""
    return F.lit(opted) | ~(kind.isin("image", "table", "equation") & F.coalesce(source == own, F.lit(False)))


def printable_share(text: Column) -> Column:
    """Share of characters other than white space that can be read; 0 without any."""
    solid = F.regexp_replace(text, f"[{WHITE}]", "")
    return F.when(F.length(solid) > 0, F.length(F.regexp_replace(solid, r"[\p{Cc}\x{FFFD}\p{Co}]", "")) / F.length(solid)).otherwise(F.lit(0.0))


def visible_strings(texts: Column) -> Column:
    """Strings that say something, trimmed, each where it first occurs."""
    return F.array_distinct(F.filter(F.transform(texts, strip), lambda t: ~is_blank(t)))


def fenced_json(text: Column) -> Column:
    """The outermost braces of an answer that may stand in a code fence; null without any."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def text_of_box(text: Column) -> Column:
    """A task's text without the ballot box before it."""
    return F.regexp_replace(text, r"^[☐☑☒][\s]*", "")
