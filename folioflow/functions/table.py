"""Tables as arrays of rows of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import bound


def render_gfm(rows: Column) -> Column:
    """Pipe table lines; cells are trimmed, pipes escaped and line breaks made spaces."""
    cell = lambda c: F.regexp_replace(F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|")), r"[\r\n]", " ")
    return F.array_join(F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))), "\n")


def drop_empty_rows(rows: Column) -> Column:
    return F.filter(rows, lambda r: F.exists(r, lambda c: F.trim(c) != ""))


def keep_columns(rows: Column, keep) -> Column:
    """The columns (0-based numbers) that keep(number) accepts, in all rows; short rows count as padded with empty cells."""
    width = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    columns = F.when(width > 0, F.filter(F.sequence(F.lit(0), width - 1), keep)).otherwise(F.array().cast("array<int>"))
    return F.transform(rows, lambda r: F.transform(columns, lambda c: F.coalesce(F.get(r, c), F.lit(""))))


def drop_empty_columns(rows: Column) -> Column:
    return keep_columns(rows, lambda c: F.exists(rows, lambda r: F.trim(F.coalesce(F.get(r, c), F.lit(""))) != ""))


def merge_equal_neighbours(rows: Column) -> Column:
    """Without columns that equal their left neighbour in every row."""
    return keep_columns(rows, lambda c: (c == 0) | F.exists(rows, lambda r: F.trim(F.coalesce(F.get(r, c), F.lit(""))) != F.trim(F.coalesce(F.get(r, c - 1), F.lit("")))))


def with_separator(rows: Column) -> Column:
    """A row of --- after the first, as wide as the widest."""
    width = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    return F.when(F.size(rows) == 0, rows).otherwise(F.concat(F.slice(rows, 1, 1), F.array(F.array_repeat(F.lit("---"), width)), F.slice(rows, F.lit(2), F.size(rows))))


def a1_column(name: Column) -> Column:
    """0-based number of a spreadsheet column's letters."""
    letters = F.filter(F.split(F.upper(name), ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda s, c: s * 26 + F.ascii(c) - 64) - 1


def parse_gfm(text: Column) -> Column:
    """Rows of the lines that hold a pipe, without separator lines; escaped pipes stay in their cells."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: F.contains(x, F.lit("|")) & ~x.rlike(r"^[|\-: \t]*$"))
    inner = lambda x: F.regexp_replace(F.trim(x), r"^\||(?<!\\)\|$", "")
    return F.transform(lines, lambda x: F.transform(F.split(inner(x), r"(?<!\\)\|", -1), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|")))))


def size_estimate(text: Column) -> Column:
    """(n_rows, n_cols) of a pipe table's lines: separators don't count, columns are pipes less one."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|") & ~x.contains("---"))
    widest = F.array_max(F.transform(lines, lambda x: F.length(F.regexp_replace(x, r"[^|]", "")) - 1))
    return F.struct(F.size(lines).cast("long").alias("n_rows"), F.greatest(F.coalesce(widest, F.lit(0)), F.lit(0)).cast("long").alias("n_cols"))


def blank_repeats(rows: Column) -> Column:
    """Rows without cells that equal the one above as it stands after this step; rows that are blank or a separator blank nothing."""
    bare = lambda r: F.forall(r, lambda c: F.trim(c).isin("", "---"))
    last = lambda done: F.get(done, F.size(done) - 1)
    none = F.array().cast("array<string>")

    def step(done, row):
        above = F.coalesce(last(done), none)
        same = lambda c, k: ~bare(above) & (F.trim(c) != "") & F.coalesce(F.trim(c) == F.trim(F.get(above, k)), F.lit(False))
        return F.concat(done, F.array(F.transform(row, lambda c, k: F.when(same(c, k), F.lit("")).otherwise(c))))

    def of(rows):
        # each step copies what is done, so it is done in blocks of the root's length
        size = F.greatest(F.ceil(F.sqrt(F.size(rows))).cast("int"), F.lit(1))

        def block(done, at):
            cut = F.aggregate(F.slice(rows, at, size), F.array(F.coalesce(last(last(done)), none)), step)
            return F.concat(done, F.array(F.slice(cut, F.lit(2), F.size(cut))))

        starts = F.when(F.size(rows) > 0, F.sequence(F.lit(1), F.size(rows), size)).otherwise(F.array().cast("array<int>"))
        return F.when(rows.isNotNull(), F.flatten(F.aggregate(starts, F.array().cast("array<array<array<string>>>"), block)))

    return bound(rows, of)
