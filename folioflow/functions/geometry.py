"""Boxes and points as columns: structs of l, t, r, b and of x, y."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _span(a: Column, b: Column) -> Column:
    return F.greatest(b - a, F.lit(0.0))


def overlap_share(p: Column, q: Column) -> Column:
    """Area that two boxes share, for each unit of the smaller one's area; whichever way their vertical axis points."""
    low = lambda x: F.least(x["t"], x["b"])
    high = lambda x: F.greatest(x["t"], x["b"])
    area = lambda x: _span(x["l"], x["r"]) * (high(x) - low(x))
    shared = _span(F.greatest(p["l"], q["l"]), F.least(p["r"], q["r"])) * _span(F.greatest(low(p), low(q)), F.least(high(p), high(q)))
    smaller = F.least(area(p), area(q))
    return F.when(smaller > 0, shared / smaller).otherwise(F.lit(0.0))


def from_bottom(box: Column, height: Column) -> Column:
    """A box measured from the top of a page as one measured from its bottom, or the other way round."""
    return F.struct(box["l"].alias("l"), (height - box["t"]).alias("t"), box["r"].alias("r"), (height - box["b"]).alias("b"))


def moved(point: Column, transforms: Column) -> Column:
    """A point after transforms (sx, sy, dx, dy), the innermost first: each scales and then shifts."""
    start = F.struct(point["x"].cast("double").alias("x"), point["y"].cast("double").alias("y"))
    return F.aggregate(transforms, start, lambda p, m: F.struct((p["x"] * m["sx"] + m["dx"]).alias("x"), (p["y"] * m["sy"] + m["dy"]).alias("y")))


def finite(value: Column) -> Column:
    """Whether a number can take part in geometry: neither null, nor NaN, nor infinite."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) != float("inf")), F.lit(False))


def matrix_product(m: Column, n: Column) -> Column:
    """m, then n: affine maps of row vectors as structs of a, b, c, d, e, f."""
    cell = lambda p, q, r, s: m[p] * n[q] + m[r] * n[s]
    return F.struct(
        cell("a", "a", "b", "c").alias("a"), cell("a", "b", "b", "d").alias("b"), cell("c", "a", "d", "c").alias("c"), cell("c", "b", "d", "d").alias("d"),
        (cell("e", "a", "f", "c") + n["e"]).alias("e"), (cell("e", "b", "f", "d") + n["f"]).alias("f"),
    )


def mapped(m: Column, x: Column, y: Column) -> Column:
    return F.struct((x * m["a"] + y * m["c"] + m["e"]).alias("x"), (x * m["b"] + y * m["d"] + m["f"]).alias("y"))


def image_box(m: Column, width: Column, height: Column) -> Column:
    """The hull, cut to the page, of the unit square under m; from the bottom, null if nothing is left."""
    corners = [mapped(m, F.lit(float(x)), F.lit(float(y))) for x in (0, 1) for y in (0, 1)]
    cut = lambda v, size: F.when(size > 0, F.greatest(F.lit(0.0), F.least(size, v))).otherwise(v)
    low, high = (lambda k, size: cut(F.least(*(c[k] for c in corners)), size)), (lambda k, size: cut(F.greatest(*(c[k] for c in corners)), size))
    l, t, r, b = low("x", width), high("y", height), high("x", width), low("y", height)  # noqa: E741
    return F.when((r > l) & (t > b), F.struct(l.alias("l"), t.alias("t"), r.alias("r"), b.alias("b")))


def dots_an_inch(pixels_x: Column, pixels_y: Column, box: Column) -> Column:
    """Rounded mean of both resolutions of an image in a box of points, within 1 and 2400; 72 without a box."""
    mean = (pixels_x * 72 / (box["r"] - box["l"]) + pixels_y * 72 / (box["t"] - box["b"])) / 2
    return F.when(mean.isNull(), 72).otherwise(F.least(F.greatest(F.round(mean), F.lit(1.0)), F.lit(2400.0))).cast("long")


def page_box(crop: Column, media: Column) -> Column:
    """What a page shows: the part of its media box inside its crop box, or all of it if they don't meet."""
    both = F.struct(F.greatest(crop["l"], media["l"]).alias("l"), F.least(crop["t"], media["t"]).alias("t"), F.least(crop["r"], media["r"]).alias("r"), F.greatest(crop["b"], media["b"]).alias("b"))
    return F.when((both["r"] > both["l"]) & (both["t"] > both["b"]), both).otherwise(media)


def user_unit(value: Column) -> Column:
    """A page's unit; 1 for one that is none or would make pages beyond 75000."""
    return F.when(finite(value) & (value > 0) & (value <= 75_000), value).otherwise(F.lit(1.0))


def rotation(value: Column) -> Column:
    """0, 90, 180 or 270; 0 for what is no quarter turn."""
    return F.when(value % 90 == 0, F.pmod(value, F.lit(360))).otherwise(F.lit(0)).cast("long")


def middle(low: Column, high: Column) -> Column:
    return (low + high) / 2
