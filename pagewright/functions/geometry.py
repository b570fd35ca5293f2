"""Rectangles in page space, normalised to 0..1 from the top left: structs of x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import let


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def max_x(r: Column) -> Column:
    return r["x"] + r["w"]


def max_y(r: Column) -> Column:
    return r["y"] + r["h"]


def mid_x(r: Column) -> Column:
    return r["x"] + r["w"] / 2


def mid_y(r: Column) -> Column:
    return r["y"] + r["h"] / 2


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def is_valid(r: Column) -> Column:
    """Finite, with an area."""
    fine = is_finite(r["x"]) & is_finite(r["y"]) & is_finite(r["w"]) & is_finite(r["h"])
    return F.coalesce(fine & (r["w"] > 0) & (r["h"] > 0), F.lit(False))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def overlap_1d(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a_hi, b_hi) - F.greatest(a_lo, b_lo))


def x_overlap(a: Column, b: Column) -> Column:
    return overlap_1d(a["x"], max_x(a), b["x"], max_x(b))


def y_overlap(a: Column, b: Column) -> Column:
    return overlap_1d(a["y"], max_y(a), b["y"], max_y(b))


def overlap_over_smaller(a: Column, b: Column) -> Column:
    """Common area over the smaller area; 0 without one."""
    smaller = F.least(a["w"] * a["h"], b["w"] * b["h"])
    return F.when(smaller > 0, x_overlap(a, b) * y_overlap(a, b) / smaller).otherwise(F.lit(0.0))


def normalized(r: Column, page: Column, rotation: Column) -> Column:
    """A page-space rectangle (from the bottom left, points) in the displayed page, clipped; ``page`` is the media box.

    Rotations are clockwise quarter turns in degrees; others count as 0. A page without area gives null.
    """
    lo_x = clamp((r["x"] - page["x"]) / page["w"])
    hi_x = clamp((max_x(r) - page["x"]) / page["w"])
    lo_y = clamp((r["y"] - page["y"]) / page["h"])
    hi_y = clamp((max_y(r) - page["y"]) / page["h"])
    turn = F.pmod(F.coalesce(rotation, F.lit(0)), F.lit(360))
    w, h = hi_x - lo_x, hi_y - lo_y
    shown = F.when(turn == 90, rect(lo_y, lo_x, h, w)).when(turn == 180, rect(1 - hi_x, lo_y, w, h)).when(turn == 270, rect(1 - hi_y, 1 - hi_x, h, w)).otherwise(rect(lo_x, 1 - hi_y, w, h))
    return F.when((page["w"] > 0) & (page["h"] > 0), shown)


def from_lower_left(r: Column) -> Column:
    """A normalised rectangle from the bottom left, as recognisers give it, from the top left and clipped."""
    lo_x, hi_x, lo_y, hi_y = clamp(r["x"]), clamp(max_x(r)), clamp(1 - max_y(r)), clamp(1 - r["y"])
    return rect(lo_x, lo_y, hi_x - lo_x, hi_y - lo_y)


def union_agg(r: Column) -> Column:
    """The smallest rectangle around all of a group, as an aggregate."""
    x, y = F.min(r["x"]), F.min(r["y"])
    return rect(x, y, F.max(max_x(r)) - x, F.max(max_y(r)) - y)


def median_of(a: Column) -> Column:
    """The mean of the two middle elements; 0 of none."""
    at = lambda s, k: F.get(s, F.floor(k).cast("int"))
    return let(F.array_sort(a), lambda s: F.coalesce((at(s, (F.size(s) - 1) / 2) + at(s, F.size(s) / 2)) / 2, F.lit(0.0)))


def upper_median_agg(c: Column) -> Column:
    """The element at n div 2 of the sorted values of a group, which is bounded (a line's glyphs, a page's lines)."""
    a = F.sort_array(F.collect_list(c))
    return F.get(a, F.floor(F.size(a) / 2).cast("int"))


def lower_median_agg(c: Column) -> Column:
    a = F.sort_array(F.collect_list(c))
    return F.get(a, F.floor((F.size(a) - 1) / 2).cast("int"))
