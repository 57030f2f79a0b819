"""Rectangles [x, y, w, h] in page units, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column, digits: int) -> Column:
    """Half towards plus infinity, at any sign."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def area(r: Column) -> Column:
    return F.get(r, F.lit(2)) * F.get(r, F.lit(3))


def clamped(r: Column) -> Column:
    """The part of a rectangle that lies on the page [0, 1] x [0, 1]."""
    x, y, w, h = (F.get(r, F.lit(i)) for i in range(4))
    left, top = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0))
    return F.array(left, top, F.least(w, F.lit(1.0) - left), F.least(h, F.lit(1.0) - top))


def usable(r: Column) -> Column:
    """Four finite numbers, none beyond 1.2, with an extent."""
    return (
        (F.size(r) >= 4)
        & F.forall(r, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & (F.array_max(r) <= 1.2)
        & (F.get(r, F.lit(2)) > 0)
        & (F.get(r, F.lit(3)) > 0)
    )


def normal_region(rects: Column) -> Column:
    """Usable rectangles, clamped; NULL if none is left."""
    kept = F.transform(F.filter(rects, usable), clamped)
    return F.when(F.size(kept) > 0, kept)


def by_area(rects: Column) -> Column:
    """Largest first; ties keep their order by value."""
    return F.array_sort(rects, lambda a, b: F.when(area(a) > area(b), -1).when(area(a) < area(b), 1).otherwise(0))


def overlap(ax: Column, aw: Column, bx: Column, bw: Column) -> Column:
    return F.greatest(F.least(ax + aw, bx + bw) - F.greatest(ax, bx), F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two rectangles, 0 if they don't meet."""
    g = lambda r, i: F.get(r, F.lit(i))
    inter = overlap(g(a, 0), g(a, 2), g(b, 0), g(b, 2)) * overlap(g(a, 1), g(a, 3), g(b, 1), g(b, 3))
    return F.when(inter > 0, inter / (area(a) + area(b) - inter)).otherwise(0.0)


def union_box(rects: Column) -> Column:
    """The least rectangle around all of them."""
    lo = lambda i: F.array_min(F.transform(rects, lambda r: F.get(r, F.lit(i))))
    hi = lambda i: F.array_max(F.transform(rects, lambda r: F.get(r, F.lit(i)) + F.get(r, F.lit(i + 2))))
    return F.array(lo(0), lo(1), hi(0) - lo(0), hi(1) - lo(1))


def is_permutation(order: Column, n: Column) -> Column:
    return F.when(n > 0, F.array_sort(order) == F.sequence(F.lit(0), n - 1)).otherwise(F.size(order) == 0)


def banded(boxes: Column, gap: float = 0.02) -> Column:
    """Boxes struct(id, x, y) in reading order: columns by left edge, each top to bottom.

    A band starts where a box lies more than `gap` right of the band's first box, so the
    fold carries that box's edge and not the previous one's.
    """
    by_x = F.array_sort(F.transform(boxes, lambda b: F.struct(b["x"].alias("x"), b["id"].alias("id"), b["y"].alias("y"))))
    start = F.struct(F.lit(-1).alias("band"), F.lit(-1e9).alias("left"), F.array().cast("array<struct<band:int,y:double,id:bigint>>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        opens = b["x"] - acc["left"] > gap
        band = F.when(opens, acc["band"] + 1).otherwise(acc["band"])
        row = F.struct(band.alias("band"), b["y"].alias("y"), b["id"].alias("id"))
        return F.struct(band.alias("band"), F.when(opens, b["x"]).otherwise(acc["left"]).alias("left"), F.array_append(acc["out"], row).alias("out"))

    return F.aggregate(by_x, start, step, lambda acc: F.transform(F.array_sort(acc["out"]), lambda r: r["id"]))


def stored_rects(region: Column) -> Column:
    """Rectangles of a stored region, a JSON text of either shape: one bare [x, y, w, h], or an object with rects."""
    kept = F.from_json(region, "rects array<array<double>>, order array<int>")["rects"]
    bare = F.array(F.slice(F.from_json(region, "array<double>"), 1, 4))
    return F.when(F.startswith(F.trim(region), F.lit("{")), kept).when(F.startswith(F.trim(region), F.lit("[")), bare)


def reading_rects(rects: Column, order: Column) -> Column:
    """Rectangles by their stored order where it is a permutation, else in banded reading order."""
    numbered = F.transform(rects, lambda r, i: F.struct(i.cast("long").alias("id"), F.get(r, F.lit(0)).alias("x"), F.get(r, F.lit(1)).alias("y")))
    stored = F.transform(order, lambda i: F.get(rects, i))
    valid = F.coalesce(is_permutation(order, F.size(rects)), F.lit(False))
    return F.when(valid, stored).otherwise(F.transform(banded(numbered), lambda i: F.get(rects, i.cast("int"))))


def edited_region(rects: Column) -> Column:
    """A curator's rectangles as stored: inside the page, to four places, largest first; NULL if any is unfit."""
    g = lambda r, i: F.get(r, F.lit(i))
    fit = F.forall(rects, lambda r: (F.size(r) >= 4) & (g(r, 0) >= 0) & (g(r, 1) >= 0) & (g(r, 2) > 0) & (g(r, 3) > 0) & (g(r, 0) + g(r, 2) <= 1.001) & (g(r, 1) + g(r, 3) <= 1.001))
    return F.when(fit & (F.size(rects) > 0), by_area(F.transform(rects, lambda r: F.transform(F.slice(r, 1, 4), lambda v: round_half_up(v, 4)))))


def from_letterbox(v: Column, pad: float, gain: float, size: float) -> Column:
    """A detector's pixel coordinate as a page coordinate in [0, 1], to four places."""
    return round_half_up(F.least(F.greatest((v - pad) / gain / size, F.lit(0.0)), F.lit(1.0)), 4)
