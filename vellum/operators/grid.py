"""Spatial joins over a grid: boxes are written to every cell that they touch, points to one.

The join is on cells. A pair of boxes that share several cells is reported by one: that of its
reference point, the lower corner of what both cover. Cells with very many boxes are split by Spark as skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size)


def in_cells(boxes: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """boxes (x0, y0, x1, y1) once for every cell (cx, cy) that they touch, with a margin."""
    along = lambda a, b: F.sequence(_cell(F.col(a) - margin, size), _cell(F.col(b) + margin, size))
    return boxes.where("x0 <= x1 AND y0 <= y1").select("*", F.explode(along("x0", "x1")).alias("cx")).select("*", F.explode(along("y0", "y1")).alias("cy"))


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """Pairs of points (px, py) and boxes that hold them, within the margin; a pair comes once."""
    at = points.withColumns({"cx": _cell(F.col("px"), size), "cy": _cell(F.col("py"), size)})
    pairs = at.join(in_cells(boxes, size, margin), ["cx", "cy"])
    held = F.col("px").between(F.col("x0") - margin, F.col("x1") + margin) & F.col("py").between(F.col("y0") - margin, F.col("y1") + margin)
    return pairs.where(held).drop("cx", "cy")


def overlapping(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Pairs of left boxes and right boxes (columns with the prefix `other_`) that share an area; a pair comes once."""
    theirs = in_cells(right, size)
    theirs = theirs.select("cx", "cy", *[F.col(c).alias(f"other_{c}") for c in right.columns])
    pairs = in_cells(left, size).join(theirs, ["cx", "cy"])
    x, y = F.greatest("x0", "other_x0"), F.greatest("y0", "other_y0")
    meets = (x < F.least("x1", "other_x1")) & (y < F.least("y1", "other_y1"))
    return pairs.where(meets & (_cell(x, size) == F.col("cx")) & (_cell(y, size) == F.col("cy"))).drop("cx", "cy")
