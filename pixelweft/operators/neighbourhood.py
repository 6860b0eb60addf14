"""3 x 3 neighbourhood operators.

A window comes from two window functions, along rows and then along columns, both
within an image: one shuffle by image_id serves them, and later operators keyed by
image. Images are bounded by the pixel budget, so no partition grows without end. Depth
below an edge is a distance, not a number of passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_even
from ..schema import ALPHA
from ..sources.store import stored

NEAR4 = ((-1, 0), (1, 0), (0, -1), (0, 1))
IMAGE = ["image_id", "x", "y"]


def windows(px: DataFrame, value: Column, only: Column | None = None) -> DataFrame:
    """px with near: the values of the up to nine pixels around and at each, those for which only holds."""
    item = value if only is None else F.when(only, value)
    row = Window.partitionBy("image_id", "y").orderBy("x").rangeBetween(-1, 1)
    column = Window.partitionBy("image_id", "x").orderBy("y").rangeBetween(-1, 1)
    out = px.repartition("image_id").withColumn("v_", item).withColumn("row_", F.collect_list("v_").over(row))
    return out.withColumn("near", F.flatten(F.collect_list("row_").over(column))).drop("v_", "row_")


def median_filter(px: DataFrame, passes: int = 1) -> DataFrame:
    """Upper median of each channel over the opaque pixels around; opaque pixels only."""
    opaque = F.col("a") >= ALPHA
    for _ in range(passes):
        near = windows(px, F.struct("r", "g", "b"), opaque)
        mid = lambda c: F.element_at(F.array_sort(F.transform("near", lambda s: s[c])), F.expr("CAST(size(near) div 2 + 1 AS INT)"))  # noqa: B023, E731
        px = near.select("image_id", "x", "y", *[F.when(opaque, mid(c)).otherwise(F.col(c)).alias(c) for c in "rgb"], "a")
    return px


def mode_filter(px: DataFrame) -> DataFrame:
    """Opaque pixels take the colour that five or more of the opaque ones around them have."""
    opaque, rgb = F.col("a") >= ALPHA, (F.col("r") * 65536 + F.col("g") * 256 + F.col("b"))
    near = windows(px, rgb, opaque).withColumn("near", F.array_sort("near"))
    # five equal ones of at most nine, sorted, reach over the middle
    middle = F.element_at("near", F.expr("CAST(size(near) div 2 + 1 AS INT)"))
    near = near.withColumn("m_", F.when(opaque, middle)).withColumn("n_", F.size(F.filter("near", lambda v: v == F.col("m_"))))
    take = opaque & (F.col("n_") >= 5)
    new = {"r": F.shiftright("m_", 16), "g": F.shiftright("m_", 8).bitwiseAND(255), "b": F.col("m_").bitwiseAND(255)}
    return near.select("image_id", "x", "y", *[F.when(take, new[c]).otherwise(F.col(c)).cast("int").alias(c) for c in "rgb"], "a")


def _beside(order: str, across: str, c: Column) -> tuple[Column, Column]:
    """c of the pixel before and of that after, null where there is none."""
    w = Window.partitionBy("image_id", across).orderBy(order)
    at = lambda k: F.when(F.lag(order, k).over(w) == F.col(order) - k, F.lag(c, k).over(w))
    return at(1), at(-1)


def _any_beside(c: Column) -> Column:
    """Whether c holds for one of the four neighbours; beyond the edge it does not."""
    four = [*_beside("x", "y", c), *_beside("y", "x", c)]
    return reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in four])


def boundary(px: DataFrame) -> DataFrame:
    """px with edge: opaque and beside a transparent pixel."""
    return px.repartition("image_id").withColumn("edge", (F.col("a") >= ALPHA) & _any_beside(F.col("a") < ALPHA))


def clear_distance(px: DataFrame) -> DataFrame:
    """px with away: steps along rows and columns to the nearest transparent pixel of the image (0 there; null: there is none).

    Distances along rows come first, from the last and the next transparent pixel; the
    least sum with a distance along the column then is two running minima. That is four
    windows, however far away transparency is.
    """
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    so_far, from_here = (Window.unboundedPreceding, 0), (0, Window.unboundedFollowing)
    at = F.when(F.col("a") < ALPHA, F.col("x"))
    px = px.repartition("image_id").withColumn("in_row_", F.least(F.col("x") - F.max(at).over(row.rowsBetween(*so_far)), F.min(at).over(row.rowsBetween(*from_here)) - F.col("x")))
    above = F.min(F.col("in_row_") - F.col("y")).over(column.rowsBetween(*so_far)) + F.col("y")
    below = F.min(F.col("in_row_") + F.col("y")).over(column.rowsBetween(*from_here)) - F.col("y")
    return px.withColumn("away", F.least(above, below)).drop("in_row_")


def erode(px: DataFrame, passes: int) -> DataFrame:
    """Peels rings: opaque pixels within so many steps of a transparent one get alpha 0; the image's edge is no transparency."""
    gone = (F.col("a") >= ALPHA) & (F.col("away") <= passes)
    return clear_distance(px).withColumn("a", F.when(gone, 0).otherwise(F.col("a"))).drop("away")


def rings(px: DataFrame, depth: int) -> DataFrame:
    """px with d: 0 transparent, 1 to depth the rings next to it, null deeper."""
    return clear_distance(px).withColumn("d", F.when(F.col("away") <= depth, F.col("away"))).drop("away")


def defringe(px: DataFrame, depth: int) -> DataFrame:
    """Repaints the rings next to transparency from deeper pixels, innermost ring first; a ring's pixels do not see each other."""
    names = px.columns
    px = rings(px, depth)
    for k in range(depth, 0, -1):
        if depth - k in (3, 6):  # plans of more rings than these take longer to make than to run
            px = stored(px)
        deeper = F.col("d").isNull() | (F.col("d") > k)
        near = windows(px, F.struct("r", "g", "b"), deeper)
        size = F.size("near")
        total = lambda c: F.aggregate("near", F.lit(0), lambda s, v: s + v[c])  # noqa: B023, E731
        take = (F.col("d") == k) & (size > 0)
        px = near.withColumns({c: F.when(take, half_even(total(c) / size)).otherwise(F.col(c)) for c in "rgb"}).drop("near")
    return px.select(*names)
