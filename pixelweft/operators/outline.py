"""Outlines of regions as rows: sides, straight runs of sides, and closed loops.

A side of a cell that faces another region is a step with the cell on its right hand.
The step after it is known from the cells around its end: where two corners of a region
touch there, the outline turns right and stays with its own cells. Straight steps are
joined to runs, from corner to corner. Each run points at the next one, and from these
pointers every run learns which is the first of its loop and how far along it stands,
without any task that walks along a whole outline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from .tiles import TILE, chained

#: Sides in the order of a walk around one cell: where it begins, and (dx, dy) of its direction.
SIDES = {"N": ((0, 0), (1, 0)), "E": ((1, 0), (0, 1)), "S": ((1, 1), (-1, 0)), "W": ((0, 1), (0, -1))}
#: A place and side as one number; sides of images are shorter.
ROW = 1 << 16


def _key(x: Column, y: Column, side: int) -> Column:
    return (y.cast("long") * ROW + x) * 4 + side


def _near(c: Column | str, dx: int, dy: int) -> Column:
    """c of the cell one step away, null where there is none."""
    along, across, k = ("x", "y", dx) if dx else ("y", "x", dy)
    w = Window.partitionBy("image_id", across).orderBy(along)
    return F.when(F.lead(along, k).over(w) == F.col(along) + k, F.lead(c, k).over(w))


def steps(cells: DataFrame) -> DataFrame:
    """cells (image_id, x, y, region, before) -> image_id, region, side (0 to 3 for N, E, S, W), x, y, key, next and inner of each step.

    before is the number of clear cells left of a cell in its row; inner is signed so
    that the sum over a loop is the number of clear cells that it goes around, counted
    negative by the loops of holes.
    """
    names = list(SIDES)
    rows = cells.repartition("image_id")
    ahead = {n: (SIDES[names[i - 1]][1]) for i, n in enumerate(names)}  # direction in which a side faces
    rows = rows.withColumns({n: _near("region", *ahead[n]) for n in names})
    # of the cell straight ahead of a step, what lies on its left hand
    rows = rows.withColumns({f"{n}_left": _near(n, *SIDES[n][1]) for n in names})
    found = []
    for i, n in enumerate(names):
        (dx, dy), (fx, fy) = SIDES[n][1], ahead[n]
        right = names[(i + 1) % 4]
        x, y, own = F.col("x"), F.col("y"), F.col("region")
        to = F.when(F.coalesce(F.col(right) != own, F.lit(True)), _key(x, y, (i + 1) % 4)).when(F.col(f"{n}_left") == own, _key(x + dx + fx, y + dy + fy, (i + 3) % 4)).otherwise(_key(x + dx, y + dy, i))
        inner = F.col("before") * (1 if n == "E" else -1) if n in "EW" else F.lit(0)
        open_ = F.coalesce(F.col(n) != own, F.lit(True))
        found.append(F.when(open_, F.struct(F.lit(i).alias("side"), _key(x, y, i).alias("key"), to.alias("next"), inner.cast("long").alias("inner"))))
    return rows.select("image_id", "region", "x", "y", F.inline(F.filter(F.array(*found), lambda s: s.isNotNull()))).select("image_id", "region", "side", "x", "y", "key", "next", "inner")


def runs(all_steps: DataFrame) -> DataFrame:
    """image_id, region, key, next (of the first step of this run and of the following one), x, y (where it begins), twice the area it adds to its loop, and inner."""
    flat = F.col("side") % 2 == 0
    line, along = F.when(flat, F.col("y")).otherwise(F.col("x")), F.when(flat, F.col("x")).otherwise(F.col("y"))
    rows = all_steps.withColumn("line", line).withColumn("at", F.when(F.col("side") < 2, along).otherwise(-along))
    w = Window.partitionBy("image_id", "side", "line").orderBy("at")
    rows = rows.withColumn("first", F.when(F.lag("next").over(w) == F.col("key"), 0).otherwise(1)).withColumn("run", F.sum("first").over(w))
    begin = {c: F.element_at(F.array(*[F.lit(SIDES[s][0][i]) for s in SIDES]), F.col("side") + 1) for i, c in enumerate("xy")}
    edge = F.when(F.col("side") == 1, F.col("x") + 1).when(F.col("side") == 3, -F.col("x")).otherwise(0)
    out = rows.groupBy("image_id", "region", "side", "line", "run").agg(
        F.min_by("key", "at").alias("key"), F.max_by("next", "at").alias("next"), F.min_by(F.col("x") + begin["x"], "at").alias("x"), F.min_by(F.col("y") + begin["y"], "at").alias("y"),
        F.sum(edge).cast("long").alias("area"), F.sum("inner").alias("inner"),
    )
    return out.select("image_id", "region", "key", "next", "x", "y", "area", "inner")


def loops(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """cells (image_id, x, y, region, before) -> image_id, region, head, area (negative: a hole), inner and points (corners along the way, cells on the right hand).

    head is the number of a loop's first step, the smallest of those at a corner.
    """
    rows = stored(runs(steps(cells)))
    known = rows.join(chained(rows, tile), ["image_id", "key"])
    out = known.groupBy("image_id", "region", "head").agg(F.sum("area").alias("area"), F.sum("inner").alias("inner"), F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("points"))
    return out.withColumn("points", F.transform("points", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))))
