"""A tracer of its own: regions of like colour to outlines, polygons or curves, as rows up to the text of each loop.

Parameters mean here: filter_speckle k drops regions below k x k cells;
layer_difference merges neighbouring regions whose cells all stay within it of their
mean colour, in every channel; stacked fills holes that hold no clear cell, as what
lies in them is drawn later, cutout leaves all; corner_threshold (degrees) keeps sharper
turns as corners; length_threshold is the shortest piece that is fitted as a curve;
splice_threshold (degrees) splits a curve where it has turned so far; path_precision is
the number of decimals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import shortest
from ..functions.path import _chain, fit_cubics
from ..schema import ALPHA
from ..sources.raster import sizes, within_budget
from ..sources.store import stored
from .merge import merged
from .outline import loops
from .region import regions

Point = tuple[float, float]
#: Farthest that a curve may be off the outline, in pixels.
FIT = 0.75


@dataclass(frozen=True)
class TraceOptions:
    mode: str = "spline"
    hierarchical: str = "stacked"
    color_mode: str = "color"
    filter_speckle: int = 8
    layer_difference: int = 16
    corner_threshold: float = 60.0
    length_threshold: float = 4.0
    splice_threshold: float = 45.0
    path_precision: int = 3

    def __post_init__(self) -> None:
        for value, known in ((self.mode, ("spline", "polygon", "none")), (self.hierarchical, ("stacked", "cutout")), (self.color_mode, ("color", "binary"))):
            if value not in known:
                raise ValueError(f"{value!r} is none of {', '.join(known)}")


def _turn(a: Point, b: Point, c: Point) -> float:
    """Degrees by which the way turns at b."""
    d = math.degrees(math.atan2(c[1] - b[1], c[0] - b[0]) - math.atan2(b[1] - a[1], b[0] - a[0]))
    return abs((d + 180) % 360 - 180)


def polygon(loop: list[Point], tolerance: float = 1.0) -> list[Point]:
    """The loop with steps of a pixel smoothed out; its first point stays."""
    mids = [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(loop, loop[1:] + loop[:1])]
    long = [math.dist(a, b) > 2 for a, b in zip(loop, loop[1:] + loop[:1])]
    pts = []
    for p, m, after, before in zip(loop, mids, long, long[-1:] + long[:-1]):
        # between two long sides is a corner; else the middles of the sides will do
        pts += [p] if after and before else []
        pts += [] if after and before else [m]
    pts = pts if len(pts) > 2 else loop
    ends = _chain([*pts, pts[0]], tolerance)
    return [pts[0], *ends[:-1]] if len(ends) > 2 else loop


def spline(loop: list[Point], o: TraceOptions) -> str:
    """Curves between the corners of the smoothed loop."""
    pts = polygon(loop, 0.5)
    n = len(pts)
    say = lambda *ps: " ".join(_number(v, o) for p in ps for v in p)
    corners = [i for i in range(n) if _turn(pts[i - 1], pts[i], pts[(i + 1) % n]) >= o.corner_threshold] or [0]
    out = [f"M{say(pts[corners[0]])}"]
    for a, b in zip(corners, corners[1:] + [corners[0] + n]):
        piece, turned = [pts[a % n]], 0.0
        runs = []
        for i in range(a + 1, b + 1):
            piece.append(pts[i % n])
            if i < b:
                turned += _turn(pts[i - 1 if i else -1] if i <= n else pts[(i - 1) % n], pts[i % n], pts[(i + 1) % n])
                if turned >= max(o.splice_threshold, 1) * 2:
                    runs.append(piece)
                    piece, turned = [pts[i % n]], 0.0
        runs.append(piece)
        for run in runs:
            if len(run) == 2 or sum(math.dist(p, q) for p, q in zip(run, run[1:])) < o.length_threshold:
                out += [f"L{say(p)}" for p in run[1:]]
            else:
                out += [f"C{say(*c)}" for c in fit_cubics(run, FIT)]
    return " ".join(out) + " Z"


def _number(v: float, o: TraceOptions) -> str:
    return shortest(round(float(v), o.path_precision) + 0.0)


def outline(loop: list[Point], o: TraceOptions) -> str:
    if o.mode == "spline":
        return spline(loop, o)
    pts = polygon(loop) if o.mode == "polygon" else loop
    return " ".join(f"{'L' if i else 'M'}{_number(x, o)} {_number(y, o)}" for i, (x, y) in enumerate(pts)) + " Z"


def layers(px: DataFrame, o: TraceOptions) -> DataFrame:
    """Cells of what is drawn: image_id, x, y, rgb, region, area (cells of the region) and before (clear cells left of the cell in its row)."""
    if o.color_mode == "binary":
        dark = F.col("r") < 128
        px = px.select("image_id", "x", "y", *[F.lit(0).alias(c) for c in "rgb"], F.when(dark, 255).otherwise(0).alias("a"))
    px = stored(within_budget(px))
    cells = regions(px)
    if o.layer_difference > 0 and o.color_mode == "color":
        cells = merged(cells, o.layer_difference)
    left = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    clear = px.select("image_id", "x", "y", F.coalesce(F.count_if(F.col("a") < ALPHA).over(left), F.lit(0)).alias("before"))
    large = cells.groupBy("image_id", "region").agg(F.count("*").alias("area")).where(F.col("area") >= o.filter_speckle**2)
    return cells.join(large, ["image_id", "region"]).join(clear, ["image_id", "x", "y"])


def layer_loops(cells: DataFrame, o: TraceOptions) -> DataFrame:
    """layers() as image_id, region, rgb, cells (their number), left, top, head, hole and points of every loop that is drawn, from the region's corner."""
    cells = stored(cells)
    boxes = cells.groupBy("image_id", "region").agg(F.min("rgb").alias("rgb"), F.min("area").alias("cells"), F.min("x").alias("left"), F.min("y").alias("top"))
    found = loops(cells.select("image_id", "x", "y", "region", "before")).join(boxes, ["image_id", "region"])
    points = F.transform("points", lambda p: F.struct((p["x"] - F.col("left")).alias("x"), (p["y"] - F.col("top")).alias("y")))
    drawn = found.where((F.col("area") > 0) | (F.col("inner") < 0)) if o.hierarchical == "stacked" else found
    return drawn.select("image_id", "region", "rgb", "cells", "left", "top", "head", (F.col("area") < 0).alias("hole"), points.alias("points"))


def outlines(points: Column | str, o: TraceOptions) -> Column:
    """Text of each loop."""

    def run(loops_: pd.Series) -> pd.Series:
        return pd.Series([outline([(p["x"], p["y"]) for p in loop], o) for loop in loops_], dtype=object)

    return F.pandas_udf(run, "string")(points)


def trace(px: DataFrame, options: TraceOptions = TraceOptions()) -> DataFrame:
    """image_id, width, height and svg of each image; an image above the pixel budget fails the job before it is taken up.

    Largest regions are drawn first, of equal ones that with the smaller number.
    """
    found = layer_loops(layers(px, options), options).withColumn("d", outlines("points", options))
    own = ["image_id", "region", "rgb", "cells", "left", "top"]
    paths = found.groupBy(*own).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("head", "d"))), lambda s: s["d"]), " ").alias("d"))
    tag = F.format_string('<path d="%s" fill="#%s" transform="translate(%d,%d)"/>\n', "d", F.lpad(F.lower(F.hex("rgb")), 6, "0"), "left", "top")
    images = paths.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("cells")).alias("k"), "region", tag.alias("tag")))), lambda s: s["tag"]), "").alias("body"))
    root = F.format_string('<?xml version="1.0" encoding="UTF-8"?>\n<!-- traced -->\n<svg version="1.1" xmlns="http://www.w3.org/2000/svg" width="%d" height="%d">\n', "w", "h")
    rows = sizes(px).join(images, "image_id", "left")
    return rows.select("image_id", F.col("w").cast("int").alias("width"), F.col("h").cast("int").alias("height"), F.concat(root, F.coalesce("body", F.lit("")), F.lit("</svg>")).alias("svg"))
