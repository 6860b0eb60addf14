"""Colour statistics: histograms, dominant and background colour, flatness, lookups of nearest colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..schema import ALPHA, cad_colors
from ..sources.raster import sizes
from .pixel import packed, parse_hex, unpacked

WHITE = 0xFFFFFF


def with_order(px: DataFrame) -> DataFrame:
    """px with ord, the pixel's place in its image, and n, the image's pixels."""
    return px.join(sizes(px), "image_id").withColumn("ord", (F.col("y") * F.col("w") + F.col("x")).cast("long")).withColumn("n", (F.col("w") * F.col("h")).cast("long"))


def _most_common(rows: DataFrame, key: str, order: str) -> DataFrame:
    """image_id, key of the most common one; on a tie the one that got there first, whose last row comes first."""
    counts = rows.groupBy("image_id", key).agg(F.count("*").alias("c_"), F.max(order).alias("last_"))
    return counts.groupBy("image_id").agg(F.max_by(key, F.struct("c_", -F.col("last_"))).alias(key))


def dominant_color(px: DataFrame) -> DataFrame:
    """image_id, rgb: the commonest opaque colour of a regular sample, white if there is none."""
    rows = with_order(px)
    step = F.greatest(F.lit(1).cast("long"), F.expr("n div 4096"))
    rows = rows.where((F.col("ord") % step == 0) & (F.col("a") >= ALPHA)).withColumn("rgb", packed())
    return px.select("image_id").distinct().join(_most_common(rows, "rgb", "ord"), "image_id", "left").select("image_id", F.coalesce("rgb", F.lit(WHITE)).alias("rgb"))


def histogram(px: DataFrame) -> DataFrame:
    """image_id, rgb, n and first (place of the first): transparent pixels count as the dominant colour."""
    rows = with_order(px).drop("n").join(dominant_color(px).withColumnRenamed("rgb", "fill_"), "image_id")
    rows = rows.withColumn("rgb", F.when(F.col("a") < ALPHA, F.col("fill_")).otherwise(packed()))
    return rows.groupBy("image_id", "rgb").agg(F.count("*").alias("n"), F.min("ord").alias("first"))


def distinct_colors(px: DataFrame) -> DataFrame:
    """image_id, rgb, first: opaque colours by their first place."""
    rows = with_order(px).where(F.col("a") >= ALPHA)
    return rows.groupBy("image_id", packed().alias("rgb")).agg(F.min("ord").alias("first"))


def sample_positions(s: DataFrame) -> DataFrame:
    """sizes -> image_id, k, x, y of the border and corner samples, repeated ones kept, in the order they are taken."""
    step = F.greatest(F.lit(1), F.floor(2 * (F.col("w") + F.col("h")) / 2048)).cast("int")
    s = s.withColumn("step", step).withColumn("c", F.least(F.lit(4), F.col("w"), F.col("h")).cast("int"))
    pos = lambda phase, i, side, x, y: F.struct(F.lit(phase).alias("p"), i.cast("int").alias("i"), F.lit(side).alias("s"), x.cast("int").alias("x"), y.cast("int").alias("y"))
    zero = F.lit(0)
    across = F.transform(F.sequence(zero, F.col("w") - 1, F.col("step")), lambda x: F.array(pos(0, x, 0, x, zero), pos(0, x, 1, x, F.col("h") - 1)))
    none = F.array().cast("array<array<struct<p:int,i:int,s:int,x:int,y:int>>>")
    down = F.when(F.col("h") > 2, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("h") - 2), F.col("step")), lambda y: F.array(pos(1, y, 0, zero, y), pos(1, y, 1, F.col("w") - 1, y)))).otherwise(none)
    cells = F.sequence(zero, F.col("c") * F.col("c") - 1)
    corner = lambda k, x0, y0: F.transform(cells, lambda i: pos(2, i, k, x0 + i % F.col("c"), y0 + F.floor(i / F.col("c"))))
    right, low = F.col("w") - F.col("c"), F.col("h") - F.col("c")
    corners = F.array(*[corner(k, x0, y0) for k, (x0, y0) in enumerate(((zero, zero), (right, zero), (zero, low), (right, low)))])
    rows = s.select("image_id", F.inline(F.concat(F.flatten(across), F.flatten(down), F.flatten(corners))))
    # in the corners the corner comes before the cell
    order = F.when(F.col("p") == 2, F.struct("p", F.col("s").alias("a"), F.col("i").alias("b"))).otherwise(F.struct("p", F.col("i").alias("a"), F.col("s").alias("b")))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("image_id").orderBy(order))).select("image_id", "k", "x", "y")


def background_color(px: DataFrame) -> DataFrame:
    """image_id, r, g, b: mean of the commonest coarse colour among the border samples; null if most of these are transparent."""
    seen = sample_positions(sizes(px)).join(px, ["image_id", "x", "y"]).withColumn("bin", F.shiftright("r", 4) * 256 + F.shiftright("g", 4) * 16 + F.shiftright("b", 4))
    opaque = F.col("a") >= ALPHA
    bins = seen.groupBy("image_id", "bin").agg(F.count("*").alias("all"), F.count_if(opaque).alias("n"), F.max(F.when(opaque, F.col("k"))).alias("last"), *[F.sum(F.when(opaque, F.col(c))).alias(c) for c in "rgb"])
    # of equally common ones the one that got there first; bins without opaque samples are none
    order = F.when(F.col("n") > 0, F.struct("n", -F.col("last")))
    best = bins.groupBy("image_id").agg((2 * F.sum("n") >= F.sum("all")).alias("ok"), F.max_by(F.struct("n", *"rgb"), order).alias("m"))
    return best.select("image_id", *[F.when(F.col("ok"), half_up(F.col(f"m.{c}") / F.col("m.n")).cast("int")).alias(c) for c in "rgb"])


def flatness(px: DataFrame) -> DataFrame:
    """image_id, flat, color_count: whether few colours cover the image, and how many it takes."""
    rows = with_order(px)
    step = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / 200_000.0))
    step = F.when(step % 2 == 0, step + 1).otherwise(step)
    counts = rows.where((F.col("ord") % step == 0) & (F.col("a") >= ALPHA)).groupBy("image_id", packed().alias("rgb")).agg(F.count("*").alias("c"))
    bits = lambda shift: F.shiftright("rgb", shift).bitwiseAND(3)
    clusters = counts.groupBy("image_id", (bits(22) * 16 + bits(14) * 4 + bits(6)).alias("bin")).agg(F.sum("c").alias("c"))

    def walked(t: DataFrame, top: int) -> DataFrame:
        """By falling count: total, number, share of the top ones, the largest share, rank at which 0.95 is reached (null: not), share walked to there within the top."""
        w = Window.partitionBy("image_id").orderBy(F.desc("c"), F.desc(t.columns[1]))
        t = t.withColumn("rank", F.row_number().over(w)).withColumn("run", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        t = t.withColumn("total", F.sum("c").over(Window.partitionBy("image_id"))).withColumn("share", F.col("run") / F.col("total"))
        g = t.groupBy("image_id").agg(F.count("*").alias("number"), F.max(F.when(F.col("rank") <= top, F.col("share"))).alias("top"), F.max(F.col("c") / F.col("total")).alias("largest"), F.min(F.when(F.col("share") >= 0.95, F.col("rank"))).alias("reach"), F.min(F.when((F.col("share") >= 0.95) & (F.col("rank") <= top), F.col("rank"))).alias("reach_top"))
        stop = F.min(F.when(F.col("share") >= 0.95, F.col("share")))
        return g.join(t.where(F.col("rank") <= top).groupBy("image_id").agg(F.coalesce(stop, F.max("share")).alias("walked")), "image_id")

    a = walked(counts.select("image_id", "rgb", "c"), 16).select("image_id", "number", "top", "reach")
    b = walked(clusters.select("image_id", "bin", "c"), 8).select("image_id", F.col("number").alias("k_all"), F.col("largest"), F.col("walked"), F.coalesce("reach_top", "number").alias("k"))
    t = px.select("image_id").distinct().join(a, "image_id", "left").join(b, "image_id", "left")
    few = (F.col("number") <= 32) & (F.col("top") < 0.9)
    clustered = (F.col("top") < 0.9) & (F.col("walked") >= 0.9) & (F.col("largest") >= 0.35)
    flat = F.when(F.col("number").isNull(), False).when(few | clustered, True).otherwise(F.col("top") >= 0.9)
    n = (
        F.when(F.col("number").isNull(), 256)
        .when(few, F.greatest(F.lit(2), F.col("number")))
        .when(clustered, F.least(F.lit(32), F.greatest(F.lit(8), 2 * F.col("k"))))
        .otherwise(F.least(F.lit(32), F.greatest(F.lit(2), F.col("reach"))))
    )
    return t.select("image_id", flat.alias("flat"), n.cast("int").alias("color_count"))


def snap(px: DataFrame, targets: DataFrame, most: int | Column) -> DataFrame:
    """targets (image_id, rgb) -> image_id, rgb of the nearest opaque colour by the largest channel difference, null if above most; ties go to the first seen."""
    colors = distinct_colors(px).withColumnRenamed("rgb", "c_")
    pairs = targets.join(colors, "image_id", "left")
    gap = F.greatest(*[F.abs(u - v) for u, v in zip(unpacked(F.col("c_")), unpacked(F.col("rgb")))])
    best = pairs.withColumn("gap", gap).groupBy("image_id").agg(F.min(F.struct("gap", "first", "c_")).alias("m"))
    return best.select("image_id", F.when(F.col("m.gap") <= most, F.col("m.c_")).alias("rgb"))


def cad_index(fills: DataFrame, fill: str = "fill") -> DataFrame:
    """fills with aci, the nearest colour of the CAD palette; an unreadable colour is 7."""
    names = fills.columns
    rgb = parse_hex(F.col(fill))
    each = fills.select(fill).distinct().withColumn("rgb_", rgb).join(F.broadcast(cad_colors(fills.sparkSession)))
    d = sum((u - F.col(p)) * (u - F.col(p)) for u, p in zip(unpacked(F.col("rgb_")), ("pr", "pg", "pb")))
    best = each.withColumn("d_", d).groupBy(fill).agg(F.min(F.struct("d_", "ord", "aci")).alias("m"))
    best = best.select(F.col(fill).alias("fill_"), F.when(F.col("m.d_").isNull(), 7).otherwise(F.col("m.aci")).alias("aci"))
    return fills.join(best, F.col(fill) == F.col("fill_"), "left").select(*names, F.coalesce("aci", F.lit(7)).alias("aci"))


def nearest_preset(needs: DataFrame, n: str, presets: DataFrame) -> DataFrame:
    """needs with the smallest preset that has n colours or more."""
    p = presets.select(F.col("colors").alias("preset"), "speckle", "layer_diff")
    found = needs.join(F.broadcast(p), F.col("preset") >= F.col(n), "left").groupBy(*needs.columns).agg(F.min(F.struct("preset", "speckle", "layer_diff")).alias("m"))
    return found.select(*needs.columns, "m.preset", "m.speckle", "m.layer_diff")
