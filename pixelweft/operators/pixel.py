"""Per-pixel projections and predicates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..schema import ALPHA

RGB = ("r", "g", "b")


def invert(px: DataFrame) -> DataFrame:
    return px.withColumns({c: 255 - F.col(c) for c in RGB})


def threshold(px: DataFrame, t: int | Column = 128) -> DataFrame:
    """Black where red is below t, else white; alpha stays."""
    v = F.when(F.col("r") < t, 0).otherwise(255)
    return px.withColumns({c: v for c in RGB})


def fill_transparent(px: DataFrame, color: tuple[int, int, int]) -> DataFrame:
    clear = F.col("a") < ALPHA
    return px.withColumns({c: F.when(clear, v).otherwise(F.col(c)) for c, v in zip(RGB, color)} | {"a": F.when(clear, 255).otherwise(F.col("a"))})


def binarize_alpha(px: DataFrame) -> DataFrame:
    return px.withColumn("a", F.when(F.col("a") >= ALPHA, 255).otherwise(0))


def luma(r: Column, g: Column, b: Column) -> Column:
    return half_up(F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b).cast("int")


def grayscale(px: DataFrame) -> DataFrame:
    v = luma(*map(F.col, RGB))
    return px.withColumn("v_", v).withColumns({c: F.col("v_") for c in RGB}).drop("v_")


def packed(r: Column | str = "r", g: Column | str = "g", b: Column | str = "b") -> Column:
    r, g, b = (F.col(c) if isinstance(c, str) else c for c in (r, g, b))
    return (r * 65536 + g * 256 + b).cast("int")


def unpacked(rgb: Column) -> list[Column]:
    return [F.shiftright(rgb, 16).bitwiseAND(255), F.shiftright(rgb, 8).bitwiseAND(255), rgb.bitwiseAND(255)]


def parse_hex(text: Column) -> Column:
    """Packed colour of #RRGGBB or RRGGBB, else null."""
    m = F.regexp_extract(F.trim(text), r"^#?([0-9a-fA-F]{6})$", 1)
    return F.when(m != "", F.conv(m, 16, 10).cast("int"))


def to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02X%02X%02X", r, g, b)


def has_alpha(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg(F.bool_or(F.col("a") < 255).alias("has_alpha"))


def sample_points(px: DataFrame, points: DataFrame) -> DataFrame:
    """points (image_id, point_id, nx, ny in 0..1) -> the pixel under each; the far edges belong to the last pixel."""
    from ..sources.raster import sizes

    at = lambda n, size: F.greatest(F.lit(0), F.least(F.col(size) - 1, F.floor(F.col(n) * F.col(size)))).cast("int")
    placed = points.join(sizes(px), "image_id").select("image_id", "point_id", at("nx", "w").alias("x"), at("ny", "h").alias("y"))
    return placed.join(px, ["image_id", "x", "y"]).select("image_id", "point_id", "x", "y", "r", "g", "b", "a")
