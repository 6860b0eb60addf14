"""Oklab colour space, fuzzy matches, and palettes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.groups import over_groups
from ..functions.numbers import half_up
from ..schema import ALPHA, with_id
from .pixel import packed
from .stats import dominant_color, histogram

# The matrices of the published Oklab space, row by row.
TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.793617785, -0.0040720468), (1.9779984951, -2.428592205, 0.4505937099), (0.0259040371, 0.7827717662, -0.808675766))
FROM_LAB = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.291485548))
FROM_LMS = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.707614701))


#: Columns of a colour in that space.
LAB = ("lab_l", "lab_a", "lab_b")


def _dot(row: tuple[float, ...], cols: list[Column]) -> Column:
    a, b, c = (F.lit(k) * v for k, v in zip(row, cols))
    return a + b + c


def linear(c: Column) -> Column:
    v = c / F.lit(255.0)
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def oklab(r: Column, g: Column, b: Column) -> list[Column]:
    """L, A and B of a colour."""
    lms = [F.cbrt(_dot(row, [linear(r), linear(g), linear(b)])) for row in TO_LMS]
    return [_dot(row, lms) for row in TO_LAB]


def with_oklab(px: DataFrame, r: str = "r", g: str = "g", b: str = "b") -> DataFrame:
    """px with the LAB columns, by projections that share their parts."""
    names = px.columns
    px = px.withColumns({f"{k}_": linear(F.col(c)) for k, c in zip("rgb", (r, g, b))})
    px = px.withColumns({f"{k}_": F.cbrt(_dot(row, [F.col("r_"), F.col("g_"), F.col("b_")])) for k, row in zip("lms", TO_LMS)})
    return px.select(*names, *[_dot(row, [F.col("l_"), F.col("m_"), F.col("s_")]).alias(k) for k, row in zip(LAB, TO_LAB)])


def srgb(lab: list[Column]) -> list[Column]:
    """r, g and b, clamped and rounded."""
    lms = [F.pow(_dot(row, lab), F.lit(3.0)) for row in FROM_LAB]
    rgb = [_dot(row, lms) for row in FROM_LMS]
    shown = [F.when(v <= 0.0031308, F.lit(12.92) * v).otherwise(F.lit(1.055) * F.pow(F.greatest(F.lit(0.0), v), F.lit(1 / 2.4)) - 0.055) for v in rgb]
    return [F.greatest(F.lit(0), F.least(F.lit(255), half_up(v * 255))).cast("int") for v in shown]


def oklab_array(rgb: np.ndarray) -> np.ndarray:
    """Rows of r, g, b as rows of L, A, B."""
    v = rgb / 255.0
    lin = np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)
    return np.cbrt(lin @ np.array(TO_LMS).T) @ np.array(TO_LAB).T


def srgb_array(lab: np.ndarray) -> np.ndarray:
    c = (lab @ np.array(FROM_LAB).T) ** 3 @ np.array(FROM_LMS).T
    v = np.where(c <= 0.0031308, 12.92 * c, 1.055 * np.maximum(0, c) ** (1 / 2.4) - 0.055)
    return np.clip(np.floor(v * 255 + 0.5), 0, 255).astype(np.int64)


def with_distance(df: DataFrame, one: tuple[str, str, str], two: tuple[str, str, str], name: str = "dist_") -> DataFrame:
    """df with the perceptual distance of two colours (columns) on a scale of 255, chroma counted double.

    By projections that share their parts: as one expression it would outgrow a generated method.
    """
    names = df.columns
    for colors, mark in ((one, "one_"), (two, "two_")):
        df = with_oklab(df, *colors)
        for c in LAB:
            df = df.withColumnRenamed(c, mark + c)
    dl, da, db = (F.col(f"one_{c}") - F.col(f"two_{c}") for c in LAB)
    return df.select(*names, (F.sqrt(dl * dl + 4 * da * da + 4 * db * db) * 255).alias(name))


def knock_out(px: DataFrame, colors: DataFrame, fuzz: float | Column) -> DataFrame:
    """Alpha 0 for every pixel within fuzz of its image's colour (image_id, rgb), transparent ones too; a null colour matches nothing.

    Distances are found once a distinct colour of an image, not once a pixel.
    """
    t = F.col("rgb")
    aims = colors.where(t.isNotNull()).select("image_id", F.shiftright(t, 16).bitwiseAND(255).alias("tr"), F.shiftright(t, 8).bitwiseAND(255).alias("tg"), t.bitwiseAND(255).alias("tb"))
    each = px.select("image_id", "r", "g", "b").distinct().join(aims, "image_id")
    # a column, not a filter: that would be pushed below the projections and written out in full
    hit = with_distance(each, ("r", "g", "b"), ("tr", "tg", "tb")).select("image_id", "r", "g", "b", (F.col("dist_") <= fuzz).alias("hit_"))
    return px.join(hit, ["image_id", "r", "g", "b"], "left").select("image_id", "x", "y", "r", "g", "b", F.when(F.col("hit_"), 0).otherwise(F.col("a")).alias("a"))


def nearest_palette(colors: DataFrame, palette: DataFrame) -> DataFrame:
    """colors (image_id, rgb, LAB) with k and dist of the nearest palette row (image_id, k, LAB), the lowest k on a tie."""
    p = palette.select("image_id", "k", *[F.col(c).alias(f"p{c}") for c in LAB])
    d = sum((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in LAB)
    return colors.join(p, "image_id").groupBy(*colors.columns).agg(F.min(F.struct(d.alias("dist"), F.col("k"))).alias("m")).select(*colors.columns, "m.k", "m.dist")


def updated_palette(assigned: DataFrame, palette: DataFrame) -> DataFrame:
    """Weighted means of the colours (image_id, k, n, LAB) of each k; one without colours stays."""
    means = assigned.groupBy("image_id", "k").agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(f"m{c}") for c in LAB])
    return palette.join(means, ["image_id", "k"], "left").select("image_id", "k", *[F.coalesce(f"m{c}", c).alias(c) for c in LAB])


def median_cut(lab: np.ndarray, n: np.ndarray, colors: int) -> list[np.ndarray]:
    """Positions of the entries of each box: the box of the widest channel is cut at its weighted median, again and again."""
    boxes = [np.arange(len(n))]
    spans = [np.ptp(lab, axis=0) if len(n) > 1 else np.full(3, -1.0)]
    while len(boxes) < colors:
        widest = np.array(spans)
        at, channel = np.unravel_index(int(widest.argmax()), widest.shape)
        if widest[at, channel] < 0:
            break
        box = boxes[at]
        box = box[np.argsort(lab[box, channel], kind="stable")]
        weight = np.cumsum(n[box])
        cut = max(1, min(int(np.searchsorted(weight, weight[-1] / 2)), len(box) - 1))
        parts = [box[:cut], box[cut:]]
        boxes[at : at + 1] = parts
        spans[at : at + 1] = [np.ptp(lab[p], axis=0) if len(p) > 1 else np.full(3, -1.0) for p in parts]
    return boxes


#: Distances (colours x palette) that are held at a time.
BLOCK = 1 << 20
#: Room for rounding in the bounds on distances.
SLACK = 1e-9


def _two_nearest(lab: np.ndarray, palette: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest palette entry of each colour (the lowest on a tie), its distance, and that of the next one; some colours at a time."""
    to, near, second = np.zeros(len(lab), int), np.zeros(len(lab)), np.full(len(lab), np.inf)
    step = max(1, BLOCK // len(palette))
    for at in range(0, len(lab), step):
        d = ((lab[at : at + step, None, :] - palette[None]) ** 2).sum(axis=2)
        to[at : at + step] = best = d.argmin(axis=1)
        rows = np.arange(len(d))
        near[at : at + step] = np.sqrt(d[rows, best])
        d[rows, best] = np.inf
        second[at : at + step] = np.sqrt(d.min(axis=1))
    return to, near, second


def refined(lab: np.ndarray, n: np.ndarray, palette: np.ndarray, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Palette and assignment after Lloyd's rounds; the last assignment may be older than the palette.

    A colour keeps its entry without a look at the others while the entry, which has
    moved by no more than is known, is nearer than any other can have come.
    """
    to, near, second = np.zeros(len(n), int), np.full(len(n), np.inf), np.zeros(len(n))
    for i in range(rounds):
        open_ = np.flatnonzero(near + SLACK >= second)
        new = to.copy()
        new[open_], near[open_], second[open_] = _two_nearest(lab[open_], palette)
        if i and (new == to).all():
            break
        to = new
        weight = np.bincount(to, n, len(palette))
        sums = np.stack([np.bincount(to, lab[:, c] * n, len(palette)) for c in range(3)], axis=1)
        moved = np.where(weight[:, None] > 0, sums / np.maximum(weight, 1)[:, None], palette)
        by = np.sqrt(((moved - palette) ** 2).sum(axis=1))
        near, second, palette = near + by[to], second - by.max(), moved
    return palette, to


def palette_map(hist: DataFrame, colors: int) -> DataFrame:
    """hist (image_id, rgb, n, first) -> image_id, rgb, new_rgb for images of more colours than that; works on the histogram, which is small beside its image."""

    def run(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        every, weight = rows.column("rgb").to_numpy(), rows.column("n").to_numpy().astype(float)
        new, known = np.zeros(len(every), np.int32), np.zeros(len(every), bool)
        for a, b in zip(starts, [*starts[1:], len(every)]):
            if b - a <= colors:
                continue
            rgb, n = every[a:b], weight[a:b]
            lab = oklab_array(np.stack([rgb >> 16 & 255, rgb >> 8 & 255, rgb & 255], axis=1))
            seeds = np.array([np.average(lab[box], axis=0, weights=n[box]) for box in median_cut(lab, n, colors)])
            palette, to = refined(lab, n, seeds)
            shown = srgb_array(palette)[to]
            new[a:b], known[a:b] = shown[:, 0] * 65536 + shown[:, 1] * 256 + shown[:, 2], True
        yield from rows.select(["image_id", "rgb"]).append_column("new_rgb", pa.array(new)).filter(pa.array(known)).to_batches()

    return over_groups(hist, ["image_id"], ["first"], run, with_id(hist, "rgb int, new_rgb int"))


def quantize(px: DataFrame, colors: int) -> DataFrame:
    """At most that many colours an image; images that have no more stay as they are. Transparent pixels take the dominant colour's entry, alpha stays."""
    moved = palette_map(histogram(px), colors).withColumnRenamed("rgb", "old_")
    rows = px.join(dominant_color(px).withColumnRenamed("rgb", "fill_"), "image_id")
    rows = rows.withColumn("old_", F.when(F.col("a") < ALPHA, F.col("fill_")).otherwise(packed()))
    new = rows.join(moved, ["image_id", "old_"], "left")
    part = {"r": F.shiftright("new_rgb", 16), "g": F.shiftright("new_rgb", 8).bitwiseAND(255), "b": F.col("new_rgb").bitwiseAND(255)}
    return new.select("image_id", "x", "y", *[F.coalesce(part[c], F.col(c)).cast("int").alias(c) for c in "rgb"], "a")
