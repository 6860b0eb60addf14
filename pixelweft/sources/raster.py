"""Rasters as pixel tables: one derived from events, packing, rotation, resampling, and size rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..schema import MAX_PIXELS, MAX_SIDE, MAX_SIDE_ULTRA, PIXEL, with_id


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 x 20 images, one pixel an event: a disc on a light ground, with noise and some transparency."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    x, y = F.col("event_id") % 25, F.expr("(event_id % 500) div 25")
    disc = (x - 12) * (x - 12) + (y - 10) * (y - 10) <= 36
    noise = lambda m: F.when(F.col("event_type") == "error", F.col("user_id") % m).otherwise(0)
    part = lambda inside, m: (F.when(disc, inside).otherwise(240) + noise(m)).cast("int")
    a = F.when((F.col("event_type") == "signup") & (F.col("user_id") % 10 == 0), 90).otherwise(255)
    return e.select(F.expr("event_id div 500").cast("int").alias("image_id"), x.cast("int").alias("x"), y.cast("int").alias("y"), part(30, 13).alias("r"), part(60, 11).alias("g"), part(120, 7).alias("b"), a.cast("int").alias("a"))


def sizes(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def rotate(px: DataFrame, clockwise: bool = True) -> DataFrame:
    """A quarter turn."""
    s = sizes(px)
    to = (F.col("h") - 1 - F.col("y"), F.col("x")) if clockwise else (F.col("y"), F.col("w") - 1 - F.col("x"))
    return px.join(s, "image_id").select("image_id", to[0].cast("int").alias("x"), to[1].cast("int").alias("y"), "r", "g", "b", "a")


def upscale_nearest(px: DataFrame, factor: int) -> DataFrame:
    """Each pixel as factor x factor pixels."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    out = px.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    return out.select("image_id", (F.col("x") * factor + F.col("dx")).alias("x"), (F.col("y") * factor + F.col("dy")).alias("y"), "r", "g", "b", "a")


def downscale(px: DataFrame, factor: int) -> DataFrame:
    """Means of factor x factor blocks in premultiplied alpha; a block without alpha is transparent black."""
    mean = lambda c: F.when(F.sum("a") > 0, half_up(F.sum(F.col(c) * F.col("a")).cast("double") / F.sum("a"))).otherwise(0)
    g = px.groupBy("image_id", F.expr(f"x div {factor}").cast("int").alias("x"), F.expr(f"y div {factor}").cast("int").alias("y"))
    return g.agg(*[mean(c).cast("int").alias(c) for c in "rgb"], half_up(F.avg("a")).cast("int").alias("a"))


def _shares(at: Column, n: Column, to: Column, nearest: bool) -> Column:
    """Array of (to, weight): the places of an axis of to pixels that the pixel at of an axis of n gives to, in whole weights.

    A shorter axis takes the parts that its pixels cover, a longer one is linear
    between the pixels' centres (or takes the pixel under its centre).
    """
    covers = F.sequence(F.expr("0L") + F.floor(at * to / n), F.floor(((at + 1) * to - 1) / n))
    area = F.transform(covers, lambda t: F.struct(t.alias("to"), (F.least((at + 1) * to, (t + 1) * n) - F.greatest(at * to, t * n)).alias("weight")))
    # a centre of the longer axis is at (2 t + 1) n - to, a pixel of the shorter one at 2 to at
    place = lambda t: F.least(F.greatest((t * 2 + 1) * n - to, F.lit(0)), to * 2 * (n - 1))
    low = F.when(at == 0, 0).otherwise(F.greatest(F.lit(0), F.floor((at * 2 - 1) * to / (n * 2)) - 1)).cast("long")
    high = F.when(at == n - 1, to - 1).otherwise(F.least(to - 1, F.ceil((at * 2 + 3) * to / (n * 2)) + 1)).cast("long")
    under = lambda t: F.when(F.floor((t * 2 + 1) * n / (to * 2)) == at, 1).otherwise(0).cast("long")
    linear = F.transform(F.sequence(low, high), lambda t: F.struct(t.alias("to"), (under(t) if nearest else to * 2 - F.abs(place(t) - to * 2 * at)).alias("weight")))
    return F.filter(F.when(to > n, linear).otherwise(area), lambda s: s["weight"] > 0)


def resample(px: DataFrame, scale: float | Column, nearest: bool = False) -> DataFrame:
    """Images at round(side * scale), at least 1, up or down; scale may be a column over w and h.

    Means by area, or linear ones in the longer axes, in premultiplied alpha; nearest
    takes single pixels when upscaling. A pixel without alpha is transparent black;
    an image that keeps its size stays as it is. Weights are whole numbers, so a
    whole factor gives what downscale() gives.
    """
    to = lambda side: F.greatest(F.lit(1), half_up(F.col(side) * (scale if isinstance(scale, Column) else F.lit(float(scale))))).cast("long")
    s = sizes(px).select("image_id", F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h")).withColumn("tw", to("w")).withColumn("th", to("h"))
    rows = px.join(s, "image_id").withColumn("same", (F.col("w") == F.col("tw")) & (F.col("h") == F.col("th")))
    shares = lambda at, n, t: F.explode(_shares(F.col(at).cast("long"), F.col(n), F.col(t), nearest))
    rows = rows.withColumn("sx", shares("x", "w", "tw")).withColumn("sy", shares("y", "h", "th")).withColumn("n", F.col("sx.weight") * F.col("sy.weight"))
    na = F.sum(F.col("n") * F.col("a"))
    mean = lambda c: F.when(na > 0, half_up(F.sum(F.col(c) * F.col("a") * F.col("n")).cast("double") / na)).otherwise(F.max(F.when(F.col("same"), F.col(c)).otherwise(0)))
    g = rows.groupBy("image_id", F.col("sx.to").cast("int").alias("x"), F.col("sy.to").cast("int").alias("y"))
    return g.agg(*[mean(c).cast("int").alias(c) for c in "rgb"], half_up(na.cast("double") / F.sum("n")).cast("int").alias("a"))


def fit(px: DataFrame, max_side: int) -> DataFrame:
    """Images whose longest side is above max_side, resampled so that it is max_side; the others as they are."""
    return resample(px, F.least(F.lit(1.0), F.lit(float(max_side)) / F.greatest("w", "h")))


def pack(px: DataFrame) -> DataFrame:
    """One row an image: RGBA bytes in row order. An image is bounded by the pixel budget."""
    byte = lambda c: F.lpad(F.hex(c), 2, "0")
    rows = px.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", F.concat(*[byte(c) for c in "rgba"]).alias("v")))).alias("p"), (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return rows.select("image_id", "width", "height", F.unhex(F.array_join(F.transform("p", lambda s: s["v"]), "")).alias("data"))


#: Pixels that a task makes of an encoded image at a time.
BATCH = 1 << 18


def pixel_batches(image_id: int, width: int, rgba: np.ndarray, of: pa.DataType = pa.int64()) -> Iterator[pa.RecordBatch]:
    """PIXELS rows of an image's pixels in row order (n x 4 bytes), some at a time."""
    for at in range(0, len(rgba), BATCH):
        part = rgba[at : at + BATCH]
        place = np.arange(at, at + len(part))
        columns = [place % width, place // width, *part.T]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), image_id), of), *(pa.array(c.astype(np.int32)) for c in columns)], names=["image_id", "x", "y", "r", "g", "b", "a"])


def block_error(w: Column, h: Column, n_bytes: Column) -> Column:
    """Null, or why so many bytes are no image of w x h."""
    return F.when((w <= 0) | (h <= 0), F.lit("an image has no side of zero or less")).when(w.cast("long") * h * 4 != n_bytes, F.format_string("%d bytes are not %d x %d pixels", n_bytes.cast("long"), w, h))


def unpack(blocks: DataFrame) -> DataFrame:
    """pack() undone; an image's bytes are read once, whatever its size. A block whose size is not that of its bytes fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, width, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                yield from pixel_batches(image_id, width, np.frombuffer(data.as_buffer() or b"", np.uint8).reshape(-1, 4), batch.column(0).type)

    error = block_error(F.col("width"), F.col("height"), F.length("data"))
    checked = blocks.where(F.when(error.isNotNull(), F.raise_error(error).cast("boolean")).otherwise(True))
    return checked.select("image_id", "width", "data").mapInArrow(run, with_id(blocks, PIXEL))


def within_budget(px: DataFrame, most: int = MAX_PIXELS) -> DataFrame:
    """px; a job over it fails if an image has more than most pixels, before a task takes up the image."""
    n = F.col("w").cast("long") * F.col("h")
    over = sizes(px).where(n > most).select("image_id", n.alias("over_"))
    refuse = F.raise_error(F.format_string("image %d: %d pixels are more than %d", F.col("image_id"), F.col("over_"), F.lit(most)))
    return px.join(over, "image_id", "left").where(F.when(F.col("over_").isNotNull(), refuse.cast("boolean")).otherwise(True)).select(*px.columns)


def fit_decode_size(w: Column, h: Column, max_side: int = MAX_SIDE) -> tuple[Column, Column]:
    scale = F.least(F.lit(1.0), F.lit(float(max_side)) / F.greatest(w, h))
    return tuple(F.greatest(F.lit(1), half_up(s * scale)).cast("int") for s in (w, h))


def effective_upscale(setting: Column, w: Column, h: Column) -> Column:
    """The setting as a factor: auto and ultra fill their largest side."""
    most = F.when(setting == "ultra", MAX_SIDE_ULTRA).otherwise(MAX_SIDE)
    return F.when(setting.isin("auto", "ultra"), F.greatest(F.lit(1.0), most / F.greatest(w, h))).otherwise(setting.try_cast("double"))


def fit_trace_scale(w: Column, h: Column, upscale: Column, max_side: int = MAX_SIDE) -> Column:
    return F.least(upscale, F.lit(float(max_side)) / F.greatest(w, h))


def budget_error(w: Column, h: Column, upscale: Column) -> Column:
    """Null, or why the image is too large to trace."""
    n = w * upscale * h * upscale
    return F.when(n > MAX_PIXELS, F.format_string("%d pixels are more than %d", n.cast("long"), F.lit(MAX_PIXELS)))

