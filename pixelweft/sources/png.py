"""PNGs painted by bands of rows.

Sides of paths are dealt to the bands they cross, each band is painted and deflated
alone, and the deflated bands are one stream as they stand: all but the last end at
a byte, without a final block. The stream's checksum comes from those of its bands:
for a band of n bytes with the sums s = d1 + ... + dn and t = n d1 + ... + 1 dn,
a stream that comes to (a, b) before it comes to (a + s, b + n a + t), modulo 65521.
A task holds the pixels of a band and the sides of one path after the other.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.groups import over_groups
from ..functions.udfs import vectorized
from .export import paint, painted_size, png_chunk, png_head, png_rows, sides
from .store import stored

#: Pixels of a band, and sides that are sent at once.
BAND, BATCH = 1 << 22, 1 << 15
#: Bytes of deflated bands that are sent at once.
SENT = 1 << 24
MODULUS = 65521
#: Deflated data of any length behind two bytes; the checksum follows in a chunk of its own.
ZLIB = b"\x78\x9c"
_SIDES = "width int, height int, rows int, first int, last int, path int, fill int, x0 double, y0 double, x1 double, y1 double"


def _banded(drawings: DataFrame, scale: float, rows: int | None) -> DataFrame:
    """image_id and the columns of _SIDES: each side with the bands from first to last that it may cross, and for each drawing a row of path -1 in all of its bands."""
    kind = drawings.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["image_id", *(c.split()[0] for c in _SIDES.split(", "))]
        for batch in batches:
            held, many = [], 0
            for image, svg in zip(batch.column(0), batch.column(1).to_pylist()):
                if svg is None:
                    continue
                w, h = painted_size(svg, scale)
                deep = rows or max(1, BAND // w)
                bands = (h - 1) // deep + 1

                def out(first, last, path, fill, start, end):
                    n = len(first)
                    ints = [np.full(n, w), np.full(n, h), np.full(n, deep), first, last, np.full(n, path), np.full(n, fill)]
                    columns = [pa.array(np.asarray(c, np.int32)) for c in ints] + [pa.array(np.ascontiguousarray(c)) for c in (start[:, 0], start[:, 1], end[:, 0], end[:, 1])]
                    return pa.RecordBatch.from_arrays([pa.repeat(image, n), *columns], names=names)

                held.append(out([0], [bands - 1], -1, 0, np.zeros((1, 2)), np.zeros((1, 2))))
                for path, fill, start, end in sides(svg, scale):
                    for k in range(0, len(start), BATCH):
                        a, b = start[k : k + BATCH], end[k : k + BATCH]
                        top = np.ceil(np.minimum(a[:, 1], b[:, 1]) - 0.5)
                        below = np.ceil(np.maximum(a[:, 1], b[:, 1]) - 0.5)  # the first row under the side
                        seen = (top < below) & (below > 0) & (top < h)
                        top, below = np.clip(top[seen], 0, h - 1), np.clip(below[seen], 1, h)
                        held.append(out(top // deep, (below - 1) // deep, path, fill, a[seen], b[seen]))
                        many += len(top)
                        if many >= BATCH:
                            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                            held, many = [], 0
            if held:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return drawings.select("image_id", "svg").mapInArrow(run, f"image_id {kind}, {_SIDES}")


def _deflated(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each band's chunk of the file, with the length and the two sums of what it packs; rows are in order of band and path."""
    images, at = rows.column("image_id"), {c: rows.column(c).to_numpy() for c in rows.column_names if c != "image_id"}
    start, end = (np.stack([at[f"x{k}"], at[f"y{k}"]], axis=1) for k in (0, 1))
    names, found, size = ["part", "bytes", "width", "height", "n", "s", "t"], [], 0
    types = [pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def out(places: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([images.take(pa.array(places)).combine_chunks(), *(pa.array(c, t) for c, t in zip(list(zip(*found)), types))], names=["image_id", *names])

    places = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows]):
        w, h, deep, k = (int(at[c][a]) for c in ("width", "height", "rows", "band"))
        first = k * deep
        a += int((at["path"][a:b] < 0).sum())  # the rows that tell of the band only come first
        rgba = paint(at["path"][a:b], at["fill"][a:b], start[a:b], end[a:b], w, first, min(deep, h - first))
        data = png_rows(rgba)
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = packer.compress(data) + packer.flush(zlib.Z_FINISH if first + deep >= h else zlib.Z_FULL_FLUSH)
        sums = zlib.adler32(data, 0)
        found.append((k + 1, png_chunk(b"IDAT", (b"" if k else ZLIB) + packed), w, h, len(data), sums & 0xFFFF, sums >> 16))
        places.append(b - 1)
        size += len(packed)
        if size > SENT:
            yield out(places)
            places, size = [], 0
            found.clear()
    if found:
        yield out(places)


@vectorized("binary")
def _head(width: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([png_head(int(w), int(h)) for w, h in zip(width, height)])


@vectorized("binary")
def _tail(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([png_chunk(b"IDAT", struct.pack(">HH", int(y), int(x))) + png_chunk(b"IEND", b"") for x, y in zip(a, b)])


def png_parts(drawings: DataFrame, scale: float = 1.0, rows: int | None = None) -> DataFrame:
    """image_id, part and bytes: in order of part a drawing's bytes are its PNG.

    drawings holds image_id, which tells drawings apart, and svg; other columns are
    ignored. Drawings that are null have no parts. Bands have so many rows, or as
    many as make BAND pixels.
    """
    kind = drawings.schema["image_id"].dataType.simpleString()
    sent = _banded(drawings, scale, rows).select("*", F.explode(F.sequence("first", "last")).alias("band"))
    bands = stored(over_groups(sent, ["image_id", "band"], ["path"], _deflated, f"image_id {kind}, part int, bytes binary, width int, height int, n long, s long, t long"))
    before = Window.partitionBy("image_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    a = (1 + F.coalesce(F.sum("s").over(before), F.lit(0))) % MODULUS
    sums = bands.drop("bytes").withColumn("b", (F.col("t") + F.col("n") % MODULUS * a) % MODULUS)
    whole = sums.groupBy("image_id").agg(F.first("width").alias("width"), F.first("height").alias("height"), F.max("part").alias("parts"), ((1 + F.sum("s")) % MODULUS).alias("a"), (F.sum("b") % MODULUS).alias("b"))
    head = whole.select("image_id", F.lit(0).alias("part"), _head("width", "height").alias("bytes"))
    tail = whole.select("image_id", (F.col("parts") + 1).alias("part"), _tail("a", "b").alias("bytes"))
    return bands.select("image_id", "part", "bytes").union(head).union(tail)


def png_cells(parts: DataFrame) -> DataFrame:
    """image_id and png, whole files in cells; for files that fit in one."""
    listed = parts.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("part", "bytes"))).alias("parts"))
    return listed.select("image_id", F.reduce("parts", F.lit(b""), lambda file, p: F.concat(file, p["bytes"])).alias("png"))


def write_png(parts: DataFrame, folder: str) -> None:
    """A file <image_id>.png for each drawing, in a folder that all executors see.

    A task writes its files part by part under a name of its own and renames each
    when it is whole, so a task that is run again leaves no broken file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, file, temporary = None, None, ""

        def close() -> None:
            if file:
                file.close()
                os.replace(temporary, os.path.join(folder, f"{image}.png"))

        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if file is None or i != image:
                    close()
                    image, temporary = i, os.path.join(folder, f".{i}-{os.urandom(8).hex()}")
                    file = open(temporary, "wb")
                file.write(data.as_buffer())
        close()
        yield from ()

    os.makedirs(folder, exist_ok=True)
    rows = parts.repartition("image_id").sortWithinPartitions("image_id", "part").select("image_id", "bytes")
    rows.mapInArrow(run, "done int").count()
