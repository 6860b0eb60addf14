"""Encoded images: sizes from their headers, checks, and decoding."""

from __future__ import annotations

import math
import os
import struct
from collections.abc import Iterator
from typing import Any
from urllib.parse import quote, urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..functions.udfs import vectorized
from ..schema import MAX_FILE_BYTES, MAX_SIDE, MAX_SOURCE_PIXELS, MAX_SOURCE_SIDE, PIXEL
from .raster import fit_decode_size, pixel_batches
from .store import stored

HEAD = 256 * 1024


def _unsigned(data: Column, at: int, n: int, big: bool = False) -> Column:
    """The unsigned number in n bytes from at (0 is the first)."""
    part = F.hex(F.substring(data, at + 1, n))
    if not big:
        part = F.concat(*[F.substring(part, 2 * k + 1, 2) for k in range(n - 1, -1, -1)])
    return F.conv(part, 16, 10).cast("long")


def _bits(data: Column, at: int) -> Column:
    return _unsigned(data, at, 1)


def _size(w: Column, h: Column) -> Column:
    return F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))


def jpeg_size(head: bytes) -> tuple[int, int, int] | None:
    """(width, height, orientation) of a JPEG, turned as its orientation says; null if no frame is found."""
    n, at, turn = len(head), 2, 0
    while at + 9 < n and head[at] == 0xFF:
        marker = head[at + 1]
        if marker == 0xFF:  # fill
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD7:  # stand alone
            at += 2
        elif marker in (0xD9, 0xDA):
            return None
        else:
            (length,) = struct.unpack_from(">H", head, at + 2)
            if length < 2:
                return None
            if marker == 0xE1 and head[at + 4 : at + 10] == b"Exif\0\0":
                turn = exif_orientation(head, at + 10, at + 2 + length)
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack_from(">HH", head, at + 5)
                return (h, w, turn) if 5 <= turn <= 8 else (w, h, turn)
            at += 2 + length
    return None


def exif_orientation(data: bytes, at: int, end: int) -> int:
    """The orientation in the first directory of a TIFF block that begins at at; 0 if it can't be read."""
    try:
        order = {b"II": "<", b"MM": ">"}.get(data[at : at + 2])
        if not order or struct.unpack_from(order + "H", data, at + 2)[0] != 42:
            return 0
        first = at + struct.unpack_from(order + "I", data, at + 4)[0]
        if first + 2 > end:
            return 0
        for k in range(struct.unpack_from(order + "H", data, first)[0]):
            entry = first + 2 + 12 * k
            if entry + 12 > end:
                return 0
            tag, _, _, value = struct.unpack_from(order + "HHIH", data, entry)
            if tag == 0x0112:
                return value
    except struct.error:
        pass
    return 0


@vectorized("width int, height int, orientation int")
def _jpeg(head: pd.Series) -> pd.DataFrame:
    rows = [jpeg_size(bytes(h)) or (None, None, None) if h is not None else (None, None, None) for h in head]
    return pd.DataFrame(rows, columns=["width", "height", "orientation"]).astype("Int32")


def headers(files: DataFrame, content: str = "content") -> DataFrame:
    """files with format, width, height and orientation; null where the format is unknown or the header broken."""
    head = F.substring(F.col(content), 1, HEAD)
    rows = files.withColumn("head_", head)
    d, n = F.col("head_"), F.length("head_")
    ascii_ = lambda at, k: F.substring(d, at + 1, k)
    is_ = lambda at, text: ascii_(at, len(text)) == F.lit(text.encode())
    signed = lambda at: F.abs(F.when(_unsigned(d, at, 4) >= 1 << 31, _unsigned(d, at, 4) - (1 << 32)).otherwise(_unsigned(d, at, 4)))
    webp = is_(0, "RIFF") & is_(8, "WEBP") & (n >= 30)
    kind = (
        F.when((n >= 24) & is_(1, "PNG"), "png")
        .when((n >= 10) & is_(0, "GIF"), "gif")
        .when((n >= 26) & is_(0, "BM"), "bmp")
        .when(webp & is_(12, "VP8 "), "webp")
        .when(webp & is_(12, "VP8L"), "webp-lossless")
        .when(webp & is_(12, "VP8X"), "webp-extended")
        .when((n >= 4) & (ascii_(0, 2) == F.lit(b"\xff\xd8")), "jpeg")
    )
    rows = rows.withColumn("format", kind)
    b = lambda at: _bits(d, at)
    lossless = _size(1 + b(22).bitwiseAND(63) * 256 + b(21), 1 + b(24).bitwiseAND(15) * 1024 + b(23) * 4 + F.shiftright(b(22), 6))  # after the signature byte
    size = (
        F.when(kind == "png", _size(_unsigned(d, 16, 4, True), _unsigned(d, 20, 4, True)))
        .when(kind == "gif", _size(_unsigned(d, 6, 2), _unsigned(d, 8, 2)))
        .when(kind == "bmp", _size(signed(18), signed(22)))
        .when(kind == "webp", _size(_unsigned(d, 26, 2).bitwiseAND(0x3FFF), _unsigned(d, 28, 2).bitwiseAND(0x3FFF)))
        .when(kind == "webp-lossless", lossless)
        .when(kind == "webp-extended", _size(1 + _unsigned(d, 24, 3), 1 + _unsigned(d, 27, 3)))
    )
    rows = rows.withColumn("size_", size).withColumn("jpeg_", _jpeg(F.when(F.col("format") == "jpeg", d)))
    out = rows.withColumns({"width": F.coalesce("size_.width", "jpeg_.width"), "height": F.coalesce("size_.height", "jpeg_.height"), "orientation": F.coalesce("jpeg_.orientation", F.lit(0))})
    return out.drop("head_", "size_", "jpeg_")


def judged(rows: DataFrame, n_bytes: Column, max_side: int = MAX_SIDE) -> DataFrame:
    """rows (format, width, height) with error (null: may be decoded) and the size to decode to."""
    w, h = F.col("width"), F.col("height")
    bad = (w <= 0) | (h <= 0) | (w > MAX_SOURCE_SIDE) | (h > MAX_SOURCE_SIDE) | (w.cast("long") * h > MAX_SOURCE_PIXELS)
    error = F.when(n_bytes > MAX_FILE_BYTES, "file too large").when(F.col("format").isNull() | w.isNull(), "unknown format").when(bad, "bad size")
    to = fit_decode_size(w, h, max_side)
    return rows.withColumns({"error": error, "decode_width": to[0], "decode_height": to[1]})


def checked(files: DataFrame, max_side: int = MAX_SIDE) -> DataFrame:
    """headers() rows with error (null: may be decoded) and the size to decode to."""
    return judged(headers(files), F.length("content"), max_side)


#: Where the pixel of each place of a shown image is stored, by orientation: mirrored left to right, upside down, axes swapped.
_TURNS = {2: (True, False, False), 3: (True, True, False), 4: (False, True, False), 5: (False, False, True), 6: (False, True, True), 7: (True, True, True), 8: (True, False, True)}


def shown(stored: np.ndarray, orientation: int) -> np.ndarray:
    """A stored image (h x w x channels) as its orientation says."""
    across, down, swapped = _TURNS.get(orientation, (False, False, False))
    out = stored[:: -1 if down else 1, :: -1 if across else 1]
    return out.transpose(1, 0, 2) if swapped else out


#: Files of one task that reads heads; refused files that a plan names.
FILES, REFUSED = 256, 1000


def _local_name(path: Column) -> Column:
    """A file's name without its scheme, as HeadReader gives it."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(path, r"\\+", "%2B")), "^[A-Za-z0-9+.-]+:/*", "")


class HeadReader(DataSourceReader):
    """Name, length and first HEAD bytes of every file below a path; no more of it is read, and nothing of files that a filter on length excludes."""

    def __init__(self, path: str) -> None:
        self.path, self.most = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (LessThanOrEqual, LessThan)) and f.attribute == ("length",):
                top = f.value - isinstance(f, LessThan)
                self.most = top if self.most is None else min(self.most, top)
            else:
                yield f

    def _store(self) -> tuple[Any, str, str]:
        """The file system, the path within it, and the host that names of its files begin with."""
        import pyarrow.fs as pafs  # starts threads, which workers that are yet to be forked should not have

        uri = urlsplit(self.path)
        store, at = pafs.FileSystem.from_uri(self.path if uri.scheme else "file://" + quote(os.path.abspath(self.path)))
        return store, at, "" if not uri.netloc or at.startswith(uri.netloc) else uri.netloc

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector

        store, at, host = self._store()
        one = store.get_file_info(at)
        found = [one] if one.is_file else store.get_file_info(FileSelector(at, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")) and (self.most is None or f.size <= self.most))
        return [InputPartition((host, files[k : k + FILES])) for k in range(0, len(files), FILES)] or [InputPartition((host, []))]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int, bytes]]:
        host, files = partition.value
        store = self._store()[0]
        for path, size in files:
            with store.open_input_file(path) as f:
                yield (host + path).lstrip("/"), size, f.read(HEAD)


class Heads(DataSource):
    """spark.read.format("image_heads").load(path): name, length and head of files."""

    @classmethod
    def name(cls) -> str:
        return "image_heads"

    def schema(self) -> str:
        return "name string, length long, head binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return HeadReader(self.options["path"])


def image_heads(spark: SparkSession, path: str, max_side: int = MAX_SIDE) -> DataFrame:
    """name, length, format, width, height, orientation, error and the size to decode to of every file below path, from its first bytes, which are read once."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Heads)
    # stored, as expressions over the bytes that stand in several others would grow beyond what is compiled
    sizes = stored(headers(spark.read.format("image_heads").load(path), "head").drop("head"))
    return judged(sizes, F.col("length"), max_side)


def shrunk(rgba: np.ndarray, w: int, h: int) -> np.ndarray:
    """An image (rows x columns x 4) at w x h, no larger than it is, by area in premultiplied alpha: the whole numbers that resample() adds up.

    The sum over a target pixel is a difference of running sums, taken between pixels in
    proportion, along rows first and then along columns; some rows are held at a time.
    """

    def along(v: np.ndarray, to: int) -> np.ndarray:
        n = len(v)
        total = np.concatenate([np.zeros((1, *v.shape[1:]), np.int64), np.cumsum(v, axis=0)])
        at, part = np.divmod(np.arange(to + 1) * n, to)
        upto = to * total[at] + part.reshape(-1, *[1] * (v.ndim - 1)) * v[np.minimum(at, n - 1)]
        return np.diff(upto, axis=0)

    tall, wide = rgba.shape[:2]
    narrow = np.empty((tall, w, 4), np.int64)
    for k in range(0, tall, 256):
        part = rgba[k : k + 256].astype(np.int64)
        part[:, :, :3] *= part[:, :, 3:]
        narrow[k : k + 256] = along(part.transpose(1, 0, 2), w).transpose(1, 0, 2)
    sums = along(narrow, h)
    alpha = sums[:, :, 3:]
    color = np.floor(np.divide(sums[:, :, :3], alpha, out=np.zeros(alpha.shape[:2] + (3,)), where=alpha > 0) + 0.5)
    return np.concatenate([np.where(alpha > 0, color, 0), np.floor(alpha / (tall * wide) + 0.5)], axis=2).astype(np.uint8)


def read_images(spark: SparkSession, path: str, max_side: int | None = MAX_SIDE) -> DataFrame:
    """Pixels of the PNG, JPEG, GIF and BMP files at path: image_id (hash of the file's name, a long), origin, x, y, r, g, b, a.

    Files are judged by their first bytes (image_heads(), whose rows say why one is
    refused): too large ones, unknown formats and sizes beyond the limits are left out
    before anything else of them is read. Images are turned as the orientation in their
    header says; those whose longest side is above max_side are made smaller by the task
    that has them (null: none are), so each is decoded once and pixels are not shuffled.
    WebP pixels are not read.
    """
    heads = image_heads(spark, path)
    # a plan can name some files only, and so many bad ones are better looked at
    refused = [r["name"] for r in heads.where("error is not null and error <> 'file too large'").select("name").limit(REFUSED + 1).collect()]
    if len(refused) > REFUSED:
        raise ValueError(f"more than {REFUSED} files at {path} are no images within the limits; see image_heads()")
    turns = heads.where("error is null and orientation between 2 and 8").select(F.col("name").alias("name_"), F.col("orientation").alias("turn"))
    name = _local_name(F.col("_metadata.file_path"))
    files = spark.read.format("image").option("dropInvalid", True).load(path).where(F.col("_metadata.file_size") <= MAX_FILE_BYTES)
    if refused:
        files = files.where(~name.isin(refused))
    rows = files.select(name.alias("name_"), "image.*").join(turns, "name_", "left")
    rows = rows.select(F.xxhash64("origin").alias("image_id"), "origin", "width", "height", "nChannels", F.coalesce("turn", F.lit(1)).alias("turn"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, origin, w, h, n, turn, data in zip(*(batch.column(k).to_pylist() for k in range(6)), batch.column(6)):
                bgra = np.frombuffer(data.as_buffer(), np.uint8).reshape(h, w, n)
                opaque = np.full((h, w, 1), 255, np.uint8)
                rgba = np.concatenate([bgra[:, :, [0, 0, 0]], opaque] if n == 1 else [bgra[:, :, [2, 1, 0]], bgra[:, :, 3:4] if n == 4 else opaque], axis=2)
                if max_side is not None and max(w, h) > max_side:
                    rgba = shrunk(rgba, *(max(1, math.floor(s * (max_side / max(w, h)) + 0.5)) for s in (w, h)))
                out = np.ascontiguousarray(shown(rgba, turn))
                for part in pixel_batches(image_id, out.shape[1], out.reshape(-1, 4)):
                    columns = [part.column(0), pa.array([origin] * part.num_rows, pa.string()), *part.columns[1:]]
                    yield pa.RecordBatch.from_arrays(columns, names=["image_id", "origin", "x", "y", "r", "g", "b", "a"])

    return rows.mapInArrow(run, f"image_id long, origin string, {PIXEL}")
