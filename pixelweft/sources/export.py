"""Drawings as SVG, PDF, DXF and PNG."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fixed, trimmed
from ..functions.path import flatten
from ..functions.svg import parse_svg
from ..functions.udfs import vectorized
from ..schema import CAD_COLORS, UNITS_PER_INCH, with_id
from .store import stored

#: How far a DXF line may be off its curve.
FLATTEN = 0.2


def _rgb(fill: str) -> tuple[int, int, int]:
    try:
        n = int(fill[1:], 16)
    except ValueError:
        n = 0
    return n >> 16 & 255, n >> 8 & 255, n & 255


def cad_color(fill: str) -> int:
    try:
        int(fill[1:], 16)
    except ValueError:
        return 7
    rgb = _rgb(fill)
    return min(CAD_COLORS, key=lambda c: sum((u - v) ** 2 for u, v in zip(rgb, c[1:])))[0]


def _xy(p: dict) -> tuple[float, float]:
    return p["x"], p["y"]


def points(sub: dict, tolerance: float = FLATTEN) -> list[tuple[float, float]]:
    """A subpath as a polyline; a closed one does not come back to its start."""
    pen = _xy(sub["start"])
    out = [pen]
    for s in sub["segments"]:
        to = _xy(s["to"])
        out += [to] if s["kind"] == "line" else flatten(pen, _xy(s["c1"]), _xy(s["c2"]), to, tolerance)
        pen = to
    return out[:-1] if sub["closed"] and len(out) > 1 and out[-1] == out[0] else out


def dxf(svg: str, scale: float = 1.0) -> str:
    """DXF R12: a layer a fill, a polyline a subpath, y upwards."""
    drawing = parse_svg(svg)
    rows: list[tuple[int, object]] = [(0, "SECTION"), (2, "HEADER"), (9, "$ACADVER"), (1, "AC1009"), (0, "ENDSEC")]
    name = lambda fill: "C_" + fill.replace("#", "", 1)
    layers = {name(p["fill"]): cad_color(p["fill"]) for p in drawing["paths"]}
    rows += [(0, "SECTION"), (2, "TABLES"), (0, "TABLE"), (2, "LAYER"), (70, len(layers))]
    for layer, aci in layers.items():
        rows += [(0, "LAYER"), (2, layer), (70, 0), (62, aci), (6, "CONTINUOUS")]
    rows += [(0, "ENDTAB"), (0, "ENDSEC"), (0, "SECTION"), (2, "ENTITIES")]
    for p in drawing["paths"]:
        layer = name(p["fill"])
        for sub in p["subpaths"]:
            rows += [(0, "POLYLINE"), (8, layer), (66, 1), (70, int(sub["closed"]))]
            for x, y in points(sub):
                rows += [(0, "VERTEX"), (8, layer), (10, trimmed(x * scale)), (20, trimmed((drawing["height"] - y) * scale)), (30, 0)]
            rows.append((0, "SEQEND"))
    rows += [(0, "ENDSEC"), (0, "EOF")]
    return "".join(f"{code}\n{value}\n" for code, value in rows)


def pdf(svg: str, page_width: float | None = None, page_height: float | None = None) -> str:
    """A PDF of one page in points, three quarters of a pixel unless sizes are given."""
    drawing = parse_svg(svg)
    w, h = drawing["width"], drawing["height"]
    pw, ph = (s * 72 / 96 if given is None else given for s, given in ((w, page_width), (h, page_height)))
    t = lambda *v: " ".join(trimmed(x) for x in v)
    lines = [f"{t(pw / w if w else 0)} 0 0 {t(-ph / h if h else 0)} 0 {t(ph)} cm"]
    for p in drawing["paths"]:
        lines.append(f"{t(*(c / 255 for c in _rgb(p['fill'])))} rg")
        for sub in p["subpaths"]:
            lines.append(f"{t(*_xy(sub['start']))} m")
            for s in sub["segments"]:
                lines.append(f"{t(*_xy(s['to']))} l" if s["kind"] == "line" else f"{t(*_xy(s['c1']), *_xy(s['c2']), *_xy(s['to']))} c")
            lines += ["h"] * sub["closed"]
        lines.append(" f")
    content = "\n".join(lines) + "\n"
    bodies = [
        "<< /Type /Catalog /Pages 2 0 R >>",
        "<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {t(pw, ph)}] /Contents 4 0 R /Resources << >> >>",
        f"<< /Length {len(content)} >>\nstream\n{content}endstream",
    ]
    objects = [f"{i} 0 obj\n{body}\nendobj\n" for i, body in enumerate(bodies, 1)]
    head = "%PDF-1.4\n"
    starts = np.cumsum([len(head), *map(len, objects)]).tolist()
    table = "".join(f"{at:010d} 00000 n \n" for at in starts[:-1])
    return f"{head}{''.join(objects)}xref\n0 {len(bodies) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(bodies) + 1} /Root 1 0 R >>\nstartxref\n{starts[-1]}\n%%EOF\n"


def sides(svg: str, scale: float = 1.0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(path, fill, starts, ends) of the sides of each subpath, in pixels; level ones cross no row and are left out."""
    for k, p in enumerate(parse_svg(svg)["paths"]):
        r, g, b = _rgb(p["fill"])
        for sub in p["subpaths"]:
            start = np.array(points(sub)) * scale
            end = np.roll(start, -1, axis=0)
            steep = start[:, 1] != end[:, 1]
            yield k, r << 16 | g << 8 | b, start[steep], end[steep]


def paint(path: np.ndarray, fill: np.ndarray, start: np.ndarray, end: np.ndarray, width: int, first: int, height: int) -> np.ndarray:
    """RGBA of the rows from first on that sides in order of path enclose: nonzero fill, sampled at pixel centres."""
    low, high = np.minimum(start[:, 1], end[:, 1]), np.maximum(start[:, 1], end[:, 1])
    top = np.clip(np.ceil(low - 0.5), first, first + height).astype(np.int64)
    n = np.maximum(np.clip(np.ceil(high - 0.5), first, first + height).astype(np.int64) - top, 0)
    side = np.repeat(np.arange(len(n)), n)
    row = top[side] + np.arange(len(side)) - np.repeat(np.cumsum(n) - n, n)
    (x0, y0), (x1, y1) = start[side].T, end[side].T
    x = x0 + (row + 0.5 - y0) * (x1 - x0) / (y1 - y0)
    col = np.clip(np.ceil(x - 0.5), 0, width).astype(np.int64)
    way, row = np.where(y0 < y1, 1, -1), row - first
    out = np.zeros((height, width, 4), np.uint8)
    cuts = np.flatnonzero(np.diff(path[side], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(side)]):
        r0, c0, r1, c1 = row[a:b].min(), col[a:b].min(), row[a:b].max() + 1, col[a:b].max()
        turns = np.zeros((r1 - r0, c1 - c0 + 1), np.int32)
        np.add.at(turns, (row[a:b] - r0, col[a:b] - c0), way[a:b])
        c = int(fill[side[a]])
        out[r0:r1, c0:c1][np.cumsum(turns, axis=1)[:, :-1] != 0] = (c >> 16, c >> 8 & 255, c & 255, 255)
    return out


def painted_size(svg: str, scale: float = 1.0) -> tuple[int, int]:
    drawing = parse_svg(svg)
    return max(1, round(drawing["width"] * scale)), max(1, round(drawing["height"] * scale))


def painted(svg: str, scale: float = 1.0) -> np.ndarray:
    """RGBA of the drawing at its box's size."""
    w, h = painted_size(svg, scale)
    found = list(sides(svg, scale))
    path, fill = (np.repeat([f[i] for f in found], [len(f[2]) for f in found]).astype(np.int64) for i in (0, 1))
    start, end = (np.concatenate([np.zeros((0, 2)), *(f[i] for f in found)]) for i in (2, 3))
    return paint(path, fill, start, end, w, 0, h)


def png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_head(width: int, height: int) -> bytes:
    return b"\x89PNG\r\n\x1a\n" + png_chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0))


def png_rows(rgba: np.ndarray) -> bytes:
    """Rows as they are packed, each behind the mark of no filter."""
    h, w = rgba.shape[:2]
    return np.hstack([np.zeros((h, 1), np.uint8), rgba.reshape(h, w * 4)]).tobytes()


def png(rgba: np.ndarray) -> bytes:
    h, w = rgba.shape[:2]
    return png_head(w, h) + png_chunk(b"IDAT", zlib.compress(png_rows(rgba), 6)) + png_chunk(b"IEND", b"")


@vectorized("string")
def to_dxf(svg: pd.Series, scale: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else dxf(s, k) for s, k in zip(svg, scale)])


@vectorized("string")
def to_pdf(svg: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    opt = lambda v: None if pd.isna(v) else float(v)
    return pd.Series([None if s is None else pdf(s, opt(w), opt(h)) for s, w, h in zip(svg, width, height)])


@vectorized("binary")
def to_png(svg: pd.Series, scale: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else png(painted(s, k)) for s, k in zip(svg, scale)])


@vectorized("array<struct<rgb:int,pixels:long>>")
def png_colors(data: pd.Series) -> pd.Series:
    """Opaque pixels by colour of PNGs as png() writes them (RGBA, no filters)."""

    def of(raw: bytes) -> list[dict[str, int]]:
        at, packed = 8, b""
        w, h = struct.unpack_from(">II", raw, 16)
        while at < len(raw):
            (n,) = struct.unpack_from(">I", raw, at)
            packed += raw[at + 8 : at + 8 + n] if raw[at + 4 : at + 8] == b"IDAT" else b""
            at += 12 + n
        rgba = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + 4 * w)[:, 1:].reshape(-1, 4).astype(np.int64)
        rgba = rgba[rgba[:, 3] > 0]
        rgb, n = np.unique(rgba[:, 0] * 65536 + rgba[:, 1] * 256 + rgba[:, 2], return_counts=True)
        return [{"rgb": int(c), "pixels": int(k)} for c, k in zip(rgb, n)]

    return pd.Series([None if d is None else of(bytes(d)) for d in data])


def physical_width_value(v: Column) -> Column:
    """v as a width: finite, above zero and at most 100,000, else null."""
    w = v.try_cast("double")
    return F.when((w > 0) & (w <= 100_000), w)


def physical_width_in(value: Column, unit: Column, size: Column, per_mm: float, per_inch: float) -> Column:
    """The export width in an output unit; null if it goes by pixels or is no width."""
    w = F.when(size == "physical", physical_width_value(value))
    return F.when(unit == "in", w * F.lit(per_inch)).when(unit == "cm", w * F.lit(per_mm) * 10).when(unit == "mm", w * F.lit(per_mm))


def pdf_page(value: Column, unit: Column, size: Column, source_w: Column, source_h: Column) -> tuple[Column, Column]:
    w = F.coalesce(physical_width_in(value, unit, size, 72 / 25.4, 72.0), source_w * F.lit(0.75))
    return w, w * (source_h / source_w)


def dxf_scale(value: Column, unit: Column, size: Column, source_w: Column, traced_w: Column) -> Column:
    return F.coalesce(physical_width_in(value, unit, size, 1.0, 25.4), source_w.cast("double")) / traced_w


@vectorized("string")
def dimensions_text(width: pd.Series, height: pd.Series, unit: pd.Series) -> pd.Series:
    """Inches as a text in unit."""
    digits = {"px": 0, "in": 2}
    return pd.Series([f"{fixed(w * UNITS_PER_INCH[u], digits.get(u, 1))}×{fixed(h * UNITS_PER_INCH[u], digits.get(u, 1))} {u}" for w, h, u in zip(width, height, unit)])


def file_name(name: Column, extension: str) -> Column:
    return F.concat(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit(f"_traced.{extension}"))


def vector_exports(images: DataFrame, edited: str) -> DataFrame:
    """image_id and vector_export: PDF and DXF hold no marks, so they are offered only where no row of the image is edited."""
    return images.groupBy("image_id").agg((F.count_if(F.col(edited)) == 0).alias("vector_export"))


def _folder_name(image_id: object) -> str:
    """As Spark names folders by a column, so that it can read them too."""
    return "image_id=" + ("__HIVE_DEFAULT_PARTITION__" if image_id is None else re.sub(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", str(image_id)))


def write_svg(drawings: DataFrame, path: str) -> DataFrame:
    """Each drawing as a text file with a line break at its end, an image's in a folder of its own below a new one that all executors see; returns image_id and file.

    Tasks write and name the files. With Spark's writer the driver moves every image's folder,
    and where its local file system has no native library it starts a process a file. A file is
    renamed when it is whole, so a task that is run again leaves no broken one.
    """
    at, base = FileSystem.from_uri(path)
    if at.get_file_info(base).type != FileType.NotFound:
        raise FileExistsError(path)
    at.create_dir(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, image, k, seen = FileSystem.from_uri(path)[0], None, 0, False
        for batch in batches:
            files = []
            for i, svg in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k = k + 1 if i == image and seen else 0
                image, seen = i, True
                folder = f"{base}/{_folder_name(i)}"
                whole, part = f"{folder}/{k}.txt", f"{folder}/.{k}-{os.urandom(8).hex()}"
                at.create_dir(folder)
                with at.open_output_stream(part) as out:
                    out.write(((svg or "") + "\n").encode())
                at.move(part, whole)
                files.append(whole)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.string())], names=["image_id", "file"])

    parts = int(drawings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = drawings.select("image_id", "svg").repartition(parts, "image_id").sortWithinPartitions("image_id", "svg")
    return stored(rows.mapInArrow(run, with_id(drawings, "file string")))


def read_svg(files: DataFrame, path: str) -> DataFrame:
    """image_id and svg, the text as it stands, of what write_svg() returns for path. Tasks read the files by name, so no list of all of them meets in the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = FileSystem.from_uri(path)[0]
        for batch in batches:
            texts = []
            for file in batch.column(1).to_pylist():
                with at.open_input_file(file) as text:
                    texts.append(text.read().decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["image_id", "svg"])

    return files.select("image_id", "file").mapInArrow(run, with_id(files, "svg string"))
