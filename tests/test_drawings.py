"""Golden cases of paths, drawings, exports, headers, edits and settings."""

import math
import re
import struct
import time
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import LessThanOrEqual

from pixelweft import queries
from pixelweft.functions import numbers, path, svg
from pixelweft.operators import color, edits, merge, region
from pixelweft.operators.trace import TraceOptions, trace
from pixelweft.schema import PIXEL
from pixelweft.plans import settings
from pixelweft.plans.pipeline import Settings, drawings
from pixelweft.sources import export, images, png
from pixelweft.sources.raster import budget_error, fit

DRAWING = '<svg version="1.1" width="200" height="160" viewBox="0 0 200 160"><g fill="#ff0000"><path d="M0 0 L10 0 10 10 Z M2 2 L4 2 4 4 Z"/><path d="M0 0 C0 5 5 10 10 10" transform="translate(5,6)" fill="#00ff00"/></g><path d="M1 1 L2 2"/></svg>'


def test_numbers():
    assert [numbers.compact(v) for v in (0.5, -0.5, -0.00001, 12.0, 1.23456, -3.1, 100)] == [".5", "-.5", "0", "12", "1.2346", "-3.1", "100"]
    assert [numbers.shortest(v) for v in (1.0, -0.0, 0.1, 1e21, 1e-7, 123456789.5)] == ["1", "0", "0.1", "1e+21", "1e-7", "123456789.5"]
    assert numbers.fixed(2.00005, 4) == "2.0000" and numbers.fixed(-2.5, 0) == "-3"


def test_straighten():
    assert path.straighten("M0 0 C3 0.1 6 0.1 10 0", 0.5) == "M0 0 L10 0 "
    assert path.straighten("M0 0 C0 10 10 10 10 0", 0.5) == "M0 0 C0 10 10 10 10 0 "
    assert path.straighten("M0 0 L5 0.1 L10 0 L10 10 Z", 0.5) == "M0 0 L10 0 L10 10 Z "
    assert path.straighten("M0 0 Q1 1 2 2", 0.5) == "M0 0 Q1 1 2 2"


def test_compress():
    assert path.compress("M0 0 L10 0 L10 10 L0 10 Z", 5, 6) == "M5 6h10v10h-10z"
    assert path.compress("M0 0 L1 1 L2 3 L.5 .25") == "M0 0l1 1 1 2-1.5-2.75"
    assert path.compress("M0 0 C0 5 5 10 10 10 C15 10 20 5 20 0") == "M0 0c0 5 5 10 10 10s10-5 10-10"
    assert path.compress("M0 0 A1 1 0 0 0 1 1") is None


def test_flatten_quarter_circle():
    k = 0.5522847498 * 100
    pts = path.flatten((100, 0), (100, k), (k, 100), (0, 100), 0.25)
    assert len(pts) >= 4 and pts[-1] == (0, 100) and all(abs(math.hypot(*p) - 100) < 1 for p in pts)


def test_parse():
    d = svg.parse_svg(DRAWING)
    assert [p["fill"] for p in d["paths"]] == ["#ff0000", "#00ff00", "#000000"] and (d["width"], d["height"]) == (200, 160)
    assert [len(p["subpaths"]) for p in d["paths"]] == [2, 1, 1] and d["paths"][1]["subpaths"][0]["start"] == {"x": 5.0, "y": 6.0}
    assert svg.parse_svg('<svg><path d="M0 0 Q1 1 2 2"/></svg>')["error"]


def test_grouping(spark):
    p = lambda f, d="M0 0": f'<path d="{d}"{f and f" fill={chr(34)}{f}{chr(34)}"}/>'
    one = lambda s: spark.createDataFrame([(s,)], "svg string").select(svg.group_fills("svg")).first()[0]
    assert one(p("#a") + "\n" + p("#a") + "\n" + p("#b")) == f'<g fill="#a">\n{p("")}\n{p("")}\n</g>\n{p("#b")}'
    for still in (p("#a") + p("#b") + p("#a"), p("#a") + "x" + p("#a"), p("") + p("")):
        assert one(still) == still


def test_dxf_and_pdf():
    t = export.dxf(DRAWING)
    assert t.count("POLYLINE") == 4 and "AC1009" in t and "10\n0\n20\n160\n" in t and t.endswith("0\nEOF\n")
    page = export.pdf(DRAWING)
    assert "/MediaBox [0 0 150 120]" in page and page.startswith("%PDF-1.4\n") and page.count(" f\n") == 3
    at = int(page.rsplit("startxref\n", 1)[1].split("\n")[0])
    assert page[at:].startswith("xref\n0 5\n")
    for i, line in enumerate(page[at:].split("\n")[3:7], 1):
        assert page[int(line[:10]) :].startswith(f"{i} 0 obj")


def test_png():
    rgba = export.painted('<svg width="4" height="3" viewBox="0 0 4 3"><path d="M0 0 L4 0 L4 3 L0 3 Z M1 1 L1 2 L3 2 L3 1 Z" fill="#102030"/></svg>')
    assert rgba.shape == (3, 4, 4) and rgba[0, 0].tolist() == [16, 32, 48, 255] and rgba[1, 1, 3] == 0 and rgba[1, 0, 3] == 255
    assert struct.unpack(">II", export.png(rgba)[16:24]) == (4, 3)


def winding(svg_text, scale):
    """Opaque pixels by the winding number of each centre, side by side."""
    w, h = export.painted_size(svg_text, scale)
    out = np.zeros((h, w, 4), np.uint8)
    for p in svg.parse_svg(svg_text)["paths"]:
        for y in range(h):
            for x in range(w):
                turns = 0
                for sub in p["subpaths"]:
                    pts = [(a * scale, b * scale) for a, b in export.points(sub)]
                    for (x0, y0), (x1, y1) in zip(pts, pts[1:] + pts[:1]):
                        low, high = sorted((y0, y1))
                        if low <= y + 0.5 < high and x0 + (y + 0.5 - y0) * (x1 - x0) / (y1 - y0) <= x + 0.5:
                            turns += 1 if y0 < y1 else -1
                if turns:
                    out[y, x] = (*export._rgb(p["fill"]), 255)
    return out


def decoded(file):
    """Pixels of a PNG without filters; sums of chunks and of the stream are checked."""
    assert file[:8] == b"\x89PNG\r\n\x1a\n"
    at, kinds, packed = 8, [], b""
    while at < len(file):
        (n,) = struct.unpack_from(">I", file, at)
        kind, data = file[at + 4 : at + 8], file[at + 8 : at + 8 + n]
        assert struct.unpack_from(">I", file, at + 8 + n) == (zlib.crc32(kind + data),)
        kinds.append(kind)
        packed += data if kind == b"IDAT" else b""
        at += 12 + n
    w, h = struct.unpack_from(">II", file, 16)
    assert kinds[0] == b"IHDR" and kinds[-1] == b"IEND" and set(kinds[1:-1]) == {b"IDAT"}
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + 4 * w)[:, 1:].reshape(h, w, 4)


BANDED = {
    2**40 + 1: DRAWING.replace('width="200" height="160" viewBox="0 0 200 160"', 'width="21" height="17" viewBox="0 0 21 17"'),
    2**40 + 2: '<svg width="9" height="13" viewBox="0 0 9 13"><path d="M-4 -3 L30 2 5 40 Z" fill="#010203"/><path d="M2 1 C20 0 -9 12 7 12 L1 6 Z M3 3 L3 9 6 9 Z" fill="#fedcba"/></svg>',
    2**40 + 3: '<svg width="3" height="5" viewBox="0 0 3 5"></svg>',
    2**40 + 4: '<svg width="6" height="1" viewBox="0 0 6 1"><path d="M1 0 L5 0 5 1 1 1 Z" fill="#ffffff"/><path d="M2 8 L5 8 5 9 Z" fill="#000001"/></svg>',
}


@pytest.mark.parametrize("scale", [1.0, 2.5])
def test_painted_by_winding_numbers(scale):
    for text in BANDED.values():
        assert (export.painted(text, scale) == winding(text, scale)).all()


@pytest.mark.parametrize("scale,rows", [(1.0, 1), (2.5, 4), (1.0, None)])
def test_png_by_bands(spark, tmp_path, scale, rows):
    """Files of bands hold what is painted whole, in cells and in a folder; null drawings have none."""
    drawn = spark.createDataFrame([*BANDED.items(), (7, None)], "image_id long, svg string").selectExpr("*", "'x' AS band", "1 AS path")
    parts = png.png_parts(drawn, scale, rows)
    files = {r.image_id: bytes(r.png) for r in png.png_cells(parts).collect()}
    assert set(files) == set(BANDED)
    png.write_png(parts, str(tmp_path / "out"))
    assert {f.name for f in (tmp_path / "out").iterdir()} == {f"{i}.png" for i in BANDED}
    for i, text in BANDED.items():
        assert (decoded(files[i]) == export.painted(text, scale)).all()
        assert (tmp_path / "out" / f"{i}.png").read_bytes() == files[i]
    if rows == 1:
        heights = {i: export.painted_size(text, scale)[1] for i, text in BANDED.items()}
        assert {r.image_id: r["count"] for r in parts.groupBy("image_id").count().collect()} == {i: h + 2 for i, h in heights.items()}
    assert png.png_parts(drawn.limit(0), scale, rows).count() == 0


def test_png_source_round_trip(spark, tmp_path):
    rgba = np.random.default_rng(0).integers(0, 256, (5, 7, 4)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(export.png(rgba))
    got = images.read_images(spark, str(tmp_path)).toPandas()
    out = np.zeros((5, 7, 4), int)
    out[got.y, got.x] = got[["r", "g", "b", "a"]]
    assert (out == rgba).all()


def pixels(spark, image_id, rgb, a):
    """One image as a pixel table."""
    h, w = rgb.shape
    rows = [(image_id, x, y, int(rgb[y, x]) >> 16, int(rgb[y, x]) >> 8 & 255, int(rgb[y, x]) & 255, int(a[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, f"image_id long, {PIXEL}")


def test_traced_outline_paints_back(spark):
    """Images with long ids, holes, touching corners and clear parts: cells, colours and clear pixels come back."""
    r = np.random.default_rng(1)
    made = {}
    for k in range(3):
        rgb = np.array([0xFF0000, 0x00FF00, 0x0000FF])[r.integers(0, 3 - k // 2, (14, 17))]
        made[(1 << 40) + k] = (rgb, np.where(r.random((14, 17)) < 0.1 * k, 0, 255))
    px = reduce(lambda x, y: x.union(y), [pixels(spark, i, *v) for i, v in made.items()])
    for kind in ("cutout", "stacked"):
        for row in trace(px, TraceOptions(mode="none", filter_speckle=1, layer_difference=0, hierarchical=kind)).collect():
            rgb, a = made[row.image_id]
            out = export.painted(row.svg)
            assert (out[:, :, 3] == a).all()
            assert ((out[:, :, 0].astype(int) << 16 | out[:, :, 1].astype(int) << 8 | out[:, :, 2])[a > 0] == rgb[a > 0]).all()
    with pytest.raises(ValueError):
        TraceOptions(mode="bogus")


SQUARE = [(x, y, 9) for x in range(2, 8) for y in range(3, 9)]
FRAME = [(x, y, 9) for x, y, _ in SQUARE if not (4 <= x < 6 and 5 <= y < 7)]
DISC = [(x, y, 9) for x in range(12) for y in range(12) if (x - 5.5) ** 2 + (y - 5.5) ** 2 <= 20]


@pytest.mark.parametrize("mode", ["polygon", "spline", "none"])
def test_shapes_come_out_as_written_by_hand(spark, mode):
    shapes = [SQUARE, FRAME, DISC]
    px = spark.createDataFrame([(i, x, y, *((200, 10, 30, 255) if (x, y, 9) in s else (0, 0, 0, 0))) for i, s in enumerate(shapes) for x in range(12) for y in range(12)], f"image_id int, {PIXEL}")
    got = {r.image_id: r.svg for r in trace(px, TraceOptions(mode=mode, filter_speckle=1)).collect()}
    path = lambda d, x, y: f'<path d="{d}" fill="#c80a1e" transform="translate({x},{y})"/>'
    square, hole = {"none": ("M0 0 L6 0 L6 6 L0 6 Z", "M4 2 L2 2 L2 4 L4 4 Z"), "polygon": ("M0 0 L6 0 L6 6 L0 6 Z", None), "spline": ("M0 0 L6 0 L6 6 L0 6 L0 0 Z", None)}[mode]
    assert path(square, 2, 3) in got[0]
    if hole:
        assert path(f"{square} {hole}", 2, 3) in got[1]
    else:
        assert square in got[1] and got[1].count("M") == 2 and got[1].count("Z") == 2
    # a disc stays within a pixel of its circle, in fewer points than its outline has
    drawn = svg.parse_svg(got[2])["paths"][0]["subpaths"][0]
    ends = [(s["to"]["x"], s["to"]["y"]) if isinstance(s["to"], dict) else tuple(s["to"]) for s in drawn["segments"]]
    assert all(abs(math.dist(p, (6, 6)) - 20**0.5) < 1.6 for p in ends)
    if mode != "none":
        assert len(ends) < 24
    assert "np." not in got[2] and ("C" in got[2]) == (mode == "spline")
    rough = {p: trace(px.where("image_id = 2"), TraceOptions(mode=mode, filter_speckle=1, path_precision=p)).first().svg for p in (0, 5)} if mode == "spline" else {}
    assert not rough or ("." not in rough[0].split("<path")[1] and max(len(n.split(".")[1]) for n in re.findall(r"\d+\.\d+", rough[5].split("<path")[1])) > 3)


def test_a_gradient_falls_into_steps(spark):
    """Grey from 0 to 255: no cell is farther than the allowed difference from its region's colour, at a tile and across tiles."""
    px = pixels(spark, 1, np.tile(np.arange(256) * 0x010101, (4, 1)), np.full((4, 256), 255))
    cells = region.regions(px)
    for tile in (512, 100, None):
        rows = merge.merged(cells, 16, tile).toPandas()
        grey = rows.rgb & 255
        assert (abs(grey - rows.x) <= 17).all() and 8 <= rows.region.nunique() <= 26
    assert merge.merged(cells, 255).select("region").distinct().count() == 1
    assert merge.merged(cells, 0).select("region").distinct().count() == 256


def test_merging_in_a_kernel_is_merging_by_joins(spark):
    r = np.random.default_rng(3)
    images = [r.integers(0, 30, (9, 11)) * 0x010203, np.add.outer(np.arange(9) * 5, np.arange(11) * 7) * 0x010001]
    px = pixels(spark, 1, images[0], np.full((9, 11), 255)).union(pixels(spark, 1 << 33, images[1], np.where(r.random((9, 11)) < 0.1, 0, 255)))
    cells = region.regions(px)
    rows = lambda tile: sorted(map(tuple, merge.merged(cells, 16, tile).collect()))
    assert rows(512) == rows(None)
    allowed = merge.merged(cells, 16, 4).join(cells.select("image_id", "x", "y", F.col("rgb").alias("old")), ["image_id", "x", "y"]).toPandas()
    new, old = allowed.rgb.to_numpy(), allowed.old.to_numpy()
    assert all((abs((new >> s & 255) - (old >> s & 255)) <= 17).all() for s in (16, 8, 0))


def jpeg(*segments):
    return b"\xff\xd8" + b"".join(segments) + b"\0" * 12


SOF = b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 400, 640) + b"\0" * 10


@pytest.mark.parametrize(
    "data, want",
    [
        (jpeg(b"\xff\xff\xff\x01", b"\xff\xd0", b"\xff\xc4\0\x04ab", SOF), (640, 400)),
        (jpeg(b"\xff\xd9", SOF), None),
        (jpeg(b"\xff\xda", SOF), None),
        (jpeg(b"\xff\xe0\0\x01", SOF), None),
        (b"\xff\xd8", None),
    ],
)
def test_jpeg_markers(data, want):
    found = images.jpeg_size(data)
    assert (found and found[:2]) == want


@pytest.mark.parametrize("order, turn, want", [("<", 6, (400, 640)), (">", 8, (400, 640)), ("<", 1, (640, 400))])
def test_exif(order, turn, want):
    tiff = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HIHHHIHHI", 42, 8, 1, 0x112, 3, 1, turn, 0, 0)
    app = b"Exif\0\0" + tiff
    assert images.jpeg_size(jpeg(b"\xff\xe1" + struct.pack(">H", len(app) + 2) + app, SOF))[:2] == want


def test_turns():
    stored = np.arange(6).reshape(2, 3)
    want = {1: stored, 2: stored[:, ::-1], 3: stored[::-1, ::-1], 4: stored[::-1], 5: stored.T, 6: np.rot90(stored, -1), 7: stored[::-1, ::-1].T, 8: np.rot90(stored)}
    for turn, shown in want.items():
        assert (images.shown(stored[:, :, None], turn)[:, :, 0] == shown).all(), turn


def test_images_are_turned(spark, tmp_path):
    jvm = spark._jvm
    drawn = jvm.java.awt.image.BufferedImage(32, 16, 1)
    drawn.createGraphics().fillRect(0, 0, 16, 16)  # white on the left, black on the right
    jvm.javax.imageio.ImageIO.write(drawn, "jpg", jvm.java.io.File(str(tmp_path / "plain one.jpg")))
    data = (tmp_path / "plain one.jpg").read_bytes()
    app = b"Exif\0\0II" + struct.pack("<HIHHHIHHI", 42, 8, 1, 0x112, 3, 1, 6, 0, 0)
    (tmp_path / "turned one.jpg").write_bytes(data[:2] + b"\xff\xe1" + struct.pack(">H", len(app) + 2) + app + data[2:])
    got = images.read_images(spark, str(tmp_path)).toPandas()
    at = {(r.origin.rsplit("/")[-1][:2], r.x, r.y): r.r for r in got.itertuples()}
    assert len(at) == len(got) == 2 * 32 * 16
    assert at["pl", 3, 8] > 240 and at["pl", 28, 8] < 15
    assert at["tu", 8, 3] > 240 and at["tu", 8, 28] < 15 and ("tu", 28, 8) not in at


def test_budget(spark):
    n = lambda w, u: spark.range(1).select(budget_error(F.lit(w).cast("long"), F.lit(w), F.lit(u))).first()[0]
    assert n(4000, 2) is None and n(8000, 4)


def test_edit_order(spark):
    acts = [{"seq": 1, "mode": "fill", "type": "rect", "color": "#f00", "x": 0.0, "y": 0.0, "width": 0.5, "height": 0.5}, {"seq": 2, "mode": "erase", "type": "rect", "x": 0.0, "y": 0.0, "width": 1.0, "height": 1.0}, {"seq": 3, "mode": "fill", "type": "rect", "color": "#0f0", "x": 0.5, "y": 0.5, "width": 0.5, "height": 0.5}]
    df = spark.createDataFrame([(1, a) for a in acts], f"image_id int, action {edits.ACTION}")
    d = spark.createDataFrame([(1, DRAWING), (2, DRAWING), (3, "no drawing")], "image_id int, svg string")
    out = {r.image_id: r.svg for r in edits.apply_actions(d, df).collect()}
    body = out[1][out[1].index("</defs>") :]
    # the first fill is inside the masked group, the last one on top of it
    assert body.index('fill="#f00"') < body.rindex("</g>") and body.endswith('fill="#0f0"/></svg>')
    assert out[2] == DRAWING and out[3] == "no drawing"
    assert body.index('fill="#0f0"') > body.rindex("</g>")


def test_marks():
    box = {"x": 0.0, "y": 0.0, "width": 100.0, "height": 50.0}
    dot = {"diameter": 0.1, "points": [{"x": 0.5, "y": 0.5}]}
    assert edits.mark(dot, box) == '<circle cx="50" cy="25" r="2.5" fill="#000"/>'
    assert edits.mark(dot, box, True) == '<rect x="48" y="23" width="5" height="5" fill="#000" shape-rendering="crispEdges"/>'
    line = {"diameter": 0.1, "points": [{"x": 0.0, "y": 0.0}, {"x": 0.1, "y": 0.2}]}
    assert 'd="M0 0 L10 10"' in edits.mark(line, box) and 'd="M0.5 0.5H10.5V10.5"' in edits.mark(line, box, True)


def test_edit_log_and_strokes(spark):
    log = [(1, i, op, i) for i, op in enumerate(["add", "add", "undo", "redo", "undo", "add", "redo", "undo", "undo", "undo", "redo"])]
    got = [r.action for r in edits.edit_log(spark.createDataFrame(log, "image_id int, seq int, op string, action long")).orderBy("pos").collect()]
    assert got == [0]
    moves = [(1, 0, "down", 0.0, 0.0), (1, 1, "move", 0.5, 0.5), (1, 2, "move", 0.5005, 0.5), (1, 3, "undo", 0.0, 0.0), (1, 4, "move", 0.9, 0.9), (1, 5, "down", 0.1, 0.1), (1, 6, "move", 0.2, 0.2), (1, 7, "up", 0.0, 0.0), (1, 8, "move", 0.3, 0.3)]
    got = [(r.stroke, r.x) for r in edits.strokes(spark.createDataFrame(moves, "image_id int, seq int, op string, x double, y double")).orderBy("stroke", "pos").collect()]
    assert got == [(0, 0.1), (0, 0.2)]


def test_settings(spark):
    raw = spark.createDataFrame([(1, '{"colors": 8, "speckle": "8", "fuzz": 999, "evil": 1, "mode": "none", "denoise": true, "upscale": "auto", "preset": "x", "knockoutColor": "#aabbcc"}'), (2, "[1, 2]"), (3, "not json"), (4, None)], "id int, settings string")
    got = {(r.id, r.key): r.value for r in settings.sanitized(settings.entries(raw)).collect()}
    assert got == {(1, "colors"): "8", (1, "mode"): '"none"', (1, "denoise"): "true", (1, "upscale"): '"auto"', (1, "preset"): '"x"', (1, "knockoutColor"): '"#aabbcc"'}


def test_nested_groups(spark):
    """A path has the fill of the innermost group around it that has one, in either form of reading."""
    text = '<svg><g fill="#111111"><g><path d="M0 0"/><g fill="#222222"><path d="M1 1"/></g><path d="M2 2" fill="#333333"/></g></g></g><path d="M3 3"/></svg>'
    want = ["#111111", "#222222", "#333333", "#000000"]
    assert [p["fill"] for p in svg.parse_svg(text)["paths"]] == want
    rows = svg.path_rows(spark.createDataFrame([(1, text)], "image_id int, svg string")).orderBy("path_ord").collect()
    assert [r.fill for r in rows] == want


def test_noisy_image_is_traced(spark):
    """Some 12,000 regions in one image, as rows."""
    r = np.random.default_rng(2)
    rgb = r.integers(0, 1 << 24, 8)[r.integers(0, 8, (120, 130))]
    (row,) = trace(pixels(spark, 5, rgb, np.full(rgb.shape, 255)), TraceOptions(mode="none", filter_speckle=1, layer_difference=0, hierarchical="cutout")).collect()
    assert row.svg.count("<path") > 10_000
    out = export.painted(row.svg)
    assert ((out[:, :, 0].astype(int) << 16 | out[:, :, 1].astype(int) << 8 | out[:, :, 2]) == rgb).all()


def plain_chain(points, tolerance):
    ends, at = [], 0
    while at < len(points) - 1:
        to = at + 1
        while to + 1 < len(points) and all(path.off_chord(p, points[at], points[to + 1]) <= tolerance for p in points[at + 1 : to + 1]):
            to += 1
        ends.append(points[to])
        at = to
    return ends


def test_straight_runs_are_those_of_looking_at_all_points():
    r = np.random.default_rng(6)
    for k in range(400):
        n = int(r.integers(1, 60))
        walk = np.cumsum(r.integers(-2, 4, (n, 2)) / (1 if k % 2 else 2), axis=0)
        if k % 5 == 0:
            walk = np.round(walk) * [1, 0]  # back and forth on a line, repeated points
        pts = [tuple(map(float, p)) for p in walk]
        for tolerance in (0.0, 0.5, 1.0, 2.5):
            assert path._chain(pts, tolerance) == plain_chain(pts, tolerance)


def test_straightening_takes_linear_time():
    stairs = [(float((i + 1) // 2), float(i // 2)) for i in range(16_000)]
    began = time.perf_counter()
    assert len(path._chain(stairs, 1.0)) == 1
    assert time.perf_counter() - began < 1


def test_files_become_drawings(spark, tmp_path):
    """The README's example: files are read, quantised, labelled, filled and traced under ids of 64 bits."""
    shape = np.full((20, 30, 4), 255, np.uint8)
    shape[5:15, 8:22, :3] = (200, 10, 30)
    for k in range(3):
        (tmp_path / f"a {k}+b.png").write_bytes(export.png(np.roll(shape, k, axis=1)))
    px = images.read_images(spark, str(tmp_path))
    ids = {r.image_id for r in px.select("image_id").distinct().collect()}
    assert len(ids) == 3 and max(map(abs, ids)) > 1 << 31
    assert {r.image_id for r in region.regions(px.drop("origin")).select("image_id").distinct().collect()} == ids
    few = color.quantize(px.drop("origin"), 2)
    assert few.select("image_id", "r", "g", "b").distinct().count() == 6
    rough = px.drop("origin").withColumn("r", (F.col("r") - F.col("x")).cast("int"))
    assert color.quantize(rough, 4).select("image_id", "r", "g", "b").distinct().groupBy("image_id").count().agg(F.max("count")).first()[0] <= 4
    assert region.knock_out_edges(few, 16.0).where("a = 0").count() == 3 * (600 - 140)
    drawn = drawings(px.drop("origin"), Settings(colors=8, straighten=0.5)).collect()
    assert {r.image_id for r in drawn} == ids and all((r.width, r.height) == (30, 20) and '#c80a1e"' in r.svg for r in drawn)


def test_files_are_judged_by_their_heads(spark, tmp_path):
    """Bad files are refused before more than their head is read; what is left is decoded once and made smaller as resample() does."""
    r = np.random.default_rng(1)
    rgba = r.integers(0, 256, (37, 61, 4)).astype(np.uint8)
    rgba[r.random((37, 61)) < 0.2, 3] = 0
    (tmp_path / "good.png").write_bytes(export.png(rgba))
    bomb = bytearray(export.png(rgba))
    bomb[16:24] = struct.pack(">II", 30_000, 30_000)
    (tmp_path / "bomb.png").write_bytes(bytes(bomb))
    (tmp_path / "text.png").write_bytes(b"no image")
    with open(tmp_path / "large.png", "wb") as f:
        f.write(export.png(rgba))
        f.truncate(60 << 20)
    heads = {x.name.split("/")[-1]: x for x in images.image_heads(spark, str(tmp_path)).collect()}
    assert {k: v.error for k, v in heads.items()} == {"good.png": None, "bomb.png": "bad size", "text.png": "unknown format", "large.png": "file too large"}
    reader = images.HeadReader(str(tmp_path))
    list(reader.pushFilters([LessThanOrEqual(("length",), 50 << 20)]))
    rows = [x for p in reader.partitions() for x in reader.read(p)]
    assert len(rows) == 3 and all(len(x[2]) <= images.HEAD for x in rows)
    assert sum(len(x[2]) for p in images.HeadReader(str(tmp_path)).partitions() for x in images.HeadReader(str(tmp_path)).read(p)) < 4 * images.HEAD
    for side in (None, 61, 40, 7):
        px = images.read_images(spark, str(tmp_path), side)
        assert {x.origin.split("/")[-1] for x in px.select("origin").distinct().collect()} == {"good.png"}
        plain = spark.createDataFrame([(1, x, y, *map(int, rgba[y, x])) for y in range(37) for x in range(61)], f"image_id int, {PIXEL}")
        want = fit(plain, side) if side else plain
        names = ["x", "y", "r", "g", "b", "a"]
        assert sorted(map(tuple, px.select(*names).collect())) == sorted(map(tuple, want.select(*names).collect()))
        plan = px._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan image") == 1 or plan.count("FileScan image") == 1


def test_svg_files(spark, tmp_path):
    """A folder an image and a file a drawing, as Spark reads them too; written without one process or move of the driver a file."""
    texts = {2**40: ["<svg>ü</svg>"], -3: ["a\nb", "", "a\nb"], 7: ["x"] * 2}
    rows = spark.createDataFrame([(i, t) for i, each in texts.items() for t in each], "image_id long, svg string")
    path = f"file://{tmp_path}/out"
    files = export.write_svg(rows, path)
    want = sorted((i, t + "\n") for i, each in texts.items() for t in each)
    assert sorted(tuple(r) for r in export.read_svg(files, path).collect()) == want
    assert sorted((r.image_id, r.value) for r in spark.read.text(path, wholetext=True).collect()) == want
    assert sorted(p.name for p in (tmp_path / "out" / "image_id=-3").iterdir()) == ["0.txt", "1.txt", "2.txt"]
    with pytest.raises(FileExistsError):
        export.write_svg(rows, path)


def test_small_groups_are_spread(spark, sf_dir):
    """Shapes come from a small table, and palettes and bands from few bytes; their work is not joined into one partition."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert queries._shapes(spark, sf_dir).rdd.getNumPartitions() == parts
    hist = spark.createDataFrame([(i, c * 1000, 1, c) for i in (1, 2**40) for c in range(i % 7 + 3)], "image_id long, rgb int, n long, first long")
    out = color.palette_map(hist, 4)
    assert out.rdd.getNumPartitions() == parts
    assert {r.image_id for r in out.collect()} == {i for i in (1, 2**40) if i % 7 + 3 > 4}


def test_bands_of_many_drawings_in_a_call(monkeypatch):
    """Bands of several drawings are deflated one by one and sent when they come to enough bytes."""
    side = lambda image, path, x0, y0, x1, y1: (image, 4, 4, 4, 0, 0, path, 255, x0, y0, x1, y1, 0)
    rows = [r for image in ("a", "b") for r in (side(image, -1, 0.0, 0.0, 0.0, 0.0), side(image, 0, 1.0, 0.0, 1.0, 4.0), side(image, 0, 3.0, 4.0, 3.0, 0.0))]
    names = ["image_id", "width", "height", "rows", "first", "last", "path", "fill", "x0", "y0", "x1", "y1", "band"]
    table = pa.table({n: list(c) for n, c in zip(names, zip(*rows))})
    whole = list(png._deflated(table, np.array([0, 3])))
    assert [b.column("image_id").to_pylist() for b in whole] == [["a", "b"]]
    packed = {c for c in whole[0].column("bytes").to_pylist()}
    assert len(packed) == 1 and zlib.decompressobj().decompress(packed.pop()[8:-4]) == (b"\0" + b"\0" * 4 + b"\0\0\xff\xff" * 2 + b"\0" * 4) * 4
    monkeypatch.setattr(png, "SENT", 1)
    assert [b.column("image_id").to_pylist() for b in png._deflated(table, np.array([0, 3]))] == [["a"], ["b"]]
