"""Types, limits and the fixed settings relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A pixel with at least this alpha is opaque.
ALPHA = 128
MAX_PIXELS = 64_000_000
MAX_SIDE, MAX_SIDE_ULTRA = 2048, 4096
MAX_FILE_BYTES, MAX_SOURCE_PIXELS, MAX_SOURCE_SIDE = 50 * 1024 * 1024, 100_000_000, 32_768
MM_PER_UNIT = {"mm": 1.0, "cm": 10.0, "in": 25.4}
UNITS_PER_INCH = {"px": 96.0, "in": 1.0, "cm": 2.54, "mm": 25.4}

#: Columns after the image's number, which is an int or a long.
PIXEL = "x int, y int, r int, g int, b int, a int"
PIXELS = f"image_id int, {PIXEL}"
POINT = "struct<x:double,y:double>"
SEGMENT = f"struct<kind:string,c1:{POINT},c2:{POINT},to:{POINT}>"
SUBPATHS = f"array<struct<start:{POINT},segments:array<{SEGMENT}>,closed:boolean>>"
SETTINGS = "colors double, speckle double, layerDiff double, upscale string, mode string, cornerThreshold double, hierarchical string, grayscale boolean, denoise boolean, crisp boolean, stencil boolean, transparent string, fuzz double, edgeTrim double, defringe double, stencilThreshold double, stencilInk string, pathPrecision double, lengthThreshold double, spliceThreshold double, straighten double"

# Defaults, presets, profiles, ranges and palettes that results must agree on.
DEFAULTS = {
    "colors": 256.0, "speckle": 8.0, "layerDiff": 16.0, "upscale": "2", "mode": "spline", "cornerThreshold": 60.0, "hierarchical": "stacked",
    "grayscale": False, "denoise": False, "crisp": False, "stencil": False, "transparent": "", "fuzz": 16.0, "edgeTrim": 0.0, "defringe": 0.0,
    "stencilThreshold": 128.0, "stencilInk": "black", "pathPrecision": 3.0, "lengthThreshold": 4.0, "spliceThreshold": 45.0, "straighten": 0.0,
}
#: (colors, speckle, layer difference)
PRESETS = [(2, 16, 48), (3, 16, 32), (4, 12, 28), (6, 10, 26), (8, 8, 24), (16, 8, 16), (32, 4, 16), (64, 4, 12), (128, 2, 8), (256, 3, 10)]
#: name, colors, speckle, layer difference, mode, corner, precision, splice, upscale, straighten, minify, stencil, ink
PROFILES = [
    ("web", 16, 10, 24, "spline", 60, 1, None, "2", 1.0, True, False, None),
    ("balanced", 256, 8, 16, "spline", 60, 2, None, "2", 0.5, False, False, None),
    ("detail", 64, 2, 8, "spline", 45, 4, 30, "auto", 0.0, False, False, None),
    ("maxDetail", 128, 1, 6, "spline", 25, 4, 20, "auto", 0.0, False, False, None),
    ("pixelExact", 8, 12, 6, "none", 60, 4, 45, "auto", 0.0, False, False, None),
    ("print", 8, 12, 28, "spline", 45, 3, None, "auto", 1.0, False, False, None),
    ("monoBlack", 2, 6, 48, "spline", 25, 4, None, "auto", 1.0, False, True, "black"),
    ("monoWhite", 2, 6, 48, "spline", 25, 4, None, "auto", 1.0, False, True, "white"),
    ("laser", 2, 12, 48, "spline", 30, 3, None, "auto", 1.5, False, True, None),
]
RANGES = {
    "colors": (2, 256), "speckle": (0, 32), "layerDiff": (0, 128), "cornerThreshold": (0, 120), "stencilThreshold": (1, 254), "fuzz": (0, 255), "edgeTrim": (0, 16),
    "defringe": (0, 8), "pathPrecision": (1, 4), "lengthThreshold": (3.5, 10), "spliceThreshold": (10, 90), "straighten": (0, 4),
}
CHOICES = {
    "hierarchical": ("stacked", "cutout"), "mode": ("spline", "polygon", "none"), "stencilInk": ("black", "white"), "transparent": ("", "edges", "auto", "custom"),
    "exportSize": ("px", "physical"), "physicalUnit": ("px", "mm", "cm", "in"), "profile": ("", *(p[0] for p in PROFILES)),
}
FLAGS = ("grayscale", "denoise", "crisp", "stencil", "minify")
#: CAD colour index and its colour; on a tie the first one counts.
CAD_COLORS = [(1, 255, 0, 0), (2, 255, 255, 0), (3, 0, 255, 0), (4, 0, 255, 255), (5, 0, 0, 255), (6, 255, 0, 255), (7, 255, 255, 255), (7, 0, 0, 0), (8, 128, 128, 128)]


def with_id(df: DataFrame, columns: str) -> str:
    """A schema of image_id, of the type that it has in df, and columns."""
    return f"image_id {df.schema['image_id'].dataType.simpleString()}, {columns}"


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "colors int, speckle int, layer_diff int")


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, "name string, colors int, speckle int, layer_diff int, mode string, corner int, precision int, splice int, upscale string, straighten double, minify boolean, stencil boolean, ink string")


def cad_colors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(CAD_COLORS)], "ord int, aci int, pr int, pg int, pb int")
