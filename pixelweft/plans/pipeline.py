"""The three composite plans: preprocessing, finishing, exporting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import svg as svgs
from ..operators import color, edits, neighbourhood, pixel, region
from ..operators.trace import TraceOptions, trace
from ..schema import DEFAULTS, MAX_SIDE, MAX_SIDE_ULTRA, PROFILES
from ..sources import raster
from ..sources.store import stored


@dataclass(frozen=True)
class Settings:
    colors: int = int(DEFAULTS["colors"])
    grayscale: bool = False
    denoise: bool = False
    stencil: bool = False
    stencil_threshold: int = int(DEFAULTS["stencilThreshold"])
    stencil_ink: str = DEFAULTS["stencilInk"]
    transparent: str | tuple[int, int, int] = ""
    fuzz: float = DEFAULTS["fuzz"]
    edge_trim: int = 0
    defringe: int = 0
    straighten: float = 0.0
    upscale: str = "1"


def preprocess(px: DataFrame, s: Settings) -> DataFrame:
    """The pixels as the tracer sees them. Settings are literals, so the plan holds only the steps that are on.

    What several parts of a later step read is stored, so that it is computed once
    and no plan grows over more than one of the large steps.
    """
    out = pixel.grayscale(px) if s.grayscale or s.stencil else px
    # binarising changes nothing where no pixel has alpha, so no probe is needed
    out = pixel.binarize_alpha(out)
    if s.denoise:
        out = neighbourhood.median_filter(out, 2)
    if s.colors < 256 or s.transparent:
        out = stored(out)
    quantized = s.colors < 256 and not s.stencil
    if quantized:
        out = stored(neighbourhood.mode_filter(color.quantize(out, s.colors)))
    if s.transparent:
        out, found = region.remove_background(out, s.transparent, s.fuzz, quantized)
        if s.edge_trim or s.defringe:
            before = stored(out)
            out = neighbourhood.erode(before, s.edge_trim)
            out = neighbourhood.defringe(out, s.defringe)
            # only images of which a colour was removed are trimmed
            hit = found.where("rgb is not null").select("image_id")
            out = out.join(hit, "image_id", "left_semi").unionByName(before.join(hit, "image_id", "left_anti"))
    if s.stencil:
        out = pixel.fill_transparent(pixel.threshold(out, s.stencil_threshold), (255, 255, 255))
    return out


def finish(traced: DataFrame, s: Settings, source_width: str = "width", source_height: str = "height") -> DataFrame:
    """traced (image_id, width, height, svg): fills grouped, the root sized, lines straightened, ink applied."""
    svg = svgs.sized_root(svgs.group_fills("svg"), F.col(source_width), F.col(source_height))
    out = traced.withColumn("svg", svg).withColumn("svg", svgs.straighten_paths("svg", F.lit(float(s.straighten))))
    return out.withColumn("svg", svgs.stencil_ink(F.col("svg"), F.lit(s.stencil_ink))) if s.stencil else out


def scaled(px: DataFrame, upscale: str, nearest: bool = False) -> DataFrame:
    """px at the scale that the tracer takes for upscale (a factor, auto or ultra); single pixels where nearest."""
    if upscale == "1":
        return px
    w, h, side = F.col("w"), F.col("h"), MAX_SIDE_ULTRA if upscale == "ultra" else MAX_SIDE
    return raster.resample(px, raster.fit_trace_scale(w, h, raster.effective_upscale(F.lit(upscale), w, h), side), nearest)


def drawings(px: DataFrame, s: Settings = Settings(), o: TraceOptions = TraceOptions()) -> DataFrame:
    """image_id, width, height (as traced) and svg, whose root has the size of px."""
    traced = trace(preprocess(scaled(px, s.upscale, nearest=o.mode == "none"), s), o)
    if s.upscale == "1":
        return finish(traced, s)
    source = raster.sizes(px).select("image_id", F.col("w").alias("source_width"), F.col("h").alias("source_height"))
    return finish(traced.join(source, "image_id"), s, "source_width", "source_height").drop("source_width", "source_height")


def of_profile(name: str) -> tuple[Settings, TraceOptions]:
    """Settings and tracer options of an export profile; what it leaves open is the default."""
    _, colors, speckle, difference, mode, corner, precision, splice, upscale, straighten, _, stencil, ink = next(p for p in PROFILES if p[0] == name)
    options = {"splice_threshold": float(splice)} if splice is not None else {}
    return Settings(colors=colors, stencil=stencil, stencil_ink=ink or DEFAULTS["stencilInk"], straighten=straighten, upscale=upscale), TraceOptions(mode=mode, filter_speckle=speckle, layer_difference=difference, corner_threshold=float(corner), path_precision=precision, **options)


def drawings_by_profile(px: DataFrame, chosen: DataFrame) -> DataFrame:
    """drawings() of each image with the profile that chosen (image_id, profile) gives it; images without a known one have none.

    One plan a profile that is chosen, and the profiles are a fixed table, so images of
    any number take no more plans.
    """
    names = [name for name, *_ in PROFILES]
    asked = {r["profile"] for r in chosen.where(F.col("profile").isin(names)).select("profile").distinct().collect()}
    out = None
    for name in [n for n in names if n in asked] or names[:1]:
        own = px.join(chosen.where(F.col("profile") == name).select("image_id").distinct(), "image_id", "left_semi")
        one = drawings(own, *of_profile(name)).select("image_id", F.lit(name).alias("profile"), "width", "height", "svg")
        out = one if out is None else out.unionByName(one)
    return out


def exported(finished: DataFrame, actions: DataFrame | None = None, pixel_exact: bool = False) -> DataFrame:
    """finished (image_id, svg, minify, physical_width, physical_unit, title) -> image_id, svg, paths, kilobytes; never traces again."""
    out = svgs.export_options(finished)
    if actions is not None:
        out = edits.apply_actions(out.select("image_id", "svg"), actions, pixel_exact)
    return out.select("image_id", "svg", svgs.count_paths(F.col("svg")).alias("paths"), (F.octet_length("svg") / 1024).alias("kilobytes"))
