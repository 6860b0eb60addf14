"""Settings: checks, precedence, presets, profiles, units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..operators.pixel import luma
from ..schema import CHOICES, DEFAULTS, FLAGS, MM_PER_UNIT, RANGES


def valid(key: Column, value: Column) -> Column:
    """Whether a value, as JSON text, may be kept under its key. Numbers as texts are no numbers."""
    number = F.when(value.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?$"), value.try_cast("double"))
    text = F.when(value.rlike(r'^".*"$'), F.substring(value, F.lit(2), F.length(value) - 2))
    ok = F.lit(False)
    for name, (low, high) in RANGES.items():
        ok = F.when(key == name, number.between(low, high)).otherwise(ok)
    for name, choices in CHOICES.items():
        ok = F.when(key == name, text.isin(*choices)).otherwise(ok)
    ok = F.when(key.isin(*FLAGS), value.isin("true", "false")).otherwise(ok)
    ok = F.when(key == "upscale", number.isin(1.0, 2.0, 3.0, 4.0) | F.coalesce(text.isin("auto", "ultra"), F.lit(False))).otherwise(ok)
    ok = F.when(key == "physicalWidth", (number > 0) & (number <= 100_000)).otherwise(ok)
    ok = F.when(key == "knockoutColor", text.rlike("^#[0-9a-fA-F]{6}$")).otherwise(ok)
    ok = F.when(key == "preset", text.isNotNull()).otherwise(ok)
    return F.coalesce(ok, F.lit(False))


def sanitized(raw: DataFrame) -> DataFrame:
    """raw (key, value as JSON text, and others) without unknown keys and invalid values."""
    return raw.where(valid(F.col("key"), F.col("value")))


def entries(json: DataFrame, column: str = "settings") -> DataFrame:
    """A column of JSON objects as rows (key, value as JSON text); what is no object gives none."""
    other = [c for c in json.columns if c != column]
    keys = F.json_object_keys(F.col(column))
    rows = json.where(F.col(column).rlike(r"^\s*\{")).select(*other, column, F.explode(keys).alias("key"))
    variant = F.try_parse_json(F.col(column))
    raw = F.to_json(F.try_variant_get(variant, F.concat(F.lit("$['"), F.col("key"), F.lit("']")), "variant"))
    return rows.select(*other, "key", raw.alias("value"))


def resolved(explicit: DataFrame, presets: DataFrame) -> DataFrame:
    """explicit (preset, colors, speckle, layer_diff; null: not set) -> the three as they hold: explicit, else of the preset, else the default."""
    p = presets.select(F.col("colors").alias("preset"), F.col("colors").alias("pc"), F.col("speckle").alias("ps"), F.col("layer_diff").alias("pl"))
    rows = explicit.join(F.broadcast(p), "preset", "left")
    pick = lambda c, q, k: F.coalesce(F.col(c), F.col(q), F.lit(int(DEFAULTS[k]))).cast("int").alias(c)
    keep = [c for c in explicit.columns if c not in ("colors", "speckle", "layer_diff")]
    return rows.select(*keep, pick("colors", "pc", "colors"), pick("speckle", "ps", "speckle"), pick("layer_diff", "pl", "layerDiff"))


def applied_profile(settings: DataFrame, profiles: DataFrame) -> DataFrame:
    """settings (..., profile) with a profile's values: all settings go back to their defaults first, so what a profile leaves open is the default."""
    rows = settings.join(F.broadcast(profiles), F.col("profile") == F.col("name"))
    keep = settings.columns
    default = {"splice": int(DEFAULTS["spliceThreshold"]), "ink": DEFAULTS["stencilInk"]}
    names = ("colors", "speckle", "layer_diff", "mode", "corner", "precision", "splice", "upscale", "straighten", "minify", "stencil", "ink")
    return rows.select(*keep, *[(F.coalesce(c, F.lit(default[c])) if c in default else F.col(c)).alias(c) for c in names], F.lit(int(DEFAULTS["fuzz"])).alias("fuzz"), F.lit(int(DEFAULTS["stencilThreshold"])).alias("stencil_threshold"))


def applied_preset(settings: DataFrame, presets: DataFrame) -> DataFrame:
    """settings (preset, colors, speckle, layer_diff, ...) with the preset's three values; an unknown preset changes nothing."""
    p = presets.select(F.col("colors").alias("preset"), F.col("colors").alias("pc"), F.col("speckle").alias("ps"), F.col("layer_diff").alias("pl"))
    rows = settings.join(F.broadcast(p), "preset", "left")
    new = {"colors": "pc", "speckle": "ps", "layer_diff": "pl"}
    return rows.select(*[F.coalesce(new[c], c).alias(c) if c in new else F.col(c) for c in settings.columns])


def knockout_target(rgb: list[Column], grayscale: Column, stencil: Column) -> list[Column]:
    """A custom colour as the processed pixels have it: grey where they are."""
    v = luma(*rgb)
    return [F.when(grayscale | stencil, v).otherwise(c) for c in rgb]


def converted(value: Column, old: Column, new: Column) -> Column:
    per = F.create_map(*[F.lit(x) for kv in MM_PER_UNIT.items() for x in kv])
    return value * per[old] / per[new]


def measured(value: Column, old: Column, new: Column) -> Column:
    """A width in its new unit, three decimals for inches and two for the others; pixels leave it as it is."""
    v = converted(value, old, new)
    places = lambda k: half_up(v * k) / k
    return F.when((new == "px") | (old == new) | ~(value > 0), value).when(new == "in", places(1000.0)).otherwise(places(100.0))


def crisp_corner(crisp: Column) -> Column:
    return F.when(crisp, 30).otherwise(60)


def notes(traced_w: Column, traced_h: Column, source_w: Column, source_h: Column, upscale: Column, paths: Column) -> tuple[Column, Column]:
    """Whether the trace ran below the size asked for, and whether it has many paths."""
    return F.greatest(traced_w, traced_h) < upscale * F.greatest(source_w, source_h), paths > 1000

