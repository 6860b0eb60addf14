"""Rounding rules and number texts."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .udfs import vectorized


def half_up(c: Column) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(c + F.lit(0.5))


def half_even(c: Column) -> Column:
    """What a clamped byte keeps of c."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.bround(c, 0))).cast("int")


def fixed(x: float, places: int) -> str:
    """x with that many decimals, the exact binary value rounded, halves away from zero."""
    return str(Decimal(x).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) if abs(x) < 1e21 else shortest(x)


def shortest(x: float) -> str:
    """The shortest text that reads back as x, whole numbers without a point."""
    if x == 0:
        return "0"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    text = repr(x)
    if "e" not in text:
        return text
    if 1e-6 <= abs(x) < 1e21:
        return format(Decimal(text), "f")
    digits, exponent = text.split("e")
    return f"{digits}e{'-' if exponent[0] == '-' else '+'}{exponent.lstrip('+-').lstrip('0')}"


def trimmed(x: float, places: int = 4) -> str:
    """x with up to that many decimals."""
    return shortest(float(fixed(x, places)))


def compact(x: float) -> str:
    """x with up to four decimals, no zero before the point, no minus zero."""
    text = fixed(x, 4).rstrip("0").rstrip(".")
    text = "0" if text in ("-0", "") else text
    return text.replace("0.", ".", 1) if text.startswith("0.") else text.replace("-0.", "-.", 1) if text.startswith("-0.") else text


@vectorized("string")
def compact_text(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else compact(float(v)))


@vectorized("string")
def trimmed_text(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else trimmed(float(v)))
