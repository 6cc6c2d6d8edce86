"""Unit conversion by tables of Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: unit: (imperial unit, conversion)
IMPERIAL: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "km/h": ("mph", lambda kmh: kmh * 0.621371),
    "mm/h": ("in/h", lambda mmh: mmh / 25.4),
    "°C": ("°F", lambda celsius: celsius * 9 / 5 + 32),
}

#: (normalised source unit, canonical unit): conversion
CANONICAL: dict[tuple[str, str], Callable[[Column], Column]] = {
    ("k", "°c"): lambda v: v - 273.15,
    ("kgm-2s-1", "mm/h"): lambda v: v * 3600,
}


def unit_token(unit: Column) -> Column:
    """Spelling variants of a unit made equal: no spaces, no power signs, lower case."""
    return F.lower(F.replace(F.replace(F.replace(unit, F.lit(" "), F.lit("")), F.lit("**"), F.lit("")), F.lit("^"), F.lit("")))


def to_imperial(value: Column, unit: Column) -> Column:
    """Units without an imperial counterpart pass through."""
    out = F.when(F.lit(False), value)
    for metric, (_, convert) in IMPERIAL.items():
        out = out.when(unit == metric, convert(value))
    return out.otherwise(value)


def imperial_unit(unit: Column) -> Column:
    out = F.when(F.lit(False), unit)
    for metric, (name, _) in IMPERIAL.items():
        out = out.when(unit == metric, F.lit(name))
    return out.otherwise(unit)


def to_canonical(value: Column, source: Column, target: Column) -> Column:
    """An absent source unit or an equal one changes nothing; an unknown pair raises."""
    have, want = unit_token(source), unit_token(target)
    out = F.when(source.isNull() | (have == want), value)
    for (a, b), convert in CANONICAL.items():
        out = out.when((have == a) & (want == b), convert(value))
    return out.otherwise(F.raise_error(F.concat(F.lit("no conversion from "), source, F.lit(" to "), target)).cast("double"))
