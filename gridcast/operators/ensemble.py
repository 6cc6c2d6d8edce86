"""Statistics and exceedance probabilities over ensemble members, one grouped pass each."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput, InvalidMembers

#: Two-sided 95 % quantile of the normal distribution.
Z95 = 1.959963984540054
PERCENTILES = (10, 25, 50, 75, 90)


def _number(name: str, value: float) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise InvalidInput(f"{name} is {value!r}, not a finite number")
    return float(value)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value.cast("double")) & (F.abs(value.cast("double")) != F.lit(float("inf")))


def strict(value: Column) -> Column:
    """The value; null, NaN and infinity raise, for a statistic over them would be wrong in silence."""
    return F.when(finite(value), value.cast("double")).otherwise(F.raise_error(F.lit("a member is not finite")).cast("double"))


def check_members(df: DataFrame, keys: Sequence[str], value: str = "value") -> None:
    """Raises ``InvalidMembers`` with the first group that has no finite member or one that isn't finite."""
    bad = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.count_if(finite(F.col(value))).alias("__ok")).where("__ok < __n or __ok = 0").take(1)
    if bad or (not keys and df.isEmpty()):
        raise InvalidMembers(f"members of {[bad[0][k] for k in keys] if bad else 'nothing'} are not finite")


def percentile(value: Column, q: float) -> Column:
    """Linear interpolation between closest ranks, q from 0 to 100."""
    q = _number("percentile", q)
    if not 0 <= q <= 100:
        raise InvalidInput(f"percentile {q} is not within 0 to 100")
    return F.percentile(value, F.lit(q / 100))


def statistics(df: DataFrame, keys: Sequence[str], value: str = "value", percentiles: Sequence[float] = PERCENTILES, member: str | None = None) -> DataFrame:
    """Mean, median, spread (population), percentiles and member count of each group; with ``member`` also the values in member order."""
    v = strict(F.col(value))
    qs = [_number("percentile", q) for q in percentiles]
    if any(not 0 <= q <= 100 for q in qs):
        raise InvalidInput("percentiles lie within 0 to 100")
    prepared = df.withColumn("__v", v)
    aggregates = [F.avg("__v").alias("mean"), F.stddev_pop("__v").alias("spread"), F.percentile("__v", F.array(*[F.lit(q / 100) for q in [50, *qs]])).alias("__p"), F.count("__v").alias("member_count")]
    if member:
        aggregates.append(F.sort_array(F.collect_list(F.struct(F.col(member).alias("m"), F.col("__v").alias("v")))).alias("__m"))
    out = prepared.groupBy(*keys).agg(*aggregates)
    shown = [*keys, "mean", F.col("__p")[0].alias("median"), "spread", *[F.col("__p")[k + 1].alias(f"p{q:g}") for k, q in enumerate(qs)], "member_count"]
    return out.select(*shown, *([F.col("__m.v").alias("members")] if member else []))


def condition(value: Column, operator: str, threshold: float, upper: float | None = None) -> Column:
    """``gt`` and ``lt`` are strict, ``between`` takes both ends."""
    low = _number("threshold", threshold)
    if operator == "between":
        if upper is None:
            raise InvalidInput("between needs an upper threshold")
        high = _number("upper threshold", upper)
        if high < low:
            raise InvalidInput("the upper threshold lies below the lower one")
        return value.between(low, high)
    if upper is not None:
        raise InvalidInput("only between has an upper threshold")
    if operator == "gt":
        return value > low
    if operator == "lt":
        return value < low
    raise InvalidInput(f"operator {operator!r} is none of gt, lt, between")


def wilson(p: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Two-sided Wilson interval of a proportion p of n, within 0 to 1."""
    level = _number("confidence", confidence)
    if not 0 < level < 1:
        raise InvalidInput("a confidence lies between 0 and 1")
    z = NormalDist().inv_cdf((1 + level) / 2)
    scale = 1 + F.lit(z * z) / n
    centre = (p + F.lit(z * z) / (2 * n)) / scale
    half = F.lit(z) / scale * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n))
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def interval(low: Column, high: Column) -> Column:
    """An interval as an array of two."""
    return F.array(low, high)


def probability(df: DataFrame, keys: Sequence[str], operator: str, threshold: float, upper: float | None = None, value: str = "value", confidence: float = 0.95) -> DataFrame:
    """Share of members that meet the condition, its interval (two columns and ``ci``) and the member count of each group."""
    met = condition(strict(F.col(value)), operator, threshold, upper)
    out = df.groupBy(*keys).agg(F.avg(met.cast("double")).alias("probability"), F.count(F.lit(1)).alias("member_count"))
    low, high = wilson(F.col("probability"), F.col("member_count").cast("double"), confidence)
    return out.withColumns({"ci_low": low, "ci_high": high, "ci": interval(low, high)})


def histogram(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Equal bins by Sturges' rule; the last bin is closed, empty bins have count 0, equal values one bin.

    Not finite values are left out.  ``(keys, bin, bin_low, bin_high, count)``.
    """
    rows = df.where(finite(F.col(value))).select(*keys, F.col(value).cast("double").alias("__v"))
    span = rows.groupBy(*keys).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.count(F.lit(1)).alias("__n"))
    span = span.withColumn("__bins", F.when(F.col("__low") == F.col("__high"), 1).otherwise(F.ceil(F.log2("__n")).cast("int") + 1))
    span = span.withColumn("__width", (F.col("__high") - F.col("__low")) / F.col("__bins"))
    place = F.when(F.col("__width") > 0, F.least(F.col("__bins") - 1, F.floor((F.col("__v") - F.col("__low")) / F.col("__width")).cast("int"))).otherwise(0)
    counts = rows.join(span, list(keys)).groupBy(*keys, place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    bins = span.select(*keys, "__low", "__width", F.explode(F.sequence(F.lit(0), F.col("__bins") - 1)).alias("bin"))
    out = bins.join(counts, [*keys, "bin"], "left")
    return out.select(*keys, "bin", (F.col("__low") + F.col("bin") * F.col("__width")).alias("bin_low"), (F.col("__low") + (F.col("bin") + 1) * F.col("__width")).alias("bin_high"), F.coalesce("count", F.lit(0)).alias("count"))


def distribution(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Count, extremes, mean, median and spread of the finite values."""
    v = F.col(value).cast("double")
    return df.where(finite(F.col(value))).groupBy(*keys).agg(F.count(v).alias("count"), F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("std_dev"))


def statistics_entries(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, place, name, value)`` in the order in which statistics are shown."""
    names = [n for n in ("mean", "median", "spread", *(f"p{q}" for q in PERCENTILES)) if n in stats.columns]
    entries = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])
    return stats.select(*keys, F.posexplode(entries).alias("place", "e")).select(*keys, "place", "e.name", "e.value")


def fan_bands(stats: DataFrame) -> DataFrame:
    """Stacked bands of a fan chart: bases and heights from the percentiles of ``statistics``."""
    return stats.withColumns({"outer_base": F.col("p10"), "outer_height": F.col("p90") - F.col("p10"), "inner_base": F.col("p25"), "inner_height": F.col("p75") - F.col("p25")})


def member_dots(df: DataFrame, keys: Sequence[str], members: str) -> DataFrame:
    """(index, value) of the finite members of an array; the index is that in the array."""
    return df.select(*keys, F.posexplode(members).alias("member", "value")).where(finite(F.col("value")))
