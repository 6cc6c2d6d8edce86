"""Forecasts against observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..functions.geo import Grid
from ..functions.keys import valid_time
from .ensemble import strict
from .interp import bilinear


def metrics(pairs: DataFrame, keys: Sequence[str] = (), observed: str = "observed", forecast: str = "forecast") -> DataFrame:
    """Bias (forecast minus observed), MAE, RMSE and count of the pairs of each group; values that aren't finite raise."""
    error = strict(F.col(forecast)) - strict(F.col(observed))
    return pairs.withColumn("__e", error).groupBy(*keys).agg(F.avg("__e").alias("bias"), F.avg(F.abs("__e")).alias("mae"), F.sqrt(F.avg(F.pow("__e", F.lit(2.0)))).alias("rmse"), F.count(F.lit(1)).alias("pairs"))


def window(observations: DataFrame, start: str, end: str, time: str = "valid_time") -> DataFrame:
    """Observations from the day ``start`` to the day ``end``, both included."""
    if end < start:
        raise InvalidInput("the window ends before it starts")
    return observations.where((F.col(time) >= F.lit(start).cast("date")) & (F.col(time) < F.date_add(F.lit(end).cast("date"), 1)))


def report(observations: DataFrame, stations: DataFrame, products: DataFrame, field: DataFrame, grid: Grid, start: str, end: str) -> DataFrame:
    """Pooled metrics by variable.

    ``products`` has ``run_id, cycle_time, variable_code, lead_time_hours`` of
    ready runs, ``field`` the nodes by run, variable and lead.  Every product that is
    valid at an observation's time pairs with it: an equi-join on the derived
    valid time.  Stations that are unknown or outside the grid drop out.
    """
    seen = window(observations, start, end).join(stations.select(F.col("station_code").alias("station_id"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude")), "station_id")
    due = products.select("run_id", "variable_code", "lead_time_hours", valid_time(F.col("cycle_time"), F.col("lead_time_hours")).alias("valid_time"))
    asked = seen.join(due, ["variable_code", "valid_time"]).select("id", "run_id", "variable_code", "lead_time_hours", "latitude", "longitude", "observed_value")
    places = asked.select("id", "latitude", "longitude").distinct()
    sampled = bilinear(places, field, grid, ["id"], by=["run_id", "variable_code", "lead_time_hours"])
    pairs = asked.join(sampled, ["id", "run_id", "variable_code", "lead_time_hours"]).where(F.col("value").isNotNull())
    return metrics(pairs.select("variable_code", F.col("observed_value").alias("observed"), F.col("value").alias("forecast")), ["variable_code"])


def flat_report(by_variable: DataFrame) -> DataFrame:
    """One row with a map ``<variable>_<metric>``; an empty map without pairs."""
    entries = F.array(*[F.struct(F.concat("variable_code", F.lit(f"_{m}")).alias("key"), F.col(m).alias("value")) for m in ("bias", "mae", "rmse")])
    return by_variable.select(F.explode(entries).alias("e")).agg(F.map_from_entries(F.sort_array(F.collect_list("e"))).alias("metrics"))
