"""Point series stitched across overlapping cycles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidInput, NotFound
from ..functions.geo import Grid, check_coordinates
from ..functions.keys import iso_z, valid_time
from ..functions.units import imperial_unit, to_imperial
from .catalog import model_runs, ready
from .ensemble import finite
from .interp import bilinear, check_inside


def lead_window(df: DataFrame, start: int | None = None, end: int | None = None, lead: str = "lead_time_hours") -> DataFrame:
    """Rows with leads from start to end, both included."""
    if start is not None and end is not None and end < start:
        raise InvalidInput("the lead window ends before it starts")
    if start is not None:
        df = df.where(F.col(lead) >= start)
    return df if end is None else df.where(F.col(lead) <= end)


def shortest_lead(candidates: DataFrame, keys: Sequence[str], lead: str = "lead_time_hours", newest: str = "cycle_time", ties: Sequence[str] = ()) -> DataFrame:
    """Of each group (model and valid time) the row of shortest lead, then newest cycle, then the least ``ties``."""
    order = Window.partitionBy(*keys).orderBy(F.asc(lead), F.desc(newest), *[F.asc(t) for t in ties])
    return candidates.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def newest(df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str] = (), pinned: object = None) -> DataFrame:
    """The newest row of each group, or that of the pinned time."""
    if pinned is not None:
        df = df.where(F.col(time) == F.lit(pinned))
    order = Window.partitionBy(*keys).orderBy(F.desc(time), *[F.asc(t) for t in ties])
    return df.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def candidates(runs: DataFrame, versions: DataFrame, models: DataFrame, products: DataFrame, stored: DataFrame, model_id: str) -> DataFrame:
    """(run_id, model_id, cycle_time, lead_time_hours, valid_time) that ready runs offer and the store really has.

    ``stored`` holds the committed ``(run_id, lead_time_hours)``; leads of cycles without any
    product row come from it alone.
    """
    open_runs = model_runs(ready(runs), versions, models).where(F.col("model_id") == model_id).select("run_id", "model_id", "cycle_time")
    listed = open_runs.join(products.select("run_id", "lead_time_hours").distinct(), "run_id")
    unlisted = open_runs.join(products.select("run_id"), "run_id", "left_anti").join(stored.select("run_id", "lead_time_hours").distinct(), "run_id")
    both = listed.unionByName(unlisted).join(stored.select("run_id", "lead_time_hours"), ["run_id", "lead_time_hours"], "left_semi")
    return both.withColumn("valid_time", valid_time(F.col("cycle_time"), F.col("lead_time_hours")))


def point_forecast(
    points: DataFrame, field: DataFrame, grid: Grid, offers: DataFrame, variables: DataFrame, keys: Sequence[str], start: int | None = None, end: int | None = None, imperial: bool = False
) -> DataFrame:
    """Values at points by valid time: ``(keys, valid_time, cycle_time, lead_time_hours, variable_code, unit, value)``.

    ``offers`` are ``candidates``; the lead window applies before the shortest lead is chosen.
    A point outside the grid raises ``OutsideGrid``.
    """
    check_inside(points, grid)
    chosen = shortest_lead(lead_window(offers, start, end), ["model_id", "valid_time"])
    used = field.join(chosen.select("run_id", "lead_time_hours"), ["run_id", "lead_time_hours"], "left_semi")
    sampled = bilinear(points, used, grid, keys, by=["run_id", "variable_code", "lead_time_hours"])
    out = sampled.join(chosen, ["run_id", "lead_time_hours"]).join(variables.select("variable_code", "unit"), "variable_code")
    if imperial:
        out = out.withColumns({"value": to_imperial(F.col("value"), F.col("unit")), "unit": imperial_unit(F.col("unit"))})
    return out.select(*keys, "valid_time", "cycle_time", "lead_time_hours", "variable_code", "unit", "value").orderBy(*keys, "valid_time", "variable_code")


def generated_at(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The newest cycle that a forecast draws on."""
    return df.groupBy(*keys).agg(F.max("cycle_time").alias("generated_at"))


def lead_times(df: DataFrame) -> DataFrame:
    """Distinct leads, ascending; a row without one counts as lead 0."""
    return df.select(F.coalesce("lead_time_hours", F.lit(0)).cast("int").alias("lead_time_hours")).distinct().orderBy("lead_time_hours")


def lead_index(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Leads with their places on the ascending axis of each group, from 0."""
    axis = df.select(*keys, "lead_time_hours").distinct()
    return axis.withColumn("index", F.row_number().over(Window.partitionBy(*keys).orderBy("lead_time_hours")) - 1)


def variable_codes(df: DataFrame) -> DataFrame:
    return df.select("variable_code").distinct().orderBy("variable_code")


def resolve_location(cities: DataFrame, resorts: DataFrame, *, resort_id: str | None = None, city_id: str | None = None, lon: float | None = None, lat: float | None = None) -> tuple[float, float]:
    """Latitude and longitude of exactly one of: a coordinate, a city, a resort."""
    if (lat is None) != (lon is None) or sum(x is not None for x in (lat, city_id, resort_id)) != 1:
        raise InvalidInput("give a latitude and longitude, or a city, or a resort")
    if lat is not None:
        check_coordinates(lat, lon)
        return lat, lon
    table, key = (cities, city_id) if city_id is not None else (resorts, resort_id)
    rows = table.where(F.col("id") == key).select("lat", "lon").take(1)
    if not rows:
        raise NotFound(f"no place {key!r}")
    return rows[0].lat, rows[0].lon


def meteogram(df: DataFrame, keys: Sequence[str], time: str = "valid_time", value: str = "value") -> DataFrame:
    """The series in time order; values that aren't finite become null."""
    return df.select(*keys, time, F.when(finite(F.col(value)), F.col(value)).alias(value)).orderBy(*keys, time)


def rendered(df: DataFrame, *times: str) -> DataFrame:
    """Timestamps as ISO-8601 text in UTC."""
    return df.withColumns({t: iso_z(F.col(t)) for t in times})
