"""What a request asks for and how an answer is shown: parsing, places, options, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput
from .keys import coordinate_label

#: Variables that have a name and a unit even where the catalog lacks them.
KNOWN_VARIABLES = (("temperature_2m", "Temperature (2 m)", "°C"), ("precipitation_rate", "Precipitation Rate", "mm/h"))


def parse_list(text: str | None) -> list[str] | None:
    """Parts between commas without blanks; None where nothing was asked for."""
    return None if text is None or not text.strip() else [p for p in (part.strip() for part in text.split(",")) if p]


def parse_model(text: str) -> str:
    """Exactly one model."""
    found = parse_list(text) or []
    if len(found) != 1:
        raise InvalidInput(f"{text!r} names {len(found)} models, not one")
    return found[0]


def split_list(text: Column) -> Column:
    """``parse_list`` of a column."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def check_index(row: int, col: int, rows: int, cols: int) -> None:
    if not (0 <= row < rows and 0 <= col < cols):
        raise InvalidInput(f"node {row}, {col} lies beyond {rows} x {cols}")


def location(kind: Column, key: Column, place: Column) -> tuple[Column, Column, Column]:
    """Of a search result: kind of location, its id and how a forecast is asked for."""
    known = kind.isin("city", "ski_resort")
    shown = F.when(known, kind).when(kind == "place", "coordinates").otherwise("station")
    via = F.when(kind == "city", "city").when(kind == "ski_resort", "resort").otherwise("coordinates")
    return shown, F.when(kind == "place", place).otherwise(key), via


def coordinates_location(latitude: Column, longitude: Column) -> Column:
    """A place that was picked on the map."""
    return F.struct(coordinate_label(latitude, longitude).alias("name"), F.lit("coordinates").alias("object"), latitude.alias("latitude"), longitude.alias("longitude"), F.lit(None).cast("string").alias("id"), F.lit("coordinates").alias("resolved_via"))


def specifier(kind: Column, key: Column, latitude: Column, longitude: Column) -> Column:
    """``city_id=``, ``resort_id=`` or the coordinates, as a request has them."""
    pair = F.concat(F.lit("lat="), latitude.cast("string"), F.lit("&lon="), longitude.cast("string"))
    return F.when((kind == "city") & key.isNotNull(), F.concat(F.lit("city_id="), key)).when((kind == "ski_resort") & key.isNotNull(), F.concat(F.lit("resort_id="), key)).otherwise(pair)


def type_label(kind: Column) -> Column:
    return F.when(kind == "city", "City").when(kind == "ski_resort", "Ski resort").when(kind == "station", "Station").otherwise("Coordinates")


def variable_meta(variables: DataFrame) -> DataFrame:
    """``(variable_code, name, unit)`` of the catalog, and of known variables that it lacks."""
    have = variables.select("variable_code", "name", "unit")
    known = variables.sparkSession.createDataFrame(KNOWN_VARIABLES, "variable_code string, name string, unit string")
    return have.unionByName(known.join(have, "variable_code", "left_anti"))


def compact_json(*columns: str) -> Column:
    """An object of the columns; those that are null are left out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def options(available: DataFrame, model: str | None = None, variable: str | None = None, cycle: object = None) -> DataFrame:
    """What can be chosen after a model, a variable and a cycle: one row ``(models, variables, cycles, leads)``.

    ``available`` is ``catalog.availability``; a level below one that isn't there, or not chosen, is empty.
    """
    none = lambda kind: F.array().cast(kind)
    kind = available.schema["variables"].dataType
    cycles = kind.elementType["initial_times"].dataType
    of = available.where(F.col("model_id") == F.lit(model)).select("variables") if model is not None else available.limit(0).select("variables")
    ids = available.agg(F.array_sort(F.collect_set("model_id")).alias("models"))
    row = ids.join(of, F.lit(True), "left").withColumn("variables", F.coalesce("variables", none(kind)))
    chosen = F.filter("variables", lambda v: v.variable_code == F.lit(variable).cast("string"))
    row = row.withColumn("cycles", F.coalesce(F.get(chosen, F.lit(0)).initial_times, none(cycles)))
    time = F.filter("cycles", lambda c: c.cycle_time == F.lit(cycle).cast(cycles.elementType["cycle_time"].dataType))
    return row.select("models", F.transform("variables", lambda v: v.variable_code).alias("variables"), F.transform("cycles", lambda c: c.cycle_time).alias("cycles"), F.coalesce(F.get(time, F.lit(0)).lead_times, none(cycles.elementType["lead_times"].dataType)).alias("leads"))


def defaults(available: DataFrame) -> DataFrame:
    """For each model its first variable, that one's newest cycle, and the first lead of it; null where there is none."""
    first = F.get("variables", F.lit(0))
    cycle = F.get(first.initial_times, F.lit(0))
    return available.select("model_id", first.variable_code.alias("variable_code"), cycle.cycle_time.alias("cycle_time"), F.get(cycle.lead_times, F.lit(0)).alias("lead_time_hours"))


def suggestion(place: Column, main: Column, second: Column) -> Column:
    """A place that was suggested; its coordinates are 0 until it is resolved."""
    return F.struct(F.concat(F.lit("place_"), place).alias("id"), F.lit("place").alias("object"), main.alias("name"), second.alias("region"), F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"), place.alias("place_id"))


def component(parts: Column, wanted: str) -> Column:
    """Text of the first address part ``struct(types, long, short)`` of a type."""
    hit = F.get(F.filter(parts, lambda p: F.array_contains(p.types, wanted)), F.lit(0))
    return F.coalesce(F.nullif(hit.long, F.lit("")), hit.short)


def context(parts: Column, wanted: str) -> Column:
    """Text of the first context ``struct(id, text)`` whose id names the kind."""
    return F.get(F.filter(parts, lambda p: F.contains(p.id, F.lit(wanted))), F.lit(0)).text


def no_elevation() -> Column:
    """Where there is no elevation model."""
    return F.lit(None).cast("double")
