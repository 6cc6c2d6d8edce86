"""Schemas of the catalog and of gridded data.

A gridded value is one row; a missing one is an absent row, never NaN.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "double": T.DoubleType(), "timestamp": T.TimestampType()}


def _struct(text: str) -> T.StructType:
    """From ``name type, ...``; needs no session, unlike Spark's own parser."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (part.split() for part in text.split(","))])


TABLES: dict[str, T.StructType] = {
    "forecast_centers": _struct("id string, center_id string, name string, country string, created_at timestamp"),
    "models": _struct("id string, model_id string, name string, center_id string, is_ensemble boolean, resolution_km double, created_at timestamp"),
    "model_versions": _struct("id string, model_id string, version_string string, created_at timestamp"),
    "model_runs": _struct("id string, model_version_id string, cycle_time timestamp, status string, zarr_store_path string, created_at timestamp"),
    "ensemble_members": _struct("id string, run_id string, member_index int, member_name string"),
    "ensemble_member_products": _struct("id string, run_id string, member_index int, lead_time_hours int"),
    "forecast_variables": _struct("id string, variable_code string, name string, unit string"),
    "forecast_grids": _struct("id string, grid_code string, name string, resolution_km double"),
    "forecast_products": _struct("id string, run_id string, variable_id string, grid_id string, product_type string, lead_time_hours int, zarr_chunk_path string"),
    "stations": _struct("id string, station_code string, name string, elevation_m double, lon double, lat double"),
    "cities": _struct("id string, city_name string, region string, country string, population int, lon double, lat double"),
    "ski_resorts": _struct("id string, resort_name string, region string, country string, summit_elevation_m double, lon double, lat double"),
    "verification_observations": _struct("id string, station_id string, variable_code string, valid_time timestamp, observed_value double"),
    "point_query_fallback_audit": _struct("cache_key string, query_params string, created_at timestamp, expires_at timestamp, fallback_reason string"),
    "grid_values": _struct("model_id string, cycle_time timestamp, variable_code string, member int, lead_time_hours int, row int, col int, latitude double, longitude double, value double"),
    "grid_geometry": _struct("grid_code string, lat_start double, lon_start double, lat_step double, lon_step double, rows int, cols int"),
}


def frame(spark: SparkSession, table: str, rows: list[dict]) -> DataFrame:
    """A DataFrame of one of the schemas; keys left out are null."""
    schema = TABLES[table]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)
