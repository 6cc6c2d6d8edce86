"""Session with the settings that results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def forecast_session(app: str = "gridcast", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``settings`` use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    for key, value in (fixed | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
