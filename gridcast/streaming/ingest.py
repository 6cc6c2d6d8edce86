"""Region files in any order: a file stream that patches a store.

Arrivals may be late or come twice; a patch replaces its own region only, so no watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import TABLES
from ..sinks.store import patch


def region_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Rows of the files of a folder, with the time of their file as ``arrived``."""
    rows = spark.readStream.schema(TABLES["grid_values"]).option("maxFilesPerTrigger", max_files).parquet(folder)
    return rows.select("*", F.col("_metadata.file_modification_time").alias("arrived"))


def newest_rows(batch: DataFrame) -> DataFrame:
    """Of each node of each region the row that arrived last, of equal times the one with the greater value."""
    keys = ["variable_code", "lead_time_hours", "member", "row", "col"]
    rest = [c for c in batch.columns if c not in (*keys, "arrived")]
    last = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("arrived", "value")).alias("__last"))
    return last.select(*[F.col(f"__last.{c}") if c in rest else F.col(c) for c in batch.columns if c != "arrived"])


def patch_store(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch becomes a patch of its regions; the newest row wins within a batch."""

    def apply(batch: DataFrame, _: int) -> None:
        patch(newest_rows(batch), path)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
