"""A data source for array files: one ``.npz`` per (run, variable, lead, member) as rows of nodes.

Registered as ``gridfield``; another forecast centre plugs in by a subclass
that overrides ``decode``.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "source_code string, units string, lead_time_hours int, member int, row int, col int, latitude double, longitude double, value double"


class FieldFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class FieldReader(DataSourceReader):
    def __init__(self, options: dict, decode) -> None:  # noqa: ANN001
        self.path, self.decode = options["path"], decode

    def partitions(self) -> list[FieldFile]:
        names = [self.path] if os.path.isfile(self.path) else sorted(glob.glob(os.path.join(self.path, "**", "*.npz"), recursive=True))
        return [FieldFile(n) for n in names]

    def read(self, partition: FieldFile) -> Iterator[pa.RecordBatch]:
        yield self.decode(partition.value)


def decode_npz(path: str) -> pa.RecordBatch:
    """Arrays ``latitude, longitude, value`` and scalars ``source_code, units, lead``, ``member`` (-1: none); NaN is left out."""
    import numpy as np

    with np.load(path, allow_pickle=False) as f:
        lat, lon, value = f["latitude"].astype(float), f["longitude"].astype(float), f["value"].astype(float)
        code, units, lead, member = str(f["source_code"]), str(f["units"]), int(f["lead"]), int(f["member"]) if "member" in f else -1
    if lat[0] > lat[-1]:
        lat, value = lat[::-1], value[::-1]
    row, col = np.nonzero(~np.isnan(value))
    n = len(row)
    return pa.RecordBatch.from_arrays(
        [pa.array([code] * n, pa.string()), pa.array([units] * n, pa.string()), pa.array(np.full(n, lead, np.int32)), pa.array([None if member < 0 else member] * n, pa.int32()), pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(lat[row]), pa.array(lon[col]), pa.array(value[row, col])],
        ["source_code", "units", "lead_time_hours", "member", "row", "col", "latitude", "longitude", "value"],
    )


class FieldSource(DataSource):
    decode = staticmethod(decode_npz)

    @classmethod
    def name(cls) -> str:
        return "gridfield"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FieldReader:  # noqa: ANN001
        return FieldReader(self.options, self.decode)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FieldSource)
