"""Coordinates and regular grids as Column arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidCoordinates, InvalidGrid

#: Degrees by which a point may lie outside a grid and still belong to it.
TOLERANCE = 1e-9
EARTH_RADIUS_KM = 6371.0088


def check_coordinates(latitude: float, longitude: float) -> None:
    for name, value, bound in (("latitude", latitude, 90), ("longitude", longitude, 180)):
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or abs(value) > bound:
            raise InvalidCoordinates(f"{name} {value!r} is not a number from -{bound} to {bound}")


def valid_coordinates(latitude: Column, longitude: Column) -> Column:
    """Null and NaN are invalid."""
    return F.coalesce(latitude.between(-90, 90) & longitude.between(-180, 180), F.lit(False))


def normalize_longitude(longitude: Column) -> Column:
    """Into the closed interval -180 to 180; positive multiples end at +180."""
    turned = F.pmod(longitude + 180, F.lit(360.0)) - 180
    return F.when((turned == -180) & (longitude > 0), F.lit(180.0)).otherwise(turned)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    h = F.greatest(F.lit(0.0), F.least(F.lit(1.0), h))
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


@dataclass(frozen=True)
class Grid:
    """A regular grid; its numbers may be Columns, so one row can carry its own grid."""

    lat_start: float | Column
    lon_start: float | Column
    lat_step: float | Column
    lon_step: float | Column
    rows: int | Column
    cols: int | Column

    def __post_init__(self) -> None:
        numbers = [x for x in (self.lat_start, self.lon_start, self.lat_step, self.lon_step) if not isinstance(x, Column)]
        steps = [x for x in (self.lat_step, self.lon_step) if not isinstance(x, Column)]
        sizes = [x for x in (self.rows, self.cols) if not isinstance(x, Column)]
        if not all(map(math.isfinite, numbers)) or any(x <= 0 for x in steps) or any(x < 1 for x in sizes):
            raise InvalidGrid("a grid has finite origins, positive steps and a node at least")

    @staticmethod
    def of_columns(prefix: str = "") -> Grid:
        return Grid(*(F.col(prefix + f.name) for f in fields(Grid)))

    @property
    def lat_stop(self):  # noqa: ANN201
        return (self.rows - 1) * self.lat_step + self.lat_start

    @property
    def lon_stop(self):  # noqa: ANN201
        return (self.cols - 1) * self.lon_step + self.lon_start

    def aligned(self, longitude: Column) -> Column:
        """The longitude in the grid's convention: west is 180 to 360 on a grid that passes 180."""
        turned = normalize_longitude(longitude)
        return F.when((F.lit(self.lon_stop) > 180) & (turned < 0), turned + 360).otherwise(turned)

    def contains(self, latitude: Column, longitude: Column) -> Column:
        east = self.aligned(longitude)
        return F.coalesce(
            (latitude >= self.lat_start - TOLERANCE) & (latitude <= self.lat_stop + TOLERANCE) & (east >= self.lon_start - TOLERANCE) & (east <= self.lon_stop + TOLERANCE), F.lit(False)
        )

    def position(self, latitude: Column, longitude: Column) -> tuple[Column, Column]:
        """Fractional row and column, clamped to the grid."""
        row = (latitude - self.lat_start) / self.lat_step
        col = (self.aligned(longitude) - self.lon_start) / self.lon_step
        clamp = lambda x, n: F.greatest(F.lit(0.0), F.least(F.lit(n - 1).cast("double"), x))
        return clamp(row, self.rows), clamp(col, self.cols)

    def nearest(self, latitude: Column, longitude: Column) -> tuple[Column, Column]:
        """Row and column of the nearest node, halves up."""
        row, col = self.position(latitude, longitude)
        last = lambda x, n: F.least(F.lit(n - 1).cast("int"), F.floor(x + 0.5).cast("int"))
        return last(row, self.rows), last(col, self.cols)

    def cell(self, latitude: Column, longitude: Column) -> tuple[Column, Column, Column, Column]:
        """Lower row and column of the cell around a point, and the weights of the upper ones."""
        row, col = self.position(latitude, longitude)
        low = lambda x, n: F.greatest(F.lit(0), F.least(F.floor(x).cast("int"), F.lit(n - 2).cast("int")))
        r, c = low(row, self.rows), low(col, self.cols)
        return r, c, row - r, col - c

    def coordinate(self, row: Column, col: Column) -> tuple[Column, Column]:
        return self.lat_start + row * self.lat_step, self.lon_start + col * self.lon_step


def western_axis(longitude: Column, axis_minimum: Column) -> Column:
    """An axis that lies wholly beyond 180 degrees is shifted by -360."""
    return F.when(axis_minimum > 180, longitude - 360).otherwise(longitude)


def tile_longitude(pixel: Column, zoom: int) -> Column:
    return pixel / (256 * (1 << zoom)) * 360 - 180


def tile_latitude(pixel: Column, zoom: int) -> Column:
    """Inverse Web Mercator."""
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * pixel / (256 * (1 << zoom))))))
