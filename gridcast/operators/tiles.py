"""Web-Mercator tiles: pixels, nearest nodes, colours, images."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..functions.geo import Grid, tile_latitude, tile_longitude
from ..functions.keys import hex_colour
from ..sinks.png import encode

SIZE, MAX_ZOOM = 256, 9
#: Rows and columns of nodes that travel together to a tile.
BLOCK = 64
#: (value, red, green, blue), ascending
Stops = Sequence[tuple[float, int, int, int]]


@dataclass(frozen=True)
class Ramp:
    """Colours of a variable; values are drawn as if they lay from ``low`` to ``high``."""

    stops: Stops
    low: float
    high: float

    @staticmethod
    def of(values: Sequence[float], colours: str, low: float, high: float) -> Ramp:
        return Ramp(tuple((float(v), *bytes.fromhex(c)) for v, c in zip(values, colours.split())), low, high)


_TEMPERATURE = Ramp.of((-40, -20, -5, 5, 15, 25, 35, 45), "313695 4575b4 74add1 f0f9e8 fed976 fe9929 d94801 a50026", -40.0, 45.0)
_RAMPS = {"precipitation_rate": Ramp.of((0, 0.5, 1, 2.5, 5, 10, 20, 40), "ffffff c2e699 78c679 31a354 197278 314c8f 7b4173 542788", 0.0, 25.0)}


def ramp(variable_code: str) -> Ramp:
    """That of the variable; all but precipitation are drawn like temperature."""
    return _RAMPS.get(variable_code, _TEMPERATURE)


def check_tile(z: int, x: int, y: int) -> None:
    if any(isinstance(v, bool) or not isinstance(v, int) for v in (z, x, y)) or not 0 <= z <= MAX_ZOOM or not (0 <= x < 1 << z and 0 <= y < 1 << z):
        raise InvalidInput(f"no tile {z}/{x}/{y}")


def pixels(spark: SparkSession, z: int, x: int, y: int) -> DataFrame:
    """(px, py, longitude, latitude) of the pixel centres of a tile."""
    check_tile(z, x, y)
    cells = spark.range(SIZE * SIZE).select((F.col("id") % SIZE).cast("int").alias("px"), F.floor(F.col("id") / SIZE).cast("int").alias("py"))
    return cells.select("px", "py", tile_longitude(F.col("px") + x * SIZE + 0.5, z).alias("longitude"), tile_latitude(F.col("py") + y * SIZE + 0.5, z).alias("latitude"))


def pixels_of(asked: DataFrame) -> DataFrame:
    """``pixels`` of every row ``(z, x, y)`` of a table, in one plan; rows that are no tile drop out."""
    world = F.expr("shiftleft(1, z)")
    real = asked.where(F.col("z").between(0, MAX_ZOOM)).where((F.col("x") >= 0) & (F.col("x") < world) & (F.col("y") >= 0) & (F.col("y") < world)).select("z", "x", "y")
    lines = real.select("z", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(SIZE - 1))).alias("py"))
    cells = lines.repartition("z", "x", "y", "py").select("z", "x", "y", "py", F.explode(F.sequence(F.lit(0), F.lit(SIZE - 1))).alias("px"))
    total = SIZE * F.pow(F.lit(2.0), F.col("z"))
    lon = (F.col("px") + F.col("x") * SIZE + 0.5) / total * 360 - 180
    lat = F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * (F.col("py") + F.col("y") * SIZE + 0.5) / total))))
    return cells.select("z", "x", "y", "px", "py", lon.alias("longitude"), lat.alias("latitude"))


def render_many(asked: DataFrame, field: DataFrame, grid: Grid, colours: Ramp) -> DataFrame:
    """(z, x, y, px, py, r, g, b, a) of many tiles at once."""
    r, g, b, a = colour(F.col("value"), colours)
    return sample(pixels_of(asked), field, grid).select("z", "x", "y", "px", "py", r.alias("r"), g.alias("g"), b.alias("b"), a.alias("a"))


def _corners(z: int, x: int, y: int) -> tuple[np.ndarray, np.ndarray]:
    """Longitudes of the pixel columns and latitudes of the pixel rows."""
    total = SIZE * (1 << z)
    px = np.arange(SIZE) + 0.5
    return (px + x * SIZE) / total * 360 - 180, np.degrees(np.arctan(np.sinh(math.pi * (1 - 2 * (px + y * SIZE) / total))))


def _nodes(z: int, x: int, y: int, grid: Grid) -> tuple[np.ndarray, np.ndarray]:
    """Row of the nearest node of each pixel row and column of each pixel column; -1 outside the grid."""
    lon, lat = _corners(z, x, y)
    low, high = grid.lon_start, grid.lon_stop
    lon = np.where((lon < low) & (lon + 360 <= high), lon + 360, np.where((lon > high) & (lon - 360 >= low), lon - 360, lon))
    row, col = np.ceil((lat - grid.lat_start) / grid.lat_step - 0.5), np.ceil((lon - low) / grid.lon_step - 0.5)
    row[(lat < grid.lat_start) | (lat > grid.lat_stop)] = -1
    col[(lon < low) | (lon > high)] = -1
    return row.astype(int), col.astype(int)


def _painted(values: np.ndarray, colours: Ramp) -> np.ndarray:
    """RGBA bytes; NaN is transparent."""
    out = np.zeros((*values.shape, 4), np.uint8)
    some = np.isfinite(values)
    x = np.clip(values[some], colours.low, colours.high)
    stops = np.array(colours.stops, float)
    for k in (1, 2, 3):
        out[..., k - 1][some] = np.interp(x, stops[:, 0], stops[:, k]).astype(np.uint8)
    out[..., 3][some] = 255
    return out


def _blocks(asked: pd.DataFrame, grid: Grid) -> Iterator[tuple[int, int, int, int, int]]:
    """The blocks of nodes that each tile looks at; one that isn't there for a tile outside the grid."""
    for z, x, y in asked[["z", "x", "y"]].itertuples(index=False):
        row, col = (np.unique(v[v >= 0] // BLOCK) for v in _nodes(z, x, y, grid))
        if not len(row) or not len(col):
            yield z, x, y, -1, -1
        for r in row.tolist():
            for c in col.tolist():
                yield z, x, y, r, c


def images(asked: DataFrame, field: DataFrame, grid: Grid, colours: Ramp, value: str = "value") -> DataFrame:
    """(z, x, y, png) of every row ``(z, x, y)`` of a table; rows that are no tile drop out.

    Nodes travel in blocks to the tiles that look at them, and a scan of ``field`` is
    narrowed to the rows and columns that any tile needs.  Each tile is drawn by one
    vectorised pass.
    """
    world = F.expr("shiftleft(1, z)")
    real = asked.where(F.col("z").between(0, MAX_ZOOM) & F.col("x").between(0, world - 1) & F.col("y").between(0, world - 1)).select("z", "x", "y").distinct()

    def looked_at(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(list(_blocks(batch, grid)), columns=["z", "x", "y", "br", "bc"])

    wanted = real.mapInPandas(looked_at, "z int, x int, y int, br int, bc int")
    span = wanted.where("br >= 0").agg(F.min("br"), F.max("br"), F.min("bc"), F.max("bc")).first()
    nodes = field.where(between_blocks("row", span[0], span[1]) & between_blocks("col", span[2], span[3]))
    place = ((F.col("row") % BLOCK) * BLOCK + F.col("col") % BLOCK).cast("int")
    cells = nodes.groupBy(F.floor(F.col("row") / BLOCK).cast("int").alias("br"), F.floor(F.col("col") / BLOCK).cast("int").alias("bc")).agg(F.collect_list(F.struct(place.alias("at"), F.col(value).cast("double").alias("v"))).alias("cells"))
    met = wanted.join(cells.select("br", "bc", F.col("cells.at").alias("at"), F.col("cells.v").alias("v")), ["br", "bc"], "left")

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        z, x, y = (int(group[k].iloc[0]) for k in ("z", "x", "y"))
        row, col = _nodes(z, x, y, grid)
        canvas = np.zeros((SIZE, SIZE), np.uint32)
        for br, bc, at, v in group[["br", "bc", "at", "v"]].itertuples(index=False):
            if at is not None and br >= 0:  # nodes are painted, pixels only look them up
                block = np.full(BLOCK * BLOCK, np.nan)
                block[np.asarray(at)] = np.asarray(v, float)
                paint = _painted(block, colours).view(np.uint32).reshape(BLOCK, BLOCK)
                rows, cols = np.flatnonzero(row // BLOCK == br), np.flatnonzero(col // BLOCK == bc)
                canvas[np.ix_(rows, cols)] = paint[np.ix_(row[rows] % BLOCK, col[cols] % BLOCK)]
        return pd.DataFrame({"z": [z], "x": [x], "y": [y], "png": [encode(canvas.view(np.uint8).reshape(SIZE, SIZE, 4))]})

    return met.groupBy("z", "x", "y").applyInPandas(draw, "z int, x int, y int, png binary")


def between_blocks(column: str, low: int | None, high: int | None) -> Column:
    """Nodes of the blocks from low to high; none if there are no blocks."""
    return F.lit(False) if low is None else F.col(column).between(low * BLOCK, (high + 1) * BLOCK - 1)


def aligned(longitude: Column, grid: Grid) -> Column:
    """Turned by 360 degrees at most once in the direction of the grid."""
    low, high = F.lit(grid.lon_start), F.lit(grid.lon_stop)
    return F.when((longitude < low) & (longitude + 360 <= high), longitude + 360).when((longitude > high) & (longitude - 360 >= low), longitude - 360).otherwise(longitude)


def nearest_low(position: Column) -> Column:
    """The nearest index; ties go to the lower one."""
    return F.ceil(position - 0.5).cast("int")


def sample(pix: DataFrame, field: DataFrame, grid: Grid, value: str = "value") -> DataFrame:
    """Value of the nearest node of each pixel; null outside the grid and where the node is absent."""
    lon = aligned(F.col("longitude"), grid)
    inside = F.col("latitude").between(F.lit(grid.lat_start), F.lit(grid.lat_stop)) & lon.between(F.lit(grid.lon_start), F.lit(grid.lon_stop))
    row = F.when(inside, nearest_low((F.col("latitude") - grid.lat_start) / grid.lat_step))
    col = F.when(inside, nearest_low((lon - grid.lon_start) / grid.lon_step))
    placed = pix.withColumns({"row": row, "col": col})
    return placed.join(field.select("row", "col", F.col(value).alias("value")), ["row", "col"], "left")


def colour(value: Column, colours: Ramp) -> tuple[Column, Column, Column, Column]:
    """Red, green, blue, alpha: clamped to the range, linear between stops, truncated; no data is transparent."""
    stops = colours.stops
    held = F.greatest(F.lit(colours.low), F.least(F.lit(colours.high), value))
    present = value.isNotNull() & ~F.isnan(value)
    channels = []
    for k in (1, 2, 3):
        out = F.when(~present, F.lit(0)).when(held >= stops[-1][0], F.lit(stops[-1][k]))
        for low, high in reversed(list(zip(stops, stops[1:]))):
            out = out.when(held >= low[0], F.floor((held - low[0]) * F.lit((high[k] - low[k]) / (high[0] - low[0])) + low[k]).cast("int"))
        channels.append(out)
    return channels[0], channels[1], channels[2], F.when(present, 255).otherwise(0)


def slice_to_tile(field: DataFrame, grid: Grid, z: int, x: int, y: int) -> DataFrame:
    """The rows and columns of the field that a tile looks at, as ranges that reach the scan."""
    row, col = (v[v >= 0] for v in _nodes(z, x, y, grid))
    if not len(row) or not len(col):
        return field.where(F.lit(False))
    return field.where(F.col("row").between(int(row.min()), int(row.max())) & F.col("col").between(int(col.min()), int(col.max())))


def render(spark: SparkSession, field: DataFrame, grid: Grid, z: int, x: int, y: int, colours: Ramp) -> DataFrame:
    """(px, py, r, g, b, a) of a tile."""
    r, g, b, a = colour(F.col("value"), colours)
    return sample(pixels(spark, z, x, y), slice_to_tile(field, grid, z, x, y), grid).select("px", "py", r.alias("r"), g.alias("g"), b.alias("b"), a.alias("a"))


def legend(spark: SparkSession, variable_code: str) -> DataFrame:
    """(value, colour, position in percent) of the variable's stops."""
    stops = ramp(variable_code).stops
    rows = spark.createDataFrame([tuple(s) for s in stops], "value double, r int, g int, b int")
    first, span = stops[0][0], stops[-1][0] - stops[0][0]
    return rows.select("value", hex_colour(F.col("r"), F.col("g"), F.col("b")).alias("colour"), ((F.col("value") - first) / span * 100).alias("position"))
