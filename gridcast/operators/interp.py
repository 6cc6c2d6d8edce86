"""Sampling gridded fields at points: equi-joins on computed node indices, no range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidGrid, OutsideGrid
from ..functions.geo import Grid, western_axis


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def check_inside(points: DataFrame, grid: Grid, lat: str = "latitude", lon: str = "longitude") -> None:
    """Raises ``OutsideGrid`` with a point that the grid doesn't cover."""
    bad = points.where(~grid.contains(F.col(lat), F.col(lon))).select(lat, lon).take(1)
    if bad:
        raise OutsideGrid(f"{bad[0][0]}, {bad[0][1]} lies outside the grid")


def near(field: DataFrame, asked: DataFrame) -> DataFrame:
    """The field's rows and columns between the least and the greatest that are asked for, as ranges that reach the scan.

    One row of bounds is collected, whatever the number of points.
    """
    low_row, high_row, low_col, high_col = asked.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    if low_row is None:
        return field.where(F.lit(False))
    return field.where(F.col("row").between(low_row, high_row) & F.col("col").between(low_col, high_col))


def bilinear(points: DataFrame, field: DataFrame, grid: Grid, keys: Sequence[str], by: Sequence[str] = (), lat: str = "latitude", lon: str = "longitude", value: str = "value") -> DataFrame:
    """Bilinear value at each point, a row for each point and group of ``by`` (variable, lead, member ...).

    ``field`` has ``row``, ``col``, ``value`` and the columns of ``by``; ``keys``
    identify a point.  Cells with an absent, null or NaN corner give null; points outside the grid
    (see ``check_inside``) and those that meet no value at all have no row.
    """
    inside = points.where(grid.contains(F.col(lat), F.col(lon)))
    r, c, tr, tc = grid.cell(F.col(lat), F.col(lon))
    cells = inside.select(*keys, r.alias("__r"), c.alias("__c"), tr.alias("__tr"), tc.alias("__tc"))
    last = lambda x, n: F.least(x + 1, F.lit(n - 1).cast("int"))
    corners = F.array(
        *[F.struct(F.lit(k).alias("k"), row.alias("row"), col.alias("col")) for k, (row, col) in enumerate([(F.col("__r"), F.col("__c")), (F.col("__r"), last(F.col("__c"), grid.cols)), (last(F.col("__r"), grid.rows), F.col("__c")), (last(F.col("__r"), grid.rows), last(F.col("__c"), grid.cols))])]
    )
    asked = cells.select(*keys, "__tr", "__tc", F.explode(corners).alias("__k")).select(*keys, "__tr", "__tc", F.col("__k.k").alias("__k"), F.col("__k.row").alias("row"), F.col("__k.col").alias("col"))
    nodes = near(field, asked).select(*by, "row", "col", F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("__v"))
    met = asked.join(nodes, ["row", "col"]).groupBy(*keys, *by)
    pick = lambda k: F.max(F.when(F.col("__k") == k, F.col("__v"))).alias(f"__v{k}")
    wide = met.agg(*[pick(k) for k in range(4)], F.first("__tr").alias("__tr"), F.first("__tc").alias("__tc"))
    south, north = lerp(F.col("__v0"), F.col("__v1"), F.col("__tc")), lerp(F.col("__v2"), F.col("__v3"), F.col("__tc"))
    return wide.select(*keys, *by, lerp(south, north, F.col("__tr")).alias(value))


def nearest(points: DataFrame, field: DataFrame, grid: Grid, keys: Sequence[str], by: Sequence[str] = (), lat: str = "latitude", lon: str = "longitude", value: str = "value") -> DataFrame:
    """Value of the nearest node of each point inside the grid."""
    r, c = grid.nearest(F.col(lat), F.col(lon))
    asked = points.where(grid.contains(F.col(lat), F.col(lon))).select(*keys, r.alias("row"), c.alias("col"))
    return asked.join(near(field, asked).select(*by, "row", "col", value), ["row", "col"]).select(*keys, *by, "row", "col", value)


def elevations(points: DataFrame, dem: DataFrame, grid: Grid, keys: Sequence[str], lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Elevation of every point; null outside the model and next to gaps.  Longitudes are taken as they are."""
    strictly = points.where(F.col(lat).between(F.lit(grid.lat_start), F.lit(grid.lat_stop)) & F.col(lon).between(F.lit(grid.lon_start), F.lit(grid.lon_stop)))
    found = bilinear(strictly, dem, grid, keys, lat=lat, lon=lon).withColumnRenamed("value", "elevation_m")
    return points.join(found, list(keys), "left")


def derive_grid(nodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Geometry of each group's axes ``latitude``, ``longitude``; ``regular`` is whether the steps are even and every node is there.

    An axis wholly beyond 180 degrees is shifted by -360; descending axes come out ascending.
    """
    low = nodes.groupBy(*keys).agg(F.min("longitude").alias("__west"))
    placed = (nodes.join(low, list(keys)) if keys else nodes.crossJoin(low)).withColumn("longitude", western_axis(F.col("longitude"), F.col("__west")))
    axes = []
    for axis, short in (("latitude", "lat"), ("longitude", "lon")):
        values = placed.select(*keys, axis).distinct()
        before = F.lag(axis).over(Window.partitionBy(*keys).orderBy(axis))
        steps = values.withColumn("__d", F.col(axis) - before)
        axes.append(steps.groupBy(*keys).agg(F.min(axis).alias(f"{short}_start"), F.max(axis).alias(f"{short}_stop"), F.count(F.lit(1)).cast("int").alias("rows" if short == "lat" else "cols"), F.min("__d").alias(f"__{short}_low"), F.max("__d").alias(f"__{short}_high")))
    total = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    join = (lambda a, b: a.join(b, list(keys))) if keys else (lambda a, b: a.crossJoin(b))
    out = join(join(axes[0], axes[1]), total)
    step = lambda short, n: (F.col(f"{short}_stop") - F.col(f"{short}_start")) / F.nullif(F.col(n) - 1, F.lit(0))
    out = out.withColumns({"lat_step": step("lat", "rows"), "lon_step": step("lon", "cols")})
    even = lambda short: (F.abs(F.col(f"__{short}_low") - F.col(f"{short}_step")) <= 1e-8 + 1e-5 * F.col(f"{short}_step")) & (F.abs(F.col(f"__{short}_high") - F.col(f"{short}_step")) <= 1e-8 + 1e-5 * F.col(f"{short}_step"))
    regular = F.coalesce(even("lat") & even("lon") & (F.col("__n") == F.col("rows") * F.col("cols")), F.lit(False))
    return out.select(*keys, "lat_start", "lon_start", "lat_step", "lon_step", "rows", "cols", regular.alias("regular"))


def check_shape(field: DataFrame, grid: Grid) -> None:
    """A field fills its grid: every node once, and no index beyond it."""
    inside = F.col("row").between(0, grid.rows - 1) & F.col("col").between(0, grid.cols - 1)
    n, distinct, outside = field.agg(F.count(F.lit(1)), F.count_distinct("row", "col"), F.count_if(~F.coalesce(inside, F.lit(False)))).first()
    if outside or n != distinct or n != grid.rows * grid.cols:
        raise InvalidGrid(f"{n} values on {distinct} nodes, {outside} of them beyond {grid.rows} x {grid.cols}")


def with_indices(nodes: DataFrame, grid: Grid) -> DataFrame:
    """Adds ``row`` and ``col`` to nodes that carry coordinates."""
    r, c = grid.nearest(F.col("latitude"), F.col("longitude"))
    return nodes.withColumns({"row": r, "col": c})
