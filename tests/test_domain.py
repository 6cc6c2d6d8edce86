"""Known values and rejected arguments of the statistics, geometry and verification."""

import math

import pytest
from pyspark.sql import functions as F

from gridcast import errors
from gridcast.functions import geo, units
from gridcast.functions.geo import Grid
from gridcast.operators import ensemble, interp, verify


def column(spark, values, name="value"):
    return spark.createDataFrame([(1, float(v)) for v in values], f"k int, {name} double")


def test_statistics_of_five_members(spark):
    r = ensemble.statistics(column(spark, [0, 10, 20, 30, 40]), ["k"]).first()
    assert (r.mean, r.median, r.p10, r.p25, r.p75, r.p90, r.member_count) == (20, 20, 4, 10, 30, 36, 5)
    assert r.spread == pytest.approx(math.sqrt(200))
    assert ensemble.statistics(column(spark, [1, 2, 3, 4]), ["k"]).first().median == 2.5


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf")])
def test_members_must_be_finite(spark, bad):
    for op in (lambda d: ensemble.statistics(d, ["k"]), lambda d: ensemble.probability(d, ["k"], "gt", 1)):
        with pytest.raises(Exception, match="not finite"):
            op(column(spark, [1, bad])).collect()


def test_members_keep_their_order(spark):
    df = spark.createDataFrame([(1, 2, 30.0), (1, 0, 10.0), (1, 1, 20.0)], "k int, m int, value double")
    assert ensemble.statistics(df, ["k"], member="m").first().members == [10, 20, 30]


def test_probabilities_and_interval(spark):
    rain = column(spark, [3, 4, 5, 6, 7])
    for args in (("gt", 4), ("lt", 6), ("between", 4, 6)):
        r = ensemble.probability(rain, ["k"], *args).first()
        assert r.probability == pytest.approx(0.6)
        assert (r.ci_low, r.ci_high) == (pytest.approx(0.2307, abs=1e-4), pytest.approx(0.8824, abs=1e-4))
    assert ensemble.probability(column(spark, [15.5 + 2 * k for k in range(5)]), ["k"], "gt", 20).first().probability == pytest.approx(0.4)
    certain = ensemble.probability(rain, ["k"], "gt", 0).first()
    assert certain.probability == 1 and certain.ci_high == pytest.approx(1) and certain.ci_low > 0.5


@pytest.mark.parametrize("args", [("gt", True), ("gt", float("nan")), ("gt", "5"), ("ge", 5), ("between", 5), ("between", 5, 4), ("gt", 5, 6)])
def test_conditions_are_checked(args):
    with pytest.raises(errors.InvalidInput):
        ensemble.condition(F.lit(1.0), *args)


@pytest.mark.parametrize("q", [-1, 101, True, float("nan")])
def test_percentiles_are_checked(spark, q):
    with pytest.raises(errors.InvalidInput):
        ensemble.statistics(column(spark, [1]), ["k"], percentiles=[q])


def test_histogram(spark):
    rows = ensemble.histogram(column(spark, [15.5 + 2 * k for k in range(5)]), ["k"]).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [2, 1, 1, 1] or sum(r["count"] for r in rows) == 5
    assert len(rows) == 4 and rows[-1].bin_high == 23.5
    one = ensemble.histogram(column(spark, [7, 7, 7]), ["k"]).collect()
    assert [(r.bin, r["count"]) for r in one] == [(0, 3)]
    assert ensemble.histogram(column(spark, [float("nan")]), ["k"]).count() == 0


def test_longitudes(spark):
    values = {540: 180, -540: -180, 200: -160, -200: 160, 0: 0, 180: 180, -180: -180, 360: 0}
    df = spark.createDataFrame([(float(k), float(v)) for k, v in values.items()], "lon double, want double")
    assert df.where(geo.normalize_longitude(F.col("lon")) != F.col("want")).count() == 0


def test_distance(spark):
    km = spark.range(1).select(geo.haversine_km(F.lit(40.7128), F.lit(-74.006), F.lit(51.5074), F.lit(-0.1278))).first()[0]
    assert km == pytest.approx(5570, rel=0.02)


@pytest.mark.parametrize("lat, lon", [(91, 0), (0, 181), (float("nan"), 0), (True, 0), ("1", 0), (0, float("inf"))])
def test_coordinates_are_checked(lat, lon):
    with pytest.raises(errors.InvalidCoordinates):
        geo.check_coordinates(lat, lon)


def plane(spark, grid, f):
    return spark.createDataFrame([(r, c, float(f(grid.lat_start + r * grid.lat_step, grid.lon_start + c * grid.lon_step))) for r in range(grid.rows) for c in range(grid.cols)], "row int, col int, value double")


GRID = Grid(38.0, -107.0, 0.25, 0.25, 4, 4)


def points(spark, rows):
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(rows)], "id int, latitude double, longitude double")


def test_bilinear_is_exact_on_a_plane(spark):
    f = lambda lat, lon: 10 + 10 * (lat - 38) + 10 * (lon + 107)
    asked = [(38.125, -106.875), (38.0, -107.0), (38.75, -106.25), (38.3, -106.4), (38.75 + 5e-10, -106.25), (39.0, -106.5), (38.1, 253.2)]
    got = {r.id: r.value for r in interp.bilinear(points(spark, asked), plane(spark, GRID, f), GRID, ["id"]).collect()}
    assert 5 not in got
    for k, (lat, lon) in enumerate(asked):
        if k != 5:
            assert got[k] == pytest.approx(f(lat, lon - 360 if lon > 180 else lon), abs=1e-6)


def test_a_gap_makes_its_cells_null(spark):
    field = plane(spark, GRID, lambda lat, lon: 1.0)
    for gap in (field.where("not (row = 1 and col = 1)"), field.withColumn("value", F.when(F.expr("row = 1 and col = 1"), float("nan")).otherwise(F.col("value")))):
        got = {r.id: r.value for r in interp.bilinear(points(spark, [(38.0, -107.0), (38.6, -106.4)]), gap, GRID, ["id"]).collect()}
        assert got == {0: None, 1: 1.0}


def test_bilinear_over_members(spark):
    field = plane(spark, GRID, lambda lat, lon: 1.0).crossJoin(spark.range(3).select(F.col("id").cast("int").alias("member"))).withColumn("value", F.col("value") + 2 * F.col("member"))
    got = interp.bilinear(points(spark, [(38.1, -106.9)]), field, GRID, ["id"], by=["member"]).orderBy("member").collect()
    assert [r.value for r in got] == [1.0, 3.0, 5.0]


def test_bilinear_has_no_range_join(spark):
    df = interp.bilinear(points(spark, [(38.1, -106.9)]), plane(spark, GRID, lambda a, b: 1.0), GRID, ["id"])
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_elevation(spark):
    dem = Grid(38.0, -107.0, 0.5, 0.5, 3, 3)
    ramp = plane(spark, dem, lambda lat, lon: lat * 100 + lon * 10)
    got = {r.id: r.elevation_m for r in interp.elevations(points(spark, [(38.25, -106.75), (45.0, -106.75)]), ramp, dem, ["id"]).collect()}
    assert got == {0: pytest.approx(2757.5), 1: None}


def test_derived_grids(spark):
    def nodes(lats, lons):
        return spark.createDataFrame([(float(a), float(b)) for a in lats for b in lons], "latitude double, longitude double")

    west = interp.derive_grid(nodes([40, 39, 38, 37, 36], range(250, 260))).first()
    assert (west.lon_start, west.lat_start, west.lat_step, west.rows, west.cols, west.regular) == (-110, 36, 1, 5, 10, True)
    assert interp.derive_grid(nodes([1, 2, 4], [0, 1])).first().regular is False
    assert interp.derive_grid(nodes([1, 2], range(0, 360, 20))).first().lon_start == 0
    assert interp.derive_grid(nodes([1, 2], [0, 1]).limit(3)).first().regular is False


@pytest.mark.parametrize("args", [(0, 0, 0, 1, 2, 2), (0, 0, 1, 1, 0, 2), (float("nan"), 0, 1, 1, 2, 2)])
def test_bad_grids(args):
    with pytest.raises(errors.InvalidGrid):
        Grid(*args)


def test_no_wrap_on_a_global_axis(spark):
    world = Grid(-90.0, 0.0, 10.0, 20.0, 19, 18)
    inside = points(spark, [(0, 340), (0, 350), (0, -20), (0, -10)]).select("id", world.contains(F.col("latitude"), F.col("longitude")).alias("ok"))
    assert [r.ok for r in inside.orderBy("id").collect()] == [True, False, True, False]


def test_ties_of_the_nearest_node(spark):
    from gridcast.operators.tiles import nearest_low

    grid = Grid(0.0, 0.0, 1.0, 1.0, 4, 4)
    r = spark.range(1).select(*grid.nearest(F.lit(0.5), F.lit(1.5)), nearest_low(F.lit(0.5)), nearest_low(F.lit(1.5))).first()
    assert tuple(r) == (1, 2, 0, 1)


def test_metrics(spark):
    pairs = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (4.0, 5.0), (6.0, 6.0)], "observed double, forecast double")
    r = verify.metrics(pairs).first()
    assert (r.bias, r.mae, r.rmse, r.pairs) == (0.25, 0.75, pytest.approx(math.sqrt(0.75)), 4)
    with pytest.raises(Exception, match="not finite"):
        verify.metrics(spark.createDataFrame([(1.0, float("nan"))], "observed double, forecast double")).collect()
    with pytest.raises(errors.InvalidInput):
        verify.window(pairs, "2026-07-22", "2026-07-21")


def test_units(spark):
    rows = spark.createDataFrame([(0.0, "°C"), (25.4, "mm/h"), (100.0, "km/h"), (5.0, "hPa")], "v double, u string")
    got = [(round(r[0], 4), r[1]) for r in rows.select(units.to_imperial(F.col("v"), F.col("u")), units.imperial_unit(F.col("u"))).collect()]
    assert got == [(32.0, "°F"), (1.0, "in/h"), (62.1371, "mph"), (5.0, "hPa")]
    source = spark.createDataFrame([(280.0, "K", "°C"), (3e-4, "kg m**-2 s**-1", "mm/h"), (3e-4, "kg m-2 s-1", "mm/h"), (7.0, None, "°C"), (7.0, "°c", "°C")], "v double, a string, b string")
    assert [round(r[0], 6) for r in source.select(units.to_canonical(F.col("v"), F.col("a"), F.col("b"))).collect()] == [6.85, 1.08, 1.08, 7.0, 7.0]
    with pytest.raises(Exception, match="no conversion"):
        spark.range(1).select(units.to_canonical(F.lit(1.0), F.lit("furlong"), F.lit("°C"))).collect()
