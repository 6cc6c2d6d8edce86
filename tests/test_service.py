"""Catalog, series, verification, tiles, ingestion and streaming on small fixtures."""

import datetime as dt
import json
import struct
import threading
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast import errors
from gridcast.functions import keys, present
from gridcast.functions.geo import Grid
from gridcast.operators import catalog, commit, ensemble, ingest, interp, record, series, tiles, verify
from gridcast.schema import TABLES, frame
from gridcast.sinks import png, store
from gridcast.sources import field_source, runs
from gridcast.streaming.ingest import patch_store, region_stream

DAY = dt.datetime(2026, 8, 14)
GRID = Grid(38.0, -107.0, 0.25, 0.25, 4, 4)


def hours(h):
    return DAY + dt.timedelta(hours=h)


@pytest.fixture(scope="module")
def world(spark):
    leads = {"r00": [0, 6, 12], "r06": [0, 6], "r12": [0]}
    tables = {
        "models": frame(spark, "models", [{"id": "m1", "model_id": "gfs", "name": "GFS", "center_id": "noaa", "is_ensemble": False}, {"id": "m2", "model_id": "gefs", "name": "GEFS", "center_id": "noaa", "is_ensemble": True}]),
        "versions": frame(spark, "model_versions", [{"id": "v1", "model_id": "gfs", "version_string": "v1.0"}]),
        "runs": frame(spark, "model_runs", [{"id": f"r{h:02}", "model_version_id": "v1", "cycle_time": hours(h), "status": "processing" if h == 12 else "ready", "zarr_store_path": None if h == 12 else f"s/{h}"} for h in (0, 6, 12)]),
        "variables": frame(spark, "forecast_variables", [dict(id=i, variable_code=c, name=i, unit=u) for i, c, u in (("t", "temperature_2m", "°C"), ("p", "precipitation_rate", "mm/h"))]),
        "products": frame(spark, "forecast_products", [{"id": f"{r}{h}{v}", "run_id": r, "variable_id": v, "grid_id": "g", "product_type": "surface", "lead_time_hours": h} for r, hs in leads.items() for h in hs for v in "tp"]),
    }
    field = [(r, "temperature_2m", h, i, j, 10 + 10 * (i * 0.25) + 10 * (j * 0.25) + 0.5 * h) for r, hs in leads.items() for h in hs for i in range(4) for j in range(4)]
    tables["field"] = spark.createDataFrame(field, "run_id string, variable_code string, lead_time_hours int, row int, col int, value double")
    tables["stored"] = tables["field"].select("run_id", "lead_time_hours").distinct()
    return tables


def offers(w, **change):
    w = w | change
    return series.candidates(w["runs"], w["versions"], w["models"], w["products"], w["stored"], "gfs")


def chosen(w, start=None, end=None, **change):
    rows = series.shortest_lead(series.lead_window(offers(w, **change), start, end), ["model_id", "valid_time"])
    return {r.valid_time: (r.run_id, r.lead_time_hours) for r in rows.collect()}


def test_shortest_lead_wins(world):
    assert chosen(world) == {hours(0): ("r00", 0), hours(6): ("r06", 0), hours(12): ("r06", 6)}
    assert set(chosen(world, 6, 6)) == {hours(6), hours(12)}


def test_a_missing_store_falls_back(world):
    assert chosen(world, stored=world["stored"].where("run_id <> 'r06'")) == {hours(0): ("r00", 0), hours(6): ("r00", 6), hours(12): ("r00", 12)}
    no_rows = chosen(world, products=world["products"].where("run_id <> 'r06'"))
    assert no_rows[hours(12)] == ("r06", 6)


def test_point_forecast(spark, world):
    place = spark.createDataFrame([(1, 38.125, -106.875)], "id int, latitude double, longitude double")
    out = series.point_forecast(place, world["field"], GRID, offers(world), world["variables"], ["id"]).collect()
    assert [(r.valid_time, r.lead_time_hours, r.value) for r in out] == [(hours(0), 0, 12.5), (hours(6), 0, 12.5), (hours(12), 6, 15.5)]
    f = series.point_forecast(place, world["field"], GRID, offers(world), world["variables"], ["id"], imperial=True).first()
    assert (f.value, f.unit) == (54.5, "°F")


def test_locations(spark):
    cities = frame(spark, "cities", [{"id": "c1", "city_name": "Aspen", "lon": -106.82, "lat": 38.19}])
    resorts = frame(spark, "ski_resorts", [{"id": "s1", "resort_name": "Aspen Mountain", "lon": -106.82, "lat": 38.2}])
    assert series.resolve_location(cities, resorts, city_id="c1") == (38.19, -106.82)
    assert series.resolve_location(cities, resorts, lat=1.0, lon=2.0) == (1.0, 2.0)
    for bad in ({}, {"lat": 1.0}, {"city_id": "c1", "resort_id": "s1"}, {"lat": 99.0, "lon": 0.0}):
        with pytest.raises(errors.InvalidInput):
            series.resolve_location(cities, resorts, **bad)
    with pytest.raises(errors.NotFound):
        series.resolve_location(cities, resorts, resort_id="nowhere")
    found = catalog.search({"city": (cities, "city_name", "id"), "resort": (resorts, "resort_name", "id")}, "aspen", 1).collect()
    assert [(r.object, r.name) for r in found] == [("city", "Aspen")]


def test_availability(world):
    (model,) = catalog.availability(world["runs"], world["versions"], world["models"], world["products"], world["variables"]).collect()
    assert model.model_id == "gfs" and [v.variable_code for v in model.variables] == ["precipitation_rate", "temperature_2m"]
    assert [(t.cycle_time, t.lead_times) for t in model.variables[0].initial_times] == [(hours(6), [0, 6]), (hours(0), [0, 6, 12])]


def test_models_are_checked(world):
    catalog.require_model(world["models"], "gefs", ensemble=True)
    with pytest.raises(errors.NotFound):
        catalog.require_model(world["models"], "icon")
    with pytest.raises(errors.InvalidInput):
        catalog.require_model(world["models"], "gfs", ensemble=True)


def test_pages(spark):
    df = spark.range(10).select(F.format_string("k%02d", "id").alias("id"))
    first = catalog.page(df, "id", 4)
    assert ([r.id for r in first.data.collect()], first.has_more, first.next_cursor) == (["k00", "k01", "k02", "k03"], True, "k03")
    last = catalog.page(df, "id", 4, starting_after="k07")
    assert ([r.id for r in last.data.collect()], last.has_more, last.next_cursor) == (["k08", "k09"], False, None)
    back = catalog.page(df, "id", 2, ending_before="k05")
    assert ([r.id for r in back.data.collect()], back.has_more, back.next_cursor) == (["k03", "k04"], True, "k03")
    for bad in ({"limit": 0}, {"limit": 101}, {"starting_after": "a", "ending_before": "b"}):
        with pytest.raises(errors.InvalidInput):
            catalog.page(df, "id", **bad)


def test_verification_report(spark, world):
    stations = frame(spark, "stations", [{"id": "1", "station_code": "KASE", "lon": -106.875, "lat": 38.125}])
    seen = frame(spark, "verification_observations", [{"id": "a", "station_id": "KASE", "variable_code": "temperature_2m", "valid_time": hours(12), "observed_value": 16.5}, {"id": "b", "station_id": "NONE", "variable_code": "temperature_2m", "valid_time": hours(12), "observed_value": 0.0}])
    due = world["products"].join(world["runs"].where("status = 'ready'").select(F.col("id").alias("run_id"), "cycle_time"), "run_id").join(world["variables"].select(F.col("id").alias("variable_id"), "variable_code"), "variable_id")
    out = verify.report(seen, stations, due, world["field"], GRID, "2026-08-14", "2026-08-14")
    (r,) = out.collect()
    assert (r.pairs, r.bias, r.mae) == (2, 0.5, 1.5) and r.rmse == pytest.approx(2.5**0.5)  # leads 12 and 6: errors 2 and -1
    assert verify.flat_report(out).first().metrics["temperature_2m_bias"] == 0.5
    assert verify.flat_report(out.where("pairs > 9")).first().metrics == {}


def test_tiles(spark):
    world = Grid(-90.0, -180.0, 1.0, 1.0, 181, 361)
    nodes = spark.range(181 * 361).select((F.col("id") / 361).cast("int").alias("row"), (F.col("id") % 361).cast("int").alias("col")).withColumn("value", (F.col("row") - 90).cast("double"))
    out = tiles.render(spark, nodes.where("row > 60"), world, 0, 0, 0, tiles.ramp("temperature_2m"))
    assert out.count() == 65536 and out.where("a = 0").count() > 0
    image = png.images(out.withColumn("tile", F.lit("0/0/0")), ["tile"]).first().png
    assert image[1:4] == b"PNG" and struct.unpack(">II", image[16:24]) == (256, 256)
    data = zlib.decompress(image[image.index(b"IDAT") + 4 : -16])
    pixels = np.frombuffer(data, np.uint8).reshape(256, 1 + 1024)[:, 1:].reshape(256, 256, 4)
    r = out.where("px = 10 and py = 20").first()
    assert pixels[20, 10].tolist() == [r.r, r.g, r.b, r.a]
    asked = spark.createDataFrame([(0, 0, 0), (1, 2, 0), (3, 1, 2)], "z int, x int, y int")
    many = tiles.render_many(asked, nodes.where("row > 60"), world, tiles.ramp("temperature_2m"))
    assert many.where("z = 0").drop("z", "x", "y").exceptAll(out).isEmpty() and many.count() == 2 * 65536
    drawn = {(r.z, r.x, r.y): r.png for r in tiles.images(asked, nodes.where("row > 60"), world, tiles.ramp("temperature_2m")).collect()}
    same = {(r.z, r.x, r.y): r.png for r in png.images(many, ["z", "x", "y"]).collect()}
    assert drawn == same and len(drawn) == 2
    away = tiles.images(asked, nodes, Grid(10.0, 10.0, 1.0, 1.0, 5, 5), tiles.ramp("precipitation_rate")).where("z = 3").first()
    assert away.png == png.encode(np.zeros((256, 256, 4), np.uint8))
    for bad in ((10, 0, 0), (1, 2, 0), (0, 0, -1)):
        with pytest.raises(errors.InvalidInput):
            tiles.check_tile(*bad)
    assert keys.tile_template("gfs", "t", "surface", 6).endswith("{z}/{x}/{y}.png?lead_time_hours=6")


def test_messages_become_canonical_rows(spark):
    messages = spark.createDataFrame([(1, "2t", "heightAboveGround", 2, "instant", "K", 280.0), (2, "prate", "surface", 0, "instant", "kg m**-2 s**-1", 3e-4), (3, "prate", "surface", 0, "avg", "kg m**-2 s**-1", 1e-4), (4, "t", "isobaricInhPa", 850, "instant", "K", 250.0), (5, "2t", "heightAboveGround", 2, "instant", "K", float("nan"))], "message_id int, short_name string, type_of_level string, level int, step_type string, units string, value double")
    specs = [ingest.parse_variable("temperature_2m:Temperature:°C:2t"), ingest.parse_variable("precipitation_rate:Rain:mm/h:prate")]
    named = ingest.rename_variables(ingest.select_fields(messages).withColumnRenamed("short_name", "source_code"), specs)
    ingest.check_units(named)
    assert sorted((r.message_id, r.variable_code, round(r.value, 6)) for r in ingest.canonical(named).collect()) == [(1, "temperature_2m", 6.85), (2, "precipitation_rate", 1.08)]
    with pytest.raises(errors.UnitMismatch):
        ingest.check_units(named.withColumn("units", F.lit("furlong")))
    with pytest.raises(errors.InvalidInput):
        ingest.parse_variable("a:b")
    steps = spark.createDataFrame([(21600, 3), (None, None)], "step_seconds long, number long")
    assert sorted(tuple(r) for r in ingest.normalise(steps).na.fill(-1).collect()) == [(0, -1), (6, 3)]


def region(spark, lead, member, add=0.0, cycle=DAY):
    return frame(spark, "grid_values", [{"model_id": "gefs", "cycle_time": cycle, "variable_code": "temperature_2m", "member": member, "lead_time_hours": lead, "row": i, "col": j, "latitude": 38 + i / 4, "longitude": -107 + j / 4, "value": lead + (member or 0) + add} for i in range(4) for j in range(4)])


def test_generations_patches_and_readiness(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(errors.NotFound):
        store.read(spark, path)
    store.write_generation(region(spark, 0, 1).unionByName(region(spark, 6, 1)), path)
    with pytest.raises(errors.LiveStore):
        store.write_generation(region(spark, 0, 1), path, live=True)
    for _ in range(2):
        store.patch(region(spark, 6, 1, add=100.0), path)
    store.patch(region(spark, 6, 2), path)
    now = store.read(spark, path)
    got = {(r.lead_time_hours, r.member): r.v for r in now.groupBy("lead_time_hours", "member").agg(F.max("value").alias("v")).collect()}
    assert got == {(0, 1): 1, (6, 1): 107, (6, 2): 8} and now.count() == 48
    have = ingest.committed_state(now, ensemble=True)
    expected = catalog.expected_pairs(spark.createDataFrame([(1,), (2,)], "member int"), spark.createDataFrame([(0,), (6,)], "lead_time_hours int"))
    assert tuple(ingest.run_status(expected, have).first()) == (4, 3, "partial")
    store.patch(region(spark, 0, 2), path)
    assert ingest.run_status(expected, ingest.committed_state(store.read(spark, path), True)).first().status == "ready"
    assert ingest.run_status(expected, have.limit(0)).first().status == "processing"
    assert store.inventory(spark, path).select("region").distinct().count() == 4
    ingest.check_identity(now, region(spark, 12, 1))
    with pytest.raises(errors.StoreMismatch):
        ingest.check_identity(now, region(spark, 12, 1, cycle=hours(6)))
    for odd in (region(spark, 12, 1).where("row > 0"), region(spark, 12, 1).withColumn("longitude", F.col("longitude") + 1)):
        with pytest.raises(errors.StoreMismatch):
            ingest.check_identity(now, odd)
    ingest.check_lead(region(spark, 12, 1), 12)
    with pytest.raises(errors.StoreMismatch):
        ingest.check_lead(region(spark, 12, 1), 6)
    assert ingest.write_set(now).first() == ingest.write_set(now.orderBy(F.desc("lead_time_hours"))).first()


def test_readers_keep_what_they_began_to_read(spark, tmp_path):
    path = str(tmp_path / "store")
    store.commit_region(region(spark, 0, 1), path, 0, 1)
    before = store.read(spark, path)
    store.commit_region(region(spark, 0, None, add=5.0), path, 0, 1)
    store.commit_region(region(spark, 6, 2), path, 6, 2)
    assert before.agg(F.max("value")).first()[0] == 1 and before.count() == 16
    assert store.read(spark, path).count() == 32 and store.read(spark, path).agg(F.max("value")).first()[0] == 8
    with pytest.raises(errors.StoreMismatch):
        store.commit_region(region(spark, 12, 1), path, 6, 1)
    runs_ = frame(spark, "model_runs", [{"id": "r", "status": "ready", "zarr_store_path": path}])
    assert store.read_ready(runs_, "r", path).count() == 32
    for bad in (record.set_partial(runs_, "r"), runs_.withColumn("zarr_store_path", F.lit("elsewhere"))):
        with pytest.raises(errors.NotFound):
            store.read_ready(bad, "r", path)
    store.write_object(spark, f"{path}/pointer.json", "{")
    with pytest.raises(errors.StoreMismatch):
        store.read(spark, path)
    assert store.check_store_path(None, "gfs", "2026-08-14 00", "/s") == "/s/gfs/2026-08-14T00"
    with pytest.raises(errors.StoreMismatch):
        store.check_store_path("/other", "gfs", "2026-08-14 00", "/s")


def test_a_polling_reader_never_misses_a_region(spark, tmp_path):
    path, seen, stop = str(tmp_path / "store"), [], threading.Event()
    store.write_generation(region(spark, 0, 1).unionByName(region(spark, 6, 1)), path)

    def poll():
        while not stop.is_set():
            seen.append(store.read(spark, path).count())

    reader = threading.Thread(target=poll)
    reader.start()
    for k in range(4):
        store.patch(region(spark, 6, 1, add=float(k)), path)
    stop.set()
    reader.join()
    assert seen and set(seen) == {32}


def record_of(**change):
    spec = [ingest.parse_variable("temperature_2m:Temperature:°C")]
    return record.RunRecord(**({"center_id": "noaa", "model_id": "gefs", "cycle_time": DAY, "store": "s/0", "ensemble": True, "variables": spec, "expected_leads": [0, 6], "expected_members": [1, 2]} | change))


def test_recording_a_run(spark):
    def kept(tables, *args):  # as if the catalog had been written and read again
        return {t: spark.createDataFrame(df.toArrow(), df.schema) for t, df in record.record_run(tables, *args).items()}

    pairs = lambda *p: spark.createDataFrame(list(p), "member int, lead_time_hours int")
    run = record_of()
    status = lambda c: c["model_runs"].first().status
    part = kept(record.empty(spark), run, pairs((1, 0), (1, 6), (2, 0)))
    assert status(part) == "partial" and part["forecast_products"].count() == 2 and part["ensemble_member_products"].count() == 3
    whole = kept(part, run, pairs((1, 0), (1, 6), (2, 0), (2, 6)))
    again = kept(whole, run, pairs((1, 0), (1, 6), (2, 0), (2, 6)))
    assert status(whole) == "ready" and all(sorted(whole[t].collect()) == sorted(again[t].collect()) for t in whole if t != "forecast_centers") and len(again) == 9
    surplus = kept(whole, run, pairs((1, 0), (1, 6), (2, 0), (2, 6), (3, 0)))
    assert status(surplus) == "partial"  # a pair that nobody expects
    shrunk = kept(whole, run, pairs((1, 0), (2, 0)))
    assert status(shrunk) == "partial" and shrunk["forecast_products"].count() == 1 and shrunk["ensemble_member_products"].count() == 2
    assert status(kept(record.empty(spark), run, pairs((1, 0)).limit(0))) == "processing"
    more = kept(record.empty(spark), record_of(ensemble=False, expected_leads=[0]), pairs((None, 0), (None, 6)))
    assert status(more) == "ready"  # further leads do no harm
    assert record.check_available(whole, "gefs", "temperature_2m", "surface", 6) == run.run_id
    for wrong, kind in ((("gfs", "temperature_2m", "surface", 6), errors.NotFound), (("gefs", "rain", "surface", 6), errors.NotFound), (("gefs", "temperature_2m", "surface", 9), errors.NotFound), (("gefs", "temperature_2m", "500", 6), errors.InvalidInput)):
        with pytest.raises(kind):
            record.check_available(whole, *wrong)
    with pytest.raises(errors.NotFound):
        record.check_available(whole, "gefs", "temperature_2m", "surface", 6, hours(6))
    with pytest.raises(errors.LiveStore):
        record.guard_overwrite(whole["model_runs"], "s/0")
    record.guard_overwrite(part["model_runs"], "s/0")
    assert record.legend_unit(whole["forecast_variables"], "temperature_2m") == "°C"


def test_a_batch_goes_on_after_a_failure(spark):
    def one(run):
        if run.hour == 6:
            raise errors.StoreMismatch("odd")

    specs = spark.createDataFrame([("gfs", 0), ("gfs", 6), ("gfs", 12)], "model string, hour int")
    out, code = ingest.run_batch(specs, one)
    assert code == 1 and [(r.hour, r.status, r.reason) for r in out.orderBy("hour").collect()] == [(0, "ingested", None), (6, "failed", "StoreMismatch: odd"), (12, "ingested", None)]
    out, code = ingest.run_batch(specs, one, dry_run=True)
    assert code == 0 and {r.status for r in out.collect()} == {"planned"}
    row = ingest.fallbacks(spark.createDataFrame([("k", "{}")], "cache_key string, query_params string"), "cache_down", 300).first()
    assert row.fallback_reason == "cache_down" and (row.expires_at - row.created_at).total_seconds() == 300


def test_stale_catalog_is_not_ready(spark):
    rows = lambda *x: spark.createDataFrame([("r", k) for k in x], "run_id string, lead_time_hours int")
    state = lambda e, r, s: ingest.run_readiness(rows(*e), rows(*r) if r else rows(0).limit(0), rows(*s) if s else None).first().status
    assert state([0, 6], [0, 6, 12, 18], [6]) == "partial" and state([0, 6], [0, 6, 12], None) == "ready"
    assert state([0, 6], [0, 6], [0, 6]) == "ready" and state([0, 6], [0], [0]) == "partial" and state([0], [], None) == "processing"


def test_markers_manifest_and_finaliser(spark, tmp_path):
    path = str(tmp_path / "store")
    arrays = spark.createDataFrame([("t", [2, 100, 200], [1, 64, 128])], "name string, shape array<int>, chunks array<int>")
    placed = spark.createDataFrame([("det_L0000", 0, None), ("det_L0006", 1, None)], "region string, lead_index int, member_index int")
    keys_of = {r.region: r.k for r in commit.chunk_keys(placed, arrays).groupBy("region").agg(F.array_sort(F.collect_list("key")).alias("k")).collect()}
    assert keys_of["det_L0006"] == ["t/1.0.0", "t/1.0.1", "t/1.1.0", "t/1.1.1"]
    objects = spark.createDataFrame([(k,) for v in keys_of.values() for k in v], "key string")
    leads = lambda *x: spark.createDataFrame([(k,) for k in x], "lead_time_hours int")
    finish = lambda o=objects: commit.finalise(spark, path, leads(0, 6), arrays, placed, o, leads(0, 6)).first()
    assert commit.read_markers(spark, path).count() == 0 and commit.serving_token(spark, path).startswith("legacy-") and commit.protocol_version(spark, path) == "legacy"
    commit.write_marker(spark, path, 0, None, "complete", keys_of["det_L0000"])
    commit.write_marker(spark, path, 6, None, "updating", keys_of["det_L0006"])
    assert finish().regions == 1
    commit.write_marker(spark, path, 6, None, "complete", keys_of["det_L0006"][:3], keys_of["det_L0006"][3:])
    done = finish()
    assert (done.status, done.regions) == ("ready", 2) and commit.serving_token(spark, path) == done.fingerprint == finish().fingerprint
    assert finish(objects.where("key <> 't/1.0.0'")).regions == 1  # written, but gone
    assert finish(objects.where("key <> 't/1.1.1'")).regions == 2  # left out on purpose
    commit.write_marker(spark, path, 6, None, "complete", keys_of["det_L0006"][:2])
    assert finish().regions == 1  # not all it should write
    commit.write_marker(spark, path, 0, None, "complete", keys_of["det_L0000"])
    assert finish().fingerprint != done.fingerprint
    commit.write_protocol_version(spark, path, "marker_v1")
    assert commit.protocol_version(spark, path) == "marker_v1"
    for text, call in (("odd", lambda: commit.protocol_version(spark, path)),):
        store.write_object(spark, f"{path}/{commit.VERSION}", text)
        with pytest.raises(errors.StoreMismatch):
            call()
    for text in ("{", "[]", "{}"):
        store.write_object(spark, f"{path}/{commit.MANIFEST}", text)
        with pytest.raises(errors.StoreMismatch):
            commit.serving_token(spark, path)


def test_requests_places_and_options(spark):
    assert present.parse_list(" a, ,b ") == ["a", "b"] and present.parse_list(" ") is None and present.parse_model(" gfs ,") == "gfs"
    for bad in ("", "a,b"):
        with pytest.raises(errors.InvalidInput):
            present.parse_model(bad)
    with pytest.raises(errors.InvalidInput):
        present.check_index(4, 0, 4, 4)
    row = spark.range(1).select(
        present.suggestion(F.lit("x"), F.lit("Main"), F.lit("Second")).alias("s"), present.coordinates_location(F.lit(38.19), F.lit(-106.82)).alias("c"),
        present.component(F.array(F.struct(F.array(F.lit("country")).alias("types"), F.lit("").alias("long"), F.lit("US").alias("short"))), "country").alias("k"),
        present.context(F.array(F.struct(F.lit("region.1").alias("id"), F.lit("Colorado").alias("text"))), "region").alias("t"), present.no_elevation().alias("e"), keys.value_label(F.lit(1234.5), F.lit("m")).alias("v"), keys.value_label(F.lit(15.0), F.lit("")).alias("w"),
    ).first()
    assert (row.s.id, row.s.latitude, row.c.name, row.k, row.t, row.e, row.v, row.w) == ("place_x", 0.0, "38.1900, -106.8200", "US", "Colorado", None, "1,234.5 m", "15")
    assert keys.storage_identity("s3://b/k/?sig=1", "https://h:9000", True) == "s3+https://h:9000/b/k" == keys.storage_identity("s3a://b/k", "h:9000", True)
    assert keys.storage_identity("file:///a/../b") == keys.storage_identity("/b") == "file:///b"
    assert 0 <= keys.key60("x") < 1 << 60 and keys.key60("x", 2) >> 60 == 2 and keys.key60("x") != keys.key60("y")


def test_choices_that_are_not_there(spark, world):
    assert catalog.unknown(["z", "temperature_2m", "a", "z"], world["variables"], "variable_code") == ["z", "a", "z"]
    codes = world["variables"].select("id", "variable_code")
    available = catalog.availability(world["runs"], world["versions"], world["models"], world["products"], codes)
    pick = lambda *a: tuple(present.options(available, *a).first())
    assert pick("gfs", "temperature_2m", hours(6)) == (["gfs"], ["precipitation_rate", "temperature_2m"], [hours(6), hours(0)], [0, 6])
    assert pick("gfs", "rain") == (["gfs"], ["precipitation_rate", "temperature_2m"], [], []) and pick("x")[1:] == ([], [], []) and pick()[0] == ["gfs"]
    assert tuple(present.defaults(available).first()) == ("gfs", "precipitation_rate", hours(6), 0)


def test_checks_of_members_points_and_fields(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "k int, value double")
    ensemble.check_members(rows((1, 1.0), (1, 2.0)), ["k"])
    for bad in (rows((1, 1.0), (2, float("nan"))), rows((1, None))):
        with pytest.raises(errors.InvalidMembers):
            ensemble.check_members(bad, ["k"])
    at = lambda lat: spark.createDataFrame([(lat, -107.0)], "latitude double, longitude double")
    interp.check_inside(at(38.5), GRID)
    with pytest.raises(errors.OutsideGrid):
        interp.check_inside(at(40.0), GRID)
    nodes = spark.createDataFrame([(i, j) for i in range(4) for j in range(4)], "row int, col int")
    interp.check_shape(nodes, GRID)
    for bad in (nodes.limit(15), nodes.unionByName(nodes.limit(1)), nodes.withColumn("row", F.col("row") + 1)):
        with pytest.raises(errors.InvalidGrid):
            interp.check_shape(bad, GRID)
    with pytest.raises(errors.InvalidInput):
        ensemble.wilson(F.lit(0.5), F.lit(3.0), 1.0)


def test_ranges_reach_the_scan(spark, tmp_path):
    nodes = spark.range(10_000).select((F.col("id") / 100).cast("int").alias("row"), (F.col("id") % 100).cast("int").alias("col"), F.col("id").cast("double").alias("value"))
    nodes.write.parquet(str(tmp_path / "f"))
    field, grid = spark.read.parquet(str(tmp_path / "f")), Grid(0.0, 0.0, 1.0, 1.0, 100, 100)
    points = spark.createDataFrame([(1, 20.5, 30.5)], "id int, latitude double, longitude double")
    for plan in (interp.bilinear(points, field, grid, ["id"]), tiles.render(spark, field, grid, 5, 17, 14, tiles.ramp("temperature_2m"))):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "LessThanOrEqual(row," in text


def test_sets_of_keys(spark):
    key = lambda *v: spark.createDataFrame([(x,) for x in v], "k string")
    ingest.check_cover(key("a", "b", "c"), key("a", "b"), key("c"), "k")
    for written, omitted in ((("a", "b"), ("b", "c")), (("a",), ("b",)), (("a", "b", "c", "d"), ())):
        with pytest.raises(errors.StoreMismatch):
            ingest.check_cover(key("a", "b", "c"), key(*written), key(*omitted) if omitted else key("a").limit(0), "k")
    once = ingest.upsert(key("a"), key("a", "b", "b"), ["k"])
    assert sorted(r.k for r in once.collect()) == sorted(r.k for r in ingest.upsert(once, key("a", "b"), ["k"]).collect()) == ["a", "b"]
    assert catalog.same_rows(key("a", "b"), key("b", "a")) and not catalog.same_rows(key("a"), key("a", "b"))


def test_manifest_and_flags(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"runs": [dict(model="gefs", cycle_date="2026-07-21", cycle_hour=0, lead_time_hours=[0, 246], members=[1, 2]), dict(model="gfs", cycle_date="2026-07-21", cycle_hour=6, lead_time_hours=[6])]}))
    todo = runs.items(runs.read_manifest(spark, str(path)))
    named = todo.select("member", runs.file_name(*(F.col(c) for c in "model cycle_date cycle_hour lead_time_hours member".split())).alias("f")).collect()
    assert len(named) == 5 and {r.f for r in named} >= {"gens/prod/gefs.20260721/00/atmos/pgrb2sp25/gep01.t00z.pgrb2s.0p25.f000", "gens/prod/gefs.20260721/00/atmos/pgrb2bp5/gep01.t00z.pgrb2s.0p50.f246", "gfs/prod/gfs.20260721/06/atmos/gfs.t06z.pgrb2.0p25.f006"}
    with pytest.raises(errors.InvalidInput):
        runs.read_manifest(spark, str(path), max_runs=1)
    runs.checked_runs(todo)
    for change in ({"member": 31}, {"member": None}, {"cycle_hour": 3}, {"lead_time_hours": 385}, {"model": "x"}):
        bad = todo.where("model = 'gefs'").withColumns({k: F.lit(v).cast(todo.schema[k].dataType) for k, v in change.items()})
        with pytest.raises(errors.InvalidInput):
            runs.checked_runs(bad)
        with pytest.raises(Exception, match="no such run"):
            bad.select(runs.file_name(*(F.col(c) for c in "model cycle_date cycle_hour lead_time_hours member".split()))).collect()
    flags = lambda m, d, h: spark.createDataFrame([(m, d, h)], "models array<string>, dates array<string>, hours array<int>")
    assert [tuple(r) for r in runs.expand(flags(["gfs"], ["a", "b"], [0, 6])).collect()] == [("gfs", "a", 0), ("gfs", "b", 6)]
    with pytest.raises(Exception, match="unequal"):
        runs.expand(flags(["gfs"], ["a", "b"], [0, 6, 12])).collect()


def test_field_files(spark, tmp_path):
    value = np.arange(12.0).reshape(3, 4)
    value[0, 0] = np.nan
    np.savez(tmp_path / "a.npz", latitude=[40.0, 39.0, 38.0], longitude=[250.0, 251, 252, 253], value=value, source_code="2t", units="K", lead=6, member=3)
    field_source.register(spark)
    got = spark.read.format("gridfield").load(str(tmp_path))
    assert got.count() == 11 and got.where("row = 0 and col = 1").first().value == 9.0 and got.first().member == 3


def test_stream_of_regions(spark, tmp_path):
    path, folder = str(tmp_path / "store"), str(tmp_path / "in")
    store.write_generation(region(spark, 0, 1), path)
    for lead, member, add in ((6, 1, 9.0), (0, 2, 0.0), (6, 1, 1.0)):
        region(spark, lead, member, add).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # file times are in seconds on some file systems
    for _ in range(2):  # a second run has nothing to do
        patch_store(region_stream(spark, folder), path, str(tmp_path / "checkpoint")).awaitTermination()
    assert {(r.lead_time_hours, r.member) for r in store.read(spark, path).select("lead_time_hours", "member").distinct().collect()} == {(0, 1), (6, 1), (0, 2)}
    assert store.read(spark, path).count() == 48
    assert {r.value for r in store.read(spark, path).where("lead_time_hours = 6").collect()} == {8.0}  # the last to arrive


def test_schemas_survive_parquet(spark, tmp_path):
    for name, schema in TABLES.items():
        frame(spark, name, [{}]).write.parquet(str(tmp_path / name))
        assert [(f.name, f.dataType) for f in spark.read.parquet(str(tmp_path / name)).schema] == [(f.name, f.dataType) for f in schema]


def test_request_keys():
    assert keys.request_key("points", a=1, b="x") == keys.request_key("points", b="x", a=1) != keys.request_key("points", a=2, b="x")


def test_labels(spark):
    r = spark.range(1).select(keys.region_id(F.lit(6)), keys.region_id(F.lit(6), F.lit(3)), keys.region_lead(F.lit("mem003_L0006")), keys.region_member(F.lit("det_L0006")), keys.coordinate_label(F.lit(38.12345), F.lit(-106.5)), keys.percent_range_label(F.lit(0.6), F.lit(0.23), F.lit(0.88)), keys.iso_z(F.lit(DAY)), keys.cycle_label(F.lit(DAY)), keys.lead_label(F.lit(6))).first()
    assert tuple(r) == ("det_L0006", "mem003_L0006", 6, None, "38.1235, -106.5000", "60% (23–88%)", "2026-08-14T00:00:00Z", "2026-08-14 00Z", "+6h")
