"""Markers of committed regions, the manifest of a store, and the finaliser that derives a run's state from them.

A marker is a small JSON object for each region; all markers of a store are read as one table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StoreMismatch
from ..functions.keys import canonical_json, joined_hash, region_id, region_lead, region_member, storage_identity, write_set_fingerprint
from ..sinks.store import exists, read_object, write_object
from .ingest import run_readiness

REGIONS, VERSION, MANIFEST = "__commit__/v1/regions", "__commit__/version", "__commit__/v1/manifest.json"
VERSIONS = ("legacy", "hybrid_marker_v1", "marker_v1")
MARKER = "protocol_version int, state string, generation string, expected_write_set_fingerprint string, logical_region struct<lead_time_hours:int,member:int>, required_materialized_object_keys array<string>, intentionally_omitted_fill_chunks array<string>"


def marker_key(lead: Column, member: Column) -> Column:
    """Place of a region's marker below its store."""
    return F.concat(F.lit(f"{REGIONS}/"), region_id(lead, member), F.lit(".json"))


def chunk_keys(regions: DataFrame, arrays: DataFrame, by_member: bool = False) -> DataFrame:
    """Objects that each region ``(region, lead_index, member_index)`` writes: ``(region, key)``.

    ``arrays`` holds ``name, shape, chunks``: axes (lead, latitude, longitude), of an ensemble with the member first.
    A lead is a chunk of its own, and all members share one; so a region writes all chunks of space of its lead.
    ``by_member`` takes the chunk in which the member really lies: two regions with a key in common can't be written at the same time.
    """
    ensemble = F.size("shape") == 4
    at = F.when(ensemble, 1).otherwise(0)
    count = lambda k: F.ceil(F.element_at("shape", at + k + 2) / F.element_at("chunks", at + k + 2)).cast("int")
    rows = regions.crossJoin(arrays).withColumns({"__lat": F.explode(F.sequence(F.lit(0), count(0) - 1))}).withColumn("__lon", F.explode(F.sequence(F.lit(0), count(1) - 1)))
    member = F.floor(F.coalesce("member_index", F.lit(0)) / F.element_at("chunks", 1)).cast("int") if by_member else F.lit(0)
    place = F.when(ensemble, F.format_string("%d.%d.%d.%d", member, "lead_index", "__lat", "__lon")).otherwise(F.format_string("%d.%d.%d", "lead_index", "__lat", "__lon"))
    return rows.select("region", F.concat_ws("/", "name", place).alias("key"))


def write_marker(spark: SparkSession, path: str, lead: int, member: int | None, state: str, required: list[str] = (), omitted: list[str] = ()) -> None:
    """``updating`` before a region is written, ``complete`` with what was written afterwards."""
    if state not in ("updating", "complete"):
        raise StoreMismatch(f"no state {state!r}")
    region = f"det_L{lead:04d}" if member is None else f"mem{member:03d}_L{lead:04d}"
    both = spark.createDataFrame([(sorted(required), sorted(omitted))], "r array<string>, o array<string>")
    body = {
        "protocol_version": 1,
        "state": state,
        "generation": uuid.uuid4().hex,
        "logical_region": {"lead_time_hours": lead} | ({} if member is None else {"member": member}),
        "expected_write_set_fingerprint": both.select(write_set_fingerprint(F.col("r"), F.col("o"))).first()[0],
        "required_materialized_object_keys": sorted(required),
        "intentionally_omitted_fill_chunks": sorted(omitted),
    }
    write_object(spark, f"{path}/{REGIONS}/{region}.json", canonical_json(body))


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """All markers of a store as ``(region, *fields)``; a damaged one raises when it is read."""
    if not exists(spark, f"{path}/{REGIONS}"):
        return spark.createDataFrame([], f"region string, {MARKER}")
    rows = spark.read.schema(MARKER).option("mode", "FAILFAST").option("multiLine", True).option("pathGlobFilter", "*.json").json(f"{path}/{REGIONS}")
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("region"), "*")


def protocol_version(spark: SparkSession, path: str) -> str:
    """``legacy`` without a version file; an unknown one raises."""
    text = read_object(spark, f"{path}/{VERSION}")
    if text is None:
        return VERSIONS[0]
    if text.strip() not in VERSIONS[1:]:
        raise StoreMismatch(f"unknown version {text!r} of {path}")
    return text.strip()


def write_protocol_version(spark: SparkSession, path: str, version: str) -> None:
    if version not in VERSIONS[1:]:
        raise StoreMismatch(f"no version {version!r}")
    write_object(spark, f"{path}/{VERSION}", version)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    text = read_object(spark, f"{path}/{MANIFEST}")
    if text is None:
        return None
    try:
        found = json.loads(text)
    except ValueError as e:
        raise StoreMismatch(f"the manifest of {path} is damaged") from e
    if not isinstance(found, dict):
        raise StoreMismatch(f"the manifest of {path} is no object")
    return found


def serving_token(spark: SparkSession, path: str) -> str:
    """Changes whenever what is served changes; of a store without manifest it follows from its name."""
    found = read_manifest(spark, path)
    if found is None:
        return "legacy-" + spark.range(1).select(joined_hash(F.lit(storage_identity(path)))).first()[0]
    if not isinstance(found.get("generation"), str) or not found["generation"]:
        raise StoreMismatch(f"the manifest of {path} names no generation")
    return found["generation"]


def valid_markers(markers: DataFrame, expected: DataFrame, objects: DataFrame) -> DataFrame:
    """Complete markers whose evidence holds.

    Written and omitted keys are disjoint and together those that the region writes
    (``expected(region, key)``), every written one exists (``objects(key)``), and the fingerprint is theirs.
    """
    done = markers.where("state = 'complete'")
    fine = F.size(F.array_intersect("required_materialized_object_keys", "intentionally_omitted_fill_chunks")) == 0
    fine &= F.col("expected_write_set_fingerprint") == write_set_fingerprint(F.col("required_materialized_object_keys"), F.col("intentionally_omitted_fill_chunks"))
    claimed = done.select("region", F.explode("required_materialized_object_keys").alias("key"), F.lit(True).alias("must")).unionByName(done.select("region", F.explode("intentionally_omitted_fill_chunks").alias("key"), F.lit(False).alias("must")))
    there = objects.select("key").distinct().withColumn("there", F.lit(True))
    odd = claimed.join(expected.withColumn("wanted", F.lit(True)), ["region", "key"], "full").join(there, "key", "left")
    wrong = odd.where(F.col("must").isNull() | F.col("wanted").isNull() | (F.col("must") & F.col("there").isNull())).select("region").distinct()
    return done.where(fine).join(wrong, "region", "left_anti")


def committed_regions(valid: DataFrame) -> DataFrame:
    """``(region, lead_time_hours, member, generation)`` of valid markers."""
    return valid.select("region", region_lead(F.col("region")).alias("lead_time_hours"), region_member(F.col("region")).alias("member"), "generation")


def serving_fingerprint(committed: DataFrame, mode: str, schema: str) -> DataFrame:
    """One row: a hash over all committed regions with their generations, so that replaced data change it."""
    states = F.array_sort(F.collect_list(F.to_json(F.struct("generation", "lead_time_hours", "member", "region"))))
    return committed.agg(joined_hash(F.lit(mode), F.lit(schema), F.array_join(states, ",")).alias("fingerprint"), F.count(F.lit(1)).alias("regions"))


def finalise(spark: SparkSession, path: str, expected: DataFrame, arrays: DataFrame, placed: DataFrame, objects: DataFrame, recorded: DataFrame, schema: str = "", ensemble: bool = False) -> DataFrame:
    """State of a run from its markers: one row ``(status, regions, fingerprint)``; the manifest is written with it.

    ``expected`` and ``recorded`` hold ``lead_time_hours[, member]``, ``placed`` the regions with their
    indices (see ``chunk_keys``), ``objects`` the keys that exist.  Doing it twice
    writes the same manifest.
    """
    markers = read_markers(spark, path)
    committed = committed_regions(valid_markers(markers, chunk_keys(placed, arrays), objects))
    run = F.lit("run").alias("run_id")
    keys = ["member", "lead_time_hours"] if ensemble else ["lead_time_hours"]
    state = run_readiness(expected.select(run, *keys), recorded.select(run, *keys), committed.select(run, *keys), ensemble=ensemble).first()
    mode = protocol_version(spark, path)
    seal = serving_fingerprint(committed, mode, schema).first()
    listed = [r.region for r in committed.select("region").orderBy("region").collect()]
    write_object(spark, f"{path}/{MANIFEST}", canonical_json({"generation": seal.fingerprint, "mode": mode, "regions": listed}))
    return spark.createDataFrame([(state.status if state else "processing", seal.regions, seal.fingerprint)], "status string, regions long, fingerprint string")
