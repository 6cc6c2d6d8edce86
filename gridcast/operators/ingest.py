"""From source messages to canonical grid values, and what a run still lacks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..errors import InvalidInput, StoreMismatch, UnitMismatch
from ..functions.keys import fingerprint, region_id
from ..functions.units import CANONICAL, to_canonical, unit_token
from .catalog import committed, status

CYCLE_HOURS, MAX_LEAD = (0, 6, 12, 18), 384
#: Source fields that are read: (short name, level type, level or None, step type)
FIELDS = (("2t", "heightAboveGround", 2, "instant"), ("prate", "surface", None, "instant"))


@dataclass(frozen=True)
class VariableSpec:
    code: str
    name: str
    unit: str
    source_code: str


def parse_variable(text: str) -> VariableSpec:
    """``CODE:NAME:UNIT[:SOURCE]``; the source defaults to the code."""
    parts = text.split(":")
    if len(parts) not in (3, 4) or not all(parts):
        raise InvalidInput(f"{text!r} is not CODE:NAME:UNIT[:SOURCE]")
    return VariableSpec(parts[0], parts[1], parts[2], parts[3] if len(parts) == 4 else parts[0])


def select_fields(messages: DataFrame, fields: tuple = FIELDS) -> DataFrame:
    """Messages of the wanted fields only."""
    wanted = F.lit(False)
    for short, kind, level, step in fields:
        wanted |= (F.col("short_name") == short) & (F.col("type_of_level") == kind) & (F.col("step_type") == step) & (F.lit(True) if level is None else F.col("level") == level)
    return messages.where(wanted)


def normalise(raw: DataFrame) -> DataFrame:
    """Source coordinates to canonical columns: ``step_seconds`` to whole hours of lead, ``number`` to member."""
    out = raw.withColumn("lead_time_hours", F.coalesce((F.col("step_seconds") / 3600).cast("int"), F.lit(0))) if "step_seconds" in raw.columns else raw
    if "number" in raw.columns:
        out = out.withColumn("member", F.col("number").cast("int"))
    return out.drop("step_seconds", "number", "valid_time")


def rename_variables(df: DataFrame, specs: list[VariableSpec]) -> DataFrame:
    """Rows of known source codes under their own code, with the wanted unit as ``unit``."""
    pairs = df.sparkSession.createDataFrame([(s.source_code, s.code, s.unit) for s in specs], "source_code string, variable_code string, unit string")
    return df.join(F.broadcast(pairs), "source_code")


def check_units(df: DataFrame, source: str = "units", target: str = "unit") -> None:
    """Raises on a pair of units without a conversion; only distinct pairs reach the driver."""
    pairs = df.select(unit_token(F.col(source)).alias("a"), unit_token(F.col(target)).alias("b")).distinct().collect()
    bad = [(r.a, r.b) for r in pairs if r.a is not None and r.a != r.b and (r.a, r.b) not in CANONICAL]
    if bad:
        raise UnitMismatch(f"no conversion for {bad}")


def canonical(df: DataFrame) -> DataFrame:
    """Values in the unit of their variable; NaN and null values become absent rows."""
    return df.withColumn("value", to_canonical(F.col("value").cast("double"), F.col("units"), F.col("unit"))).where(~F.isnan("value") & F.col("value").isNotNull()).drop("units")


def check_lead(df: DataFrame, lead: int) -> None:
    """A file holds the lead it was asked for, and no other."""
    leads = [r[0] for r in df.select("lead_time_hours").distinct().limit(2).collect()]
    if leads != [lead]:
        raise StoreMismatch(f"leads {leads} instead of {lead}")


def check_identity(store: DataFrame, new: DataFrame) -> None:
    """New data must be of the store's model and cycle and have its axes and variables; members and leads may be others."""
    if store.isEmpty():
        return
    if not new.select("model_id", "cycle_time").distinct().exceptAll(store.select("model_id", "cycle_time").distinct()).isEmpty():
        raise StoreMismatch("data of another run")
    for axis in (["row", "latitude"], ["col", "longitude"], ["variable_code"]):
        a, b = store.select(*axis).distinct(), new.select(*axis).distinct()
        if not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()):
            raise StoreMismatch(f"another {axis[-1]}")


def merge_leads(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Leads of ``new`` replace those of ``existing``, which keeps the others."""
    return existing.join(new.select("lead_time_hours").distinct(), "lead_time_hours", "left_anti").unionByName(new)


def committed_state(values: DataFrame, ensemble: bool) -> DataFrame:
    """Leads, or members and leads, with any value."""
    return committed(values, ["member", "lead_time_hours"] if ensemble else ["lead_time_hours"])


def run_status(expected: DataFrame, present: DataFrame) -> DataFrame:
    """One row ``(expected, present, status)``; only expected keys count as present."""
    keys = expected.columns
    both = expected.distinct().join(present.select(*keys).distinct().withColumn("__there", F.lit(1)), keys, "left")
    return both.agg(F.count(F.lit(1)).alias("expected"), F.count("__there").alias("present")).withColumn("status", status(F.col("expected"), F.col("present")))


def run_readiness(expected: DataFrame, recorded: DataFrame, stored: DataFrame | None = None, run: str = "run_id", ensemble: bool = False) -> DataFrame:
    """``(run, expected, present, status)`` of every run with expectations.

    The tables hold ``run, lead_time_hours`` and, of an ensemble, ``member``: what should be there, what the
    catalog has, and what the store really holds.  ``processing`` without any recorded lead. ``ready`` needs every expected lead,
    of an ensemble exactly the expected pairs and no others, and, where the store is known, a catalog
    that equals it.  All else is ``partial``.
    """
    keys = [run, "lead_time_hours", *(["member"] if ensemble else [])]
    flagged = [t.select(*keys).distinct().withColumn("__k", F.lit(k)) for k, t in enumerate((expected, recorded, stored)) if t is not None]
    rows = flagged[0]
    for t in flagged[1:]:
        rows = rows.unionByName(t)
    place = rows.groupBy(*keys).agg(*[F.bool_or(F.col("__k") == k).alias(n) for k, n in enumerate(("e", "r", "s"))])
    lead = place.groupBy(run, "lead_time_hours").agg(*[F.bool_or(c).alias(c) for c in ("e", "r")]).groupBy(run).agg(F.count_if(F.col("e") & ~F.col("r")).alias("lacking"), F.count_if("r").alias("leads"))
    counts = place.groupBy(run).agg(
        F.count_if("e").alias("expected"), F.count_if(F.col("e") & F.col("r")).alias("present"), F.count_if(F.col("e") != F.col("r")).alias("odd"), F.count_if(F.col("r") != F.col("s")).alias("stale")
    )
    wrong = (F.col("lacking") > 0) | (F.col("odd") > 0 if ensemble else F.lit(False)) | (F.col("stale") > 0 if stored is not None else F.lit(False))
    state = F.when(F.col("leads") == 0, "processing").when(wrong, "partial").otherwise("ready")
    return counts.join(lead, run).where("expected > 0").select(run, "expected", "present", state.alias("status"))


def write_set(values: DataFrame) -> DataFrame:
    """One fingerprint over the regions of a run, whatever the order of their rows."""
    regions = values.select(region_id(F.col("lead_time_hours"), F.col("member")).alias("region")).distinct()
    return regions.agg(fingerprint(F.collect_set("region")).alias("fingerprint"), F.count(F.lit(1)).alias("regions"))


def stale(recorded: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Catalog rows without committed data behind them."""
    return recorded.join(present.select(*keys), keys, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` and those rows of ``new`` whose natural key it lacks; running it again changes nothing."""
    return existing.unionByName(new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def check_cover(expected: DataFrame, materialised: DataFrame, omitted: DataFrame, key: str) -> None:
    """Written and omitted keys are disjoint and together the expected ones."""
    if not materialised.select(key).intersect(omitted.select(key)).isEmpty():
        raise StoreMismatch("a key is both written and omitted")
    union = materialised.select(key).union(omitted.select(key)).distinct()
    if not (union.exceptAll(expected.select(key).distinct()).isEmpty() and expected.select(key).distinct().exceptAll(union).isEmpty()):
        raise StoreMismatch("the keys are not those expected")


def run_batch(runs: DataFrame, one: Callable[[Row], None], dry_run: bool = False) -> tuple[DataFrame, int]:
    """Ingests runs one after the other; a run that fails leaves the others alone.

    Gives ``(*runs, status, reason)``, where the status is ``planned``, ``ingested`` or ``failed``, and the
    exit code, 1 if any failed.  The specifications are collected: a batch has few (see ``limited``).
    """
    rows = []
    for run in runs.collect():
        status, reason = "planned", None
        if not dry_run:
            try:
                one(run)
                status = "ingested"
            except Exception as e:  # noqa: BLE001 - whatever it is, the other runs go on
                status, reason = "failed", f"{type(e).__name__}: {e}"
        rows.append((*run, status, reason))
    schema = StructType([*runs.schema.fields, StructField("status", StringType()), StructField("reason", StringType())])
    return runs.sparkSession.createDataFrame(rows, schema), int(any(r[-2] == "failed" for r in rows))


def fallbacks(requests: DataFrame, reason: str, seconds: int) -> DataFrame:
    """Audit rows of answers that didn't come from the cache: ``requests(cache_key, query_params)`` with times and the reason."""
    now = F.current_timestamp()
    return requests.select("cache_key", "query_params", now.alias("created_at"), (now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))).alias("expires_at"), F.lit(reason).alias("fallback_reason"))
