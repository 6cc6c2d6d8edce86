"""The catalog of runs as tables: recording what was ingested, and asking whether a selection is there."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput, LiveStore, NotFound
from ..schema import TABLES, frame
from .ingest import VariableSpec, run_readiness, stale, upsert

Catalog = dict[str, DataFrame]


@dataclass(frozen=True)
class RunRecord:
    """What a catalog says of a run; ``expected_*`` is what makes it ready."""

    center_id: str
    model_id: str
    cycle_time: object
    version: str = "v1"
    store: str | None = None
    ensemble: bool = False
    grid_code: str = "global"
    product_type: str = "surface"
    variables: Sequence[VariableSpec] = ()
    expected_leads: Sequence[int] = ()
    expected_members: Sequence[int] = ()
    names: dict[str, str] = field(default_factory=dict)

    @property
    def version_id(self) -> str:
        return f"version_{self.model_id}_{self.version}"

    @property
    def run_id(self) -> str:
        return f"run_{self.version_id}_{self.cycle_time:%Y%m%d%H%M}_{self.model_id}"


_KEYS = {
    "forecast_centers": ["center_id"],
    "models": ["model_id"],
    "model_versions": ["model_id", "version_string"],
    "model_runs": ["model_version_id", "cycle_time"],
    "forecast_grids": ["grid_code"],
    "forecast_variables": ["variable_code"],
    "forecast_products": ["run_id", "variable_id", "grid_id", "product_type", "lead_time_hours"],
    "ensemble_members": ["run_id", "member_index"],
    "ensemble_member_products": ["run_id", "member_index", "lead_time_hours"],
}


def empty(spark) -> Catalog:  # noqa: ANN001
    return {t: spark.createDataFrame([], TABLES[t]) for t in _KEYS}


def record_run(catalog: Catalog, run: RunRecord, committed: DataFrame) -> Catalog:
    """The catalog with a run and all that belongs to it; recording it again changes nothing.

    ``committed`` holds the ``(lead_time_hours[, member])`` that the store really
    has.  Rows that exist keep their values, but the run takes the new store path; products and pairs
    that the store no longer has go; the status follows from what is there.
    """
    spark, run_id = committed.sparkSession, run.run_id
    one = {
        "forecast_centers": [{"id": f"center_{run.center_id}", "center_id": run.center_id, "name": run.names.get("center", run.center_id)}],
        "models": [{"id": f"model_{run.model_id}", "model_id": run.model_id, "name": run.names.get("model", run.model_id), "center_id": run.center_id, "is_ensemble": run.ensemble}],
        "model_versions": [{"id": run.version_id, "model_id": run.model_id, "version_string": run.version}],
        "model_runs": [{"id": run_id, "model_version_id": run.version_id, "cycle_time": run.cycle_time, "status": "processing", "zarr_store_path": run.store}],
        "forecast_grids": [{"id": f"grid_{run.grid_code}", "grid_code": run.grid_code, "name": run.names.get("grid", run.grid_code)}],
        "forecast_variables": [{"id": f"var_{v.code}", "variable_code": v.code, "name": v.name, "unit": v.unit} for v in run.variables],
    }
    new = {t: frame(spark, t, rows) for t, rows in one.items()}
    leads = committed.select("lead_time_hours").distinct()
    codes = new["forecast_variables"].select(F.col("variable_code").alias("variable_id"))
    named = F.concat_ws("_", F.lit("product"), F.lit(run_id), "variable_id", F.lit(run.grid_code), F.lit(run.product_type), F.col("lead_time_hours").cast("string"))
    new["forecast_products"] = leads.crossJoin(codes).select(
        named.alias("id"), F.lit(run_id).alias("run_id"), "variable_id", F.lit(run.grid_code).alias("grid_id"), F.lit(run.product_type).alias("product_type"), "lead_time_hours", F.lit(run.store).cast("string").alias("zarr_chunk_path")
    )
    if run.ensemble:
        pairs = committed.where("member is not null").select("member", "lead_time_hours").distinct()
        new["ensemble_members"] = pairs.select("member").distinct().select(F.format_string(f"member_%d_{run_id}", "member").alias("id"), F.lit(run_id).alias("run_id"), F.col("member").alias("member_index"), F.format_string(f"{run.model_id}_member_%d", "member").alias("member_name"))
        new["ensemble_member_products"] = pairs.select(F.format_string(f"member_product_%d_%d_{run_id}", "member", "lead_time_hours").alias("id"), F.lit(run_id).alias("run_id"), F.col("member").alias("member_index"), "lead_time_hours")
    out = dict(catalog)
    for t, rows in new.items():
        out[t] = upsert(catalog[t], rows, _KEYS[t])
    out = reconciled(out, run_id, committed, run.ensemble)
    status = _status(out, run, committed)
    mine = F.col("id") == run_id
    out["model_runs"] = out["model_runs"].withColumns({"status": F.when(mine, F.lit(status)).otherwise(F.col("status")), "zarr_store_path": F.when(mine & F.lit(run.store is not None), F.lit(run.store)).otherwise(F.col("zarr_store_path"))})
    return out


def reconciled(catalog: Catalog, run_id: str, committed: DataFrame, ensemble: bool = False) -> Catalog:
    """Without products and pairs of the run that the store doesn't have."""
    out = dict(catalog)
    products = catalog["forecast_products"]
    gone = stale(products.where(F.col("run_id") == run_id), committed.select("lead_time_hours").distinct(), ["lead_time_hours"])
    out["forecast_products"] = products.join(gone.select("id"), "id", "left_anti").select(*products.columns)
    if ensemble:
        pairs = catalog["ensemble_member_products"]
        there = committed.select(F.col("member").alias("member_index"), "lead_time_hours").distinct()
        gone = stale(pairs.where(F.col("run_id") == run_id), there, ["member_index", "lead_time_hours"])
        out["ensemble_member_products"] = pairs.join(gone.select("id"), "id", "left_anti").select(*pairs.columns)
    return out


def _status(catalog: Catalog, run: RunRecord, committed: DataFrame) -> str:
    spark, run_id = committed.sparkSession, run.run_id
    named = F.lit(run_id).alias("run_id")
    paired = run.ensemble and bool(run.expected_members)
    if not run.expected_leads:  # what was recorded is the whole truth
        return "ready"
    wanted = [(m, x) for m in (run.expected_members if paired else [None]) for x in run.expected_leads]
    expected = spark.createDataFrame(wanted, "member int, lead_time_hours int").select(named, "member", "lead_time_hours")
    source = catalog["ensemble_member_products"].withColumnRenamed("member_index", "member") if paired else catalog["forecast_products"]
    recorded = source.where(F.col("run_id") == run_id)
    return run_readiness(expected, recorded, committed.select(named, *(["member"] if paired else []), "lead_time_hours"), ensemble=paired).first().status


def set_partial(runs: DataFrame, run_id: str) -> DataFrame:
    """Runs with one that is no longer served; done before its store changes."""
    return runs.withColumn("status", F.when(F.col("id") == run_id, F.lit("partial")).otherwise(F.col("status")))


def is_live(runs: DataFrame, path: str) -> bool:
    """Whether a ready run is served from this store."""
    return not runs.where((F.col("status") == "ready") & (F.col("zarr_store_path") == path)).isEmpty()


def guard_overwrite(runs: DataFrame, path: str) -> None:
    if is_live(runs, path):
        raise LiveStore(f"{path} is served; patch its regions instead")


def with_products(runs: DataFrame, products: DataFrame, variable: str, level: str, lead: int) -> DataFrame:
    """Runs that have a product of this variable, level and lead."""
    rows = products.where((F.col("variable_id") == variable) & (F.col("product_type") == level) & (F.col("lead_time_hours") == lead))
    return runs.join(rows.select(F.col("run_id").alias("id")), "id", "left_semi")


def check_available(catalog: Catalog, model: str, variable: str, level: str, lead: int, cycle: object = None) -> str:
    """The run that a map of this selection is drawn from, without opening its store: the newest ready one, or that of ``cycle``."""
    if level != "surface":
        raise InvalidInput(f"level {level!r} is not supported")
    for table, key, value in (("models", "model_id", model), ("forecast_variables", "variable_code", variable)):
        if catalog[table].where(F.col(key) == value).isEmpty():
            raise NotFound(f"no {key} {value!r}")
    versions = catalog["model_versions"].where(F.col("model_id") == model).select(F.col("id").alias("model_version_id"))
    runs = catalog["model_runs"].where((F.col("status") == "ready") & F.col("zarr_store_path").isNotNull()).join(versions, "model_version_id", "left_semi")
    if cycle is not None:
        runs = runs.where(F.col("cycle_time") == F.lit(cycle))
    newest = runs.orderBy(F.desc("cycle_time")).limit(1)
    found = with_products(newest, catalog["forecast_products"], variable, level, lead).select("id").take(1)
    if not found:
        raise NotFound(f"no {variable} of {model} at lead {lead}")
    return found[0][0]


def legend_unit(variables: DataFrame, code: str) -> str:
    rows = variables.where(F.col("variable_code") == code).select("unit").take(1)
    if not rows or rows[0][0] is None:
        raise NotFound(f"no variable {code!r}")
    return rows[0][0]
