"""Catalog lists, availability, readiness and set tests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput, NotFound

MAX_LIMIT = 100


@dataclass(frozen=True)
class Page:
    """A page of a list; the cursor continues it in the direction of the request."""

    data: DataFrame
    has_more: bool
    next_cursor: object


def check_paging(limit: int = 20, starting_after: object = None, ending_before: object = None) -> None:
    if isinstance(limit, bool) or not 1 <= limit <= MAX_LIMIT:
        raise InvalidInput(f"limit must lie within 1 to {MAX_LIMIT}")
    if starting_after is not None and ending_before is not None:
        raise InvalidInput("a page starts after a key or ends before one, not both")


def page_rows(df: DataFrame, key: str, limit: int = 20, starting_after: object = None, ending_before: object = None) -> DataFrame:
    """Rows of a keyset page, ascending; found by a range filter and a top-k, never by an offset."""
    check_paging(limit, starting_after, ending_before)
    if ending_before is not None:
        return df.where(F.col(key) < F.lit(ending_before)).orderBy(F.desc(key)).limit(limit).orderBy(key)
    rows = df if starting_after is None else df.where(F.col(key) > F.lit(starting_after))
    return rows.orderBy(key).limit(limit)


def page(df: DataFrame, key: str, limit: int = 20, starting_after: object = None, ending_before: object = None) -> Page:
    """A page with its continuation; at most ``limit`` + 1 keys reach the driver."""
    check_paging(limit, starting_after, ending_before)
    backward = ending_before is not None
    rows = df.where(F.col(key) < F.lit(ending_before)) if backward else df if starting_after is None else df.where(F.col(key) > F.lit(starting_after))
    keys = [r[0] for r in rows.select(key).orderBy(F.desc(key) if backward else F.asc(key)).limit(limit + 1).collect()]
    shown = keys[:limit]
    cursor = shown[-1] if len(keys) > limit else None
    return Page(page_rows(df, key, limit, starting_after, ending_before), len(keys) > limit, cursor)


def filtered(df: DataFrame, **equal: object) -> DataFrame:
    """Rows equal in the given columns; None leaves a column out."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def ready(runs: DataFrame) -> DataFrame:
    return runs.where((F.col("status") == "ready") & F.col("zarr_store_path").isNotNull())


def model_runs(runs: DataFrame, versions: DataFrame, models: DataFrame) -> DataFrame:
    """Runs with their version and model; the dimensions are small, Spark broadcasts them by size."""
    v = versions.select(F.col("id").alias("model_version_id"), "model_id", "version_string")
    m = models.select("model_id", F.col("name").alias("model_name"), "is_ensemble", "center_id")
    return runs.withColumnRenamed("id", "run_id").join(v, "model_version_id").join(m, "model_id")


def require_model(models: DataFrame, model_id: str, ensemble: bool = False) -> None:
    rows = models.where(F.col("model_id") == model_id).select("is_ensemble").take(1)
    if not rows:
        raise NotFound(f"no model {model_id!r}")
    if ensemble and not rows[0][0]:
        raise InvalidInput(f"model {model_id!r} has no members")


def availability(runs: DataFrame, versions: DataFrame, models: DataFrame, products: DataFrame, variables: DataFrame) -> DataFrame:
    """Model, variable, cycles (newest first) and their distinct leads, of ready runs."""
    v = variables.select(F.col("id").alias("variable_id"), "variable_code")
    rows = model_runs(ready(runs), versions, models).join(products.select("run_id", "variable_id", "lead_time_hours"), "run_id").join(v, "variable_id")
    leads = rows.groupBy("model_id", "variable_code", "cycle_time").agg(F.sort_array(F.collect_set("lead_time_hours")).alias("lead_times"))
    cycles = leads.groupBy("model_id", "variable_code").agg(F.sort_array(F.collect_list(F.struct("cycle_time", "lead_times")), asc=False).alias("initial_times"))
    return cycles.groupBy("model_id").agg(F.sort_array(F.collect_list(F.struct("variable_code", "initial_times"))).alias("variables"))


def missing(wanted: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wanted.join(present.select(*keys).distinct(), list(keys), "left_anti")


def unknown(codes: Sequence[str], table: DataFrame, key: str) -> list[str]:
    """Of a request's codes those that the table lacks, in the order of the request."""
    asked = table.sparkSession.createDataFrame(list(enumerate(codes)), f"place int, {key} string")
    return [r[0] for r in asked.join(table.select(key), key, "left_anti").orderBy("place").select(key).collect()]


def known(wanted: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wanted.join(present.select(*keys), list(keys), "left_semi")


def shared(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that both tables have."""
    return a.select(*keys).intersect(b.select(*keys))


def either(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that one of the tables has."""
    return a.select(*keys).union(b.select(*keys)).distinct()


def centers(table: DataFrame, limit: int = 20, starting_after: object = None) -> DataFrame:
    """A page of forecast centers by id."""
    return page_rows(table.select("id", "name"), "id", limit, starting_after)


def expected_pairs(members: DataFrame, leads: DataFrame) -> DataFrame:
    """All members at all leads: one of the two cross joins on purpose."""
    return members.crossJoin(leads)


def committed(values: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Keys under which some value is present."""
    some = F.bool_or(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return values.groupBy(*keys).agg(some.alias("__some")).where("__some").drop("__some")


def status(expected: Column, present: Column) -> Column:
    """``ready`` with all expected parts, ``partial`` with some, else ``processing``."""
    return F.when(present >= expected, "ready").when(present > 0, "partial").otherwise("processing")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same set of rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def search(sources: dict[str, tuple[DataFrame, str, str]], query: str, limit: int = 20, kind: str = "all") -> DataFrame:
    """Case-insensitive search over several tables: ``{object: (table, name column, id column)}``.

    The query is a pattern between wildcards; its own ``%`` and ``_`` act as such.
    Results are ordered by name, object and id before the limit.
    """
    if not query:
        raise InvalidInput("an empty query")
    if kind != "all" and kind not in sources:
        raise InvalidInput(f"no objects of type {kind!r}")
    found = None
    for name, (table, text, key) in sources.items():
        if kind in ("all", name):
            hits = table.where(F.col(text).ilike(f"%{query}%")).select(F.lit(name).alias("object"), F.col(key).cast("string").alias("id"), F.col(text).alias("name"))
            found = hits if found is None else found.unionByName(hits)
    return found.orderBy("name", "object", "id").limit(limit)
