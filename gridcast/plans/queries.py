"""Every operator over the test tables, with the same query in DuckDB SQL.

Doubles are rounded to six places on both sides, for sums may run in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, keys, present, units
from ..functions.geo import Grid
from ..operators import catalog, commit, ensemble, ingest, interp, record, series, tiles, verify

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


def _r(sql: str) -> str:
    return f"round({sql}, 6)"


# Series

_LEADS = """SELECT o_orderpriority AS model_id, CAST(l_shipdate AS DATE) AS valid_time, CAST(o_orderdate AS DATE) AS cycle_time,
  CAST(24 * date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS BIGINT) AS lead_time_hours, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice AS value
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE CAST(l_shipdate AS DATE) >= CAST(o_orderdate AS DATE)"""


def _leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("cycle_time"))
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", F.col("l_shipdate").cast("date").alias("valid_time"))
    lead = (F.datediff("valid_time", "cycle_time").cast("bigint") * 24).alias("lead_time_hours")
    both = o.join(li, o.o_orderkey == li.l_orderkey).where("valid_time >= cycle_time")
    return both.select(F.col("o_orderpriority").alias("model_id"), "valid_time", "cycle_time", lead, "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_extendedprice").alias("value"))


_TIES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "value"]


@query(f"""WITH c AS ({_LEADS})
SELECT model_id, valid_time, cycle_time, lead_time_hours, l_orderkey, l_linenumber, value FROM (
  SELECT *, row_number() OVER (PARTITION BY model_id, valid_time ORDER BY lead_time_hours, cycle_time DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber, value) AS k FROM c) WHERE k = 1""")
def min_lead_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = series.shortest_lead(_leads(spark, sf_dir), ["model_id", "valid_time"], ties=_TIES)
    return chosen.select("model_id", "valid_time", "cycle_time", "lead_time_hours", "l_orderkey", "l_linenumber", "value")


@query(f"""WITH c AS ({_LEADS})
SELECT model_id, valid_time, cycle_time, lead_time_hours, l_orderkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY model_id, valid_time ORDER BY lead_time_hours, cycle_time DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber, value) AS k FROM c
  WHERE lead_time_hours BETWEEN 240 AND 2400) WHERE k = 1""")
def lead_window_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = series.lead_window(_leads(spark, sf_dir), 240, 2400)
    chosen = series.shortest_lead(window, ["model_id", "valid_time"], ties=_TIES)
    return chosen.select("model_id", "valid_time", "cycle_time", "lead_time_hours", "l_orderkey", "l_linenumber")


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k = 1""")
def newest_run_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.newest(_t(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders
  WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)) WHERE k = 1""")
def pinned_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_orderdate")).first()[0]
    return series.newest(orders, ["o_custkey"], "o_orderdate", ["o_orderkey"], pinned=last).select("o_custkey", "o_orderkey", "o_totalprice")


_RUNS = "SELECT CAST(c_custkey AS VARCHAR) AS id, n_name, c_mktsegment AS model_id, c_acctbal, TIMESTAMP '2026-01-01' + to_hours(CAST(6 * (c_custkey % 40) AS INTEGER)) AS cycle_time FROM customer JOIN nation ON c_nationkey = n_nationkey"


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as runs, nations as versions of the market segments' models."""
    c, n = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation")
    version = F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string"))
    cycle = F.lit("2026-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("c_custkey") % 40 * 6).cast("int"))
    runs = c.select(F.col("c_custkey").cast("string").alias("id"), version.alias("model_version_id"), cycle.alias("cycle_time"), F.when(F.col("c_acctbal") > 0, "ready").otherwise("partial").alias("status"), F.when(F.col("c_acctbal") < 9000, "store").alias("zarr_store_path"))
    models = c.select(F.col("c_mktsegment").alias("model_id"), F.col("c_mktsegment").alias("name"), F.lit(False).alias("is_ensemble"), F.lit("x").alias("center_id")).distinct()
    versions = models.crossJoin(n).select(F.concat_ws("/", "model_id", F.col("n_nationkey").cast("string")).alias("id"), "model_id", F.col("n_name").alias("version_string"))
    return runs, versions, models


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("run_id"), F.col("o_orderpriority").alias("variable_id"), (F.col("o_orderkey") % 9 * 6).cast("int").alias("lead_time_hours"))


_READY = "c_acctbal > 0 AND c_acctbal < 9000"


@query(f"""WITH r AS ({_RUNS}), o AS (SELECT * FROM r WHERE {_READY} AND model_id = 'BUILDING'), p AS (SELECT CAST(o_custkey AS VARCHAR) AS id, o_orderkey % 9 * 6 AS lead FROM orders WHERE o_orderstatus = 'O'),
s AS (SELECT CAST(o_custkey AS VARCHAR) AS id, o_orderkey % 9 * 6 AS lead FROM orders WHERE o_totalprice > 100000),
c AS (SELECT DISTINCT id, lead FROM p UNION SELECT id, lead FROM s WHERE id NOT IN (SELECT id FROM p))
SELECT id AS run_id, model_id, cycle_time, CAST(lead AS INTEGER) AS lead_time_hours, cycle_time + to_hours(CAST(lead AS INTEGER)) AS valid_time FROM c JOIN o USING (id) SEMI JOIN s USING (id, lead)""")
def candidates_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, versions, models = _runs(spark, sf_dir)
    lead = (F.col("o_orderkey") % 9 * 6).cast("int").alias("lead_time_hours")
    orders = _t(spark, sf_dir, "orders")
    products = orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").cast("string").alias("run_id"), lead)
    stored = orders.where("o_totalprice > 100000").select(F.col("o_custkey").cast("string").alias("run_id"), lead)
    return series.candidates(runs, versions, models, products, stored, "BUILDING").select("run_id", "model_id", "cycle_time", "lead_time_hours", "valid_time")


@query(f"WITH r AS ({_RUNS}) SELECT model_id, max(cycle_time) AS generated_at FROM r GROUP BY model_id")
def generated_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.generated_at(catalog.model_runs(*_runs(spark, sf_dir)), ["model_id"])


@query("SELECT DISTINCT CAST(o_orderkey % 9 * 6 AS INTEGER) AS lead_time_hours FROM orders")
def lead_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.lead_times(_products(spark, sf_dir))


@query("""SELECT run_id, lead_time_hours, CAST(row_number() OVER (PARTITION BY run_id ORDER BY lead_time_hours) - 1 AS INTEGER) AS index
FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS run_id, CAST(o_orderkey % 9 * 6 AS INTEGER) AS lead_time_hours FROM orders)""")
def lead_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.lead_index(_products(spark, sf_dir), ["run_id"])


@query("SELECT DISTINCT o_orderpriority AS variable_code FROM orders")
def variable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.variable_codes(_products(spark, sf_dir).withColumnRenamed("variable_id", "variable_code"))


@query("""SELECT user_id, date_trunc('hour', ts) AS valid_time, round(avg(value), 6) AS value FROM events WHERE user_id < 200 GROUP BY ALL""")
def meteogram_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = _t(spark, sf_dir, "events").where("user_id < 200").groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("valid_time")).agg(F.round(F.avg("value"), 6).alias("value"))
    return series.meteogram(hours, ["user_id"])


# Ensembles

_STATS = """round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS spread, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.25), 6) AS p25,
  round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.9), 6) AS p90, count(*) AS member_count"""
_STAT_COLUMNS = ["mean", "median", "spread", *(f"p{q}" for q in ensemble.PERCENTILES)]


@query(f"SELECT event_type, {_STATS} FROM (SELECT event_type, value AS v FROM events) GROUP BY event_type")
def ensemble_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ensemble.statistics(_t(spark, sf_dir, "events"), ["event_type"]), *_STAT_COLUMNS)


@query(f"SELECT vec_id, {_STATS} FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY vec_id")
def ensemble_stats_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("member", "value"))
    return _rounded(ensemble.statistics(members, ["vec_id"]), *_STAT_COLUMNS)


@query("SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS members FROM events WHERE user_id < 50 GROUP BY user_id")
def ensemble_members_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").where("user_id < 50").select("user_id", "event_id", F.col("event_id").cast("double").alias("value"))
    stats = ensemble.statistics(rows, ["user_id"], member="event_id")
    return stats.select("user_id", F.array_join(F.transform("members", lambda x: x.cast("bigint").cast("string")), ",").alias("members"))


def _wilson_sql(condition: str, z: float = ensemble.Z95) -> str:
    return f"""WITH g AS (SELECT event_type, avg(CASE WHEN {condition} THEN 1.0 ELSE 0.0 END) AS p, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY event_type),
w AS (SELECT *, (p + {z * z} / (2 * n)) / (1 + {z * z} / n) AS c, {z} / (1 + {z * z} / n) * sqrt(p * (1 - p) / n + {z * z} / (4 * n * n)) AS h FROM g)
SELECT event_type, round(p, 6) AS probability, CAST(n AS BIGINT) AS member_count, round(greatest(0.0, c - h), 6) AS ci_low, round(least(1.0, c + h), 6) AS ci_high FROM w"""


def _probability(spark: SparkSession, sf_dir: str, *args: object) -> DataFrame:
    return _rounded(ensemble.probability(_t(spark, sf_dir, "events"), ["event_type"], *args), "probability", "ci_low", "ci_high").drop("ci")


@query(_wilson_sql("value > 50"))
def prob_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probability(spark, sf_dir, "gt", 50)


@query(_wilson_sql("value < 20"))
def prob_lt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probability(spark, sf_dir, "lt", 20)


@query(_wilson_sql("value BETWEEN 20 AND 60"))
def prob_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probability(spark, sf_dir, "between", 20, 60)


@query("""WITH s AS (SELECT event_type, min(value) AS lo, max(value) AS hi, count(*) AS n FROM events GROUP BY event_type),
b AS (SELECT *, CASE WHEN lo = hi THEN 1 ELSE CAST(ceil(log2(n)) AS INTEGER) + 1 END AS bins FROM s),
w AS (SELECT *, (hi - lo) / bins AS width FROM b),
c AS (SELECT e.event_type, CASE WHEN width > 0 THEN least(bins - 1, CAST(floor((value - lo) / width) AS INTEGER)) ELSE 0 END AS bin, count(*) AS count FROM events e JOIN w USING (event_type) GROUP BY ALL),
g AS (SELECT event_type, lo, width, unnest(range(bins)) AS bin FROM w)
SELECT event_type, CAST(bin AS INTEGER) AS bin, round(lo + bin * width, 6) AS bin_low, round(lo + (bin + 1) * width, 6) AS bin_high, coalesce(count, 0) AS count FROM g LEFT JOIN c USING (event_type, bin)""")
def histogram_sturges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ensemble.histogram(_t(spark, sf_dir, "events"), ["event_type"]), "bin_low", "bin_high").withColumn("count", F.col("count").cast("bigint"))


@query("""SELECT event_type, count(value) AS count, round(min(value), 6) AS minimum, round(max(value), 6) AS maximum, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
  round(stddev_pop(value), 6) AS std_dev FROM events GROUP BY event_type""")
def distribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ensemble.distribution(_t(spark, sf_dir, "events"), ["event_type"]), "minimum", "maximum", "mean", "median", "std_dev")


@query("""WITH q AS (SELECT event_type, CAST(ts AS DATE) AS day, quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.25) AS b, quantile_cont(value, 0.75) AS c, quantile_cont(value, 0.9) AS d FROM events GROUP BY ALL)
SELECT event_type, day, round(a, 6) AS outer_base, round(d - a, 6) AS outer_height, round(b, 6) AS inner_base, round(c - b, 6) AS inner_height FROM q""")
def fan_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _t(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    bands = ensemble.fan_bands(ensemble.statistics(days, ["event_type", "day"]))
    return _rounded(bands, "outer_base", "outer_height", "inner_base", "inner_height").select("event_type", "day", "outer_base", "outer_height", "inner_base", "inner_height")


@query("""SELECT vec_id, CAST(i - 1 AS INTEGER) AS member, round(CAST(embedding[i] AS DOUBLE), 6) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE vec_id < 50)""")
def member_dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    dots = ensemble.member_dots(_t(spark, sf_dir, "embeddings").where("vec_id < 50"), ["vec_id"], "embedding")
    return dots.withColumn("value", F.round(F.col("value").cast("double"), 6))


@query(f"""WITH s AS (SELECT event_type, {_STATS} FROM (SELECT event_type, value AS v FROM events) GROUP BY event_type)
SELECT event_type, CAST(unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS INTEGER) AS place, unnest(['mean', 'median', 'spread', 'p10', 'p25', 'p50', 'p75', 'p90']) AS name, unnest([mean, median, spread, p10, p25, p50, p75, p90]) AS value FROM s""")
def statistics_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ensemble.statistics_entries(ensemble.statistics(_t(spark, sf_dir, "events"), ["event_type"]), ["event_type"]), "value")


@query(_wilson_sql("value > 50", 1.6448536269514722))
def prob_interval_90(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ensemble.probability(_t(spark, sf_dir, "events"), ["event_type"], "gt", 50, confidence=0.9)
    return _rounded(found, "probability", "ci_low", "ci_high").drop("ci")


# Verification


@query("""WITH f AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS f FROM lineitem GROUP BY l_orderkey),
e AS (SELECT o_orderpriority, f - o_totalprice AS e FROM orders JOIN f ON o_orderkey = l_orderkey)
SELECT o_orderpriority, round(avg(e), 4) AS bias, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, count(*) AS pairs FROM e GROUP BY o_orderpriority""")
def verification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    forecast = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("forecast"))
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("observed"))
    return _rounded(verify.metrics(o.join(forecast, o.o_orderkey == forecast.l_orderkey), ["o_orderpriority"]), "bias", "mae", "rmse", places=4)


@query("""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY ALL),
p AS (SELECT o.event_type, f.v - o.v AS e FROM d o JOIN d f ON f.event_type = o.event_type AND CAST(f.day + INTERVAL 1 DAY AS DATE) = o.day)
SELECT event_type, round(avg(e), 6) AS bias, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, count(*) AS pairs FROM p GROUP BY event_type""")
def verification_temporal_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _t(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("v"))
    observed = days.select("event_type", F.col("day").alias("valid_day"), F.col("v").alias("observed"))
    due = days.select("event_type", F.date_add("day", 1).alias("valid_day"), F.col("v").alias("forecast"))
    return _rounded(verify.metrics(observed.join(due, ["event_type", "valid_day"]), ["event_type"]), "bias", "mae", "rmse")


#: Observations of January 1995; each day's field is the parts' prices and the day.
_REPORT = """obs AS (SELECT o_orderkey, o_custkey, day(o_orderdate) AS d, o_totalprice / 100 AS observed FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1995-02-01')"""


@query("REPORT")
def verification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").where("o_orderdate >= date'1995-01-01' and o_orderdate < date'1995-02-01'")
    observations = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("station_id"), F.lit("price").alias("variable_code"), F.col("o_orderdate").cast("timestamp_ntz").alias("valid_time"), (F.col("o_totalprice") / 100).alias("observed_value"))
    stations = _points(spark, sf_dir).select(F.col("c_custkey").alias("station_code"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    days = spark.range(1, 32).select(F.col("id").cast("int").alias("d"))
    cycle = F.lit("1994-12-31").cast("timestamp_ntz") + F.make_dt_interval(F.col("d") - 1)
    products = days.select(F.col("d").cast("string").alias("run_id"), cycle.alias("cycle_time"), F.lit("price").alias("variable_code"), F.lit(24).alias("lead_time_hours"))
    field = _field(spark, sf_dir).crossJoin(days).select(F.col("d").cast("string").alias("run_id"), F.lit("price").alias("variable_code"), F.lit(24).alias("lead_time_hours"), "row", "col", (F.col("value") + F.col("d")).alias("value"))
    return _rounded(verify.report(observations, stations, products, field, _GRID, "1995-01-01", "1995-01-31"), "bias", "mae", "rmse", places=4)


@query("SELECT event_id, ts, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09'")
def obs_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.window(_t(spark, sf_dir, "events"), "2024-01-05", "2024-01-08", "ts").select("event_id", "ts", "user_id", "event_type")


# Catalog


@query(f"""WITH r AS ({_RUNS}) SELECT model_id, o_orderpriority AS variable_code, cycle_time, string_agg(DISTINCT CAST(o_orderkey % 9 * 6 AS VARCHAR), ',' ORDER BY CAST(o_orderkey % 9 * 6 AS VARCHAR)) AS leads
FROM r JOIN orders ON CAST(o_custkey AS VARCHAR) = id WHERE {_READY} GROUP BY ALL""")
def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _available(spark, sf_dir).select("model_id", F.explode("variables").alias("v")).select("model_id", "v.variable_code", F.explode("v.initial_times").alias("t"))
    return found.select("model_id", "variable_code", "t.cycle_time", F.array_join(F.array_sort(F.transform("t.lead_times", lambda x: x.cast("string"))), ",").alias("leads"))


def _available(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = _products(spark, sf_dir)
    variables = products.select(F.col("variable_id").alias("id"), F.col("variable_id").alias("variable_code")).distinct()
    return catalog.availability(*_runs(spark, sf_dir), products, variables)


@query(f"""WITH r AS ({_RUNS}), a AS (SELECT model_id, o_orderpriority AS v, cycle_time, o_orderkey % 9 * 6 AS lead FROM r JOIN orders ON CAST(o_custkey AS VARCHAR) = id WHERE {_READY}),
d AS (SELECT model_id, min(v) AS v FROM a GROUP BY model_id), t AS (SELECT model_id, v, max(cycle_time) AS cycle_time FROM a JOIN d USING (model_id, v) GROUP BY ALL)
SELECT model_id, v AS variable_code, cycle_time, CAST(min(lead) AS INTEGER) AS lead_time_hours FROM a JOIN t USING (model_id, v, cycle_time) GROUP BY ALL""")
def default_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present.defaults(_available(spark, sf_dir))


@query(f"""WITH r AS ({_RUNS}), a AS (SELECT model_id, o_orderpriority AS v, cycle_time, o_orderkey % 9 * 6 AS lead FROM r JOIN orders ON CAST(o_custkey AS VARCHAR) = id WHERE {_READY})
SELECT (SELECT string_agg(m, ',' ORDER BY m) FROM (SELECT DISTINCT model_id AS m FROM a)) AS models, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT v FROM a WHERE model_id = 'BUILDING')) AS variables,
  (SELECT count(DISTINCT cycle_time) FROM a WHERE model_id = 'BUILDING' AND v = '1-URGENT') AS cycles, (SELECT string_agg(CAST(lead AS VARCHAR), ',' ORDER BY lead) FROM (SELECT DISTINCT lead FROM a WHERE model_id = 'BUILDING' AND v = '1-URGENT' AND cycle_time = TIMESTAMP '2026-01-03')) AS leads""")
def option_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = present.options(_available(spark, sf_dir), "BUILDING", "1-URGENT", "2026-01-03")
    text = lambda c: F.nullif(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(""))
    return row.select(text("models").alias("models"), text("variables").alias("variables"), F.size("cycles").cast("bigint").alias("cycles"), text("leads").alias("leads"))


@query("""SELECT object, id, name FROM (SELECT 'customer' AS object, CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer WHERE c_name ILIKE '%1%'
  UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier WHERE s_name ILIKE '%1%' UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), p_name FROM part WHERE p_name ILIKE '%1%') ORDER BY name, object, id LIMIT 20""")
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"customer": "c_name", "supplier": "s_name", "part": "p_name"}
    ids = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}
    return catalog.search({k: (_t(spark, sf_dir, k), name, ids[k]) for k, name in tables.items()}, "1", 20)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey > 40 ORDER BY c_custkey LIMIT 25")
def page_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.page_rows(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 25, starting_after=40)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey < 90 ORDER BY c_custkey DESC LIMIT 25")
def page_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.page_rows(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 25, ending_before=90)


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey > 4 ORDER BY id LIMIT 15")
def list_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.centers(_t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), 15, 4)


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def filter_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.filtered(_t(spark, sf_dir, "customer"), c_mktsegment="BUILDING", c_nationkey=3, c_name=None).select("c_custkey", "c_name")


@query(f"WITH r AS ({_RUNS}) SELECT id AS run_id, model_id, n_name AS version_string, cycle_time FROM r WHERE model_id = 'BUILDING' AND {_READY}")
def filter_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, versions, models = _runs(spark, sf_dir)
    return catalog.filtered(catalog.model_runs(catalog.ready(runs), versions, models), model_id="BUILDING").select("run_id", "model_id", "version_string", "cycle_time")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IS NOT NULL")
def ready_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "ready").otherwise("processing").alias("status"), F.col("o_orderpriority").alias("zarr_store_path"))
    return catalog.ready(runs).select("o_orderkey")


_TYPES = "(SELECT DISTINCT p_type || p_partkey % 7 AS code FROM part WHERE p_size <= 10)"
_OTHER = "(SELECT DISTINCT p_type || p_partkey % 7 AS code FROM part WHERE p_size >= 40)"


def _codes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = _t(spark, sf_dir, "part").withColumn("code", F.concat("p_type", (F.col("p_partkey") % 7).cast("string")))
    return part.where("p_size <= 10").select("code").distinct(), part.where("p_size >= 40").select("code").distinct()


@query(f"SELECT code FROM {_TYPES} EXCEPT SELECT code FROM {_OTHER}")
def unknown_vars_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.missing(*_codes(spark, sf_dir), ["code"])


@query(f"SELECT code FROM {_TYPES} WHERE code IN (SELECT code FROM {_OTHER})")
def known_vars_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.known(*_codes(spark, sf_dir), ["code"])


@query(f"SELECT code FROM {_TYPES} INTERSECT SELECT code FROM {_OTHER}")
def vars_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.shared(*_codes(spark, sf_dir), ["code"])


@query(f"SELECT code FROM {_TYPES} UNION SELECT code FROM {_OTHER}")
def vars_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.either(*_codes(spark, sf_dir), ["code"])


# Readiness


@query("""SELECT user_id, event_type FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (SELECT DISTINCT event_type FROM events)
  EXCEPT SELECT user_id, event_type FROM events WHERE value > 40""")
def expected_cross_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("user_id", "event_type", "value")
    pairs = catalog.expected_pairs(e.select("user_id").distinct(), e.select("event_type").distinct())
    return catalog.missing(pairs, e.where("value > 40"), ["user_id", "event_type"])


_LEAD = "ascii(substr(event_type, 1, 1))"
_STATE = f"""WITH x AS (SELECT DISTINCT user_id, {_LEAD} AS lead, CAST(hour(ts) % 3 AS INTEGER) AS member, value FROM events),
e AS (SELECT u.user_id, l.lead, m.member FROM (SELECT DISTINCT user_id FROM x) u CROSS JOIN (SELECT DISTINCT lead FROM x) l CROSS JOIN (SELECT DISTINCT member FROM x) m WHERE l.lead < 118),
r AS (SELECT DISTINCT user_id, lead, member FROM x WHERE value > 8 AND user_id % 5 <> 3), s AS (SELECT DISTINCT user_id, lead, member FROM x WHERE (value > 8 OR user_id % 4 = 1) AND user_id % 5 <> 3)"""


def _state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is expected, recorded and stored of each user's run."""
    x = _t(spark, sf_dir, "events").select("user_id", F.ascii(F.substring("event_type", 1, 1)).alias("lead_time_hours"), (F.hour("ts") % 3).cast("int").alias("member"), "value")
    e = x.select("user_id").distinct().crossJoin(x.select("lead_time_hours").distinct().where("lead_time_hours < 118")).crossJoin(x.select("member").distinct())
    return e, x.where("value > 8 and user_id % 5 <> 3"), x.where("(value > 8 or user_id % 4 = 1) and user_id % 5 <> 3")


@query(f"""{_STATE}, k AS (SELECT user_id, lead, member, bool_or(t = 0) AS e, bool_or(t = 1) AS r, bool_or(t = 2) AS s FROM (SELECT *, 0 AS t FROM e UNION ALL SELECT *, 1 FROM r UNION ALL SELECT *, 2 FROM s) GROUP BY ALL)
SELECT user_id, count(*) FILTER (e) AS expected, count(*) FILTER (e AND r) AS present, CASE WHEN NOT bool_or(r) THEN 'processing' WHEN bool_and(e = r AND r = s) THEN 'ready' ELSE 'partial' END AS status FROM k GROUP BY user_id HAVING bool_or(e)""")
def readiness_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.run_readiness(*_state(spark, sf_dir), run="user_id", ensemble=True)


@query(f"""{_STATE}, p AS (SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, lead FROM e) SEMI JOIN r USING (user_id, lead) GROUP BY user_id), q AS (SELECT user_id, count(DISTINCT lead) AS leads FROM r GROUP BY user_id),
d AS (SELECT DISTINCT user_id FROM (SELECT DISTINCT user_id, lead FROM r) ANTI JOIN s USING (user_id, lead) UNION SELECT user_id FROM (SELECT DISTINCT user_id, lead FROM s) ANTI JOIN r USING (user_id, lead))
SELECT user_id, count(DISTINCT lead) AS expected, coalesce(any_value(n), 0) AS present, CASE WHEN any_value(leads) IS NULL THEN 'processing' WHEN coalesce(any_value(n), 0) < count(DISTINCT lead) OR user_id IN (FROM d) THEN 'partial' ELSE 'ready' END AS status
FROM e LEFT JOIN p USING (user_id) LEFT JOIN q USING (user_id) GROUP BY user_id""")
def readiness_by_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.run_readiness(*_state(spark, sf_dir), run="user_id")


@query("SELECT user_id, CAST(ts AS DATE) AS day FROM events GROUP BY ALL HAVING bool_or(value > 60)")
def committed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("day"), F.when(F.col("value") > 60, F.col("value")).alias("value"))
    return catalog.committed(e, ["user_id", "day"])


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def reconcile_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return ingest.stale(_t(spark, sf_dir, "orders").select("o_orderkey"), present, ["o_orderkey"])


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0""")
def upsert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return ingest.upsert(c.where("c_custkey % 3 = 0"), c.where("c_custkey % 2 = 0"), ["c_custkey"])


@query("""SELECT o_orderkey, lead_time_hours FROM (SELECT o_orderkey, o_orderkey % 7 AS lead_time_hours FROM orders WHERE o_orderkey % 7 <> 3 AND o_custkey % 2 = 0
  UNION ALL SELECT o_orderkey, CAST(3 AS BIGINT) FROM orders WHERE o_orderkey % 7 = 3 AND o_custkey % 2 = 1)""")
def merge_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 7).alias("lead_time_hours"))
    new = o.where("o_custkey % 2 = 1 and lead_time_hours = 3").select("o_orderkey", "lead_time_hours")
    return ingest.merge_leads(o.where("o_custkey % 2 = 0").select("o_orderkey", "lead_time_hours"), new)


# Geometry


@query("""WITH c AS (SELECT c_custkey, -90 + (c_custkey % 181) AS lat1, -180 + (c_custkey % 361) AS lon1, -90 + ((c_custkey * 7) % 181) AS lat2, -180 + ((c_custkey * 11) % 361) AS lon2 FROM customer),
h AS (SELECT c_custkey, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2) AS h FROM c)
SELECT c_custkey, round(2 * 6371.0088 * atan2(sqrt(greatest(0.0, least(1.0, h))), sqrt(1 - greatest(0.0, least(1.0, h)))), 4) AS km FROM h""")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    km = geo.haversine_km((k % 181 - 90).cast("double"), (k % 361 - 180).cast("double"), ((k * 7) % 181 - 90).cast("double"), ((k * 11) % 361 - 180).cast("double"))
    return _t(spark, sf_dir, "customer").select("c_custkey", F.round(km, 4).alias("km"))


@query("""WITH c AS (SELECT c_custkey, CAST((c_custkey % 1081) - 540 AS DOUBLE) AS lon FROM customer), m AS (SELECT *, ((lon + 180) % 360 + 360) % 360 - 180 AS x FROM c)
SELECT c_custkey, CASE WHEN x = -180 AND lon > 0 THEN 180.0::DOUBLE ELSE x END AS lon FROM m""")
def normalize_lon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", geo.normalize_longitude((F.col("c_custkey") % 1081 - 540).cast("double")).alias("lon"))


@query("SELECT c_custkey, c_custkey % 200 - 95 BETWEEN -90 AND 90 AND c_custkey % 400 - 190 BETWEEN -180 AND 180 AS valid FROM customer")
def coordinate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", geo.valid_coordinates(F.col("c_custkey") % 200 - 95, F.col("c_custkey") % 400 - 190).alias("valid"))


#: p_partkey 0..199 on 10 rows of 20 nodes, half a degree apart
_GRID = Grid(40.0, -110.0, 0.5, 0.5, 10, 20)
_POINTS = "SELECT c_custkey, 40 + (c_custkey * 37 % 451) / 100.0::DOUBLE AS lat, -110 + (c_custkey * 53 % 951) / 100.0::DOUBLE AS lon FROM customer"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return _t(spark, sf_dir, "customer").select("c_custkey", (F.lit(40) + (k * 37 % 451) / F.lit(100.0)).alias("latitude"), (F.lit(-110) + (k * 53 % 951) / F.lit(100.0)).alias("longitude"))


def _field(spark: SparkSession, sf_dir: str, where: str = "p_partkey < 200") -> DataFrame:
    k = F.col("p_partkey")
    return _t(spark, sf_dir, "part").where(where).select(F.floor(k / 20).cast("int").alias("row"), (k % 20).cast("int").alias("col"), F.col("p_retailprice").alias("value"))


_CELLS = f"""p AS ({_POINTS}), q AS (SELECT *, least(9.0, greatest(0.0, (lat - 40.0) / 0.5)) AS r, least(19.0, greatest(0.0, (lon + 110.0) / 0.5)) AS c FROM p),
k AS (SELECT *, least(8, CAST(floor(r) AS INTEGER)) AS r0, least(18, CAST(floor(c) AS INTEGER)) AS c0 FROM q)"""
_BILINEAR = """v AS (SELECT k.*, a.p_retailprice AS v00, b.p_retailprice AS v01, d.p_retailprice AS v10, e.p_retailprice AS v11, r - r0 AS tr, c - c0 AS tc FROM k
  {j} n a ON a.p_partkey = r0 * 20 + c0 {j} n b ON b.p_partkey = r0 * 20 + c0 + 1 {j} n d ON d.p_partkey = (r0 + 1) * 20 + c0 {j} n e ON e.p_partkey = (r0 + 1) * 20 + c0 + 1)"""
_LERP = "round((v00 + (v01 - v00) * tc) + ((v10 + (v11 - v10) * tc) - (v00 + (v01 - v00) * tc)) * tr, 6)"


ORACLE_SQL["verification_report"] = f"""WITH n AS (SELECT * FROM part WHERE p_partkey < 200), {_CELLS}, {_BILINEAR.format(j="JOIN")}, {_REPORT},
e AS (SELECT {_LERP.removeprefix("round").removesuffix(", 6)")}) + d - observed AS e FROM obs JOIN v ON c_custkey = o_custkey)
SELECT 'price' AS variable_code, round(avg(e), 4) AS bias, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, count(*) AS pairs FROM e"""


@query(f"WITH n AS (SELECT * FROM part WHERE p_partkey < 200), {_CELLS}, {_BILINEAR.format(j='JOIN')} SELECT c_custkey, {_LERP} AS value FROM v")
def bilinear_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(interp.bilinear(_points(spark, sf_dir), _field(spark, sf_dir), _GRID, ["c_custkey"]), "value")


@query(f"WITH n AS (SELECT * FROM part WHERE p_partkey < 200 AND p_partkey % 13 <> 0), {_CELLS}, {_BILINEAR.format(j='LEFT JOIN')} SELECT c_custkey, {_LERP} AS elevation_m FROM v")
def dem_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = interp.elevations(_points(spark, sf_dir), _field(spark, sf_dir, "p_partkey < 200 and p_partkey % 13 <> 0"), _GRID, ["c_custkey"])
    return _rounded(found, "elevation_m").select("c_custkey", "elevation_m")


@query(f"""WITH {_CELLS} SELECT c_custkey, least(9, CAST(floor(r + 0.5) AS INTEGER)) AS row, least(19, CAST(floor(c + 0.5) AS INTEGER)) AS col, p_retailprice AS value
  FROM k JOIN part ON p_partkey = least(9, CAST(floor(r + 0.5) AS INTEGER)) * 20 + least(19, CAST(floor(c + 0.5) AS INTEGER))""")
def nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interp.nearest(_points(spark, sf_dir), _field(spark, sf_dir), _GRID, ["c_custkey"])


@query("SELECT CAST(40.0 AS DOUBLE) AS lat_start, CAST(-110.0 AS DOUBLE) AS lon_start, CAST(0.5 AS DOUBLE) AS lat_step, CAST(0.5 AS DOUBLE) AS lon_step, CAST(10 AS INTEGER) AS rows, CAST(20 AS INTEGER) AS cols, true AS regular")
def derived_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _field(spark, sf_dir).select((F.lit(40.0) + F.col("row") * 0.5).alias("latitude"), (F.lit(250.0) + F.col("col") * 0.5).alias("longitude"))
    return interp.derive_grid(nodes)


# Units, labels, keys

_UNITS = "CASE event_type WHEN 'click' THEN '°C' WHEN 'view' THEN 'mm/h' WHEN 'purchase' THEN 'km/h' ELSE 'hPa' END"


def _unit() -> F.Column:
    t = F.col("event_type")
    return F.when(t == "click", "°C").when(t == "view", "mm/h").when(t == "purchase", "km/h").otherwise("hPa")


@query(f"""WITH e AS (SELECT event_id, value, {_UNITS} AS unit FROM events) SELECT event_id, round(CASE unit WHEN '°C' THEN value * 9 / 5 + 32 WHEN 'mm/h' THEN value / 25.4 WHEN 'km/h' THEN value * 0.621371 ELSE value END, 6) AS value,
  CASE unit WHEN '°C' THEN '°F' WHEN 'mm/h' THEN 'in/h' WHEN 'km/h' THEN 'mph' ELSE unit END AS unit FROM e""")
def units_imperial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", F.round(units.to_imperial(F.col("value"), _unit()), 6).alias("value"), units.imperial_unit(_unit()).alias("unit"))


@query("""SELECT event_id, round(CASE WHEN event_type = 'click' THEN value - 273.15 WHEN event_type = 'view' THEN value * 3600 ELSE value END, 6) AS value FROM events""")
def units_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    source = F.when(t == "click", "K").when(t == "view", "kg m**-2 s**-1")
    target = F.when(t == "click", "°C").when(t == "view", "mm/h").otherwise("hPa")
    return _t(spark, sf_dir, "events").select("event_id", F.round(units.to_canonical(F.col("value"), source, target), 6).alias("value"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('mem%03d_L%04d', l_linenumber, l_partkey % 385) AS region, CAST(l_partkey % 385 AS INTEGER) AS lead, l_linenumber AS member,
  'temperature/' || (l_partkey % 385) || '.' || l_linenumber || '.0' AS chunk FROM lineitem WHERE l_orderkey < 2000""")
def region_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead, member = F.col("l_partkey") % 385, F.col("l_linenumber")
    rows = _t(spark, sf_dir, "lineitem").where("l_orderkey < 2000")
    region = keys.region_id(lead, member)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", region.alias("region"), keys.region_lead(region).alias("lead"), keys.region_member(region).alias("member"), keys.chunk_id(F.lit("temperature"), lead, member, F.lit(0)).alias("chunk"))


@query("""SELECT o_orderkey, sha256('["' || o_orderkey || '",' || CASE WHEN o_custkey % 3 = 0 THEN 'null' ELSE '"' || o_custkey || '"' END || ',"' || CASE WHEN o_custkey % 3 = 1 THEN '' ELSE o_orderstatus END || '"]') AS key FROM orders""")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey") % 3
    return _t(spark, sf_dir, "orders").select("o_orderkey", keys.row_key(F.col("o_orderkey"), F.when(k != 0, F.col("o_custkey")), F.when(k == 1, "").otherwise(F.col("o_orderstatus"))).alias("key"))


@query("""SELECT o_orderkey, sha256('write-set' || o_orderpriority || o_orderstatus || o_clerk) AS write_set, sha256('legacy-region-evidence' || o_orderpriority || o_orderstatus) AS evidence, sha256('schema' || 'latitude' || 'longitude' || o_orderpriority) AS schema,
  sha256(coalesce(CASE WHEN o_custkey % 2 = 0 THEN o_clerk END, '<null>') || o_orderstatus) AS joined FROM (SELECT *, 'Clerk' || o_custkey AS o_clerk FROM orders)""")
def evidence_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").withColumn("o_clerk", F.concat(F.lit("Clerk"), F.col("o_custkey").cast("string")))
    pair = F.array("o_orderstatus", "o_orderpriority")
    return o.select("o_orderkey", keys.write_set_fingerprint(pair, F.array("o_clerk")).alias("write_set"), keys.evidence_fingerprint(pair).alias("evidence"), keys.schema_fingerprint(F.array(F.lit("longitude"), F.lit("latitude")), F.array("o_orderpriority")).alias("schema"), keys.joined_hash(F.when(F.col("o_custkey") % 2 == 0, F.col("o_clerk")), F.col("o_orderstatus")).alias("joined"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'City' WHEN c_custkey % 3 = 0 THEN 'Ski resort' WHEN c_custkey % 5 = 0 THEN 'Coordinates' ELSE 'Station' END AS label, CASE WHEN c_custkey % 2 = 0 THEN 'city' WHEN c_custkey % 3 = 0 THEN 'ski_resort' WHEN c_custkey % 5 = 0 THEN 'coordinates' ELSE 'station' END AS object,
  CASE WHEN c_custkey % 2 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 = 0 THEN c_phone ELSE c_name END AS id, CASE WHEN c_custkey % 2 = 0 THEN 'city' WHEN c_custkey % 3 = 0 THEN 'resort' ELSE 'coordinates' END AS via,
  CASE WHEN c_custkey % 2 = 0 THEN 'city_id=' || c_name WHEN c_custkey % 3 = 0 THEN 'resort_id=' || c_name ELSE 'lat=' || (c_custkey % 90) || '&lon=' || (c_custkey % 180) END AS specifier, '{"c_custkey":' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN ',"c_segment":"' || c_mktsegment || '"' ELSE '' END || '}' AS json
FROM (SELECT *, 'p' || c_custkey AS c_phone FROM customer)""")
def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = _t(spark, sf_dir, "customer").withColumns({"c_phone": F.concat(F.lit("p"), k.cast("string")), "c_segment": F.when(k % 2 == 0, F.col("c_mktsegment"))})
    kind = F.when(k % 2 == 0, "city").when(k % 3 == 0, "ski_resort").when(k % 5 == 0, "place").otherwise("station")
    shown, key, via = present.location(kind, F.col("c_name"), F.col("c_phone"))
    return c.select("c_custkey", present.type_label(shown).alias("label"), shown.alias("object"), key.alias("id"), via.alias("via"), present.specifier(shown, key, k % 90, k % 180).alias("specifier"), present.compact_json("c_custkey", "c_segment").alias("json"))


@query("""SELECT n_name AS variable_code, n_name AS name, 'u' AS unit FROM nation UNION ALL SELECT 'temperature_2m', 'Temperature (2 m)', '°C' UNION ALL SELECT 'precipitation_rate', 'Precipitation Rate', 'mm/h'""")
def variable_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present.variable_meta(_t(spark, sf_dir, "nation").select(F.col("n_name").alias("variable_code"), F.col("n_name").alias("name"), F.lit("u").alias("unit")))


@query("""SELECT p_partkey, list_filter([trim(x) FOR x IN string_split(p_type || ' ,, ' || p_size, ',')], lambda x: x <> '')[1] AS first, len(list_filter([trim(x) FOR x IN string_split(p_type || ' ,, ' || p_size, ',')], lambda x: x <> '')) AS n FROM part""")
def split_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = present.split_list(F.concat("p_type", F.lit(" ,, "), F.col("p_size").cast("string")))
    return _t(spark, sf_dir, "part").select("p_partkey", F.get(parts, F.lit(0)).alias("first"), F.size(parts).cast("bigint").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity > 25 THEN 'gens/prod/gefs.' || strftime(l_shipdate, '%Y%m%d') || '/' || printf('%02d', l_partkey % 4 * 6) || '/atmos/' || CASE WHEN l_suppkey % 385 <= 240 THEN 'pgrb2sp25' ELSE 'pgrb2bp5' END || printf('/gep%02d.t%02dz.pgrb2s.', l_partkey % 30 + 1, l_partkey % 4 * 6) || CASE WHEN l_suppkey % 385 <= 240 THEN '0p25' ELSE '0p50' END || printf('.f%03d', l_suppkey % 385)
  ELSE 'gfs/prod/gfs.' || strftime(l_shipdate, '%Y%m%d') || printf('/%02d/atmos/gfs.t%02dz.pgrb2.0p25.f%03d', l_partkey % 4 * 6, l_partkey % 4 * 6, l_suppkey % 385) END AS file,
  CASE WHEN l_quantity > 25 THEN printf('gep%02d.t%02dz.pgrb2s.0p25.f%03d.grib2', l_partkey % 30 + 1, l_partkey % 4 * 6, l_suppkey % 385) ELSE printf('gfs.t%02dz.pgrb2.0p25.f%03d.grib2', l_partkey % 4 * 6, l_suppkey % 385) END AS staged FROM lineitem WHERE l_orderkey < 2000""")
def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import runs

    ens, hour, lead = F.col("l_quantity") > 25, (F.col("l_partkey") % 4 * 6).cast("int"), (F.col("l_suppkey") % 385).cast("int")
    model, member = F.when(ens, "gefs").otherwise("gfs"), F.when(ens, (F.col("l_partkey") % 30 + 1).cast("int"))
    rows = _t(spark, sf_dir, "lineitem").where("l_orderkey < 2000")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", runs.file_name(model, F.col("l_shipdate"), hour, lead, member).alias("file"), runs.staged_name(model, hour, lead, member).alias("staged"))


_CHUNKS = """SELECT format('det_L{:04d}', CAST(o_orderkey % 50 AS INTEGER)) AS region, unnest(['a/' || (o_orderkey % 50) || '.0.0', 'a/' || (o_orderkey % 50) || '.0.1', 'a/' || (o_orderkey % 50) || '.1.0', 'a/' || (o_orderkey % 50) || '.1.1', 'b/' || MEMBER || '.' || (o_orderkey % 50) || '.0.0']) AS key FROM orders WHERE o_orderkey < 400"""


def _chunks(spark: SparkSession, sf_dir: str, by_member: bool) -> DataFrame:
    lead = (F.col("o_orderkey") % 50).cast("int")
    regions = _t(spark, sf_dir, "orders").where("o_orderkey < 400").select(keys.region_id(lead).alias("region"), lead.alias("lead_index"), (F.col("o_custkey") % 30).cast("int").alias("member_index"))
    arrays = spark.createDataFrame([("a", [50, 100, 200], [1, 64, 128]), ("b", [30, 50, 100, 200], [10, 1, 100, 200])], "name string, shape array<int>, chunks array<int>")
    return commit.chunk_keys(regions, arrays, by_member)


@query(_CHUNKS.replace("MEMBER", "'0'"))
def region_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, False)


@query(_CHUNKS.replace("MEMBER", "(o_custkey % 30 // 10)"))
def region_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, True)


@query(f"""WITH r AS ({_RUNS}) SELECT id FROM r WHERE EXISTS (SELECT 1 FROM orders WHERE CAST(o_custkey AS VARCHAR) = id AND o_orderpriority = '1-URGENT' AND o_orderkey % 9 * 6 = 12)""")
def runs_with_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = _products(spark, sf_dir).withColumn("product_type", F.lit("surface"))
    return record.with_products(_runs(spark, sf_dir)[0], products, "1-URGENT", "surface", 12).select("id")


@query(f"WITH r AS ({_RUNS}) SELECT id, CASE WHEN id = '7' THEN 'partial' WHEN c_acctbal > 0 THEN 'ready' ELSE 'partial' END AS status FROM r")
def downgraded_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record.set_partial(_runs(spark, sf_dir)[0], "7").select("id", "status")


@query("SELECT c_custkey, CAST(trunc(round_even((c_custkey * 37 % 451) / 7.0::DOUBLE, 3) * 1000) AS INTEGER) AS lat_key, CAST(trunc(round_even((c_custkey * 53 % 951) / 7.0::DOUBLE, 3) * 1000) AS INTEGER) AS lon_key FROM customer")
def elevation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = keys.elevation_key(F.col("c_custkey") * 37 % 451 / F.lit(7.0), F.col("c_custkey") * 53 % 951 / F.lit(7.0))
    return _t(spark, sf_dir, "customer").select("c_custkey", lat.alias("lat_key"), lon.alias("lon_key"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(printf('%.2f', p_size * 0.25), '0+$', ''), '\\.$', '') || ' mm/h' AS value, CAST(p_size * 2 AS INTEGER) || '%' AS share FROM part WHERE p_size < 50""")
def value_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").where("p_size < 50").select("p_partkey", keys.value_label(F.col("p_size") * 0.25, F.lit("mm/h")).alias("value"), keys.percent_label(F.col("p_size") / 50.0).alias("share"))


@query("SELECT o_custkey, sha256(string_agg(s, chr(10) ORDER BY s)) AS fingerprint FROM (SELECT DISTINCT o_custkey, o_orderpriority AS s FROM orders) GROUP BY o_custkey")
def set_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(keys.fingerprint(F.collect_set("o_orderpriority")).alias("fingerprint"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(o_orderdate, '%Y-%m-%d %H') || 'Z' AS cycle, '+' || (o_orderkey % 385) || 'h' AS lead,
  o_orderdate + to_hours(CAST(o_orderkey % 385 AS INTEGER)) AS valid_time FROM orders""")
def time_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = (F.col("o_orderkey") % 385).cast("int")
    t = F.col("o_orderdate")
    return _t(spark, sf_dir, "orders").select("o_orderkey", keys.iso_z(t).alias("iso"), keys.cycle_label(t).alias("cycle"), keys.lead_label(lead).alias("lead"), keys.valid_time(t, lead).alias("valid_time"))


@query("""SELECT r_regionkey, unnest(['gfs', 'gfs', 'gfs']) AS model, unnest([1, 2, 3]) AS cycle_date, unnest([0, 6, 12]) AS cycle_hour FROM region""")
def run_spec_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.runs import expand

    specs = expand(spark.range(1).select(F.array(F.lit("gfs")).alias("models"), F.array(*map(F.lit, (1, 2, 3))).alias("dates"), F.array(*map(F.lit, (0, 6, 12))).alias("hours")))
    return _t(spark, sf_dir, "region").select("r_regionkey").crossJoin(F.broadcast(specs))


def _stops_sql(values: str, colours: str) -> str:
    rows = [f"({v}::DOUBLE, {', '.join(str(b) for b in bytes.fromhex(c))})" for v, c in zip(values.split(), colours.split())]
    return f"(SELECT *, lead(v) OVER w AS v1, lead(r) OVER w AS r1, lead(g) OVER w AS g1, lead(b) OVER w AS b1 FROM (VALUES {', '.join(rows)}) t(v, r, g, b) WINDOW w AS (ORDER BY v))"


_T_STOPS = _stops_sql("-40 -20 -5 5 15 25 35 45", "313695 4575b4 74add1 f0f9e8 fed976 fe9929 d94801 a50026")
_P_STOPS = _stops_sql("0 0.5 1 2.5 5 10 20 40", "ffffff c2e699 78c679 31a354 197278 314c8f 7b4173 542788")


def _channel(c: str) -> str:
    return f"CAST(CASE WHEN x IS NULL THEN 0 WHEN v1 IS NULL THEN {c} ELSE floor((x - v) * (({c}1 - {c})::DOUBLE / (v1 - v)) + {c}) END AS INTEGER) AS {c}"


_COLOURED = ", ".join([*map(_channel, "rgb"), "CAST(CASE WHEN x IS NULL THEN 0 ELSE 255 END AS INTEGER) AS a"])


def _heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field in degrees, some nodes absent."""
    return _field(spark, sf_dir, "p_partkey < 200 and p_partkey % 17 <> 5").withColumn("value", F.col("value") % 95 - 45)


@query(f"""WITH p AS (SELECT unnest(range(65536)) AS id), g AS (SELECT CAST(id % 256 AS INTEGER) AS px, CAST(id // 256 AS INTEGER) AS py FROM p),
t AS (SELECT px, py, (px + 12 * 256 + 0.5) / (256 * 64) * 360 - 180 AS lon, degrees(atan(sinh(pi() * (1 - 2 * (py + 23 * 256 + 0.5) / (256 * 64))))) AS lat FROM g),
n AS (SELECT px, py, CASE WHEN lat BETWEEN 40.0 AND 44.5 AND lon BETWEEN -110.0 AND -100.5 THEN CAST(ceil((lat - 40.0) / 0.5 - 0.5) AS INTEGER) * 20 + CAST(ceil((lon + 110.0) / 0.5 - 0.5) AS INTEGER) END AS node FROM t),
f AS (SELECT px, py, CASE WHEN p_retailprice IS NOT NULL THEN least(45.0, greatest(-40.0, p_retailprice % 95 - 45)) END AS x FROM n LEFT JOIN (SELECT * FROM part WHERE p_partkey < 200 AND p_partkey % 17 <> 5) ON p_partkey = node)
SELECT px, py, {_COLOURED} FROM f LEFT JOIN {_T_STOPS} s ON x >= v AND (v1 IS NULL OR x < v1)""")
def tile_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.render(spark, _heat(spark, sf_dir), _GRID, 6, 12, 23, tiles.ramp("temperature_2m"))


@query(f"""WITH p AS (SELECT p_partkey, 't' AS kind, least(45.0, greatest(-40.0, p_size * 2.125 - 50)) AS x FROM part UNION ALL SELECT p_partkey, 'p', least(25.0, greatest(0.0, p_size * 0.625 - 1)) FROM part),
s AS (SELECT 't' AS kind, * FROM {_T_STOPS} UNION ALL SELECT 'p', * FROM {_P_STOPS}) SELECT p_partkey, p.kind, {_COLOURED} FROM p JOIN s ON p.kind = s.kind AND x >= v AND (v1 IS NULL OR x < v1)""")
def colour_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, out = _t(spark, sf_dir, "part"), None
    for kind, code, value in (("t", "temperature_2m", F.col("p_size") * 2.125 - 50), ("p", "precipitation_rate", F.col("p_size") * 0.625 - 1)):
        r, g, b, a = tiles.colour(value, tiles.ramp(code))
        rows = part.select("p_partkey", F.lit(kind).alias("kind"), r.alias("r"), g.alias("g"), b.alias("b"), a.alias("a"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""SELECT 't' AS kind, v AS value, format('#{{:02x}}{{:02x}}{{:02x}}', r, g, b) AS colour, (v + 40) / 85 * 100 AS position FROM {_T_STOPS} UNION ALL SELECT 'p', v, format('#{{:02x}}{{:02x}}{{:02x}}', r, g, b), v / 40 * 100 FROM {_P_STOPS}""")
def legend_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = tiles.legend(spark, "temperature_2m").withColumn("kind", F.lit("t")).unionByName(tiles.legend(spark, "precipitation_rate").withColumn("kind", F.lit("p")))
    return both.select("kind", "value", "colour", "position")


def tile_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNG files of 64 tiles; tests decode them and compare the pixels."""
    asked = spark.createDataFrame([(6, 8 + k % 8, 20 + k // 8) for k in range(64)], "z int, x int, y int")
    return tiles.images(asked, _heat(spark, sf_dir), _GRID, tiles.ramp("temperature_2m"))


QUERIES["tile_images"] = tile_images
