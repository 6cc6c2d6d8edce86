"""Run specifications from manifests and flags, and the addresses of source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInput

MANIFEST = "runs array<struct<model:string,cycle_date:date,cycle_hour:int,lead_time_hours:array<int>,members:array<int>>>"
MAX_RUNS = 16


def read_manifest(spark: SparkSession, path: str, max_runs: int = MAX_RUNS) -> DataFrame:
    """One row for each run of a JSON manifest; malformed files and too many runs raise."""
    runs = spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path, multiLine=True).select(F.explode("runs").alias("r")).select("r.*")
    return limited(runs, max_runs)


def limited(runs: DataFrame, max_runs: int = MAX_RUNS) -> DataFrame:
    if runs.limit(max_runs + 1).count() > max_runs:
        raise InvalidInput(f"more than {max_runs} runs")
    return runs


def expand(specs: DataFrame) -> DataFrame:
    """Columns ``models, dates, hours`` (arrays) are aligned by position; arrays of one element repeat.  No cross product."""
    n = F.greatest(F.size("models"), F.size("dates"), F.size("hours"))
    fill = lambda c: F.when(F.size(c) == 1, F.array_repeat(F.col(c)[0], n)).otherwise(F.col(c))
    even = F.forall(F.array(F.size("models"), F.size("dates"), F.size("hours")), lambda k: (k == 1) | (k == n))
    checked = specs.withColumn("__ok", F.when(even, True).otherwise(F.raise_error(F.lit("flags of unequal length")).cast("boolean"))).where("__ok")
    return checked.select(F.explode(F.arrays_zip(fill("models").alias("model"), fill("dates").alias("cycle_date"), fill("hours").alias("cycle_hour"))).alias("r")).select("r.*")


def items(runs: DataFrame) -> DataFrame:
    """Every lead of every member (null without members) of each run."""
    members = F.when(F.size(F.coalesce("members", F.array().cast("array<int>"))) > 0, F.col("members")).otherwise(F.array(F.lit(None).cast("int")))
    return runs.select("model", "cycle_date", "cycle_hour", F.explode(members).alias("member"), "lead_time_hours").select("model", "cycle_date", "cycle_hour", "member", F.explode("lead_time_hours").alias("lead_time_hours"))


MEMBERS = (1, 30)
#: Leads up to which members come at a quarter of a degree.
SPLIT = 240


def valid_run(model: Column, hour: Column, lead: Column, member: Column | None = None) -> Column:
    """Known model, cycle hour and lead, and for an ensemble a member; null is invalid."""
    ok = model.isin("gfs", "gefs") & hour.isin(0, 6, 12, 18) & lead.between(0, 384)
    if member is not None:
        ok &= (model == "gfs") | member.between(*MEMBERS)
    return F.coalesce(ok, F.lit(False))


def checked_runs(df: DataFrame) -> DataFrame:
    """Rows ``model, cycle_hour, lead_time_hours[, member]`` as they are; raises ``InvalidInput`` with one that is no run."""
    member = F.col("member") if "member" in df.columns else None
    bad = df.where(~valid_run(F.col("model"), F.col("cycle_hour"), F.col("lead_time_hours"), member)).take(1)
    if bad:
        raise InvalidInput(f"no run {bad[0].asDict()}")
    return df


def file_name(model: Column, date: Column, hour: Column, lead: Column, member: Column) -> Column:
    """Address of the source file below the server; members beyond ``SPLIT`` hours come at half a degree.

    Anything but a run raises when the plan is executed.
    """
    hh, fff = F.lpad(hour.cast("string"), 2, "0"), F.lpad(lead.cast("string"), 3, "0")
    day = F.date_format(date, "yyyyMMdd")
    det = F.concat(F.lit("gfs/prod/gfs."), day, F.lit("/"), hh, F.lit("/atmos/gfs.t"), hh, F.lit("z.pgrb2.0p25.f"), fff)
    near = lead <= SPLIT
    folder, degrees = F.when(near, "pgrb2sp25").otherwise("pgrb2bp5"), F.when(near, "0p25").otherwise("0p50")
    ens = F.concat(F.lit("gens/prod/gefs."), day, F.lit("/"), hh, F.lit("/atmos/"), folder, F.lit("/gep"), F.lpad(member.cast("string"), 2, "0"), F.lit(".t"), hh, F.lit("z.pgrb2s."), degrees, F.lit(".f"), fff)
    named = F.when(model == "gefs", ens).otherwise(det)
    return F.when(valid_run(model, hour, lead, member), named).otherwise(F.raise_error(F.lit("no such run")).cast("string"))


def url(base: str, model: Column, date: Column, hour: Column, lead: Column, member: Column) -> Column:
    return F.concat(F.lit(f"{base.rstrip('/')}/pub/data/nccf/com/"), file_name(model, date, hour, lead, member))


def staged_name(model: Column, hour: Column, lead: Column, member: Column) -> Column:
    """Name of the local copy of a file; the same file always has the same name."""
    tail = F.format_string("t%02dz.pgrb2%s.0p25.f%03d.grib2", hour, F.when(member.isNull(), "").otherwise("s"), lead)
    return F.concat_ws(".", F.when(member.isNull(), model).otherwise(F.format_string("gep%02d", member)), tail)
