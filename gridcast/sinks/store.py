"""Generations of a run's store: sets of regions (variable, lead, member) that never change once written.

Files lie under ``data/write=<id>/<region>``; a generation is a list that says
from which write each region comes.  A writer adds files, then a list, and at last
renames the pointer to the list into place, so a reader sees one complete
generation before and after, whatever a writer does.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import LiveStore, NotFound, StoreMismatch

PARTITIONS = ["variable_code", "lead_time_hours", "member_part"]


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def store_path(model: str, cycle: str, root: str) -> str:
    return f"{root}/{model}/{cycle.replace(':', '').replace(' ', 'T')}"


def check_store_path(path: str | None, model: str, cycle: str, root: str, custom: bool = False) -> str:
    """The path that follows from the run, unless another one is asked for with ``custom``."""
    own = store_path(model, cycle, root)
    if path in (None, own) or custom:
        return path or own
    raise StoreMismatch(f"{path} is not the store of {model} {cycle}")


def write_object(spark: SparkSession, path: str, text: str) -> None:
    """A small file, replaced in one step."""
    jvm = spark._jvm
    fs, target = _path(spark, path)
    fs.mkdirs(target.getParent())
    _, draft = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    how = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, how)


def read_object(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _write(values: DataFrame, path: str) -> dict[str, str]:
    """Writes the regions, sorted by node so that row-group statistics prune boxes; says which write holds each."""
    spark, write = values.sparkSession, uuid.uuid4().hex
    parted = values.withColumn("member_part", F.coalesce(F.col("member").cast("string"), F.lit("none")))
    parted.repartition(*PARTITIONS).sortWithinPartitions(*PARTITIONS, "row", "col").write.partitionBy(*PARTITIONS).parquet(f"{path}/data/write={write}")
    return {region: write for region in _regions(spark, f"{path}/data/write={write}")}


def _regions(spark: SparkSession, folder: str) -> list[str]:
    """Region folders below one write, from listings."""
    fs, _ = _path(spark, folder)
    found = [""]
    for _ in PARTITIONS:
        found = [f"{f}/{s.getPath().getName()}".lstrip("/") for f in found for s in fs.listStatus(_path(spark, f"{folder}/{f}")[1]) if s.isDirectory()]
    return sorted(found)


def _publish(spark: SparkSession, path: str, regions: dict[str, str], before: str | None) -> str:
    generation = uuid.uuid4().hex
    write_object(spark, f"{path}/generations/{generation}.json", json.dumps({"regions": regions, "before": before}, sort_keys=True))
    write_object(spark, f"{path}/pointer.json", json.dumps({"generation": generation}))
    return generation


def write_generation(values: DataFrame, path: str, live: bool = False) -> str:
    """A generation of these values alone.  A live store refuses."""
    if live:
        raise LiveStore(f"{path} is served; patch its regions instead")
    return _publish(values.sparkSession, path, _write(values, path), None)


def generation(spark: SparkSession, path: str) -> str:
    """Name of the current generation; a pointer that can't be read raises, it is never taken for none."""
    text = read_object(spark, f"{path}/pointer.json")
    if text is None:
        raise NotFound(f"no store at {path}")
    try:
        found = json.loads(text)["generation"]
    except (ValueError, KeyError, TypeError) as e:
        raise StoreMismatch(f"the pointer of {path} is damaged") from e
    if not isinstance(found, str) or not found:
        raise StoreMismatch(f"the pointer of {path} names no generation")
    return found


def regions(spark: SparkSession, path: str, which: str | None = None) -> dict[str, str]:
    """Region folder and write of the current generation, or of the one named."""
    text = read_object(spark, f"{path}/generations/{which or generation(spark, path)}.json")
    if text is None:
        raise NotFound(f"no generation {which} at {path}")
    return json.loads(text)["regions"]


def read(spark: SparkSession, path: str, which: str | None = None) -> DataFrame:
    """The current generation, or the one named; later patches don't touch what is read."""
    found = regions(spark, path, which)
    base = f"{path}/data"
    return spark.read.option("basePath", base).parquet(*[f"{base}/write={w}/{r}" for r, w in sorted(found.items())]).drop("member_part", "write")


def read_ready(runs: DataFrame, run_id: str, path: str | None = None) -> DataFrame:
    """The store of a run that is ready now and, if ``path`` is given, still served from there."""
    rows = runs.where((F.col("id") == run_id) & (F.col("status") == "ready")).select("zarr_store_path").take(1)
    if not rows or not rows[0][0] or path not in (None, rows[0][0]):
        raise NotFound(f"run {run_id!r} is not served")
    return read(runs.sparkSession, rows[0][0])


def patch(values: DataFrame, path: str) -> str:
    """A generation in which the regions of ``values`` replace those of the current one; doing it twice changes no value."""
    spark = values.sparkSession
    now = generation(spark, path)
    return _publish(spark, path, regions(spark, path, now) | _write(values, path), now)


def commit_region(values: DataFrame, path: str, lead: int, member: int | None = None) -> str:
    """One region from one source file: the member is set, the lead checked, the store begun if there is none."""
    leads = {r[0] for r in values.select("lead_time_hours").distinct().limit(2).collect()}
    if leads != {lead}:
        raise StoreMismatch(f"leads {sorted(leads)} instead of {lead}")
    pinned = values.withColumn("member", F.lit(member).cast("int"))
    return patch(pinned, path) if exists(values.sparkSession, f"{path}/pointer.json") else write_generation(pinned, path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Objects of the current generation: ``(region, path, bytes)``, from one listing of each region."""
    fs, _ = _path(spark, path)
    rows = []
    for region, write in sorted(regions(spark, path).items()):
        rows += [(region, str(s.getPath()), s.getLen()) for s in fs.listStatus(_path(spark, f"{path}/data/write={write}/{region}")[1]) if str(s.getPath()).endswith(".parquet")]
    return spark.createDataFrame(rows, "region string, path string, bytes long")
