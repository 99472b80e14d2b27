"""Publishing the result: tables with fixed schemas, flattened rules, a run summary and drill-downs."""

from __future__ import annotations

import datetime
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Versions that `vacuum` leaves: readers of the last one go on while the next is committed.
KEEP = 2


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was based on the predecessor of."""


def _at(spark: SparkSession, path: str):
    """The file system of path, in any store that Spark reads, and the path in it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def stamps(spark: SparkSession, paths: list[str]) -> tuple:
    """Files under the paths with size and time of change: differs when a table has been written again."""
    out = []
    for path in paths:
        fs, where = _at(spark, path)
        found = list(fs.listStatus(where)) if fs.exists(where) else []
        out += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found]
    return tuple(sorted(out))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers under which something was committed, in order."""
    fs, where = _at(spark, f"{path}/_versions")
    if not fs.exists(where):
        return []
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(where) if f.getPath().getName().isdigit())


def _read(spark: SparkSession, path: str, number: int) -> dict | None:
    """What a version says; None for one that its writer did not complete."""
    fs, where = _at(spark, f"{path}/_versions/{number:012d}")
    stream = fs.open(where)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return json.loads(text) if text.endswith("\n") else None


def manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number of the last version under path and what it says (table -> folder, and facts); -1 and nothing before the first."""
    numbers = versions(spark, path)
    for number in reversed(numbers):
        if (found := _read(spark, path, number)) is not None:
            return numbers[-1], found
    return (numbers[-1] if numbers else -1), {}


def commit(spark: SparkSession, path: str, number: int, says: dict) -> None:
    """Makes `says` version `number`; of several writers of one number the first succeeds, the others get Conflict.

    The file is created only if it is not there, and counts once its last line is complete. HDFS decides this itself in
    `create`; Hadoop's local file system looks first and creates then, so there the file is opened exclusively by the
    operating system. A store whose `create` is not exclusive either needs a single writer.
    """
    fs, where = _at(spark, f"{path}/_versions/{number:012d}")
    text = json.dumps(says) + "\n"
    taken = f"version {number} of {path} is there"
    if fs.getUri().getScheme() == "file":
        fs.mkdirs(where.getParent())
        try:
            with open(where.toUri().getPath(), "x", encoding="utf-8") as file:
                file.write(text)
        except FileExistsError as error:
            raise Conflict(taken) from error
        return
    try:
        stream = fs.create(where, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName() or fs.exists(where):
            raise Conflict(taken) from error
        raise
    stream.write(text.encode())
    stream.close()


def write(df: DataFrame, path: str, by: str | None = None, sort: list[str] | None = None) -> tuple[str, int]:
    """Writes a table of a new version under path; its folder, and its rows as they were counted while they were written."""
    folder, seen = uuid.uuid4().hex, Observation()
    df = df.observe(seen, F.count(F.lit(1)).alias("n"))
    if by or sort:
        df = df.sortWithinPartitions(*([by] if by else []), *(sort or []))
    (df.write.partitionBy(by) if by else df.write).parquet(f"{path}/{folder}")
    return folder, seen.get["n"]


def publish(tables: dict[str, DataFrame], path: str, partition: dict[str, str] | None = None, order: dict[str, list[str]] | None = None, carry: bool = False, facts: dict | None = None) -> dict[str, int]:
    """Replaces the snapshot under path and returns rows per table.

    All tables go to new folders first; one version file names them once they are complete, so that readers see the
    whole old or the whole new snapshot, and a failed run leaves the old one. With `carry` the other tables of the last
    version stay in the new one, for a refresh of some tables as one commit. A writer whose version another one has taken
    meanwhile gets Conflict, and nothing of it is seen. `order` sorts rows within files for lookups; `facts` go with the version.
    """
    spark = next(iter(tables.values())).sparkSession
    number, held = manifest(spark, path)
    says, out = {**(held if carry else {}), **(facts or {})}, {}
    for name, df in tables.items():
        says[name], out[name] = write(df, path, (partition or {}).get(name), (order or {}).get(name, []))
    commit(spark, path, number + 1, says)
    return out


def published(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{manifest(spark, path)[1][name]}")


def refresh(path: str, ownership: DataFrame, order: DataFrame | None = None, written_at: str | None = None, key: str = "platform_id") -> DataFrame:
    """One commit of the tables that change during a draft, and the keys that are newly held since the version before.

    ownership, the draft's order where it is given, and the stamp go to one version; the other tables of the snapshot stay
    as they are. Without a snapshot under path it fails, as there is nothing to refresh.
    """
    spark = ownership.sparkSession
    number, held = manifest(spark, path)
    if number < 0:
        raise FileNotFoundError(f"no snapshot under {path}")
    before = spark.read.parquet(f"{path}/{held['ownership']}").select(key) if "ownership" in held else ownership.select(key).limit(0)
    stamp = written_at or datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds")
    publish({"ownership": ownership, **({"draft": order} if order is not None else {})}, path, carry=True, facts={"written_at": stamp})
    now = published(spark, path, "ownership").select(key).filter(F.col(key).isNotNull()).distinct()
    return now.join(before, key, "left_anti")


def vacuum(spark: SparkSession, path: str, keep: int = KEEP) -> int:
    """Removes all versions but the last `keep`, and folders that none of these names; returns how many folders went.

    Folders that are being written belong to no version yet; so only one writer may vacuum, after its own commit.
    """
    fs, where = _at(spark, path)
    numbers = versions(spark, path)
    left = [v for v in (_read(spark, path, n) for n in numbers[-keep:]) if v]
    named = json.dumps(left)
    for number in numbers[:-keep]:
        fs.delete(_at(spark, f"{path}/_versions/{number:012d}")[1], False)
    gone = [f.getPath() for f in fs.listStatus(where) if f.isDirectory() and not f.getPath().getName().startswith("_") and f.getPath().getName() not in named]
    for folder in gone:
        fs.delete(folder, True)
    return len(gone)


def as_views(tables: dict[str, DataFrame]) -> None:
    """Tables as temporary views, for ad-hoc SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def slots_table(slots: DataFrame, baselines: DataFrame) -> DataFrame:
    """(kind, name, count): starting slots of slots(slot) counted, and baselines(pos, baseline)."""
    one = slots.groupBy(F.col("slot").alias("name")).agg(F.count("*").alias("count")).select(F.lit("slot").alias("kind"), "name", "count")
    return one.unionByName(baselines.select(F.lit("replacement").alias("kind"), F.col("pos").alias("name"), F.col("baseline").cast("long").alias("count")))


def flat_rules(base: DataFrame, overlays: DataFrame, left: DataFrame) -> DataFrame:
    """base(stat, points) as ALL, overlays(pos, stat, points), left(key, value) as not projected."""
    rows = base.select(F.lit("ALL").alias("pos"), "stat", "points", F.lit(1).alias("projected"))
    rows = rows.unionByName(overlays.select("pos", "stat", "points", F.lit(1).alias("projected")))
    return rows.unionByName(left.select(F.lit("ALL").alias("pos"), F.col("key").alias("stat"), F.col("value").alias("points"), F.lit(0).alias("projected")))


def stacked(frames: list[DataFrame]) -> DataFrame:
    """Frames with ragged columns as one."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def run_summary(board: DataFrame, lines: DataFrame) -> DataFrame:
    """One row: most entities of a method, the sources as text, when it was written."""
    most = board.groupBy("avg_type").count().agg(F.max("count").alias("entities"))
    # one value a source before they meet in one row
    names = lines.select("data_src").distinct().agg(F.array_join(F.array_sort(F.collect_list("data_src")), ", ").alias("sources"))
    return most.join(F.broadcast(names)).withColumn("written_at", F.current_timestamp())  # one row each


def drill_down(lines: DataFrame, metrics: list[str], entity: int | None = None) -> DataFrame:
    """(id, stat, data_src, value) of all metrics that a source projects, for one entity or all."""
    rows = lines if entity is None else lines.filter(F.col("id") == entity)
    return rows.unpivot(["id", "data_src"], metrics, "stat", "value").filter("value is not null")


def wide(drill: DataFrame, sources: list[str]) -> DataFrame:
    """Stat by source table of a drill-down."""
    return drill.groupBy("id", "stat").pivot("data_src", sources).agg(F.max("value"))
