"""Sources and sinks: event tables, the knowledge base, task status, advice logs, settings."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from roundsmith.plans.lineage import saved

EVENT_TYPES = ("round_end", "player_death", "player_blind", "bomb_planted", "smokegrenade_detonate", "inferno_startfire", "hegrenade_detonate")
POSITIONED = ("player_death", "smokegrenade_detonate", "inferno_startfire", "hegrenade_detonate")

#: Folders that the status rows of a version are dealt to by task id; a table keeps the number it began with.
STATUS_BUCKETS = 64


@dataclass(frozen=True)
class Settings:
    """Options with their defaults; the environment's ROUNDSMITH_<NAME> comes before them."""

    knowledge_path: str = "data/knowledge"
    status_path: str = "data/task_status"
    log_path: str = "output/advice"
    landing_path: str = "data/landing"
    time_zone: str = "Asia/Shanghai"
    task_seconds: int = 3600

    @classmethod
    def load(cls, environ: dict | None = None) -> Settings:
        env = os.environ if environ is None else environ
        given = {f.name: env[f"ROUNDSMITH_{f.name.upper()}"] for f in fields(cls) if f"ROUNDSMITH_{f.name.upper()}" in env}
        return cls(**{k: int(v) if k == "task_seconds" else v for k, v in given.items()})


def scan_events(events: DataFrame, kind: str) -> DataFrame:
    """Events of one type from a long table (event_type, ...); positions only where a type has them."""
    rows = events.where(F.col("event_type") == kind).drop("event_type")
    return rows if kind in POSITIONED else rows.drop(*(c for c in rows.columns if c[-2:] in ("_X", "_Y", "_Z")))


def write_events(events: DataFrame, path: str) -> None:
    """Lays events out by type, so that a scan of one type reads its own files alone."""
    events.write.mode("overwrite").partitionBy("event_type").parquet(path)


def read_header(headers: DataFrame) -> DataFrame:
    return headers.withColumn("map_name", F.coalesce("map_name", F.lit("Unknown")))


def seed_documents(spark: SparkSession) -> DataFrame:
    """A small knowledge base: text, map, side, tactic_type."""
    rows = [
        ("Hold mid with a crossfire from window and connector, and save a smoke for the retake of A.", "Mirage", "CT", "Default hold"),
        ("Take banana early with two fire grenades, then use the space for a late B execute.", "Inferno", "Both", "Map control"),
        ("Open mid doors with a flash, split through lower tunnels and long, and plant for long.", "Dust2", "T", "Mid split"),
        ("Win outside with a wall of smokes, then drop secret to pinch the lower site.", "Nuke", "Both", "Vertical split"),
        ("Push slowly through donut while a lurker waits in cave for the rotation.", "Ancient", "T", "Slow push"),
    ]
    return spark.createDataFrame(rows, "text string, map string, side string, tactic_type string")


def write_knowledge(docs: DataFrame, path: str, embed) -> None:
    """Replaces the knowledge base: texts with their vectors and ids from 0 in order of their contents. Rows are
    sorted over many tasks; a row's id is its place in its task and what the tasks before it hold."""
    order = ["text", *(c for c in docs.columns if c != "text")]
    rows = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_task": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    rows = saved(rows, "knowledge")
    counts = sorted(map(tuple, rows.groupBy("_task").count().collect()))  # one row for each task
    before = [(task, sum(n for _, n in counts[:k])) for k, (task, _) in enumerate(counts)]
    at = docs.sparkSession.createDataFrame(before, "_task int, _before long")
    numbered = rows.join(F.broadcast(at), "_task").withColumn("doc_id", F.col("_before") + F.col("_place") - F.shiftleft(F.col("_task").cast("long"), 33))
    numbered.drop("_task", "_place", "_before").withColumn("seq", F.col("doc_id")).withColumn("vec", embed(F.col("text"))).write.mode("overwrite").parquet(path)


def _bucket(task_id: Column) -> Column:
    return F.pmod(F.xxhash64(task_id), F.lit(STATUS_BUCKETS)).cast("int")


def _write_tasks(batch: DataFrame, path: str) -> None:
    """One file for each bucket of task ids that a batch has."""
    batch.withColumn("bucket", _bucket(F.col("task_id"))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def upsert_status(spark: SparkSession, batch: DataFrame, path: str, version: int) -> None:
    """Adds a batch of task results (task_id, status, result, error) under its version; a batch that is
    run again replaces its own files, so the table stays the same."""
    _write_tasks(batch, f"{path}/version={version}")


def accept_tasks(batch: DataFrame, path: str, version: int) -> None:
    """Notes the tasks (task_id, ...) of a batch before they are worked on; the same batch again replaces its own."""
    _write_tasks(batch, f"{path}_accepted/version={version}")


def accepted_tasks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}_accepted")


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, path)
    return fs.exists(p)


def task_status(spark: SparkSession, path: str, task_id: str | None = None) -> DataFrame:
    """The latest row of each task, or of one; result only for SUCCESS, error only for FAILURE. Tasks that were taken
    and have no row yet are STARTED."""
    schema = "task_id string, status string, result string, error string, version int, bucket int"
    rows = spark.read.parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)
    if _exists(spark, f"{path}_accepted"):
        rows = rows.unionByName(accepted_tasks(spark, path).select("task_id", F.lit("STARTED").alias("status"), F.lit(-1).alias("version"), "bucket"), allowMissingColumns=True)
    if task_id is not None:  # the bucket is a folder: the others are not read
        rows = rows.where((F.col("bucket") == _bucket(F.lit(task_id))) & (F.col("task_id") == task_id))
    rows = rows.groupBy("task_id").agg(F.max_by(F.struct("status", "result", "error"), "version").alias("s"))
    return rows.select("task_id", "s.status", F.when(F.col("s.status") == "SUCCESS", F.col("s.result")).alias("result"), F.when(F.col("s.status") == "FAILURE", F.col("s.error")).alias("error"))


def lookup(spark: SparkSession, path: str, task_id: str) -> DataFrame:
    """The status of one task, from the files of its bucket alone."""
    return task_status(spark, path, task_id)


def compact_status(spark: SparkSession, path: str, version: int) -> None:
    """Brings the latest rows of the versions before one into its folder, a file for each bucket, and removes those
    versions. The version must not be the last, which a stream may write again. What a lost run leaves is
    harmless: a row that is there twice is the same row, and rows are moved before any are removed."""
    rows = spark.read.parquet(path)
    if version >= rows.agg(F.max("version")).first()[0]:
        raise ValueError("only versions before the last are compacted")
    newest = rows.where(F.col("version") <= version).groupBy("bucket", "task_id").agg(F.max_by(F.struct("status", "result", "error", "version"), "version").alias("s"))
    own = f"{path}/_compact-{uuid.uuid4().hex}"
    _write_tasks(newest.select("task_id", "s.*").where(F.col("version") < version).drop("version"), own)
    fs, root = _folder(spark, path)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    for folder in fs.listStatus(Path(own)):
        bucket = folder.getPath()
        if bucket.getName().startswith("bucket="):
            target = Path(f"{path}/version={version}/{bucket.getName()}")
            fs.mkdirs(target)
            for file in fs.listStatus(bucket):
                fs.rename(file.getPath(), Path(target, file.getPath().getName()))
    fs.delete(Path(own), True)
    for folder in fs.listStatus(root):
        name = folder.getPath().getName()
        if name.startswith("version=") and int(name.removeprefix("version=")) < version:
            fs.delete(folder.getPath(), True)


def append_log(entries: DataFrame, path: str, key: str) -> None:
    """Appends entries (value) below a key; the same key again replaces its own entries."""
    entries.select("value").write.mode("overwrite").text(f"{path}/{key}")
