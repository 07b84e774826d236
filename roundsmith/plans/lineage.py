"""Cutting lineage: reliable checkpoints and written tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, one of our own, but only if driver and
    executors are one process; on a cluster, where others would not see a local folder, this raises."""
    context = spark.sparkContext._jsc.sc()
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and context.getCheckpointDir().isDefined():
        root = context.getCheckpointDir().get()
    if not root:
        if not context.isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="roundsmith-")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint of df. What follows has a short plan, and survives the loss of an executor."""
    shared_root(df.sparkSession)
    return df.checkpoint()


#: Spark's setting by which a query's shuffle files go when it ends; without it they stay until the driver collects its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of the shared folder, by Zstandard. What follows computes it once, however often it is read, and
    Spark knows its size when it picks a join. Nothing reads the shuffle files of the writing again, so they go with it."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    given = conf.get(CLEAN, None)
    conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEAN, given) if given is not None else conf.unset(CLEAN)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes what saved() wrote; nothing that is still to be computed may read it."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
