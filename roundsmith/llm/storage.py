"""Shared folders: where operators write what other executors and the driver read."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local one of our own, but only if driver
    and executors are one process; on a cluster, where others would not see that, this raises."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_to = context._jsc.sc().getCheckpointDir()
        if set_to.isDefined():
            root = set_to.get()
        elif context._jsc.sc().isLocal():
            root = "file://" + tempfile.mkdtemp(prefix="roundsmith-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", root) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is there yet."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a plain path is a local one."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def replace(fs: pafs.FileSystem, own: str, path: str) -> None:
    """Renames a finished file to its final name, also over that of an earlier attempt."""
    try:
        fs.move(own, path)
    except OSError:  # some stores do not rename over a file
        fs.delete_file(path)
        fs.move(own, path)


def put(uri: str, data: bytes) -> None:
    """Writes a whole file under a name of this attempt and then renames it, so that a task that is
    lost or run twice never leaves a part of a file under the final name."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(own, compression=None) as out:
        out.write(data)
    replace(fs, own, path)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: the cut of lineage used here."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def drop(*saved_ones: DataFrame) -> None:
    """Removes what saved() wrote; nothing that is still to be computed may read it."""
    for df in saved_ones:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def sample(rows: DataFrame, n: int, n_bytes: int, by: str | None = None, total: int | None = None) -> list:
    """Whole rows with the least hash of their contents, in its order: at most n different ones with a text (of each
    value of by, if given), and as many of these as have n_bytes of text between them. Keys come first, texts of the
    chosen alone follow, each once however often a row repeats. total: how many rows there are about; of so many only
    those that can be among the least are sorted."""
    key = F.xxhash64(*sorted(rows.columns))
    keyed = rows.where(F.octet_length("text") > 0).select(key.alias("key"), F.octet_length("text").cast("long").alias("size"), (F.col(by) if by else F.lit(0)).alias("by"))
    w, share, least = Window.partitionBy("by").orderBy("key"), 0.0, []
    while len(least) < n and share < 1.0:
        share = min(1.0, max(8 * share, 4 * n / total)) if total else 1.0
        own = keyed if share == 1.0 else keyed.where(F.col("key") < int(2**64 * share) - 2**63)
        least = own.groupBy("by", "key").agg(F.first("size").alias("size")).withColumn("at", F.row_number().over(w)).where(F.col("at") <= n).collect()
    chosen, left = [], {}
    for r in sorted(least, key=lambda r: r["key"]):
        room = left.setdefault(r["by"], n_bytes)
        if r["size"] <= room:
            chosen.append(r["key"])
            left[r["by"]] = room - r["size"]
    if not chosen:
        return []
    found = rows.withColumn("key", key).where(F.col("key").isin(chosen)).groupBy("key").agg(*(F.first(c).alias(c) for c in rows.columns)).collect()
    return sorted(found, key=lambda r: r["key"])


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, from one pass of the JVM over one column."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(F.col(column).cast("string"))), F.lit(0))).first()[0])


#: Rows of an Arrow batch, and of a batch of the Parquet reader: what a worker and its executor hold beside
#: their own arrays stays small where texts are long.
BATCH_ROWS = 500


def settle(spark: SparkSession) -> None:
    """Bounds the batches of this session, unless they are bounded closer already."""
    for key, default in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"), ("spark.sql.parquet.columnarReaderBatchSize", "4096")):
        if not 0 < int(spark.conf.get(key, default)) <= BATCH_ROWS:
            spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    settle(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["shared_root", "fresh", "open_fs", "replace", "put", "saved", "drop", "sample", "text_bytes", "settle", "table"]
