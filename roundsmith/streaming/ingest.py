"""Streams of payload files and of recorded matches through the workflow, and rounds from live events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from roundsmith.functions.render import advice_log
from roundsmith.plans import demos, workflow
from roundsmith.plans.lineage import saved
from roundsmith.sources import payloads, tables


def _finish(tasks: DataFrame, state: DataFrame, batch_id: int, settings: tables.Settings) -> None:
    """Status of each task (task_id, match_id, map_name), and the advice of those that have one."""
    state = saved(state, "state")
    tables.upsert_status(state.sparkSession, workflow.task_results(state), settings.status_path, batch_id)
    entries = state.select(F.col("match_id").alias("task_id"), "coach_advice").where("coach_advice is not null").join(tasks.select("task_id", "match_id", "map_name"), "task_id")
    tables.append_log(entries.select(advice_log(F.col("task_id"), F.col("match_id"), F.col("map_name"), F.col("coach_advice")).alias("value")), settings.log_path, f"batch={batch_id}")


def process_batch(raw: DataFrame, batch_id: int, settings: tables.Settings, retrieve: Callable, provider=None) -> None:
    """Validates a batch of payload texts, gives out task ids, runs the workflow and writes status, log and
    rejects. What it writes is keyed by the batch, so that a batch that is run again leaves the same tables. Each
    payload is a task of its own, also where a match_id or a whole payload comes twice."""
    parsed = saved(payloads.parse_payloads(raw).drop("v"), "payloads")
    parsed = parsed.withColumn("v", F.try_parse_json("raw"))
    payloads.quarantined(parsed).write.mode("overwrite").json(f"{settings.status_path}_rejects/batch={batch_id}")
    tasks = saved(payloads.enqueued(payloads.accepted(parsed), batch_id), "tasks")
    at = F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), settings.time_zone), "yyyy-MM-dd HH:mm:ss")
    tables.accept_tasks(payloads.acknowledged(tasks).withColumn("accepted_at", at), settings.status_path, batch_id)
    _finish(tasks, workflow.run(tasks.select(F.col("task_id").alias("match_id"), "raw_data"), retrieve, provider), batch_id, settings)


def process_demos(files: DataFrame, batch_id: int, settings: tables.Settings, retrieve: Callable, decoder: str, provider=None) -> None:
    """Stores a batch of uploaded files (path, content), decodes them and runs the workflow; keyed as process_batch. Each
    file of the landing folder is an upload and a task of its own, also where names and contents are equal."""
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("path").alias("upload"), "content")
    stored = saved(payloads.store_uploads(named, settings.landing_path + "_demos"), "uploads")
    stored.where("error is not null").write.mode("overwrite").json(f"{settings.status_path}_rejects/batch={batch_id}")
    good = stored.where("error is null")
    events = saved(demos.read(files.sparkSession, good, decoder), "events")
    ids = good.select(payloads.task_id(F.lit(batch_id), F.col("temp_filename")).alias("task_id"), F.substring_index("temp_filename", ".", 1).alias("match_id"), "temp_filename")
    tables.accept_tasks(payloads.acknowledged(ids), settings.status_path, batch_id)
    ids = ids.drop("temp_filename")
    state = saved(demos.analyse(events, retrieve, provider), "demo-state").withColumnRenamed("match_id", "of")
    tasks = saved(ids.join(state.select("of", "map_name"), ids["match_id"] == F.col("of"), "left").drop("of"), "tasks")
    done = ids.join(state, ids["match_id"] == state["of"], "left").drop("match_id", "of").withColumnRenamed("task_id", "match_id")
    _finish(tasks, done, batch_id, settings)


def start(spark: SparkSession, settings: tables.Settings, retrieve: Callable, provider=None, once: bool = True) -> StreamingQuery:
    """A stream over the landing folder: one file holds one payload. once: what is there, then stop."""
    raw = spark.readStream.option("wholetext", True).text(settings.landing_path)
    out = raw.writeStream.option("checkpointLocation", f"{settings.status_path}_stream").foreachBatch(lambda df, k: process_batch(df, k, settings, retrieve, provider))
    return (out.trigger(availableNow=True) if once else out).start()


def start_demos(spark: SparkSession, settings: tables.Settings, retrieve: Callable, decoder: str, provider=None, once: bool = True) -> StreamingQuery:
    """A stream over uploaded files below the landing folder; what is no .dem file is refused."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(settings.landing_path)
    out = files.writeStream.option("checkpointLocation", f"{settings.status_path}_stream").foreachBatch(lambda df, k: process_demos(df, k, settings, retrieve, decoder, provider))
    return (out.trigger(availableNow=True) if once else out).start()


def await_within(query: StreamingQuery, settings: tables.Settings) -> None:
    """Waits for a stream to end, for at most the time that tasks may take; beyond it the stream is stopped."""
    if not query.awaitTermination(settings.task_seconds):
        query.stop()
        raise TimeoutError(f"not done within {settings.task_seconds} s")


def live_round_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Kills and rounds by match and window from a stream of events (ts, match_id, event_type); events
    later than the watermark are dropped."""
    seen = events.withWatermark("ts", late).groupBy(F.window("ts", window), "match_id")
    out = seen.agg(F.count_if(F.col("event_type") == "player_death").alias("kills"), F.count_if(F.col("event_type") == "round_end").alias("rounds"))
    return out.select(F.col("window.start").alias("start"), "match_id", "kills", "rounds")
