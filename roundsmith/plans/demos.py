"""Recorded matches to advice: decoded events, rounds, payloads, and the workflow that payloads go through."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from roundsmith.functions.render import match_json
from roundsmith.functions.scalar import truncated
from roundsmith.operators import rounds
from roundsmith.plans import workflow
from roundsmith.sources import payloads
from roundsmith.sources.demo import DECODE_ERROR, DemoSource, decoded

#: Fields of each event type: name, type, and what stands for one that the recording does not have.
FIELDS = {
    "round_end": [("winner", "string", "Unknown"), ("reason", "string", "Unknown")],
    "player_death": [("attacker_name", "string", "Environment"), ("user_name", "string", "Unknown"), ("weapon", "string", "Unknown"), ("headshot", "boolean", None), *((f"{who}_{axis}", "double", None) for who in ("user", "attacker") for axis in "XYZ")],
    "player_blind": [("user_name", "string", "Unknown"), ("attacker_name", "string", "Unknown"), ("blind_duration", "double", 0.0)],
    "bomb_planted": [("user_name", "string", "Unknown"), ("site", "string", "Unknown")],
}
GRENADES = ("smokegrenade_detonate", "inferno_startfire", "hegrenade_detonate")
FIELDS |= {kind: [("user_name", "string", "Unknown"), *((f"user_{axis}", "double", None) for axis in "XYZ")] for kind in GRENADES}


def events_of(events: DataFrame, kind: str) -> DataFrame:
    """match_id, seq, tick and the fields of one event type, from decoded events (props: JSON)."""

    def field(name: str, to: str, default) -> Column:
        value = F.get_json_object("props", f"$.{name}").cast(to)
        return F.when(F.array_contains(F.json_object_keys("props"), name), value).otherwise(F.lit(default).cast(to)).alias(name)

    return events.where(F.col("event_type") == kind).select("match_id", "seq", "tick", *(field(*f) for f in FIELDS[kind]))


def documents(events: DataFrame) -> DataFrame:
    """match_id, map_name, rounds: the document of each decoded match that has a round."""
    of = lambda kind: events_of(events, kind)
    bounds = rounds.round_bounds(of("round_end"))
    header = events.where("event_type = 'header'").groupBy("match_id").agg(F.min_by(F.get_json_object("props", "$.map_name"), "seq").alias("map_name"))
    return rounds.match_documents(header, bounds, rounds.kills(of("player_death"), bounds), rounds.grenades(*(of(k) for k in GRENADES), bounds), rounds.blinds(of("player_blind"), bounds), rounds.plants(of("bomb_planted"), bounds))


def read(spark: SparkSession, files: DataFrame | list[str], decoder: str) -> DataFrame:
    """Decoded events of .dem files: of a few paths, or of a table of them (path), which stays distributed."""
    if isinstance(files, DataFrame):
        return decoded(files, decoder)
    spark.dataSource.register(DemoSource)
    return spark.read.format("demo").option("decoder", decoder).option("paths", json.dumps(files)).load()


def tasks(events: DataFrame, cut: bool = False) -> DataFrame:
    """match_id, map_name, n_rounds, raw_data, error: the payload text of each decoded match (cut to the local
    limit if asked), or why there is none: the decoder failed, or the recording holds no rounds."""
    failed = events.where(F.col("event_type") == DECODE_ERROR).select("match_id", F.get_json_object("props", "$.error").alias("failure"))
    whole = payloads.demo_payload(documents(events).withColumn("filename", F.concat("match_id", F.lit(".dem"))))
    every = events.select("match_id").distinct().join(whole, "match_id", "left").join(failed, "match_id", "left")
    text = match_json(F.col("match_id"), F.col("map_name"), F.col("rounds"))
    extra = F.concat(F.lit(', "extra_data": '), F.to_json("extra_data"), F.lit("}"))
    text = F.concat(F.substring(text, F.lit(1), F.length(text) - 1), extra)
    error = F.coalesce("failure", "error", F.when(F.coalesce(F.size("rounds"), F.lit(0)) <= 0, "ValueError: the demo holds no rounds"))
    return every.select("match_id", F.coalesce("map_name", F.lit("unknown")).alias("map_name"), F.coalesce(F.size("rounds"), F.lit(0)).alias("n_rounds"), F.when(error.isNull(), truncated(text) if cut else text).alias("raw_data"), error.alias("error"))


def analyse(events: DataFrame, retrieve: Callable, provider=None, cut: bool = False) -> DataFrame:
    """The final state of each decoded match, with map_name and n_rounds; one that failed has its error alone."""
    from roundsmith.plans.lineage import saved

    every = saved(tasks(events, cut), "demo-tasks")
    state = workflow.run(every.where("error is null").select("match_id", "raw_data"), retrieve, provider)
    return every.select("match_id", "map_name", "n_rounds", F.col("error").alias("failure")).join(state, "match_id", "left").withColumn("error", F.coalesce("failure", "error")).drop("failure")
