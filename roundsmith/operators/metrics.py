"""Player and round metrics from assembled rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def first_kill_rate(kills: DataFrame, bounds: DataFrame) -> DataFrame:
    """match_id, player, first_kills, first_deaths, n_rounds, first_kill_rate, first_death_rate."""
    n = bounds.groupBy("match_id").agg(F.count("*").alias("n_rounds"))
    first = kills.where("is_first_kill")
    sides = first.select("match_id", F.col("killer").alias("player"), F.lit(1).alias("k"), F.lit(0).alias("d")).unionByName(first.select("match_id", F.col("victim").alias("player"), F.lit(0).alias("k"), F.lit(1).alias("d")))
    per = sides.groupBy("match_id", "player").agg(F.sum("k").alias("first_kills"), F.sum("d").alias("first_deaths")).join(n, "match_id")
    rate = lambda c: F.round(F.col(c) / F.col("n_rounds"), 9)
    return per.select("match_id", "player", "first_kills", "first_deaths", "n_rounds", rate("first_kills").alias("first_kill_rate"), rate("first_deaths").alias("first_death_rate"))


def multikill_rounds(kills: DataFrame) -> DataFrame:
    """match_id, player, multikill_rounds, most_kills: rounds with two kills and more."""
    per = kills.groupBy("match_id", "round_number", F.col("killer").alias("player")).agg(F.count("*").alias("n"))
    return per.groupBy("match_id", "player").agg(F.count_if(F.col("n") >= 2).alias("multikill_rounds"), F.max("n").alias("most_kills"))


def player_totals(kills: DataFrame) -> DataFrame:
    """match_id, player, kills, deaths, headshots, kd_ratio, headshot_rate. Damage is not among the
    events, so average damage and rating are null."""
    hs = F.coalesce(F.col("is_headshot").cast("int"), F.lit(0))
    sides = kills.select("match_id", F.col("killer").alias("player"), F.lit(1).alias("k"), F.lit(0).alias("d"), hs.alias("h")).unionByName(kills.select("match_id", F.col("victim").alias("player"), F.lit(0).alias("k"), F.lit(1).alias("d"), F.lit(0).alias("h")))
    per = sides.groupBy("match_id", "player").agg(F.sum("k").alias("kills"), F.sum("d").alias("deaths"), F.sum("h").alias("headshots"))
    none = F.lit(None).cast("double")
    return per.select("match_id", "player", "kills", "deaths", "headshots", F.round(F.try_divide("kills", "deaths"), 9).alias("kd_ratio"), F.round(F.try_divide("headshots", "kills"), 9).alias("headshot_rate"), none.alias("adr"), none.alias("rating"))


def kast(kills: DataFrame, bounds: DataFrame, trade_ticks: int) -> DataFrame:
    """match_id, player, n_rounds, kill_rounds, survived_rounds, traded_rounds, kast: the share of rounds in which
    a player killed, survived, or died to one who died in turn within trade_ticks of the same round. Assists are not
    among the events, so the share is a lower bound. Players are those that kill or die in the match."""
    key = ["match_id", "round_number", "player"]
    died = kills.select("match_id", "round_number", F.col("victim").alias("player"), "killer", "tick")
    revenge = kills.select("match_id", "round_number", F.col("victim").alias("killer"), F.col("tick").alias("then"))
    traded = died.join(revenge, ["match_id", "round_number", "killer"]).where((F.col("then") > F.col("tick")) & (F.col("then") <= F.col("tick") + trade_ticks))
    tag = lambda rows, name: rows.select(*key, F.lit(name).alias("tag"))
    seen = tag(kills.withColumnRenamed("killer", "player"), "k").union(tag(died, "d")).union(tag(traded, "t"))
    flags = seen.groupBy(key).agg(*(F.bool_or(F.col("tag") == x).alias(x) for x in "kdt"))
    grid = flags.select("match_id", "player").distinct().join(bounds.select("match_id", "round_number"), "match_id")
    rows = grid.join(flags, key, "left").select("match_id", "player", F.coalesce("k", F.lit(False)).alias("k"), (~F.coalesce("d", F.lit(False))).alias("s"), F.coalesce("t", F.lit(False)).alias("t"))
    n = F.count_if
    return rows.groupBy("match_id", "player").agg(F.count("*").alias("n_rounds"), n("k").alias("kill_rounds"), n("s").alias("survived_rounds"), n("t").alias("traded_rounds"), F.round(n(F.col("k") | F.col("s") | F.col("t")) / F.count("*"), 9).alias("kast"))


def utility_usage(grenades: DataFrame) -> DataFrame:
    """match_id, type, uses, throwers."""
    return grenades.groupBy("match_id", "type").agg(F.count("*").alias("uses"), F.count_distinct("thrower").alias("throwers"))


def blind_time(blinds: DataFrame) -> DataFrame:
    """match_id, attacker, blinds, blind_seconds."""
    return blinds.groupBy("match_id", "attacker").agg(F.count("*").alias("blinds"), F.round(F.sum("blind_duration"), 6).alias("blind_seconds"))


def plants_by_site(plants: DataFrame) -> DataFrame:
    return plants.groupBy("match_id", "site").agg(F.count("*").alias("plants"))


def round_wins(bounds: DataFrame) -> DataFrame:
    return bounds.groupBy("match_id", "winner", "reason").agg(F.count("*").alias("wins"))
