"""Round assembly: game events cut into the tick intervals of their match's rounds.

A round's interval is half open, from the end of the round before it in row order (0 for the first,
exclusive) to its own end (inclusive). Events at tick 0 or less, and after the last end, belong to no
round; where ends fall, intervals overlap and an event lies in several rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from roundsmith.functions.scalar import nan_to_null

GRENADES = ("Smoke", "Molotov/Incendiary", "HE")


def has(df: DataFrame, name: str, default, kind: str) -> Column:
    """A column, or a default where the table has no such column; nulls stay."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(default).cast(kind)


def round_bounds(round_end: DataFrame) -> DataFrame:
    """match_id, round_number, lo, hi, winner, reason from round ends (match_id, seq, tick, ...)."""
    w = Window.partitionBy("match_id").orderBy("seq")
    return round_end.select(
        "match_id",
        F.row_number().over(w).alias("round_number"),
        F.lag("tick", 1, 0).over(w).alias("lo"),
        F.col("tick").alias("hi"),
        has(round_end, "winner", "Unknown", "string").alias("winner"),
        has(round_end, "reason", "Unknown", "string").alias("reason"),
    )


def in_rounds(events: DataFrame, bounds: DataFrame) -> DataFrame:
    """Events with their round_number: the interval join, by match and tick. Spark keeps the match as
    the join key, so that a match with very many events is split when partitions are uneven."""
    b = bounds.select(F.col("match_id").alias("m"), "round_number", "lo", "hi")
    return events.join(b, (events["match_id"] == b["m"]) & (events["tick"] > b["lo"]) & (events["tick"] <= b["hi"])).drop("m", "lo", "hi")


def in_rounds_sorted(events: DataFrame, bounds: DataFrame) -> DataFrame:
    """As in_rounds, in one sort of each match; right only where a match's ends never fall. Of rounds
    with one end the first takes the events."""
    ends = bounds.groupBy("match_id", F.col("hi").alias("tick")).agg(F.min("round_number").alias("end_round"), F.min("lo").alias("lo"))
    both = events.withColumns({"end_round": F.lit(None).cast("int"), "lo": F.lit(None).cast("long")}).unionByName(ends, allowMissingColumns=True)
    later = Window.partitionBy("match_id").orderBy(F.col("tick"), F.col("end_round").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("round_number", F.first("end_round", ignorenulls=True).over(later)).where("end_round is null and round_number is not null")
    return found.where("tick > 0").drop("end_round", "lo")


def _binned(events: DataFrame, bounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and rounds with the bins (of the mean length of a round) that they lie in: one for an event; rounds
    have less than twice as many as there are rounds."""
    held = bounds.where("hi > lo")
    width = held.agg(F.greatest(F.lit(1), F.ceil(F.avg(F.col("hi") - F.col("lo")))).cast("long")).scalar()
    at = lambda tick: F.floor(tick / F.col("width"))
    rows = held.select(F.col("match_id").alias("m"), "round_number", "lo", "hi", width.alias("width"))
    rows = rows.withColumn("b", F.explode(F.sequence(at(F.col("lo") + 1), at(F.col("hi"))))).drop("width")
    return events.withColumn("width", width).withColumn("bin", at(F.col("tick"))).drop("width"), rows


def in_rounds_binned(events: DataFrame, bounds: DataFrame) -> DataFrame:
    """As in_rounds, for any ends: match and bin of ticks are the join key, so that an event meets the few rounds of
    its bin, however many its match has, and a long match is many keys. The mean length of all rounds comes first."""
    e, b = _binned(events, bounds)
    return e.join(b, (e["match_id"] == b["m"]) & (e["bin"] == b["b"]) & (e["tick"] > b["lo"]) & (e["tick"] <= b["hi"])).drop("m", "lo", "hi", "b", "bin")


def kills(player_death: DataFrame, bounds: DataFrame) -> DataFrame:
    """Kills by round with the first-kill flag: every kill at a round's first kill tick has it."""
    d = player_death
    rows = d.select("match_id", "seq", "tick", has(d, "attacker_name", "Environment", "string").alias("killer"), has(d, "user_name", "Unknown", "string").alias("victim"), has(d, "weapon", "Unknown", "string").alias("weapon"), has(d, "headshot", None, "boolean").alias("is_headshot"), *(nan_to_null(has(d, f"{who}_{axis}", None, "double")).alias(f"{who}_{axis}") for who in ("user", "attacker") for axis in "XYZ"))
    first = F.min("tick").over(Window.partitionBy("match_id", "round_number"))
    return in_rounds(rows, bounds).withColumn("is_first_kill", F.col("tick") == first)


def grenades(smokes: DataFrame, fires: DataFrame, explosives: DataFrame, bounds: DataFrame) -> DataFrame:
    """Grenades of three kinds by round; type_rank and seq give their order in a round."""
    parts = [d.select("match_id", "seq", "tick", F.lit(k).alias("type_rank"), F.lit(GRENADES[k]).alias("type"), has(d, "user_name", "Unknown", "string").alias("thrower"), *(nan_to_null(has(d, f"user_{a}", None, "double")).alias(f"user_{a}") for a in "XYZ")) for k, d in enumerate((smokes, fires, explosives))]
    return in_rounds(parts[0].unionByName(parts[1]).unionByName(parts[2]), bounds)


def blinds(player_blind: DataFrame, bounds: DataFrame) -> DataFrame:
    d = player_blind
    rows = d.select("match_id", "seq", "tick", has(d, "user_name", "Unknown", "string").alias("victim"), has(d, "attacker_name", "Unknown", "string").alias("attacker"), nan_to_null(has(d, "blind_duration", 0.0, "double")).alias("blind_duration"))
    return in_rounds(rows, bounds)


def plants(bomb_planted: DataFrame, bounds: DataFrame) -> DataFrame:
    d = bomb_planted
    rows = d.select("match_id", "seq", "tick", has(d, "user_name", "Unknown", "string").alias("planter"), has(d, "site", "Unknown", "string").alias("site"))
    return in_rounds(rows, bounds)


def _nested(rows: DataFrame, name: str, order: list[str], fields: list[Column]) -> DataFrame:
    """One array for each round, in order."""
    item = F.struct(*order, F.struct(*fields).alias("item"))
    return rows.groupBy("match_id", "round_number").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]).alias(name))


def _xyz(who: str) -> Column:
    return F.array(*(F.col(f"{who}_{a}") for a in "XYZ"))


def match_documents(headers: DataFrame, bounds: DataFrame, k: DataFrame, g: DataFrame, b: DataFrame, p: DataFrame) -> DataFrame:
    """match_id, map_name, rounds: the nested document of each match that has a round."""
    rounds = bounds.select("match_id", "round_number", "winner", "reason")
    parts = (
        _nested(k, "kills", ["seq"], [F.col(c) for c in ("tick", "killer", "victim", "weapon", "is_headshot", "is_first_kill")] + [F.struct(_xyz("user").alias("victim_xyz"), _xyz("attacker").alias("killer_xyz")).alias("location")]),
        _nested(g, "grenades", ["type_rank", "seq"], [F.col("tick"), F.col("type"), F.col("thrower"), _xyz("user").alias("detonation_xyz")]),
        _nested(b, "flash_blinds", ["seq"], [F.col(c) for c in ("tick", "victim", "attacker", "blind_duration")]),
        _nested(p, "plants", ["seq"], [F.col(c) for c in ("tick", "planter", "site")]),
    )
    names = ("kills", "grenades", "flash_blinds", "plants")
    for part in parts:
        rounds = rounds.join(part, ["match_id", "round_number"], "left")
    for name, part in zip(names, parts, strict=True):
        rounds = rounds.withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    whole = rounds.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("round_number", "winner", "reason", *names))).alias("rounds"))
    named = headers.select("match_id", "map_name")
    return whole.join(named, "match_id", "left").select("match_id", F.coalesce("map_name", F.lit("Unknown")).alias("map_name"), "rounds")


def round_summary(bounds: DataFrame, k: DataFrame, g: DataFrame, b: DataFrame, p: DataFrame) -> DataFrame:
    """Counts by round; rounds without events stay. One aggregation over the tagged union of families."""
    tags = {"kill_count": k, "grenade_count": g, "blind_count": b, "plant_count": p}
    rows = None
    for name, part in tags.items():
        own = part.select("match_id", "round_number", F.lit(name).alias("tag"))
        rows = own if rows is None else rows.unionByName(own)
    counts = rows.groupBy("match_id", "round_number").agg(*(F.count_if(F.col("tag") == name).alias(name) for name in tags))
    return bounds.join(counts, ["match_id", "round_number"], "left").select("match_id", "round_number", "lo", "hi", *(F.coalesce(name, F.lit(0)).alias(name) for name in tags))


def dropped(events: DataFrame, bounds: DataFrame) -> DataFrame:
    """Events that lie in no round."""
    b = bounds.select(F.col("match_id").alias("m"), "lo", "hi")
    return events.join(b, (events["match_id"] == b["m"]) & (events["tick"] > b["lo"]) & (events["tick"] <= b["hi"]), "left_anti")
