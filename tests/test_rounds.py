from pyspark.sql import functions as F

from roundsmith.functions.render import match_json
from roundsmith.operators import metrics, rounds


def ends(spark, ticks, match="m"):
    return spark.createDataFrame([(match, k, t) for k, t in enumerate(ticks)], "match_id string, seq long, tick long")


def at(spark, ticks, match="m", schema="match_id string, seq long, tick long"):
    return spark.createDataFrame([(match, k, t) for k, t in enumerate(ticks)], schema)


def placed(spark, end_ticks, event_ticks):
    rows = rounds.in_rounds(at(spark, event_ticks), rounds.round_bounds(ends(spark, end_ticks))).collect()
    return sorted((r.tick, r.round_number) for r in rows)


def test_interval_bounds(spark):
    assert placed(spark, [100, 200], [0, 1, 100, 101, 200, 201]) == [(1, 1), (100, 1), (101, 2), (200, 2)]


def test_equal_ends_make_an_empty_round(spark):
    assert placed(spark, [100, 100], [50, 100]) == [(50, 1), (100, 1)]
    rows = rounds.in_rounds_sorted(at(spark, [50, 100]), rounds.round_bounds(ends(spark, [100, 100]))).collect()
    assert sorted((r.tick, r.round_number) for r in rows) == [(50, 1), (100, 1)]


def test_falling_ends_overlap(spark):
    assert placed(spark, [100, 50, 120], [60]) == [(60, 1), (60, 3)]


def test_no_round_ends_means_no_rows(spark):
    assert placed(spark, [], [1, 2]) == []


def test_first_kill_ties_and_missing_columns(spark):
    bounds = rounds.round_bounds(ends(spark, [100]))
    assert [tuple(r) for r in bounds.select("winner", "reason").collect()] == [("Unknown", "Unknown")]
    k = rounds.kills(at(spark, [10, 10, 12]), bounds).orderBy("seq").collect()
    assert [r.is_first_kill for r in k] == [True, True, False]
    assert {(r.killer, r.victim, r.weapon, r.is_headshot) for r in k} == {("Environment", "Unknown", "Unknown", None)}


def match(spark):
    deaths = spark.createDataFrame([("m", 0, 5, None, "bob", "ak", True, float("nan"), 2.0, None), ("m", 1, 9, "ann", "cat", "awp", False, 1.5, 2.0, 3.0)], "match_id string, seq long, tick long, attacker_name string, user_name string, weapon string, headshot boolean, user_X double, user_Y double, user_Z double")
    none = at(spark, []).limit(0)
    he, smoke = at(spark, [5]), at(spark, [9])
    bounds = rounds.round_bounds(ends(spark, [10, 20]).withColumn("winner", F.lit("T")).withColumn("reason", F.lit(None).cast("string")))
    k, g = rounds.kills(deaths, bounds), rounds.grenades(smoke, none, he, bounds)
    b, p = rounds.blinds(none, bounds), rounds.plants(none, bounds)
    return rounds.match_documents(ends(spark, [1]).select("match_id", F.lit(None).cast("string").alias("map_name")), bounds, k, g, b, p), bounds, k, g, b, p


def test_nested_document(spark):
    doc = match(spark)[0].collect()[0]
    assert doc.map_name == "Unknown" and [r.round_number for r in doc.rounds] == [1, 2]
    first, second = doc.rounds
    assert [g.type for g in first.grenades] == ["Smoke", "HE"]
    assert first.kills[0].location.victim_xyz == [None, 2.0, None] and first.kills[1].killer == "ann"
    assert (second.kills, second.grenades, second.flash_blinds, second.plants) == ([], [], [], [])


def test_rendered_json(spark):
    text = match(spark)[0].select(match_json(F.col("match_id"), F.col("map_name"), F.col("rounds")).alias("t")).first().t
    assert text.startswith('{"match_id": "m", "map_name": "Unknown", "rounds": [{"round_number": 1, "winner": "T", "reason": "None", "kills": [{"tick": 5, "killer": "None", "victim": "bob", "weapon": "ak", "is_headshot": 1, "is_first_kill": true, "location": {"victim_xyz": [null, 2.0, null]')
    import json

    doc = json.loads(text)
    assert doc["rounds"][1]["kills"] == [] and doc["rounds"][0]["kills"][1]["is_headshot"] == 0


def test_json_strings_keep_other_alphabets(spark):
    import json

    from roundsmith.functions.render import json_string

    for s in ("区a防守", 'a"b\\c\nd', "", "é\t"):
        got = spark.range(1).select(json_string(F.lit(s)).alias("t")).first().t
        assert json.loads(got) == s and ("区" in got) == ("区" in s)


def test_summary_and_metrics(spark):
    _, bounds, k, g, b, p = match(spark)
    s = {r.round_number: r for r in rounds.round_summary(bounds, k, g, b, p).collect()}
    assert (s[1].kill_count, s[1].grenade_count, s[1].blind_count, s[2].kill_count) == (2, 2, 0, 0)
    assert {(r.player, r.first_kills, r.first_deaths) for r in metrics.first_kill_rate(k, bounds).collect()} == {(None, 1, 0), ("bob", 0, 1)}
    totals = {r.player: r for r in metrics.player_totals(k).collect()}
    assert totals["ann"].kills == 1 and totals["bob"].kd_ratio == 0.0 and totals["ann"].kd_ratio is None and totals["ann"].adr is None
    assert metrics.blind_time(b).collect() == [] and metrics.plants_by_site(p).collect() == []


def test_binned_join_equals_the_plain_one_and_tests_few_pairs(spark):
    """Any ends, and one match of 2000 rounds whose events meet a few rounds each."""
    import random

    rng = random.Random(2)
    ends_of = {"a": [100, 50, 120, 7, 7, 400], "b": [-5, 3, -9, 30], "c": [rng.randint(0, 500) for _ in range(20)], "d": [1000 * (k + 1) + rng.randint(0, 900) for k in range(2000)], "e": []}
    e = spark.createDataFrame([(m, k, t) for m, ts in ends_of.items() for k, t in enumerate(ts)], "match_id string, seq long, tick long")
    rows = spark.createDataFrame([(m, k, rng.randint(-20, 2_001_000 if m == "d" else 520)) for m in ends_of for k in range(4000 if m == "d" else 300)], "match_id string, seq long, tick long")
    bounds = rounds.round_bounds(e)
    key = lambda df: sorted(map(tuple, df.select("match_id", "seq", "tick", "round_number").collect()))
    assert key(rounds.in_rounds_binned(rows, bounds)) == key(rounds.in_rounds(rows, bounds))
    assert rounds.in_rounds_binned(rows, bounds).columns == ["match_id", "seq", "tick", "round_number"]
    ev, b = rounds._binned(rows.where("match_id = 'd'"), bounds.where("match_id = 'd'"))
    assert b.count() <= 2 * 2000 + 1
    assert ev.join(b, (ev["match_id"] == b["m"]) & (ev["bin"] == b["b"])).count() < 4 * 4000
    assert rounds.in_rounds_binned(rows, bounds.limit(0)).collect() == []
