"""Live rounds, sessions and repeats on streams of files, against the batch plans."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from roundsmith.operators import rounds
from roundsmith.streaming import live

SCHEMA = "match_id string, seq long, ts timestamp, tick long, event_type string"
START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


@pytest.fixture()
def store(spark):
    spark.conf.set(live.STORE_SETTING, live.STORE)
    yield
    spark.conf.unset(live.STORE_SETTING)


def deliver(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def run(spark, path, plan, out, log, one=False):
    """Everything that is there, one file a batch, then stop: the next run goes on from the checkpoint."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path))
    query = plan(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(log)).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None


def matches():
    """Three matches: rising ends, ends that fall, and ticks that many events share; events after the last end."""
    rng, out = random.Random(3), []
    for m, ends in (("a", [100, 200, 300]), ("b", [100, 50, 120, 90, 400]), ("c", [3, 3, 9])):
        kinds = ["round_end"] * len(ends) + ["player_death", "player_blind"] * 20
        rng.shuffle(kinds)
        left = list(ends)
        for seq, kind in enumerate(kinds):
            tick = left.pop(0) if kind == "round_end" else rng.randint(-5, max(ends) + 20)
            out.append((m, seq, at(seq * 20), tick, kind))
    return out


def test_live_rounds_equal_the_batch_across_restarts(spark, store, tmp_path):
    rows = matches()
    table = spark.createDataFrame(rows, SCHEMA)
    bounds = rounds.round_bounds(table.where("event_type = 'round_end'"))
    want = Counter(tuple(r) for r in rounds.in_rounds(table.where("event_type <> 'round_end'"), bounds).select("match_id", "seq", "round_number").collect())
    ends = {(r.match_id, r.round_number, r.hi) for r in bounds.collect()}
    # deliveries out of order by up to five minutes, over two runs; the last row moves the watermark past all others
    rng = random.Random(8)
    late = sorted(rows, key=lambda r: (r[2] + timedelta(seconds=rng.randint(0, 300)), r[0]))
    cut = len(late) * 2 // 3
    plan = lambda s: live.live_rounds(s, "6 minutes")
    deliver(spark, tmp_path / "in", late[: cut // 2])
    deliver(spark, tmp_path / "in", late[cut // 2 : cut])
    run(spark, tmp_path / "in", plan, tmp_path / "out", tmp_path / "log")
    first = spark.read.parquet(str(tmp_path / "out")).count()
    deliver(spark, tmp_path / "in", late[cut:])
    deliver(spark, tmp_path / "in", [("z", 0, at(7200), 1, "player_death"), ("z", None, at(7200), 1, "player_death"), (None, 1, at(7200), 1, "player_death")])
    run(spark, tmp_path / "in", plan, tmp_path / "out", tmp_path / "log")
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert 0 < first < len(got)
    assert Counter((r.match_id, r.seq, r.round_number) for r in got if r.event_type != "round_end") == want
    assert {(r.match_id, r.round_number, r.tick) for r in got if r.event_type == "round_end"} == ends


def test_an_idle_match_is_forgotten(spark, store, tmp_path):
    plan = lambda s: live.live_rounds(s, "1 minute", 10)
    deliver(spark, tmp_path / "in", [("m", 0, at(0), 5, "player_death"), ("m", 1, at(1), 10, "round_end")])
    run(spark, tmp_path / "in", plan, tmp_path / "out", tmp_path / "log")
    deliver(spark, tmp_path / "in", [("z", 0, at(3600), 1, "player_death")])
    run(spark, tmp_path / "in", plan, tmp_path / "out", tmp_path / "log")
    deliver(spark, tmp_path / "in", [("m", 2, at(3700), 7, "round_end")])
    deliver(spark, tmp_path / "in", [("z", 1, at(9000), 1, "player_death")])
    run(spark, tmp_path / "in", plan, tmp_path / "out", tmp_path / "log")
    got = {(r.seq, r.round_number) for r in spark.read.parquet(str(tmp_path / "out")).where("match_id = 'm'").collect()}
    assert got == {(0, 1), (1, 1), (2, 1)}


def test_sessions_and_repeats_of_a_stream(spark, tmp_path):
    rows = [("m", k, at(s), k, kind) for k, (s, kind) in enumerate([(0, "player_death"), (600, "round_end"), (3000, "player_death"), (1500, "player_blind")])]
    for part in (rows[:2] + rows[:1], rows[2:], rows[1:2], [("m", 9, at(60), 1, "player_death")], [("z", 0, at(90000), 1, "x")], [("z", 1, at(90001), 1, "x")]):
        deliver(spark, tmp_path / "in", part)

    def plan(events):
        return live.sessions(live.without_repeats(events, ["match_id", "seq"], "30 minutes"), "20 minutes", None)

    run(spark, tmp_path / "in", plan, tmp_path / "out", tmp_path / "log")
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("match_id = 'm'").collect()}
    # the repeated rows count once, and seq 9 is later than the watermark, which drops rows from the batch after the next on
    assert got == {("m", at(0), at(2700), 3, 1, 1), ("m", at(3000), at(4200), 1, 1, 0)}
    table = spark.createDataFrame(rows + rows[:2], SCHEMA)
    assert {tuple(r) for r in live.sessions(live.without_repeats(table, ["match_id", "seq"]), "20 minutes").collect()} == got
