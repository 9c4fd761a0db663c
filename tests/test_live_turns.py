"""The live turn detector against its batch form, over restarts, commands, given turns and timers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelathe.operators import windows
from wavelathe.series import of_level
from wavelathe.streaming.turns import EVENTS, TurnRules, Turns, live_turn_events, turn_events

COLUMNS = ["k", *EVENTS]
RULES = {
    "plain": TurnRules(1.0, 0.5, 1, 2),
    "long": TurnRules(0.2, 0.2, 1, 4, longest=6, grace=3),
    "hard": TurnRules(-9.0, longest=5, grace=0),
    "messages": TurnRules(0.5, 0.0, 0, 1, every=3, window=4, at_end=2, least=2, pre_roll=-1, post_roll=1),
    "late": TurnRules(0.5, 0.2, 1, 1, first=20, at_end=0),
    "inverted": TurnRules(1.5, 1.8, 1, 1, invert=True),
}


@pytest.fixture(scope="module")
def level(spark):
    rng = np.random.default_rng(5)
    rows = [(k, i, float(v)) for k in range(5) for i, v in enumerate(rng.normal(0.4, 1, 40 + 7 * k).cumsum() % 3)]
    return spark.createDataFrame(rows, "k int, vidx long, x double").cache()


def rows(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def streamed(spark, tmp_path, level, parts, rules, **more):
    """The events of the level's parts, each in a run of its own that goes on from the checkpoint."""
    schema = level.schema
    for n, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = live_turn_events(stream, ["k"], ["vidx"], "x", rules, **more).writeStream.option("checkpointLocation", f"{tmp_path}/c").format("parquet").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def test_batch_form_gives_the_turns(level):
    got = turn_events(level, ["k"], ["vidx"], "x", RULES["plain"]).where("event = 'turnEnd'").select("k", "segment", "start", "stop")
    want = windows.turns_between(level, of_level("k"), "x", 1.0, 0.5, 1, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", RULES)
def test_rules(level, name):
    r = RULES[name]
    events = turn_events(level, ["k"], ["vidx"], "x", r).toPandas()
    ends = events[events.event == "turnEnd"]
    assert len(ends) and (ends["stop"] >= ends["start"]).all()
    assert (events[events.event == "turnStart"].groupby("k").size() == ends.groupby("k").size()).all()
    length = ends["stop"] - ends["start"] + 1
    if r.longest:
        assert length.max() <= r.longest + r.grace + 2 and (ends["forced"] == 1).any()
    spans = events[(events.event == "turnFrameTime")]
    if r.every:
        inner = spans[(spans["complete"] == 0) & (spans["forced"] == 0)]
        assert (inner["stop"] - inner["start"] + 1 <= r.window).all() and len(inner)
    if r.at_end == 0:
        assert not len(spans)
    if r.first:
        assert ends["start"].min() >= r.first


@pytest.mark.parametrize("name", ["plain", "long", "messages"])
def test_live_equals_batch_after_restarts(spark, level, tmp_path, name):
    marked = level.withColumn("last", F.col("vidx") == F.max("vidx").over(of_level("k").whole()))
    parts = [marked.where("vidx < 13"), marked.where("vidx >= 13 and vidx < 31"), marked.where("vidx >= 31")]
    got = streamed(spark, tmp_path, marked, parts, RULES[name], end="last")
    assert rows(got) == rows(turn_events(level, ["k"], ["vidx"], "x", RULES[name]))


def test_commands_and_given_turns(spark, level, tmp_path):
    rules = TurnRules(-1.0, pre=0, post=0, calm=3)
    control = spark.createDataFrame([(0, 5, "block"), (0, 9, "unblock"), (1, 0, "block")], "k int, vidx long, command string")
    ends = turn_events(level, ["k"], ["vidx"], "x", rules, control).where("event = 'turnEnd'").collect()
    spans = {k: [(r["start"], r["stop"]) for r in sorted(ends) if r["k"] == k] for k in range(5)}
    assert spans[0] == [(0, 4), (12, 39)] and spans[1] == [] and spans[2] == [(0, 53)]
    control.coalesce(1).write.parquet(f"{tmp_path}/control")
    commands = spark.readStream.schema(control.schema).parquet(f"{tmp_path}/control")
    marked = level.withColumn("last", F.col("vidx") == F.max("vidx").over(of_level("k").whole()))
    got = streamed(spark, tmp_path, marked, [marked], rules, end="last", control=commands)
    assert rows(got) == rows(turn_events(level, ["k"], ["vidx"], "x", rules, control))

    given = spark.createDataFrame([(0, 2, 6), (0, 8, 8), (2, 50, 53), (3, 60, 99)], "k int, start long, stop long")
    some = level.where("k in (0, 2, 3)")
    want = turn_events(some, ["k"], ["vidx"], "x", rules, preloaded=given)
    assert [(r["k"], r["start"], r["stop"]) for r in sorted(want.where("event = 'turnEnd'").collect())] == [(0, 2, 6), (0, 8, 8), (2, 50, 53), (3, 60, 60)]
    some = some.withColumn("last", F.col("vidx") == F.max("vidx").over(of_level("k").whole()))
    got = streamed(spark, f"{tmp_path}/given", some, [some.where("vidx < 7"), some.where("vidx >= 7")], rules, end="last", preloaded=given)
    assert rows(got) == rows(want)


def test_silence_ends_a_turn_and_numbers_go_on(spark, tmp_path):
    """After a timeout the key's next turn is segment 1, behind the rows counted so far."""
    import time

    (tmp_path / "out").mkdir()
    for n in range(2):
        spark.createDataFrame([("a", n * 4 + i, 9.0) for i in range(4)], "k string, vidx long, x double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("k string, vidx long, x double").parquet(f"{tmp_path}/in")
        q = live_turn_events(stream, ["k"], ["vidx"], "x", TurnRules(1.0, pre=1, post=1), timeout="1 second").writeStream.option("checkpointLocation", f"{tmp_path}/c").format("parquet").option("path", f"{tmp_path}/out").trigger(processingTime="500 milliseconds").start()
        until = time.monotonic() + 40
        while time.monotonic() < until and q.exception() is None:
            time.sleep(1)
            if spark.read.schema("k string, event string, segment long").parquet(f"{tmp_path}/out").where("event = 'turnEnd'").count() > n:
                break
        q.stop()
    ends = [r for r in spark.read.parquet(f"{tmp_path}/out").collect() if r["event"] == "turnEnd"]
    assert sorted((r["segment"], r["start"], r["stop"], r["forced"]) for r in ends) == [(0, 0, 3, 2), (1, 4, 7, 2)]


def test_status_blocks():
    m = Turns(TurnRules(0.0, pre=0, post=0, status_only=True, calm=2))
    m.command("block")
    events = [e[0] for v in (1, 1, 1, -1) for e in m.take(v)]
    assert events == ["turnStart", "turnEnd", "turnFrameTime"]
