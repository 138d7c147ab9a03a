"""What the chain of signals, sessions and episodes does with its rows."""

import random

import pytest
from pyspark.sql import functions as F

from emberlog.operators import batches, episodes, novelty

EVENTS = "time long, seq long, source string, user string, dest string"


def test_events_meet_one_table_of_memory(spark):
    df = spark.createDataFrame([(k, k, f"s{k % 3}", f"u{k % 4}", f"d{k % 5}") for k in range(60)], EVENTS)
    plan = novelty.event_signals(df, novelty.NoveltyConfig(warmup_events=0))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "lambda" not in plan


def test_an_event_without_destination_has_its_source_s_fanout(spark):
    rows = [(k, k, "s", "u", f"d{k}") for k in range(6)] + [(9, 9, "s", "u", None)]
    out = {r.seq: (r.signals, r.first_time_hits) for r in novelty.event_signals(spark.createDataFrame(rows, EVENTS), novelty.NoveltyConfig(warmup_events=0)).collect()}
    assert out[9] == (["source_fanout", "source_user_fanout", "user_fanout"], 0)


@pytest.mark.parametrize("steps", [(0, 1, 3), (1, 40, 700), (500, 900, 5000)])
def test_exits_are_found_among_ticks_without_a_join_by_time(spark, steps):
    rng, times = random.Random(len(steps)), [0]
    for _ in range(150):
        times.append(times[-1] + rng.choice(steps))
    rows = [(t, k) for k, t in enumerate(times) if rng.random() < 0.5]
    out = episodes.with_exits(spark.createDataFrame(rows, "time long, seq long"), spark.createDataFrame([(t,) for t in times], "time long"), 600)
    assert {r.seq: r.pop for r in out.collect()} == {k: min((x for x in times if x >= t + 600), default=None) for t, k in rows}
    assert out.count() == len(rows)


def test_a_batch_s_state_is_made_without_a_window_over_a_key(spark, monkeypatch):
    """A key that has all events is one group of such a window."""
    plans, write = [], batches.saved
    monkeypatch.setattr(batches, "saved", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or write(df, name))
    df = spark.createDataFrame([(40 * k, k, "s", "u", f"d{k % 7}") for k in range(90)], EVENTS)
    batches.advance(batches.RunState(), df, novelty.NoveltyConfig(warmup_events=5))
    own = [p for name, p in plans if name == "sessions"][0]
    assert not any("Window" in line and "_bucket" not in line and "source#" in line and "max(session" in line for line in own.splitlines())
    assert "Window" not in [p for name, p in plans if name == "entries"][0]


def test_a_key_s_long_silences_and_late_entries(spark):
    """Sessions over spans that a key leaves out, with entries just before and after a span's last two windows."""
    times = [0, 2990, 2999, 3001, 3590, 3601, 3900, 7199, 14000, 14100, 14399, 14401, 40000]
    ticks = sorted({*times, *range(0, 41000, 170)})
    df = spark.createDataFrame([(t, k, "a" if t in times else "tick", "u", "d") for k, t in enumerate(ticks)], EVENTS)
    out = episodes.sessions(df.filter("source = 'a'"), df, 300).orderBy("time").collect()
    pop = lambda t: min((x for x in ticks if x >= t + 600), default=None)
    flags = []
    for k, t in enumerate(times):
        old = [pop(x) for x in times[:k] if x <= t - 600]
        flags.append(k == 0 or bool(old) and max(old) >= times[k - 1] + 300)
    assert [r.opens for r in out] == flags and [r.session for r in out] == [sum(flags[: k + 1]) for k in range(len(flags))]
    assert [r.pop for r in out] == [pop(t) for t in times] and out[0].opens
