"""Sessions against an independent simulation of the shared expiry queue."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from emberlog.operators import episodes, variants

W = 300


def simulated(events):
    """New-episode flags of (time, key or None) in order; None is an event without a signal."""
    queue, active, flags = deque(), {}, []
    for now, key in events:
        while queue and queue[0][0] <= now - W:
            _, k = queue.popleft()
            if k in active and active[k] <= now - W:
                del active[k]
        if key is None:
            continue
        flags.append(key not in active)
        active[key] = now
        queue.append((now + W, key))
    return flags


def run(spark, events):
    rows = [(t, i, k or "tick", "u", "d", ["s"] if k else []) for i, (t, k) in enumerate(events)]
    df = spark.createDataFrame(rows, "time long, seq long, source string, user string, dest string, signals array<string>")
    out = episodes.sessions(df.filter(F.size("signals") > 0), df, W).orderBy("seq").collect()
    last, flags = {}, []
    for r in out:
        flags.append(last.get(r.source) != r.session)
        last[r.source] = r.session
    return flags


@pytest.mark.parametrize(
    ("times", "ticks", "flags"),
    [((0, 299), (), "TF"), ((0, 600), (), "TT"), ((0, 100, 650), (), "TFT"), ((0, 100, 650), (600,), "TFT"), ((0, 500, 850), (600,), "TFF"), ((0, 500, 850), (), "TFT")],
)
def test_edges(spark, times, ticks, flags):
    events = sorted([(t, "k") for t in times] + [(t, None) for t in ticks])
    assert run(spark, events) == [f == "T" for f in flags] == simulated(events)


def test_random_streams(spark):
    rng = random.Random(5)
    events, t = [], 0
    for _ in range(600):
        t += rng.choice([0, 1, 40, 150, 290, 310, 500])
        events.append((t, rng.choice(["a", "b", None, "c"])))
    assert run(spark, events) == simulated(events)


def test_rows_in_any_order_give_the_same(spark):
    events = [(t * 70, "ab"[t % 2]) for t in range(60)]
    rows = [(t, i, k, "u", "d", ["s"]) for i, (t, k) in enumerate(events)]
    schema = "time long, seq long, source string, user string, dest string, signals array<string>"
    a = spark.createDataFrame(rows, schema)
    b = spark.createDataFrame(rows[::-1], schema).repartition(7)
    get = lambda d: sorted(map(tuple, episodes.sessions(d, d, W).select("seq", "session").collect()))
    assert get(a) == get(b)


def test_anchored_sessions(spark):
    rows = [(t, i, "a", "u") for i, t in enumerate((0, 299, 300, 500, 601))]
    out = variants.anchored_sessions(spark.createDataFrame(rows, "time long, seq long, source string, user string")).orderBy("seq").collect()
    assert [r.session for r in out] == [1, 1, 2, 2, 3]


def test_empty(spark):
    df = spark.createDataFrame([], "time long, seq long, source string, user string, dest string, signals array<string>")
    assert episodes.sessions(df, df, W).count() == 0


def test_one_key_is_many_tasks_work(spark):
    """One source and user with all events: sessions as by the simulation, found by spans of time in many tasks."""
    rng = random.Random(8)
    events, t = [], 0
    for _ in range(4000):
        t += rng.choice([0, 1, 40, 150, 290, 310, 500])
        events.append((t, rng.choice(["a", "a", None])))
    assert run(spark, events) == simulated(events)
    rows = spark.createDataFrame([(t, i, "a", "u", t + 700) for i, (t, k) in enumerate(events)], "time long, seq long, source string, user string, pop long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        new = episodes.starts(rows, ["source", "user"], W)
        parts = [r.rows for r in new.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("rows"), F.count_if("_new")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(parts) == len(events) and len(parts) >= 16 and max(parts) < len(events) / 8
