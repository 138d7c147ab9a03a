"""Joins of spans with points, and running distinct counts, of keys that hold much of a log."""

import random

import pytest
from pyspark.sql import functions as F

from emberlog.operators import matching as mt
from emberlog.operators.intervals import interval_join, met
from emberlog.operators.novelty import running_distincts

LABELS = "redteam_index long, time long, user string, source string, dest string"


def test_spans_of_any_length_meet_points_once(spark):
    rng = random.Random(1)
    spans = [(k, rng.choice("ab"), s := rng.randrange(-5000, 100_000), s + rng.choice([0, 1, 599, 600, 601, 1200, 7000, 90_000])) for k in range(300)]
    spans += [(900, "a", 5, 4), (901, None, 0, 10), (902, "b", None, 10)]
    points = [(k, rng.choice("abc"), rng.randrange(-6000, 110_000)) for k in range(300)] + [(900, "a", None), (901, None, 5)]
    s, p = spark.createDataFrame(spans, "s long, key string, start long, end long"), spark.createDataFrame(points, "p long, key string, at long")
    got = [(r.s, r.p) for r in interval_join(s, p, ["key"], F.col("start"), F.col("end"), F.col("at")).collect()]
    want = [(a, b) for a, k, x, y in spans for b, q, t in points if k == q and None not in (k, x, t) and x <= t <= y]
    assert sorted(got) == sorted(want) and len(set(got)) == len(got)
    assert interval_join(s.limit(0), p, ["key"], F.col("start"), F.col("end"), F.col("at")).count() == 0


def test_rows_that_meet_grow_with_the_log(spark):
    """Ten copies of a log laid end to end: ten times the pairs, not a hundred times."""

    def log(copies):
        episodes, labels = [], []
        for c in range(copies):
            r = random.Random(3)
            for k in range(200):
                t = c * 100_000 + r.randrange(90_000)
                episodes.append((c * 1000 + k, "h", t, t + r.randrange(600), ["d1", "d2"]))
                t = c * 100_000 + r.randrange(90_000)
                labels.append((c * 1000 + k, t, "u", "h", r.choice(["d1", "d3"])))
        return spark.createDataFrame(episodes, "k long, source string, start_time long, end_time long, destinations array<string>"), spark.createDataFrame(labels, LABELS)

    def candidates(copies):
        e, l = log(copies)
        return met(e, l, ["source"], F.col("start_time") - 600, F.col("end_time") + 600, F.col("time")).count()

    one, ten = candidates(1), candidates(10)
    assert 0 < one and ten <= 11 * one < 200 * 200
    e, l = log(10)
    assert mt.matches(e, l, 600).count() == 10 * mt.matches(*log(1), 600).count()


@pytest.mark.parametrize("span", [3600, 7])
def test_running_distinct_counts(spark, span):
    rng = random.Random(4)
    rows = [(t := rng.randrange(40), k, rng.choice(["a", "a", "a", "b", None]), rng.choice(["x", "y", "z", "w", None]), rng.choice("mn")) for k in range(200)]
    events = spark.createDataFrame(rows, "time long, seq long, source string, dest string, user string")
    out = running_distincts(events, {"d": (["source"], "dest"), "u": (["source"], "user"), "s": (["user"], "source")}, span).collect()
    assert len(out) == len(rows) and t >= 0
    for r in out:
        for name, key, of in (("d", "source", "dest"), ("u", "source", "user"), ("s", "user", "source")):
            past = {x[of] for x in out if x[key] == r[key] and (x.time, x.seq) < (r.time, r.seq)} - {None}
            assert r[name] == len(past) and r[f"{name}_first"] == (r[of] is not None and r[of] not in past)


def test_one_source_with_all_events_is_many_tasks_work(spark):
    events = spark.range(40_000).select((F.col("id") * 9).alias("time"), F.col("id").alias("seq"), F.lit("hot").alias("source"), F.concat(F.lit("d"), F.col("id") % 977).alias("dest"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        out = running_distincts(events, {"n": (["source"], "dest")})
        parts = [r.rows for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("rows"), F.sum("n"), F.count_if("n_first")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(parts) == 40_000 and len(parts) >= 16 and max(parts) < 4_000
    assert out.filter("n <> least(seq, 977)").isEmpty()
