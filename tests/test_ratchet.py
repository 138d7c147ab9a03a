"""Scores that each event can raise: folded as a tree, against a plain fold."""

import random

import pytest
from pyspark.sql import functions as F

from emberlog.operators import variants as vr

ROWS = "source string, user string, session long, time long, seq long, dest string, signals array<string>, n long, risk double, b double"


def fold(steps):
    s = 0.0
    for e, b in steps:
        s = min(1.0, max(0.0, max(s, e) + b))
    return s


@pytest.mark.parametrize("chunk", [2, 7, 1024])
def test_tree_of_steps_equals_the_fold(spark, chunk):
    rng = random.Random(chunk)
    rows, want = [], {}
    for session in range(60):
        steps = [(rng.choice([0.0, 0.2, rng.random(), 1.0]), rng.choice([0.0, 0.18, -0.3, -1.5, 1.5, rng.uniform(-0.4, 0.4)])) for _ in range(rng.choice([1, 2, 3, 40, 90]))]
        want[session] = fold(steps)
        rows += [("s", "u", session, 10 * k, k, f"d{k % 3}", ["x"], k + 1, e, b) for k, (e, b) in enumerate(steps)]
    rng.shuffle(rows)
    out = vr.ratcheted(spark.createDataFrame(rows, ROWS), F.col("b"), chunk).collect()
    assert {r.session for r in out} == set(want)
    for r in out:
        assert abs(r.score - want[r.session]) < 1e-12


def test_one_session_of_many_events(spark):
    """Numbers, destinations and tags so far come span by span; no array holds more than a chunk."""
    n = 120_000
    rows = spark.range(n).select(
        F.lit("s").alias("source"), F.lit("u").alias("user"), F.lit(1).cast("long").alias("session"), (F.col("id") * 3).alias("time"), F.col("id").alias("seq"), F.concat(F.lit("d"), F.col("id") % 501).alias("dest"),
        F.when(F.col("id") == 70_000, F.array(F.lit("first_time_source_to_dest"))).otherwise(F.array(F.lit("x"))).alias("signals"), ((F.col("id") * 7919) % 1000 / 1000).alias("risk"),
    )
    seen = vr.so_far(rows, ("first_time_source_to_dest",))
    bad = (F.col("n") != F.col("seq") + 1) | (F.col("d") != F.least(F.col("seq") + 1, F.lit(501))) | (F.col("duration") != F.col("time")) | (F.col("s_first_time_source_to_dest") != (F.col("seq") >= 70_000))
    assert seen.count() == n and seen.filter(bad).isEmpty()
    change = (F.col("seq") % 11 - 5) / 100
    score = vr.ratcheted(seen, change).first().score
    assert abs(score - fold(((k * 7919) % 1000 / 1000, (k % 11 - 5) / 100) for k in range(n))) < 1e-9
