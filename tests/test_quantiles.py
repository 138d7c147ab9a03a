"""Exact quantiles, ranks inside groups, chains and separated choices against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.operators import quantiles
from emberlog.operators.graph import rank_within
from emberlog.operators.variants import cleanup_ticks, visited
from emberlog.operators.windows import selected_windows, separated


def test_quantiles(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randrange(5)), rng.random()])) for _ in range(600)] + [("c", 1.5), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    fractions = {"p0": 0.0, "p1": 0.01, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    own = lambda g: [v for k, v in rows if k == g and v is not None]
    found = {r.g: r for r in quantiles.linear(df, "v", ["g"], fractions).collect()}
    assert set(found) == {"a", "b", "c", None}
    for g, r in found.items():
        assert r.n == len(own(g))
        for k, p in fractions.items():
            assert r[k] == pytest.approx(np.percentile(own(g), 100 * p), abs=1e-12)
    for r in quantiles.nearest(df, "v", ["g"], fractions).collect():
        assert [r[k] for k in fractions] == [sorted(own(r.g))[round((r.n - 1) * p)] for p in fractions.values()]
    r = quantiles.linear(df, "v", [], fractions).first()
    whole = [v for _, v in rows if v is not None]
    assert r.n == len(whole) and r.p25 == pytest.approx(np.percentile(whole, 25))
    assert quantiles.linear(df.limit(0), "v", ["g"], fractions).count() == 0
    assert quantiles.linear(df.limit(0), "v", [], fractions).collect()[0].p50 is None


def test_a_large_group_is_many_parts(spark):
    df = spark.range(0, 300_000, 1, 8).select(((F.col("id") * 7919) % 300_007).alias("v"), F.lit("x").alias("g"))
    r = quantiles.linear(df, "v", ["g"], {"m": 0.5, "p99": 0.99}).first()
    v = np.sort((np.arange(300_000) * 7919) % 300_007)
    assert (r.m, r.p99) == (np.percentile(v, 50), pytest.approx(np.percentile(v, 99)))


def test_ranks_inside_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(50), k) for k in range(500)]
    out = rank_within(spark.createDataFrame(rows, "g string, v long, k long"), F.col("g"), F.desc("v"), F.col("k"), to="r").collect()
    for g in ("a", "b", None):
        assert [r.k for r in sorted((r for r in out if r.g == g), key=lambda r: r.r)] == [k for x, v, k in sorted(rows, key=lambda x: (-x[1], x[2])) if x == g]
        assert sorted(r.r for r in out if r.g == g) == list(range(1, sum(x == g for x, *_ in rows) + 1))


@pytest.mark.parametrize("span", [2000])
def test_clean_ups(spark, span):
    rng, t, times = random.Random(3), 0, []
    for _ in range(500):
        t += rng.choice([1, 20, 90, 301, 900])
        times.append(t)
    want, last = [], 0
    for t in times:
        if t - last > 300:
            want.append(t)
            last = t
    ticks = spark.createDataFrame([(t, k) for k, t in enumerate(times)], "time long, seq long")
    assert sorted(r.time for r in cleanup_ticks(ticks, 300, span).collect()) == want


def test_visited(spark):
    hops = [(k, k + 3 if k + 3 < 400 else None) for k in range(400)]
    df = spark.createDataFrame(hops, "time long, next long")
    at = lambda x: spark.createDataFrame([(x,)], "time long")
    assert sorted(r.time for r in visited(df, at(1)).collect()) == list(range(1, 400, 3))
    assert visited(df, at(None)).count() == 0 and visited(df, at(399)).count() == 1


def test_separated_choice_is_the_greedy_one(spark):
    rng = random.Random(5)
    rows = [(g, rng.randrange(4000), k, rng.random()) for k, g in enumerate(rng.choice("abb") for _ in range(400))]
    df = spark.createDataFrame(rows, "g string, at long, k long, o double")
    quota = F.when(F.col("g") == "a", 3).otherwise(9)
    got = separated(df, ["g"], "at", F.struct("o", "k"), 350, quota).collect()
    for g, needed in (("a", 3), ("b", 9)):
        want = []
        for _, at, k, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (r[3], r[2])):
            if len(want) < needed and all(abs(at - b) >= 350 for b, _ in want):
                want.append((at, k))
        assert sorted(want) == sorted((r["at"], r.k) for r in got if r.g == g)
    assert separated(df.limit(0), ["g"], "at", F.struct("o", "k"), 350, quota).count() == 0


def test_quotas_ids_and_fill(spark):
    rows = [(k * 60, k * 60 + 120, band, 10 + k % 7, k, (k % 10) / 10) for band, ks in (("early", range(20)), ("middle", range(40, 45)), ("late", range(60, 90))) for k in ks]
    w = spark.createDataFrame(rows, "start long, end long, band string, line_count long, density_rank int, density_percentile double")
    out = selected_windows(w, {"early": 2, "middle": 3, "late": 0}, 0.5, 600).orderBy("window_id").collect()
    assert [r.window_id for r in out] == [f"bg_{k:03d}" for k in range(1, 6)] and [r.band for r in out] == ["early"] * 2 + ["middle"] * 3
    assert abs(sum((-1) ** i * (r.start + r.end) for i, r in enumerate(out[:2]))) >= 1200
    assert [r.selection_reason.rsplit(";", 1)[1] for r in out[2:]] == ["deterministic_band_selection", "deterministic_band_fill", "deterministic_band_fill"]
