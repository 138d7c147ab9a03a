"""Orders of large tables, batches and state, against plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.operators import batches, decisions, episodes, features, geometry, matching, novelty, queues, variants, windows
from emberlog.operators.graph import Ordered, beside, bucketed, global_rank
from emberlog.sources import sinks

EVENT = "time long, seq long, source string, user string, dest string"


@pytest.fixture
def partitions(spark):
    """Sets the number of shuffle partitions for one test."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", was)


def events(spark, n=900, seed=1, keys=4):
    rng = random.Random(seed)
    times = sorted(rng.randrange(20_000) for _ in range(n))
    rows = [(t, i, f"C{rng.randrange(keys)}", f"U{rng.randrange(keys)}", f"D{rng.randrange(12)}") for i, t in enumerate(times)]
    return spark.createDataFrame(rows, EVENT), rows


@pytest.mark.parametrize(("n", "parts"), [(200_000, 8), (200_000, 16), (200_000, 200), (1_000_000, 16)])
def test_ranks_lose_no_row(spark, partitions, n, parts):
    partitions(parts)
    rows = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("score"), F.col("id").alias("key"), F.md5(F.col("id").cast("string")).alias("text"), (F.col("id") % 7).alias("other"))
    out = global_rank(rows, F.desc("score"), F.col("key"))
    s = out.agg(F.count("*"), F.countDistinct("rank"), F.min("rank"), F.max("rank"), F.sum("rank")).first()
    assert tuple(s) == (n, n, 1, n, n * (n + 1) // 2)
    # Rows that only one side of a join reads the columns of, as in the queues.
    assert out.select("rank", "text").join(out.select("rank", "other"), "rank").count() == n
    wrong = out.alias("a").join(out.alias("b"), F.col("a.rank") + 1 == F.col("b.rank")).filter((F.col("a.score") < F.col("b.score")) | ((F.col("a.score") == F.col("b.score")) & (F.col("a.key") > F.col("b.key"))))
    assert wrong.isEmpty()


@pytest.mark.parametrize("parts", [8, 200])
def test_episode_numbers_and_queue_are_whole(spark, partitions, parts):
    partitions(parts)
    e = spark.range(300_000).select(F.pmod(F.xxhash64("id"), F.lit(90_000)).alias("start_time"), F.col("id").alias("start_seq"), F.md5(F.col("id").cast("string")).alias("episode_key"))
    s = episodes.numbered(e).agg(F.count("*"), F.countDistinct("episode_id"), F.max("episode_id")).first()
    assert tuple(s) == (300_000, 300_000, 300_000)


def test_running_values(spark, partitions):
    partitions(16)
    rng = random.Random(2)
    v = [rng.randrange(1000) for _ in range(5000)]
    df = spark.createDataFrame(list(enumerate(v)), "i long, v long").repartition(7)
    want = {i: (sum(v[:i]) if i else None, max(v[: i + 1]), min(v[i + 1 :], default=None)) for i in range(len(v))}
    o = Ordered(df, F.col("i")).running(a=(F.sum, "v", "before"), b=(F.max, "v", "upto"), c=(F.min, "v", "after"))
    assert {r.i: (r.a, r.b, r.c) for r in o.collect()} == want
    k = bucketed(df, F.floor(F.col("i") / 300), ["i"], [], a=(F.sum, "v", "before"), b=(F.max, "v", "upto"), c=(F.min, "v", "after"))
    assert {r.i: (r.a, r.b, r.c) for r in k.collect()} == want


def test_neighbours_across_stretches(spark, monkeypatch):
    from emberlog.operators import graph

    monkeypatch.setattr(graph, "STRETCH", 10)
    df = spark.range(1, 41).select(F.col("id").alias("rank"), (F.col("id") * 3).alias("v"))
    for r in beside(df, "v", (-2, 1)).collect():
        assert r["v_-2"] == (3 * (r.rank - 2) if r.rank > 2 else None) and r["v_1"] == (3 * (r.rank + 1) if r.rank < 40 else None)


def test_curvature_equals_numpy(spark, monkeypatch):
    from emberlog.operators import graph

    monkeypatch.setattr(graph, "STRETCH", 16)
    rng = np.random.default_rng(0)
    s = np.sort(rng.random(100))[::-1]
    df = spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(s)], "rank long, score double")
    g = np.gradient(np.gradient(s))
    r = geometry.curvature(df, "score").first()
    assert np.allclose([r.mean, r.std, r.abs_mean, r.abs_max, r.abs_p95, r.abs_p99], [g.mean(), g.std(), np.abs(g).mean(), np.abs(g).max(), *np.percentile(np.abs(g), [95, 99])])
    assert tuple(geometry.curvature(df.limit(4), "score").first()) == (0.0,) * 6


def test_merge_and_nearest_in_many_parts(spark, partitions):
    partitions(8)
    rng = random.Random(3)
    spans = [(a, a + rng.randrange(40)) for a in (rng.randrange(50_000) for _ in range(1500))]
    merged = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    got = windows.merge_intervals(spark.createDataFrame(spans, "start long, end long"))
    assert sorted([r.start, r.end] for r in got.collect()) == merged
    labels = sorted({rng.randrange(50_000) for _ in range(60)})
    wins = [(a, a + 100) for a in range(0, 49_000, 70)]
    w = spark.createDataFrame(wins, "start long, end long")
    near = windows.nearest_label(w, spark.createDataFrame([(t,) for t in labels], "time long"))
    want = {a: min(0 if a <= t < b else a - t if t < a else t - b for t in labels) for a, b in wins}
    assert {r.start: r.distance for r in near.collect()} == want
    free = windows.without_overlap(w, got)
    assert {r.start for r in free.collect()} == {a for a, b in wins if not any(a < y and b > x for x, y in merged)}


def test_windows_that_overlap_are_refused(spark):
    e = spark.createDataFrame([(5, 0)], "time long, seq long")
    ok = spark.createDataFrame([(0, 10), (10, 20)], "start long, end long")
    assert windows.extract(e, ok, ["start"]).count() == 1
    with pytest.raises(ValueError, match="overlap"):
        windows.extract(e, ok.union(spark.createDataFrame([(15, 30)], "start long, end long")), ["start"])


def test_warmup_end(spark):
    df, rows = events(spark)
    for n in (1, 2, 450, 900):
        assert tuple(novelty.warmup_end(df, n).first().warm) == rows[n - 1][:2]
    assert novelty.warmup_end(df, 901).isEmpty()


@pytest.mark.parametrize("cuts", [[4000], [300, 310, 9000, 15_000], [19_999]])
def test_batches_give_the_same_episodes(spark, tmp_path, cuts):
    df, _ = events(spark, keys=3)
    config = novelty.NoveltyConfig(warmup_events=40)
    names = ["episode_key", "events_count", "destination_count", "score", "candidate_gate", "suppression_reason", "signals"]
    want = sorted(map(str, episodes.detect(df, config).select(*names).collect()))
    state, out = batches.RunState(), []
    ends = [*cuts, 30_000]
    for k, (lo, hi) in enumerate(zip([0, *cuts], ends, strict=True)):
        closed, state = batches.advance(state, df.filter((F.col("time") >= lo) & (F.col("time") < hi)), config, last=k == len(ends) - 1)
        out += map(str, closed.select(*names).collect())
        state.save(str(tmp_path / str(k)))
        state = batches.RunState.load(spark, str(tmp_path / str(k)))
    assert sorted(out) == want and state.n_events == df.count()


def test_cleanup_ticks_follow_the_chain_across_spans(spark):
    rng = random.Random(4)
    times = sorted({rng.randrange(40_000) for _ in range(700)})
    want, last = [], 0
    for t in times:
        if t - last > 300:
            want.append(t)
            last = t
    ticks = spark.createDataFrame([(t, i) for i, t in enumerate(times)], "time long, seq long")
    assert sorted(r.time for r in variants.cleanup_ticks(ticks, 300, span=2000).collect()) == want


def test_ranker_artefact_is_checked(spark, tmp_path):
    rng = random.Random(5)
    names = list(features.NUMERIC)
    rows = spark.createDataFrame([(f"k{i}", i % 2, *(rng.random() + i % 2 for _ in names)) for i in range(80)], f"episode_key string, label int, {', '.join(f'{n} double' for n in names)}")
    for kind in ("logistic_l1", "sgd_balanced", "tree"):
        model = features.fit_ranker(rows, kind)
        features.save_ranker(model, str(tmp_path / kind), features.feature_names(rows.columns), spark, kind=kind)
        loaded, about = features.load_ranker(str(tmp_path / kind), rows)
        assert about["kind"] == kind
        a, b = (sorted((r.episode_key, r.model_score) for r in features.model_score(m, rows).collect()) for m in (model, loaded))
        assert a == b
    with pytest.raises(ValueError, match="no columns"):
        features.load_ranker(str(tmp_path / "tree"), rows.drop("duration"))
    features.save_ranker(model, str(tmp_path / "bare"), [], spark)
    with pytest.raises(ValueError, match="no features"):
        features.load_ranker(str(tmp_path / "bare"), rows)
    assert len(features.importances(model, names, 3)) == 3


def test_label_mask(spark):
    rows = spark.createDataFrame([("a", 1, "[]", 0.0), ("b", 2, "[7]", 0.0), ("c", 3, None, 2.0)], "episode_key string, episode_id long, redteam_ids string, positive double")
    matched = spark.createDataFrame([("a", 3)], "episode_key string, matched_episode_id long")
    get = lambda df: (sorted(r.episode_key for r in df[0].filter("is_labelled").collect()), df[1])
    assert get(matching.label_mask(rows, matched)) == (["b", "c"], "direct")
    plain = rows.drop("redteam_ids", "positive")
    assert get(matching.label_mask(plain, matched)) == (["c"], "ids")
    assert get(matching.label_mask(plain.drop("episode_id"), matched)) == (["a"], "keys")
    assert get(matching.label_mask(plain.drop("episode_id"), matched.select("matched_episode_id"))) == ([], "none")


def test_annotations_take_the_last_note(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "episode_key string")
    notes = spark.createDataFrame([("a", [1, 2], 5, 1), ("a", [3], 0, 2)], "episode_key string, label_ids array<long>, exact_count long, at long")
    out = {r.episode_key: (r.redteam_count, r.exact_count) for r in matching.with_annotations(rows, notes, order="at").collect()}
    assert out == {"a": (1, 0), "b": (0, 0)}


def test_decision_state_round_trip(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, i, f"U{rng.randrange(3)}", f"r{rng.randrange(2)}", rng.choice("abc"), f"D{rng.randrange(4)}", 0.4, rng.choice([None, "x", "y"])) for i in range(300)]
    e = spark.createDataFrame(rows, "time long, seq long, actor string, role string, action string, resource string, criticality double, device_id string")
    policy = decisions.Policy(spark.createDataFrame([("r0", "a")], "role string, action string"), spark.createDataFrame([("r0", "*")], "role string, resource string"))
    state = decisions.learnt(e.filter("seq < 200"), policy)
    state.save(str(tmp_path / "s"))
    again = decisions.DecisionState.load(spark, str(tmp_path / "s"))
    names = ["seq", "fusion_risk", "graph_risk", "behavioral_risk", "action_taken", "reasons"]
    # The first event of each actor after the state sees just that state in both ways.
    first = e.filter("seq >= 200").groupBy("actor").agg(F.min("seq").alias("seq")).select("seq")
    frozen = decisions.frozen_decisions(e.join(first, "seq"), policy, again).select(*names)
    whole = decisions.decide(e, policy).join(first, "seq").select(*names)
    new = {(r.role, r.action) for r in e.filter("seq >= 200").collect()} - {(r.role, r.action) for r in e.filter("seq < 200").collect()}
    assert not new and sorted(map(str, frozen.collect())) == sorted(map(str, whole.collect()))
    assert decisions.frozen_decisions(e.limit(0), policy, again).count() == 0
    unknown = decisions.frozen_decisions(e.filter("seq = 250").withColumn("actor", F.lit("new")), policy, again).first()
    assert "low_history_actor" in unknown.reasons


def test_capped_sweep_and_tiers(spark):
    rows = spark.createDataFrame([(i + 1, f"e{i}", "X" if i % 3 else f"C{i}", 1.0 - i / 100, i * 100, [i] if i % 5 == 0 else None) for i in range(60)], "rank long, episode_key string, source string, score double, start_time long, label_ids array<long>")
    out = queues.capped_summary(queues.capped_sweep(rows, (1, 3), (10, 20)))
    got = {(r.source_cap, r.queue_size): (r.n, r.filled, r.sources) for r in out.collect()}
    assert got[1, 10] == (10, True, 10) and got[1, 20] == (20, True, 20) and got[3, 10][2] < 10
    tiers = {r.episode_key: r for r in queues.host_triage(rows.withColumn("w", F.floor(F.col("start_time") / 200)), "source", "w", 0.95).collect()}
    assert tiers["e1"].triage_tier.startswith("C_") and tiers["e2"].triage_tier.startswith("D_") and tiers["e0"].triage_tier.startswith("A_") and tiers["e57"].triage_tier.startswith("E_")
    assert tiers["e2"].cluster_order > tiers["e57"].cluster_order


def test_outputs_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("a", None, 0.9, 0.9, 1.0, ["x", "y"]), ("b", "too_few_events", 0.1, 0.1, 0.0, [])], "episode_key string, suppression_reason string, score double, raw_score double, fanout_velocity_score double, signals array<string>")
    names = sinks.save_outputs(str(tmp_path / "o"), e, e, e.limit(0), e.withColumn("queue_size", F.lit(100)))
    assert {n: sinks.load_output(spark, str(tmp_path / "o"), n).count() for n in names if n != "near_matches"} == {"all_episodes": 2, "suppressed_episodes": 1, "matches": 2, "ranked_episodes": 1, "queues": 2}
    assert {r.signals for r in sinks.load_output(spark, str(tmp_path / "o"), "queues").collect()} == {"x|y", None}
