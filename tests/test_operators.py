"""Small hand-made cases of single operators."""

import pytest
from pyspark.sql import functions as F

from emberlog.operators import decisions, episodes, features, geometry, matching, novelty, queues, windows
from emberlog.operators.graph import components, global_rank
from emberlog.sources import readers


def test_strict_reader_drops_failures_and_unknown_hosts(spark):
    lines = ["5,U1,U2,C1,C2,K,N,L,Success", "6,?,U2,C1,C2,K,N,L,Success", "7,?,?,C1,C2,K,N,L,Success", "8,U1,U2,?,C2,K,N,L,Success", "9,U1,U2,C1,C2,K,N,L,Fail", "x,U1,U2,C1,C2,K,N,L,Success", "short", ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "seq long, value string")
    assert [(r.time, r.user) for r in readers.auth_strict(df).orderBy("seq").collect()] == [(5, "U1"), (6, "U2"), (7, "")]


def test_fanout_and_first_time_count_strictly_earlier_events(spark):
    rows = [(i, i, "s", "u", f"d{i}") for i in range(7)] + [(7, 7, "s", "", "d9")]
    df = spark.createDataFrame(rows, "time long, seq long, source string, user string, dest string")
    out = {r.seq: r.signals for r in novelty.event_signals(df, novelty.NoveltyConfig(warmup_events=1)).collect()}
    assert "source_user_fanout" not in out[2] and "source_user_fanout" in out[3]
    assert "source_fanout" not in out[4] and "source_fanout" in out[5]
    assert out[7] == ["first_time_source_to_dest", "source_fanout"]


def test_warmup_is_learnt_but_not_scored(spark):
    df = spark.createDataFrame([(1, 0, "s", "u", "d"), (2, 1, "s", "u", "d"), (3, 2, "s", "u", "e")], "time long, seq long, source string, user string, dest string")
    out = novelty.event_signals(df, novelty.NoveltyConfig(warmup_events=2)).orderBy("seq").collect()
    assert [r.seq for r in out] == [1, 2] and out[0].signals == []


@pytest.mark.parametrize(("novelty_events", "duration", "gate"), [(5, 900, "A"), (5, 901, "none"), (4, 900, "B"), (1, 900, "none")])
def test_gate_limits(spark, novelty_events, duration, gate):
    """Novelty .25 and .20, duration 900 and 901; the compact tag is widened, since its own limit is 600 s."""
    signals = ["first_time_source_to_dest", "first_time_source_user_to_dest", "first_time_user_to_dest", "source_user_fanout"]
    row = ("s", "u", 1, 0, duration, 0, 20, signals, novelty_events, 9, 1.0, 8, 3, duration, 1, "k")
    e = spark.createDataFrame([row], "source string, user string, session long, start_time long, end_time long, start_seq long, events_count long, signals array<string>, first_time_event_count long, first_time_signal_hits long, max_risk double, destination_count long, peak_velocity_new_dests long, duration long, user_count int, episode_key string")
    assert episodes.finalised(e, episodes.replace(episodes.PRUNED, compact_duration=1000)).first().candidate_gate == gate


def test_merge_touching_and_adjacent(spark):
    df = spark.createDataFrame([(0, 5), (5, 7), (8, 9), (20, 30), (22, 23)], "start long, end long")
    get = lambda r: sorted(map(tuple, windows.merge_intervals(df, r).select("start", "end").collect()))
    assert get(0) == [(0, 7), (8, 9), (20, 30)]
    assert get(1) == [(0, 9), (20, 30)]


def test_components_and_ranks(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    out = {r.node: r.component for r in components(links).collect()}
    assert {out[i] for i in range(41)} == {0} and out[101] == 100
    df = spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "v long")
    assert all(r.rank == r.v + 1 for r in global_rank(df, F.asc("v")).collect())


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "s double, label int")
    r = features.auc_ap(df, "s").first()
    assert r.auc == pytest.approx(3.5 / 4) and r.ap == pytest.approx((1 + 2 / 3) / 2)
    assert features.auc_ap(df.filter("label = 1"), "s").first().auc is None


def test_no_label_reaches_models_or_deployment(spark):
    with pytest.raises(ValueError):
        features.refuse_leaks(["duration", "label_ids"])
    assert not set(queues.DEPLOYED) & {"label", "redteam_count", "label_ids", "exact_count"}


def test_weighted_round_robin_skips_pools_that_run_out(spark):
    rows = [("a", f"a{i}", 1 - i / 100) for i in range(5)] + [("b", "b0", 0.9)]
    df = spark.createDataFrame(rows, "pool string, episode_key string, score double")
    got = [r.episode_key for r in geometry.weighted_round_robin(df, {"a": 2, "b": 1}, "pool").orderBy("place").collect()]
    assert got == ["a0", "a1", "b0", "a2", "a3", "a4"]


def test_round_half_even_quantiles(spark):
    df = spark.createDataFrame([(1, v) for v in (1, 2, 3, 4)], "g int, v long")
    r = queues.nearest_rank_quantiles(df, "v", ["g"]).first()
    assert (r.p25, r.p50, r.p75) == (2, 3, 3)


def test_matches_ignore_the_user(spark):
    e = spark.createDataFrame([("s", "u", 100, 200, ["d", "x"], "k", "A")], "source string, user string, start_time long, end_time long, destinations array<string>, episode_key string, candidate_gate string")
    l = spark.createDataFrame([(0, 100, "other", "s", "d"), (1, 801, "u", "s", "d"), (2, 150, "u", "s", "z")], "redteam_index long, time long, user string, source string, dest string")
    assert [r.label_redteam_index for r in matching.matches(e, l, 600).collect()] == [0]


def test_decisions(spark):
    c = decisions.DecisionConfig()
    assert decisions.fused_of(1, 1, 1, 1, c) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        decisions.DecisionConfig(alpha=0.5)
    rows = [(i, i, "ann", "ops", "read", "r1", 0.2) for i in range(6)] + [(9, 9, "ann", "ops", "read", "frozen", 0.9), (10, 10, "eve", "ghost", "write", "r1", 0.9)]
    df = spark.createDataFrame(rows, "time long, seq long, actor string, role string, action string, resource string, criticality double")
    policy = decisions.Policy(spark.createDataFrame([("ops", "read")], "role string, action string"), spark.createDataFrame([("ops", "*")], "role string, resource string"), frozen=("frozen",))
    out = {r.seq: r for r in decisions.decide(df, policy).collect()}
    assert out[5].action_taken == "allow" and out[9].action_taken == "block" and out[10].action_taken == "human_review"
    assert out[10].semantic_risk == pytest.approx(0.9) and "low_history_actor" in out[10].reasons


def test_means_of_risks_do_not_depend_on_how_rows_are_dealt(spark):
    """A mean that lies between two rounded values; sums of these doubles fall short of it or go beyond it."""
    names = ("fusion_risk", "confidence", "semantic_risk", "behavioral_risk", "graph_risk")
    for value, n, to in ((0.2000005, 30, 0.200001), (0.3000005, 100, 0.300001)):
        rows = spark.range(n).select(*(F.lit(value).alias(c) for c in names))
        for tasks in (1, 3, 7):
            m = decisions.risk_metrics(rows.repartition(tasks))
            assert set(m.select(*(F.round(c, 6) for c in m.columns if c.startswith("mean"))).first()) == {to}


def test_streams_equal_batches(spark, tmp_path):
    from emberlog.streaming import jobs

    rows = [(i, f"s{i % 3}", f"d{i % 5}") for i in range(200)]
    spark.createDataFrame(rows, "time long, source string, dest string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("time long, source string, dest string").parquet(str(tmp_path / "in"))
    jobs.run_to(jobs.first_seen_edges(stream, ["source", "dest"]), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 15
    jobs.run_to(jobs.time_profile(stream, 60), str(tmp_path / "out2"), str(tmp_path / "ck2")).awaitTermination()
    assert all(r.line_count == 60 for r in spark.read.parquet(str(tmp_path / "out2")).collect())


def test_a_table_is_made_once_and_again_if_it_is_gone(spark):
    from emberlog.operators import tables

    made = []
    make = lambda: (made.append(1), spark.range(3))[1]
    assert tables.made_once(spark, "once", ("a",), make).count() == 3 == tables.made_once(spark, "once", ("a",), make).count()
    assert tables.made_once(spark, "once", ("b",), make).count() == 3 and len(made) == 2
    path = tables._made[(spark.sparkContext.applicationId, "once", "a")]
    gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    assert tables.made_once(spark, "once", ("a",), make).count() == 3 and len(made) == 3


def test_a_group_is_named_by_all_its_labels(spark):
    """1,500 labels in one chain of episodes, beside a group of two and an episode of its own."""
    rows = [(f"e{i}", [i, i + 1]) for i in range(1499)] + [("f", [5000, 9]), ("g", [7000, 10_000]), ("h", [7000, 800_000]), ("i", [6000])]
    out = {r.episode_key: r.group_id for r in matching.label_groups(spark.createDataFrame(rows, "episode_key string, label_ids array<long>")).collect()}
    long = "rtgrp:" + "+".join(map(str, [*range(1500), 5000]))
    assert all(out[k] == long for k in ("f", *(f"e{i}" for i in range(1499)))) and len(out) == 1503
    assert out["g"] == out["h"] == "rtgrp:7000+10000+800000" and out["i"] == "rtgrp:6000"
