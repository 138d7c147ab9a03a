"""Logs so dense that a class, a group or an output has no rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from emberlog.operators import decisions, features, geometry, matching
from emberlog.sources import readers, sinks


@pytest.mark.parametrize("kind", ["logistic", "logistic_l1", "sgd_balanced"])
def test_balanced_rankers_fit_one_class(spark, kind):
    rows = spark.createDataFrame([(f"e{i}", 1, float(i)) for i in range(20)], "episode_key string, label int, duration double")
    model = features.fit_ranker(rows, kind)
    assert {round(r.model_score, 6) for r in features.model_score(model, rows).collect()} == {1.0}


def test_average_precision_needs_positives_only(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1)], "s double, label int")
    r = features.auc_ap(df, "s").first()
    assert r.auc is None and r.ap == 1.0
    assert features.auc_ap(df.withColumn("label", F.lit(0)), "s").first().ap is None


def test_distance_to_a_group_without_rows_is_undefined(spark):
    df = spark.createDataFrame([("R2", "a", 1.0), ("R2", "a", 3.0), ("R2", "b", 2.0), ("R2", "b", 2.0)], "g string, feature string, v double")
    assert math.isnan(geometry.wasserstein(df.filter("feature = 'a'"), "v", "g", "R2", "R0").first().w1)
    out = {r.feature: r.w1 for r in geometry.wasserstein(df, "v", "g", "R2", "R0", ["feature"]).collect()}
    assert math.isnan(out["a"]) and out["b"] == 0.0


def test_outputs_without_rows_keep_their_columns(spark, tmp_path):
    e = spark.createDataFrame([("a", 0.5, 0.5, 0.5, "few", ["x"])], "episode_key string, score double, raw_score double, fanout_velocity_score double, suppression_reason string, signals array<string>")
    names = sinks.save_outputs(str(tmp_path), e, e.limit(0), e.limit(0), e.limit(0).withColumn("queue_size", F.lit(100)))
    assert {n: sinks.load_output(spark, str(tmp_path), n).agg(F.countDistinct("episode_key")).first()[0] for n in names} == {"all_episodes": 1, "suppressed_episodes": 1, "matches": 0, "near_matches": 0, "ranked_episodes": 0, "queues": 0}


def pairwise(labels, events, window):
    """The best event of each label, by looking at all pairs."""
    out = {}
    same = lambda a, b: a is not None and b is not None and a.lower() == b.lower()
    for n, at, *own in labels:
        for time, seq, *other in events:
            dt = abs(time - at)
            score = sum(w for w, a, b in zip((2, 3, 3), own, other) if same(a, b)) + (3 if dt == 0 else 2 if dt <= 10 else 1 if dt <= 300 else 0)
            if dt <= window and score > 0:
                out[n] = max(out.get(n, (0,)), (score, -time, -seq, dt))
    return {n: (-time, -seq, score, dt) for n, (score, time, seq, dt) in out.items()}


@pytest.mark.parametrize("window", [0, 7, 300, 450])
def test_alignments_are_those_of_all_pairs(spark, window):
    r = random.Random(window)
    some = lambda head, n: r.choice([None, *(f"{head}{i}" for i in range(n)), f"{head.lower()}0"])
    rows = lambda n: [(i, r.randrange(-50, 2500), some("U", 3), some("C", 3), some("D", 4)) for i in range(n)]
    labels, events = rows(60), [(t, i, *own) for i, t, *own in rows(150)]
    l = spark.createDataFrame(labels, "redteam_index long, time long, user string, source string, dest string")
    e = spark.createDataFrame(events, "time long, seq long, user string, source string, dest string")
    out = {x.redteam_index: (x.time, x.seq, x.score, x.dt) for x in matching.alignments(l, e, window).collect()}
    assert out == pairwise(labels, events, window)


def test_alignments_of_one_second_grow_with_its_rows(spark):
    """Labels and events of other sources, all in one second."""

    def rows(n):
        e = spark.range(n).select(F.lit(5).cast("long").alias("time"), F.col("id").alias("seq"), *(F.concat(F.lit(c), F.col("id") % 50).alias(f"_{c}") for c in ("source", "dest", "user")))
        l = e.select(F.col("seq").alias("label_redteam_index"), F.col("time").alias("label_time"), "_source", F.lit("x").alias("_dest"), "_user")
        return matching.answerable(matching.questions(l, 300), e, 300).count()

    assert rows(2000) <= 2 * rows(1000)


def test_frozen_memories_are_not_copied_for_each_event(spark):
    """One actor has all events: its memory comes once for each stretch, and any stretch gives the same decisions."""
    e = spark.range(400).select(F.col("id").alias("time"), F.col("id").alias("seq"), F.lit("a").alias("actor"), F.lit("r").alias("role"), F.concat(F.lit("x"), F.col("id") % 3).alias("action"), F.concat(F.lit("D"), F.col("id") % 7).alias("resource"), ((F.col("id") % 11) / 10).alias("criticality"))
    policy = decisions.Policy(spark.createDataFrame([("r", "x0")], "role string, action string"), spark.createDataFrame([("r", "*")], "role string, resource string"))
    state = decisions.learnt(e.filter("seq < 200"), policy)
    rows = [sorted(map(str, decisions.frozen_decisions(e.filter("seq >= 200"), policy, state, stretch=n).collect())) for n in (10, 150, 1000)]
    assert len(rows[0]) == 200 and rows[0] == rows[1] == rows[2]


def test_entropies_that_were_asked_for_are_those_that_are_learnt():
    r = random.Random(3)
    c, a, b = decisions.DecisionConfig(), decisions.Past(), decisions.Past()
    for _ in range(300):
        action, resource = r.choice(["x", "y", "z", None]), r.choice("DEFG")
        now = a.entropy(action, resource, c.entropy_window) if a.n >= 5 else None
        a.learn(action, resource, c, now), b.learn(action, resource, c)
        assert (a.actions, a.resources, a.baseline) == (b.actions, b.resources, b.baseline) and len(a.actions) <= c.history


def test_conditions_on_fields_do_not_make_the_line_anew(spark):
    """A line that is costly to make is made once for each row, whatever a reader asks of its fields."""
    lines = spark.range(3).select(F.col("id").alias("seq"), F.concat_ws(",", F.get_json_object(F.to_json(F.struct("id")), "$.id"), *map(F.lit, ("U1", "U2", "C1", "D1", "K", "N", "L", "Success"))).alias("value"))
    for reader in (readers.auth_strict, readers.auth_tolerant):
        rows = reader(lines)
        assert rows.count() == 3 and rows._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") == 1
