"""Streams with kept state against the same in batch, over random splits and restarts."""

import random

import pytest

from emberlog.operators import decisions as dc
from emberlog.operators import episodes as ep
from emberlog.operators.novelty import NoveltyConfig
from emberlog.streaming.decisions import decision_stream, restore_state_store, use_state_store
from emberlog.streaming.episodes import EpisodeStream

EVENTS = "time long, seq long, source string, user string, dest string"


def logins(n, seed):
    rng, t, rows = random.Random(seed), 0, []
    for k in range(n):
        t += rng.choice([0, 5, 60, 200, 320, 700])
        rows.append((t, k, rng.choice(["a", "b"]), rng.choice(["u", "v", ""]), f"d{rng.randrange(12)}"))
    return rows


def keyed(rows):
    return sorted((r.episode_key, r.events_count, r.candidate_gate, r.suppression_reason or "", round(r.score, 9), tuple(r.signals)) for r in rows)


@pytest.mark.parametrize("seed", [1])
def test_episodes_of_a_stream_equal_the_batch(spark, tmp_path, seed):
    rows = logins(200, seed)
    novelty = NoveltyConfig(warmup_events=20)
    want = keyed(ep.detect(spark.createDataFrame(rows, EVENTS), novelty).collect())
    rng = random.Random(seed + 10)
    cuts = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(2 + seed))})
    folder = f"file://{tmp_path}"
    for a, b in zip(cuts, cuts[1:]):
        spark.createDataFrame(rows[a:b], EVENTS).write.mode("append").parquet(f"{folder}/in")
        sink = EpisodeStream(f"{folder}/out", novelty)  # a new one each time: nothing is kept in the driver
        stream = spark.readStream.schema(EVENTS).parquet(f"{folder}/in")
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    sink.finish(spark)
    assert keyed(sink.episodes(spark).collect()) == want and len(want) > 10


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    rows, novelty = logins(120, 3), NoveltyConfig(warmup_events=10)
    want = keyed(ep.detect(spark.createDataFrame(rows, EVENTS), novelty).collect())
    sink = EpisodeStream(f"file://{tmp_path}", novelty)
    for number, part in enumerate((rows[:50], rows[:0], rows[50:])):
        for _ in range(2):
            sink(spark.createDataFrame(part, EVENTS), number)
    sink.finish(spark), sink.finish(spark)
    assert keyed(sink.episodes(spark).collect()) == want


def test_decisions_of_a_stream_equal_the_batch(spark, tmp_path):
    rng = random.Random(4)
    schema = "time long, seq long, actor string, role string, action string, resource string, criticality double, device_id string, source_ip string"
    rows = [(k // 3, k, rng.choice("xyz"), rng.choice(["r1", "r2"]), rng.choice(["read", "write", "grant"]), f"s{rng.randrange(6)}", rng.choice([0.1, 0.9]), rng.choice([None, "", "p", "q"]), rng.choice([None, "i", "j"])) for k in range(180)]
    policy = dc.Policy(spark.createDataFrame([("r1", "read"), ("r2", "write")], "role string, action string"), spark.createDataFrame([("r1", "*"), ("r2", "s1")], "role string, resource string"), frozen=("s5",))
    named = lambda df: sorted((r.seq, r.action_taken, round(r.fusion_risk, 9), round(r.confidence, 9), tuple(r.reasons)) for r in df.collect())
    want = named(dc.decide(spark.createDataFrame(rows, schema), policy))
    folder = f"file://{tmp_path}"
    was = use_state_store(spark)
    try:
        for a, b in ((0, 70), (70, 180)):
            spark.createDataFrame(rows[a:b], schema).write.mode("append").parquet(f"{folder}/in")
            out = decision_stream(spark.readStream.schema(schema).parquet(f"{folder}/in"), policy)
            out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        restore_state_store(spark, was)
    got = named(spark.read.parquet(f"{folder}/out"))
    assert got == want and len(got) == 180
