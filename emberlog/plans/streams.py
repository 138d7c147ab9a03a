"""Queries of streams: the events arrive in parts, and the stream is started anew for each, so its state has to outlive it."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.tables import shared_folder
from emberlog.sources import views
from emberlog.streaming.decisions import decision_stream, restore_state_store, use_state_store
from emberlog.streaming.episodes import EpisodeStream

from .oracles import ORACLES
from .queries import example_policy, novelty_config, query, six

#: Times at which the events are split into what arrives.
SPLITS = (40_000, 90_000)


def parts(rows: DataFrame) -> list[DataFrame]:
    """The rows of each split, in order of time."""
    ends = [None, *SPLITS, None]
    t = F.col("time")
    return [rows.filter(reduce(lambda a, b: a & b, [t >= lo] * (lo is not None) + [t < hi] * (hi is not None))) for lo, hi in zip(ends, ends[1:])]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def streamed_episodes(spark, sf_dir):
    """Three runs of one stream with what has arrived by then; then what is open is closed."""
    events, folder = views.auth(spark, sf_dir), new_folder(spark, "episode-stream")
    sink = EpisodeStream(f"{folder}/out", novelty_config(events))
    for part in parts(events):
        part.write.mode("append").parquet(f"{folder}/in")
        arrived = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        arrived.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    sink.finish(spark)
    f = sink.episodes(spark)
    return f.select("episode_key", "events_count", "candidate_gate", "suppression_reason", six("score"), F.array_join("signals", ";").alias("signals"))


ORACLES["streamed_episodes"] = ORACLES["batched_episodes"]


@query
def streamed_decisions(spark, sf_dir):
    """Three runs of one stream of access events, with actors' memories in the state store."""
    events, folder, policy = views.access(spark, sf_dir), new_folder(spark, "decision-stream"), example_policy(spark, sf_dir)
    was = use_state_store(spark)
    try:
        for part in parts(events):
            part.write.mode("append").parquet(f"{folder}/in")
            arrived = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
            decided = decision_stream(arrived, policy)
            decided.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        restore_state_store(spark, was)
    d = spark.read.parquet(f"{folder}/out")
    return d.select("seq", "actor", "action_taken", *(six(c) for c in ("semantic_risk", "behavioral_risk", "graph_risk", "fusion_risk", "confidence")), F.array_join("reasons", ";").alias("reasons"))


ORACLES |= {"streamed_decisions": ORACLES["access_decisions"]} if "access_decisions" in ORACLES else {}
