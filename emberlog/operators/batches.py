"""Detection in batches: what one batch hands on to the next, and runs that are separate for each window of time."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .episodes import PRUNED, Preset, aggregate, finalised, sessions
from .novelty import NoveltyConfig, signal_masks, triples_of
from .tables import saved, small

KEY = ("source", "user")


@dataclass
class RunState:
    """What a detector remembers between batches: first events of edges, entries of sessions that may go on, and how many events
    there were, from when to when."""

    triples: DataFrame | None = None
    entries: DataFrame | None = None
    n_events: int = 0
    first: int | None = None
    last: int | None = None

    def save(self, folder: str) -> None:
        """Writes the state as tables; an older state there is replaced."""
        for name in ("triples", "entries"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")
        counts = json.dumps({"n_events": self.n_events, "first": self.first, "last": self.last})
        self.triples.sparkSession.createDataFrame([(counts,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/counts")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> RunState:
        counts = json.loads(spark.read.text(f"{folder}/counts").first()["value"])
        return cls(spark.read.parquet(f"{folder}/triples"), spark.read.parquet(f"{folder}/entries"), **counts)


def advance(state: RunState, events: DataFrame, novelty: NoveltyConfig = NoveltyConfig(), preset: Preset = PRUNED, last: bool = False) -> tuple[DataFrame, RunState]:
    """(finalised episodes that are closed for good, the state after) of the next events in order of time. Any split of the events
    into batches gives the same episodes in all; `last` closes those that are still open.

    A later event of a key can only extend the key's newest session, and its closing depends on the newest entry that is two
    windows old; so a key hands on its newest session and the entries from the one that was two windows old at its last event.
    """
    window = preset.window
    counts = events.agg(F.count("*"), F.min("time"), F.max("time")).first()
    triples = triples_of(events, known=state.triples)
    signals = signal_masks(events, replace(novelty, warmup_events=max(0, novelty.warmup_events - state.n_events)), triples).filter("mask > 0")
    if state.entries is None:
        rows = sessions(signals, events, window).withColumn("done", F.lit(False))
    else:
        rows = sessions(signals.withColumn("done", F.lit(False)), events, window, carried=state.entries)
    rows = saved(rows, "sessions")
    ends = small(rows.groupBy(*KEY).agg(F.max("session").alias("_newest"), F.max("time").alias("_end")))
    old = rows.join(ends, [*KEY]).filter(F.col("time") <= F.col("_end") - 2 * window).groupBy(*KEY).agg(F.max("time").alias("_from"))
    rows = rows.join(small(saved(ends.join(old, [*KEY], "left"), "ends")), [*KEY])
    open_ = F.lit(False) if last else F.col("session") == F.col("_newest")
    closed = finalised(aggregate(rows.filter(~F.col("done") & ~open_)), preset)
    kept = rows.filter((F.col("session") == F.col("_newest")) | (F.col("time") >= F.col("_from"))).withColumn("done", F.col("done") | ~open_).drop("_newest", "_end", "_from")
    times = [x for x in (state.first, counts[1]) if x is not None], [x for x in (state.last, counts[2]) if x is not None]
    return closed, RunState(triples, saved(kept, "entries"), state.n_events + counts[0], min(times[0], default=None), max(times[1], default=None))


def window_runs(events: DataFrame, warmup: int, preset: Preset = PRUNED, window: str = "window_id") -> DataFrame:
    """Finalised episodes of runs that know nothing of one another, one for each value of the column `window`, which is part of
    every key: memory, warm-up and clock are the window's own."""
    novelty = NoveltyConfig(warmup_events=warmup, within=(window,))
    events = saved(events.select(window, "time", "seq", "source", "user", "dest"), "events")
    signals = signal_masks(events, novelty).filter("mask > 0")
    return finalised(aggregate(sessions(signals, events, preset.window, (window,)), within=(window,)), preset)


def window_yield(episodes: DataFrame, events: DataFrame, window: str = "window_id") -> DataFrame:
    """One row for each window: events, their first and last time, accepted and suppressed episodes, accepted ones for a million
    events, and counts of gates, signals and reasons as maps of name to number."""
    good = F.col("suppression_reason").isNull()
    base = events.groupBy(window).agg(F.count("*").alias("parsed_events"), F.min("time").alias("first_seen_time"), F.max("time").alias("last_seen_time"))
    n = episodes.groupBy(window).agg(F.count_if(good).alias("accepted_episodes"), F.count_if(~good).alias("suppressed_episodes"))
    out = base.join(n, window, "left").fillna(0, ["accepted_episodes", "suppressed_episodes"])
    out = out.withColumn("accepted_per_million_parsed_events", F.round(F.col("accepted_episodes") / F.col("parsed_events") * 1_000_000, 6))
    both = F.when(good, "accepted").otherwise("suppressed")
    kinds = {"gate_counts": F.array("candidate_gate"), "signal_counts": F.col("signals"), "reason_counts": F.array_compact(F.array("suppression_reason"))}
    for name, values in kinds.items():
        each = episodes.select(window, both.alias("_k"), F.explode(values).alias("_v")).groupBy(window, "_k", "_v").agg(F.count("*").alias("_n"))
        maps = each.groupBy(window).agg(*(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("_k") == k, F.struct("_v", "_n"))))).alias(f"{k}_{name}") for k in ("accepted", "suppressed") if (k, name) != ("accepted", "reason_counts")))
        out = out.join(maps, window, "left")
    return out
