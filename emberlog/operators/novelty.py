"""First-time edges, fan-out, bursts: signals of single events from all that came before them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import saved, small

#: An event's signals and their weights.
EVENT_WEIGHTS = {"first_time_source_to_dest": 0.22, "first_time_user_to_dest": 0.26, "first_time_source_user_to_dest": 0.42, "source_fanout": 0.10, "user_fanout": 0.10, "source_user_fanout": 0.20}
FIRST_TIME = ("first_time_source_to_dest", "first_time_user_to_dest", "first_time_source_user_to_dest")
FANOUT = ("source_fanout", "user_fanout", "source_user_fanout")
#: Ports that a flow signal names.
SUSPICIOUS_PORTS = (4444, 5555, 6666, 7777, 8888, 9999, 1337, 31337)


@dataclass(frozen=True)
class NoveltyConfig:
    warmup_events: int = 50_000
    min_source_fanout: int = 5
    min_user_fanout: int = 5
    min_source_user_fanout: int = 3
    within: tuple[str, ...] = ()  # columns, as window_id, of independent runs


def order_key() -> Column:
    return F.struct("time", "seq")


def first_seen(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each edge (or other key) with the order key of its first event: the memory of a detector as a table."""
    return events.groupBy(*keys).agg(F.min(order_key()).alias("first"))


def fanout_reached(edges: DataFrame, keys: list[str], k: int) -> DataFrame:
    """For each key, the order key of its k-th different edge; an event after it has seen k edges or more."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("first"))
    return edges.withColumn("n", nth).filter(F.col("n") == k).select(*keys, F.col("first").alias("reached"))


def warmup_end(events: DataFrame, n: int, within: tuple[str, ...] = ()) -> DataFrame:
    """The order key of the n-th event (of each run); none if there are fewer. Events are counted by hour; the n-th one's hour is
    counted by second, and only the events of its second are put in order."""
    w = list(within)
    hour = F.floor(F.col("time") / 3600).alias("h")

    def reaching(rows: DataFrame, key: Column | str, base: Column, *also: str) -> DataFrame:
        """The one value of the key in each run in which the n-th event lies, with the number of events before it."""
        counts = rows.groupBy(*w, key, *also).agg(F.count("*").alias("c"))
        run = F.sum("c").over(Window.partitionBy(*w).orderBy(key if isinstance(key, str) else "h")) + base
        return counts.withColumn("_to", run).withColumn("_from", run - F.col("c")).filter((F.col("_from") < n) & (F.col("_to") >= n))

    hours = reaching(events, hour, F.lit(0)).select(*w, "h", F.col("_from").alias("_base"))
    inside = events.select(*w, "time", hour).join(F.broadcast(hours), [*w, "h"])  # a row a run
    second = reaching(inside, "time", F.col("_base"), "_base").select(*w, "time", F.col("_from"))
    nth = F.row_number().over(Window.partitionBy(*w, "time").orderBy("seq"))
    rows = events.join(F.broadcast(second), [*w, "time"]).withColumn("_n", nth + F.col("_from")).filter(F.col("_n") == n)
    return rows.select(*w, order_key().alias("warm"))


def triples_of(events: DataFrame, within: tuple[str, ...] = (), known: DataFrame | None = None) -> DataFrame:
    """The first event of each source, user and destination, those of an earlier table included: a detector's memory."""
    key = [*within, "source", "user", "dest"]
    new = first_seen(events, key)
    return saved(new if known is None else new.unionByName(known).groupBy(*key).agg(F.min("first").alias("first")), "triples")


def memory(triples: DataFrame, config: NoveltyConfig) -> DataFrame:
    """The first event of each source, user and destination, whether it is new in the smaller keys too (_sd, _ud), and where its
    source, user, and both have reached their fan-out (_rs, _ru, _rsu)."""
    w = list(config.within)
    sud, su = w + ["source", "user", "dest"], w + ["source", "user"]
    first = lambda *keys: F.min("first").over(Window.partitionBy(*w, *keys)) == F.col("first")
    out = triples.select(*sud, "first", first("source", "dest").alias("_sd"), ((F.col("user") != "") & first("user", "dest")).alias("_ud"))
    named = triples.filter("user <> ''")
    by_sd = triples.groupBy(*w, "source", "dest").agg(F.min("first").alias("first"))
    by_ud = named.groupBy(*w, "user", "dest").agg(F.min("first").alias("first"))
    for name, edges, keys, k in (("_rs", by_sd, w + ["source"], config.min_source_fanout), ("_ru", by_ud, w + ["user"], config.min_user_fanout), ("_rsu", named, su, config.min_source_user_fanout)):
        out = out.join(fanout_reached(edges, keys, k).withColumnRenamed("reached", name), keys, "left")
    return small(saved(out, "memory"))


def signal_masks(events: DataFrame, config: NoveltyConfig = NoveltyConfig(), triples: DataFrame | None = None) -> DataFrame:
    """Adds mask to events (time, seq, source, user, dest) that come at or after the warm-up's end: its bit i is the i-th signal of
    EVENT_WEIGHTS. The events before it are learnt and dropped here. Each event is compared with strictly earlier ones.

    All memory follows from one table, the first event of each source, user and destination: an event that is new in a smaller
    key is one of those first events, and a key's fan-out is reached at one of them. So events meet one table, by source, user
    and destination. triples: that table where it is there already. A warm-up of no events drops none.
    """
    w = list(config.within)
    known = memory(triples_of(events, config.within) if triples is None else triples, config)
    scored = events
    if config.warmup_events > 0:
        ends = F.broadcast(warmup_end(events, config.warmup_events, config.within))  # a row a run
        scored = (events.join(ends, w) if w else events.crossJoin(ends)).filter(order_key() >= F.col("warm")).drop("warm")
    # A missing destination is no edge, but its source and user have a fan-out.
    own = {c: f"_of_{c}" for c in (*w, "source", "user", "dest")}
    known = known.withColumn("first", F.when(F.col("dest").isNotNull(), F.col("first"))).withColumnsRenamed(own)
    same = [F.col(c).eqNullSafe(F.col(k)) if c == "dest" else F.col(c) == F.col(k) for c, k in own.items()]
    out = scored.join(known, same, "left")
    own, user = order_key(), F.col("user") != ""
    new = own == F.col("first")
    tests = {
        "first_time_source_to_dest": new & F.col("_sd"),
        "first_time_user_to_dest": new & F.col("_ud"),
        "first_time_source_user_to_dest": user & new,
        "source_fanout": own > F.col("_rs"),
        "user_fanout": user & (own > F.col("_ru")),
        "source_user_fanout": user & (own > F.col("_rsu")),
    }
    mask = sum((F.when(tests[n], 1 << i).otherwise(0) for i, n in enumerate(EVENT_WEIGHTS)), F.lit(0))
    return out.select(*events.columns, mask.alias("mask"))


def of_mask(value) -> Column:
    """value(the names of a mask's signals) of the column mask, looked up in a table of all masks."""
    names = [[n for i, n in enumerate(EVENT_WEIGHTS) if mask >> i & 1] for mask in range(1 << len(EVENT_WEIGHTS))]
    return F.array(*(value(n) for n in names))[F.col("mask")]


def signals_of_mask() -> Column:
    return of_mask(lambda names: F.array(*map(F.lit, sorted(names))).cast("array<string>"))


def hits_of_mask() -> Column:
    return of_mask(lambda names: F.lit(sum(n in FIRST_TIME for n in names)))


def risk_of_mask() -> Column:
    return of_mask(lambda names: F.lit(min(sum((EVENT_WEIGHTS[n] for n in names), 0.0), 1.0)))


def event_signals(events: DataFrame, config: NoveltyConfig = NoveltyConfig(), triples: DataFrame | None = None) -> DataFrame:
    """As signal_masks(), with signals (sorted array), first_time_hits and risk in place of the mask."""
    rows = signal_masks(events, config, triples)
    return rows.select(*events.columns, signals_of_mask().alias("signals"), hits_of_mask().alias("first_time_hits"), risk_of_mask().alias("risk"))


#: Seconds of a bucket of time in which events of a key are counted together.
SPAN = 3600


def running_distincts(events: DataFrame, measures: dict[str, tuple[list[str], str]], span: int = SPAN) -> DataFrame:
    """Adds, for each name: (key, of) in measures, name: how many different values of `of`, nulls left out, the key's strictly
    earlier events have; and name_first: whether this event brings a new one.

    A count changes only where a value comes up first in its key. These places come from an aggregate; counted by key and bucket
    of time and added up over buckets they give what a bucket starts with; the rest is a window inside the bucket, in which
    those places and that start stand as rows among the events. So a key that has all events is as many groups as it has
    buckets, and only bucket totals of a key are put in one order. Events are told apart by (time, seq).
    """
    at, out = ["time", "seq"], events
    for key in dict.fromkeys(tuple(k) for k, _ in measures.values()):
        own = {name: of for name, (k, of) in measures.items() if tuple(k) == key}
        bucket = F.floor(F.col("time") / span).alias("_bucket")
        marks = None
        for name, of in own.items():
            first = events.filter(F.col(of).isNotNull()).groupBy(*key, of).agg(F.min(order_key()).alias("_first"))
            rows = first.select(*key, "_first.time", "_first.seq", *(F.lit(int(n == name)).cast("long").alias(n) for n in own))
            marks = rows if marks is None else marks.union(rows)
        marks = marks.groupBy(*key, *at).agg(*(F.sum(n).alias(n) for n in own)).select("*", bucket, F.lit(2).alias("_kind"))
        zero = {n: F.lit(0).cast("long") for n in own}
        places = events.select(*key, bucket).distinct().withColumns(zero).union(marks.select(*key, "_bucket", *own))
        totals = places.groupBy(*key, "_bucket").agg(*(F.sum(n).alias(n) for n in own))
        before = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = totals.select(*key, "_bucket", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in own), F.lit(0).alias("_kind"))
        rows = out.withColumns(zero).select("*", bucket, F.lit(1).alias("_kind"))
        rows = rows.unionByName(marks, allowMissingColumns=True).unionByName(starts, allowMissingColumns=True)
        order = Window.partitionBy(*key, "_bucket").orderBy(F.when(F.col("_kind") == 0, 0).otherwise(1), *at, "_kind")
        upto = order.rowsBetween(Window.unboundedPreceding, 0)
        here = F.lead(F.struct("_kind", *at, *own)).over(order).alias("_next")
        rows = rows.select("*", *(F.sum(n).over(upto).alias(f"_sum_{n}") for n in own), here).filter("_kind = 1")
        same = (F.col("_next._kind") == 2) & (F.col("_next.time") == F.col("time")) & (F.col("_next.seq") == F.col("seq"))
        new = {f"{n}_first": F.coalesce(same & (F.col(f"_next.{n}") > 0), F.lit(False)) for n in own}
        out = rows.withColumns(new).withColumns({n: F.col(f"_sum_{n}") for n in own}).drop("_bucket", "_kind", "_next", *(f"_sum_{n}" for n in own))
    return out


def running_distinct(events: DataFrame, key: list[str], of: str) -> DataFrame:
    """Adds n_before: different values of `of`, nulls left out, in a key's strictly earlier events."""
    return running_distincts(events, {"n_before": (key, of)}).drop("n_before_first")


def trailing(events: DataFrame, key: list[str], seconds: int, agg, to: str) -> DataFrame:
    """Adds agg(window) over a key's events from time - seconds up to this row in file order: earlier seconds by a range frame,
    the same second by a row frame. agg takes a window and gives an array of two columns' combination."""
    return events.withColumn(to, agg(Window.partitionBy(*key).orderBy("time").rangeBetween(-seconds, -1), Window.partitionBy(*key, "time").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))


def trailing_count(events: DataFrame, key: list[str], seconds: int, to: str = "n_recent") -> DataFrame:
    return trailing(events, key, seconds, lambda past, now: F.count("*").over(past) + F.count("*").over(now), to)


def trailing_distinct(events: DataFrame, key: list[str], of: str, seconds: int, to: str = "n_recent") -> DataFrame:
    return trailing(events, key, seconds, lambda past, now: F.size(F.array_union(F.collect_set(of).over(past), F.collect_set(of).over(now))), to)


def bursts(events: DataFrame, host: str, seconds: int, threshold: int) -> DataFrame:
    """Events at which a host has `threshold` or more within the last seconds."""
    return trailing_count(events, [host], seconds).filter(F.col("n_recent") >= threshold)


def flow_signals(flows: DataFrame, big_bytes: int = 10_000_000) -> DataFrame:
    """A row for each host of a flow with a signal: suspicious port .75, large transfer .30."""
    port, large = F.col("dst_port").isin(*SUSPICIOUS_PORTS), F.col("bytes") >= big_bytes
    rows = flows.withColumn("signals", F.array_compact(F.array(F.when(port, F.lit("suspicious_port")), F.when(large, F.lit("large_flow"))))).withColumn("risk", F.greatest(F.when(port, 0.75).otherwise(0.0), F.when(large, 0.30).otherwise(0.0)))
    return rows.filter(F.size("signals") > 0).select("time", "seq", F.explode(F.array("src", "dst")).alias("host"), "signals", "risk")


def login_signals(logins: DataFrame) -> DataFrame:
    """A row for each host of a login with a signal: failed .55, lateral (a success between two hosts) .22."""
    kind = F.when(~F.col("success"), F.lit("failed_auth")).when(F.col("source") != F.col("dest"), F.lit("auth_lateral"))
    rows = logins.withColumn("signal", kind).filter("signal is not null")
    return rows.select("time", "seq", F.explode(F.array("source", "dest")).alias("host"), F.array("signal").alias("signals"), F.when(F.col("signal") == "failed_auth", 0.55).otherwise(0.22).alias("risk"))


def entropy(rows: DataFrame, key: list[str], of: str) -> DataFrame:
    """Shannon entropy of a key's values over the logarithm of their number; 0 for one value."""
    n = rows.groupBy(*key, of).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*key))
    parts = n.withColumn("h", -p * F.log2(p)).groupBy(*key).agg(F.sum("h").alias("h"), F.count("*").alias("k"))
    return parts.select(*key, F.when(F.col("k") > 1, F.col("h") / F.log2("k")).otherwise(0.0).alias("entropy"))
