"""Ranked queues for review: bands, burden, caps, clusters, and summaries of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quantiles
from .features import refuse_leaks
from .graph import global_rank, rank_within

SIZES = (100, 500, 1000, 5000)


def severity(score: Column) -> Column:
    return F.when(score >= 0.90, "critical").when(score >= 0.75, "high").when(score >= 0.50, "medium").when(score >= 0.25, "low").otherwise("low_review")


def priority(rank: Column) -> Column:
    return F.when(rank <= 100, "P1").when(rank <= 500, "P2").when(rank <= 1000, "P3").when(rank <= 5000, "P4").otherwise("P5")


def score_band(score: Column) -> Column:
    return F.when(score >= 0.95, ">=0.95").when(score >= 0.90, "0.90-0.95").when(score >= 0.75, "0.75-0.90").when(score >= 0.50, "0.50-0.75").when(score >= 0.25, "0.25-0.50").otherwise("<0.25")


def explanation() -> Column:
    has = lambda s: F.array_contains("signals", s)
    return F.concat_ws("; ", F.when(has("first_time_source_user_to_dest"), "new source-user-destination"), F.when(has("source_user_fanout"), "source-user fan-out"), F.when(has("compact_lateral_burst"), "compact burst"), F.when(has("fanout_velocity"), "fast fan-out"), F.concat(F.col("destination_count"), F.lit(" destinations in "), F.col("duration"), F.lit(" s")))


#: What a deployed queue shows, and what a research queue adds.
DEPLOYED = ("rank", "score", "severity", "priority", "episode_key", "source", "user", "start_time", "end_time", "duration", "events_count", "destination_count", "candidate_gate", "explanation")
RESEARCH = ("redteam_count", "exact_count")


def banded(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("severity", severity(F.col("score"))).withColumn("priority", priority(F.col("rank"))).withColumn("explanation", explanation())


def deployment(ranked: DataFrame) -> DataFrame:
    """The allowed columns only; raises if one of them tells a label."""
    refuse_leaks([c for c in DEPLOYED if c not in ("score", "candidate_gate")])
    return banded(ranked).select(*DEPLOYED)


def research(ranked: DataFrame) -> DataFrame:
    return banded(ranked).select(*DEPLOYED, *RESEARCH)


def sized(ranked: DataFrame, sizes=SIZES) -> DataFrame:
    """The first rows of the queue once for each size, with queue_size."""
    return ranked.filter(F.col("rank") <= max(sizes)).withColumn("queue_size", F.explode(F.array(*map(F.lit, sizes)))).filter(F.col("rank") <= F.col("queue_size"))


def tie_order() -> list[Column]:
    """Score, novelty, first-time hits, destinations, velocity, peak velocity, compactness from the largest down, duration from
    the shortest up, events from the most down, and the rank that was there."""
    r = lambda c: F.desc(F.round(c, 9))  # noqa: E731  sums of decimals that differ in the last bit tie
    return [r("score"), r("novelty_ratio"), F.desc("first_time_signal_hits"), F.desc("destination_count"), r("fanout_velocity_score"), F.desc("peak_velocity_new_dests"), r("compactness_score"), F.asc("duration"), F.desc("events_count"), F.asc("rank")]


def tie_audit(ranked: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Rank by other keys beside the given one, and their difference."""
    return global_rank(ranked, *(order or tie_order()), to="new_rank").withColumn("rank_delta", F.col("rank") - F.col("new_rank"))


def tie_effect(audited: DataFrame, ks: list[int], label_ids: str = "label_ids") -> DataFrame:
    """For each k, episodes with labels and labels among the first k of both orders, and their differences."""
    labels = F.coalesce(F.size(label_ids), F.lit(0)) if "label_ids" == label_ids else F.col(label_ids)
    rows = audited.filter(F.least("rank", "new_rank") <= max(ks)).select("rank", "new_rank", F.greatest(F.lit(0), labels).alias("n")).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    sums = {f"{name}_{what}": F.sum(F.when(F.col(r) <= F.col("k"), value).otherwise(0)) for name, r in (("original", "rank"), ("tie", "new_rank")) for what, value in (("episodes", (F.col("n") > 0).cast("int")), ("labels", F.col("n")))}
    out = rows.groupBy("k").agg(*(v.alias(n) for n, v in sums.items()))
    return out.withColumn("delta_episodes", F.col("tie_episodes") - F.col("original_episodes")).withColumn("delta_labels", F.col("tie_labels") - F.col("original_labels"))


def repaired_ranks(rows: DataFrame, rank: str = "rank", score: str = "score", key: str = "episode_key") -> DataFrame:
    """Ranks as whole numbers, 0 where they are none; if none is above 0, ranks by score from the largest down."""
    n = F.coalesce(F.col(rank).try_cast("double"), F.lit(0.0)).cast("long")
    top = rows.agg(F.max(n)).first()[0]
    if (top or 0) > 0:
        return rows.withColumn(rank, n)
    return global_rank(rows.drop(rank), F.desc(F.coalesce(F.col(score).try_cast("double"), F.lit(0.0))), F.col(key), to=rank)


def window_ranks(rows: DataFrame, window: str, *order: Column) -> DataFrame:
    """Adds rank over all rows and rank_in_window: places in one order of windows, less the first place of the window."""
    by_window = global_rank(global_rank(rows, *order), F.col(window), F.col("rank"), to="_w")
    first = by_window.groupBy(window).agg(F.min("_w").alias("_first"))
    return by_window.join(first, window).withColumn("rank_in_window", F.col("_w") - F.col("_first") + 1).drop("_w", "_first")


def sized_in_windows(ranked: DataFrame, window: str, sizes=SIZES) -> DataFrame:
    """The first rows of each window's queue once for each size."""
    return ranked.filter(F.col("rank_in_window") <= max(sizes)).withColumn("queue_size", F.explode(F.array(*map(F.lit, sizes)))).filter(F.col("rank_in_window") <= F.col("queue_size"))


def concentration(rows: DataFrame, field: Column, group: list[str], most: int = 50) -> DataFrame:
    """(group, value, place, n, share, cumulative_share) of the most frequent values."""
    n = rows.groupBy(*group, field.alias("value")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*group))
    by = Window.partitionBy(*group).orderBy(F.desc("n"), "value")
    out = n.withColumn("share", F.col("n") / total).withColumn("cumulative_share", F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)) / total).withColumn("place", F.row_number().over(by))
    return out.filter(F.col("place") <= most)


def distribution(rows: DataFrame, field: Column, group: list[str]) -> DataFrame:
    n = rows.groupBy(*group, field.alias("value")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*group)))


def nearest_rank_quantiles(rows: DataFrame, metric: str, group: list[str]) -> DataFrame:
    """min, p25, p50, p75 at the place round((n - 1) p), half to even, mean, max of a metric."""
    stats = rows.groupBy(*group).agg(F.min(metric).alias("min"), F.avg(metric).alias("mean"), F.max(metric).alias("max"))
    out = quantiles.joined(stats, quantiles.nearest(rows, metric, group, {"p25": 0.25, "p50": 0.5, "p75": 0.75}), group)
    return out.select(*group, "min", "p25", "p50", "p75", "mean", "max")


def queue_summary(queues: DataFrame, focus: str) -> DataFrame:
    """For each queue size: different sources and users, the share of the top 1, 5 and 10 sources, of the focus source, medians."""
    q = ["queue_size"]
    top = concentration(queues, F.col("source"), q, 10).groupBy(*q).agg(F.max(F.when(F.col("place") == 1, F.col("share"))).alias("top1_share"), F.sum(F.when(F.col("place") <= 5, F.col("share"))).alias("top5_share"), F.sum("share").alias("top10_share"))
    base = queues.groupBy(*q).agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.countDistinct("user").alias("users"), (F.count_if(F.col("source") == focus) / F.count("*")).alias("focus_share"), F.median("score").alias("median_score"), F.median("duration").alias("median_duration"))
    return base.join(top, q)


def source_capped(ranked: DataFrame, cap: int, target: int, by: str = "source") -> DataFrame:
    """Rows in rank order, at most `cap` of a source, until `target`; with new_rank. Only the first rows of each source are
    looked at, and only the queue, of a fixed size, is ranked again."""
    own = F.row_number().over(Window.partitionBy(by).orderBy("rank"))
    kept = ranked.withColumn("_own", own).filter(F.col("_own") <= cap).orderBy("rank").limit(target)
    return kept.withColumn("new_rank", F.row_number().over(Window.orderBy("rank"))).drop("_own")


def capped_sweep(ranked: DataFrame, caps: tuple[int, ...], sizes: tuple[int, ...], by: str = "source") -> DataFrame:
    """The queues of all caps and sizes, with source_cap, queue_size and new_rank."""
    own = F.row_number().over(Window.partitionBy(by).orderBy("rank"))
    firsts, out = ranked.withColumn("_own", own).filter(F.col("_own") <= max(caps)), None
    for cap in caps:
        one = firsts.filter(F.col("_own") <= cap).orderBy("rank").limit(max(sizes)).withColumn("source_cap", F.lit(cap))
        out = one if out is None else out.union(one)
    placed = out.withColumn("new_rank", F.row_number().over(Window.partitionBy("source_cap").orderBy("rank"))).drop("_own")
    return placed.withColumn("queue_size", F.explode(F.array(*map(F.lit, sizes)))).filter(F.col("new_rank") <= F.col("queue_size"))


def capped_summary(sweep: DataFrame, label_ids: str = "label_ids") -> DataFrame:
    """For each cap and size: rows, whether the size was reached, sources, the largest source's share, episodes with labels, and
    labels, each once."""
    key = ["source_cap", "queue_size"]
    base = sweep.groupBy(*key).agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.count_if(F.col(label_ids).isNotNull()).alias("positive_episodes"), F.median("score").alias("median_score")).withColumn("filled", F.col("n") >= F.col("queue_size"))
    top = concentration(sweep, F.col("source"), key, 1).select(*key, F.col("value").alias("top_source"), F.col("share").alias("top_share"))
    labels = sweep.select(*key, F.explode(label_ids).alias("l")).groupBy(*key).agg(F.countDistinct("l").alias("labels"))
    return base.join(top, key).join(labels, key, "left").fillna(0, ["labels"])


def compact_counts(rows: DataFrame, key: list[str], field: str, k: int, to: str) -> DataFrame:
    n = rows.groupBy(*key, field).agg(F.count("*").alias("n"))
    top = n.withColumn("i", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), field))).filter(F.col("i") <= k)
    return top.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.concat_ws(":", field, "n").alias("t")))), lambda x: x["t"]), ";").alias(to))


def source_clusters(queues: DataFrame) -> DataFrame:
    """One row for each source of each queue."""
    key = ["queue_size", "source"]
    out = queues.groupBy(*key).agg(
        F.count("*").alias("n"), F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"), F.max("score").alias("max_score"), F.median("score").alias("median_score"), F.min("score").alias("min_score"), F.min("start_time").alias("first_start"), F.max("end_time").alias("last_end"), F.countDistinct("user").alias("users"), F.median("destination_count").alias("median_destinations")
    )
    return out.join(compact_counts(queues, key, "candidate_gate", 1, "top_gate"), key).join(compact_counts(queues, key, "user", 3, "top_users"), key)


def representatives(queues: DataFrame, k: int = 5) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("queue_size", "source").orderBy("rank"))
    return queues.withColumn("place", nth).filter(F.col("place") <= k)


def annotation_diagnostic(queues: DataFrame, label_ids: str = "label_ids", total: int | None = None) -> DataFrame:
    """Labels counted by rows, and once each; the difference; and recall over `total`, else over the largest queue's labels."""
    base = queues.groupBy("queue_size").agg(F.coalesce(F.sum(F.when(F.col(label_ids).isNotNull(), F.size(label_ids))), F.lit(0)).alias("row_labels"))
    once = queues.select("queue_size", F.explode(label_ids).alias("l")).groupBy("queue_size").agg(F.countDistinct("l").alias("labels"))
    out = base.join(once, "queue_size", "left").fillna(0, ["labels"]).withColumn("duplicates", F.col("row_labels") - F.col("labels"))
    whole = F.lit(total) if total else F.max("labels").over(Window.partitionBy())
    return out.withColumn("duplicate_ratio", F.coalesce(F.try_divide("duplicates", "row_labels"), F.lit(0.0))).withColumn("official_recall", F.try_divide("labels", whole))


#: Fractions of a scope's scores.
SCOPE_FRACTIONS = (0.0, 0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99, 1.0)


def with_whole(rows: DataFrame, scope: str) -> DataFrame:
    """Rows once for their scope and once for all together."""
    return rows.withColumn("_s", F.explode(F.array(F.col(scope).cast("string"), F.lit("all"))))


def scope_summary(rows: DataFrame, scope: str) -> DataFrame:
    """Linear quantiles of the score, severities and top shares, for each scope and for all together."""
    both = with_whole(rows, scope)
    out = both.groupBy("_s").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.75).alias("high"))
    out = quantiles.joined(out, quantiles.linear(both, "score", ["_s"], quantiles.names_of(SCOPE_FRACTIONS)), ["_s"])
    top = concentration(both.filter("source <> ''"), F.col("source"), ["_s"], 5).groupBy("_s").agg(F.sum("share").alias("top5_share"))
    return out.join(top, "_s").withColumnRenamed("_s", "scope")


def dominant(rows: DataFrame, key: list[str], fields: dict[str, Column]) -> DataFrame:
    """(key, dominant_<name>, dominant_<name>_count): the most frequent value of each field, the first in order of ties. A field may
    be an array, whose values count each. All fields are counted in one pass."""

    def each(name: str, c: Column) -> Column:
        many = rows.select(c.alias("c")).schema["c"].dataType.typeName() == "array"
        return F.transform(c if many else F.array(c), lambda v: F.struct(F.lit(name).alias("field"), v.cast("string").alias("value")))

    values = [each(name, c) for name, c in fields.items()]
    n = rows.select(*key, F.explode(F.concat(*values)).alias("x")).filter("x.value is not null").groupBy(*key, "x.field", "x.value").agg(F.count("*").alias("n"))
    best = n.groupBy(*key, "field").agg(F.min(F.struct((-F.col("n")).alias("less"), "value")).alias("best"))
    own = lambda name, what: F.max(F.when(F.col("field") == name, what))
    return best.groupBy(*key).agg(*(c for f in fields for c in (own(f, F.col("best.value")).alias(f"dominant_{f}"), own(f, -F.col("best.less")).alias(f"dominant_{f}_count"))))


def named(field: str) -> Column:
    """A name, or <blank> where there is none."""
    text = F.trim(F.coalesce(F.col(field), F.lit("")))
    return F.when(text == "", "<blank>").otherwise(text)


def queue_burden(queues: DataFrame, focus: str) -> DataFrame:
    """What a queue of each size asks of its readers: different sources, users and gates; the largest source and user and the
    shares of the first 1, 5 and 10; the focus source; medians and ends; the dominant gate, severity and signal, with shares.
    Queues are of fixed sizes, so medians are those of a bounded number of rows."""
    q = ["queue_size"]
    n = F.count("*")
    out = queues.groupBy(*q).agg(
        n.alias("rows"), F.countDistinct(named("source")).alias("unique_sources"), F.countDistinct(named("user")).alias("unique_users"), F.countDistinct("candidate_gate").alias("unique_gates"), F.count_if(F.col("source") == focus).alias("focus_count"), (F.count_if(F.col("source") == focus) / n).alias("focus_share"),
        F.min("score").alias("min_score"), F.max("score").alias("max_score"), *(F.median(c).alias(f"median_{c}") for c in ("score", "duration", "destination_count", "events_count")),
    )
    for field in ("source", "user"):
        top = concentration(queues, named(field), q, 10).groupBy(*q).agg(F.min_by("value", "place").alias(f"top_{field}"), *(F.sum(F.when(F.col("place") <= k, F.col("share"))).alias(f"top{k}_{field}_share") for k in (1, 5, 10)))
        out = out.join(top, q)
    most = dominant(queues.withColumn("_severity", severity(F.col("score"))), q, {"gate": F.col("candidate_gate"), "severity": F.col("_severity"), "signal": F.col("signals")})
    out = out.join(most, q, "left")
    return out.withColumns({f"dominant_{f}_share": F.col(f"dominant_{f}_count") / F.col("rows") for f in ("gate", "severity", "signal")})


def signal_concentration(queues: DataFrame, most: int = 100) -> DataFrame:
    """(queue_size, value, place, n, share, cumulative_share) of the most frequent signals; shares are of rows, so they may add up to
    more than 1."""
    rows = queues.groupBy("queue_size").agg(F.count("*").alias("_rows"))
    out = concentration(queues.withColumn("_signal", F.explode("signals")), F.col("_signal"), ["queue_size"], most).drop("share", "cumulative_share").join(rows, "queue_size")
    upto = Window.partitionBy("queue_size").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("share", F.col("n") / F.col("_rows")).withColumn("cumulative_share", F.sum("n").over(upto) / F.col("_rows")).drop("_rows")


def cluster_report(queues: DataFrame, examples: int = 5) -> DataFrame:
    """One row for each source of each queue, with all that an analyst is told of a cluster: ranks, scores, times, users, medians,
    the dominant gate, severity and signal, counts of gates, priorities and signals, and the first episodes."""
    key = ["queue_size", "source"]
    rows = queues.withColumn("severity", severity(F.col("score"))).withColumn("priority", priority(F.col("rank")))
    out = rows.groupBy(*key).agg(
        F.count("*").alias("episodes"), F.min("rank").alias("top_rank"), F.max("rank").alias("last_rank"), *(f("score").alias(f"score_{n}") for n, f in (("max", F.max), ("median", F.median), ("min", F.min))), F.min("start_time").alias("time_min"), F.max("end_time").alias("time_max"),
        F.count_distinct(F.when(F.col("user") != "", F.col("user"))).alias("unique_users"), *(F.median(c).alias(f"median_{c}") for c in ("duration", "destination_count", "events_count")),
    )
    out = out.withColumn("rank_span", F.col("last_rank") - F.col("top_rank")).withColumn("time_span", F.col("time_max") - F.col("time_min"))
    out = out.join(dominant(rows, key, {"gate": F.col("candidate_gate"), "severity": F.col("severity"), "signal": F.col("signals")}), key, "left")
    for field, k, to in (("candidate_gate", 5, "top_gates"), ("priority", 5, "top_priorities")):
        out = out.join(compact_counts(rows, key, field, k, to), key, "left")
    out = out.join(compact_counts(rows.withColumn("signal", F.explode("signals")), key, "signal", 8, "top_signals"), key, "left")
    names = rows.filter("user <> ''").groupBy(*key, "user").agg(F.min("rank").alias("r")).withColumn("i", F.row_number().over(Window.partitionBy(*key).orderBy("r"))).filter("i <= 20")
    names = names.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "user"))), lambda x: x["user"]), ";").alias("users"))
    firsts = representatives(queues, examples).groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "episode_key"))), lambda x: x["episode_key"]), ";").alias("representatives"))
    return out.join(names, key, "left").join(firsts, key)


#: Severities of a scored background and the scores from which they hold.
BACKGROUND_SEVERITIES = {"critical_review": 0.90, "high_review": 0.75, "medium_review": 0.50, "low_review": 0.25}


def background_severity(score: Column) -> Column:
    out = F
    for name, least in BACKGROUND_SEVERITIES.items():
        out = out.when(score >= least, name)
    return out.otherwise("background")


def scope_report(rows: DataFrame, scope: str, yields: DataFrame | None = None) -> DataFrame:
    """For each scope and for all together: rows, sources and users, the largest source, shares of the first 5 and 10 (of rows that
    name a source), the dominant gate and signal, quantiles, and how many rows have each severity. yields: rows named by `scope`
    (as window_yield() makes them) whose columns are added."""
    both = with_whole(rows, scope)
    severity_ = background_severity(F.col("score"))
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    counts = [F.count_if(severity_ == s).alias(f"{s}_count") for s in ("background", *reversed(BACKGROUND_SEVERITIES))]
    out = both.groupBy("_s").agg(F.count("*").alias("rows"), F.count_distinct(blank("source")).alias("unique_sources"), F.count_distinct(blank("user")).alias("unique_users"), *counts)
    out = quantiles.joined(out, quantiles.linear(both, "score", ["_s"], quantiles.names_of((0.0, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0))), ["_s"])
    top = concentration(both.filter("source <> ''"), F.col("source"), ["_s"], 10).groupBy("_s")
    top = top.agg(F.min_by("value", "place").alias("top_source"), F.min_by("n", "place").alias("top_source_count"), F.sum(F.when(F.col("place") <= 5, F.col("share"))).alias("top5_share"), F.sum("share").alias("top10_share"))
    out = out.join(top, "_s", "left").join(dominant(both, ["_s"], {"gate": F.col("candidate_gate"), "signal": F.col("signals")}), "_s", "left")
    share = lambda c: F.col(c) / F.col("rows")
    out = out.withColumn("top_source_share", share("top_source_count")).withColumn("dominant_gate_share", share("dominant_gate_count")).withColumn("dominant_signal_share", share("dominant_signal_count"))
    if yields is not None:
        out = out.join(yields.withColumn("_s", F.col(scope).cast("string")).drop(scope), "_s", "left")
    return out.withColumnRenamed("_s", "scope")


def round_robin(ranked: DataFrame, by: str = "source") -> DataFrame:
    """The first row of each source in rank order, then each one's second, and so on."""
    return rank_within(ranked, F.col(by), F.col("rank"), to="round")


def recurrence(ranked: DataFrame, seconds: int, k: int, by: str = "source") -> DataFrame:
    """Sources among the first k of two periods or more."""
    day = ranked.withColumn("day", F.floor(F.col("start_time") / seconds))
    n = day.groupBy("day", by).agg(F.count("*").alias("n"))
    top = n.withColumn("i", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), by))).filter(F.col("i") <= k)
    return top.groupBy(by).agg(F.count("*").alias("days"), F.sum("n").alias("episodes")).filter("days > 1")


def signal_composition(ranked: DataFrame, k: int) -> DataFrame:
    head = ranked.filter(F.col("rank") <= k)
    return head.select(F.explode("signals").alias("signal")).groupBy("signal").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.lit(k))


def analyst_packet(queues: DataFrame, clusters: int = 10, examples: int = 5, only_source: str | None = None) -> DataFrame:
    """What an analyst opens first, as rows (queue_size, section, place, source, episode_key, n, share, best_rank, score): a brief
    of each queue (rows, share of the largest cluster), its largest clusters, and the first episodes of those or of one source."""
    c = source_clusters(queues).withColumn("place", F.row_number().over(Window.partitionBy("queue_size").orderBy(F.desc("n"), "best_rank"))).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("queue_size")))
    none = lambda t: F.lit(None).cast(t)
    head = c.groupBy("queue_size").agg(F.sum("n").alias("n"), F.max("share").alias("share"), F.min_by("source", "place").alias("source"), F.min("best_rank").alias("best_rank"), F.max("max_score").alias("score"))
    brief = head.select("queue_size", F.lit("brief").alias("section"), F.lit(1).alias("place"), "source", none("string").alias("episode_key"), "n", "share", "best_rank", "score")
    top = c.filter(F.col("place") <= clusters)
    listed = top.select("queue_size", F.lit("cluster"), "place", "source", none("string"), "n", "share", "best_rank", F.col("max_score"))
    wanted = top.select("queue_size", "source") if only_source is None else top.filter(F.col("source") == only_source).select("queue_size", "source")
    reps = representatives(queues, examples).join(wanted, ["queue_size", "source"]).select("queue_size", F.lit("representative"), "place", "source", "episode_key", none("long"), none("double"), F.col("rank"), "score")
    return brief.union(listed).union(reps)


def host_triage(ranked: DataFrame, host: str, window: str, high: float) -> DataFrame:
    """Adds presentation_class, by the number of windows in which a host is in the queue, and triage_tier: of a persistent host
    the first row stands for it (C) and the others are members (D); rows above `high` of recurring hosts are B, of others A; the
    rest is context (E). And cluster_order, in which members come last."""
    spans = ranked.groupBy(host).agg(F.countDistinct(window).alias("windows"), F.min("rank").alias("best_rank"))
    w = F.col("windows")
    # Names of classes and tiers, and the windows from which they hold.
    kind = F.when(w >= 20, "persistent_cross_signal_infrastructure_like_cluster").when(w >= 10, "recurrent_cross_signal_cluster").when(w >= 3, "recurring_candidate_cluster").otherwise("distinct_host_window_spike")
    tier = F.when((w >= 20) & (F.col("rank") == F.col("best_rank")), "C_persistent_cluster_representative").when(w >= 20, "D_persistent_cluster_member").when((F.col("score") > high) & (w >= 3), "B_recurrent_high_signal_candidate").when(F.col("score") > high, "A_distinct_high_signal_candidate").otherwise("E_context_queue")
    out = ranked.join(spans, host).withColumn("presentation_class", kind).withColumn("triage_tier", tier)
    return global_rank(out, F.col("triage_tier") == "D_persistent_cluster_member", F.col("rank"), to="cluster_order")
