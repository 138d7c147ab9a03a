"""Shapes of score distributions, tails, and triage policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quantiles
from .graph import Ordered, beside, global_rank, rank_within
from .tables import saved

RESCUE = ("destination_count", "duration", "events_count", "sig__source_user_fanout", "sig__entropy_soft_duration")
COMPACT = ("compactness_score", "fanout_velocity_score", "novelty_ratio", "sig__compact_lateral_burst", "sig__fanout_velocity", "sig__propagation_convergence_bonus")


def regimes(ranked: DataFrame, top: int = 100, middle: int = 5000) -> DataFrame:
    if middle <= top:
        raise ValueError("the middle regime has to end after the top")
    return ranked.withColumn("regime", F.when(F.col("rank") <= top, "R2").when(F.col("rank") <= middle, "R1").otherwise("R0"))


def phi(rows: DataFrame) -> DataFrame:
    """Adds first_time_density and temporal_density; a division by 0 gives 0."""
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return rows.withColumn("first_time_density", div("first_time_signal_hits", "events_count")).withColumn("temporal_density", div("events_count", "duration"))


def histogram(rows: DataFrame, value: str, bins: int, group: list[str] | None = None) -> DataFrame:
    """(bin, n, density): equal bins from least to greatest value of all rows, the last one closed; empty bins are there too."""
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / width))).otherwise(0)
    group = group or []
    n = rows.crossJoin(F.broadcast(ends)).select(*group, at.alias("bin")).groupBy(*group, "bin").agg(F.count("*").alias("n"))
    grid = rows.sparkSession.range(bins).select(F.col("id").alias("bin")).crossJoin(F.broadcast(ends))
    grid = grid.crossJoin(rows.select(*group).distinct()) if group else grid
    out = grid.join(n, [*group, "bin"], "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(*group))
    return out.select(*group, "bin", "n", F.coalesce(F.try_divide(F.col("n"), total * width), F.lit(0.0)).alias("density"))


def score_stats(rows: DataFrame, value: str, group: list[str]) -> DataFrame:
    stats = rows.groupBy(*group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max(value).alias("max"))
    return quantiles.joined(stats, quantiles.linear(rows, value, group, {"median": 0.5, "p99": 0.99}), group)


def kl(rows: DataFrame, value: str, group: str, a: str, b: str, bins: int, eps: float = 1e-12) -> DataFrame:
    """Divergence of group a's histogram from b's over shared bins."""
    h = histogram(rows.filter(F.col(group).isin(a, b)), value, bins, [group])
    p = h.groupBy("bin").agg(F.sum(F.when(F.col(group) == a, F.col("n"))).alias("x"), F.sum(F.when(F.col(group) == b, F.col("n"))).alias("y"))
    p = p.withColumn("x", F.coalesce("x", F.lit(0)) + eps).withColumn("y", F.coalesce("y", F.lit(0)) + eps)
    t = p.crossJoin(p.agg(F.sum("x").alias("sx"), F.sum("y").alias("sy")))
    q = F.col("x") / F.col("sx")
    return t.agg(F.sum(q * F.ln(q / (F.col("y") / F.col("sy")))).alias("kl"))


def wasserstein(rows: DataFrame, value: str, group: str, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Exact first Wasserstein distance of two groups (for each `by`, of which there are few): the area between their running
    shares, along one stored order of the different values. A group without rows has no shares: NaN, unless all values are equal."""
    by = by or []
    v = rows.filter(F.col(group).isin(a, b)).groupBy(*by, F.col(value).alias("v")).agg(F.count_if(F.col(group) == a).alias("x"), F.count_if(F.col(group) == b).alias("y"))
    run = Ordered(v, *map(F.col, [*by, "v"])).running(cx=(F.sum, "x", "upto"), cy=(F.sum, "y", "upto"), after=(F.min, F.struct(*by, "v"), "after"))
    whole = run.groupBy(*by).agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.max("cx").alias("tx"), F.max("cy").alias("ty"))
    both = run.join(F.broadcast(whole), by) if by else run.crossJoin(F.broadcast(whole))
    share = lambda c, t, s: F.when(F.col(s) == 0, float("nan")).otherwise(F.try_divide(F.col(c) - (F.col(t) - F.col(s)), F.col(s)))  # noqa: E731  what earlier groups add goes
    step = F.when(sum((F.when(F.col(f"after.{k}") != F.col(k), 1).otherwise(0) for k in by), F.lit(0)) == 0, F.col("after.v") - F.col("v"))
    part = F.abs(share("cx", "tx", "sx") - share("cy", "ty", "sy")) * step
    return both.groupBy(*by).agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("w1"))


def curvature(scores: DataFrame, value: str) -> DataFrame:
    """Mean, std and absolute mean, maximum and 95th and 99th percentile of the second gradient of the scores in order of rank;
    ends are one-sided differences, and fewer than five scores give zeros."""
    at = beside(scores.select("rank", F.col(value).alias("s")), "s", (-2, -1, 1, 2))
    s, (b2, b1, a1, a2) = F.col("s"), (F.col(f"s_{k}") for k in (-2, -1, 1, 2))
    here = F.when(b1.isNull(), a1 - s).when(a1.isNull(), s - b1).otherwise((a1 - b1) / 2)
    before = F.when(b2.isNull(), s - b1).otherwise((s - b2) / 2)
    after = F.when(a2.isNull(), a1 - s).otherwise((a2 - s) / 2)
    g = at.select(F.when(b1.isNull(), after - here).when(a1.isNull(), here - before).otherwise((after - before) / 2).alias("g"))
    g = saved(g.withColumn("size", F.abs("g")), "curvature")
    stats = g.agg(F.count("*").alias("n"), F.avg("g").alias("mean"), F.stddev_pop("g").alias("std"), F.avg("size").alias("abs_mean"), F.max("size").alias("abs_max"))
    both = quantiles.joined(stats, quantiles.linear(g, "size", [], {"abs_p95": 0.95, "abs_p99": 0.99}), [])
    return both.select(*(F.when(F.col("n") >= 5, F.col(m)).otherwise(0.0).alias(m) for m in ("mean", "std", "abs_mean", "abs_max", "abs_p95", "abs_p99")))


def long_form(rows: DataFrame, features: list[str], group: str) -> DataFrame:
    """(group, feature, v): one row for each feature, so that all are measured in one job."""
    return rows.select(group, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features))).alias("x")).select(group, "x.*")


def centroid_distances(rows: DataFrame, features: list[str], group: str) -> DataFrame:
    m = long_form(rows, features, group).groupBy(group, "feature").agg(F.avg("v").alias("m"))
    a, b = m.toDF("a", "feature", "x"), m.toDF("b", "feature", "y")
    return a.join(b, "feature").filter("a < b").groupBy("a", "b").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) ** 2)).alias("distance"))


def feature_delta(rows: DataFrame, features: list[str], group: str, a: str, b: str, population: bool = False) -> DataFrame:
    """Means and standardised difference of two groups for each feature; pooled sample (or population) deviations, 0 if both are."""
    std = F.stddev_pop if population else F.stddev_samp
    s = long_form(rows.filter(F.col(group).isin(a, b)), features, group).groupBy("feature").agg(
        *(f(F.when(F.col(group) == g, F.col("v"))).alias(n) for g, p in ((a, "a"), (b, "b")) for f, n in ((F.avg, f"mean_{p}"), (std, f"std_{p}")))
    )
    pooled = F.sqrt((F.coalesce("std_a", F.lit(0.0)) ** 2 + F.coalesce("std_b", F.lit(0.0)) ** 2) / 2)
    return s.withColumn("delta", F.col("mean_a") - F.col("mean_b")).withColumn("standardised", F.coalesce(F.try_divide(F.col("delta"), pooled), F.lit(0.0)))


def window_rows(rows: DataFrame, window: str) -> DataFrame:
    """One row for each window: rows, mean, population deviation, 99th percentile and maximum of the score, and, if rows have
    regimes, how many are of each."""
    counts = [F.count_if(F.col("regime") == r).alias(f"{r.lower()}_count") for r in ("R0", "R1", "R2")] if "regime" in rows.columns else []
    stats = rows.groupBy(window).agg(F.count("*").alias("rows"), F.avg("score").alias("score_mean"), F.stddev_pop("score").alias("score_std"), F.max("score").alias("score_max"), *counts)
    return quantiles.joined(stats, quantiles.linear(rows, "score", [window], {"score_p99": 0.99}), [window])


def window_stability(rows: DataFrame, window: str) -> DataFrame:
    """Variance and deviation across windows of each window's mean, 99th percentile and maximum."""
    kinds = {"mean": "score_mean", "p99": "score_p99", "max": "score_max"}
    return window_rows(rows, window).agg(F.count("*").alias("windows"), *(f(c).alias(f"{n}_{k}") for k, c in kinds.items() for f, n in ((F.var_pop, "var"), (F.stddev_pop, "std"))))


def background_place(rows: DataFrame, background: DataFrame, value: str = "score") -> DataFrame:
    """Adds percentile (100 times the share of background not above) and rank_equivalent (1 + background above): one ordered
    pass over distinct values of both, no join of all pairs."""
    v = rows.select(value).distinct().select(value, F.lit(0).alias("n")).union(background.groupBy(value).agg(F.count("*").alias("n"))).groupBy(value).agg(F.sum("n").alias("n"))
    c = Ordered(v, F.col(value)).running(below=(F.sum, "n", "upto")).select(value, "below").crossJoin(F.broadcast(background.agg(F.count("*").alias("total"))))
    return rows.join(c, value).withColumn("percentile", 100 * F.try_divide("below", "total")).withColumn("rank_equivalent", 1 + F.col("total") - F.col("below")).drop("below", "total")


def thresholds(ranked: DataFrame, ranks: list[int], rows: DataFrame) -> DataFrame:
    """The score at each rank, and how many of `rows` reach it."""
    at = ranked.filter(F.col("rank").isin(ranks)).select("rank", F.col("score").alias("threshold"))
    return rows.crossJoin(F.broadcast(at)).groupBy("rank", "threshold").agg(F.count_if(F.col("score") >= F.col("threshold")).alias("n"), F.avg((F.col("score") >= F.col("threshold")).cast("double")).alias("share"))


def tail_strata(rows: DataFrame, margin: float = 0.35) -> DataFrame:
    """Adds compact_index and rescue_index (means of z-scores by sample deviation, 0 where it is 0) and subtype."""
    used = sorted({*RESCUE, *COMPACT})
    s = rows.agg(*(f(c).alias(f"{n}{c}") for c in used for f, n in ((F.avg, "_m_"), (F.stddev_samp, "_s_"))))
    z = {c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in used}
    mean = lambda names: sum((z[c] for c in names), F.lit(0.0)) / len(names)
    out = rows.crossJoin(F.broadcast(s)).withColumn("rescue_index", mean(RESCUE)).withColumn("compact_index", mean(COMPACT)).drop(*s.columns)
    d = F.col("compact_index") - F.col("rescue_index")
    return out.withColumn("subtype", F.when(d > margin, "compact").when(d < -margin, "rescue").otherwise("mixed"))


def subtype_order() -> Column:
    return F.when(F.col("subtype") == "compact", 0).when(F.col("subtype") == "mixed", 1).when(F.col("subtype") == "rescue", 2).otherwise(9)


def weighted_round_robin(rows: DataFrame, weights: dict[str, int], pool: str, to: str = "place") -> DataFrame:
    """Takes weights[p] rows of each pool in turn, best first; pools that run out are skipped; rows of other pools come last."""
    w = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    first = F.create_map(*(F.lit(x) for i, k in enumerate(weights) for x in (k, sum(list(weights.values())[:i]))))
    own, off = F.try_element_at(w, F.col(pool)), F.try_element_at(first, F.col(pool))
    placed = rank_within(rows, F.col(pool), F.desc("score"), F.col("episode_key"), to="_r").withColumn("_r", F.col("_r") - 1)
    at = placed.withColumn("_cycle", F.floor(F.col("_r") / own)).withColumn("_slot", off + F.col("_r") % own)
    return global_rank(at, F.asc_nulls_last("_cycle"), F.asc_nulls_last("_slot"), F.desc("score"), F.col("episode_key"), to=to).drop("_r", "_cycle", "_slot")


def policies(rows: DataFrame, rescue_threshold: float = 0.5) -> dict[str, DataFrame]:
    """Queues by policy: A score, B subtype, C rounds of 7:2:1, D compact, mixed, extreme rescue, rest, E two lanes of 2:1."""
    tail = (F.desc("score"), F.col("episode_key"))
    extreme = F.when(F.col("subtype") == "compact", 0).when(F.col("subtype") == "mixed", 1).when((F.col("subtype") == "rescue") & (F.col("rescue_index") >= rescue_threshold), 2).otherwise(3)
    lane = rows.withColumn("lane", F.when(F.col("subtype") == "rescue", "rescue").otherwise("main"))
    return {
        "A": global_rank(rows, *tail, to="place"),
        "B": global_rank(rows.withColumn("_o", subtype_order()), F.col("_o"), *tail, to="place").drop("_o"),
        "C": weighted_round_robin(rows, {"compact": 7, "mixed": 2, "rescue": 1}, "subtype"),
        "D": global_rank(rows.withColumn("_o", extreme), F.col("_o"), *tail, to="place").drop("_o"),
        "E": weighted_round_robin(lane, {"main": 2, "rescue": 1}, "lane").drop("lane"),
    }


def prefix_recall(queues: dict[str, DataFrame], depths: list[int]) -> DataFrame:
    """(policy, depth, hits, recall) of labelled rows."""
    out = None
    for name, q in queues.items():
        total = q.agg(F.sum("label").alias("total"))
        one = q.crossJoin(F.broadcast(total)).withColumn("depth", F.explode(F.array(*map(F.lit, depths)))).groupBy("depth").agg(F.coalesce(F.sum(F.when(F.col("place") <= F.col("depth"), F.col("label"))), F.lit(0)).alias("hits"), F.first("total").alias("total")).select(F.lit(name).alias("policy"), "depth", "hits", F.try_divide("hits", "total").alias("recall"))
        out = one if out is None else out.union(one)
    return out


def rank_stats(queues: dict[str, DataFrame]) -> DataFrame:
    """Where labelled rows stand in each policy's queue: first, median, 75th and 90th percentile (linear), last and mean place."""
    out = None
    for name, q in queues.items():
        own = q.filter("label = 1")
        one = own.agg(F.count("*").alias("labelled"), F.min("place").alias("first_place"), F.max("place").alias("last_place"), F.avg("place").alias("mean_place"))
        one = quantiles.joined(one, quantiles.linear(own, "place", [], {"median_place": 0.5, "p75_place": 0.75, "p90_place": 0.9}), [])
        one = one.select(F.lit(name).alias("policy"), "labelled", "first_place", "median_place", "p75_place", "p90_place", "last_place", "mean_place")
        out = one if out is None else out.union(one)
    return out


def prefix_table(queues: dict[str, DataFrame], depths: list[int]) -> DataFrame:
    """Each policy's queue to each depth: rows, labelled ones and recall, background share, scores, sources, users, subtypes."""
    out = None
    for name, q in queues.items():
        total = F.broadcast(q.agg(F.sum("label").alias("total")))
        top = q.filter(F.col("place") <= max(depths)).withColumn("depth", F.explode(F.array(*map(F.lit, depths)))).filter(F.col("place") <= F.col("depth")).crossJoin(total)
        subtype = lambda s: F.count_if(F.col("subtype") == s).alias(f"{s}_count")
        one = top.groupBy("depth").agg(
            F.count("*").alias("n"), F.sum("label").alias("labelled"), F.try_divide(F.sum("label"), F.max("total")).alias("recall"), (1 - F.avg("label")).alias("background_share"), F.avg("score").alias("mean_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"),
            F.countDistinct("source").alias("sources"), F.countDistinct("user").alias("users"), subtype("compact"), subtype("mixed"), subtype("rescue"),
        ).withColumn("policy", F.lit(name))
        out = one if out is None else out.union(one)
    return out


def tail_groups(rows: DataFrame) -> DataFrame:
    """Adds tail_group: labelled rows, and the background of the two upper regimes."""
    return rows.withColumn("tail_group", F.when(F.col("label") == 1, "redteam_associated").when(F.col("regime") == "R2", "background_R2").otherwise("background_R1_tail"))


def group_subtypes(rows: DataFrame, features: list[str] | None = None) -> DataFrame:
    """(tail_group, subtype, n, share, means): with features, their means as <feature>_mean too."""
    means = {"score_mean": "score", "rescue_index_mean": "rescue_index", "compact_index_mean": "compact_index", **{f"{f}_mean": f for f in features or []}}
    n = rows.groupBy("tail_group", "subtype").agg(F.count("*").alias("n"), *(F.avg(c).alias(m) for m, c in means.items()))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("tail_group")))


def subtype_contrast(rows: DataFrame) -> DataFrame:
    """For each subtype its share among labelled rows and both backgrounds, and the differences of shares."""
    g = rows.groupBy("subtype").agg(*(F.count_if(F.col("tail_group") == t).alias(f"{n}_count") for n, t in TAIL_GROUPS.items()))
    all_ = rows.agg(*(F.count_if(F.col("tail_group") == t).alias(f"_{n}") for n, t in TAIL_GROUPS.items()))
    out = g.crossJoin(F.broadcast(all_)).withColumns({f"{n}_share": F.coalesce(F.try_divide(f"{n}_count", f"_{n}"), F.lit(0.0)) for n in TAIL_GROUPS})
    return out.drop(*(f"_{n}" for n in TAIL_GROUPS)).withColumn("minus_r2_share", F.col("redteam_share") - F.col("r2_share")).withColumn("minus_r1_share", F.col("redteam_share") - F.col("r1_share"))


#: Names of the groups of a tail.
TAIL_GROUPS = {"redteam": "redteam_associated", "r2": "background_R2", "r1": "background_R1_tail"}


def standardised_distance(rows: DataFrame, features: list[str], group: str, a: str, b: str) -> DataFrame:
    """Length of the difference of two groups' means, each feature over the sample deviation of both groups' rows together; a
    feature that doesn't vary adds nothing."""
    long = long_form(rows.filter(F.col(group).isin(a, b)), features, group).groupBy("feature").agg(F.stddev_samp("v").alias("s"), *(F.avg(F.when(F.col(group) == g, F.col("v"))).alias(n) for g, n in ((a, "x"), (b, "y"))))
    z = F.coalesce(F.when(F.col("s") > 0, (F.col("x") - F.col("y")) / F.col("s")), F.lit(0.0))
    return long.agg(F.sqrt(F.sum(z * z)).alias("distance"), F.count("*").alias("features"))


def slot_sweep(rows: DataFrame, slots: list[tuple[int, int, int]], margins: list[float], depth: int) -> DataFrame:
    """(slots, margin, hits, recall): policy C with other slots for compact, mixed and rescue, and subtypes at other margins."""
    out = None
    d = F.col("compact_index") - F.col("rescue_index")
    for margin in margins:
        cut = rows.withColumn("subtype", F.when(d > margin, "compact").when(d < -margin, "rescue").otherwise("mixed"))
        for s in slots:
            q = weighted_round_robin(cut, dict(zip(("compact", "mixed", "rescue"), s, strict=True)), "subtype")
            one = q.agg(F.coalesce(F.sum(F.when(F.col("place") <= depth, F.col("label"))), F.lit(0)).alias("hits"), F.sum("label").alias("total"))
            one = one.select(F.lit(":".join(map(str, s))).alias("slots"), F.lit(margin).alias("margin"), "hits", F.try_divide("hits", "total").alias("recall"))
            out = one if out is None else out.union(one)
    return out


def bootstrap_recall(place_a: DataFrame, place_b: DataFrame, depths: list[int], rounds: int, seed: int) -> DataFrame:
    """For each depth: labelled rows drawn again with repetition, `rounds` times, as many of each subtype as there are. Mean
    improvement of policy b over a in recall, its 95 % interval, the share of rounds in which b is better, and in which it isn't
    worse.

    Draws are rows of their own: round, subtype and number of the draw give a hash, which names the row that is drawn. They meet
    the labelled rows of the tail, whose number the regimes bound, in an equi-join.
    """
    both = place_a.filter("label = 1").select("episode_key", "subtype", F.col("place").alias("a")).join(place_b.select("episode_key", F.col("place").alias("b")), "episode_key")
    own = saved(both.withColumn("i", F.row_number().over(Window.partitionBy("subtype").orderBy("episode_key")) - 1), "labelled")
    strata = own.groupBy("subtype").agg(F.count("*").alias("n"))
    draws = strata.crossJoin(own.sparkSession.range(1, rounds + 1).withColumnRenamed("id", "round")).withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    name = F.concat_ws(":", F.lit(seed), "subtype", "round", "draw")
    draws = draws.withColumn("i", F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % F.col("n"))
    hit = lambda c: (F.col(c) <= F.col("depth")).cast("int")
    drawn = draws.join(own, ["subtype", "i"]).withColumn("depth", F.explode(F.array(*map(F.lit, depths))))
    r = drawn.groupBy("depth", "round").agg(F.avg(hit("b") - hit("a")).alias("d"))
    return r.groupBy("depth").agg(F.avg("d").alias("mean"), F.percentile("d", F.lit(0.025)).alias("lo"), F.percentile("d", F.lit(0.975)).alias("hi"), F.avg((F.col("d") > 0).cast("double")).alias("p_better"), F.avg((F.col("d") >= 0).cast("double")).alias("p_not_worse"))
