"""Intervals of time: merging, filtering by them, profiles, candidate and background windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quantiles
from .graph import Ordered, bucketed, global_rank
from .tables import saved, small

#: Seconds of a bucket of time whose totals are put in order; a year has 8,766.
SPAN = 3600

def merge_intervals(intervals: DataFrame, reach: int = 0) -> DataFrame:
    """(start, end) merged where one starts no later than `reach` after the end of those before: 0 joins touching intervals, 1
    also adjacent ones. Running maxima inside spans of time, with what earlier spans reached carried in; no sort of all."""
    own = saved(intervals.select("start", "end"), "intervals")
    span = F.floor(F.col("start") / SPAN)
    rows = bucketed(own, span, ["start", "end"], [], reached=(F.max, "end", "before"))
    fresh = rows.filter(F.col("reached").isNull() | (F.col("start") > F.col("reached") + reach)).select("start", "reached")
    # A merged interval ends where what the next one has seen of ends before it ends.
    later = bucketed(fresh, span, ["start"], [], later=(F.min, F.struct("start", "reached"), "after"))
    return later.crossJoin(F.broadcast(own.agg(F.max("end").alias("top")))).select("start", F.coalesce("later.reached", "top").alias("end"))


def around(labels: DataFrame, radius: int, clamp: bool = False) -> DataFrame:
    start = F.col("time") - radius
    return labels.select((F.greatest(start, F.lit(0)) if clamp else start).alias("start"), (F.col("time") + radius).alias("end"))


def in_intervals(events: DataFrame, intervals: DataFrame, width: int = 3600, half_open: bool = False, keep: list[str] | None = None, time: str = "time") -> DataFrame:
    """Events inside an interval: an equi-join on coarse buckets of time and a test inside. With disjoint intervals no event is
    doubled; `keep` names columns of the interval to add. The intervals are stored and counted first, so that events aren't
    shuffled for few of them."""
    last = F.col("end") - (1 if half_open else 0)
    spread = saved(intervals, "intervals").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(last / width))))
    inside = (F.col(time) >= F.col("start")) & ((F.col(time) < F.col("end")) if half_open else (F.col(time) <= F.col("end")))
    joined = events.withColumn("_b", F.floor(F.col(time) / width)).join(small(spread), "_b").filter(inside)
    return joined.select(*events.columns, *(keep or []))


def in_range(events: DataFrame, labels: DataFrame, margin: int) -> DataFrame:
    """Events between the first label minus and the last plus a margin: literal bounds, which reach the scan."""
    lo, hi = labels.agg(F.min("time"), F.max("time")).first()
    return events.filter(F.col("time").between((lo or 0) - margin, (hi or 0) + margin)) if lo is not None else events.limit(0)


def time_profile(events: DataFrame, size: int) -> DataFrame:
    start = F.floor(F.col("time") / size) * size
    return events.groupBy(start.alias("bucket_start")).agg(F.count("*").alias("line_count")).withColumn("bucket_end", F.col("bucket_start") + size).withColumn("bucket_size", F.lit(size).cast("long"))


def profile_summary(profile: DataFrame) -> DataFrame:
    n = F.col("line_count")
    stats = profile.agg(F.count("*").alias("n_buckets"), F.min(n).alias("min_count"), F.max(n).alias("max_count"), F.avg(n).alias("mean_count"), F.count_if(n > 0).alias("nonempty"))
    return quantiles.joined(stats, quantiles.linear(profile, "line_count", [], {"median_count": 0.5}), [])


def candidates(t_min: Column, t_max: Column, bounds: DataFrame, duration: int, stride: int) -> DataFrame:
    """Windows [start, start + duration) from t_min on that end by t_max."""
    starts = F.when(t_max - duration >= t_min, F.sequence(t_min, t_max - duration, F.lit(stride).cast("long")))
    return bounds.select(F.explode(starts).alias("start")).withColumn("end", F.col("start") + duration)


def without_overlap(windows: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Windows (start, end) that overlap no exclusion (half-open): an equi-join on buckets of time and a test inside."""
    spread = lambda df: df.select("start", "end", F.explode(F.sequence(F.floor(F.col("start") / SPAN), F.floor(F.col("end") / SPAN))).alias("_b"))
    x = spread(exclusions).toDF("xs", "xe", "_b")
    hit = spread(windows).join(x, "_b").filter((F.col("start") < F.col("xe")) & (F.col("end") > F.col("xs"))).select("start", "end").distinct()
    return windows.join(hit, ["start", "end"], "left_anti")


def nearest_label(windows: DataFrame, labels: DataFrame, closed: bool = False) -> DataFrame:
    """Adds distance to the nearest label, 0 inside. Windows and labels stand in one stored order, in which each window sees the
    last label before and the first after its start."""
    at = lambda c: F.lit(None).cast("long").alias(c)
    both = windows.select(F.col("start").alias("at"), "start", "end", at("label")).union(labels.select(F.col("time").alias("at"), at("start"), at("end"), F.col("time").alias("label")))
    seen = Ordered(both, F.col("at"), F.col("label").isNull(), F.col("end")).running(before=(F.max, "label", "upto"), next=(F.min, "label", "after")).filter("start is not null")
    after = F.when(F.col("before") == F.col("start"), F.col("start")).otherwise(F.col("next"))
    inside = (after <= F.col("end")) if closed else (after < F.col("end"))
    gap = F.when(inside, 0).otherwise(F.least(F.col("start") - F.col("before"), after - F.col("end")))
    return seen.select("start", "end", gap.cast("long").alias("distance"))


def exact_counts(windows: DataFrame, events: DataFrame, width: int) -> DataFrame:
    """Adds n_events of [start, end); windows may overlap. Events are counted by second before they meet windows."""
    seconds = events.groupBy("time").agg(F.count("*").alias("c"))
    spread = windows.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    hits = seconds.withColumn("_b", F.floor(F.col("time") / width)).join(spread, "_b").filter((F.col("time") >= F.col("start")) & (F.col("time") < F.col("end")))
    return windows.join(hits.groupBy("start", "end").agg(F.sum("c").alias("n_events")), ["start", "end"], "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))


def prorated_counts(windows: DataFrame, profile: DataFrame, size: int) -> DataFrame:
    """Adds line_count (each bucket's count times its overlap, rounded half to even) and bucket_count."""
    spread = windows.withColumn("bucket_start", F.explode(F.sequence(F.floor(F.col("start") / size) * size, F.floor((F.col("end") - 1) / size) * size, F.lit(size).cast("long"))))
    both = spread.join(profile.withColumnRenamed("line_count", "_n"), "bucket_start", "left")
    overlap = F.least("end", F.col("bucket_start") + size) - F.greatest("start", "bucket_start")
    return both.groupBy("start", "end").agg(F.coalesce(F.sum(F.bround(F.col("_n") * overlap / size)), F.lit(0.0)).cast("long").alias("line_count"), F.count("_n").alias("bucket_count"))


def banded(windows: DataFrame, t_min: Column, t_max: Column) -> DataFrame:
    """Adds band: in which third of the time the centre lies; and rank and percentile of density in it. Ranks come from one
    order of all windows, percentiles from counts of equal densities."""
    third = (t_max - t_min) / 3
    centre = (F.col("start") + F.col("end")) / 2
    rows = windows.withColumn("band", F.when(centre < t_min + third, "early").when(centre < t_min + 2 * third, "middle").otherwise("late"))
    ranked = global_rank(rows, F.col("band"), F.desc("line_count"), F.col("start"), to="_rank")
    first = F.broadcast(ranked.groupBy("band").agg(F.min("_rank").alias("_first")))  # a row a band
    own = Window.partitionBy("band")
    share = ranked.groupBy("band", "line_count").agg(F.count("*").alias("_n")).select("band", "line_count", (F.sum("_n").over(own.orderBy("line_count")) / F.sum("_n").over(own)).alias("density_percentile"))
    return ranked.join(first, "band").join(share, ["band", "line_count"]).select(*windows.columns, "band", (F.col("_rank") - F.col("_first") + 1).cast("int").alias("density_rank"), "density_percentile")


def first_windows(windows: DataFrame, least: int, most: int, k: int) -> DataFrame:
    return windows.filter(F.col("line_count").between(least, most)).orderBy("start").limit(k)


#: Bands in order, and the reason of each choice.
BANDS = ("early", "middle", "late")


def separated(rows: DataFrame, key: list[str], at: str, order: Column, distance: int, needed: Column) -> DataFrame:
    """The first `needed` rows of each key that a greedy choice in `order` (of no ties) takes, where a row goes if one that was
    taken lies less than `distance` from it along `at`.

    In rounds: a row that is the best within the distance is taken, and its neighbours go. The best row that is left is always
    taken, so there are at most as many rounds as rows are needed. Neighbours are looked for in stretches of `distance`, each a
    group of its own with the rows of those beside it.
    """
    stretch = F.floor(F.col(at) / distance)
    left = saved(rows.select(*key, at, order.alias("_order"), needed.alias("_needed"), F.struct(*rows.columns).alias("_row")), "left")
    taken, n = None, left.agg(F.max("_needed")).first()[0] or 0
    for _ in range(n):
        w = Window.partitionBy(*key, "_s").orderBy(at).rangeBetween(1 - distance, distance - 1)
        beside = left.select(*key, at, "_order", "_needed", "_row", F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("_s"))
        best = beside.withColumn("_best", F.col("_order") == F.min("_order").over(w)).filter(F.col("_s") == stretch)
        # A row's neighbours are seen whole only in its own stretch, so who is best is settled there before it takes others along.
        best = saved(best.drop("_s"), "best")
        chosen = best.filter("_best").drop("_best")
        taken = chosen if taken is None else taken.union(chosen)
        marks = best.select("*", F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("_s")).withColumn("_gone", F.max("_best").over(w)).filter(F.col("_s") == stretch)
        left = saved(marks.filter(~F.col("_gone")).drop("_gone", "_best", "_s"), "left")
        # Those taken before the best row that is left are the first of the whole choice.
        rest = left.groupBy(*key).agg(F.min("_order").alias("_next"))
        done = taken.join(rest, key, "left").filter(F.col("_next").isNull() | (F.col("_order") < F.col("_next"))).groupBy(*key).agg(F.count("*").alias("_done"))
        left = left.join(done, key, "left").filter(F.coalesce("_done", F.lit(0)) < F.col("_needed")).drop("_done")
        if left.isEmpty():
            break
    if taken is None:
        return rows.limit(0)
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("_order"))
    return taken.withColumn("_nth", nth).filter(F.col("_nth") <= F.col("_needed")).select("_row.*")


def selected_windows(windows: DataFrame, quotas: dict[str, int], quantile: float, separation: int) -> DataFrame:
    """Background windows with a quota for each band: those nearest a density quantile whose centres lie `separation` apart; then,
    if too few, the next best. Adds window_id (bg_001, ... by band, chosen ones first) and selection_reason."""
    quota = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv)), F.col("band")), F.lit(0))
    order = F.struct(F.abs(F.col("density_percentile") - quantile).alias("off"), (-F.col("line_count")).alias("less"), F.col("start").alias("at"), F.col("end").alias("to"))
    rows = windows.withColumn("_at", F.col("start") + F.col("end")).withColumn("_by", order).withColumn("_quota", quota).filter("_quota > 0")
    rows = saved(rows, "eligible")
    chosen = saved(separated(rows, ["band"], "_at", F.col("_by"), 2 * separation, F.col("_quota")).withColumn("_fill", F.lit(False)), "chosen")
    short = chosen.groupBy("band").agg(F.count("*").alias("_have"))
    rest = rows.join(chosen.select("band", "_by"), ["band", "_by"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("band").orderBy("_by"))
    rest = rest.withColumn("_nth", nth).filter(F.col("_nth") <= max(quotas.values(), default=0)).join(F.broadcast(short), "band", "left")  # a row a band
    fill = rest.filter(F.col("_nth") <= F.col("_quota") - F.coalesce("_have", F.lit(0))).drop("_nth", "_have").withColumn("_fill", F.lit(True))
    both = chosen.unionByName(fill)
    band = F.array_position(F.array(*map(F.lit, BANDS)), F.col("band"))
    number = F.row_number().over(Window.orderBy(band, "_fill", "_by"))  # as many rows as the quotas have
    how = F.when(F.col("_fill"), "deterministic_band_fill").otherwise("deterministic_band_selection")
    reason = F.concat(F.lit("profile_based_selection;band="), F.col("band"), F.lit(f";outside_redteam_margin;sufficient_auth_volume;density_target_quantile={quantile};"), how)
    return both.select(*windows.columns, F.format_string("bg_%03d", number).alias("window_id"), reason.alias("selection_reason"))


def stratified_windows(windows: DataFrame, per_band: int, quantile: float, separation: int) -> DataFrame:
    """The same with one quota for all bands."""
    out = selected_windows(windows, dict.fromkeys(BANDS, per_band), quantile, separation)
    return out.select("start", "end", "band", "line_count", "density_rank", "density_percentile")


def overlapping_pairs(windows: DataFrame) -> DataFrame:
    """Windows that start before an earlier one ends; extraction wants none."""
    return bucketed(windows, F.floor(F.col("start") / SPAN), ["start", "end"], [], before=(F.max, "end", "before")).filter(F.col("start") < F.col("before"))


def extract(events: DataFrame, windows: DataFrame, keep: list[str], width: int = SPAN, merged: bool = False) -> DataFrame:
    """Events inside half-open windows, with columns `keep` of their window; raises if windows overlap, which merged ones can't."""
    if not merged:
        windows = saved(windows, "windows")
        bad = overlapping_pairs(windows).head(1)
        if bad:
            raise ValueError(f"windows overlap at {bad[0]['start']}")
    return in_intervals(events, windows, width, half_open=True, keep=keep)
