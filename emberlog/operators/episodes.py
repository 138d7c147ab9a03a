"""Sessions of signal-bearing events, their scores, gates and suppression."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import global_rank, rows_of
from .novelty import FANOUT, FIRST_TIME, NoveltyConfig, hits_of_mask, risk_of_mask, signal_masks, signals_of_mask
from .tables import saved, small


@dataclass(frozen=True)
class Preset:
    """Limits of scoring and gating. The names of gates are A to E; see gate()."""

    name: str = "pruned"
    window: int = 300
    min_events: int = 3
    min_score: float = 0.78
    low_novelty: float = 0.25
    low_novelty_penalty: float = 0.08
    a_novelty: float = 0.25
    a_duration: int = 900
    a_dests: int = 24
    b_bounded: bool = True
    c_novelty: float = 0.30
    c_dests: int | None = 24
    d_novelty: float = 0.20
    e_strict: bool = True
    order: str = "ABC"
    compact_dests: int = 12
    compact_duration: int = 600
    soft_duration: int = 420
    long_duration: int = 1200
    a_needs_fanout: bool = False
    compact_bonus: float = 0.0
    fanout_bonus: float = 0.0
    fanout_bonus_novelty: float = 0.15
    suppress_low_novelty: bool = False


PRUNED = Preset()
RECALL = replace(PRUNED, name="recall", low_novelty_penalty=0.06, b_bounded=False, c_dests=None, d_novelty=0.15, e_strict=False, order="ADEBC", compact_bonus=0.08, fanout_bonus=0.06)
BALANCED = replace(RECALL, name="balanced", min_score=0.79, low_novelty_penalty=0.08, a_novelty=0.30, a_duration=720, a_dests=20, compact_bonus=0.06, fanout_bonus=0.04)
LOOSE = replace(PRUNED, name="loose", min_score=0.80, low_novelty=0.35, low_novelty_penalty=0.10, a_novelty=0.35, a_duration=600, a_dests=18, b_bounded=False, c_dests=None, compact_dests=10, compact_duration=420, soft_duration=300, long_duration=900)
TIGHT = replace(LOOSE, name="tight", min_score=0.82, low_novelty=0.50, low_novelty_penalty=0.20, a_novelty=0.50, a_duration=420, a_dests=12, a_needs_fanout=True, suppress_low_novelty=True)
PRESETS = {p.name: p for p in (PRUNED, RECALL, BALANCED, LOOSE, TIGHT)}


def next_ticks(ticks: DataFrame, wait: int, within: tuple[str, ...] = ()) -> DataFrame:
    """For each tick t (distinct times): pop, the first tick at t + wait or later, or null."""
    base = ticks.select(*within, "time").distinct()
    return with_exits(base, base, wait, within, "pop")


def with_exits(rows: DataFrame, ticks: DataFrame, wait: int, within: tuple[str, ...] = (), to: str = "pop") -> DataFrame:
    """Adds to rows the first tick at time + wait or later, or null. Rows without a time go.

    Ticks are put in buckets of `wait` seconds, and rows stand among those of the bucket in which they ask. The answer is there, or
    it is the first tick of the next bucket that has any; the latter is a window over buckets, of which there are few, never over
    ticks.
    """
    w = list(within)
    number = F.floor(F.col("time") / wait)
    ticks, rows = ticks.filter("time is not null"), rows.filter("time is not null")
    asking = rows.select("*", (F.col("time") + wait).alias("_at"), (number + 1).alias("_ask"), F.lit(None).cast("long").alias("_tick"))
    both = asking.unionByName(ticks.select(*w, F.col("time").alias("_at"), number.alias("_ask"), F.col("time").alias("_tick")), allowMissingColumns=True)
    inside = F.min("_tick").over(Window.partitionBy(*w, "_ask").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_inside", inside).filter("_tick is null")
    # Later buckets as those before in the opposite order, which Spark goes through once. Buckets in which rows ask may be empty.
    heads = ticks.groupBy(*w, number.alias("_ask")).agg(F.min("time").alias("_head"))
    asked = rows.select(*w, (number + 1).alias("_ask")).distinct().withColumn("_head", F.lit(None).cast("long"))
    later = Window.partitionBy(*w).orderBy(F.desc("_ask")).rowsBetween(Window.unboundedPreceding, -1)
    after = heads.union(asked).groupBy(*w, "_ask").agg(F.min("_head").alias("_head")).withColumn("_after", F.min("_head").over(later)).drop("_head")
    own = [F.col(f"`{c}`") for c in rows.columns]
    return found.join(after, w + ["_ask"]).select(*own, F.coalesce("_inside", "_after").alias(to))


def sessions(signals: DataFrame, ticks: DataFrame, window: int = 300, within: tuple[str, ...] = (), carried: DataFrame | None = None) -> DataFrame:
    """Adds `session` (1, 2, ... for each source and user) to events with signals, `pop`, the exit of their entries, and `opens`,
    whether the event is its session's first.

    carried: rows of an earlier batch with all three; their sessions stay, and open ones may go on.

    An episode is closed through one queue shared by all keys: an entry written at t leaves it at the first event of any key at
    t + 2 * window or later, and closes its key's episode if that has been silent for a window by then. In closed form: an
    event starts a new episode if no event of its key came before, or if the latest exit among entries of its key, written 2
    windows or more before it, is a window or more after the key's previous event.
    """
    w = list(within)
    key = w + ["source", "user"]
    times = ticks.select(*w, "time")
    if carried is None:
        rows = with_exits(signals, times, 2 * window, within)
    else:
        # An exit that no earlier batch had a tick for is the first one here, if there is one.
        both = signals.unionByName(carried, allowMissingColumns=True)
        rows = with_exits(both, times.union(carried.select(*w, "time")), 2 * window, within, "_pop").withColumn("pop", F.coalesce("pop", "_pop")).drop("_pop").withColumnsRenamed({"session": "_known", "opens": "_opened"})
    rows = saved(rows, "signals")
    new = F.col("_new") if carried is None else F.col("_new") & F.col("_known").isNull()
    marked = starts(rows, key, window).withColumn("_new", new.cast("int"))
    upto = rows_of("upto", [*key, "_bucket"], ["time", "seq"])
    marked = saved(marked.withColumn("_here", F.sum("_new").over(upto)), "marked")
    totals = marked.groupBy(*key, "_bucket").agg(F.sum("_new").alias("_n"))
    before = small(totals.select(*key, "_bucket", F.coalesce(F.sum("_n").over(rows_of("before", key, ["_bucket"])), F.lit(0)).alias("_before")))
    out = marked.join(before, [*key, "_bucket"])
    number = F.col("_here") + F.col("_before")
    if carried is None:
        return out.withColumn("session", number).withColumn("opens", F.col("_new") == 1).drop("_here", "_before", "_new", "_bucket")
    newest = small(carried.groupBy(*key).agg(F.max("session").alias("_newest")))
    out = out.join(newest, key, "left").withColumn("session", F.coalesce("_known", number + F.coalesce("_newest", F.lit(0))))
    return out.withColumn("opens", F.coalesce("_opened", F.col("_new") == 1)).drop("_here", "_before", "_new", "_known", "_opened", "_bucket", "_newest")


def starts(rows: DataFrame, key: list[str], window: int, span: int = 3600) -> DataFrame:
    """Adds `_new`, whether a row (key, time, seq, pop) starts a session, and `_bucket`, its span of time; see sessions().

    A key is as many groups as it has spans. What a row has to see of earlier ones is in its own span, in the last two windows of
    the one before (whose rows come along, without their other columns), or else is the last row before those: exits rise with
    time, so the last entry has the latest one, and it is more than two windows old. That row is found from each span's last.
    """
    span = max(span, 2 * window)
    rows = rows.withColumn("_bucket", F.floor(F.col("time") / span))
    near = F.col("time") >= (F.col("_bucket") + 1) * span - 2 * window
    past = rows.filter(near).select(*key, (F.col("_bucket") + 1).alias("_bucket"), "time", "seq", "pop")
    far = lambda c: F.max(F.when(~near, F.col(c)))
    last = rows.groupBy(*key, "_bucket").agg(F.max("time").alias("time"), F.max("pop").alias("pop"), far("time").alias("_time"), far("pop").alias("_pop"))
    by = Window.partitionBy(*key).orderBy("_bucket")
    older, beside = by.rangeBetween(Window.unboundedPreceding, -2), by.rangeBetween(-1, -1)
    carry = last.select(*key, "_bucket", *(F.greatest(F.max(c).over(older), F.max(f"_{c}").over(beside)).alias(c) for c in ("time", "pop"))).filter("time is not null")
    seen = past.union(carry.select(*key, "_bucket", "time", F.lit(None).cast("long").alias("seq"), "pop")).withColumn("_past", F.lit(True))
    both = rows.withColumn("_past", F.lit(False)).unionByName(seen, allowMissingColumns=True)
    by_time = Window.partitionBy(*key, "_bucket").orderBy("time").rangeBetween(Window.unboundedPreceding, -2 * window)
    before = F.lag("time").over(Window.partitionBy(*key, "_bucket").orderBy("time", "seq"))
    new = F.coalesce(before.isNull() | (F.max("pop").over(by_time) >= before + window), F.lit(False))
    return both.withColumn("_new", new).filter(~F.col("_past")).drop("_past")


def aggregate(rows: DataFrame, velocity_window: int = 120, within: tuple[str, ...] = ()) -> DataFrame:
    """One row for each episode, with counts, signals, and the most destinations first seen within velocity_window seconds, from
    events with a mask of signals (novelty.signal_masks) in sessions. Events are added up by destination first."""
    key = list(within) + ["source", "user", "session"]
    hits = hits_of_mask()
    dests = rows.groupBy(*key, "dest").agg(
        F.min("time").alias("t"),
        F.max("time").alias("end_time"),
        F.max(F.when(F.col("opens"), F.col("seq"))).alias("start_seq"),
        F.count("*").alias("events_count"),
        F.bit_or("mask").alias("mask"),
        F.count_if(hits > 0).alias("first_time_event_count"),
        F.sum(hits).alias("first_time_signal_hits"),
        F.max(risk_of_mask()).alias("max_risk"),
    )
    recent = F.count("*").over(Window.partitionBy(*key).orderBy("t").rangeBetween(-velocity_window, 0))
    out = dests.withColumn("recent", recent).groupBy(*key).agg(
        F.min("t").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.max("start_seq").alias("start_seq"),
        F.sum("events_count").alias("events_count"),
        F.bit_or("mask").alias("mask"),
        F.sum("first_time_event_count").alias("first_time_event_count"),
        F.sum("first_time_signal_hits").alias("first_time_signal_hits"),
        F.max("max_risk").alias("max_risk"),
        F.count("*").alias("destination_count"),
        F.max("recent").alias("peak_velocity_new_dests"),
        F.array_sort(F.collect_list("dest")).alias("destinations"),
    )
    out = out.withColumn("signals", signals_of_mask()).drop("mask")
    return out.withColumn("duration", F.col("end_time") - F.col("start_time")).withColumn("user_count", F.when(F.col("user") != "", 1).otherwise(0)).withColumn("episode_key", F.concat_ws("|", *within, "source", "user", "start_time", "start_seq"))


def has(name: str) -> Column:
    return F.array_contains("signals", name)


def tagged(df: DataFrame, **tags: Column) -> DataFrame:
    return df.withColumn("signals", F.array_sort(F.array_union("signals", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in tags.items()))))))


def gate(p: Preset) -> Column:
    """The first gate, in the preset's order, that an episode passes; `none` otherwise."""
    sud, suf, vel, compact = has("first_time_source_user_to_dest"), has("source_user_fanout"), has("fanout_velocity"), has("compact_lateral_burst")
    ft = sum((has(n).cast("int") for n in FIRST_TIME), F.lit(0))
    nov, dur, d, speed = F.col("novelty_ratio"), F.col("duration"), F.col("destination_count"), F.col("fanout_velocity_score")
    b = sud & (speed >= 0.60) & (ft >= 2)
    if p.b_bounded:
        b = b & vel & (suf | compact) & (dur <= 900) & (d <= 30) & (nov >= 0.10)
    c = sud & (nov >= p.c_novelty) & (d >= 3) & (dur <= 900)
    e = sud & suf & (ft >= 2)
    gates = {
        "A": sud & compact & (suf if p.a_needs_fanout else suf | vel) & (nov >= p.a_novelty) & (dur <= p.a_duration) & (d <= p.a_dests),
        "B": b,
        "C": c & (d <= p.c_dests) if p.c_dests else c,
        "D": sud & compact & (ft >= 2) & (dur <= 900) & (d <= 24) & (nov >= p.d_novelty),
        "E": e & (dur <= 720) & (d <= 20) & (((compact | vel) & (nov >= 0.20)) | ((d <= 12) & (dur <= 600) & (nov >= 0.35))) if p.e_strict else e & (dur <= 900) & (d <= 30) & (nov >= 0.15),
    }
    out = F
    for name in p.order:
        out = out.when(gates[name], F.lit(name))
    return out.otherwise(F.lit("none"))


def shape(episodes: DataFrame, p: Preset = PRUNED) -> DataFrame:
    """Adds compactness, velocity, novelty, tags, raw_score, entropy_penalty, score and candidate_gate."""
    span = F.greatest(F.lit(1), F.col("duration"))
    df = episodes.withColumn("compactness_score", F.least(F.lit(1.0), F.col("destination_count") / span / 0.03))
    df = df.withColumn("fanout_velocity_score", F.least(F.lit(1.0), F.col("peak_velocity_new_dests") / 3)).withColumn("novelty_ratio", F.col("first_time_event_count") / F.greatest(F.lit(1), F.col("events_count")))
    n, d, dur = F.col("events_count"), F.col("destination_count"), F.col("duration")
    df = tagged(df, compact_lateral_burst=n.between(3, 30) & d.between(3, p.compact_dests) & (span <= p.compact_duration), fanout_velocity=F.col("fanout_velocity_score") >= 0.60)
    # The weights of an episode's signals.
    weights = (("first_time_source_user_to_dest", 0.42), ("first_time_user_to_dest", 0.22), ("first_time_source_to_dest", 0.18), ("source_user_fanout", 0.20), ("source_fanout", 0.10), ("user_fanout", 0.10), ("compact_lateral_burst", 0.22))
    raw = sum((F.when(has(k), v).otherwise(0.0) for k, v in weights), F.lit(0.0)) + F.when(has("fanout_velocity"), 0.22 * F.col("fanout_velocity_score")).otherwise(0.0) + 0.08 * F.col("compactness_score")
    classes = sum((has(k).cast("int") for k in (*FIRST_TIME, *FANOUT, "compact_lateral_burst", "fanout_velocity")), F.lit(0))
    sud, compact, suf, vel = has("first_time_source_user_to_dest"), has("compact_lateral_burst"), has("source_user_fanout"), has("fanout_velocity")
    low = classes < 3
    converged = sud & compact & (suf | vel)
    rescue = sud & has("first_time_user_to_dest") & compact & ~vel & F.lit(p.compact_bonus > 0)
    spread = sud & suf & (F.col("novelty_ratio") >= p.fanout_bonus_novelty) & F.lit(p.fanout_bonus > 0)
    df = df.withColumn("_raw", F.when(low, raw * 0.5).otherwise(raw) + F.when(converged, 0.10).otherwise(0.0) + F.when(rescue, p.compact_bonus).otherwise(0.0) + F.when(spread, p.fanout_bonus).otherwise(0.0))
    df = df.withColumn("raw_score", F.least(F.lit(1.0), F.col("_raw"))).drop("_raw")
    # The penalties.
    penalties = {
        "entropy_many_events": (n > 80, 0.10),
        "entropy_extreme_events": (n > 200, 0.20),
        "entropy_long_duration": (dur > p.long_duration, 0.30),
        "entropy_soft_duration": ((dur > p.soft_duration) & (dur <= p.long_duration), 0.12),
        "entropy_oversized_fanout": (d > 25, 0.35),
        "entropy_excessive_destinations": (d > 40, 0.20),
        "entropy_many_users": (F.col("user_count") > 8, 0.15),
        "entropy_low_novelty": (F.col("novelty_ratio") < p.low_novelty, p.low_novelty_penalty),
    }
    df = df.withColumn("entropy_penalty", F.least(F.lit(0.75), sum((F.when(c, v).otherwise(0.0) for c, v in penalties.values()), F.lit(0.0))))
    df = df.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("raw_score") - F.col("entropy_penalty")))).withColumn("candidate_gate", gate(p))
    return tagged(df, low_convergence_penalty=low, propagation_convergence_bonus=converged, compact_rescue_bonus=rescue, source_user_fanout_rescue_bonus=spread, **{k: c for k, (c, _) in penalties.items()})


def suppression(p: Preset = PRUNED) -> Column:
    """Why an episode is held back, in order; null if it is accepted. 1e-9 keeps sums of decimals at the limit on its good side."""
    first = has("first_time_source_to_dest") | has("first_time_user_to_dest")
    out = F.when(F.col("events_count") < p.min_events, "too_few_events").when(~has("first_time_source_user_to_dest"), "missing_source_user_dest_novelty").when(~first, "missing_first_time_convergence").when(F.col("candidate_gate") == "none", "no_candidate_gate")
    if p.suppress_low_novelty:
        out = out.when((F.col("novelty_ratio") < p.low_novelty) & (F.col("fanout_velocity_score") < 0.60) & ~has("compact_lateral_burst"), "low_novelty_without_velocity_or_compactness")
    return out.when(F.col("score") < p.min_score - 1e-9, "below_min_score")


def finalised(episodes: DataFrame, p: Preset = PRUNED) -> DataFrame:
    return shape(episodes, p).withColumn("suppression_reason", suppression(p)).withColumn("preset", F.lit(p.name))


def raw_episodes(events: DataFrame, novelty: NoveltyConfig, window: int = 300) -> DataFrame:
    """Episodes before any scoring; what all presets share. Events are stored, since memory, warm-up and ticks read them too."""
    events = saved(events.select(*novelty.within, "time", "seq", "source", "user", "dest"), "events")
    signals = signal_masks(events, novelty).filter("mask > 0")
    return aggregate(sessions(signals, events, window, novelty.within), within=novelty.within)


def detect(events: DataFrame, novelty: NoveltyConfig = NoveltyConfig(), p: Preset = PRUNED) -> DataFrame:
    """The whole chain: events (time, seq, source, user, dest) to finalised episodes, accepted and suppressed."""
    return finalised(raw_episodes(events, novelty, p.window), p)


def swept(episodes: DataFrame, presets: list[Preset]) -> DataFrame:
    """Every preset over the same episodes, told apart by the column preset."""
    out = None
    for p in presets:
        one = finalised(episodes, p)
        out = one if out is None else out.unionByName(one)
    return out


def numbered(episodes: DataFrame) -> DataFrame:
    """Adds episode_id in order of creation: a sort of episodes, not of events."""
    return global_rank(episodes, F.col("start_time"), F.col("start_seq"), to="episode_id")


def ranked(episodes: DataFrame, limit: int = 10_000) -> DataFrame:
    """The best accepted episodes."""
    return episodes.filter("suppression_reason is null").orderBy(F.desc("score"), F.desc("raw_score"), F.desc("fanout_velocity_score"), "episode_key").limit(limit)


def summary_counts(episodes: DataFrame) -> DataFrame:
    """(kind, name, n): episodes by gate, signal and reason."""
    one = lambda kind, col: episodes.groupBy(F.lit(kind).alias("kind"), col.alias("name")).agg(F.count("*").alias("n"))
    return one("gate", F.col("candidate_gate")).union(one("reason", F.coalesce("suppression_reason", F.lit("accepted")))).union(episodes.select(F.explode("signals").alias("s")).groupBy(F.lit("signal").alias("kind"), F.col("s").alias("name")).agg(F.count("*").alias("n")))


#: Weights of a host's signals; other signals weigh 5.
HOST_WEIGHTS = {"suspicious_port": 80, "process_burst": 45, "failed_auth": 45, "auth_lateral": 25, "dns_flood": 30, "large_flow": 15, "redteam_overlap": 100}


def host_episodes(signals: DataFrame, window: int = 300, examples: int = 5) -> DataFrame:
    """Episodes of a host in fixed buckets of time, from rows (time, seq, source_rank, host, signals, risk)."""
    rows = signals.withColumn("bucket", F.floor(F.col("time") / window))
    out = rows.groupBy("host", "bucket").agg(
        F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.count("*").alias("events_count"), F.max("risk").alias("max_risk"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("signals")))).alias("signals"), F.min_by("seq", F.struct("source_rank", "time", "seq")).alias("first_example")
    )
    weights = F.create_map(*(F.lit(x) for kv in HOST_WEIGHTS.items() for x in kv))
    points = F.aggregate("signals", F.lit(0), lambda acc, s: acc + F.coalesce(F.try_element_at(weights, s), F.lit(5)))
    score = 100 * F.col("max_risk") + points + F.least(F.lit(30), F.floor(F.col("events_count") / 10))
    port, failed, lateral, flood, burst = (has(n) for n in ("suspicious_port", "failed_auth", "auth_lateral", "dns_flood", "process_burst"))
    joint = port & (burst | failed | lateral)
    tier = F.when(joint, 1).when(failed & (burst | flood), 2).when(flood & (burst | lateral), 3).otherwise(4)
    action = F.when(has("redteam_overlap"), "ground_truth_match").when(joint | (F.col("max_risk") >= 0.75) | (F.col("score") >= 140), "human_review").when((F.col("max_risk") >= 0.45) | (F.col("score") >= 90), "collect_evidence").otherwise("watch")
    return out.withColumn("score", F.round(score, 3)).withColumn("tier", tier).withColumn("action", action)


def kept_hosts(episodes: DataFrame) -> DataFrame:
    return episodes.filter((F.size("signals") >= 2) | (F.col("max_risk") >= 0.45))
