"""Older detectors: other session rules, scores that each event can raise, tags that stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .episodes import has, sessions
from .graph import bucketed
from .novelty import FANOUT, FIRST_TIME, NoveltyConfig, event_signals, order_key, running_distincts, trailing_distinct, warmup_end
from .tables import saved

HOUR = 3600
KEY = ["source", "user"]
FAR = (1 << 62) - 1
#: What signals add to an event's risk, in four detectors.
EARLY_FIRST, EARLY_FANOUT = 0.35, 0.25
RATCHET_WEIGHTS = {"first_time_source_to_dest": 0.28, "first_time_user_to_dest": 0.32, "first_time_source_user_to_dest": 0.38, "source_fanout": 0.14, "user_fanout": 0.14, "source_user_fanout": 0.24}
STRICT_WEIGHTS = {"first_time_source_to_dest": 0.22, "first_time_user_to_dest": 0.26, "first_time_source_user_to_dest": 0.42, "source_fanout": 0.10, "user_fanout": 0.10, "source_user_fanout": 0.20, "fanout_velocity": 0.22}
STICKY_WEIGHTS = {"first_time_source_to_dest": 0.16, "first_time_user_to_dest": 0.18, "first_time_source_user_to_dest": 0.30, "source_fanout": 0.12, "user_fanout": 0.10, "source_user_fanout": 0.16}


def next_tick(rows: DataFrame, at: Column, ticks: DataFrame, to: str) -> DataFrame:
    """Adds the first tick (time, seq) at time `at` or later, as a struct; null if there is none."""
    none = F.lit(None)
    row = F.struct(*rows.columns)
    kind = rows.select(row.alias("r")).schema["r"].dataType
    both = rows.select(row.alias("_row"), at.alias("_at"), none.cast("struct<time: bigint, seq: bigint>").alias("_tick")).union(ticks.select(none.cast(kind), "time", F.struct("time", "seq")))
    found = bucketed(both, F.floor(F.col("_at") / HOUR), ["_at", F.col("_tick").isNotNull()], [], **{to: (F.min, "_tick", "from")})
    return found.filter("_row is not null").select("_row.*", to)


def heads(events: DataFrame) -> DataFrame:
    """The first event of each second."""
    return events.groupBy("time").agg(F.min("seq").alias("seq"))


def visited(hops: DataFrame, start: DataFrame) -> DataFrame:
    """The times that a chain (time, next) passes from `start` (a row or none) on. Each round joins the chain's steps with
    themselves, so that they lead twice as far, and adds what is reached from all that was: as many rounds as the logarithm of
    the chain's length."""
    steps, seen = saved(hops.filter("next is not null"), "steps"), saved(start.filter("time is not null").select("time"), "visited")
    while True:
        more = seen.join(steps, "time").select(F.col("next").alias("time"))
        new = saved(seen.union(more).distinct(), "visited")
        if new.count() == seen.count():
            return new
        ahead = steps.select(F.col("time").alias("next"), F.col("next").alias("_then"))
        steps, seen = saved(steps.join(ahead, "next").select("time", F.col("_then").alias("next")), "steps"), new


def cleanup_ticks(ticks: DataFrame, window: int, span: int = 86_400) -> DataFrame:
    """Times of clean-ups: the first tick more than a window after time 0, then always the first more than a window after the one
    before.

    A chain through all ticks, followed in spans of time at once: inside a span each tick's way out of it is found from the
    last tick back; ticks at which a chain can enter a span, at most `window` + 1 of each, are joined to those they lead to, see
    visited(); then every span walks on from where the chain enters it.
    """
    after = saved(next_tick(ticks.select("time"), F.col("time") + window + 1, ticks, "_n").select("time", F.col("_n.time").alias("next"), F.floor(F.col("time") / span).alias("span")), "next-ticks")

    def ways_out(pdf):
        out = {}
        for t, n in sorted(zip(pdf["time"], pdf["next"], strict=True), reverse=True):
            out[t] = out.get(n, n)  # a tick in this span leads on as its own way out does
        return pdf.assign(next=[out[t] for t in pdf["time"]])

    out = after.groupBy("span").applyInPandas(ways_out, "time long, next double, span long").withColumn("next", F.col("next").cast("long"))
    first = after.filter(F.col("time") > window).agg(F.min("time").alias("time"))
    enters = out.select(F.col("next").alias("time")).filter("time is not null").union(first).distinct()
    entered = visited(out.join(enters, "time").select("time", "next"), first).select(F.floor(F.col("time") / span).alias("span"), F.col("time").alias("enter"))

    def walk(pdf):
        way, at, seen = dict(zip(pdf["time"], pdf["next"], strict=True)), pdf["enter"].iloc[0], []
        while at == at and at is not None and at in way:
            seen.append(int(at))
            at = way[at]
        return pdf.iloc[:0][["time"]].reindex(range(len(seen))).assign(time=seen)

    return after.join(entered, "span").groupBy("span").applyInPandas(walk, "time long")


def until_sessions(rows: DataFrame) -> DataFrame:
    """Adds session and start_time to rows (source, user, time, seq, until: struct of time and seq): the first event of a session
    says until when it lasts, that place included; null means to the end. Rows of a key lie together, sorted, and a task holds
    one key's end at a time."""

    def fold(batches):
        key, end, start, n = None, None, 0, 0
        for pdf in batches:
            found, starts = [], []
            for source, user, time, seq, ut, us in zip(pdf["source"], pdf["user"], pdf["time"], pdf["seq"], pdf["until_time"], pdf["until_seq"], strict=True):
                if (source, user) != key:
                    key, n, end = (source, user), 0, (-1, -1)
                if (time, seq) > end:
                    start, n, end = time, n + 1, (ut, us)
                found.append(n)
                starts.append(start)
            yield pdf[["source", "user", "time", "seq"]].assign(session=found, start_time=starts)

    own = rows.select(*KEY, "time", "seq", F.coalesce("until.time", F.lit(FAR)).alias("until_time"), F.coalesce("until.seq", F.lit(FAR)).alias("until_seq"))
    marks = own.repartition(*KEY).sortWithinPartitions(*KEY, "time", "seq").mapInPandas(fold, "source string, user string, time long, seq long, session long, start_time long")
    return rows.drop("until").join(marks, [*KEY, "time", "seq"])


def anchored_sessions(signals: DataFrame, window: int = 300) -> DataFrame:
    """Sessions that end `window` seconds after their first event: an event starts a new one if it comes at start + window or
    later."""
    until = F.struct((F.col("time") + window - 1).alias("time"), F.lit(FAR).alias("seq"))
    return until_sessions(signals.withColumn("until", until))


def early_signals(events: DataFrame, warmup: int, gated: bool, numbered: bool, users_of_source: bool = False) -> DataFrame:
    """Adds signals and risk to events (and, if there is one, a column success, without which nothing is signalled): first-time
    edges after the warm-up, fan-out (after it too, if gated), named with its size if numbered, and users of a source."""
    named = events.withColumn("_named", F.when(F.col("user") != "", F.col("user")))
    measures = {"_s": (["source"], "dest"), "_u": (["user"], "dest")} | ({"_su": (["source"], "_named")} if users_of_source else {})
    e = running_distincts(named, measures).withColumn("_sd", F.col("_s_first")).withColumn("_ud", F.col("_u_first") & (F.col("user") != ""))
    e = e.crossJoin(F.broadcast(warmup_end(events, warmup))).withColumn("_warm", order_key() >= F.col("warm"))
    good = F.col("success") if "success" in events.columns else F.lit(True)
    wide = good & (F.col("_warm") if gated else F.lit(True))
    name = lambda kind, size: F.concat(F.lit(f"{kind}_"), size) if numbered else F.lit(kind)
    tests = [(F.lit("first_time_user_to_dest"), EARLY_FIRST, good & F.col("_warm") & F.col("_ud")), (F.lit("first_time_source_to_dest"), EARLY_FIRST * 0.8, good & F.col("_warm") & F.col("_sd"))]
    tests += [(name("source_fanout", F.col("_s")), EARLY_FANOUT, wide & (F.col("_s") >= 5)), (name("user_fanout", F.col("_u")), EARLY_FANOUT, wide & (F.col("user") != "") & (F.col("_u") >= 5))]
    if users_of_source:
        tests.append((F.lit("source_user_fanout"), EARLY_FANOUT, wide & (F.col("_su") >= 3)))
    signals = F.array_sort(F.array_compact(F.array(*(F.when(t, n) for n, _, t in tests))))
    risk = F.least(F.lit(1.0), sum((F.when(t, w).otherwise(0.0) for _, w, t in tests), F.lit(0.0)))
    return e.select(*events.columns, signals.alias("signals"), risk.alias("risk"))


def early_episodes(rows: DataFrame, least_signals: int = 2, least_events: int = 1) -> DataFrame:
    """One row for each session, and whether it is kept: enough different signals and events."""
    out = rows.groupBy(*KEY, "session", "start_time").agg(F.max("time").alias("end_time"), F.count("*").alias("events_count"), F.countDistinct("dest").alias("destination_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("signals")))).alias("signals"), F.max("risk").alias("max_risk"))
    return out.withColumn("kept", (F.size("signals") >= least_signals) & (F.col("events_count") >= least_events))


def every_event_episodes(events: DataFrame, warmup: int, window: int = 300) -> DataFrame:
    """Every event of a key joins its episode, also failed and unsignalled ones. The first event of any key that comes more than a
    window after an episode's start closes it, and belongs to it if it is of its key."""
    rows = early_signals(events, warmup, gated=False, numbered=True)
    return early_episodes(until_sessions(next_tick(rows, F.col("time") + window + 1, heads(events), "until")))


def cleanup_episodes(events: DataFrame, warmup: int, window: int = 300) -> DataFrame:
    """Events with signals only; episodes older than a window are closed at clean-ups, which are more than a window apart."""
    ticks = heads(events)
    cleanups = saved(cleanup_ticks(ticks, window), "clean-ups").withColumn("seq", F.lit(FAR))
    rows = early_signals(events, warmup, gated=True, numbered=True).filter(F.size("signals") > 0)
    rows = next_tick(rows, F.col("time") + window + 1, cleanups, "_c")
    until = F.when(F.col("_c").isNotNull(), F.struct((F.col("_c.time") - 1).alias("time"), F.lit(FAR).alias("seq")))
    return early_episodes(until_sessions(rows.withColumn("until", until).drop("_c")))


def anchored_episodes(events: DataFrame, warmup: int, window: int = 300) -> DataFrame:
    """Events with signals, users of a source among them; sessions from a fixed start; two signals and three events at least."""
    rows = early_signals(events, warmup, gated=True, numbered=False, users_of_source=True).filter(F.size("signals") > 0)
    return early_episodes(anchored_sessions(rows, window), least_events=3)


def risk_of(weights: dict[str, float]) -> Column:
    return F.least(F.lit(1.0), sum((F.when(has(k), v).otherwise(0.0) for k, v in weights.items()), F.lit(0.0)))


EPISODE = [*KEY, "session"]


def in_spans(rows: DataFrame, **values) -> DataFrame:
    """Running values (see graph.bucketed) of episodes by span of time, so that a long episode is many groups. rows are read twice, so
    they are stored first."""
    return bucketed(saved(rows, "steps"), F.floor(F.col("time") / HOUR), ["time", "seq"], EPISODE, **values)


def so_far(rows: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """Adds what an episode is at each of its events: n, d (destinations), duration, and s_<tag>, whether a tag has come up."""
    out = running_distincts(saved(rows, "episode-events"), {"_d": (EPISODE, "dest")}).withColumn("d", F.col("_d") + F.col("_d_first").cast("long")).drop("_d", "_d_first")
    out = in_spans(out, n=(F.sum, F.lit(1), "upto"), _start=(F.min, F.col("time"), "upto"), **{f"s_{t}": (F.max, has(t), "upto") for t in tags})
    return out.withColumn("duration", F.col("time") - F.col("_start")).drop("_start")


#: Events, and chunks of them, that one fold takes at once.
CHUNK = 1024


def clamped(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(hi, F.greatest(lo, x))


def chained(steps: Column) -> Column:
    """One step that does what an array of steps does in order. A step (c, lo, hi) takes a score s to s + c, held between lo and hi;
    two of them in a row are such a step again."""
    first = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def then(f: Column, g: Column) -> Column:
        return F.struct((f["c"] + g["c"]).alias("c"), clamped(f["lo"] + g["c"], g["lo"], g["hi"]).alias("lo"), clamped(f["hi"] + g["c"], g["lo"], g["hi"]).alias("hi"))

    return F.aggregate(steps, first, then)


def ratcheted(rows: DataFrame, change: Column, chunk: int | None = None) -> DataFrame:
    """One row for each episode. At each event the score becomes the larger of itself and the event's risk, plus `change`, between
    0 and 1.

    That is s -> s + change, not below risk + change and inside 0 and 1: a step as chained() puts together. So events, numbered by
    n in their episode, are folded chunk by chunk, the chunks' steps again, and then what is left, which is one array of an
    episode's events over chunk * chunk.
    """
    size = chunk or CHUNK
    low = clamped(F.col("risk") + F.col("_b"), F.lit(0.0), F.lit(1.0))
    steps = rows.withColumn("_b", change.cast("double")).select(*EPISODE, (F.col("n") - 1).alias("at"), F.col("_b").alias("c"), low.alias("lo"), F.lit(1.0).alias("hi"))
    for last in (False, False, True):
        steps = steps.withColumn("_at", F.lit(0).cast("long") if last else F.floor(F.col("at") / size)).groupBy(*EPISODE, "_at").agg(chained(F.array_sort(F.collect_list(F.struct("at", "c", "lo", "hi")))).alias("x"))
        steps = steps.select(*EPISODE, F.col("_at").alias("at"), "x.*")
    score = steps.select(*EPISODE, clamped(F.col("c"), F.col("lo"), F.col("hi")).alias("score"))
    out = rows.groupBy(*EPISODE).agg(F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.count("*").alias("events_count"), F.countDistinct("dest").alias("destination_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("signals")))).alias("signals"))
    return out.join(score, EPISODE)


def of(condition: Column, value: float) -> Column:
    return F.when(condition, value).otherwise(0.0)


def first_time_kinds() -> Column:
    return sum((F.col(f"s_{t}").cast("int") for t in FIRST_TIME), F.lit(0))


def ratchet_scores(events: DataFrame, novelty: NoveltyConfig = NoveltyConfig(), window: int = 300) -> DataFrame:
    """Episodes whose score each event can raise: .18 while they are compact, .08 for each kind of first-time edge so far, less
    .30 while they reach too many destinations and .15 while they are long. Kept with three events, .75 and a first-time edge."""
    signals = event_signals(events, novelty).filter(F.size("signals") > 0).withColumn("risk", risk_of(RATCHET_WEIGHTS))
    rows = so_far(sessions(signals, events, window), FIRST_TIME)
    long = F.greatest(F.lit(1), F.col("duration"))
    change = of(F.col("n").between(3, 25) & (F.col("d") <= 10) & (long <= window), 0.18) + 0.08 * first_time_kinds() - of(F.col("d") > 25, 0.30) - of(long > window, 0.15)
    out = ratcheted(rows, change)
    return out.withColumn("kept", (F.col("events_count") >= 3) & (F.col("score") >= 0.75 - 1e-9) & F.exists("signals", lambda s: s.startswith("first_time")))


def strict_ratchet_scores(events: DataFrame, novelty: NoveltyConfig = NoveltyConfig(), window: int = 300) -> DataFrame:
    """The same with a signal of its own for three destinations or more of a source and user in 120 seconds of events after the
    warm-up, other steps, and stricter rules: .82, a new source-user-destination, and a new edge of the source or user."""
    scored = trailing_distinct(event_signals(events, novelty), KEY, "dest", 120, "_v")
    fast = F.when(F.col("_v") >= 3, F.array_sort(F.array_append("signals", F.lit("fanout_velocity")))).otherwise(F.col("signals"))
    signals = scored.withColumn("signals", fast).drop("_v").filter(F.size("signals") > 0).withColumn("risk", risk_of(STRICT_WEIGHTS))
    rows = so_far(sessions(signals, events, window), (*FIRST_TIME, "fanout_velocity"))
    d, long = F.col("d"), F.col("duration")
    change = of(F.col("n").between(3, 30) & (d <= 10) & (long <= 420), 0.22) + of(F.col("s_fanout_velocity"), 0.10) + 0.05 * first_time_kinds() - of(d > 25, 0.35) - F.when(long > 900, 0.30).when(long > window, 0.12).otherwise(0.0)
    out = ratcheted(rows, change)
    edge = has("first_time_source_to_dest") | has("first_time_user_to_dest")
    return out.withColumn("kept", (F.col("events_count") >= 3) & (F.col("score") >= 0.82 - 1e-9) & has("first_time_source_user_to_dest") & edge)


def sticky_episodes(events: DataFrame, novelty: NoveltyConfig = NoveltyConfig(), window: int = 300) -> DataFrame:
    """Episodes that are shaped anew at each event, and keep every tag that they had once. First-time hits count each kind, so
    novelty may exceed 1."""
    signals = event_signals(events, novelty).filter(F.size("signals") > 0).withColumn("risk", risk_of(STICKY_WEIGHTS))
    rows = so_far(sessions(signals, events, window), (*FIRST_TIME, *FANOUT))
    n, d, long = F.col("n"), F.col("d"), F.greatest(F.lit(1), F.col("duration"))
    s = lambda *tags: sum((F.col(f"s_{t}").cast("int") for t in tags), F.lit(0))
    rows = rows.withColumn("velocity", F.least(F.lit(1.0), d / F.greatest(long / 60, F.lit(1.0)) / 3.0))
    rows = in_spans(rows, _hits=(F.sum, F.col("first_time_hits"), "upto"), s_compact=(F.max, n.between(3, 35) & d.between(3, 12) & (long <= 600), "upto"), s_velocity=(F.max, F.col("velocity") >= 0.65, "upto"))
    rows = rows.withColumn("novelty", F.col("_hits") / n).drop("_hits")
    rows = rows.withColumn("kinds", s(*FIRST_TIME, *FANOUT, "compact", "velocity"))
    # The penalties.
    penalties = {"entropy_many_events": (n > 80, 0.10), "entropy_extreme_events": (n > 200, 0.20), "entropy_long_duration": (F.col("duration") > 1800, 0.15), "entropy_excessive_destinations": (d > 40, 0.20), "entropy_low_novelty": (F.col("novelty") < 0.25, 0.20)}
    converged = F.col("s_first_time_source_user_to_dest") & F.col("s_compact") & (F.col("s_source_user_fanout") | F.col("s_source_fanout"))
    tags = {"compact_lateral_burst": F.col("s_compact"), "fanout_velocity": F.col("s_velocity"), "low_convergence_penalty": F.col("kinds") < 3, "propagation_convergence_bonus": converged, **{k: c for k, (c, _) in penalties.items()}}
    now = F.struct("n", "d", "duration", "novelty", "velocity", "kinds", *(F.col(f"s_{t}") for t in (*FIRST_TIME, *FANOUT, "compact", "velocity")))
    out = rows.groupBy(*EPISODE).agg(F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.max("risk").alias("max_risk"), F.max_by(now, order_key()).alias("x"), *(F.max(c).alias(f"t_{t}") for t, c in tags.items())).select("*", "x.*").drop("x")
    # The weights of an episode's tags.
    weights = (("first_time_source_user_to_dest", 0.30), ("first_time_user_to_dest", 0.18), ("first_time_source_to_dest", 0.16), ("source_user_fanout", 0.16), ("source_fanout", 0.12), ("user_fanout", 0.10), ("compact", 0.18))
    compactness = F.least(F.lit(1.0), d / long / 0.03)
    raw = sum((of(F.col(f"s_{t}"), v) for t, v in weights), F.lit(0.0)) + F.when(F.col("s_velocity"), 0.18 * F.col("velocity")).otherwise(0.0) + 0.10 * compactness
    raw = F.least(F.lit(1.0), F.when(F.col("kinds") < 3, raw * 0.5).otherwise(raw) + of(converged, 0.12))
    penalty = F.least(F.lit(0.65), sum((of(c, v) for c, v in penalties.values()), F.lit(0.0)))
    first = s(*FIRST_TIME)
    gate = F.when(F.col("s_first_time_source_user_to_dest") & F.col("s_compact") & (s(*FANOUT) > 0), "A").when((F.col("velocity") >= 0.65) & (first >= 2), "B").when((F.col("novelty") >= 0.50) & (d >= 3) & (F.col("duration") <= 600), "C").otherwise("none")
    out = out.withColumn("raw_score", raw).withColumn("entropy_penalty", penalty).withColumn("score", F.greatest(F.lit(0.0), F.col("raw_score") - F.col("entropy_penalty"))).withColumn("candidate_gate", gate)
    reason = F.when(n < 3, "too_few_events").when(first == 0, "no_first_time_edge").when(F.col("candidate_gate") == "none", "no_candidate_gate").when(F.col("score") < 0.75 - 1e-9, "below_min_score")
    names = F.array_sort(F.array_compact(F.array(*(F.when(F.col(f"s_{t}"), F.lit(t)) for t in (*FIRST_TIME, *FANOUT)), *(F.when(F.col(f"t_{t}"), F.lit(t)) for t in tags))))
    return out.withColumn("suppression_reason", reason).withColumn("signals", names).withColumnRenamed("n", "events_count").withColumnRenamed("d", "destination_count").drop(*(c for c in out.columns if c.startswith(("s_", "t_"))), "kinds")
