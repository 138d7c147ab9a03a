"""Joins of episodes, events and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .intervals import interval_join
from .tables import saved
from .windows import around, in_intervals, merge_intervals

LABEL = ("redteam_index", "time", "user", "source", "dest")


def as_label(labels: DataFrame) -> DataFrame:
    return labels.select(*(F.col(c).alias(f"label_{c}") for c in LABEL))


def matches(episodes: DataFrame, labels: DataFrame, window: int) -> DataFrame:
    """Label and episode of one source, with the label's destination among the episode's, in [start - w, end + w]. The user is
    not compared. Source, destination and a bucket of time are the join's keys."""
    t = F.col("label_time")
    eps = episodes.withColumn("label_dest", F.explode("destinations"))
    rows = interval_join(eps, as_label(labels).withColumnRenamed("label_source", "source"), ["source", "label_dest"], F.col("start_time") - window, F.col("end_time") + window, t)
    return rows.withColumn("delta_start", t - F.col("start_time")).withColumn("delta_end", t - F.col("end_time")).withColumn("exact_start", t == F.col("start_time"))


def label_hosts(labels: DataFrame) -> DataFrame:
    """Labels once for each host that they name."""
    return labels.select(*LABEL, F.explode(F.array_distinct(F.array("source", "dest"))).alias("host"))


def host_matches(hosts: DataFrame, labels: DataFrame, window: int) -> DataFrame:
    """Host episodes and labels that name the host on either side, once each, with overlapping times."""
    return interval_join(hosts, label_hosts(labels), ["host"], F.col("start_time") - window, F.col("end_time") + window, F.col("time"))


def start_matches(hosts: DataFrame, labels: DataFrame, window: int) -> DataFrame:
    """Host episodes that start within `window` of a label that names the host."""
    return interval_join(hosts, label_hosts(labels), ["host"], F.col("start_time") - window, F.col("start_time") + window, F.col("time"))


def edge_matches(episodes: DataFrame, labels: DataFrame, window: int) -> DataFrame:
    """A match within `window` of the episode's start or end."""
    near = F.least(F.abs("delta_start"), F.abs("delta_end"))
    return matches(episodes, labels, window).withColumn("time_delta", near).filter(F.col("time_delta") <= window)


def overlap_summary(matched: DataFrame, episodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Recall, overlap rate and their harmonic mean; a label is its time, source and destination."""
    m = matched.agg(F.countDistinct("label_time", "source", "label_dest").alias("matched_labels"), F.countDistinct("episode_key").alias("matched_episodes"))
    out = m.crossJoin(episodes.agg(F.count("*").alias("episodes"))).crossJoin(labels.agg(F.count("*").alias("labels")))
    rate, recall = F.try_divide("matched_episodes", "episodes"), F.try_divide("matched_labels", "labels")
    return out.withColumn("overlap_rate", rate).withColumn("recall", recall).withColumn("harmonic", F.coalesce(F.try_divide(2 * F.col("overlap_rate") * F.col("recall"), F.col("overlap_rate") + F.col("recall")), F.lit(0.0)))


def validation_summary(matched: DataFrame, episodes: DataFrame, labels: DataFrame, observed: DataFrame) -> DataFrame:
    """Recall over all labels and over those in the observed time range (row: lo, hi); a label is its time, user, source, dest."""
    ident = F.struct("label_time", "label_user", "source", "label_dest")
    m = matched.agg(F.countDistinct(ident).alias("matched_labels"), F.countDistinct("episode_key").alias("matched_episodes"), F.count_if("exact_start").alias("exact_starts"))
    l = labels.crossJoin(observed).agg(F.countDistinct("time", "user", "source", "dest").alias("labels"), F.countDistinct(F.when(F.col("time").between(F.col("lo"), F.col("hi")), F.struct("time", "user", "source", "dest"))).alias("labels_observed"))
    out = m.crossJoin(l).crossJoin(episodes.agg(F.count("*").alias("episodes")))
    return out.withColumn("recall_all", F.try_divide("matched_labels", "labels")).withColumn("recall_observed", F.try_divide("matched_labels", "labels_observed")).withColumn("overlap_rate", F.try_divide("matched_episodes", "episodes"))


def gate_counts(matched: DataFrame) -> DataFrame:
    return matched.groupBy("candidate_gate").agg(F.count("*").alias("matches"), F.count_if("exact_start").alias("exact"), F.countDistinct("episode_key").alias("episodes"))


def near_matches(suppressed: DataFrame, labels: DataFrame, window: int, limit: int = 500) -> DataFrame:
    """The first matches, in order of label, of episodes that were held back."""
    return matches(suppressed, labels, window).orderBy("label_redteam_index", "start_time", "episode_key").limit(limit)


#: What equal columns of a label and an event are worth, and distances in time up to so many seconds.
WORTH = {"source": 3, "dest": 3, "user": 2}
NEAR = {0: 3, 10: 2, 300: 1}


def alignments(labels: DataFrame, events: DataFrame, window: int = 300) -> DataFrame:
    """For each label the best event within `window`: +3 source, +3 destination, +2 user, +3/+2/+1 by distance in time. The first
    in file order wins ties.

    Labels whose own second has an event that is equal in all columns are settled by equal keys, since no score is higher. The
    others ask for each set of columns, and for each distance that is worth more, which event with these columns equal comes first;
    the best of the answers is the best event, since an event's score is its answer for just its equal columns and own distance,
    and less for others. So labels never meet events pair by pair, however many lie in one second.
    """
    l = as_label(labels).select("label_redteam_index", "label_time", *(F.lower(f"label_{c}").alias(f"_{c}") for c in WORTH))
    e = events.filter("time is not null").select("time", "seq", *(F.lower(c).alias(f"_{c}") for c in WORTH))
    keys = [f"_{c}" for c in WORTH]
    same = e.groupBy(*keys, F.col("time").alias("label_time")).agg(F.min("seq").alias("seq"))
    first = saved(l.join(same, [*keys, "label_time"], "left"), "equal-events")
    top = sum(WORTH.values()) + NEAR[0]
    equal = first.filter("seq is not null").select("label_redteam_index", F.struct(F.col("label_time").alias("time"), "seq", F.lit(top).alias("score"), F.lit(0).cast("long").alias("dt")).alias("m"))
    asked = questions(first.filter("seq is null"), window)
    of = Window.partitionBy("_set", *keys, "_bucket").orderBy(F.desc("_at"), F.col("label_time").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = answerable(asked, e, window).withColumn("m", F.last("_event", ignorenulls=True).over(of)).filter(F.col("m.time") <= F.col("_to"))
    x = found.select("label_redteam_index", F.struct("m.time", "m.seq", "score", F.abs(F.col("m.time") - F.col("label_time")).alias("dt")).alias("m"))
    best = x.groupBy("label_redteam_index").agg(F.max_by("m", F.struct("m.score", -F.col("m.time"), -F.col("m.seq"))).alias("m")).union(equal)
    return best.select(F.col("label_redteam_index").alias("redteam_index"), "m.*", F.when(F.col("m.score") >= 7, "strong").when(F.col("m.score") >= 4, "medium").otherwise("weak").alias("strength"))


def column_sets(rows: DataFrame) -> DataFrame:
    """Each row for each set of columns of WORTH that has no null in it: its number, what it is worth, and its values (others null)."""
    sets = [[c for i, c in enumerate(WORTH) if k >> i & 1] for k in range(1 << len(WORTH))]
    one = lambda k, s: F.when(
        F.lit(True) if not s else ~F.greatest(F.lit(False), *(F.col(f"_{c}").isNull() for c in s)), F.struct(F.lit(k).alias("_set"), F.lit(sum(WORTH[c] for c in s)).alias("_worth"), *((F.col(f"_{c}") if c in s else F.lit(None).cast("string")).alias(f"_{c}") for c in WORTH))
    )
    return rows.withColumn("_s", F.explode(F.array_compact(F.array(*(one(k, s) for k, s in enumerate(sets)))))).drop(*(f"_{c}" for c in WORTH)).select("*", "_s.*").drop("_s")


def questions(labels: DataFrame, window: int) -> DataFrame:
    """What labels ask: the first event of a set of equal columns from _at to _to, and the score it would have; for both buckets of
    time that this may reach into."""
    far = lambda d: next((w for limit, w in NEAR.items() if d <= limit), 0)
    tiers = {**{d: w for d, w in NEAR.items() if d < window}, window: far(window)}
    reach = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in tiers.items())))
    rows = column_sets(labels).withColumn("_t", reach).withColumn("score", F.col("_worth") + F.col("_t.w")).filter("score > 0")
    rows = rows.withColumn("_at", F.col("label_time") - F.col("_t.d")).withColumn("_to", F.col("label_time") + F.col("_t.d"))
    number = lambda c: F.floor(F.col(c) / (2 * window + 1))
    return rows.withColumn("_bucket", F.explode(F.sequence(number("_at"), number("_to")))).select("_set", *(f"_{c}" for c in WORTH), "_bucket", "_at", "_to", "score", "label_redteam_index", "label_time")


def answerable(asked: DataFrame, events: DataFrame, window: int) -> DataFrame:
    """Questions beside the first event of each second, for each set of columns and bucket that anything is asked of: rows grow
    with labels and with events, not with their pairs."""
    keys = ["_set", *(f"_{c}" for c in WORTH), "_bucket"]
    firsts = column_sets(events).withColumn("_bucket", F.floor(F.col("time") / (2 * window + 1))).groupBy(*keys, "time").agg(F.min("seq").alias("seq"))
    wanted = asked.select(*(F.col(k).alias(f"{k}_") for k in keys)).distinct()
    firsts = firsts.join(wanted, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys], "left_semi")
    return firsts.select(*keys, F.col("time").alias("_at"), F.struct("time", "seq").alias("_event")).unionByName(asked, allowMissingColumns=True)


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Label keys matched by both runs, by the first only (lost), by the second only (new)."""
    both = a.select(*keys).distinct().withColumn("_a", F.lit(1)).join(b.select(*keys).distinct().withColumn("_b", F.lit(1)), keys, "full")
    return both.select(*keys, F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "lost").otherwise("both").alias("status"))


def match_maps(matched: DataFrame) -> DataFrame:
    """Each matched episode with its labels (sorted array) and exact starts."""
    return matched.groupBy("episode_key").agg(F.array_sort(F.collect_set("label_redteam_index")).alias("label_ids"), F.count_if("exact_start").alias("exact_count"), F.first("candidate_gate").alias("candidate_gate"))


def label_groups(maps: DataFrame) -> DataFrame:
    """Adds group_id: episodes that share labels, directly or through others, are one group, and its name lists all its labels. A name
    is made once for a group, from each label once, and meets the group's episodes last, so that no other join carries it."""
    maps = saved(maps, "label-maps")
    pairs = maps.select("episode_key", F.explode("label_ids").alias("label"))
    head = pairs.groupBy("episode_key").agg(F.min("label").alias("head"))
    links = pairs.join(head, "episode_key").select(F.col("label").cast("long").alias("a"), F.col("head").cast("long").alias("b"))
    comp = components(links)
    grouped = lambda rows, label: rows.join(comp, F.col(label) == F.col("node"), "left").withColumn("component", F.coalesce("component", label)).drop("node", label)
    each = pairs.select("label", F.col("label").alias("of")).distinct()
    names = grouped(each, "of").groupBy("component").agg(F.concat(F.lit("rtgrp:"), F.array_join(F.array_sort(F.collect_list("label")), "+")).alias("group_id"))
    return maps.join(grouped(head, "head"), "episode_key").join(names, "component").drop("component")


def own_groups(maps: DataFrame) -> DataFrame:
    return maps.withColumn("group_id", F.concat(F.lit("rtgrp:"), F.array_join("label_ids", "+")))


def with_annotations(rows: DataFrame, notes: DataFrame, key: str = "episode_key", order: str = "exact_count") -> DataFrame:
    """Left join of label counts onto deployed rows; 0 where there are none, and of repeated notes the last in `order`."""
    last = notes.groupBy(key).agg(F.max_by(F.struct("label_ids", "exact_count"), F.struct(order, "label_ids")).alias("_n"))
    return rows.join(last.select(key, F.size("_n.label_ids").alias("redteam_count"), "_n.exact_count"), key, "left").fillna(0, ["redteam_count", "exact_count"])


def label_window_rows(events: DataFrame, labels: DataFrame, window: int, k: int = 20) -> DataFrame:
    """(field, value, n, place): the most frequent sources and destinations of events within `window` of a label. An event counts
    once, however many labels are near."""
    near = in_intervals(events, merge_intervals(around(labels, window)))
    n = near.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("source", "dest")))).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))).filter(F.col("place") <= k)


#: Parts of names of columns that tell a label, values that count as yes and no, and names of ids and keys.
TELLING = ("redteam", "matched_red", "represented_red", "is_positive", "positive", "label", "match_indices")
YES, NO = ("true", "yes", "y", "1", "positive", "matched", "redteam"), ("false", "no", "n", "0", "none", "nan", "null", "[]", "{}")
ID_NAMES = ("episode_id", "accepted_episode_id", "matched_episode_id", "source_episode_id", "episode_index", "idx", "id")
KEY_NAMES = ("background_episode_key", "episode_key", "accepted_episode_key", "matched_episode_key")


def says_yes(df: DataFrame, name: str) -> Column:
    """Whether a value of a column tells a label: true, above 0, not empty, or a word for yes."""
    kind = df.schema[name].dataType.typeName()
    c = F.col(f"`{name}`")
    if kind == "boolean":
        out = c
    elif kind in ("array", "map"):
        out = F.size(c) > 0
    elif kind == "struct":
        out = c.isNotNull()
    elif kind == "string":
        text = F.lower(F.trim(c))
        out = text.isin(*YES) | (~text.isin(*NO) & text.startswith("[") & text.endswith("]") & (F.length(text) > 2))
    else:
        out = ~F.isnan(c.cast("double")) & (c > 0)
    return F.coalesce(out, F.lit(False))


def label_mask(rows: DataFrame, matched: DataFrame) -> tuple[DataFrame, str]:
    """(rows with a column is_labelled, how it was found): by the rows' own columns that tell a label; else by ids, else by keys
    that the matches name too; else none is. Which way, is asked of whole tables with counts; rows are joined, never collected."""
    telling = [c for c in rows.columns if any(t in c.lower() for t in TELLING)]
    if telling:
        hits = rows.agg(*(F.count_if(says_yes(rows, c)).alias(f"c{i}") for i, c in enumerate(telling))).first()
        used = [c for i, c in enumerate(telling) if hits[i]]
        if used:
            mask = says_yes(rows, used[0])
            for c in used[1:]:
                mask = mask | says_yes(rows, c)
            return rows.withColumn("is_labelled", mask), "direct"
    for how, names in (("ids", ID_NAMES), ("keys", KEY_NAMES)):
        theirs = [c for c in names if c in matched.columns]
        if not theirs:
            continue
        values = matched.select(F.explode(F.array(*(F.col(c).cast("string") for c in theirs))).alias("_v")).filter("_v is not null").distinct().withColumn("is_labelled", F.lit(True))
        for c in names:
            if c in rows.columns:
                out = rows.join(values, F.col(c).cast("string") == F.col("_v"), "left").drop("_v").fillna(False, ["is_labelled"])
                if not out.filter("is_labelled").isEmpty():
                    return out, how
    return rows.withColumn("is_labelled", F.lit(False)), "none"


def without_near_matches(rows: DataFrame, near: DataFrame, as_observed: bool = False, key: str = "episode_key") -> DataFrame:
    """Rows that are no near match. as_observed: nothing is left out, as by loaders that look for an id where there is none."""
    return rows if as_observed else rows.join(near.select(key).distinct(), key, "left_anti")
