"""Queries around review: outputs, labels, splits, queues by window and cap, tails, policies, decisions; each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from emberlog.operators import decisions as dc
from emberlog.operators import episodes as ep
from emberlog.operators import features as ft
from emberlog.operators import geometry as gm
from emberlog.operators import matching as mt
from emberlog.operators import queues as qu
from emberlog.operators.tables import saved, shared_folder
from emberlog.sources import sinks, views

from .oracles import _ACC, _F, _G, _M, _MAPS, _T, CHAIN, ORACLES, TIES, E, LABELS
from .queries import by_score, detected, example_policy, feature_table, maps, measured, query, queue, queues_of, regime_rows, six, tail

_L = f"WITH {E}, {LABELS}"


# Outputs.


@query
def saved_outputs(spark, sf_dir):
    """Everything a run writes, read again: rows of each output, and keys in it."""
    folder = f"{shared_folder(spark)}/outputs-{uuid.uuid4().hex}"
    d, labels = detected(spark, sf_dir), views.labels(spark, sf_dir)
    near = mt.near_matches(d.filter("suppression_reason is not null"), labels, 600)
    names = sinks.save_outputs(folder, d, mt.matches(d, labels, 600), near, qu.sized(by_score(d), (100, 500)))
    out = None
    for name in names:
        one = sinks.load_output(spark, folder, name).agg(F.lit(name).alias("output"), F.count("*").alias("n"), F.countDistinct("episode_key").alias("keys"))
        out = one if out is None else out.union(one)
    return out


ORACLES["saved_outputs"] = f"""{_M}, nm AS (SELECT * FROM mm WHERE suppression_reason IS NOT NULL ORDER BY redteam_index, start_time, episode_key LIMIT 500)
SELECT 'all_episodes' AS output, count(*) AS n, count(DISTINCT episode_key) AS keys FROM f UNION ALL SELECT 'suppressed_episodes', count(*), count(DISTINCT episode_key) FROM f WHERE suppression_reason IS NOT NULL UNION ALL SELECT 'ranked_episodes', count(*), count(DISTINCT episode_key) FROM f WHERE suppression_reason IS NULL
UNION ALL SELECT 'matches', count(*), count(DISTINCT episode_key) FROM mm UNION ALL SELECT 'near_matches', count(*), count(DISTINCT episode_key) FROM nm UNION ALL SELECT 'queues', least(100, count(*)) + least(500, count(*)), least(500, count(*)) FROM f"""


# Labels.


@query
def label_window_rows(spark, sf_dir):
    return mt.label_window_rows(views.auth(spark, sf_dir), views.unnumbered_labels(spark, sf_dir), 5)


ORACLES["label_window_rows"] = f"""{_L}, nr AS (SELECT * FROM e WHERE EXISTS (SELECT 1 FROM labels_ AS l WHERE abs(l.time - e.time) <= 5)), nn AS (SELECT 'source' AS field, source AS value, count(*) AS n FROM nr GROUP BY ALL UNION ALL SELECT 'dest', dest, count(*) FROM nr GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value)::INT AS place FROM nn QUALIFY place <= 20"""


@query
def inferred_labels(spark, sf_dir):
    """The mask from the rows' own columns, and from keys where the rows have none that tell."""
    d = detected(spark, sf_dir).filter("suppression_reason is null")
    m = maps(spark, sf_dir)
    plain = d.select("episode_key")
    rows = d.select("episode_key").join(m.select("episode_key", F.size("label_ids").alias("redteam_count")), "episode_key", "left").fillna(0)
    direct, how = mt.label_mask(rows, m)
    by_key, how_2 = mt.label_mask(plain, m.select("episode_key"))
    return direct.select(F.lit(how).alias("how"), "episode_key", "is_labelled").union(by_key.select(F.lit(how_2), "episode_key", "is_labelled"))


ORACLES["inferred_labels"] = f"""{_MAPS} SELECT how, episode_key, ids IS NOT NULL AS is_labelled FROM f LEFT JOIN mp USING (episode_key), (VALUES ('direct'), ('keys')) AS h(how) WHERE suppression_reason IS NULL"""


@query
def training_without_near_matches(spark, sf_dir):
    d = detected(spark, sf_dir)
    near = mt.near_matches(d.filter("suppression_reason is not null"), views.labels(spark, sf_dir), 600)
    out = mt.without_near_matches(d, near).select(F.lit("intended").alias("rule"), "episode_key")
    return out.union(mt.without_near_matches(d, near, as_observed=True).select(F.lit("observed"), "episode_key"))


ORACLES["training_without_near_matches"] = f"""{_M}, nm AS (SELECT episode_key FROM mm WHERE suppression_reason IS NOT NULL ORDER BY redteam_index, start_time, episode_key LIMIT 500) SELECT 'intended' AS rule, episode_key FROM f WHERE episode_key NOT IN (SELECT episode_key FROM nm) UNION ALL SELECT 'observed', episode_key FROM f"""


# Samples and splits by hash; their queries are in queries.py.

_HASH = lambda key: f"(('0x' || substr(md5('7:' || {key}), 1, 8))::BIGINT / 4294967296)"
ORACLES["negative_sample_hashed"] = f"""{_F} SELECT episode_key FROM fs WHERE label = 0 ORDER BY {_HASH("episode_key")}, episode_key LIMIT 500"""
ORACLES["split_stratified"] = f"""{_F}, sp AS (SELECT label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {_HASH("episode_key")}, episode_key) <= floor(0.7 * count(*) OVER (PARTITION BY label)) THEN 'train' ELSE 'test' END AS part FROM fs) SELECT label, part, count(*) AS n FROM sp GROUP BY ALL"""
ORACLES["split_by_group"] = f"""{_F}, sp AS (SELECT array_to_string(ids, '+') AS group_id, episode_key FROM fs), sq AS (SELECT group_id, CASE WHEN {_HASH("coalesce(group_id, episode_key)")} < 0.7 THEN 'train' ELSE 'test' END AS part FROM sp) SELECT group_id, part, count(*) AS n FROM sq GROUP BY ALL"""


# Rankers.


@query
def ranker_tree_depths(spark, sf_dir):
    """Trees of several depths, each judged on the later part."""
    rows = saved(ft.time_split(feature_table(spark, sf_dir)), "split")
    out = None
    for depth in (3, 5, 10):
        model = ft.fit_ranker(rows.filter("part = 'train'"), "tree", ft.RankerConfig(depth=depth, min_leaf=10))
        one = ft.auc_ap(ft.model_score(model, rows.filter("part = 'test'")), "model_score").select(F.lit(depth).alias("depth"), "auc", "ap")
        out = one if out is None else out.union(one)
    return out


@query
def ranker_importances(spark, sf_dir):
    rows = feature_table(spark, sf_dir)
    found = ft.importances(ft.fit_ranker(rows, "tree"), ft.feature_names(rows.columns))
    return spark.createDataFrame(found, "feature string, importance double")


@query
def cross_branch_metrics(spark, sf_dir):
    """Models fitted on the recall branch, saved, loaded with a check of their features, and used on the pruned branch: hits among
    the first k, for each model and k."""
    labels = views.labels(spark, sf_dir)

    def branch(preset):
        d = detected(spark, sf_dir, preset)
        return saved(ft.feature_rows(d, mt.match_maps(mt.matches(d, labels, 600))), "branch")

    train, rows, out = branch(ep.RECALL), branch(ep.PRUNED), None
    for kind in ("logistic", "tree"):
        folder = f"{shared_folder(spark)}/ranker-{uuid.uuid4().hex}"
        ft.save_ranker(ft.fit_ranker(train, kind), folder, ft.feature_names(train.columns), spark, branch="recall", kind=kind)
        model, about = ft.load_ranker(folder, rows)
        ranked = qu.global_rank(ft.model_score(model, rows), F.desc(F.round("model_score", 9)), F.col("episode_key"))
        one = ft.top_k(ranked, [20, 100, 500, 1000]).select(F.lit(about["kind"]).alias("model"), "k", "hits", six("precision"), "labels", six("label_recall"))
        out = one if out is None else out.union(one)
    return out


# Queues.


@query
def multi_key_ranks(spark, sf_dir):
    """Score, novelty, hits, destinations and velocity from the largest down, duration from the shortest up, then the key."""
    r = lambda c: F.desc(F.round(c, 9))
    return qu.global_rank(detected(spark, sf_dir), r("score"), r("novelty_ratio"), F.desc("first_time_signal_hits"), F.desc("destination_count"), r("fanout_velocity_score"), F.asc("duration"), F.asc("episode_key")).select("episode_key", "rank")


ORACLES["multi_key_ranks"] = f"""{CHAIN} SELECT episode_key, row_number() OVER (ORDER BY round(score, 9) DESC, round(nov, 9) DESC, first_time_signal_hits DESC, destination_count DESC, round(vs, 9) DESC, dur, episode_key) AS rank FROM f"""


@query
def tie_effect(spark, sf_dir):
    q = queue(spark, sf_dir).join(maps(spark, sf_dir).select("episode_key", "label_ids"), "episode_key", "left")
    return qu.tie_effect(qu.tie_audit(q), [20, 100, 500, 1000])


ORACLES["tie_effect"] = f"""{TIES}, kk AS (SELECT k, rank, new_rank, coalesce(len(ids), 0) AS n FROM ta, (VALUES (20), (100), (500), (1000)) AS q(k)),
ks AS (SELECT k, count(*) FILTER (rank <= k AND n > 0) AS original_episodes, coalesce(sum(n) FILTER (rank <= k), 0)::BIGINT AS original_labels, count(*) FILTER (new_rank <= k AND n > 0) AS tie_episodes, coalesce(sum(n) FILTER (new_rank <= k), 0)::BIGINT AS tie_labels FROM kk GROUP BY k) SELECT *, tie_episodes - original_episodes AS delta_episodes, tie_labels - original_labels AS delta_labels FROM ks"""


@query
def repaired_ranks(spark, sf_dir):
    """A queue whose ranks are lost, and one whose ranks are text."""
    q = queue(spark, sf_dir).withColumn("score", F.round("score", 9))
    lost = qu.repaired_ranks(q.withColumn("rank", F.lit("0")))
    text = qu.repaired_ranks(q.withColumn("rank", F.when(F.col("rank") % 7 != 0, F.concat("rank", F.lit(".0"))).otherwise("n/a")))
    return lost.select(F.lit("lost").alias("case"), "episode_key", "rank").union(text.select(F.lit("text"), "episode_key", "rank"))


ORACLES["repaired_ranks"] = f"""{_F} SELECT 'lost' AS "case", episode_key, rank FROM fs UNION ALL SELECT 'text', episode_key, CASE WHEN rank % 7 <> 0 THEN rank ELSE 0 END FROM fs"""


def ranked_windows(spark, sf_dir):
    d = detected(spark, sf_dir).withColumn("window_id", F.floor(F.col("start_time") / 20_000))
    return qu.window_ranks(d, "window_id", F.desc(F.round("score", 9)), F.col("episode_key"))


@query
def window_ranks(spark, sf_dir):
    return ranked_windows(spark, sf_dir).select("window_id", "episode_key", "rank", "rank_in_window")


@query
def window_queues(spark, sf_dir):
    return qu.sized_in_windows(ranked_windows(spark, sf_dir), "window_id").select("window_id", "queue_size", "rank_in_window", "rank", "episode_key")


_W = f"""{_F}, wr AS (SELECT start_time // 20000 AS window_id, episode_key, rank, row_number() OVER (PARTITION BY start_time // 20000 ORDER BY rank) AS rank_in_window FROM fs)"""
ORACLES["window_ranks"] = f"""{_W} SELECT * FROM wr"""
ORACLES["window_queues"] = f"""{_W} SELECT window_id, k AS queue_size, rank_in_window, rank, episode_key FROM wr, (VALUES (100), (500), (1000), (5000)) AS q(k) WHERE rank_in_window <= k"""

CAPS, CAP_SIZES = (3, 5, 10, 20), (30, 60, 100)


def sweep(spark, sf_dir):
    q = queue(spark, sf_dir).join(maps(spark, sf_dir).select("episode_key", "label_ids"), "episode_key", "left")
    return qu.capped_sweep(q, CAPS, CAP_SIZES)


@query
def source_cap_sweep(spark, sf_dir):
    s = qu.capped_summary(sweep(spark, sf_dir))
    return s.select("source_cap", "queue_size", "n", "filled", "sources", "top_source", six("top_share"), "positive_episodes", "labels", six("median_score"))


@query
def capped_source_distribution(spark, sf_dir):
    c = qu.concentration(sweep(spark, sf_dir), F.col("source"), ["source_cap", "queue_size"], 1000)
    return c.select("source_cap", "queue_size", F.col("place").alias("source_rank"), F.col("value").alias("source"), "n", six("share"))


_CAPPED = f"""{_F}, co AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank) AS own FROM fs), cc AS (SELECT co.*, cap AS source_cap, row_number() OVER (PARTITION BY cap ORDER BY rank) AS new_rank FROM co, (VALUES {", ".join(f"({c})" for c in CAPS)}) AS x(cap) WHERE own <= cap),
cs AS (SELECT cc.*, k AS queue_size FROM cc, (VALUES {", ".join(f"({k})" for k in CAP_SIZES)}) AS y(k) WHERE new_rank <= k),
cn AS (SELECT source_cap, queue_size, source, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY source_cap, queue_size) AS share, row_number() OVER (PARTITION BY source_cap, queue_size ORDER BY count(*) DESC, source)::INT AS source_rank FROM cs GROUP BY source_cap, queue_size, source)"""
ORACLES["capped_source_distribution"] = f"""{_CAPPED} SELECT source_cap, queue_size, source_rank, source, n, round(share, 6) AS share FROM cn"""
ORACLES["source_cap_sweep"] = f"""{_CAPPED}, cl AS (SELECT source_cap, queue_size, count(DISTINCT l) AS labels FROM (SELECT source_cap, queue_size, unnest(ids) AS l FROM cs) GROUP BY ALL), ca AS (SELECT source_cap, queue_size, count(*) AS n, count(*) >= queue_size AS filled, count(DISTINCT source) AS sources, count(*) FILTER (ids IS NOT NULL) AS positive_episodes, round(median(score), 6) AS median_score FROM cs GROUP BY source_cap, queue_size)
SELECT source_cap, queue_size, ca.n, filled, sources, source AS top_source, round(share, 6) AS top_share, positive_episodes, coalesce(labels, 0) AS labels, median_score FROM ca JOIN cn USING (source_cap, queue_size) LEFT JOIN cl USING (source_cap, queue_size) WHERE source_rank = 1"""


@query
def analyst_packet(spark, sf_dir):
    return qu.analyst_packet(queues_of(spark, sf_dir), 3, 2).select("queue_size", "section", "place", "source", "episode_key", "n", six("share"), "best_rank", six("score"))


ORACLES["analyst_packet"] = f"""{_F}, qs AS (SELECT fs.*, q.k AS queue_size FROM fs JOIN (VALUES (100), (500), (1000), (5000)) AS q(k) ON rank <= q.k),
ac AS (SELECT queue_size, source, count(*) AS n, min(rank) AS best_rank, max(score) AS score FROM qs GROUP BY ALL), ad AS (SELECT *, row_number() OVER (PARTITION BY queue_size ORDER BY n DESC, best_rank) AS place, n / sum(n) OVER (PARTITION BY queue_size) AS share FROM ac)
SELECT queue_size, 'brief' AS section, 1 AS place, arg_min(source, place) AS source, NULL AS episode_key, sum(n)::BIGINT AS n, round(max(share), 6) AS share, min(best_rank) AS best_rank, round(max(score), 6) AS score FROM ad GROUP BY queue_size
UNION ALL SELECT queue_size, 'cluster', place, source, NULL, n, round(share, 6), best_rank, round(score, 6) FROM ad WHERE place <= 3
UNION ALL SELECT queue_size, 'representative', place, source, episode_key, NULL, NULL, rank, round(score, 6) FROM (SELECT qs.*, row_number() OVER (PARTITION BY queue_size, source ORDER BY rank) AS place FROM qs SEMI JOIN (SELECT * FROM ad WHERE place <= 3) AS t USING (queue_size, source)) WHERE place <= 2"""


@query
def host_triage(spark, sf_dir):
    q = queue(spark, sf_dir).withColumn("window_id", F.floor(F.col("start_time") / 5_000))
    return qu.host_triage(q, "source", "window_id", 0.9).select("episode_key", "rank", "windows", "presentation_class", "triage_tier", "cluster_order")


ORACLES["host_triage"] = f"""{_F}, ht AS (SELECT * FROM fs), hw AS (SELECT source, count(DISTINCT start_time // 5000) AS windows, min(rank) AS best FROM ht GROUP BY source),
hc AS (SELECT episode_key, rank, windows, CASE WHEN windows >= 20 THEN 'persistent_cross_signal_infrastructure_like_cluster' WHEN windows >= 10 THEN 'recurrent_cross_signal_cluster' WHEN windows >= 3 THEN 'recurring_candidate_cluster' ELSE 'distinct_host_window_spike' END AS presentation_class,
  CASE WHEN windows >= 20 AND rank = best THEN 'C_persistent_cluster_representative' WHEN windows >= 20 THEN 'D_persistent_cluster_member' WHEN score > 0.9 AND windows >= 3 THEN 'B_recurrent_high_signal_candidate' WHEN score > 0.9 THEN 'A_distinct_high_signal_candidate' ELSE 'E_context_queue' END AS triage_tier FROM ht JOIN hw USING (source))
SELECT *, row_number() OVER (ORDER BY triage_tier = 'D_persistent_cluster_member', rank) AS cluster_order FROM hc"""


# Tails and policies.


def grouped_tail(spark, sf_dir):
    return gm.tail_groups(tail(spark, sf_dir))


@query
def tail_group_subtypes(spark, sf_dir):
    g = gm.group_subtypes(grouped_tail(spark, sf_dir), ["novelty_ratio", "duration"])
    return g.select("tail_group", "subtype", "n", *(six(c) for c in ("share", "score_mean", "rescue_index_mean", "compact_index_mean", "novelty_ratio_mean", "duration_mean")))


@query
def tail_gates(spark, sf_dir):
    return qu.distribution(grouped_tail(spark, sf_dir), F.col("candidate_gate"), ["tail_group", "subtype"]).withColumn("share", F.round("share", 6))


@query
def tail_contrast(spark, sf_dir):
    c = gm.subtype_contrast(grouped_tail(spark, sf_dir))
    return c.select("subtype", *(f"{n}_count" for n in gm.TAIL_GROUPS), *(six(f"{n}_share") for n in gm.TAIL_GROUPS), six("minus_r2_share"), six("minus_r1_share"))


_TG = f"""{_T}, tg AS (SELECT *, CASE WHEN label = 1 THEN 'redteam_associated' WHEN regime = 'R2' THEN 'background_R2' ELSE 'background_R1_tail' END AS tail_group FROM tt)"""
ORACLES["tail_group_subtypes"] = f"""{_TG} SELECT tail_group, subtype, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY tail_group), 6) AS share, round(avg(score), 6) AS score_mean, round(avg(ri), 6) AS rescue_index_mean, round(avg(ci), 6) AS compact_index_mean, round(avg(novelty_ratio), 6) AS novelty_ratio_mean, round(avg(duration), 6) AS duration_mean FROM tg GROUP BY tail_group, subtype"""
ORACLES["tail_gates"] = f"""{_TG} SELECT tail_group, subtype, candidate_gate AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY tail_group, subtype), 6) AS share FROM tg GROUP BY tail_group, subtype, candidate_gate"""
_ONE = lambda g: f"count(*) FILTER (tail_group = '{g}')"
ORACLES["tail_contrast"] = f"""{_TG}, ta AS (SELECT {", ".join(f"{_ONE(g)} AS a_{n}" for n, g in gm.TAIL_GROUPS.items())} FROM tg), tc AS (SELECT subtype, {", ".join(f"{_ONE(g)} AS {n}_count" for n, g in gm.TAIL_GROUPS.items())} FROM tg GROUP BY subtype),
td AS (SELECT *, {", ".join(f"coalesce({n}_count / nullif(a_{n}, 0), 0) AS {n}_s" for n in gm.TAIL_GROUPS)} FROM tc, ta)
SELECT subtype, {", ".join(f"{n}_count" for n in gm.TAIL_GROUPS)}, {", ".join(f"round({n}_s, 6) AS {n}_share" for n in gm.TAIL_GROUPS)}, round(redteam_s - r2_s, 6) AS minus_r2_share, round(redteam_s - r1_s, 6) AS minus_r1_share FROM td"""


@query
def standardised_distance(spark, sf_dir):
    return gm.standardised_distance(regime_rows(spark, sf_dir), list(ft.NUMERIC), "regime", "R2", "R0").select(six("distance"), "features")


_LONG = f"sl AS (UNPIVOT (SELECT regime, {', '.join(ft.NUMERIC)} FROM rg WHERE regime <> 'R1') ON {', '.join(ft.NUMERIC)} INTO NAME feature VALUE v)"
ORACLES["standardised_distance"] = f"""{_G}, {_LONG}, sm AS (SELECT feature, coalesce((avg(v) FILTER (regime = 'R2') - avg(v) FILTER (regime = 'R0')) / nullif(stddev_samp(v), 0), 0) AS z FROM sl GROUP BY feature) SELECT round(sqrt(sum(z * z)), 6) AS distance, count(*) AS features FROM sm"""


def policy_queues(spark, sf_dir):
    return gm.policies(saved(tail(spark, sf_dir).withColumn("score", F.round("score", 9)), "tail"))


@query
def policy_rank_stats(spark, sf_dir):
    r = gm.rank_stats(policy_queues(spark, sf_dir))
    return r.select("policy", "labelled", "first_place", *(six(c) for c in ("median_place", "p75_place", "p90_place")), "last_place", six("mean_place"))


@query
def policy_prefixes(spark, sf_dir):
    t = gm.prefix_table(policy_queues(spark, sf_dir), [25, 100, 500])
    return t.select("policy", "depth", "n", "labelled", *(six(c) for c in ("recall", "background_share", "mean_score", "min_score", "max_score")), "sources", "users", "compact_count", "mixed_count", "rescue_count")


_PLACES = """pl AS (SELECT *, row_number() OVER (PARTITION BY policy ORDER BY o1, o2, sc DESC, episode_key) AS place FROM (
SELECT r0.*, 'A' AS policy, 0 AS o1, 0 AS o2 FROM r0
UNION ALL SELECT r0.*, 'B', CASE subtype WHEN 'compact' THEN 0 WHEN 'mixed' THEN 1 ELSE 2 END, 0 FROM r0
UNION ALL SELECT r0.*, 'C', i // CASE subtype WHEN 'compact' THEN 7 WHEN 'mixed' THEN 2 ELSE 1 END, CASE subtype WHEN 'compact' THEN i % 7 WHEN 'mixed' THEN 7 + i % 2 ELSE 9 END FROM r0
UNION ALL SELECT r0.*, 'D', CASE WHEN subtype = 'compact' THEN 0 WHEN subtype = 'mixed' THEN 1 WHEN ri >= 0.5 THEN 2 ELSE 3 END, 0 FROM r0
UNION ALL SELECT r0.*, 'E', CASE WHEN subtype = 'rescue' THEN j ELSE j // 2 END, CASE WHEN subtype = 'rescue' THEN 2 ELSE j % 2 END FROM r0))"""
_POLICIES = f"""{_T}, r0 AS (SELECT *, row_number() OVER (PARTITION BY subtype ORDER BY sc DESC, episode_key) - 1 AS i, row_number() OVER (PARTITION BY subtype = 'rescue' ORDER BY sc DESC, episode_key) - 1 AS j FROM tt), {_PLACES}"""
ORACLES["policy_rank_stats"] = f"""{_POLICIES} SELECT policy, count(*) AS labelled, min(place) AS first_place, round(quantile_cont(place, 0.5), 6) AS median_place, round(quantile_cont(place, 0.75), 6) AS p75_place, round(quantile_cont(place, 0.9), 6) AS p90_place, max(place) AS last_place, round(avg(place), 6) AS mean_place FROM pl WHERE label = 1 GROUP BY policy"""
ORACLES["policy_prefixes"] = f"""{_POLICIES}, pt AS (SELECT policy, sum(label) AS t FROM pl GROUP BY policy)
SELECT policy, depth, count(*) AS n, sum(label)::BIGINT AS labelled, round(sum(label) / any_value(t), 6) AS recall, round(1 - avg(label), 6) AS background_share, round(avg(sc), 6) AS mean_score, round(min(sc), 6) AS min_score, round(max(sc), 6) AS max_score, count(DISTINCT source) AS sources, count(DISTINCT "user") AS users, {", ".join(f"count(*) FILTER (subtype = '{s}') AS {s}_count" for s in ("compact", "mixed", "rescue"))}
FROM pl JOIN pt USING (policy), (VALUES (25), (100), (500)) AS d(depth) WHERE place <= depth GROUP BY policy, depth"""
_DRAW = "('0x' || substr(md5('7:' || subtype || ':' || round || ':' || draw), 1, 8))::BIGINT"
ORACLES["policy_bootstrap"] = f"""{_POLICIES}, bo AS (SELECT episode_key, subtype, max(place) FILTER (policy = 'A') AS a, max(place) FILTER (policy = 'C') AS b, row_number() OVER (PARTITION BY subtype ORDER BY episode_key) - 1 AS k FROM pl WHERE label = 1 GROUP BY episode_key, subtype),
bs AS (SELECT subtype, count(*) AS n FROM bo GROUP BY subtype), bd AS (SELECT subtype, n, round, unnest(range(1, n + 1)) AS draw FROM bs, range(1, 5001) AS r(round)), bh AS (SELECT subtype, round, {_DRAW} % n AS k FROM bd),
br AS (SELECT depth, round, avg((b <= depth)::INT - (a <= depth)::INT) AS d FROM bh JOIN bo USING (subtype, k), (VALUES (25), (100), (500)) AS x(depth) GROUP BY depth, round)
SELECT depth, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi, round(avg((d > 0)::INT), 6) AS p_better, round(avg((d >= 0)::INT), 6) AS p_not_worse FROM br GROUP BY depth"""

SLOTS, MARGINS = [(7, 2, 1), (6, 3, 1), (8, 1, 1)], [0.25, 0.35, 0.5]


@query
def policy_slot_sweep(spark, sf_dir):
    rows = saved(tail(spark, sf_dir).withColumn("score", F.round("score", 9)), "tail")
    return gm.slot_sweep(rows, SLOTS, MARGINS, 100).withColumn("recall", F.round("recall", 6))


_SWEPT = " UNION ALL ".join(f"SELECT '{a}:{b}:{c}' AS slots, {m}::DOUBLE AS margin, {a} AS wa, {b} AS wb, {c} AS wc" for m in MARGINS for a, b, c in SLOTS)
ORACLES["policy_slot_sweep"] = f"""{_T}, sw AS ({_SWEPT}), s0 AS (SELECT slots, margin, wa, wb, wc, label, sc, episode_key, CASE WHEN ci - ri > margin THEN 'compact' WHEN ci - ri < -margin THEN 'rescue' ELSE 'mixed' END AS st FROM tt, sw),
s1 AS (SELECT *, row_number() OVER (PARTITION BY slots, margin, st ORDER BY sc DESC, episode_key) - 1 AS i FROM s0), s2 AS (SELECT *, CASE st WHEN 'compact' THEN i // wa WHEN 'mixed' THEN i // wb ELSE i // wc END AS cycle, CASE st WHEN 'compact' THEN i % wa WHEN 'mixed' THEN wa + i % wb ELSE wa + wb + i % wc END AS slot FROM s1),
s3 AS (SELECT *, row_number() OVER (PARTITION BY slots, margin ORDER BY cycle, slot, sc DESC, episode_key) AS place FROM s2) SELECT slots, margin, coalesce(sum(label) FILTER (place <= 100), 0)::BIGINT AS hits, round(coalesce(sum(label) FILTER (place <= 100), 0) / sum(label), 6) AS recall FROM s3 GROUP BY slots, margin"""

# A window is picked greedily, one a round: the best one left whose centre is far enough from those picked.
_PICKED = f"""cn AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY abs(density_percentile - 0.5), line_count DESC, start) AS o, (start + "end") / 2 AS centre FROM de),
pk AS (SELECT band, 0 AS round, 0::BIGINT AS o, []::DOUBLE[] AS centres FROM cn GROUP BY band UNION ALL SELECT cn.band, any_value(pk.round) + 1, min(cn.o), list_append(any_value(pk.centres), arg_min(cn.centre, cn.o)) FROM pk JOIN cn ON cn.band = pk.band AND list_min(list_transform(list_append(pk.centres, cn.centre + 1e12), lambda c: abs(c - cn.centre))) >= 3600 WHERE pk.round < 3 GROUP BY cn.band),
ch AS (SELECT band, o FROM pk WHERE round > 0), fl AS (SELECT band, o, row_number() OVER (PARTITION BY band ORDER BY o) AS r FROM cn ANTI JOIN ch USING (band, o)),
al AS (SELECT band, o FROM ch UNION ALL SELECT fl.band, fl.o FROM fl LEFT JOIN (SELECT band, count(*) AS n FROM ch GROUP BY band) AS x ON x.band = fl.band WHERE r <= 3 - coalesce(n, 0))"""


def _stratified() -> str:
    from .oracles import _CAND, _CLEAN, _DENSE

    return f"""WITH RECURSIVE {E}, {LABELS}, {_CAND}, {_CLEAN}, {_DENSE}, {_PICKED} SELECT start, "end", band, line_count, density_rank::INT AS density_rank, density_percentile FROM cn SEMI JOIN al USING (band, o)"""


ORACLES["stratified_window_select"] = _stratified()


# Decisions.


def decided(spark, sf_dir):
    return saved(dc.decide(views.access(spark, sf_dir), example_policy(spark, sf_dir)), "decisions")


@query
def risk_metrics(spark, sf_dir):
    m = dc.risk_metrics(decided(spark, sf_dir))
    return m.select("events", *(six(c) for c in m.columns[1:]))


@query
def audit_log(spark, sf_dir):
    return dc.audit(decided(spark, sf_dir), 200).select("seq", "actor", "action_taken", six("fusion_risk"))


@query
def governance_rates(spark, sf_dir):
    g = dc.governance(decided(spark, sf_dir), F.col("action") == "purchase")
    return g.select(*(six(c) for c in g.columns))


@query
def risk_aucs(spark, sf_dir):
    return dc.risk_aucs(decided(spark, sf_dir), F.col("action") == "purchase").select("risk", measured("auc"), measured("ap"))


@query
def frozen_decisions(spark, sf_dir):
    """The later half of the events, judged one by one against the state after the first half, which was saved and loaded."""
    e, policy = views.access(spark, sf_dir), example_policy(spark, sf_dir)
    half = 80_000
    folder = f"{shared_folder(spark)}/decision-state-{uuid.uuid4().hex}"
    dc.learnt(e.filter(F.col("time") < half), policy).save(folder)
    d = dc.frozen_decisions(e.filter(F.col("time") >= half), policy, dc.DecisionState.load(spark, folder))
    return d.select("seq", "actor", "action_taken", *(six(c) for c in ("semantic_risk", "behavioral_risk", "graph_risk", "fusion_risk", "confidence")), F.array_join("reasons", ";").alias("reasons"))


# Entropies and novelty come from windows over an actor's earlier events, baselines from a sum of decaying terms; only the two
# remembered risks need one step after another.
_ENTROPY = lambda xs: f"CASE WHEN len(list_distinct({xs})) < 2 THEN 0 ELSE least(1.0, greatest(0.0, list_entropy({xs}) / log2(len(list_distinct({xs}))))) END"
_LAST = "ROWS BETWEEN 19 PRECEDING AND CURRENT ROW"


def _baseline(ent: str, i: str, by: str) -> str:
    """What is remembered of `ent` after each event of a key: itself for the first five, then 0.97 of before and 0.03 of it."""
    term = f"CASE WHEN {i} = 5 THEN {ent} * pow(0.97, -5) WHEN {i} > 5 THEN 0.03 * {ent} * pow(0.97, -{i}) ELSE 0 END"
    return f"CASE WHEN {i} <= 5 THEN {ent} ELSE pow(0.97, {i}) * sum({term}) OVER (PARTITION BY {by} ORDER BY {i} ROWS UNBOUNDED PRECEDING) END"


def _facts(where: str = "true") -> str:
    return f"""d1 AS (SELECT pr.*, least(1.0, r1::INT * 0.25 + r2::INT * 0.35 + r3::INT * 0.30 + r4::INT * 0.55 + r5::INT * 0.30)::DOUBLE AS s, row_number() OVER (PARTITION BY actor ORDER BY time, seq) AS i, row_number() OVER (PARTITION BY actor, role, resource ORDER BY time, seq) AS j, row_number() OVER (PARTITION BY actor, role ORDER BY time, seq) = 1 AS nr,
  row_number() OVER (PARTITION BY actor, action ORDER BY time, seq) = 1 AS na, row_number() OVER (PARTITION BY actor, resource ORDER BY time, seq) = 1 AS nx, row_number() OVER (PARTITION BY role, action ORDER BY time, seq) = 1 AS nra,
  list(action) OVER (PARTITION BY actor ORDER BY time, seq {_LAST}) AS la, list(resource) OVER (PARTITION BY actor ORDER BY time, seq {_LAST}) AS lr, list(action) OVER (PARTITION BY actor, role, resource ORDER BY time, seq {_LAST}) AS lc FROM pr WHERE {where}),
d2 AS (SELECT *, ({_ENTROPY("la")} + {_ENTROPY("lr")}) / 2 AS ent, {_ENTROPY("lc")} / 2 AS cent FROM d1),
d3 AS (SELECT *, {_baseline("ent", "i", "actor")} AS base, {_baseline("cent", "j", "actor, role, resource")} AS cbase FROM d2),
d4 AS (SELECT *, CASE WHEN i > 5 THEN greatest(0, ent - lag(base) OVER (PARTITION BY actor ORDER BY i)) ELSE 0 END AS shift, CASE WHEN j > 5 THEN greatest(0, cent - lag(cbase) OVER (PARTITION BY actor, role, resource ORDER BY j)) ELSE 0 END AS cshift FROM d3)"""


_PARTS = "nr::INT * 0.20 + na::INT * 0.20 + nx::INT * 0.20 * (0.5 + least(1.0, greatest(0.0, criticality))) + (shift > 0.35)::INT * least(0.15, 0.30 * shift) + (cshift > 0.30)::INT * least(0.12, 0.25 * cshift)"
_GRAPH = "nx::INT * 0.35 + na::INT * 0.25 + nra::INT * 0.20"


_CONF = "least(1.0, greatest(0.0, 0.45 * (1 - (greatest(s, b, g) - least(s, b, g))) + 0.40 * (1 - greatest(s, b, g)) + 0.15 * (1 - abs(s - b))))"
_FUSED = "least(1.0, greatest(0.0, 0.45 * s + 0.30 * b + 0.10 * least(s, b) * cf + 0.15 * g * cf))"
_REASONS = """list_filter([CASE WHEN r1 THEN 'role_unknown' END, CASE WHEN r2 THEN 'role_action_mismatch' END, CASE WHEN r3 THEN 'resource_scope_mismatch' END, CASE WHEN r4 THEN 'resource_frozen' END, CASE WHEN r5 THEN 'missing_or_invalid_approval' END, CASE WHEN i = 1 THEN 'low_history_actor' END, CASE WHEN i > 1 AND nr THEN 'actor_role_novelty' END, CASE WHEN i > 1 AND na THEN 'actor_action_novelty' END, CASE WHEN i > 1 AND nx THEN 'actor_resource_novelty' END,
  CASE WHEN shift > 0.35 THEN 'behavioral_entropy_shift' END, CASE WHEN cshift > 0.30 THEN 'context_entropy_shift' END, CASE WHEN gnew > 0 THEN 'graph_novelty' END, CASE WHEN 0.25 * susp_ > 0.10 THEN 'graph_suspicion_memory' END], lambda x: x IS NOT NULL)"""
_HAS = lambda *n: "list_has_any(why, [" + ", ".join(f"'{x}'" for x in n) + "])"
_ACTION = f"""CASE WHEN {_HAS("resource_frozen", "mission_state_contradiction")} THEN CASE WHEN s >= 0.85 OR criticality >= 0.8 THEN 'block' ELSE 'human_review' END WHEN {_HAS("role_action_mismatch")} AND s >= 0.65 THEN 'human_review' WHEN {_HAS("resource_scope_mismatch")} AND criticality >= 0.8 THEN CASE WHEN s >= 0.45 THEN 'human_review' ELSE 'queue_review' END
  WHEN {_HAS("missing_or_invalid_approval")} THEN CASE WHEN s >= 0.60 AND criticality >= 0.7 THEN 'human_review' ELSE 'queue_review' END WHEN {_HAS("actor_role_novelty", "actor_action_novelty")} THEN CASE WHEN fu >= 0.30 THEN 'step_up_auth' ELSE 'watch' END WHEN g >= 0.45 OR fu >= 0.25 AND fu < 0.45 THEN 'shadow_observe'
  WHEN b >= 0.45 AND s < 0.30 THEN 'collect_evidence' WHEN fu >= 0.70 AND cf <= 0.60 THEN 'human_review' WHEN fu >= 0.50 THEN 'queue_review' WHEN fu >= 0.25 THEN 'watch' ELSE 'allow' END"""


def _decisions(where: str = "true") -> str:
    """All events decided one after another, dd."""
    return f"""{_facts(where)}, d5 AS (SELECT *, {_PARTS} AS parts, {_GRAPH} AS gnew FROM d4),
rc AS (SELECT actor, i, s, b, g, cf, {_FUSED}::DOUBLE AS fu, 0.0::DOUBLE AS risk_, 0.0::DOUBLE AS susp_ FROM (SELECT *, {_CONF}::DOUBLE AS cf FROM (SELECT actor, i, s, 0.15::DOUBLE AS b, least(1.0, gnew)::DOUBLE AS g FROM d5 WHERE i = 1))
UNION ALL SELECT actor, i, s, b, g, cf, {_FUSED}::DOUBLE, risk_, susp_ FROM (SELECT *, {_CONF}::DOUBLE AS cf FROM (SELECT d5.actor, d5.i, d5.s, least(1.0, parts + 0.25 * least(1.0, 0.90 * rc.risk_ + 0.10 * rc.fu))::DOUBLE AS b, least(1.0, gnew + 0.25 * least(1.0, 0.85 * rc.susp_ + 0.15 * rc.fu))::DOUBLE AS g, least(1.0, 0.90 * rc.risk_ + 0.10 * rc.fu)::DOUBLE AS risk_, least(1.0, 0.85 * rc.susp_ + 0.15 * rc.fu)::DOUBLE AS susp_ FROM rc JOIN d5 ON d5.actor = rc.actor AND d5.i = rc.i + 1))),
dw AS (SELECT d5.*, rc.b, rc.g, rc.cf, rc.fu, rc.risk_, rc.susp_ FROM d5 JOIN rc USING (actor, i)), dx AS (SELECT *, {_REASONS} AS why FROM dw), dd AS (SELECT *, {_ACTION} AS act FROM dx)"""


_DD = f"WITH RECURSIVE {E}, {_ACC}, {_decisions()}"
_OUT = "round(s, 6) AS semantic_risk, round(b, 6) AS behavioral_risk, round(g, 6) AS graph_risk, round(fu, 6) AS fusion_risk, round(cf, 6) AS confidence, array_to_string(why, ';') AS reasons"
ORACLES["access_decisions"] = f"""{_DD} SELECT seq, actor, act AS action_taken, {_OUT} FROM dd"""
ORACLES["decision_metrics"] = f"""{_DD} SELECT 'action' AS kind, act AS name, count(*) AS n FROM dd GROUP BY ALL UNION ALL SELECT 'reason', r, count(*) FROM (SELECT unnest(why) AS r FROM dd) GROUP BY ALL"""
ORACLES["risk_metrics"] = f"""{_DD} SELECT count(*) AS events, round(avg(fu), 6) AS mean_risk, round(max(fu), 6) AS max_risk, round(avg(cf), 6) AS mean_confidence, round(avg(s), 6) AS mean_semantic, round(avg(b), 6) AS mean_behavioral, round(avg(g), 6) AS mean_graph FROM dd"""
ORACLES["audit_log"] = f"""{_DD} SELECT seq, actor, act AS action_taken, round(fu, 6) AS fusion_risk FROM dd ORDER BY time DESC, seq DESC LIMIT 200"""
_RATE = lambda acts, of: f"round(avg((act IN ({', '.join(repr(a) for a in acts)}))::INT) FILTER ({of}), 6)"
ORACLES["governance_rates"] = f"""{_DD} SELECT {", ".join(f"{_RATE(v, w)} AS {k}_{n}" for k, v in (("hard", dc.HARD), ("friction", dc.FRICTION), ("evidence", dc.EVIDENCE)) for n, w in (("tpr", "action = 'purchase'"), ("fpr", "action <> 'purchase'")))} FROM dd"""
ORACLES["risk_aucs"] = f"""{_DD}, lr AS (UNPIVOT (SELECT (action = 'purchase')::INT AS bad, round(s, 9) AS semantic_risk, round(b, 9) AS behavioral_risk, round(g, 9) AS graph_risk, round(fu, 9) AS fusion_risk FROM dd) ON semantic_risk, behavioral_risk, graph_risk, fusion_risk INTO NAME risk VALUE v), ag AS (SELECT risk, v, sum(bad) AS p, sum(1 - bad) AS n FROM lr GROUP BY ALL), ac2 AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM ag WINDOW w AS (PARTITION BY risk ORDER BY v DESC ROWS UNBOUNDED PRECEDING))
SELECT risk, round(sum(n * (cp - p / 2)) / (sum(p) * sum(n)), 6) AS auc, round(sum(p * cp / (cp + cn)) / sum(p), 6) AS ap FROM ac2 GROUP BY risk"""

# What a state knows: the first half's facts, decided one after another; later events are held against it one by one.
_STATE = f"""fz AS (SELECT ac3.*, least(1.0, r1::INT * 0.25 + r2::INT * 0.35 + r3::INT * 0.30 + r4::INT * 0.55 + r5::INT * 0.30)::DOUBLE AS s FROM pr AS ac3 WHERE time >= 80000),
kn AS (SELECT actor, max(i) AS n, arg_max(la, i) AS la, arg_max(lr, i) AS lr, arg_max(base, i) AS base, least(1.0, 0.90 * arg_max(risk_, i) + 0.10 * arg_max(fu, i)) AS risk_, least(1.0, 0.85 * arg_max(susp_, i) + 0.15 * arg_max(fu, i)) AS susp_, list(DISTINCT role) AS roles, list(DISTINCT action) AS acts, list(DISTINCT resource) AS uses FROM dd GROUP BY actor),
kc AS (SELECT actor, role, resource, max(j) AS cn, arg_max(lc, j) AS lc, arg_max(cbase, j) AS cbase FROM dd GROUP BY actor, role, resource),
f1 AS (SELECT fz.* EXCLUDE (actor), fz.actor, coalesce(n, 0) + 1 AS i, coalesce(risk_, 0)::DOUBLE AS risk_, coalesce(susp_, 0)::DOUBLE AS susp_, NOT coalesce(list_contains(roles, fz.role), false) AS nr, NOT coalesce(list_contains(acts, fz.action), false) AS na, NOT coalesce(list_contains(uses, fz.resource), false) AS nx, (fz.role, fz.action) NOT IN (SELECT (role, action) FROM dd) AS nra,
  list_append(la, fz.action)[-20:] AS xa, list_append(lr, fz.resource)[-20:] AS xr, list_append(lc, fz.action)[-20:] AS xc, n, cn, base, cbase FROM fz LEFT JOIN kn ON kn.actor = fz.actor LEFT JOIN kc ON kc.actor = fz.actor AND kc.role = fz.role AND kc.resource = fz.resource),
f2 AS (SELECT *, CASE WHEN n >= 5 THEN greatest(0, ({_ENTROPY("xa")} + {_ENTROPY("xr")}) / 2 - base) ELSE 0 END AS shift, CASE WHEN cn >= 5 THEN greatest(0, {_ENTROPY("xc")} / 2 - cbase) ELSE 0 END AS cshift FROM f1),
f3 AS (SELECT *, {_PARTS} AS parts, {_GRAPH} AS gnew FROM f2), f4 AS (SELECT *, CASE WHEN i = 1 THEN 0.15 ELSE least(1.0, parts + 0.25 * risk_) END::DOUBLE AS b, least(1.0, gnew + 0.25 * susp_)::DOUBLE AS g FROM f3),
f5 AS (SELECT *, {_CONF}::DOUBLE AS cf FROM f4), f6 AS (SELECT *, {_FUSED}::DOUBLE AS fu, {_REASONS} AS why FROM f5), f7 AS (SELECT *, {_ACTION} AS act FROM f6)"""
ORACLES["frozen_decisions"] = f"""WITH RECURSIVE {E}, {_ACC}, {_decisions("time < 80000")}, {_STATE} SELECT seq, actor, act AS action_taken, {_OUT} FROM f7"""
