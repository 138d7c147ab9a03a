"""Queries of burden, cluster, scope and window reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import batches as bt
from emberlog.operators import geometry as gm
from emberlog.operators import queues as qu
from emberlog.operators import windows as wn
from emberlog.sources import readers as rd
from emberlog.sources import views

from .oracles import _CAND, _CLEAN, _DENSE, _F, _G, _LINES, _PRI, _Q, _SEV, CHAIN, LABELS, ORACLES, E
from .queries import auth_lines, by_score, dense, detected, query, queues_of, six
from .review import _PICKED

DAY = 20_000


def _most(name: str, key: str, rows: str) -> str:
    """The most frequent v of rows (key, v), with its count n."""
    return f"{name} AS (SELECT {key}, v, n FROM (SELECT {key}, v, count(*) AS n FROM ({rows}) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY n DESC, v) = 1)"


def _shares(name: str, field: str) -> str:
    return f"""{name} AS (SELECT queue_size, arg_min(v, i) AS top, sum(n) FILTER (i = 1) AS s1, sum(n) FILTER (i <= 5) AS s5, sum(n) AS s10 FROM (SELECT queue_size, {field} AS v, count(*) AS n, row_number() OVER (PARTITION BY queue_size ORDER BY count(*) DESC, {field}) AS i FROM qs GROUP BY queue_size, {field}) WHERE i <= 10 GROUP BY queue_size)"""


@query
def queue_burden(spark, sf_dir):
    b = qu.queue_burden(queues_of(spark, sf_dir), "C1")
    shares = [f"top{k}_{f}_share" for f in ("source", "user") for k in (1, 5, 10)]
    return b.select(
        "queue_size", "rows", "unique_sources", "unique_users", "unique_gates", "focus_count", "top_source", "top_user", "dominant_gate", "dominant_severity", "dominant_signal",
        *(six(c) for c in ("focus_share", *shares, "min_score", "max_score", "median_score", "median_duration", "median_destination_count", "median_events_count", "dominant_gate_share", "dominant_severity_share", "dominant_signal_share")),
    )


_share = lambda t, f: ", ".join(f"round(any_value({t}.s{k}) / count(*), 6) AS top{k}_{f}_share" for k in (1, 5, 10))
ORACLES["queue_burden"] = f"""{_Q}, {_shares("ss", "source")}, {_shares("su", '"user"')}, {_most("dg", "queue_size", "SELECT queue_size, candidate_gate AS v FROM qs")}, {_most("dv", "queue_size", f"SELECT queue_size, {_SEV} AS v FROM qs")}, {_most("ds", "queue_size", "SELECT queue_size, unnest(signals) AS v FROM qs")}
SELECT queue_size, count(*) AS rows, count(DISTINCT source) AS unique_sources, count(DISTINCT "user") AS unique_users, count(DISTINCT candidate_gate) AS unique_gates, count(*) FILTER (source = 'C1') AS focus_count, round(count(*) FILTER (source = 'C1') / count(*), 6) AS focus_share, any_value(ss.top) AS top_source, any_value(su.top) AS top_user, {_share("ss", "source")}, {_share("su", "user")},
  round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, round(median(score), 6) AS median_score, {", ".join(f"round(median({c}), 6) AS median_{c}" for c in ("duration", "destination_count", "events_count"))}, {", ".join(f"any_value({t}.v) AS dominant_{n}, round(any_value({t}.n) / count(*), 6) AS dominant_{n}_share" for t, n in (("dg", "gate"), ("dv", "severity"), ("ds", "signal")))}
FROM qs JOIN ss USING (queue_size) JOIN su USING (queue_size) JOIN dg USING (queue_size) JOIN dv USING (queue_size) JOIN ds USING (queue_size) GROUP BY queue_size"""


@query
def user_concentration(spark, sf_dir):
    return qu.concentration(queues_of(spark, sf_dir), qu.named("user"), ["queue_size"]).select("queue_size", "value", "place", "n", six("share"), six("cumulative_share"))


@query
def signal_concentration(spark, sf_dir):
    return qu.signal_concentration(queues_of(spark, sf_dir)).select("queue_size", "value", "place", "n", six("share"), six("cumulative_share"))


_CONCENTRATED = "SELECT queue_size, v AS value, place, n, round(n / t, 6) AS share, round(sum(n) OVER (PARTITION BY queue_size ORDER BY place) / t, 6) AS cumulative_share FROM (SELECT queue_size, v, count(*) AS n, row_number() OVER (PARTITION BY queue_size ORDER BY count(*) DESC, v) AS place FROM ({}) GROUP BY queue_size, v) JOIN (SELECT queue_size, count(*) AS t FROM qs GROUP BY queue_size) USING (queue_size) WHERE place <= {}"
ORACLES["user_concentration"] = f"""{_Q} {_CONCENTRATED.format('SELECT queue_size, "user" AS v FROM qs', 50)}"""
ORACLES["signal_concentration"] = f"""{_Q} {_CONCENTRATED.format("SELECT queue_size, unnest(signals) AS v FROM qs", 100)}"""


CLUSTER = ("top_gates", "top_priorities", "top_signals", "users", "representatives", "dominant_gate", "dominant_severity", "dominant_signal", "dominant_gate_count", "dominant_severity_count", "dominant_signal_count")


@query
def cluster_report(spark, sf_dir):
    c = qu.cluster_report(queues_of(spark, sf_dir))
    return c.select("queue_size", "source", "episodes", "top_rank", "last_rank", "rank_span", "time_min", "time_max", "time_span", "unique_users", *(six(n) for n in ("score_max", "score_median", "score_min", "median_duration", "median_destination_count", "median_events_count")), *CLUSTER)


_KEY = "queue_size, source"
_top = lambda name, to, rows, k: f"""{name} AS (SELECT {_KEY}, string_agg(v || ':' || n, ';' ORDER BY i) AS {to} FROM (SELECT {_KEY}, v, count(*) AS n, row_number() OVER (PARTITION BY {_KEY} ORDER BY count(*) DESC, v) AS i FROM ({rows}) GROUP BY {_KEY}, v) WHERE i <= {k} GROUP BY {_KEY})"""
_GATES, _SIGNALS = f"SELECT {_KEY}, candidate_gate AS v FROM qs", f"SELECT {_KEY}, unnest(signals) AS v FROM qs"
ORACLES["cluster_report"] = f"""{_Q}, {_most("dg", _KEY, _GATES)}, {_most("dv", _KEY, f"SELECT {_KEY}, {_SEV} AS v FROM qs")}, {_most("ds", _KEY, _SIGNALS)}, {_top("tg", "top_gates", _GATES, 5)}, {_top("tp", "top_priorities", f"SELECT {_KEY}, {_PRI} AS v FROM qs", 5)}, {_top("ts", "top_signals", _SIGNALS, 8)},
us AS (SELECT {_KEY}, string_agg("user", ';' ORDER BY r) AS users FROM (SELECT {_KEY}, "user", min(rank) AS r FROM qs GROUP BY {_KEY}, "user" QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY min(rank)) <= 20) GROUP BY {_KEY}),
rp AS (SELECT {_KEY}, string_agg(episode_key, ';' ORDER BY rank) AS representatives FROM (SELECT * FROM qs QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY rank) <= 5) GROUP BY {_KEY}),
cl AS (SELECT {_KEY}, count(*) AS episodes, min(rank) AS top_rank, max(rank) AS last_rank, max(rank) - min(rank) AS rank_span, min(start_time) AS time_min, max(end_time) AS time_max, max(end_time) - min(start_time) AS time_span, count(DISTINCT "user") AS unique_users, round(max(score), 6) AS score_max, round(median(score), 6) AS score_median, round(min(score), 6) AS score_min, {", ".join(f"round(median({c}), 6) AS median_{c}" for c in ("duration", "destination_count", "events_count"))} FROM qs GROUP BY {_KEY})
SELECT cl.*, top_gates, top_priorities, top_signals, users, representatives, {", ".join(f"{t}.v AS dominant_{n}, {t}.n AS dominant_{n}_count" for t, n in (("dg", "gate"), ("dv", "severity"), ("ds", "signal")))} FROM cl {" ".join(f"LEFT JOIN {t} USING ({_KEY})" for t in ("dg", "dv", "ds", "tg", "tp", "ts", "us", "rp"))}"""


def by_day(rows, time="start_time"):
    return rows.withColumn("day", F.floor(F.col(time) / DAY))


SEVERITIES = ("background", "low_review", "medium_review", "high_review", "critical_review")


@query
def scope_report(spark, sf_dir):
    episodes, events = by_day(detected(spark, sf_dir)), by_day(views.auth(spark, sf_dir), "time")
    y = bt.window_yield(episodes, events, "day").select("day", "parsed_events", "accepted_episodes", "suppressed_episodes", "accepted_per_million_parsed_events")
    s = qu.scope_report(episodes, "day", y)
    return s.select(
        "scope", "rows", "unique_sources", "unique_users", "top_source", "top_source_count", "dominant_gate", "dominant_signal", *(f"{c}_count" for c in SEVERITIES), *(six(c) for c in ("p0", "p50", "p75", "p90", "p95", "p99", "p100", "top5_share", "top10_share", "top_source_share", "dominant_gate_share", "dominant_signal_share")),
        "parsed_events", "accepted_episodes", "suppressed_episodes", six("accepted_per_million_parsed_events"),
    )


_REVIEWED = "CASE WHEN score >= 0.90 THEN 'critical_review' WHEN score >= 0.75 THEN 'high_review' WHEN score >= 0.50 THEN 'medium_review' WHEN score >= 0.25 THEN 'low_review' ELSE 'background' END"
ORACLES["scope_report"] = f"""{_F}, sb AS (SELECT (start_time // {DAY})::VARCHAR AS scope, * FROM fs UNION ALL SELECT 'all', * FROM fs), st AS (SELECT scope, source, count(*) AS n, row_number() OVER (PARTITION BY scope ORDER BY count(*) DESC, source) AS i FROM sb GROUP BY scope, source),
sh AS (SELECT scope, arg_min(source, i) AS top_source, arg_min(n, i) AS top_source_count, sum(n) FILTER (i <= 5) AS s5, sum(n) FILTER (i <= 10) AS s10 FROM st GROUP BY scope), {_most("dg", "scope", "SELECT scope, candidate_gate AS v FROM sb")}, {_most("ds", "scope", "SELECT scope, unnest(signals) AS v FROM sb")},
ye AS (SELECT (time // {DAY})::VARCHAR AS scope, count(*) AS parsed_events FROM e GROUP BY ALL), yf AS (SELECT (start_time // {DAY})::VARCHAR AS scope, count(*) FILTER (suppression_reason IS NULL) AS a, count(*) FILTER (suppression_reason IS NOT NULL) AS b FROM fs GROUP BY ALL)
SELECT scope, count(*) AS rows, count(DISTINCT source) AS unique_sources, count(DISTINCT "user") AS unique_users, any_value(top_source) AS top_source, any_value(top_source_count) AS top_source_count, any_value(dg.v) AS dominant_gate, any_value(ds.v) AS dominant_signal, {", ".join(f"count(*) FILTER ({_REVIEWED} = '{s}') AS {s}_count" for s in SEVERITIES)},
  {", ".join(f"round(quantile_cont(score, {p / 100}), 6) AS p{p}" for p in (0, 50, 75, 90, 95, 99, 100))}, round(any_value(s5) / count(*), 6) AS top5_share, round(any_value(s10) / count(*), 6) AS top10_share, round(any_value(top_source_count) / count(*), 6) AS top_source_share, round(any_value(dg.n) / count(*), 6) AS dominant_gate_share, round(any_value(ds.n) / count(*), 6) AS dominant_signal_share,
  any_value(parsed_events) AS parsed_events, any_value(a) AS accepted_episodes, any_value(b) AS suppressed_episodes, round(any_value(a) / any_value(parsed_events) * 1000000, 6) AS accepted_per_million_parsed_events
FROM sb JOIN sh USING (scope) JOIN dg USING (scope) LEFT JOIN ds USING (scope) LEFT JOIN ye USING (scope) LEFT JOIN yf USING (scope) GROUP BY scope"""


@query
def scope_distribution(spark, sf_dir):
    """All fractions of each scope's scores."""
    s = qu.scope_summary(by_day(detected(spark, sf_dir)), "day")
    return s.select("scope", "n", *(six(f"p{q}") for q in ("0", "01", "05", "10", "25", "50", "75", "90", "95", "99", "100")))


ORACLES["scope_distribution"] = f"""{_F}, sb AS (SELECT (start_time // {DAY})::VARCHAR AS scope, score FROM fs UNION ALL SELECT 'all', score FROM fs) SELECT scope, count(*) AS n, {", ".join(f"round(quantile_cont(score, {int(q) / 100}), 6) AS p{q}" for q in ("0", "01", "05", "10", "25", "50", "75", "90", "95", "99", "100"))} FROM sb GROUP BY scope"""


@query
def window_stability_rows(spark, sf_dir):
    rows = gm.regimes(by_score(by_day(detected(spark, sf_dir))), 100, 2000)
    return gm.window_rows(rows, "day").select("day", "rows", *(six(f"score_{c}") for c in ("mean", "std", "p99", "max")), "r0_count", "r1_count", "r2_count")


ORACLES["window_stability_rows"] = f"""{_G} SELECT start_time // {DAY} AS day, count(*) AS rows, round(avg(score), 6) AS score_mean, round(stddev_pop(score), 6) AS score_std, round(quantile_cont(score, 0.99), 6) AS score_p99, round(max(score), 6) AS score_max, {", ".join(f"count(*) FILTER (regime = 'R{k}') AS r{k}_count" for k in range(3))} FROM rg GROUP BY ALL"""


@query
def window_spread(spark, sf_dir):
    """Variances and deviations across windows."""
    s = gm.window_stability(by_day(detected(spark, sf_dir)), "day")
    return s.select("windows", *(F.round(f"{n}_{k}", 9).alias(f"{n}_{k}") for k in ("mean", "p99", "max") for n in ("var", "std")))


ORACLES["window_spread"] = f"""{CHAIN}, ws AS (SELECT avg(score) AS mean, quantile_cont(score, 0.99) AS p99, max(score) AS max FROM f GROUP BY start_time // {DAY}) SELECT count(*) AS windows, {", ".join(f"round({f}_pop({k}), 9) AS {n}_{k}" for k in ("mean", "p99", "max") for n, f in (("var", "var"), ("std", "stddev")))} FROM ws"""


QUOTAS = {"early": 1, "middle": 4, "late": 2}


@query
def background_windows(spark, sf_dir):
    """A quota for each band, ids in order of the choice, and its reason."""
    w = wn.selected_windows(dense(spark, sf_dir), QUOTAS, 0.5, 3600)
    return w.select("window_id", "start", "end", "band", "line_count", "density_rank", "selection_reason")


_QUOTA = "(CASE {}.band " + " ".join(f"WHEN '{b}' THEN {n}" for b, n in QUOTAS.items()) + " END)"
_CHOSEN = _PICKED.replace("pk.round < 3", "pk.round < " + _QUOTA.format("pk")).replace("r <= 3 -", "r <= " + _QUOTA.format("fl") + " -")
_WHY = "'profile_based_selection;band=' || band || ';outside_redteam_margin;sufficient_auth_volume;density_target_quantile=0.5;' || CASE WHEN fill THEN 'deterministic_band_fill' ELSE 'deterministic_band_selection' END"
ORACLES["background_windows"] = f"""WITH RECURSIVE {E}, {LABELS}, {_CAND}, {_CLEAN}, {_DENSE}, {_CHOSEN}, ab AS (SELECT al.band, al.o, ch.o IS NULL AS fill FROM al LEFT JOIN ch ON ch.band = al.band AND ch.o = al.o)
SELECT 'bg_' || lpad(row_number() OVER (ORDER BY list_position(['early', 'middle', 'late'], band), fill, o)::VARCHAR, 3, '0') AS window_id, start, "end", band, line_count, density_rank::INT AS density_rank, {_WHY} AS selection_reason FROM cn JOIN ab USING (band, o)"""


@query
def first_lines_probe(spark, sf_dir):
    """Lines that hold a text among the first thousand."""
    return rd.probe(auth_lines(spark, sf_dir), ",C1,D1", first=1000)


ORACLES["first_lines_probe"] = f"""WITH {E}, {_LINES}, fl AS (SELECT * FROM (SELECT * FROM ln ORDER BY seq LIMIT 1000) WHERE contains(value, ',C1,D1')) SELECT count(*) AS n, min(seq) AS first_seq, (SELECT string_agg(value, '|' ORDER BY seq) FROM (SELECT * FROM fl ORDER BY seq LIMIT 5)) AS examples FROM fl"""
