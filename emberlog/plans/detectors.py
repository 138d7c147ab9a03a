"""Queries of older detectors, of detection in batches and of separate runs for windows of time, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import batches as bt
from emberlog.operators import episodes as ep
from emberlog.operators import novelty as nv
from emberlog.operators import variants as vr
from emberlog.operators.tables import saved, shared_folder
from emberlog.sources import views

from .oracles import CHAIN, E, EPISODES, EVENT_CHAIN, ORACLES, SIGNALS, WARM, shaped
from .queries import novelty_config, query, six

WINDOW_SPAN, WINDOW_WARMUP = 20_000, 20


def in_windows(spark, sf_dir):
    e = views.auth(spark, sf_dir)
    return e.withColumn("window_id", F.concat(F.lit("w"), F.floor(F.col("time") / WINDOW_SPAN)))


@query
def batched_episodes(spark, sf_dir):
    """Three batches, the state written and read again between them: the same episodes as in one run."""
    e = saved(views.auth(spark, sf_dir), "events")
    novelty, lo, hi = novelty_config(e), 40_000, 90_000
    folder = f"{shared_folder(spark)}/run-state-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    state, out = bt.RunState(), None
    for k, part in enumerate((e.filter(F.col("time") < lo), e.filter((F.col("time") >= lo) & (F.col("time") < hi)), e.filter(F.col("time") >= hi))):
        closed, state = bt.advance(state, part, novelty, last=k == 2)
        state.save(f"{folder}/{k}")
        state = bt.RunState.load(spark, f"{folder}/{k}")
        out = closed if out is None else out.unionByName(closed)
    return out.select("episode_key", "events_count", "candidate_gate", "suppression_reason", six("score"), F.array_join("signals", ";").alias("signals"))


ORACLES["batched_episodes"] = f"""{CHAIN} SELECT episode_key, events_count, candidate_gate, suppression_reason, round(score, 6) AS score, array_to_string(signals, ';') AS signals FROM f"""


@query
def window_run_episodes(spark, sf_dir):
    out = bt.window_runs(in_windows(spark, sf_dir), WINDOW_WARMUP)
    return out.select("window_id", "episode_key", "events_count", "candidate_gate", "suppression_reason", six("score"))


@query
def window_run_yield(spark, sf_dir):
    e = in_windows(spark, sf_dir)
    y = bt.window_yield(bt.window_runs(e, WINDOW_WARMUP), e)
    text = lambda c: F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda x: F.concat_ws(":", x["key"], x["value"])), ";"), F.lit(""))
    maps = [c for c in y.columns if c.endswith("_counts")]
    return y.select("window_id", "parsed_events", "first_seen_time", "last_seen_time", "accepted_episodes", "suppressed_episodes", six("accepted_per_million_parsed_events"), *(text(c).alias(c) for c in maps))


# Sources, users and ticks of a window are told apart by its number; the rest of the chain is the same.
_WE = E.replace("e AS (", "e0 AS (", 1) + f""", e AS (SELECT time, seq, (time // {WINDOW_SPAN}) || '~' || source AS source, (time // {WINDOW_SPAN}) || '~' || "user" AS "user", dest, time // {WINDOW_SPAN} AS wid FROM e0), wn AS (SELECT time, seq, row_number() OVER (PARTITION BY time // {WINDOW_SPAN} ORDER BY time, seq) AS wnth FROM e)"""
_WS = SIGNALS.replace(f"nth >= {WARM}", f"(o.time, o.seq) IN (SELECT (time, seq) FROM wn WHERE wnth >= {WINDOW_WARMUP})")
_WP = EPISODES.replace("SELECT DISTINCT time AS tick FROM e", "SELECT DISTINCT time AS tick, wid FROM e").replace("ON s.time + 600 <= x.tick", f"ON s.time // {WINDOW_SPAN} = x.wid AND s.time + 600 <= x.tick")
_WKEY = """'w' || split_part(source, '~', 1) || '|' || split_part(source, '~', 2) || '|' || split_part("user", '~', 2) || '|' || start_time || '|' || start_seq"""
_WINDOWS = f"""WITH {_WE}, {_WS}, {_WP}, {shaped(ep.PRUNED)}, f AS (SELECT *, 'w' || split_part(source, '~', 1) AS window_id FROM f_pruned)"""
ORACLES["window_run_episodes"] = f"""{_WINDOWS} SELECT window_id, {_WKEY} AS episode_key, events_count, candidate_gate, suppression_reason, round(score, 6) AS score FROM f"""


def _counted(name: str, values: str, kind: str, good: str) -> str:
    return f"""LEFT JOIN (SELECT window_id, string_agg(v || ':' || n, ';' ORDER BY v) AS {name} FROM (SELECT window_id, v, count(*) AS n FROM (SELECT window_id, unnest({values}) AS v FROM f WHERE {good}) GROUP BY ALL) GROUP BY ALL) AS {kind} USING (window_id)"""


_GOOD, _BAD = "suppression_reason IS NULL", "suppression_reason IS NOT NULL"
_COUNTS = (("accepted_gate_counts", "[candidate_gate]", _GOOD), ("suppressed_gate_counts", "[candidate_gate]", _BAD), ("accepted_signal_counts", "signals", _GOOD), ("suppressed_signal_counts", "signals", _BAD), ("suppressed_reason_counts", "[suppression_reason]", _BAD))
ORACLES["window_run_yield"] = f"""{_WINDOWS}, we AS (SELECT 'w' || wid AS window_id, count(*) AS parsed_events, min(time) AS first_seen_time, max(time) AS last_seen_time FROM e GROUP BY ALL), wf AS (SELECT window_id, count(*) FILTER ({_GOOD}) AS a, count(*) FILTER ({_BAD}) AS b FROM f GROUP BY ALL)
SELECT window_id, parsed_events, first_seen_time, last_seen_time, coalesce(a, 0) AS accepted_episodes, coalesce(b, 0) AS suppressed_episodes, round(coalesce(a, 0) / parsed_events * 1000000, 6) AS accepted_per_million_parsed_events, {", ".join(f"coalesce({n}, '') AS {n}" for n, _, _ in _COUNTS)}
FROM we LEFT JOIN wf USING (window_id) {" ".join(_counted(n, v, f"j{i}", g) for i, (n, v, g) in enumerate(_COUNTS))}"""


# Older detectors.


def early(rows):
    return rows.select("source", "user", "start_time", "end_time", "events_count", "destination_count", F.array_join("signals", ";").alias("signals"), six("max_risk"), "kept")


@query
def every_event_episodes(spark, sf_dir):
    e = views.logins(spark, sf_dir)
    return early(vr.every_event_episodes(e, e.count() // 20))


@query
def cleanup_episodes(spark, sf_dir):
    e = views.auth(spark, sf_dir)
    return early(vr.cleanup_episodes(e, e.count() // 20))


@query
def anchored_episodes(spark, sf_dir):
    e = views.auth(spark, sf_dir)
    return early(vr.anchored_episodes(e, e.count() // 20))


@query
def anchored_sessions(spark, sf_dir):
    e = views.auth(spark, sf_dir)
    rows = nv.event_signals(e, novelty_config(e)).filter(F.size("signals") > 0)
    return vr.anchored_sessions(rows).select("seq", "source", "user", "session", "start_time")


def ratchet(rows):
    return rows.select("source", "user", "session", "start_time", "end_time", "events_count", "destination_count", six("score"), "kept")


@query
def ratchet_scores(spark, sf_dir):
    e = views.auth(spark, sf_dir)
    return ratchet(vr.ratchet_scores(e, novelty_config(e)))


@query
def strict_ratchet_scores(spark, sf_dir):
    e = views.auth(spark, sf_dir)
    return ratchet(vr.strict_ratchet_scores(e, novelty_config(e)))


@query
def sticky_episodes(spark, sf_dir):
    e = views.auth(spark, sf_dir)
    s = vr.sticky_episodes(e, novelty_config(e))
    return s.select("source", "user", "session", "start_time", "events_count", "destination_count", six("novelty"), six("velocity"), six("raw_score"), six("entropy_penalty"), six("score"), six("max_risk"), "candidate_gate", "suppression_reason", F.array_join("signals", ";").alias("signals"))


def _early(gated: bool, numbered: bool, users: bool, success: str) -> str:
    """Events with signals of the early kinds, q."""
    warm, wide = f"nth >= {WARM} AND {success}", f"{success}" + (f" AND nth >= {WARM}" if gated else "")
    name = lambda kind, size: f"'{kind}_' || {size}" if numbered else f"'{kind}'"
    tests = [("'first_time_user_to_dest'", "0.35", f"{warm} AND ud"), ("'first_time_source_to_dest'", "0.28", f"{warm} AND sd"), (name("source_fanout", "ns"), "0.25", f"{wide} AND ns >= 5"), (name("user_fanout", "nu"), "0.25", f"{wide} AND nu >= 5")]
    tests += [("'source_user_fanout'", "0.25", f"{wide} AND nsu >= 3")] if users else []
    before = "ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""q0 AS (SELECT e.*, row_number() OVER (ORDER BY time, seq) AS nth FROM e),
q1 AS (SELECT *, row_number() OVER (PARTITION BY source, dest ORDER BY nth) = 1 AS sd, row_number() OVER (PARTITION BY "user", dest ORDER BY nth) = 1 AS ud, row_number() OVER (PARTITION BY source, "user" ORDER BY nth) = 1 AS su FROM q0),
q2 AS (SELECT *, coalesce(sum(sd::INT) OVER (PARTITION BY source {before}), 0)::BIGINT AS ns, coalesce(sum(ud::INT) OVER (PARTITION BY "user" {before}), 0)::BIGINT AS nu, coalesce(sum(su::INT) OVER (PARTITION BY source {before}), 0)::BIGINT AS nsu FROM q1),
q AS (SELECT *, list_sort(list_filter([{", ".join(f"CASE WHEN {t} THEN {n} END" for n, _, t in tests)}], lambda x: x IS NOT NULL)) AS sg, least(1.0, {" + ".join(f"({t})::INT * {w}" for _, w, t in tests)})::DOUBLE AS risk FROM q2)"""


def _jump(rows: str, next_: str) -> str:
    """Starts of sessions: the first event of a key, then always its first one that `next_` of the last start s lets through."""
    return f"""st AS (SELECT source, "user", min(nth) AS s FROM {rows} GROUP BY ALL UNION ALL SELECT st.source, st."user", min(g.nth) FROM st JOIN {rows} AS a ON a.nth = st.s JOIN {rows} AS g ON g.source = st.source AND g."user" = st."user" AND {next_} GROUP BY ALL),
se AS (SELECT g.*, st.s, h.time AS start_time FROM {rows} AS g ASOF JOIN st ON g.source = st.source AND g."user" = st."user" AND g.nth >= st.s JOIN {rows} AS h ON h.nth = st.s)"""


def _kept(signals: int, events: int) -> str:
    return f"""SELECT source, "user", any_value(start_time) AS start_time, max(time) AS end_time, count(*) AS events_count, count(DISTINCT dest) AS destination_count, array_to_string(list_sort(list_distinct(flatten(list(sg)))), ';') AS signals, round(max(risk), 6) AS max_risk, len(list_distinct(flatten(list(sg)))) >= {signals} AND count(*) >= {events} AS kept FROM se GROUP BY source, "user", s"""


_REC = f"WITH RECURSIVE {E}"
_CLOSES = "ev AS (SELECT q.*, x.first AS closes FROM q ASOF LEFT JOIN (SELECT time, min(nth) AS first FROM q GROUP BY time) AS x ON q.time + 301 <= x.time)"
ORACLES["every_event_episodes"] = f"""{_REC}, {_early(False, True, False, "event_type <> 'error'")}, {_CLOSES}, {_jump("ev", "g.nth > a.closes")} {_kept(2, 1)}"""
_CLEAN = f"""cu AS (SELECT min(time) AS c FROM e WHERE time > 300 UNION ALL SELECT min(e.time) FROM cu JOIN e ON e.time > cu.c + 300 HAVING count(*) > 0),
ev AS (SELECT q.*, x.c AS closes FROM q ASOF LEFT JOIN cu AS x ON q.time + 301 <= x.c WHERE len(sg) > 0)"""
ORACLES["cleanup_episodes"] = f"""{_REC}, {_early(True, True, False, "true")}, {_CLEAN}, {_jump("ev", "g.time >= a.closes")} {_kept(2, 1)}"""
ORACLES["anchored_episodes"] = f"""{_REC}, {_early(True, False, True, "true")}, ev AS (SELECT * FROM q WHERE len(sg) > 0), {_jump("ev", "g.time >= a.time + 300")} {_kept(2, 3)}"""
_SIG = EVENT_CHAIN.replace("WITH e AS", "WITH RECURSIVE e AS", 1)
ORACLES["anchored_sessions"] = f"""{_SIG}, ev AS (SELECT * FROM s WHERE len(signals) > 0), {_jump("ev", "g.time >= a.time + 300")} SELECT seq, source, "user", dense_rank() OVER (PARTITION BY source, "user" ORDER BY s) AS session, start_time FROM se"""


def _weighted(weights: dict[str, float], signals: str = "signals") -> str:
    return "least(1.0::DOUBLE, " + " + ".join(f"list_contains({signals}, '{k}')::INT * {v}::DOUBLE" for k, v in weights.items()) + ")"


_TAGS = {"s_sd": "first_time_source_to_dest", "s_ud": "first_time_user_to_dest", "s_sud": "first_time_source_user_to_dest", "s_sf": "source_fanout", "s_uf": "user_fanout", "s_suf": "source_user_fanout", "s_vel": "fanout_velocity"}
_OWN = "(PARTITION BY source, \"user\", session ORDER BY nth ROWS UNBOUNDED PRECEDING)"


def _so_far(rows: str, weights: dict[str, float]) -> str:
    """What an episode of `rows` is at each event, p, and the risks of events."""
    return f"""p0 AS (SELECT *, {_weighted(weights)} AS risk_, (row_number() OVER (PARTITION BY source, "user", session, dest ORDER BY nth) = 1)::INT AS nd, row_number() OVER (PARTITION BY source, "user", session ORDER BY nth) AS i FROM {rows}),
p AS (SELECT *, count(*) OVER w AS n, sum(nd) OVER w AS d, time - min(time) OVER w AS dur, {", ".join(f"bool_or(list_contains(signals, '{t}')) OVER w AS {k}" for k, t in _TAGS.items())} FROM p0 WINDOW w AS {_OWN})"""


def _ratchet(change: str, kept: str) -> str:
    return f"""ch AS (SELECT *, {change} AS b FROM p),
rt AS (SELECT source, "user", session, i, least(1.0::DOUBLE, greatest(0.0::DOUBLE, risk_ + b)) AS score FROM ch WHERE i = 1 UNION ALL SELECT ch.source, ch."user", ch.session, ch.i, least(1.0::DOUBLE, greatest(0.0::DOUBLE, greatest(rt.score, risk_) + b)) FROM rt JOIN ch ON ch.source = rt.source AND ch."user" = rt."user" AND ch.session = rt.session AND ch.i = rt.i + 1)
SELECT source, "user", session::BIGINT AS session, min(time) AS start_time, max(time) AS end_time, count(*) AS events_count, count(DISTINCT dest) AS destination_count, round(arg_max(score, i), 6) AS score, count(*) >= 3 AND {kept} AS kept FROM ch JOIN rt USING (source, "user", session, i) GROUP BY source, "user", session"""


_SESSIONS = f"{_SIG}, {EPISODES}"
_FT = "(s_sd::INT + s_ud::INT + s_sud::INT)"
ORACLES["ratchet_scores"] = f"""{_SESSIONS}, {_so_far("m", vr.RATCHET_WEIGHTS)}, {_ratchet(f"(n BETWEEN 3 AND 25 AND d <= 10 AND greatest(1, dur) <= 300)::INT * 0.18::DOUBLE + 0.08::DOUBLE * {_FT} - (d > 25)::INT * 0.30::DOUBLE - (greatest(1, dur) > 300)::INT * 0.15::DOUBLE", "arg_max(score, i) >= 0.75 - 1e-9 AND bool_or(s_sd OR s_ud OR s_sud)")}"""
_FAST = EPISODES.replace("FROM s ASOF LEFT JOIN", "FROM sv AS s ASOF LEFT JOIN")
_VELOCITY = """sv AS (SELECT s.* EXCLUDE (signals), CASE WHEN (SELECT count(DISTINCT b.dest) FROM s AS b WHERE b.source = s.source AND b."user" = s."user" AND b.time >= s.time - 120 AND b.nth <= s.nth) >= 3 THEN list_sort(list_append(signals, 'fanout_velocity')) ELSE signals END AS signals FROM s)"""
ORACLES["strict_ratchet_scores"] = f"""{_SIG}, {_VELOCITY}, {_FAST}, {_so_far("m", vr.STRICT_WEIGHTS)}, {_ratchet(f"(n BETWEEN 3 AND 30 AND d <= 10 AND dur <= 420)::INT * 0.22::DOUBLE + s_vel::INT * 0.10::DOUBLE + 0.05::DOUBLE * {_FT} - (d > 25)::INT * 0.35::DOUBLE - CASE WHEN dur > 900 THEN 0.30::DOUBLE WHEN dur > 300 THEN 0.12::DOUBLE ELSE 0 END", "arg_max(score, i) >= 0.82 - 1e-9 AND bool_or(s_sud) AND bool_or(s_sd OR s_ud)")}"""
_PEN = {"entropy_many_events": ("n > 80", 0.10), "entropy_extreme_events": ("n > 200", 0.20), "entropy_long_duration": ("dur > 1800", 0.15), "entropy_excessive_destinations": ("d > 40", 0.20), "entropy_low_novelty": ("nov < 0.25", 0.20)}
_CONV = "s_sud AND s_co AND (s_suf OR s_sf)"
_DYNAMIC = {"compact_lateral_burst": "s_co", "fanout_velocity": "s_ve", "low_convergence_penalty": "kinds < 3", "propagation_convergence_bonus": _CONV, **{k: c for k, (c, _) in _PEN.items()}}
ORACLES["sticky_episodes"] = f"""{_SESSIONS}, {_so_far("m", vr.STICKY_WEIGHTS)},
y1 AS (SELECT *, sum(hits) OVER w / n AS nov, least(1.0, d / greatest(greatest(1, dur) / 60, 1.0) / 3.0) AS speed FROM p WINDOW w AS {_OWN}),
y2 AS (SELECT *, bool_or(n BETWEEN 3 AND 35 AND d BETWEEN 3 AND 12 AND greatest(1, dur) <= 600) OVER w AS s_co, bool_or(speed >= 0.65) OVER w AS s_ve FROM y1 WINDOW w AS {_OWN}),
y3 AS (SELECT *, s_sd::INT + s_ud::INT + s_sud::INT + s_sf::INT + s_uf::INT + s_suf::INT + s_co::INT + s_ve::INT AS kinds FROM y2),
y4 AS (SELECT source, "user", session, min(time) AS start_time, max(risk_) AS mr, {", ".join(f"bool_or({c}) AS t_{t}" for t, c in _DYNAMIC.items())} FROM y3 GROUP BY ALL),
y5 AS (SELECT *, s_sud::INT * 0.30::DOUBLE + s_ud::INT * 0.18::DOUBLE + s_sd::INT * 0.16::DOUBLE + s_suf::INT * 0.16::DOUBLE + s_sf::INT * 0.12::DOUBLE + s_uf::INT * 0.10::DOUBLE + s_co::INT * 0.18::DOUBLE + CASE WHEN s_ve THEN 0.18::DOUBLE * speed ELSE 0 END + 0.10::DOUBLE * least(1.0, d / greatest(1, dur) / 0.03) AS base, least(0.65::DOUBLE, {" + ".join(f"({c})::INT * {v}::DOUBLE" for c, v in _PEN.values())}) AS pen
  FROM y3 JOIN y4 USING (source, "user", session) QUALIFY row_number() OVER (PARTITION BY source, "user", session ORDER BY nth DESC) = 1),
y6 AS (SELECT *, least(1.0::DOUBLE, CASE WHEN kinds < 3 THEN base * 0.5 ELSE base END + ({_CONV})::INT * 0.12::DOUBLE) AS raw FROM y5),
y7 AS (SELECT *, greatest(0.0, raw - pen) AS sc, CASE WHEN s_sud AND s_co AND (s_sf OR s_uf OR s_suf) THEN 'A' WHEN speed >= 0.65 AND {_FT} >= 2 THEN 'B' WHEN nov >= 0.50 AND d >= 3 AND dur <= 600 THEN 'C' ELSE 'none' END AS gate FROM y6)
SELECT source, "user", session::BIGINT AS session, start_time, n AS events_count, d::BIGINT AS destination_count, round(nov, 6) AS novelty, round(speed, 6) AS velocity, round(raw, 6) AS raw_score, round(pen, 6) AS entropy_penalty, round(sc, 6) AS score, round(mr, 6) AS max_risk, gate AS candidate_gate,
  CASE WHEN n < 3 THEN 'too_few_events' WHEN {_FT} = 0 THEN 'no_first_time_edge' WHEN gate = 'none' THEN 'no_candidate_gate' WHEN sc < 0.75 - 1e-9 THEN 'below_min_score' END AS suppression_reason,
  array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN {k} THEN '{t}' END" for k, t in _TAGS.items() if k != "s_vel")}, {", ".join(f"CASE WHEN t_{t} THEN '{t}' END" for t in _DYNAMIC)}], lambda x: x IS NOT NULL)), ';') AS signals FROM y7"""
