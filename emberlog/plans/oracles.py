"""The registered queries in DuckDB's SQL."""

from __future__ import annotations

from emberlog.operators.episodes import PRESETS, Preset
from emberlog.operators.features import NUMERIC
from emberlog.operators.features import SIGNALS as TAGS

ORACLES: dict[str, str] = {}

E = """e AS (SELECT (epoch_us(ts) - 1704067200000000) // 16000000 AS time, event_id AS seq, 'C' || (user_id % 20) AS source, 'U' || (user_id % 50) AS "user", 'D' || ((props->>'$.k')::BIGINT % 60) AS dest, event_type, value, user_id, (props->>'$.k')::BIGINT AS k FROM events)"""
LABELS = """labels_ AS (SELECT row_number() OVER (ORDER BY time, seq) - 1 AS redteam_index, time, "user", source, dest FROM e WHERE event_type = 'purchase' AND value > 60)"""
#: The warm-up of queries: a twentieth of the events.
WARM = "(SELECT count(*) // 20 FROM events)"
#: Events with signals after the warm-up.
SIGNALS = f"""
o AS (SELECT time, seq, source, "user", dest, row_number() OVER (ORDER BY time, seq) AS nth FROM e),
sd AS (SELECT source, dest, min(nth) AS f FROM o GROUP BY ALL), ud AS (SELECT "user", dest, min(nth) AS f FROM o GROUP BY ALL), sud AS (SELECT source, "user", dest, min(nth) AS f FROM o GROUP BY ALL),
rs AS (SELECT source, f FROM sd QUALIFY row_number() OVER (PARTITION BY source ORDER BY f) = 5), ru AS (SELECT "user", f FROM ud QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY f) = 5),
rsu AS (SELECT source, "user", f FROM sud QUALIFY row_number() OVER (PARTITION BY source, "user" ORDER BY f) = 3),
b AS (SELECT o.*, nth = sd.f AS t_sd, nth = ud.f AS t_ud, nth = sud.f AS t_sud, coalesce(nth > rs.f, false) AS t_sf, coalesce(nth > ru.f, false) AS t_uf, coalesce(nth > rsu.f, false) AS t_suf
  FROM o JOIN sd USING (source, dest) JOIN ud USING ("user", dest) JOIN sud USING (source, "user", dest) LEFT JOIN rs USING (source) LEFT JOIN ru USING ("user") LEFT JOIN rsu USING (source, "user") WHERE nth >= {WARM}),
s AS (SELECT *, list_sort(list_filter([CASE WHEN t_sd THEN 'first_time_source_to_dest' END, CASE WHEN t_ud THEN 'first_time_user_to_dest' END, CASE WHEN t_sud THEN 'first_time_source_user_to_dest' END, CASE WHEN t_sf THEN 'source_fanout' END, CASE WHEN t_uf THEN 'user_fanout' END, CASE WHEN t_suf THEN 'source_user_fanout' END], lambda x: x IS NOT NULL)) AS signals,
  t_sd::INT + t_ud::INT + t_sud::INT AS hits, least(1.0, t_sd::INT * 0.22 + t_ud::INT * 0.26 + t_sud::INT * 0.42 + t_sf::INT * 0.10 + t_uf::INT * 0.10 + t_suf::INT * 0.20)::DOUBLE AS risk FROM b)"""
EPISODES = """
ticks AS (SELECT DISTINCT time AS tick FROM e),
g AS (SELECT s.*, x.tick AS pop FROM s ASOF LEFT JOIN ticks AS x ON s.time + 600 <= x.tick WHERE len(signals) > 0),
n AS (SELECT *, coalesce(lag(time) OVER w IS NULL OR max(pop) OVER (PARTITION BY source, "user" ORDER BY time RANGE BETWEEN UNBOUNDED PRECEDING AND 600 PRECEDING) >= lag(time) OVER w + 300, false) AS fresh FROM g WINDOW w AS (PARTITION BY source, "user" ORDER BY time, seq)),
m AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY source, "user" ORDER BY time, seq ROWS UNBOUNDED PRECEDING) AS session FROM n),
pd AS (SELECT source, "user", session, dest, min(time) AS t FROM m GROUP BY ALL),
pk AS (SELECT source, "user", session, count(*) AS destination_count, max(c) AS peak FROM (SELECT *, count(*) OVER (PARTITION BY source, "user", session ORDER BY t RANGE BETWEEN 120 PRECEDING AND CURRENT ROW) AS c FROM pd) GROUP BY ALL),
ep AS (SELECT source, "user", session, min(time) AS start_time, max(time) AS end_time, arg_min(seq, nth) AS start_seq, count(*) AS events_count, list_sort(list_distinct(flatten(list(signals)))) AS sg, count(*) FILTER (hits > 0) AS first_time_event_count, sum(hits)::BIGINT AS first_time_signal_hits, max(risk) AS max_risk,
  bool_or(t_sd) AS sd, bool_or(t_ud) AS ud, bool_or(t_sud) AS sud, bool_or(t_sf) AS sf, bool_or(t_uf) AS uf, bool_or(t_suf) AS suf FROM m GROUP BY ALL),
r AS (SELECT *, end_time - start_time AS dur, source || '|' || "user" || '|' || start_time || '|' || start_seq AS episode_key FROM ep JOIN pk USING (source, "user", session))"""


def shaped(p: Preset) -> str:
    """Episodes r as scored and gated f, in one preset."""
    d = "destination_count"
    b = "sud AND vs >= 0.60 AND ft >= 2" + (f" AND vel AND (suf OR compact) AND dur <= 900 AND {d} <= 30 AND nov >= 0.10" if p.b_bounded else "")
    e = "sud AND suf AND ft >= 2 AND " + (f"dur <= 720 AND {d} <= 20 AND (((compact OR vel) AND nov >= 0.20) OR ({d} <= 12 AND dur <= 600 AND nov >= 0.35))" if p.e_strict else f"dur <= 900 AND {d} <= 30 AND nov >= 0.15")
    gates = {
        "A": f"sud AND compact AND ({'suf' if p.a_needs_fanout else 'suf OR vel'}) AND nov >= {p.a_novelty} AND dur <= {p.a_duration} AND {d} <= {p.a_dests}",
        "B": b,
        "C": f"sud AND nov >= {p.c_novelty} AND {d} >= 3 AND dur <= 900" + (f" AND {d} <= {p.c_dests}" if p.c_dests else ""),
        "D": f"sud AND compact AND ft >= 2 AND dur <= 900 AND {d} <= 24 AND nov >= {p.d_novelty}",
        "E": e,
    }
    gate = " ".join(f"WHEN {gates[g]} THEN '{g}'" for g in p.order)
    low = f"WHEN nov < {p.low_novelty} AND vs < 0.60 AND NOT compact THEN 'low_novelty_without_velocity_or_compactness'" if p.suppress_low_novelty else ""
    n = p.name
    return f"""
a_{n} AS (SELECT *, least(1.0, {d} / greatest(1, dur) / 0.03) AS cs, least(1.0, peak / 3) AS vs, first_time_event_count / greatest(1, events_count) AS nov, sd::INT + ud::INT + sud::INT AS ft, events_count BETWEEN 3 AND 30 AND {d} BETWEEN 3 AND {p.compact_dests} AND greatest(1, dur) <= {p.compact_duration} AS compact, least(1.0, peak / 3) >= 0.60 AS vel FROM r),
c_{n} AS (SELECT *, ft + sf::INT + uf::INT + suf::INT + compact::INT + vel::INT < 3 AS lowc, sud AND compact AND (suf OR vel) AS conv, {p.compact_bonus} > 0 AND sud AND ud AND compact AND NOT vel AS rescue, {p.fanout_bonus} > 0 AND sud AND suf AND nov >= {p.fanout_bonus_novelty} AS spread,
  (sud::INT * 0.42::DOUBLE + ud::INT * 0.22::DOUBLE + sd::INT * 0.18::DOUBLE + suf::INT * 0.20::DOUBLE + sf::INT * 0.10::DOUBLE + uf::INT * 0.10::DOUBLE + compact::INT * 0.22::DOUBLE + vel::INT * 0.22::DOUBLE * vs + 0.08::DOUBLE * cs) AS base FROM a_{n}),
d_{n} AS (SELECT *, least(1.0::DOUBLE, CASE WHEN lowc THEN base * 0.5::DOUBLE ELSE base END + conv::INT * 0.10::DOUBLE + rescue::INT * {p.compact_bonus}::DOUBLE + spread::INT * {p.fanout_bonus}::DOUBLE) AS raw_score,
  least(0.75::DOUBLE, (events_count > 80)::INT * 0.10::DOUBLE + (events_count > 200)::INT * 0.20::DOUBLE + (dur > {p.long_duration})::INT * 0.30::DOUBLE + (dur > {p.soft_duration} AND dur <= {p.long_duration})::INT * 0.12::DOUBLE + ({d} > 25)::INT * 0.35::DOUBLE + ({d} > 40)::INT * 0.20::DOUBLE + (nov < {p.low_novelty})::INT * {p.low_novelty_penalty}::DOUBLE) AS entropy_penalty FROM c_{n}),
h_{n} AS (SELECT *, least(1.0, greatest(0.0, raw_score - entropy_penalty)) AS score, CASE {gate} ELSE 'none' END AS candidate_gate FROM d_{n}),
f_{n} AS (SELECT *, '{n}' AS preset, CASE WHEN events_count < {p.min_events} THEN 'too_few_events' WHEN NOT sud THEN 'missing_source_user_dest_novelty' WHEN NOT (sd OR ud) THEN 'missing_first_time_convergence' WHEN candidate_gate = 'none' THEN 'no_candidate_gate' {low} WHEN score < {p.min_score} - 1e-9 THEN 'below_min_score' END AS suppression_reason,
  list_sort(list_concat(sg, list_filter([CASE WHEN compact THEN 'compact_lateral_burst' END, CASE WHEN vel THEN 'fanout_velocity' END, CASE WHEN lowc THEN 'low_convergence_penalty' END, CASE WHEN conv THEN 'propagation_convergence_bonus' END, CASE WHEN rescue THEN 'compact_rescue_bonus' END, CASE WHEN spread THEN 'source_user_fanout_rescue_bonus' END, CASE WHEN events_count > 80 THEN 'entropy_many_events' END, CASE WHEN events_count > 200 THEN 'entropy_extreme_events' END, CASE WHEN dur > {p.long_duration} THEN 'entropy_long_duration' END, CASE WHEN dur > {p.soft_duration} AND dur <= {p.long_duration} THEN 'entropy_soft_duration' END, CASE WHEN {d} > 25 THEN 'entropy_oversized_fanout' END, CASE WHEN {d} > 40 THEN 'entropy_excessive_destinations' END, CASE WHEN nov < {p.low_novelty} THEN 'entropy_low_novelty' END], lambda x: x IS NOT NULL))) AS signals FROM h_{n})"""


CHAIN = f"WITH {E}, {LABELS}, {SIGNALS}, {EPISODES}, {shaped(PRESETS['pruned'])}, f AS (SELECT * FROM f_pruned)"
EVENT_CHAIN = f"WITH {E}, {LABELS}, {SIGNALS}"
OUT = """episode_key, source, "user", start_time, end_time, dur AS duration, events_count, destination_count, first_time_event_count, first_time_signal_hits, round(nov, 6) AS novelty, round(cs, 6) AS compactness, round(vs, 6) AS velocity, peak, round(entropy_penalty, 6) AS entropy_penalty, round(raw_score, 6) AS raw_score, round(score, 6) AS score, round(max_risk, 6) AS max_risk, candidate_gate, suppression_reason, array_to_string(signals, ';') AS signals"""
ORACLES["episodes_detect"] = f"{CHAIN} SELECT {OUT} FROM f"

_LINES = """ln AS (SELECT seq, concat_ws(',', CASE WHEN k % 23 = 0 THEN 'x' ELSE time::VARCHAR END, CASE WHEN k % 5 = 0 THEN '?' ELSE "user" END, 'V' || (k % 7), source, CASE WHEN k % 17 = 0 THEN '?' ELSE dest END, 'Kerberos', 'Network', 'LogOn', CASE WHEN event_type = 'error' THEN 'Fail' ELSE 'Success' END) AS value FROM e),
pf AS (SELECT seq, value, list_transform(string_split(value, ','), lambda x: CASE WHEN trim(x) IN ('?', '') THEN NULL ELSE trim(x) END) AS c FROM ln)"""
ORACLES["read_auth_strict"] = f"""WITH {E}, {_LINES} SELECT seq, try_cast(c[1] AS BIGINT) AS time, coalesce(c[2], c[3], '') AS "user", c[4] AS source, c[5] AS dest FROM pf WHERE c[9] = 'Success' AND try_cast(c[1] AS BIGINT) IS NOT NULL AND c[4] IS NOT NULL AND c[5] IS NOT NULL"""
ORACLES["read_auth_permissive"] = f"""WITH {E}, {_LINES} SELECT seq, coalesce(try_cast(c[1] AS BIGINT), -1) AS time, c[2] AS src_user, c[3] AS dst_user, c[4] AS source, c[5] AS dest, lower(c[9]) = 'success' AS success FROM pf"""
ORACLES["read_auth_tolerant"] = f"""WITH {E}, {_LINES} SELECT seq, try_cast(c[1] AS BIGINT) AS time, c[2] AS src_user, c[4] AS source, c[5] AS dest, value AS raw FROM pf WHERE try_cast(c[1] AS BIGINT) IS NOT NULL"""
ORACLES["read_flow"] = f"""WITH {E} SELECT seq, time, 0::BIGINT AS duration, source AS src, 0::BIGINT AS src_port, dest AS dst, 4440 + k % 10 AS dst_port, '6' AS protocol, k % 9 AS packets, floor(value * 100)::BIGINT AS bytes FROM e"""
ORACLES["read_proc_dns"] = f"""WITH {E} SELECT seq, time, "user", source AS computer, dest AS process, 'Start' AS action, source AS src, dest AS resolved FROM e"""
ORACLES["read_labels"] = f"""WITH {E}, {LABELS} SELECT * FROM labels_"""
ORACLES["parse_quality"] = f"""WITH {E}, {_LINES} SELECT count(*) AS events, count(*) FILTER (try_cast(c[1] AS BIGINT) IS NULL) AS bad_lines, count(*) FILTER (c[9] <> 'Success' AND try_cast(c[1] AS BIGINT) IS NOT NULL) AS signal_events FROM pf"""
ORACLES["flatten_records"] = f"""WITH {E} SELECT seq, source AS edge_source, dest AS edge_to_dest, k AS edge_to_k FROM e"""
ORACLES["time_range_extract"] = f"""WITH {E} SELECT time, seq, source, "user", dest FROM e WHERE time BETWEEN 20000 AND 90000"""
ORACLES["substring_probe"] = f"""WITH {E}, {_LINES} SELECT count(*) AS n, min(seq) AS first_seq, (SELECT string_agg(value, '|' ORDER BY seq) FROM (SELECT * FROM ln WHERE contains(value, ',C1,D1') ORDER BY seq LIMIT 5)) AS examples FROM ln WHERE contains(value, ',C1,D1')"""
ORACLES["read_text_lines"] = f"""WITH {E}, {_LINES} SELECT value, count(*) AS n FROM ln GROUP BY value"""
ORACLES["read_json_records"] = f"""WITH {E} SELECT seq, source, dest FROM e WHERE k % 23 <> 0"""


def _merged(radius: int, reach: int = 0, name: str = "mi") -> str:
    return f"""{name}_a AS (SELECT time - {radius} AS s, time + {radius} AS t FROM labels_),
{name}_b AS (SELECT *, coalesce(s > max(t) OVER (ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {reach}, true) AS fresh FROM {name}_a),
{name}_c AS (SELECT *, sum(fresh::INT) OVER (ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS g FROM {name}_b),
{name} AS (SELECT min(s) AS start, max(t) AS "end" FROM {name}_c GROUP BY g)"""


_L = f"WITH {E}, {LABELS}"
ORACLES["interval_merge"] = f"""{_L}, {_merged(60)} SELECT * FROM mi"""
ORACLES["interval_merge_adjacent"] = f"""{_L}, {_merged(60, 1)} SELECT * FROM mi"""
ORACLES["sparse_window_filter"] = f"""{_L} SELECT time, seq, source, "user", dest FROM e WHERE EXISTS (SELECT 1 FROM labels_ AS l WHERE abs(l.time - e.time) <= 60)"""
ORACLES["range_gate"] = f"""{_L} SELECT time, seq, source, "user", dest FROM e WHERE time BETWEEN (SELECT min(time) FROM labels_) - 5 AND (SELECT max(time) FROM labels_) + 5"""
ORACLES["observed_range"] = f"""WITH {E} SELECT min(time) AS lo, max(time) AS hi FROM e"""
ORACLES["candidate_cap"] = f"""{_L} SELECT time, seq, source, "user", dest FROM e WHERE EXISTS (SELECT 1 FROM labels_ AS l WHERE abs(l.time - e.time) <= 60) ORDER BY time, seq LIMIT 500"""
ORACLES["warmup_cut"] = f"""WITH {E} SELECT time, seq FROM e QUALIFY row_number() OVER (ORDER BY time, seq) >= {WARM}"""
_PROFILE = "pr AS (SELECT time // 60 * 60 AS bucket_start, count(*) AS line_count FROM e GROUP BY ALL)"
ORACLES["time_profile"] = f"""WITH {E}, {_PROFILE} SELECT bucket_start, line_count, bucket_start + 60 AS bucket_end, 60::BIGINT AS bucket_size FROM pr"""
ORACLES["profile_summary"] = f"""WITH {E}, {_PROFILE} SELECT count(*) AS n_buckets, min(line_count) AS min_count, max(line_count) AS max_count, round(avg(line_count), 6) AS mean_count, median(line_count) AS median_count, count(*) FILTER (line_count > 0) AS nonempty FROM pr"""
ORACLES["exclusion_zones"] = f"""{_L} SELECT greatest(time - 300, 0) AS start, time + 300 AS "end" FROM labels_"""
_CAND = f"""cw AS (SELECT unnest(range(lo, hi - 120 + 1, 60)) AS start FROM (SELECT min(time) AS lo, max(time) AS hi FROM e)),
ca AS (SELECT start, start + 120 AS "end" FROM cw)"""
_CLEAN = f"""{_merged(60)}, cl AS (SELECT * FROM ca WHERE NOT EXISTS (SELECT 1 FROM mi WHERE ca.start < mi."end" AND ca."end" > mi.start))"""
_DENSE = f"""dn AS (SELECT cl.*, (SELECT count(*) FROM e WHERE time >= cl.start AND time < cl."end") AS line_count FROM cl),
bd AS (SELECT *, CASE WHEN (start + "end") / 2 < lo + (hi - lo) / 3 THEN 'early' WHEN (start + "end") / 2 < lo + 2 * ((hi - lo) / 3) THEN 'middle' ELSE 'late' END AS band FROM dn, (SELECT min(time) AS lo, max(time) AS hi FROM e)),
de AS (SELECT start, "end", line_count, band, row_number() OVER (PARTITION BY band ORDER BY line_count DESC, start) AS density_rank, cume_dist() OVER (PARTITION BY band ORDER BY line_count) AS density_percentile FROM bd)"""
ORACLES["candidate_windows"] = f"""WITH {E}, {_CAND} SELECT * FROM ca"""
ORACLES["windows_without_labels"] = f"""{_L}, {_CAND}, {_CLEAN} SELECT * FROM cl"""
ORACLES["nearest_label_distance"] = f"""{_L}, {_CAND} SELECT start, "end", min(CASE WHEN l.time >= start AND l.time < "end" THEN 0 WHEN l.time < start THEN start - l.time ELSE l.time - "end" END) AS distance FROM ca, labels_ AS l GROUP BY ALL"""
ORACLES["exact_window_counts"] = f"""WITH {E}, {_CAND} SELECT ca.*, (SELECT count(*) FROM e WHERE time >= ca.start AND time < ca."end") AS n_events FROM ca"""
ORACLES["prorated_window_counts"] = f"""WITH {E}, {_CAND}, {_PROFILE} SELECT start, "end", coalesce(sum(round_even(line_count * (least("end", bucket_start + 60) - greatest(start, bucket_start)) / 60, 0)), 0)::BIGINT AS line_count, count(line_count) AS bucket_count FROM ca LEFT JOIN pr ON bucket_start < "end" AND bucket_start + 60 > start GROUP BY ALL"""
ORACLES["band_density"] = f"""{_L}, {_CAND}, {_CLEAN}, {_DENSE} SELECT start, "end", line_count, band, density_rank::INT AS density_rank, round(density_percentile, 6) AS density_percentile FROM de"""
ORACLES["simple_window_select"] = f"""{_L}, {_CAND}, {_CLEAN}, {_DENSE} SELECT start, "end", line_count FROM de WHERE line_count BETWEEN 2 AND 1000000 ORDER BY start LIMIT 20"""
ORACLES["chosen_window_events"] = f"""{_L}, {_CAND}, {_CLEAN}, {_DENSE}, sw AS (SELECT start, "end" FROM (SELECT * FROM de WHERE line_count BETWEEN 2 AND 1000000 ORDER BY start LIMIT 20) WHERE start % 120 = 0) SELECT sw.start, count(*) AS n, min(time) AS first_seen, max(time) AS last_seen FROM e JOIN sw ON time >= sw.start AND time < sw."end" GROUP BY ALL"""
ORACLES["window_extraction"] = f"""{_L}, {_merged(30)} SELECT mi.start, count(*) AS n, min(time) AS first_seen, max(time) AS last_seen FROM e JOIN mi ON time >= mi.start AND time <= mi."end" GROUP BY ALL"""
ORACLES["extract_reconcile"] = f"""WITH {E}, {_CAND}, {_PROFILE}, x AS (SELECT ca.*, (SELECT count(*) FROM e WHERE time >= ca.start AND time < ca."end") AS n FROM ca), y AS (SELECT start, coalesce(sum(round_even(line_count * (least("end", bucket_start + 60) - greatest(start, bucket_start)) / 60, 0)), 0)::BIGINT AS c FROM ca LEFT JOIN pr ON bucket_start < "end" AND bucket_start + 60 > start GROUP BY ALL)
SELECT start, n - c AS delta FROM x JOIN y USING (start)"""
ORACLES["event_signals"] = f"""{EVENT_CHAIN} SELECT time, seq, source, "user", dest, array_to_string(signals, ';') AS signals, hits::BIGINT AS hits, round(risk, 6) AS risk FROM s"""
ORACLES["first_seen_edges"] = f"""WITH {E} SELECT source, dest, time, seq FROM e QUALIFY row_number() OVER (PARTITION BY source, dest ORDER BY time, seq) = 1"""
_RUN = """x AS (SELECT *, (row_number() OVER (PARTITION BY source, {c} ORDER BY time, seq) = 1)::INT AS f FROM e), y AS (SELECT *, coalesce(sum(f) OVER (PARTITION BY source ORDER BY time, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_before FROM x)"""
ORACLES["source_user_fanout"] = f"""WITH {E}, {_RUN.format(c='"user"')} SELECT time, seq, n_before FROM y WHERE n_before >= 3"""
ORACLES["numbered_fanout"] = f"""WITH {E}, {_RUN.format(c="dest")} SELECT seq, 'source_fanout_' || n_before AS signal FROM y WHERE n_before >= 5"""
ORACLES["sliding_velocity"] = f"""{EVENT_CHAIN}, x AS (SELECT a.seq, count(DISTINCT b.dest) AS n_recent FROM s AS a JOIN s AS b ON a.source = b.source AND a."user" = b."user" AND b.time >= a.time - 120 AND b.nth <= a.nth GROUP BY ALL) SELECT seq, n_recent, CASE WHEN n_recent >= 3 THEN 0.22 ELSE 0 END::DOUBLE AS score FROM x"""
_BURST = """SELECT a.seq, a.source AS {name}, count(*) AS n_recent FROM e AS a JOIN e AS b ON a.source = b.source AND b.event_type = a.event_type AND b.time >= a.time - {sec} AND (b.time < a.time OR b.time = a.time AND b.seq <= a.seq) WHERE a.event_type = '{kind}' GROUP BY ALL HAVING count(*) >= {n}"""
ORACLES["dns_flood"] = f"WITH {E} " + _BURST.format(name="src", sec=60, kind="signup", n=2)
ORACLES["process_burst"] = f"WITH {E} " + _BURST.format(name="computer", sec=300, kind="view", n=4)
_PORTS = "(4444, 5555, 6666, 7777, 8888, 9999, 1337, 31337)"
_FLOW = f"""fl AS (SELECT time, seq, unnest([source, dest]) AS host, list_filter([CASE WHEN 4440 + k % 10 IN {_PORTS} THEN 'suspicious_port' END, CASE WHEN floor(value * 100000) >= 10000000 THEN 'large_flow' END], lambda x: x IS NOT NULL) AS signals, CASE WHEN 4440 + k % 10 IN {_PORTS} THEN 0.75 ELSE 0.3 END::DOUBLE AS risk FROM e WHERE event_type = 'click' AND (4440 + k % 10 IN {_PORTS} OR floor(value * 100000) >= 10000000))"""
_LOGIN = """lo AS (SELECT time, seq, unnest([source, dest]) AS host, [CASE WHEN event_type = 'error' THEN 'failed_auth' ELSE 'auth_lateral' END] AS signals, CASE WHEN event_type = 'error' THEN 0.55 ELSE 0.22 END::DOUBLE AS risk FROM e WHERE event_type = 'error' OR source <> dest)"""
ORACLES["flow_signals"] = f"""WITH {E}, {_FLOW} SELECT seq, host, array_to_string(signals, ';') AS signals, risk FROM fl"""
ORACLES["login_signals"] = f"""WITH {E}, {_LOGIN} SELECT seq, host, array_to_string(signals, ';') AS signals, risk FROM lo"""
ORACLES["action_entropy"] = f"""WITH {E}, x AS (SELECT "user", event_type, count(*) AS n FROM e GROUP BY ALL), y AS (SELECT *, n / sum(n) OVER (PARTITION BY "user") AS p FROM x) SELECT "user", round(CASE WHEN count(*) > 1 THEN sum(-p * log2(p)) / log2(count(*)) ELSE 0 END, 6) AS entropy FROM y GROUP BY ALL"""
_RAW = f"WITH {E}, {LABELS}, {SIGNALS}, {EPISODES}"
ORACLES["episode_sessions"] = f"""{_RAW} SELECT seq, source, "user", session::BIGINT AS session FROM m"""
ORACLES["next_ticks"] = f"""WITH {E}, t AS (SELECT DISTINCT time FROM e) SELECT a.time, b.time AS pop FROM t AS a ASOF LEFT JOIN t AS b ON a.time + 600 <= b.time"""
ORACLES["episodes_ranked"] = f"""{CHAIN} SELECT episode_key, round(score, 6) AS score, candidate_gate FROM f WHERE suppression_reason IS NULL ORDER BY round(score, 9) DESC, round(raw_score, 9) DESC, vs DESC, episode_key LIMIT 1000"""
ORACLES["episodes_suppressed"] = f"""{CHAIN} SELECT episode_key, suppression_reason, round(score, 6) AS score FROM f WHERE suppression_reason IS NOT NULL"""
ORACLES["episode_counters"] = f"""{CHAIN} SELECT 'gate' AS kind, candidate_gate AS name, count(*) AS n FROM f GROUP BY ALL UNION ALL SELECT 'reason', coalesce(suppression_reason, 'accepted'), count(*) FROM f GROUP BY ALL UNION ALL SELECT 'signal', s, count(*) FROM (SELECT unnest(signals) AS s FROM f) GROUP BY ALL"""
ORACLES["episode_numbers"] = f"""{_RAW} SELECT row_number() OVER (ORDER BY start_time, start_seq) AS episode_id, episode_key FROM r"""
for _p in PRESETS.values():
    ORACLES[f"preset_{_p.name}"] = f"""{_RAW}, {shaped(_p)} SELECT episode_key, candidate_gate, suppression_reason, round(score, 6) AS score, array_to_string(signals, ';') AS signals FROM f_{_p.name}"""
ORACLES["threshold_sweep"] = f"""{_RAW}, {", ".join(shaped(p) for p in PRESETS.values())}, x AS ({" UNION ALL ".join(f"SELECT preset, candidate_gate, suppression_reason FROM f_{p}" for p in PRESETS)}) SELECT preset, candidate_gate, count(*) AS n, count(*) FILTER (suppression_reason IS NULL) AS accepted FROM x GROUP BY ALL"""
_HOSTS = f"""{_FLOW}, {_LOGIN}, pb AS ({_BURST.format(name="host", sec=300, kind="view", n=4)}), df AS ({_BURST.format(name="host", sec=60, kind="signup", n=2)}),
hs AS (SELECT 0 AS sr, time, seq, host, signals, risk FROM fl UNION ALL SELECT 1, time, seq, host, signals, risk FROM lo UNION ALL SELECT 2, time, e.seq, host, ['process_burst'], 0.45 FROM pb JOIN e USING (seq) UNION ALL SELECT 3, time, e.seq, host, ['dns_flood'], 0.35 FROM df JOIN e USING (seq)),
hb AS (SELECT host, time // 300 AS bucket, min(time) AS start_time, max(time) AS end_time, count(*) AS events_count, max(risk) AS max_risk, list_sort(list_distinct(flatten(list(signals)))) AS sg, arg_min(seq, (sr, time, seq)) AS first_example FROM hs GROUP BY ALL),
hw AS (SELECT *, round(100 * max_risk + list_sum(list_transform(sg, lambda x: CASE x WHEN 'suspicious_port' THEN 80 WHEN 'process_burst' THEN 45 WHEN 'failed_auth' THEN 45 WHEN 'auth_lateral' THEN 25 WHEN 'dns_flood' THEN 30 WHEN 'large_flow' THEN 15 ELSE 5 END)) + least(30, events_count // 10), 3) AS score,
  list_contains(sg, 'suspicious_port') AND (list_contains(sg, 'process_burst') OR list_contains(sg, 'failed_auth') OR list_contains(sg, 'auth_lateral')) AS joint FROM hb),
he AS (SELECT *, CASE WHEN joint THEN 1 WHEN list_contains(sg, 'failed_auth') AND (list_contains(sg, 'process_burst') OR list_contains(sg, 'dns_flood')) THEN 2 WHEN list_contains(sg, 'dns_flood') AND (list_contains(sg, 'process_burst') OR list_contains(sg, 'auth_lateral')) THEN 3 ELSE 4 END AS tier, CASE WHEN joint OR max_risk >= 0.75 OR score >= 140 THEN 'human_review' WHEN max_risk >= 0.45 OR score >= 90 THEN 'collect_evidence' ELSE 'watch' END AS action FROM hw)"""
ORACLES["host_episodes"] = f"""WITH {E}, {_HOSTS} SELECT host, bucket, start_time, end_time, events_count, round(max_risk, 6) AS max_risk, array_to_string(sg, ';') AS signals, round(score, 6) AS score, tier, action, first_example FROM he"""
ORACLES["host_episodes_kept"] = f"""WITH {E}, {_HOSTS} SELECT host, bucket, tier, round(score, 6) AS score FROM he WHERE len(sg) >= 2 OR max_risk >= 0.45"""
#: Matches of labels and episodes of f.
MATCHES = """ed AS (SELECT source, "user", session, list(DISTINCT dest) AS dests FROM m GROUP BY ALL),
mm AS (SELECT l.redteam_index, l.time AS lt, l."user" AS lu, l.dest AS ld, f.*, l.time - start_time AS delta_start, l.time - end_time AS delta_end, l.time = start_time AS exact_start FROM f JOIN ed USING (source, "user", session) JOIN labels_ AS l ON l.source = f.source AND list_contains(dests, l.dest) AND l.time BETWEEN start_time - 600 AND end_time + 600)"""
_M = f"{CHAIN}, {MATCHES}"
ORACLES["label_matches"] = f"""{_M} SELECT redteam_index AS label_redteam_index, episode_key, delta_start, delta_end, exact_start FROM mm"""
ORACLES["host_label_matches"] = f"""WITH {E}, {LABELS}, {_HOSTS} SELECT redteam_index, host, bucket FROM he JOIN labels_ AS l ON (l.source = host OR l.dest = host) AND start_time <= l.time + 60 AND end_time >= l.time - 60"""
ORACLES["host_start_matches"] = f"""WITH {E}, {LABELS}, {_HOSTS} SELECT count(DISTINCT l.time) AS matched_times, count(DISTINCT host) AS matched_hosts FROM he JOIN labels_ AS l ON (l.source = host OR l.dest = host) AND abs(start_time - l.time) <= 60"""
ORACLES["edge_match_summary"] = f"""{_M}, x AS (SELECT count(DISTINCT (lt, source, ld)) AS matched_labels, count(DISTINCT episode_key) AS matched_episodes FROM mm WHERE least(abs(delta_start), abs(delta_end)) <= 60), y AS (SELECT x.*, (SELECT count(*) FROM f) AS episodes, (SELECT count(*) FROM labels_) AS labels FROM x), z AS (SELECT *, matched_episodes / episodes AS a, matched_labels / labels AS b FROM y)
SELECT matched_labels, matched_episodes, episodes, labels, round(a, 6) AS overlap_rate, round(b, 6) AS recall, round(2 * a * b / (a + b), 6) AS harmonic FROM z"""
ORACLES["validation_summary"] = f"""{_M}, x AS (SELECT count(DISTINCT (lt, lu, source, ld)) AS matched_labels, count(DISTINCT episode_key) AS matched_episodes, count(*) FILTER (exact_start) AS exact_starts FROM mm), y AS (SELECT x.*, (SELECT count(*) FROM f) AS episodes, (SELECT count(DISTINCT (time, "user", source, dest)) FROM labels_) AS labels FROM x)
SELECT matched_labels, matched_episodes, exact_starts, labels, labels AS labels_observed, episodes, round(matched_labels / labels, 6) AS recall_all, round(matched_labels / labels, 6) AS recall_observed, round(matched_episodes / episodes, 6) AS overlap_rate FROM y"""
ORACLES["match_gate_counts"] = f"""{_M} SELECT candidate_gate, count(*) AS matches, count(*) FILTER (exact_start) AS exact, count(DISTINCT episode_key) AS episodes FROM mm GROUP BY ALL"""
ORACLES["suppressed_near_matches"] = f"""{_M} SELECT redteam_index AS label_redteam_index, episode_key, suppression_reason FROM mm WHERE suppression_reason IS NOT NULL ORDER BY redteam_index, start_time, episode_key LIMIT 500"""
ORACLES["scored_alignment"] = f"""{_L}, x AS (SELECT l.redteam_index, e.time, e.seq, abs(e.time - l.time) AS dt, 3 * (e.source = l.source)::INT + 3 * (e.dest = l.dest)::INT + 2 * (e."user" = l."user")::INT + CASE WHEN e.time = l.time THEN 3 WHEN abs(e.time - l.time) <= 10 THEN 2 ELSE 1 END AS score FROM labels_ AS l JOIN e ON abs(e.time - l.time) <= 300)
SELECT redteam_index, time, seq, score, dt, CASE WHEN score >= 7 THEN 'strong' WHEN score >= 4 THEN 'medium' ELSE 'weak' END AS strength FROM x QUALIFY row_number() OVER (PARTITION BY redteam_index ORDER BY score DESC, time, seq) = 1"""
ORACLES["run_comparison"] = f"""{_RAW}, {shaped(PRESETS["recall"])}, {shaped(PRESETS["pruned"])}, ed AS (SELECT source, "user", session, list(DISTINCT dest) AS dests FROM m GROUP BY ALL),
rn AS (SELECT DISTINCT q.preset, l.time AS label_time, l."user" AS label_user, l.source, l.dest AS label_dest FROM (SELECT preset, source, "user", session, start_time, end_time FROM f_recall WHERE suppression_reason IS NULL UNION ALL SELECT preset, source, "user", session, start_time, end_time FROM f_pruned WHERE suppression_reason IS NULL) AS q JOIN ed USING (source, "user", session) JOIN labels_ AS l ON l.source = q.source AND list_contains(dests, l.dest) AND l.time BETWEEN start_time - 600 AND end_time + 600)
SELECT label_time, label_user, source, label_dest, CASE WHEN count(*) = 2 THEN 'both' WHEN min(preset) = 'recall' THEN 'lost' ELSE 'new' END AS status FROM rn GROUP BY ALL"""
_MAPS = f"""{_M}, mp AS (SELECT episode_key, list_sort(list(DISTINCT redteam_index)) AS ids, count(*) FILTER (exact_start) AS exact_count FROM mm GROUP BY ALL)"""
ORACLES["episode_label_maps"] = f"""{_MAPS} SELECT episode_key, array_to_string(ids, '+') AS label_ids, exact_count FROM mp"""
ORACLES["label_components"] = f"""{_MAPS.replace("WITH e AS", "WITH RECURSIVE e AS", 1)}, lk AS (SELECT DISTINCT a.l AS a, b.l AS b FROM (SELECT episode_key, unnest(ids) AS l FROM mp) AS a JOIN (SELECT episode_key, unnest(ids) AS l FROM mp) AS b USING (episode_key)),
rc AS (SELECT a AS root, a AS node FROM lk UNION SELECT rc.root, lk.b FROM rc JOIN lk ON rc.node = lk.a), cm AS (SELECT node, min(root) AS c FROM rc GROUP BY ALL), nm AS (SELECT c, 'rtgrp:' || string_agg(node::VARCHAR, '+' ORDER BY node) AS group_id FROM cm GROUP BY c)
SELECT episode_key, group_id FROM mp JOIN cm ON cm.node = ids[1] JOIN nm USING (c)"""
ORACLES["label_own_groups"] = f"""{_MAPS} SELECT episode_key, 'rtgrp:' || array_to_string(ids, '+') AS group_id FROM mp"""
ORACLES["annotated_episodes"] = f"""{_MAPS} SELECT f.episode_key, coalesce(len(ids), 0)::BIGINT AS redteam_count, coalesce(exact_count, 0)::BIGINT AS exact_count FROM f LEFT JOIN mp USING (episode_key)"""

_FR = f"""fr AS (SELECT f.episode_key, source, "user", start_time, end_time, dur::DOUBLE AS duration, events_count::DOUBLE AS events_count, destination_count::DOUBLE AS destination_count, 1.0::DOUBLE AS user_count, first_time_event_count::DOUBLE AS first_time_event_count,
  CASE WHEN first_time_signal_hits = 0 THEN ft ELSE first_time_signal_hits END::DOUBLE AS first_time_signal_hits, destination_count::DOUBLE AS new_destination_event_count, CASE WHEN nov = 0 THEN least(1.0, destination_count / greatest(1, events_count)) ELSE nov END::DOUBLE AS novelty_ratio, cs::DOUBLE AS compactness_score, vs::DOUBLE AS fanout_velocity_score, peak::DOUBLE AS peak_velocity_new_dests,
  score, raw_score, entropy_penalty, candidate_gate, suppression_reason, signals, {", ".join(f"list_contains(signals, '{t}')::INT::DOUBLE AS sig__{t}" for t in TAGS)}, ids, coalesce(exact_count, 0) AS exact_count, (ids IS NOT NULL)::INT AS label, row_number() OVER (ORDER BY round(score, 9) DESC, f.episode_key) AS rank FROM f LEFT JOIN mp USING (episode_key)),
fs AS (SELECT *, novelty_ratio + compactness_score + fanout_velocity_score + 0.25 * sig__first_time_source_user_to_dest + 0.15 * sig__source_user_fanout - entropy_penalty AS feature_sum FROM fr)"""
_F = f"{_MAPS}, {_FR}"
_QS = "qs AS (SELECT fs.*, q.k AS queue_size FROM fs JOIN (VALUES (100), (500), (1000), (5000)) AS q(k) ON rank <= q.k)"
_Q = f"{_F}, {_QS}"
_SEV = "CASE WHEN score >= 0.90 THEN 'critical' WHEN score >= 0.75 THEN 'high' WHEN score >= 0.50 THEN 'medium' WHEN score >= 0.25 THEN 'low' ELSE 'low_review' END"
_PRI = "CASE WHEN rank <= 100 THEN 'P1' WHEN rank <= 500 THEN 'P2' WHEN rank <= 1000 THEN 'P3' WHEN rank <= 5000 THEN 'P4' ELSE 'P5' END"
_BAND = "CASE WHEN score >= 0.95 THEN '>=0.95' WHEN score >= 0.90 THEN '0.90-0.95' WHEN score >= 0.75 THEN '0.75-0.90' WHEN score >= 0.50 THEN '0.50-0.75' WHEN score >= 0.25 THEN '0.25-0.50' ELSE '<0.25' END"
ORACLES["feature_table_rows"] = f"""{_F} SELECT episode_key, {", ".join(f"round({c}, 6) AS {c}" for c in NUMERIC)}, {", ".join(f"sig__{t}" for t in TAGS)}, label, round(feature_sum, 6) AS feature_sum FROM fs"""
ORACLES["negative_sample_first"] = f"""{_F} SELECT episode_key FROM fs WHERE label = 0 ORDER BY start_time, episode_key LIMIT 500"""
ORACLES["split_by_time"] = f"""{_F} SELECT episode_key, CASE WHEN row_number() OVER (ORDER BY start_time, episode_key) <= floor(0.7 * (SELECT count(*) FROM fs)) THEN 'train' ELSE 'test' END AS part FROM fs"""
ORACLES["ranker_auc_ap"] = f"""{_F}, lr AS (UNPIVOT (SELECT episode_key, label, round(score, 9) AS score, round(raw_score, 9) AS raw_score, round(feature_sum, 9) AS feature_sum, round(novelty_ratio, 9) AS novelty_ratio, round(fanout_velocity_score, 9) AS fanout_velocity_score FROM fs) ON score, raw_score, feature_sum, novelty_ratio, fanout_velocity_score INTO NAME ranker VALUE s),
ag AS (SELECT ranker, s, sum(label) AS p, sum(1 - label) AS n FROM lr GROUP BY ALL), ac AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM ag WINDOW w AS (PARTITION BY ranker ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
SELECT ranker, round(sum(n * (cp - p / 2)) / (sum(p) * sum(n)), 6) AS auc, round(sum(p * cp / (cp + cn)) / sum(p), 6) AS ap FROM ac GROUP BY ranker"""
ORACLES["top_k_metrics"] = f"""{_F}, kk AS (SELECT fs.*, k FROM fs JOIN (VALUES (20), (50), (100), (500), (1000)) AS q(k) ON rank <= k), kl AS (SELECT k, count(DISTINCT l) AS labels FROM (SELECT k, unnest(ids) AS l FROM kk) GROUP BY k)
SELECT k, count(*) FILTER (label = 1) AS hits, round(count(*) FILTER (label = 1) / count(*), 6) AS precision, coalesce(any_value(labels), 0) AS labels, round(coalesce(any_value(labels), 0) / (SELECT count(DISTINCT l) FROM (SELECT unnest(ids) AS l FROM fs)), 6) AS label_recall, sum(exact_count)::BIGINT AS exact_starts, count(DISTINCT source) AS sources, count(DISTINCT "user") AS users FROM kk LEFT JOIN kl USING (k) GROUP BY k"""
ORACLES["research_queue"] = f"""{_F} SELECT rank, episode_key, {_SEV} AS severity, coalesce(len(ids), 0)::BIGINT AS redteam_count, exact_count FROM fs"""
ORACLES["deployment_queue"] = f"""{_F} SELECT rank, round(score, 6) AS score, {_SEV} AS severity, {_PRI} AS priority, episode_key, source, "user", start_time, end_time, duration::BIGINT AS duration, events_count::BIGINT AS events_count, destination_count::BIGINT AS destination_count, candidate_gate,
  concat_ws('; ', CASE WHEN sig__first_time_source_user_to_dest = 1 THEN 'new source-user-destination' END, CASE WHEN sig__source_user_fanout = 1 THEN 'source-user fan-out' END, CASE WHEN sig__compact_lateral_burst = 1 THEN 'compact burst' END, CASE WHEN sig__fanout_velocity = 1 THEN 'fast fan-out' END, destination_count::BIGINT || ' destinations in ' || duration::BIGINT || ' s') AS explanation FROM fs"""
ORACLES["sized_queues"] = f"""{_Q} SELECT queue_size, rank, episode_key FROM qs"""
TIES = f"""{_F}, ta AS (SELECT fs.*, row_number() OVER (ORDER BY round(fs.score, 9) DESC, round(nov, 9) DESC, f.first_time_signal_hits DESC, f.destination_count DESC, round(vs, 9) DESC, peak DESC, round(cs, 9) DESC, dur, f.events_count DESC, rank) AS new_rank FROM fs JOIN f USING (episode_key))"""
ORACLES["tie_audit"] = f"""{TIES} SELECT episode_key, rank, new_rank, rank - new_rank AS rank_delta FROM ta"""
ORACLES["source_concentration"] = f"""{_Q}, sc AS (SELECT queue_size, source AS value, count(*) AS n FROM qs GROUP BY ALL), sp AS (SELECT queue_size, value, row_number() OVER w AS place, n, round(n / sum(n) OVER (PARTITION BY queue_size), 6) AS share, round(sum(n) OVER w / sum(n) OVER (PARTITION BY queue_size), 6) AS cumulative_share FROM sc WINDOW w AS (PARTITION BY queue_size ORDER BY n DESC, value ROWS UNBOUNDED PRECEDING)) SELECT * FROM sp WHERE place <= 50"""
ORACLES["severity_distribution"] = f"""{_Q}, sv AS ({" UNION ALL ".join(f"SELECT '{n}' AS field, queue_size, {c} AS value FROM qs" for n, c in (("severity", _SEV), ("priority", _PRI), ("gate", "candidate_gate"), ("band", _BAND)))}), sn AS (SELECT field, queue_size, value, count(*) AS n FROM sv GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY field, queue_size), 6) AS share FROM sn"""
ORACLES["metric_distribution"] = f"""{_Q}, md AS (SELECT queue_size, duration::BIGINT AS v, row_number() OVER (PARTITION BY queue_size ORDER BY duration) - 1 AS i, count(*) OVER (PARTITION BY queue_size) AS n FROM qs)
SELECT queue_size, min(v) AS min, max(v) FILTER (i = round_even((n - 1) * 0.25, 0)) AS p25, max(v) FILTER (i = round_even((n - 1) * 0.5, 0)) AS p50, max(v) FILTER (i = round_even((n - 1) * 0.75, 0)) AS p75, round(avg(v), 6) AS mean, max(v) AS max FROM md GROUP BY ALL"""
ORACLES["queue_summary"] = f"""{_Q}, sc AS (SELECT queue_size, source, count(*) AS n FROM qs GROUP BY ALL), sp AS (SELECT queue_size, n / sum(n) OVER (PARTITION BY queue_size) AS share, row_number() OVER (PARTITION BY queue_size ORDER BY n DESC, source) AS place FROM sc),
tp AS (SELECT queue_size, max(share) FILTER (place = 1) AS a, sum(share) FILTER (place <= 5) AS b, sum(share) FILTER (place <= 10) AS c FROM sp GROUP BY ALL)
SELECT queue_size, count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT "user") AS users, round(count(*) FILTER (source = 'C1') / count(*), 6) AS focus_share, round(median(score), 6) AS median_score, round(median(duration), 6) AS median_duration, round(any_value(a), 6) AS top1_share, round(any_value(b), 6) AS top5_share, round(any_value(c), 6) AS top10_share FROM qs JOIN tp USING (queue_size) GROUP BY ALL"""
ORACLES["source_capped_queue"] = f"""{_F}, cp AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank) AS own FROM fs) SELECT row_number() OVER (ORDER BY rank) AS new_rank, rank, episode_key FROM cp WHERE own <= 5 ORDER BY rank LIMIT 60"""
ORACLES["source_clusters"] = f"""{_Q}, tg AS (SELECT queue_size, source, candidate_gate || ':' || count(*) AS top_gate FROM qs GROUP BY queue_size, source, candidate_gate QUALIFY row_number() OVER (PARTITION BY queue_size, source ORDER BY count(*) DESC, candidate_gate) = 1),
tu AS (SELECT queue_size, source, string_agg(t, ';' ORDER BY i) AS top_users FROM (SELECT queue_size, source, "user" || ':' || count(*) AS t, row_number() OVER (PARTITION BY queue_size, source ORDER BY count(*) DESC, "user") AS i FROM qs GROUP BY queue_size, source, "user") WHERE i <= 3 GROUP BY ALL)
SELECT queue_size, source, count(*) AS n, min(rank) AS best_rank, max(rank) AS worst_rank, round(max(score), 6) AS max_score, round(median(score), 6) AS median_score, round(min(score), 6) AS min_score, min(start_time) AS first_start, max(end_time) AS last_end, count(DISTINCT "user") AS users, median(destination_count) AS median_destinations, any_value(top_gate) AS top_gate, any_value(top_users) AS top_users FROM qs JOIN tg USING (queue_size, source) JOIN tu USING (queue_size, source) GROUP BY ALL"""
ORACLES["cluster_representatives"] = f"""{_Q} SELECT queue_size, source, row_number() OVER (PARTITION BY queue_size, source ORDER BY rank) AS place, episode_key FROM qs QUALIFY place <= 5"""
ORACLES["annotation_diagnostic"] = f"""{_Q}, an AS (SELECT queue_size, coalesce(sum(len(ids)), 0)::BIGINT AS row_labels FROM qs GROUP BY ALL), al AS (SELECT queue_size, count(DISTINCT l) AS labels FROM (SELECT queue_size, unnest(ids) AS l FROM qs) GROUP BY ALL), ax AS (SELECT queue_size, row_labels, coalesce(labels, 0) AS labels FROM an LEFT JOIN al USING (queue_size))
SELECT *, row_labels - labels AS duplicates, round(coalesce((row_labels - labels) / nullif(row_labels, 0), 0), 6) AS duplicate_ratio, round(labels / max(labels) OVER (), 6) AS official_recall FROM ax"""
ORACLES["scope_summary"] = f"""{_F}, sb AS (SELECT (start_time // 20000)::VARCHAR AS scope, source, score FROM fs UNION ALL SELECT 'all', source, score FROM fs), st AS (SELECT scope, sum(n) AS t FROM (SELECT scope, source, count(*) AS n FROM sb GROUP BY scope, source QUALIFY row_number() OVER (PARTITION BY scope ORDER BY count(*) DESC, source) <= 5) GROUP BY scope)
SELECT scope, count(*) AS n, {", ".join(f"round(quantile_cont(score, {q}), 6) AS p{n}" for n, q in ((0, 0.0), (50, 0.5), (90, 0.9), (95, 0.95), (99, 0.99), (100, 1.0)))}, count(*) FILTER (score >= 0.75) AS high, round(any_value(t) / count(*), 6) AS top5_share FROM sb JOIN st USING (scope) GROUP BY scope"""
ORACLES["round_robin_queue"] = f"""{_F} SELECT episode_key, row_number() OVER (PARTITION BY source ORDER BY rank) AS round FROM fs"""
ORACLES["source_recurrence"] = f"""{_F}, rd AS (SELECT start_time // 20000 AS day, source, count(*) AS n FROM fs GROUP BY start_time // 20000, source QUALIFY row_number() OVER (PARTITION BY start_time // 20000 ORDER BY count(*) DESC, source) <= 10) SELECT source, count(*) AS days, sum(n)::BIGINT AS episodes FROM rd GROUP BY source HAVING count(*) > 1"""
ORACLES["signal_composition"] = f"""{_F} SELECT signal, count(*) AS n, round(count(*) / 500, 6) AS share FROM (SELECT unnest(signals) AS signal FROM fs WHERE rank <= 500) GROUP BY signal"""
_G = f"""{_F}, rg AS (SELECT *, CASE WHEN rank <= 100 THEN 'R2' WHEN rank <= 2000 THEN 'R1' ELSE 'R0' END AS regime FROM fs)"""
ORACLES["score_regimes"] = f"""{_G} SELECT regime, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(median(score), 6) AS median, round(quantile_cont(score, 0.99), 6) AS p99, round(max(score), 6) AS max FROM rg GROUP BY regime"""
ORACLES["phi_matrix"] = f"""{_G} SELECT episode_key, regime, round(coalesce(first_time_signal_hits / nullif(events_count, 0), 0), 6) AS first_time_density, round(coalesce(events_count / nullif(duration, 0), 0), 6) AS temporal_density FROM rg"""
_HIST = "(SELECT min(dur) AS lo, max(dur) AS hi FROM f)"
ORACLES["score_histogram"] = f"""{CHAIN}, hh AS (SELECT least(19, floor((dur - lo) / ((hi - lo) / 20)))::BIGINT AS bin, count(*) AS n FROM f, {_HIST} GROUP BY ALL) SELECT g.bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM f) / ((hi - lo) / 20), 9) AS density FROM (SELECT unnest(range(20)) AS bin) AS g LEFT JOIN hh USING (bin), {_HIST}"""
ORACLES["kl_divergence"] = f"""{_G}, kr AS (SELECT * FROM rg WHERE regime <> 'R1'), kb AS (SELECT regime, least(19, floor((duration - lo) / ((hi - lo) / 20))) AS bin FROM kr, (SELECT min(duration) AS lo, max(duration) AS hi FROM kr)),
kx AS (SELECT g.bin, count(*) FILTER (regime = 'R2') + 1e-12 AS x, count(*) FILTER (regime = 'R0') + 1e-12 AS y FROM (SELECT unnest(range(20)) AS bin) AS g LEFT JOIN kb USING (bin) GROUP BY ALL), ky AS (SELECT x / sum(x) OVER () AS x, y / sum(y) OVER () AS y FROM kx) SELECT round(sum(x * ln(x / y)), 6) AS kl FROM ky"""


def _w1(rows: str, by: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""wv AS (SELECT {by + ',' if by else ''} v, count(*) FILTER (regime = 'R2') AS x, count(*) FILTER (regime = 'R0') AS y FROM {rows} WHERE regime <> 'R1' GROUP BY ALL),
wc AS (SELECT *, abs(sum(x) OVER w / sum(x) OVER ({part}) - sum(y) OVER w / sum(y) OVER ({part})) * (lead(v) OVER ({part} ORDER BY v) - v) AS d FROM wv WINDOW w AS ({part} ORDER BY v ROWS UNBOUNDED PRECEDING))"""


_LONG = f"lf AS (UNPIVOT (SELECT regime, {', '.join(NUMERIC)} FROM rg) ON {', '.join(NUMERIC)} INTO NAME feature VALUE v)"
ORACLES["wasserstein_distance"] = f"""{_G}, wr AS (SELECT regime, duration AS v FROM rg), {_w1("wr", "")} SELECT round(coalesce(sum(d), 0), 6) AS w1 FROM wc"""
ORACLES["wasserstein_features"] = f"""{_G}, {_LONG}, {_w1("lf", "feature")} SELECT feature, round(coalesce(sum(d), 0), 6) AS w1 FROM wc GROUP BY feature"""


def _gradient(of: str, to: str, src: str, out: str) -> str:
    return f"""{out} AS (SELECT *, CASE WHEN lag({of}) OVER w IS NULL THEN lead({of}) OVER w - {of} WHEN lead({of}) OVER w IS NULL THEN {of} - lag({of}) OVER w ELSE (lead({of}) OVER w - lag({of}) OVER w) / 2 END AS {to} FROM {src} WINDOW w AS (ORDER BY rank))"""


ORACLES["score_curvature"] = f"""{_F}, g0 AS (SELECT rank, round(score, 6) AS s FROM fs), {_gradient("s", "a", "g0", "g1")}, {_gradient("a", "b", "g1", "g2")} SELECT round(avg(b), 8) AS mean, round(stddev_pop(b), 8) AS std, round(avg(abs(b)), 8) AS abs_mean, round(max(abs(b)), 8) AS abs_max, round(quantile_cont(abs(b), 0.95), 8) AS abs_p95, round(quantile_cont(abs(b), 0.99), 8) AS abs_p99 FROM g2"""
ORACLES["centroid_distance"] = f"""{_G}, {_LONG}, lm AS (SELECT regime, feature, avg(v) AS m FROM lf GROUP BY ALL) SELECT x.regime AS a, y.regime AS b, round(sqrt(sum((x.m - y.m) ** 2)), 6) AS distance FROM lm AS x JOIN lm AS y ON x.feature = y.feature AND x.regime < y.regime GROUP BY ALL"""
ORACLES["feature_delta"] = f"""{_G}, {_LONG}, ls AS (SELECT feature, avg(v) FILTER (regime = 'R2') AS ma, stddev_samp(v) FILTER (regime = 'R2') AS sa, avg(v) FILTER (regime = 'R0') AS mb, stddev_samp(v) FILTER (regime = 'R0') AS sb FROM lf GROUP BY ALL)
SELECT feature, round(ma, 6) AS mean_a, round(sa, 6) AS std_a, round(mb, 6) AS mean_b, round(sb, 6) AS std_b, round(ma - mb, 6) AS delta, round(coalesce((ma - mb) / nullif(sqrt((sa ** 2 + sb ** 2) / 2), 0), 0), 6) AS standardised FROM ls"""
ORACLES["window_stability"] = f"""{CHAIN}, ws AS (SELECT start_time // 20000 AS day, avg(score) AS m, quantile_cont(score, 0.99) AS p, max(score) AS x FROM f GROUP BY ALL) SELECT count(*) AS windows, round(var_pop(m), 6) AS var_mean, round(var_pop(p), 6) AS var_p99, round(var_pop(x), 6) AS var_max FROM ws"""
ORACLES["gate_by_regime"] = f"""{_G}, gr AS (SELECT regime, candidate_gate AS value, count(*) AS n FROM rg GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY regime), 6) AS share FROM gr"""
ORACLES["background_percentile"] = f"""{_F}, bs AS (SELECT round(score, 9) AS s FROM fs WHERE label = 0) SELECT episode_key, round(100 * (SELECT count(*) FROM bs WHERE s <= round(fs.score, 9)) / (SELECT count(*) FROM bs), 6) AS percentile, 1 + (SELECT count(*) FROM bs WHERE s > round(fs.score, 9)) AS rank_equivalent FROM fs WHERE label = 1"""
ORACLES["threshold_placement"] = f"""{_F}, bt AS (SELECT row_number() OVER (ORDER BY round(score, 9) DESC, episode_key) AS rank, round(score, 9) AS t FROM fs WHERE label = 0) SELECT bt.rank, round(t, 6) AS threshold, count(*) FILTER (round(score, 9) >= t) AS n, round(avg((round(score, 9) >= t)::INT), 6) AS share FROM fs, bt WHERE label = 1 AND bt.rank IN (100, 500, 1000) GROUP BY ALL"""
_RES, _COM = ("destination_count", "duration", "events_count", "sig__source_user_fanout", "sig__entropy_soft_duration"), ("compactness_score", "fanout_velocity_score", "novelty_ratio", "sig__compact_lateral_burst", "sig__fanout_velocity", "sig__propagation_convergence_bonus")
_Z = lambda names: "(" + " + ".join(f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0), 0)" for c in names) + f") / {len(names)}"
_T = f"""{_G}, tz AS (SELECT *, {_Z(_COM)} AS ci, {_Z(_RES)} AS ri FROM rg WHERE regime <> 'R0'), tt AS (SELECT *, CASE WHEN ci - ri > 0.35 THEN 'compact' WHEN ci - ri < -0.35 THEN 'rescue' ELSE 'mixed' END AS subtype, round(score, 9) AS sc FROM tz)"""
ORACLES["tail_strata"] = f"""{_T} SELECT episode_key, round(ci, 6) AS compact_index, round(ri, 6) AS rescue_index, subtype FROM tt"""
ORACLES["subtype_shares"] = f"""{_T}, ts AS (SELECT regime, subtype AS value, count(*) AS n FROM tt GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY regime), 6) AS share FROM ts"""
ORACLES["triage_policies"] = f"""{_T}, r0 AS (SELECT *, row_number() OVER (PARTITION BY subtype ORDER BY sc DESC, episode_key) - 1 AS i, row_number() OVER (PARTITION BY subtype = 'rescue' ORDER BY sc DESC, episode_key) - 1 AS j FROM tt),
pl AS (SELECT 'A' AS policy, label, row_number() OVER (ORDER BY sc DESC, episode_key) AS place FROM r0
UNION ALL SELECT 'B', label, row_number() OVER (ORDER BY CASE subtype WHEN 'compact' THEN 0 WHEN 'mixed' THEN 1 ELSE 2 END, sc DESC, episode_key) FROM r0
UNION ALL SELECT 'C', label, row_number() OVER (ORDER BY i // CASE subtype WHEN 'compact' THEN 7 WHEN 'mixed' THEN 2 ELSE 1 END, CASE subtype WHEN 'compact' THEN i % 7 WHEN 'mixed' THEN 7 + i % 2 ELSE 9 END, sc DESC, episode_key) FROM r0
UNION ALL SELECT 'D', label, row_number() OVER (ORDER BY CASE WHEN subtype = 'compact' THEN 0 WHEN subtype = 'mixed' THEN 1 WHEN ri >= 0.5 THEN 2 ELSE 3 END, sc DESC, episode_key) FROM r0
UNION ALL SELECT 'E', label, row_number() OVER (ORDER BY CASE WHEN subtype = 'rescue' THEN j ELSE j // 2 END, CASE WHEN subtype = 'rescue' THEN 2 ELSE j % 2 END, sc DESC, episode_key) FROM r0)
SELECT policy, depth, coalesce(sum(label) FILTER (place <= depth), 0)::BIGINT AS hits, round(coalesce(sum(label) FILTER (place <= depth), 0) / sum(label), 6) AS recall FROM pl, (VALUES (25), (50), (100), (500), (1000)) AS d(depth) GROUP BY ALL"""
_ACC = """ac AS (SELECT time, seq, "user" AS actor, 'role' || (user_id % 4) AS role, event_type AS action, dest AS resource, (k % 11) / 10 AS criticality FROM e), may AS (SELECT role, action FROM ac GROUP BY role, action QUALIFY count(*) * 20 >= sum(count(*)) OVER (PARTITION BY role)), sco AS (SELECT role, resource FROM ac WHERE role <> 'role0' GROUP BY ALL HAVING count(*) >= 5),
pr AS (SELECT ac.*, role NOT IN (SELECT role FROM may) AS r1, may.role IS NULL AS r2, ac.role <> 'role0' AND sco.role IS NULL AS r3, resource = 'D7' AS r4, action = 'purchase' AS r5 FROM ac LEFT JOIN may USING (role, action) LEFT JOIN sco USING (role, resource))"""
ORACLES["policy_risk"] = f"""WITH {E}, {_ACC} SELECT seq, round(least(1.0, r1::INT * 0.25 + r2::INT * 0.35 + r3::INT * 0.30 + r4::INT * 0.55 + r5::INT * 0.30), 6)::DOUBLE AS semantic_risk, concat_ws(';', CASE WHEN r1 THEN 'role_unknown' END, CASE WHEN r2 THEN 'role_action_mismatch' END, CASE WHEN r3 THEN 'resource_scope_mismatch' END, CASE WHEN r4 THEN 'resource_frozen' END, CASE WHEN r5 THEN 'missing_or_invalid_approval' END) AS reasons FROM pr"""
ORACLES["path_validity"] = f"""WITH {E}, {_ACC} SELECT seq, NOT (r1 OR r2 OR r3 OR r5) AS path_valid FROM pr"""
ORACLES["role_action_novelty"] = f"""WITH {E}, {_ACC} SELECT seq, row_number() OVER (PARTITION BY role, action ORDER BY time, seq) = 1 AS new_role_action FROM ac"""
