"""DuckDB SQL for the queries that SQL can express."""

from .licenses import BASE_PHRASES, CONTEXT, WORD, anchored, rules

ORACLES: dict[str, str] = {}

# A run of more than 200 words that occurs twice is a 201-word window that does.
ORACLES["op5_quality_rules"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, text, doc_id FROM t),
p AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g3 AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(ws[i:i+2], ' ')) AS c FROM p WHERE i + 2 <= len(ws)) WHERE c > 1),
g6 AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(ws[i:i+5], ' ')) AS c FROM p WHERE i + 5 <= len(ws)) WHERE c > 1),
g201 AS (SELECT DISTINCT r FROM (SELECT r, md5(array_to_string(ws[i:i+200], ' ')) AS h FROM p JOIN g6 USING (r, i) WHERE i + 200 <= len(ws)) GROUP BY r, h HAVING count(*) > 1),
c3 AS (SELECT r, count(DISTINCT i + k) AS n FROM g3, range(0, 3) AS x(k) GROUP BY r),
c6 AS (SELECT r, count(DISTINCT i + k) AS n FROM g6, range(0, 6) AS x(k) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines,
  coalesce(c3.n, 0)::BIGINT AS n_repeat_words, coalesce(c6.n, 0)::BIGINT AS covered_words, g201.r IS NOT NULL AS long_repeat
  FROM w LEFT JOIN l USING (r) LEFT JOIN c3 USING (r) LEFT JOIN c6 USING (r) LEFT JOIN g201 USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * covered_words > 50 * n_words OR long_repeat) AS kept, covered_words FROM f
"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_BASE = ", ".join(f"({_quoted(p)}, {_quoted(label)}, {len(p.split())})" for p, label in BASE_PHRASES.items())
_RULES = ", ".join(f"({r.order}, {_quoted(r.label)}, {_quoted(r.first)}, {_quoted(anchored(r))}, {r.score})" for r in rules())
# Every rule at every word, without the keyword gate.
ORACLES["op6_license_scan"] = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, text, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(low, {_quoted(WORD)}) AS ws FROM t),
p AS (SELECT r, ws, unnest(range(len(ws))) AS i FROM w),
b AS (SELECT r, i, x.label FROM p JOIN (VALUES {_BASE}) AS x(phrase, label, k) ON array_to_string(ws[i+1:i+k], ' ') = phrase),
rules AS (SELECT ord, label, unnest(string_split(firsts, ' ')) AS w, pattern, score FROM (VALUES {_RULES}) AS x(ord, label, firsts, pattern, score)),
h AS (SELECT p.r, i, ord, label, score, regexp_extract(array_to_string(ws[i+1:i+{CONTEXT}], ' '), pattern, 1) AS hit FROM p JOIN rules ON ws[i+1] = rules.w),
e AS (SELECT *, i + len(string_split(hit, ' ')) AS stop FROM h WHERE hit <> ''),
k AS (SELECT r, label, score FROM e QUALIFY coalesce(max(stop) OVER (PARTITION BY r ORDER BY i, stop DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < stop),
bb AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY r),
kk AS (SELECT r, max(score) AS score FROM k GROUP BY r),
ll AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM b UNION ALL SELECT r, label FROM k) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(bb.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
  coalesce(bb.labels, '') AS base_labels, coalesce(ll.labels, '') AS labels, CASE WHEN bb.n > 0 THEN 1.0 ELSE coalesce(kk.score, 0) END::DOUBLE AS score
FROM w LEFT JOIN bb USING (r) LEFT JOIN kk USING (r) LEFT JOIN ll USING (r)
"""

# Independent of seeds: every pair of equal tokens, counted along diagonals.
ORACLES["op10_decontamination"] = r"""
WITH dt AS (SELECT r, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM (SELECT *, row_number() OVER () AS r FROM documents)),
bt AS (SELECT item_id, ws, len(ws) AS n FROM (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark) WHERE len(ws) > 0),
d AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM dt),
b AS (SELECT item_id, n, least(n, 13) AS win, least(n, 13) - CASE WHEN n >= 13 THEN 2 WHEN n >= 10 THEN 1 ELSE 0 END AS need, unnest(ws) AS w, unnest(range(n)) AS q FROM bt),
m AS (SELECT r, item_id, p - q AS diag, q, win, need FROM d JOIN b USING (w)),
c AS (SELECT r, item_id, need, win, diag, q FROM m QUALIFY count(*) OVER (PARTITION BY r, item_id, diag) >= need),
s AS (SELECT x.r, x.item_id, x.need, x.diag, x.q, count(*) AS n FROM c AS x JOIN c AS y ON x.r = y.r AND x.item_id = y.item_id AND x.diag = y.diag AND y.q >= x.q AND y.q < x.q + x.win GROUP BY ALL),
h AS (SELECT r, item_id, max(n) AS best FROM s WHERE n >= need GROUP BY ALL),
g AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS item_ids, max(best) AS best FROM h GROUP BY r)
SELECT doc_id, g.r IS NOT NULL AS contaminated, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(item_ids, '') AS item_ids, coalesce(best, 0)::BIGINT AS best_window
FROM dt LEFT JOIN g USING (r)
"""

# Every earlier line is tried: equal, or, from five words on, with one word replaced, added or left out.
ORACLES["op2_line_dedup"] = r"""
WITH l AS (SELECT doc_id, k, string_split(text, chr(10))[k] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents)),
w AS (SELECT doc_id, k, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l),
f AS (SELECT doc_id, k, ws, len(ws) AS n, doc_id * 1000000 + k AS pos, array_to_string(ws, ' ') AS s FROM w WHERE len(ws) > 0),
d AS (SELECT s, any_value(ws) AS ws, any_value(n) AS n, min(pos) AS pos FROM f GROUP BY s),
v AS (SELECT pos, n, i, array_to_string(ws[1:i-1], ' ') || '|' || array_to_string(ws[i+1:], ' ') AS split, array_to_string(ws[1:i-1] || ws[i+1:], ' ') AS rest FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM d WHERE n >= 5)),
a AS (SELECT pos FROM v QUALIFY min(pos) OVER (PARTITION BY split) < pos),
b AS (SELECT v.pos AS longer, d.pos AS shorter FROM v JOIN d ON v.rest = d.s WHERE d.n >= 5),
near AS (SELECT pos FROM a UNION SELECT longer FROM b WHERE shorter < longer UNION SELECT shorter FROM b WHERE longer < shorter),
g AS (SELECT f.doc_id, f.k, f.pos > d.pos AS exact, near.pos IS NOT NULL AS near FROM f JOIN d USING (s) LEFT JOIN near ON near.pos = f.pos),
x AS (SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (exact) AS n_exact, count(*) FILTER (near AND NOT exact) AS n_near,
  coalesce(string_agg(line, chr(10) ORDER BY l.k) FILTER (NOT coalesce(exact OR near, false)), '') AS kept FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.k = g.k GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_exact, n_near, md5(kept) AS kept_md5 FROM x
"""

# Every 200-byte string of every text, by position; texts as hexadecimal digits, two for each byte.
ORACLES["op4_suffix_dedup"] = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS k FROM t WHERE len(h) >= 400),
w AS (SELECT r, k FROM (SELECT r, k, md5(substr(h, 2 * k + 1, 400)) AS m FROM p) QUALIFY count(*) OVER (PARTITION BY m) > 1),
n AS (SELECT r, k, coalesce(k > lag(k) OVER (PARTITION BY r ORDER BY k) + 200, true)::INT AS fresh FROM w),
g AS (SELECT r, k, sum(fresh) OVER (PARTITION BY r ORDER BY k ROWS UNBOUNDED PRECEDING) AS span FROM n),
s AS (SELECT r, span, min(k) AS lo, max(k) + 200 AS hi FROM g GROUP BY r, span),
x AS (SELECT r, span, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS prev FROM s),
k AS (SELECT r, sum(hi - lo) AS removed, count(*) AS spans, string_agg(substr(h, 2 * prev + 1, 2 * (lo - prev)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS kept FROM x JOIN t USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM t LEFT JOIN k USING (r)
"""

# Every pair of texts that share a 5-word shingle; classes by walking along links.
ORACLES["op9_jaccard_join"] = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
c AS (SELECT text, any_value(ws) AS ws, min(doc_id) AS node, count(*) AS copies FROM t GROUP BY text),
g AS (SELECT DISTINCT node, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT node, ws, unnest(range(1, len(ws) - 3)) AS i FROM c)),
n AS (SELECT node, count(*) AS n FROM g GROUP BY node),
p AS (SELECT a.node AS a, b.node AS b, count(*) AS k FROM g AS a JOIN g AS b ON a.g = b.g AND a.node <> b.node GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n AS x ON x.node = a JOIN n AS y ON y.node = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-6),
w AS (SELECT node AS root, node FROM c UNION SELECT w.root, l.b FROM w JOIN l ON w.node = l.a),
k AS (SELECT node, min(root) AS class_id FROM w GROUP BY node),
d AS (SELECT a AS node, sum(copies) AS links FROM l JOIN c ON c.node = l.b GROUP BY a)
SELECT doc_id, class_id, copies - 1 AS n_copies, (coalesce(links, 0) + copies - 1)::BIGINT AS n_links FROM t JOIN c USING (text) JOIN k USING (node) LEFT JOIN d USING (node)
"""

ORACLES["op11_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS cp, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256 FROM t
WINDOW w AS (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id)
"""

# The checksum byte by byte from its table; near words by deleting each letter of every word.
ORACLES["op12_spelling_variants"] = r"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) AS r(i))),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+') AS ws FROM documents),
c AS (SELECT doc_id, w, count(*) AS n FROM (SELECT r, doc_id, unnest(ws) AS w FROM d) GROUP BY r, doc_id, w),
h AS (SELECT w, n, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM c),
k AS (SELECT w, n, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS crc FROM h, tab),
v AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN crc % 97 = 0 THEN substr(w, 1, crc % length(w)) || substr(w, crc % length(w) + 2) ELSE w END AS word, n FROM k) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM x AS a JOIN x AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.rest = v.word UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.rest = v.word),
f AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM p GROUP BY word),
g AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM v LEFT JOIN f ON v.word = f.word),
w AS (SELECT word, word AS root, form AS ahead FROM g UNION ALL SELECT w.word, g.word, g.form FROM w JOIN g ON g.word = w.ahead)
SELECT g.word, form, root, n, n_near, form_n FROM g JOIN w ON g.word = w.word WHERE w.ahead IS NULL
"""

# Every pair of sources over every kept term, counts of 0 included.
ORACLES["op13_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
c AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(ts) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, term, sum(n) AS n FROM c SEMI JOIN k USING (lang, term) GROUP BY ALL),
gn AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce((SELECT sum(n) FROM s WHERE s.lang = g.lang AND s.source = g.source), 0) AS n FROM g LEFT JOIN v USING (lang)),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(s.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(s.n, 0) + 5)) // (gn.n + 5 * gn.v) AS p FROM gn JOIN k USING (lang) LEFT JOIN s USING (lang, source, term)),
q AS (SELECT k.lang, term, 1 + (1000000000::HUGEINT * (k.n + 5)) // (v.n + 5 * v.v) AS q FROM k JOIN v USING (lang)),
pp AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pp ON pp.lang = a.lang AND pp.source = a.source AND pp.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x) WHERE part = 'pair' OR rank <= 50
"""
