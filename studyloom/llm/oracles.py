"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from studyloom.llm import decontamination, line_dedup, overlaps, quality, secrets, sharding
from studyloom.llm.shared import LOWER, UPPER

_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_SPACE = r"[^\x20\x09-\x0D]+"

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
best AS (SELECT h, max(page_id) AS best FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN best <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN best <> page_id THEN best END AS refers_to
FROM p LEFT JOIN best ON best.h = p.h"""

OP3 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_SPACE}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN [w[1]] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS other FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""


def _kind(k: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    value = f"regexp_extract(m, '{p}', {group})" if group else "m"
    return rf"""SELECT doc_id, source, {k} AS k, '{kind}' AS kind, m, {value} AS v, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))::BIGINT AS a
FROM (SELECT doc_id, source, g, ms, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, source, regexp_split_to_array(coalesce(text, ''), '{p}') AS g, regexp_extract_all(coalesce(text, ''), '{p}') AS ms FROM documents)) WHERE length({value}) >= {least}"""


OP4 = f"""
WITH c AS ({' UNION ALL '.join(_kind(k, kind, pattern, group, least) for k, (kind, pattern, group, least, _) in enumerate(secrets.KINDS))}),
f AS (SELECT v, count(DISTINCT coalesce(source, '')) AS owners, count(DISTINCT coalesce(source, '') || chr(1) || coalesce(doc_id::VARCHAR, '')) AS repos FROM c GROUP BY v),
s AS (SELECT doc_id, k, kind, a, a + length(m) AS b, a + length(m) - length(v) AS va, owners, repos, owners >= {secrets.EXAMPLE_OWNERS} OR repos >= {secrets.EXAMPLE_REPOS} AS example,
  NOT (owners >= {secrets.EXAMPLE_OWNERS} OR repos >= {secrets.EXAMPLE_REPOS}) AND len(list_distinct(string_split(v, ''))) >= {secrets.LIVE_CHARACTERS} AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT regexp_matches(v, '{secrets.PLACEHOLDER}') AS live FROM c JOIN f USING (v)),
every AS (SELECT doc_id, a, k, b, kind FROM s UNION ALL SELECT DISTINCT doc_id, va, {len(secrets.KINDS)}, b, 'live' FROM s WHERE live UNION ALL SELECT DISTINCT doc_id, va, {len(secrets.KINDS) + 1}, b, 'example' FROM s WHERE example),
said AS (SELECT doc_id, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM every GROUP BY doc_id),
n AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS base,
  count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE example) AS n_example, string_agg(va || ':' || owners || ':' || repos, ',' ORDER BY a, k) AS ownership FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(ownership, '') AS ownership FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN said USING (doc_id)"""

def _rate(m: str) -> str:
    counted, of, _ = quality.MEASURES[m]
    return f"({counted} * {quality.MILLION} // greatest({of}, 1))"


def _quartiles(keys: str, name: str) -> str:
    pick = f"{keys}, " if keys else ""
    return f"""{name} AS (SELECT {pick}measure, any_value(total) AS n, min(bucket) FILTER (WHERE 4 * upto >= total) AS q1, min(bucket) FILTER (WHERE 4 * upto >= 3 * total) AS q3
  FROM (SELECT *, sum(n) OVER (PARTITION BY {pick}measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {pick}measure) AS total FROM (SELECT {pick}measure, bucket, count(*) AS n FROM b GROUP BY ALL)) GROUP BY {pick}measure)"""


def _shrunk(k: int) -> str:
    wider = f"((l.n * l.q{k} + {quality.SHRINK} * a.q{k}) / (l.n + {quality.SHRINK})::DOUBLE)"
    return f"((o.n * o.q{k} + {quality.SHRINK} * {wider}) / (o.n + {quality.SHRINK})::DOUBLE)"


_SLACK = "CASE measure " + " ".join(f"WHEN '{m}' THEN {slack}" for m, (_, _, slack) in quality.MEASURES.items()) + " END"
_OUTSIDE = " OR ".join(f"bool_or(measure = '{m}' AND (v > q3 + spread{' OR v < q1 - spread' if m in quality.BOTH_SIDES else ''}))" for m in quality.MEASURES)
OP5 = rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS x FROM w WHERE len(w) >= 8),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS c FROM rep, range(0, 8) r(k) GROUP BY doc_id),
n AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines, coalesce(c, 0)::BIGINT AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SPACE}')) AS ls FROM w) LEFT JOIN cov USING (doc_id)),
m AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed FROM n),
e AS (SELECT doc_id, lang, source, unnest({list(quality.MEASURES)!r}) AS measure, unnest([{', '.join(map(_rate, quality.MEASURES))}]) AS v FROM m WHERE NOT base_failed),
b AS (SELECT *, v - v % (2 ** greatest(length(bin(v)) - {quality.BITS}, 0))::BIGINT AS bucket FROM e),
{_quartiles('lang, source', 'own')}, {_quartiles('lang', 'ofl')}, {_quartiles('', 'whole')},
f AS (SELECT lang, source, measure, q1, q3, {quality.RANGES} * (q3 - q1) + {_SLACK} AS spread
  FROM (SELECT o.lang, o.source, o.measure, {_shrunk(1)} AS q1, {_shrunk(3)} AS q3 FROM own o JOIN ofl l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN whole a ON a.measure = o.measure)),
bad AS (SELECT doc_id FROM e JOIN f ON e.lang IS NOT DISTINCT FROM f.lang AND e.source IS NOT DISTINCT FROM f.source AND e.measure = f.measure GROUP BY doc_id HAVING {_OUTSIDE.replace('measure', 'f.measure')})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM m"""

_BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP6 = rf"""
WITH b AS (SELECT item_id, regexp_extract_all({_LOW}, '{_BENCH_WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, l, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i+l-1], ' '))) AS x FROM (SELECT *, least(10, len(w)) AS l FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_BENCH_WORD}') AS w FROM documents),
dw AS (SELECT doc_id, l, unnest(range(1, len(w) - l + 2)) AS i, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i+l-1], ' '))) AS x FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l),
hit AS (SELECT doc_id, item_id, i, bw.l FROM dw JOIN bw USING (l, x)),
h AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, range(0, 10) r(k) WHERE k < l GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id),
wt AS (SELECT DISTINCT item_id, i, l, unnest(w[i:i+l-1]) AS t FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS i FROM (SELECT *, least({decontamination.WINDOW}, len(w)) AS l FROM b WHERE len(w) > 0))),
need AS (SELECT item_id, i, l, count(*) AS need FROM wt GROUP BY ALL),
dp AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS pos FROM d),
cand AS (SELECT doc_id, item_id, i, l, need FROM (SELECT DISTINCT doc_id, t FROM dp) JOIN wt USING (t) JOIN need USING (item_id, i, l) GROUP BY ALL HAVING count(*) = need),
p AS (SELECT cand.*, t, pos FROM cand JOIN wt USING (item_id, i, l) JOIN dp USING (doc_id, t)),
near AS (SELECT DISTINCT doc_id, item_id FROM (SELECT x.doc_id, x.item_id, x.i, x.pos, x.need FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.item_id IS NOT DISTINCT FROM y.item_id AND x.i = y.i AND y.pos >= x.pos AND y.pos < x.pos + x.l + {decontamination.SLOP} GROUP BY ALL HAVING count(DISTINCT y.t) = x.need)),
nn AS (SELECT doc_id, count(*) AS n_near FROM near GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN nn USING (doc_id)"""

_M, _N = sharding.TABLE_SIZE, len(sharding.SHARDS)


def _bits(text: str, at: int) -> str:
    return f"('0x' || substring(md5({text}), {at}, 8))::BIGINT"


OP9 = f"""
WITH RECURSIVE names AS (SELECT {list(sharding.SHARDS)!r} AS s),
pref AS (SELECT list_transform(s, lambda x: {_bits('x', 1)} % {_M}) AS o, list_transform(s, lambda x: {_bits('x', 9)} % {_M - 1} + 1) AS k FROM names),
fill AS (SELECT 0 AS step, list_transform(range(0, {_M}), lambda i: -1) AS t
  UNION ALL
  SELECT step + 1, list_transform(t, lambda v, i: CASE WHEN i - 1 = free THEN step % {_N} ELSE v END)
  FROM (SELECT step, t, list_filter(list_transform(range(0, {_M}), lambda j: (o[step % {_N} + 1] + j * k[step % {_N} + 1]) % {_M}), lambda p: t[p + 1] < 0)[1] AS free FROM fill, pref WHERE step < {_M})),
done AS (SELECT t FROM fill WHERE step = {_M}),
slots AS (SELECT doc_id, source, coalesce(strlen(text), 0)::BIGINT AS bytes, ({_bits("coalesce(doc_id::VARCHAR, '')", 1)} % {_M})::INT AS slot FROM documents)
SELECT doc_id, source, bytes, slot, s[t[slot + 1] + 1] AS shard FROM slots, done, names"""


OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM l),
common AS (SELECT k FROM k WHERE length(k) >= {line_dedup.MIN_LENGTH} GROUP BY k HAVING count(DISTINCT r) >= {line_dedup.MIN_DOCS})
SELECT doc_id, count(*)::BIGINT AS n_lines, count(c.k)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN common c ON c.k = k.k GROUP BY r, doc_id"""

OP12 = f"""
WITH crcs AS (SELECT list(list_reduce([i] || list_transform(range(8), lambda z: 0::BIGINT), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
c AS (SELECT client_id, ts, kind, lag(ts) OVER (PARTITION BY client_id ORDER BY ts) AS before FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) > {overlaps.GAP_US} THEN 1 ELSE 0 END) OVER (PARTITION BY client_id ORDER BY ts) AS k FROM c),
e AS (SELECT client_id, k, min(ts) AS a, max(ts) AS b FROM n GROUP BY client_id, k),
z AS (SELECT e.client_id, epoch_us(a)::VARCHAR AS first, epoch_us(a) // {overlaps.SLOT_US} AS s, CASE WHEN bool_or(kind = 'error') THEN {overlaps.OPEN} ELSE any_value(epoch_us(b)) // {overlaps.SLOT_US} END AS e
  FROM e JOIN n ON n.client_id = e.client_id AND n.k = e.k AND n.ts = e.b GROUP BY e.client_id, e.k, a),
x AS (SELECT client_id, s, e, xor(list_reduce([4294967295] || list_transform(string_split(first, ''), lambda b: ascii(b)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM z, crcs),
shipped AS (SELECT sale_id, max(shipped_at) AS last_shipped FROM sale_lines GROUP BY sale_id),
y AS (SELECT sale_id, client_id, epoch_us(sold_at) // {overlaps.SLOT_US} AS s, CASE WHEN status = 'open' THEN {overlaps.OPEN} ELSE epoch_us(greatest(sold_at, coalesce(last_shipped, sold_at))) // {overlaps.SLOT_US} END AS e
  FROM sales LEFT JOIN shipped USING (sale_id) WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
p AS (SELECT sale_id, least(y.e, x.e) - greatest(y.s, x.s) + 1 AS shared, y.e = {overlaps.OPEN} AND x.e = {overlaps.OPEN} AS both_open, crc,
  CASE sign(y.s - x.s) WHEN -1 THEN ['overlaps', 'finished_by', 'contains'] WHEN 0 THEN ['starts', 'equals', 'started_by'] ELSE ['during', 'finishes', 'overlapped_by'] END[sign(y.e - x.e)::INT + 2] AS relation
  FROM y JOIN x ON x.client_id = y.client_id AND x.s <= y.e AND y.s <= x.e)
SELECT sale_id, relation, count(*)::BIGINT AS n_pairs, sum(CASE WHEN NOT both_open THEN shared END)::BIGINT AS overlap_slots, sum(crc)::BIGINT AS sessions_crc FROM p GROUP BY sale_id, relation"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_dictionary": OP1, "op3_signature_join": OP3, "op4_ownership_frequency": OP4, "op5_adaptive_quality": OP5, "op6_positional_index": OP6, "op9_lookup_sharding": OP9, "op11_levelled_runs": OP11, "op12_overlap_relations": OP12}
