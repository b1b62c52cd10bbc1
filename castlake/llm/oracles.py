"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from . import disclosure, quality

BLANK = r"[\x20\x09-\x0D]+"
WORDS = f"list_filter(regexp_split_to_array({{text}}, '{BLANK}'), lambda x: x <> '')"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=LOWERED)} AS words FROM documents),
tok AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM w WHERE len(words) >= 5),
five AS (SELECT doc_id, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS s FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
sh AS (SELECT DISTINCT doc_id, s FROM five WHERE s IS NOT NULL UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 4),
n AS (SELECT doc_id, COUNT(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, edges.y FROM reach JOIN edges ON reach.r = edges.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, MIN(r) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id"""

def _level(name: str) -> str:
    over, under = quality.SIGNALS[name].split(" / ")
    share = f"(CASE WHEN {under} > 0 THEN CAST({over} AS DOUBLE) / {under} ELSE 0 END)"
    return "(" + " + ".join(f"CASE WHEN {share} <= CAST({c} AS DOUBLE) THEN 1 ELSE 0 END" for c in quality.LEVELS[name]) + ")"


_LEVEL = f"least({', '.join(map(_level, quality.SIGNALS))})"
_P = quality.ALPHA

QUALITY = f"""
WITH t AS (SELECT doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {WORDS.format(text="text")} AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
tok AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM w),
three AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS s FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM three WHERE s IS NOT NULL QUALIFY COUNT(*) OVER (PARTITION BY doc_id, s) > 1),
covered AS (SELECT doc_id, CAST(SUM(k) AS BIGINT) AS n FROM (SELECT doc_id, least(3, i - lag(i, 1, -3) OVER (PARTITION BY doc_id ORDER BY i)) AS k FROM twice) GROUP BY doc_id),
f AS (SELECT w.doc_id, stratum, text, CAST(len(words) AS BIGINT) AS n_words, length(regexp_replace(text, '{BLANK}', '', 'g')) AS word_chars,
 length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(text) - length(replace(text, '!', '')) AS n_shouts,
 length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals, len(lines) AS n_lines,
 CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
l AS (SELECT *, {_LEVEL} AS level FROM g),
known AS (SELECT l.*, q.quality FROM l JOIN (SELECT doc_id, MIN(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) q ON q.doc_id = l.doc_id
 WHERE NOT base_failed QUALIFY row_number() OVER (PARTITION BY stratum, text ORDER BY l.doc_id) = 1),
rejected AS (SELECT stratum, rule, COUNT(*) FILTER (quality = 1) AS n, COUNT(*) FILTER (quality = 1 AND level <= rule) AS x, COUNT(*) FILTER (quality = 0 AND level <= rule) AS bad
 FROM known, range({quality.RULES}) r(rule) GROUP BY stratum, rule),
tested AS (SELECT *, CASE WHEN x >= n * {_P} THEN 1.0 ELSE (SELECT SUM(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_P}) + (n - i) * ln(1 - {_P}))) FROM range(0, x + 1) u(i)) END
 <= {quality.DELTA} / (SELECT COUNT(DISTINCT stratum) FROM known) AS passes FROM rejected),
ends AS (SELECT stratum, MIN(rule) FILTER (NOT passes) AS stop FROM tested GROUP BY stratum),
best AS (SELECT t.stratum, rule FROM tested t JOIN ends e ON e.stratum = t.stratum WHERE bad > 0 AND rule < coalesce(stop, {quality.RULES}) QUALIFY row_number() OVER (PARTITION BY t.stratum ORDER BY bad DESC, rule) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND level > coalesce(rule, -1) AS kept FROM l LEFT JOIN best ON best.stratum = l.stratum"""


NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
 FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 3"""


_TERMS = "list_filter(regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\p{{L}}+'), lambda w: length(w) BETWEEN 4 AND 40)"
_KEYS = "list_concat({words}, list_transform({words}, lambda w: w[:" + str(disclosure.STEM) + "] || '*'))"
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_GAPS = " UNION ALL ".join(f"SELECT row, text, '{kind}' AS kind, {k} AS k, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM t" for k, (kind, pattern) in enumerate(_PLAIN.items()))
_NEAR, _ASIDE = disclosure.NEAR, disclosure.ASIDE
_AHEAD = f"CASE WHEN length(before) < {_ASIDE} THEN before ELSE regexp_replace(right(before, {_ASIDE}), '^\\p{{L}}+', '') END"
_AFTER = f"CASE WHEN length(behind) < {_ASIDE} THEN behind ELSE regexp_replace(left(behind, {_ASIDE}), '\\p{{L}}+$', '') END"

DISCLOSURE = f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT row, text, kind, k, i, m[i] AS value, g[i] AS before, g[i + 1] AS behind, CAST(SUM(length(g[i]) + length(m[i])) OVER (PARTITION BY row, kind ORDER BY i) AS BIGINT) AS e FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({_GAPS}))),
b AS (SELECT *, e - length(value) AS s FROM (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM u) WHERE CASE kind WHEN 'email' THEN true
 WHEN 'ip' THEN list_bool_and(list_transform(string_split(value, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(TRY_CAST(ltrim(x, '0') AS INTEGER), 0) <= 255))
 WHEN 'phone' THEN length(d) BETWEEN 9 AND 15 ELSE length(d) BETWEEN 13 AND 19
 AND CAST(list_sum(list_transform(range(1, length(d) + 1), lambda j: CASE WHEN (length(d) - j) % 2 = 0 THEN CAST(substr(d, j, 1) AS INTEGER) ELSE (2 * CAST(substr(d, j, 1) AS INTEGER) - CASE WHEN substr(d, j, 1) > '4' THEN 9 ELSE 0 END) END)) AS INTEGER) % 10 = 0 END),
near AS (SELECT row, text, kind || ':' || CASE kind WHEN 'email' THEN translate(value, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') WHEN 'ip' THEN value ELSE d END AS entity,
 list_concat({_TERMS.format(text=_AHEAD)}[-{_NEAR}:], {_TERMS.format(text=_AFTER)}[:{_NEAR}]) AS words FROM b),
pairs AS (SELECT DISTINCT row, text, entity, unnest(list_append({_KEYS.format(words="words")}, '')) AS key FROM near),
ev AS (SELECT entity, key, COUNT(*) AS n FROM pairs GROUP BY entity, key HAVING COUNT(DISTINCT text) >= {disclosure.SUPPORT}),
own AS (SELECT row, text, {_TERMS.format(text="text")} AS words FROM t),
nk AS (SELECT key, COUNT(*) AS n_key FROM (SELECT DISTINCT row, unnest({_KEYS.format(words="words")}) AS key FROM own) WHERE key IN (SELECT key FROM ev) GROUP BY key),
total AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n_all FROM documents),
told AS (SELECT DISTINCT ev.key FROM ev JOIN (SELECT entity, n AS n_entity FROM ev WHERE key = '') c ON c.entity = ev.entity JOIN nk ON nk.key = ev.key, total
 WHERE ev.key <> '' AND n_entity < n_all AND ln(n * n_all / (CAST(n_entity AS DOUBLE) * n_key)) / ln(n_all / n_entity) >= {disclosure.DISCLOSED}),
runs AS (SELECT *, string_split_regex(text, '\\p{{L}}+') AS g, regexp_extract_all(text, '\\p{{L}}+') AS m FROM t),
tok AS (SELECT row, translate(m[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, length(m[i]) AS n, CAST(SUM(length(g[i]) + length(m[i])) OVER (PARTITION BY row ORDER BY i) AS BIGINT) AS e FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM runs)),
found AS (SELECT row, e - n AS s, e FROM tok WHERE w IN (SELECT key FROM told) AND NOT EXISTS (SELECT 1 FROM b WHERE b.row = tok.row AND b.s < tok.e AND tok.e - tok.n < b.e)),
line AS (SELECT row, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS line, COUNT(*) FILTER (kind = 'email') AS n_email, COUNT(*) FILTER (kind = 'ip') AS n_ip, COUNT(*) FILTER (kind = 'card') AS n_card, COUNT(*) FILTER (kind = 'phone') AS n_phone FROM b GROUP BY row),
more AS (SELECT row, string_agg('term:' || s || ':' || e, ',' ORDER BY s) AS more FROM found GROUP BY row)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(line, '')) AS base_sha256, concat_ws(',', line, more) AS spans
FROM t LEFT JOIN line ON line.row = t.row LEFT JOIN more ON more.row = t.row"""
