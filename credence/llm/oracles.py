"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality import CLASSES, COMMON_WORDS, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, MIN_WORDS, PER_LANGUAGE

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"[^\x20\x09-\x0D]+"


def _count(pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"length(t) - length(regexp_replace(t, '{quoted}', '', 'g'))"


_LISTS = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v)}]" for k, v in COMMON_WORDS.items())
_CLASS_COUNTS = ", ".join(_count(p) for p in CLASSES.values())

OP3_SQL = f"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT doc_id, i, w[i:i + 7] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) > 8)),
rp AS (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
rn AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM rp GROUP BY 1),
f AS (SELECT doc_id, lang, t, w, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  {_count('[#*$%&|<>]')} AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  [{_CLASS_COUNTS}, {_count('[\\x20\\x09-\\x0D]')}] AS c0, CASE lang {_LISTS} END AS cl, list_transform(w, lambda x: lower(x)) AS lw FROM w LEFT JOIN rn USING (doc_id)),
b AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  list_append(c0, length(t) - list_sum(c0)) AS cc, list_transform(cl, lambda x: len(list_filter(lw, lambda y: y = x))) AS w0 FROM f),
lf AS (SELECT doc_id, lang, n_words, base_failed, 'c' AS kind, unnest(cc)::DOUBLE AS v, generate_subscripts(cc, 1) AS i FROM b WHERE cl IS NOT NULL
  UNION ALL SELECT doc_id, lang, n_words, base_failed, 'w', unnest(list_append(w0, n_words - list_sum(w0)))::DOUBLE, unnest(range(1, len(w0) + 2)) FROM b WHERE cl IS NOT NULL),
sm AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents WHERE lang IN ({', '.join(map(repr, COMMON_WORDS))}) AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) WHERE k <= {PER_LANGUAGE}),
rf AS (SELECT lang, kind, i, sum(v) AS v FROM lf WHERE NOT base_failed AND n_words >= {MIN_WORDS} AND doc_id IN (SELECT doc_id FROM sm) GROUP BY ALL),
rq AS (SELECT lang, kind, i, v / sum(v) OVER (PARTITION BY lang, kind) AS q FROM rf),
pq AS (SELECT doc_id, n_words, lf.kind, CASE WHEN sum(v) OVER (PARTITION BY doc_id, lf.kind) > 0 THEN v / sum(v) OVER (PARTITION BY doc_id, lf.kind) END AS p, q FROM lf JOIN rq ON rq.lang = lf.lang AND rq.kind = lf.kind AND rq.i = lf.i),
js AS (SELECT doc_id, kind, any_value(n_words) AS n, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS d FROM pq WHERE p IS NOT NULL GROUP BY ALL),
far AS (SELECT DISTINCT doc_id FROM js WHERE n >= {MIN_WORDS} AND d > CASE kind WHEN 'c' THEN {MAX_CLASS_DISTANCE[0]} + {MAX_CLASS_DISTANCE[1]} / sqrt(n) ELSE {MAX_WORD_DISTANCE[0]} + {MAX_WORD_DISTANCE[1]} / sqrt(n) END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM far) AS kept FROM b
"""

OP5_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
r AS (SELECT a AS x, b AS y FROM l UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
c AS (SELECT x, min(y) AS y FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.y, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = w.doc_id
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP6_SQL = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_ALNUM}') AS w FROM documents),
iw AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_ALNUM}') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, m, w[i:i + m - 1] AS g FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)),
d AS (SELECT doc_id, m, i, w[i:i + m - 1] AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
h AS (SELECT doc_id, item_id, d.m, i FROM d JOIN p USING (g)),
k AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)
"""


#: The damage by a CRC of the key bit by bit, and the cheapest edits by recursion over the turns; a state is its cost (nine digits) and audit.
OP13_SQL = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(k, ''), lambda c: ord(c)::UBIGINT)), lambda h, b:
    list_reduce(list_prepend(xor(h, b), list_transform(range(8), lambda z: 0::UBIGINT)), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)),
    4294967295::UBIGINT) % 20 AS d FROM src),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN d = 0 THEN 0 WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth,
    right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS last_char, left(role, 1) AS i FROM ordered),
marked AS (
  SELECT conv_id, turn, role, text, pos, i, CASE WHEN last_char = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last_char NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i NOT IN ('su', 'ua', 'au') AS illegal FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n FROM marked GROUP BY conv_id),
fold(conv_id, pos, s0, s1, s2, s3) AS (
  SELECT conv_id, 0::BIGINT, '000000000', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM counts
  UNION ALL
  SELECT conv_id, pos, c0, least(d1, CASE WHEN keeps AND i = 's' THEN p0 END), least(d2, CASE WHEN keeps AND i = 'u' THEN pu END, CASE WHEN stays THEN ru END), least(d3, CASE WHEN keeps AND i = 'a' THEN pa END, CASE WHEN stays THEN ra END)
  FROM (
    SELECT conv_id, pos, i, stays, stays AS keeps, lpad((left(z0, 9)::INT + 4)::VARCHAR, 9, '0') || substr(z0, 10) || 'D' AS c0, lpad((left(z1, 9)::INT + 4)::VARCHAR, 9, '0') || substr(z1, 10) || 'D' AS d1,
      lpad((left(z2, 9)::INT + 4)::VARCHAR, 9, '0') || substr(z2, 10) || 'D' AS d2, lpad((left(z3, 9)::INT + 4)::VARCHAR, 9, '0') || substr(z3, 10) || 'D' AS d3,
      lpad((left(z0, 9)::INT + t)::VARCHAR, 9, '0') || substr(z0, 10) || 'K' AS p0, lpad((left(zu, 9)::INT + t)::VARCHAR, 9, '0') || substr(zu, 10) || 'K' AS pu, lpad((left(z2, 9)::INT + t)::VARCHAR, 9, '0') || substr(z2, 10) || 'K' AS pa,
      lpad((left(zu, 9)::INT + t + 3)::VARCHAR, 9, '0') || substr(zu, 10) || 'R' AS ru, lpad((left(z2, 9)::INT + t + 3)::VARCHAR, 9, '0') || substr(z2, 10) || 'R' AS ra
    FROM (
      SELECT y.*, m.i, m.pos, m.fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN m.fault = 'truncated' THEN 3 ELSE 0 END AS t, s0 AS z0, s1 AS z1, y2 AS z2, y3 AS z3, least(s0, s1, y3) AS zu
      FROM (
        SELECT conv_id, pos AS before, s0, s1, least(x2, lpad((left(least(s0, s1, x3), 9)::INT + 3)::VARCHAR, 9, '0') || substr(least(s0, s1, x3), 10) || 'I') AS y2, least(x3, lpad((left(x2, 9)::INT + 3)::VARCHAR, 9, '0') || substr(x2, 10) || 'I') AS y3
        FROM (SELECT conv_id, pos, s0, s1, least(s2, lpad((left(least(s0, s1, s3), 9)::INT + 3)::VARCHAR, 9, '0') || substr(least(s0, s1, s3), 10) || 'I') AS x2,
          least(s3, lpad((left(s2, 9)::INT + 3)::VARCHAR, 9, '0') || substr(s2, 10) || 'I') AS x3 FROM fold)) y
      JOIN marked m ON m.conv_id IS NOT DISTINCT FROM y.conv_id AND m.pos = y.before + 1))),
ended AS (
  SELECT f.conv_id, least(s0, s3, lpad((left(s2, 9)::INT + 3)::VARCHAR, 9, '0') || substr(s2, 10) || 'I', lpad((left(s1, 9)::INT + 6)::VARCHAR, 9, '0') || substr(s1, 10) || 'II') AS best
  FROM fold f JOIN counts c ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND c.n = f.pos),
tokens AS (
  SELECT conv_id, length(replace(substr(best, 10), 'D', '')) % 2 AS lead, unnest(regexp_extract_all(substr(best, 10), 'I*[KRD]|I+$')) AS token,
    generate_subscripts(regexp_extract_all(substr(best, 10), 'I*[KRD]|I+$'), 1) AS pos FROM ended),
letters AS (
  SELECT conv_id, lead, pos, unnest(string_split(token, '')) AS letter, generate_subscripts(string_split(token, ''), 1) AS nth FROM tokens),
stay AS (
  SELECT l.conv_id, l.pos, l.nth, CASE WHEN letter = 'K' THEN m.role WHEN (row_number() OVER (PARTITION BY l.conv_id ORDER BY l.pos, l.nth) - 1 - lead) % 2 = 0 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN letter = 'I' THEN '' ELSE m.text END AS line
  FROM letters l LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.pos = l.pos WHERE letter <> 'D'),
digests AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY pos, nth)) AS digest FROM stay GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(left(best, 9)::BIGINT, 0) AS cost, coalesce(substr(best, 10), '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM ids i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN digests d ON d.conv_id IS NOT DISTINCT FROM i.conv_id
"""


#: All phrases of up to three words are counted plainly.
OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM words, (VALUES (1), (2), (3)) AS s(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
cand AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, j.j AS cut, array_to_string(w[1:j.j], ' ') AS lp, array_to_string(w[j.j + 1:], ' ') AS rp FROM cand c, (VALUES (1), (2)) AS j(j) WHERE j.j < c.k),
scored AS (
  SELECT u.lang, u.phrase, u.a, u.cut, l.a AS l, r.a AS r, ((1000000::HUGEINT * u.a * u.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM cuts u JOIN f l ON l.lang = u.lang AND l.phrase = u.lp JOIN f r ON r.lang = u.lang AND r.phrase = u.rp),
least_cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
cover AS (SELECT lang, phrase, max(a) AS a FROM (
  SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM cand WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM cand WHERE k = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM least_cut c LEFT JOIN cover v ON v.lang = c.lang AND v.phrase = c.phrase WHERE v.a IS NULL OR 100 * v.a < 50 * c.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN total t ON t.lang = r.lang WHERE r.rank <= 2000
"""
