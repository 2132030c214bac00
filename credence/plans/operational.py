"""Exports, contexts, derived beliefs, audits and oracles over events and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import belief, text
from ..operators import curation, ledger, operational
from . import query
from .tables import SQL_LEDGER, SQL_SESSION, k_of, read, session_events
from .tables import ledger as tables

SQL_INTERVALS = SQL_LEDGER + """, iv AS (SELECT belief_id, CASE WHEN kind IN ('born', 'refreshed', 'confirmed') THEN 'active' ELSE kind END AS state, eff AS from_turn,
  lead(eff) OVER (PARTITION BY belief_id ORDER BY eff, at_turn, belief_event_id) AS to_turn FROM be)"""


@query("""WITH t AS (SELECT printf('e%03d', event_id) AS id, date_trunc('second', ts) AS timestamp, event_type AS outcome FROM events WHERE event_id % 3 <> 1),
y AS (SELECT printf('e%03d', i) AS id, TIMESTAMP '2026-02-01 09:00:00' + to_days(cast(i % 10 * 9 + i // 10 % 3 AS INT)) AS timestamp, ['high', 'moderate', 'quiet'][(i // 10 + i % 10) % 3 + 1] AS outcome FROM range(80) AS r(i))
SELECT * FROM t UNION ALL SELECT * FROM y WHERE id NOT IN (SELECT id FROM t)""")
def synthetic_events(spark, d):
    """The table's events, with the fixture's put in where their ids are not taken; done twice."""
    e = read(spark, d, "events").where("event_id % 3 <> 1")
    have = e.select(F.format_string("e%03d", "event_id").alias("id"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("timestamp"), F.col("event_type").alias("outcome"))
    more = operational.synthetic_events(spark).select("id", "timestamp", "outcome")
    return operational.insert_missing(operational.insert_missing(have, more, ["id"]), more, ["id"])


@query(f"""WITH {SQL_INTERVALS}, a AS (SELECT iv.*, session_id, created_turn FROM iv JOIN b USING (belief_id) WHERE state = 'active' AND (to_turn IS NULL OR from_turn < to_turn)),
s AS (SELECT se.event_id, se.session_id, se.turn, se.kind, list_sort(list(belief_id::VARCHAR) FILTER (belief_id IS NOT NULL)) AS l FROM se LEFT JOIN a ON a.session_id = se.session_id AND se.turn >= greatest(from_turn, created_turn) AND (to_turn IS NULL OR se.turn < to_turn) GROUP BY ALL)
SELECT session_id, turn, event_id, '{{"active_beliefs":[' || coalesce(array_to_string(list_transform(l, lambda x: '"' || x || '"'), ','), '') || '],"event_id":' || event_id || ',"kind":"' || kind || '","session_id":' || session_id || ',"turn":' || turn || '}}' AS json FROM s""")
def session_export(spark, d):
    beliefs, events = tables(spark, d)
    return operational.session_export(session_events(spark, d), beliefs, ledger.intervals(events))


@query(f"""WITH {SQL_INTERVALS}, a AS (SELECT iv.*, session_id, created_turn, belief_type, claim FROM iv JOIN b USING (belief_id) WHERE state <> 'retired'),
j AS (SELECT se.event_id, a.state, '{{"belief_id":"' || belief_id || '","belief_type":"' || belief_type || '","claim":"' || claim || '","created_turn":' || created_turn || ',"state":"' || a.state || '"}}' AS x, belief_id::VARCHAR AS bid
  FROM se JOIN a ON a.session_id = se.session_id AND se.turn >= greatest(from_turn, created_turn) AND (to_turn IS NULL OR se.turn < to_turn)),
l AS (SELECT event_id, string_agg(x, ',' ORDER BY bid, x) AS xs FROM j GROUP BY 1), c AS (SELECT event_id, string_agg('"' || state || '":' || n, ',' ORDER BY state) AS cs FROM (SELECT event_id, state, count(*) AS n FROM j GROUP BY ALL) GROUP BY 1)
SELECT se.session_id, turn, se.event_id, md5('{{"active_belief_counts":{{' || coalesce(cs, '') || '}},"active_beliefs_at_turn":[' || coalesce(xs, '') || '],"call_id":null,"event_idx":0,"event_type":"' || kind || '","outcome_status":null,"payload":{{"k":' || k || ',"src":{{"a":[1,2],"b":"' || kind || '"}}}},"session_id":' || se.session_id
  || ',"source_event_id":"e' || se.event_id || '","source_line_number":' || (turn + 1) || ',"timestamp":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","turn_idx":' || turn || '}}') AS json FROM se LEFT JOIN l USING (event_id) LEFT JOIN c USING (event_id)""")
def session_records(spark, d):
    from ..sources import exports

    beliefs, events = tables(spark, d)
    e = session_events(spark, d)
    payload = F.concat(F.lit('{"src": {"b": "'), F.col("kind"), F.lit('", "a": [1, 2]}, "k": '), F.col("k").cast("string"), F.lit("}"))
    rows = e.select("session_id", "turn", F.lit(0).alias("event_idx"), (F.col("turn") + 1).alias("line"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("source_event_id"), F.col("kind").alias("event_type"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("outcome"), payload.alias("payload"))
    out = exports.records(rows, beliefs, ledger.intervals(events))
    return out.join(e.select("session_id", "turn", "event_id"), ["session_id", "turn"]).select("session_id", "turn", "event_id", F.md5(F.col("json").cast("binary")).alias("json"))


@query(f"""WITH {SQL_SESSION}, en AS (SELECT session_id, max(turn) AS e FROM se GROUP BY 1), pn AS (SELECT session_id, turn AS f, turn + k % 9 AS t FROM se WHERE kind = 'view'), bk AS (SELECT session_id, turn AS f, CASE WHEN k % 5 > 0 THEN turn + k % 7 END AS t FROM se WHERE kind = 'error'),
vc AS (SELECT s.session_id, s.turn, (SELECT min(x.turn) FROM se x WHERE x.session_id = s.session_id AND x.kind = 'click' AND x.turn > s.turn) AS nx FROM se s WHERE kind = 'signup' AND EXISTS (SELECT 1 FROM pn WHERE pn.session_id = s.session_id AND f <= s.turn AND s.turn < t)),
ac AS (SELECT s.session_id, s.turn, EXISTS (SELECT 1 FROM bk WHERE bk.session_id = s.session_id AND f <= s.turn AND (t IS NULL OR s.turn < t)) AS b FROM se s WHERE kind = 'purchase'),
sg AS (SELECT session_id, turn, k % 6 AS g FROM se WHERE kind = 'error'), sn AS (SELECT a.session_id, a.turn, a.g FROM sg a JOIN sg b ON a.session_id = b.session_id AND a.g = b.g AND b.turn BETWEEN a.turn - 19 AND a.turn GROUP BY ALL HAVING count(*) >= 3),
rn AS (SELECT *, coalesce(turn - lag(turn) OVER (PARTITION BY session_id, g ORDER BY turn) > 20, true) AS nw FROM sn), rr AS (SELECT *, sum(nw::INT) OVER (PARTITION BY session_id, g ORDER BY turn) AS r FROM rn),
lp AS (SELECT session_id, min(turn) AS f, max(turn) AS s FROM rr GROUP BY session_id, g, r),
al AS (SELECT session_id, 'validation_complete' AS belief_type, turn AS f, coalesce(nx, turn) AS l, CASE WHEN nx IS NULL THEN 'active' ELSE 'contradicted' END AS st, CASE WHEN nx IS NULL THEN 'validation_tool_success' ELSE 'new_fix_attempted' END AS tr, 60 AS h, true AS ages FROM vc
  UNION ALL SELECT session_id, CASE WHEN b THEN 'action_blocked' ELSE 'action_ready' END, turn, turn, 'active', 'action_proposal', 5, false FROM ac
  UNION ALL SELECT session_id, 'failure_signature_active', f, CASE WHEN s + 20 <= e THEN s + 20 ELSE s END, CASE WHEN s + 20 <= e THEN 'retired' ELSE 'active' END, CASE WHEN s + 20 <= e THEN 'signature_aged_out' ELSE 'recurrence' END, 10, true FROM lp JOIN en USING (session_id))
SELECT session_id, belief_type, f AS turn_first_seen, l AS turn_last_updated, st AS lifecycle_state, CASE WHEN (CASE WHEN st = 'active' AND ages THEN e - l ELSE 0 END) / h < 0.5 THEN 'fresh' WHEN (CASE WHEN st = 'active' AND ages THEN e - l ELSE 0 END) / h < 1 THEN 'decaying' ELSE 'stale' END AS decay_status, tr AS trigger FROM al JOIN en USING (session_id)""")
def derived_beliefs(spark, d):
    e = session_events(spark, d)
    kind, k, t = F.col("kind"), F.col("k"), F.col("turn")
    turns = e.select("session_id", "turn", (kind == "signup").alias("validated"), (kind == "purchase").alias("proposes"), F.when(kind == "error", k % 6).alias("signature"))
    pending = e.where("kind = 'view'").select("session_id", t.alias("from_turn"), (t + k % 9).alias("to_turn"))
    blockers = e.where("kind = 'error'").select("session_id", t.alias("from_turn"), F.when(k % 5 > 0, t + k % 7).alias("to_turn"))
    return operational.derived_beliefs(turns, pending, e.where("kind = 'click'"), blockers)


QUOTAS = curation.Quotas(("view", "click", "purchase", "error", "signup"))


def question_pool(spark, d):
    """Events as candidates: answers by value, positions by the turn's share of the session."""
    w = Window.partitionBy("session_id")
    e = session_events(spark, d).withColumn("n", F.count("*").over(w))
    return e.select("session_id", "turn", F.col("kind").alias("category"), F.when(F.col("value") < 40, "POSITIVE").otherwise("NEGATIVE").alias("answer"), belief.position_bucket(F.col("turn"), F.col("n")).alias("position"))


@query()
def curated_questions(spark, d):
    return curation.curate(question_pool(spark, d), QUOTAS)


@query("""WITH o AS (SELECT conv_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line, md5(coalesce(text, '')) AS raw FROM conversations),
s AS (SELECT session_id, CASE WHEN line % 4 = 0 THEN line + 1 ELSE line END AS line, raw FROM o UNION ALL SELECT session_id, line, raw FROM o WHERE line = 1 UNION ALL SELECT session_id, line, raw || 'x' FROM o WHERE line = 2),
r AS (SELECT *, dense_rank() OVER (PARTITION BY session_id ORDER BY line) AS k, row_number() OVER (PARTITION BY session_id, line ORDER BY raw) AS nth, min(raw) OVER (PARTITION BY session_id, line) AS kept FROM s)
SELECT session_id, line, raw, CASE WHEN session_id::BIGINT % 7 = 0 THEN 'finalized' WHEN k <> line THEN 'out_of_order' WHEN nth = 1 THEN 'accepted' WHEN raw = kept THEN 'replayed' ELSE 'mutated' END AS status FROM r""")
def admitted_lines(spark, d):
    from ..sources import exports

    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    o = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), n.alias("line"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("raw"))
    sent = o.withColumn("line", F.when(F.col("line") % 4 == 0, F.col("line") + 1).otherwise(F.col("line"))).unionByName(o.where("line = 1")).unionByName(o.where("line = 2").withColumn("raw", F.concat("raw", F.lit("x"))))
    return exports.admit(sent, o.where("cast(session_id as bigint) % 7 = 0").select("session_id"))


UNIVERSE = ["src1", "src2", "src3", "src4"]
SQL_CHUNKS = "ch AS (SELECT doc_id % 700 AS event_id, DATE '2024-01-01' + (doc_id % 60)::INT AS date, source, doc_id AS ord FROM documents)"


def _chunks(spark, d):
    docs = read(spark, d, "documents")
    e = docs.select((F.col("doc_id") % 700).alias("event_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).alias("date"), F.array("source").alias("actors"), F.col("doc_id").alias("ord"))
    return operational.scan_chunks(e, "2024-01-10", "2024-02-05", UNIVERSE)


@query(f"""WITH {SQL_CHUNKS}, k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ord) AS r FROM ch WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-02-05' AND source IN ('src1', 'src2', 'src3', 'src4'))
SELECT event_id, ord, source FROM k WHERE r = 1""")
def chunk_scan(spark, d):
    return _chunks(spark, d)[0].select("event_id", "ord", F.get("actors", F.lit(0)).alias("source"))


@query(f"""WITH {SQL_CHUNKS} SELECT count(*) AS n_read, count(*) FILTER (date NOT BETWEEN DATE '2024-01-10' AND DATE '2024-02-05') AS n_outside,
  count(*) FILTER (date BETWEEN DATE '2024-01-10' AND DATE '2024-02-05' AND source NOT IN ('src1', 'src2', 'src3', 'src4')) AS n_unknown FROM ch""")
def chunk_scan_counters(spark, d):
    return _chunks(spark, d)[1]


@query(f"""WITH {SQL_SESSION}, r AS (SELECT session_id, k % 30 AS tool_use_id, turn FROM se WHERE kind = 'click'), u AS (SELECT session_id, k % 30 AS tool_use_id, turn FROM se WHERE kind = 'view')
SELECT r.session_id, r.tool_use_id, r.turn, max(CASE WHEN u.turn < r.turn THEN u.turn END) AS use_turn FROM r LEFT JOIN u USING (session_id, tool_use_id) GROUP BY ALL""")
def tool_invocations(spark, d):
    e = session_events(spark, d).withColumn("tool_use_id", F.col("k") % 30)
    return operational.invoking_turn(e.where("kind = 'click'"), e.where("kind = 'view'"))


@query(f"""WITH {SQL_SESSION} SELECT a.session_id, a.turn, min(b.turn) AS next_turn FROM se a LEFT JOIN se b ON b.session_id = a.session_id AND b.kind = 'purchase' AND b.turn > a.turn WHERE a.kind = 'signup' GROUP BY ALL""")
def next_fix(spark, d):
    e = session_events(spark, d)
    return operational.next_after(e.where("kind = 'signup'"), e.where("kind = 'purchase'"))


@query(f"""WITH {SQL_SESSION}, bb AS (SELECT session_id, k % 5 AS b, min(turn) AS birth_turn FROM se GROUP BY ALL),
t AS (SELECT session_id, k % 5 AS b, arg_max(kind, turn) AS state FROM se WHERE turn <= 30 GROUP BY ALL),
w AS (SELECT session_id, k % 5 AS b, max(turn) AS last_warrant FROM se WHERE turn <= 30 AND kind = 'view' GROUP BY ALL)
SELECT bb.session_id, bb.b AS belief, state, coalesce(last_warrant, birth_turn) AS last_warrant FROM bb JOIN t USING (session_id, b) LEFT JOIN w USING (session_id, b) WHERE birth_turn <= 30""")
def trail_as_of(spark, d):
    e = session_events(spark, d).groupBy("session_id", (F.col("k") % 5).alias("belief")).agg(F.min("turn").alias("birth_turn"), F.collect_list(F.struct("turn", F.col("kind").alias("new_state"))).alias("trail"), F.collect_list(F.when(F.col("kind") == "view", F.col("turn"))).alias("warrant_turns"))
    return operational.as_of_trail(e, 30).select("session_id", "belief", "state", "last_warrant")


@query(f"""WITH {SQL_INTERVALS}, p AS (SELECT session_id, turn, max((kind = 'purchase')::INT) OVER (PARTITION BY session_id ORDER BY turn RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) AS proposed FROM se),
k AS (SELECT session_id, from_turn, to_turn FROM iv JOIN b USING (belief_id) WHERE state = 'active' AND (to_turn IS NULL OR from_turn < to_turn) AND belief_type = 'pipeline_failed')
SELECT session_id, turn, CASE WHEN proposed = 0 THEN 'none' WHEN EXISTS (SELECT 1 FROM k WHERE k.session_id = p.session_id AND from_turn <= turn AND (to_turn IS NULL OR turn < to_turn)) THEN 'blocked' ELSE 'ready' END AS action FROM p""")
def action_states(spark, d):
    beliefs, events = tables(spark, d)
    k = ledger.intervals(events).where("state = 'active'").join(beliefs.where("belief_type = 'pipeline_failed'").select("belief_id", "session_id"), "belief_id")
    return operational.actions(session_events(spark, d).select("session_id", "turn", (F.col("kind") == "purchase").alias("proposes")), k.select("session_id", "from_turn", "to_turn"))


SQL_AUDIT_ONLY = """au AS (SELECT session_id, turn, share FROM (SELECT session_id, turn, row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM se),
  (VALUES (0.25), (0.5), (0.75)) v(share) WHERE n >= 10 AND i = floor(n * share))"""
SQL_AUDIT = f"{SQL_SESSION}, {SQL_AUDIT_ONLY}"


@query(f"WITH {SQL_AUDIT} SELECT session_id, turn, round(share::DOUBLE, 2) AS share FROM au")
def audit_points(spark, d):
    return operational.audit_points(session_events(spark, d).select("session_id", "turn"))


@query(f"""WITH {SQL_INTERVALS}, {SQL_AUDIT_ONLY}, q AS (SELECT session_id, state, from_turn, to_turn FROM iv JOIN b USING (belief_id) WHERE belief_type = 'validation_pending' AND (to_turn IS NULL OR from_turn < to_turn)),
pt AS (SELECT DISTINCT session_id, turn FROM au)
SELECT pt.session_id, pt.turn, CASE WHEN count(q.session_id) = 0 THEN 'NA' ELSE 'APPLICABLE' END AS applies, CASE WHEN count(q.session_id) = 0 THEN NULL WHEN max((state = 'active' AND (to_turn IS NULL OR pt.turn < to_turn))::INT) = 1 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS answer
FROM pt LEFT JOIN q ON q.session_id = pt.session_id AND from_turn <= pt.turn GROUP BY pt.session_id, pt.turn""")
def oracle_metrics(spark, d):
    beliefs, events = tables(spark, d)
    b = ledger.intervals(events).join(beliefs.select("belief_id", "session_id", "belief_type"), "belief_id")
    points = operational.audit_points(session_events(spark, d).select("session_id", "turn")).select("session_id", "turn").distinct()
    return operational.oracle(points, b, "validation_pending", "active")


SQL_CONV = "cv AS (SELECT conv_id AS session_id, turn, role, text, max(turn) OVER (PARTITION BY conv_id) AS top FROM conversations)"


@query(f"""WITH {SQL_CONV}, p AS (SELECT session_id, turn AS pos FROM cv WHERE turn = top), j AS (SELECT p.session_id, p.pos, cv.turn, '[' || cv.turn || '] ' || role || ': ' || CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '… [+' || (length(text) - 80) || ' chars]' ELSE text END AS line
  FROM p JOIN cv ON cv.session_id = p.session_id AND cv.turn BETWEEN p.pos - 2 AND p.pos), g AS (SELECT session_id, pos, count(*) AS n_turns, string_agg(line, chr(10) || chr(10) ORDER BY turn) AS context FROM j GROUP BY ALL)
SELECT session_id, pos AS turn, n_turns, context, greatest(1, (length(context) + 3) // 4) AS tokens FROM g""")
def raw_context(spark, d):
    c = read(spark, d, "conversations").withColumnRenamed("conv_id", "session_id")
    points = c.groupBy("session_id").agg(F.max("turn").alias("turn"))
    return operational.last_turns(c, points, 3, 80)


@query(f"""WITH {SQL_CONV}, f AS (SELECT *, length(text) % 3 = 0 AS sup, length(text) % 5 = 0 AS err FROM cv), p AS (SELECT session_id, turn AS pos, k, cap FROM cv, (VALUES (1), (3)) a(k), (VALUES (50), (400)) b(cap) WHERE turn = top OR turn = 1),
e AS (SELECT k, cap, p.session_id, pos, sum(least(length(text), cap)) FILTER (turn > pos - k) AS chars, count(*) FILTER (turn > pos - k AND length(text) > cap) AS cut, count(*) FILTER (turn > pos - k) AS seen,
  count(*) FILTER (sup AND turn > pos - k) / nullif(count(*) FILTER (sup), 0) AS su, count(*) FILTER (err AND turn > pos - k) / nullif(count(*) FILTER (err), 0) AS er FROM p JOIN f ON f.session_id = p.session_id AND f.turn <= pos GROUP BY ALL),
t AS (SELECT *, cast(floor((chars + 3) / 4) AS BIGINT) AS tokens FROM e), l AS (SELECT k, cap, list_sort(list(tokens)) AS a FROM t GROUP BY ALL)
SELECT k, cap, count(*) AS n, round(avg(tokens), 6) AS mean_tokens, round(avg((cut > 0)::INT), 6) AS cut_rate, round(sum(cut) / sum(seen), 6) AS truncation, count(*) FILTER (tokens > 150) AS overflow, round(avg(su), 6) AS support_coverage, count(su) AS n_support, round(avg(er), 6) AS error_coverage, count(er) AS n_failed,
  any_value(a[cast(floor(len(a) * 0.5) AS BIGINT) + 1]) AS median, any_value(a[cast(floor(len(a) * 0.9) AS BIGINT) + 1]) AS p90, any_value(a[-1]) AS most FROM t JOIN l USING (k, cap) GROUP BY ALL""")
def context_sweep(spark, d):
    size = F.length("text")
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "text", (size % 3 == 0).alias("supports"), (size % 5 == 0).alias("is_error"))
    points = c.groupBy("session_id").agg(F.max("turn").alias("turn")).unionByName(c.where("turn = 1").select("session_id", "turn"))
    out = operational.sweep(c, points, (1, 3), (50, 400), 150)
    return out.withColumns({x: F.round(x, 6) for x in ("mean_tokens", "cut_rate", "truncation", "support_coverage", "error_coverage")})


@query("""WITH b AS (SELECT user_id % 20 AS actor, user_id * 10 + event_id % 3 AS belief_id, arg_max(event_type, {'a': ts, 'b': event_id}) AS kind, max(ts::DATE) - CASE WHEN user_id % 3 = 0 THEN 40 ELSE 0 END AS last_seen, count(*) AS support FROM events GROUP BY user_id, user_id * 10 + event_id % 3),
s AS (SELECT *, CASE WHEN kind = 'error' THEN 'attention' WHEN kind <> 'purchase' THEN 'active' WHEN date_diff('day', last_seen, DATE '2024-02-08') <= 30 THEN 'recently retired' ELSE 'older' END AS section FROM b),
m AS (SELECT *, CASE WHEN section = 'older' THEN strftime(last_seen, '%Y-%m') ELSE '' END AS month FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY actor, section, month ORDER BY CASE WHEN section = 'older' THEN -support ELSE -date_diff('day', DATE '1970-01-01', last_seen) END, belief_id) AS r FROM m),
c AS (SELECT *, CASE section WHEN 'active' THEN r <= 12 WHEN 'recently retired' THEN r <= 8 WHEN 'older' THEN r <= 3 ELSE true END AS ok FROM r)
SELECT actor, section, month, count(*) AS n, string_agg('c' || belief_id, '; ' ORDER BY r) FILTER (ok) AS shown, count(*) FILTER (NOT ok) AS omitted FROM c GROUP BY ALL""")
def narrative_sections(spark, d):
    e = read(spark, d, "events")
    b = e.groupBy("user_id", (F.col("user_id") * 10 + F.col("event_id") % 3).alias("belief_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"), F.max(F.to_date("ts")).alias("last"), F.count("*").alias("support"))
    state = F.when(F.col("kind") == "error", "contradicted").when(F.col("kind") == "purchase", "retired").otherwise("active")
    last = F.when(F.col("user_id") % 3 == 0, F.date_sub("last", 40)).otherwise(F.col("last"))
    return operational.narrative(b.select((F.col("user_id") % 20).alias("actor"), "belief_id", state.alias("state"), last.alias("last_seen"), "support", F.concat(F.lit("c"), F.col("belief_id").cast("string")).alias("claim")), "2024-02-08")


_Q = ", ".join("'" + q + "'" for q in operational.QUESTIONS)


@query(f"""WITH {SQL_SESSION}, n AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM se) SELECT session_id, turn, kind AS category, CASE WHEN turn / n < 0.25 THEN 'early' WHEN turn / n < 0.75 THEN 'middle' ELSE 'late' END AS position,
  replace([{_Q}][((turn + length(kind)) % 3 + 1)::INT], '{{turn}}', turn::VARCHAR) AS question FROM n WHERE kind IN ('error', 'purchase')""".replace("{{turn}}", "{turn}"))
def question_candidates(spark, d):
    from pyspark.sql import Window

    e = session_events(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("session_id")))
    return operational.candidates(e, F.col("kind"), F.col("kind").isin("error", "purchase"))


@query("""SELECT event_id, CASE event_type WHEN 'signup' THEN 'growing' WHEN 'purchase' THEN 'growing' WHEN 'error' THEN 'failing' ELSE 'steady' END AS state_class,
  CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS direction,
  CASE WHEN value / 400 < 0.5 THEN 'fresh' WHEN value / 400 < 1 THEN 'decaying' ELSE 'stale' END AS decay, round(least(greatest(value / 100, 0), 1), 6) AS clamped FROM events""")
def state_classes(spark, d):
    e = read(spark, d, "events")
    c = text.state_class(F.col("event_type"))
    return e.select("event_id", c["state_class"].alias("state_class"), c["direction"].alias("direction"), belief.decay_status(F.col("value"), F.lit(400.0)).alias("decay"), F.round(text.clamped((F.col("value") / 100).cast("string"), 0, 1, 0.5), 6).alias("clamped"))


@query("""SELECT conv_id AS session_id, turn, coalesce(regexp_matches(text, '(?i)\\b(may|shall|should|can) i\\b|\\b(do you want|is it ok|okay) (me )?to\\b|\\bplease (confirm|approve)\\b'), false) AS asks,
  role = 'user' AND (starts_with(text, '<command-message>') OR starts_with(text, '<system-reminder>')) AS meta, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '… [+' || (length(text) - 40) || ' chars]' ELSE text END AS summary FROM conversations""")
def turn_predicates(spark, d):
    c = read(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), "turn", text.matches_any(F.col("text"), text.APPROVAL_REQUEST).alias("asks"), text.is_meta(F.col("role"), F.col("text")).alias("meta"), text.shortened(F.col("text"), 40).alias("summary"))


@query("""SELECT doc_id, substr(lower(regexp_replace(regexp_replace(regexp_replace(text, '\\d{4}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d(:\\d\\d)?(\\.\\d+)?Z?', '<ts>', 'g'), '(/[^/\\s:]+)+((/[^/\\s:]+){3})', '<path>\\2', 'g'), ':\\d+(:\\d+)?', ':<line>', 'g')), 1, 200) AS signature FROM documents""")
def normalized_signatures(spark, d):
    return read(spark, d, "documents").select("doc_id", belief.normalized_signature(F.col("text")).alias("signature"))


@query()
def normalized_arguments(spark, d):
    """Texts as arguments and as messages, in the two normal forms by which failures are compared."""
    docs = read(spark, d, "documents")
    return docs.select("doc_id", F.md5(belief.normalized_arguments(F.col("text")).cast("binary")).alias("arguments"), belief.normalized_error(F.col("text")).alias("error"))


@query("""WITH p AS (SELECT event_id, '/r/' || (k // 10) || CASE WHEN k % 2 = 0 THEN '/' || (k % 10) ELSE '/' END AS a, '/r/' || (k % 10) AS b FROM (SELECT event_id, cast(json_extract_string(props, '$.k') AS INT) AS k FROM events)),
n AS (SELECT event_id, rtrim(a, '/') AS a, rtrim(b, '/') AS b FROM p) SELECT event_id, a = b OR starts_with(a, b || '/') OR starts_with(b, a || '/') AS overlaps FROM n""")
def path_overlaps(spark, d):
    k = k_of()
    a = F.concat(F.lit("/r/"), F.floor(k / 10).cast("string"), F.when(k % 2 == 0, F.concat(F.lit("/"), (k % 10).cast("string"))).otherwise("/"))
    return read(spark, d, "events").select("event_id", belief.path_overlap(a, F.concat(F.lit("/r/"), (k % 10).cast("string"))).alias("overlaps"))


@query("""SELECT w AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 DAY, ts) - i * INTERVAL 1 DAY FOR i IN range(7)]) AS w FROM events) GROUP BY 1""")
def sliding_windows(spark, d):
    return operational.sliding_counts(read(spark, d, "events"), "7 days", "1 day")


@query()
def vector_projection(spark, d):
    p = operational.projection(read(spark, d, "embeddings"))
    return p.select("vec_id", F.transform("pca", lambda x: F.round(F.abs(x), 4)).alias("pca"))


@query("SELECT least(greatest(floor((embedding[1]::DOUBLE + 3) / 0.6), -1), 10)::BIGINT + 1 AS x, least(greatest(floor((embedding[2]::DOUBLE + 3) / 0.6), -1), 10)::BIGINT + 1 AS y, count(*) AS n FROM embeddings GROUP BY ALL")
def vector_histogram(spark, d):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return operational.histogram(read(spark, d, "embeddings"), at(0), at(1), -3.0, 3.0, 10)
