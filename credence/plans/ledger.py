"""The belief ledger over events as sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import belief
from ..operators import ledger, rules
from . import query
from .tables import SQL_LEDGER, SQL_SESSION, SQL_STATE, read, session_events
from .tables import ledger as tables

TURN = 40


def _state(spark, d):
    beliefs, events = tables(spark, d)
    return ledger.state_at(beliefs, events, TURN)


@query(f"WITH {SQL_STATE.format(turn=TURN)} SELECT belief_id, state, authority, last_updated_turn, array_to_string(warrants, ',') AS warrants FROM st")
def ledger_state_asof(spark, d):
    return _state(spark, d).select("belief_id", "state", "authority", "last_updated_turn", F.array_join(F.col("warrant_turns").cast("array<string>"), ",").alias("warrants"))


@query(f"""WITH {SQL_LEDGER}, i AS (SELECT *, lead(eff) OVER (PARTITION BY belief_id ORDER BY eff, at_turn, belief_event_id) AS to_turn FROM be)
SELECT belief_id, CASE WHEN kind IN ('born', 'refreshed', 'confirmed') THEN 'active' ELSE kind END AS state, eff AS from_turn, to_turn FROM i WHERE to_turn IS NULL OR eff < to_turn""")
def ledger_state_all_turns(spark, d):
    return ledger.intervals(tables(spark, d)[1])


SQL_FULL = SQL_STATE.format(turn=TURN) + f""", bl AS (SELECT *, CASE WHEN len(warrants) > 0 THEN warrants ELSE [last_updated_turn] END AS w FROM st
  WHERE state = 'active' AND belief_type IN ('validation_pending', 'user_approval_pending', 'pipeline_failed')),
ab AS (SELECT session_id, 'synthetic:action_blocked:' || session_id || ':{TURN}' AS belief_id, 'action_blocked \u2014 ' || string_agg(belief_type, ', ' ORDER BY created_turn, belief_id) AS claim, max(rank_authority) AS rank_authority,
  CASE max(rank_authority) WHEN 3 THEN 'tool' WHEN 2 THEN 'user' ELSE 'assistant' END AS authority, flatten(list(w ORDER BY created_turn, belief_id)) AS warrants,
  min(created_turn) AS created_turn, max(last_updated_turn) AS last_updated_turn FROM bl GROUP BY session_id),
fu AS (SELECT belief_id::VARCHAR AS belief_id, session_id, belief_type, claim, state, authority, rank_authority, warrants, created_turn, last_updated_turn FROM st
  UNION ALL BY NAME SELECT *, 'action_blocked' AS belief_type, 'active' AS state FROM ab)"""


def _full(spark, d):
    return ledger.full_state(*tables(spark, d), TURN)


@query(f"WITH {SQL_FULL} SELECT session_id, belief_id, claim, authority, array_to_string(warrants, ',') AS warrants, created_turn, last_updated_turn FROM ab")
def action_blocked(spark, d):
    out = ledger.action_blocked(_state(spark, d), TURN)
    return out.select("session_id", "belief_id", "claim", "authority", F.array_join(F.col("warrant_turns").cast("array<string>"), ",").alias("warrants"), "created_turn", "last_updated_turn")


@query(f"WITH {SQL_FULL} SELECT session_id, count(*) FILTER (state = 'active') AS n_active, count(*) FILTER (state = 'retired') AS n_retired, count(*) FILTER (state = 'contradicted') AS n_contradicted FROM fu GROUP BY 1")
def state_counts(spark, d):
    return ledger.state_counts(_full(spark, d))


SQL_RANK = f"""WITH {SQL_FULL}, rk AS (SELECT *, '[' || state || '] ' || belief_type || ' :: ' || claim[:80] || ' (auth=' || authority || ', last=' || last_updated_turn || ')' AS line, row_number() OVER (PARTITION BY session_id ORDER BY
  CASE WHEN coalesce(warrants[1], created_turn) <= {TURN - 20} AND coalesce(warrants[-1], created_turn) <= {TURN - 20} THEN 0 ELSE 1 END,
  CASE WHEN belief_type IN ('action_blocked', 'validation_pending', 'user_approval_pending', 'pipeline_failed', 'pipeline_running') THEN 1 ELSE 5 END, last_updated_turn DESC, rank_authority DESC, belief_id) AS rank FROM fu WHERE state = 'active')"""


@query(SQL_RANK + " SELECT session_id, belief_id, rank FROM rk")
def overlay_rank(spark, d):
    return ledger.rank_overlay(_full(spark, d), TURN).select("session_id", "belief_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH RECURSIVE {SQL_RANK[5:]}" + """, it AS (SELECT session_id, belief_id, rank, greatest(1, (length(line) + 3) // 4) + 1 AS cost FROM rk),
p AS (SELECT session_id, 0 AS i, 0 AS used, '' AS admitted, 0 AS omitted FROM (SELECT DISTINCT session_id FROM it) UNION ALL
  SELECT p.session_id, i + 1, CASE WHEN used + cost <= 45 THEN used + cost ELSE used END, CASE WHEN used + cost <= 45 THEN admitted || it.belief_id || ',' ELSE admitted END,
  CASE WHEN used + cost <= 45 THEN omitted ELSE omitted + 1 END FROM p JOIN it ON it.session_id = p.session_id AND it.rank = p.i + 1)
SELECT session_id, cast(arg_max(used, i) AS BIGINT) AS used, arg_max(admitted, i) AS admitted, cast(arg_max(omitted, i) AS BIGINT) AS omitted FROM p GROUP BY 1""")
def overlay_pack(spark, d):
    line = belief.overlay_line(F.col("state"), F.col("belief_type"), F.col("claim"), F.col("authority"), F.col("last_updated_turn"))
    ranked = ledger.rank_overlay(_full(spark, d), TURN).withColumn("cost", belief.approx_tokens(line) + 1)
    out = ledger.pack(ranked, 45, "cost")
    return out.select("session_id", "used", F.concat(F.array_join("admitted", ","), F.when(F.size("admitted") > 0, ",").otherwise("")).alias("admitted"), F.size("omitted").cast("long").alias("omitted"))


SQL_OVERLAY = f"WITH RECURSIVE {SQL_RANK[5:]}" + """, it AS (SELECT session_id, belief_id, belief_type, line, rank, greatest(1, (length(line) + 3) // 4) + 1 AS cost FROM rk),
room AS (SELECT 100 - greatest(1, (length('# Operational belief overlay (budget: 100 tokens, used: 9999, omitted: 99, K=20)') + 3) // 4) - 1 AS most),
p AS (SELECT session_id, 0 AS i, 0 AS used, []::VARCHAR[] AS yes FROM (SELECT DISTINCT session_id FROM it) UNION ALL
  SELECT p.session_id, i + 1, CASE WHEN used + cost <= most THEN used + cost ELSE used END, CASE WHEN used + cost <= most THEN list_append(yes, it.belief_id) ELSE yes END FROM p JOIN it ON it.session_id = p.session_id AND it.rank = p.i + 1 CROSS JOIN room),
e AS (SELECT session_id, arg_max(used, i) AS used, arg_max(yes, i) AS yes FROM p GROUP BY 1),
m AS (SELECT it.*, used, list_contains(yes, belief_id) AS ok FROM it JOIN e USING (session_id)),
ct AS (SELECT session_id, string_agg(belief_type || '=' || n, ',' ORDER BY belief_type) FILTER (ok) AS a, string_agg(belief_type || '=' || n, ',' ORDER BY belief_type) FILTER (NOT ok) AS o FROM (SELECT session_id, ok, belief_type, count(*) AS n FROM m GROUP BY ALL) GROUP BY 1),
bd AS (SELECT session_id, max(used) AS used, count(*) FILTER (ok) AS n_admitted, count(*) FILTER (NOT ok) AS n_omitted,
  '# Operational belief overlay (budget: 100 tokens, used: ' || max(used) || ', omitted: ' || count(*) FILTER (NOT ok) || ', K=20)' || coalesce(chr(10) || string_agg(line, chr(10) ORDER BY rank) FILTER (ok), '') AS body FROM m GROUP BY 1),
tx AS (SELECT *, CASE WHEN n_omitted > 0 AND (length(body || chr(10) || '# omitted: ' || replace(o, ',', ', ')) + 3) // 4 <= 100 THEN body || chr(10) || '# omitted: ' || replace(o, ',', ', ') ELSE body END AS text FROM bd JOIN ct USING (session_id))
SELECT session_id, text, cast(used AS BIGINT) AS body_tokens, (length(text) + 3) // 4 AS tokens_used, n_admitted, n_omitted, coalesce(a, '') AS admitted_by_type, coalesce(o, '') AS omitted_by_type FROM tx"""


@query(SQL_OVERLAY)
def overlay_text(spark, d):
    return ledger.overlay(*tables(spark, d), TURN, 100)


SQL_CLUSTERS = f"""WITH {SQL_STATE.format(turn=TURN)}, o AS (SELECT *, 'claim ' || belief_id % 3 AS cl, coalesce(warrants[1], created_turn) <= {TURN - 20} AND coalesce(warrants[-1], created_turn) <= {TURN - 20} AS outside FROM st),
cu AS (SELECT session_id % 10 AS session_id, belief_type, cl AS claim, count(*) AS n, max(last_updated_turn) AS last_updated_turn, max(rank_authority) AS authority_rank, bool_and(outside) AS all_outside,
  arg_max(belief_id, {{'a': (state = 'active')::INT, 'b': last_updated_turn, 'c': belief_id}}) AS representative, arg_max(state, {{'a': (state = 'active')::INT, 'b': last_updated_turn, 'c': belief_id}}) AS state FROM o GROUP BY 1, 2, 3)"""


def _clusters(spark, d):
    s = _state(spark, d).withColumns({"outside": ledger.out_of_window(TURN, 20), "claim": F.concat(F.lit("claim "), (F.col("belief_id") % 3).cast("string")), "session_id": F.col("session_id") % 10})
    return ledger.clusters(s)


@query(SQL_CLUSTERS + " SELECT * FROM cu")
def overlay_clusters(spark, d):
    return _clusters(spark, d)


@query(SQL_CLUSTERS + """ SELECT session_id, representative, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN all_outside THEN 0 ELSE 1 END,
  CASE WHEN belief_type IN ('action_blocked', 'validation_pending', 'user_approval_pending', 'pipeline_failed', 'pipeline_running') THEN 1 WHEN state IN ('weakened', 'contradicted') THEN 2 ELSE 5 END, last_updated_turn DESC, authority_rank DESC, sha256(representative::VARCHAR)) AS rank FROM cu""")
def cluster_rank(spark, d):
    return ledger.rank_clusters(_clusters(spark, d)).select("session_id", "representative", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {SQL_SESSION}, l AS (SELECT session_id, event_id AS line, CASE WHEN kind <> 'view' THEN k % 6 END AS turn_id FROM se),
t AS (SELECT *, last_value(turn_id IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS tid FROM l),
f AS (SELECT *, min(line) OVER (PARTITION BY session_id, tid) AS first_line FROM t)
SELECT line, CASE WHEN tid IS NULL THEN -1 ELSE dense_rank() OVER (PARTITION BY session_id, tid IS NULL ORDER BY first_line) - 1 END AS turn FROM f""")
def turn_resolution(spark, d):
    lines = session_events(spark, d).select("session_id", F.col("event_id").alias("line"), F.when(F.col("kind") != "view", F.col("k") % 6).alias("turn_id"))
    return ledger.resolve_turns(lines).select("line", "turn")


@query(f"WITH {SQL_SESSION} SELECT event_id AS line, row_number() OVER (PARTITION BY session_id, k % 6 ORDER BY event_id) - 1 AS event_idx FROM se")
def event_index(spark, d):
    e = session_events(spark, d).select("session_id", (F.col("k") % 6).alias("turn"), F.col("event_id").alias("line"))
    return ledger.event_index(e).select("line", "event_idx")


def _calls(spark, d):
    e = session_events(spark, d).withColumn("call_id", F.col("k") % 20)
    return e.where("kind = 'view'"), e.where("kind = 'click'"), e


@query(f"""WITH {SQL_SESSION}, r AS (SELECT *, k % 20 AS call_id FROM se)
SELECT a.event_id, max(CASE WHEN b.event_id < a.event_id THEN b.event_id END) AS parent_id FROM r a LEFT JOIN r b ON a.session_id = b.session_id AND a.call_id = b.call_id AND b.kind = 'view' WHERE a.kind = 'click' GROUP BY 1""")
def result_parents(spark, d):
    calls, results, _ = _calls(spark, d)
    return ledger.parents(calls, results).select("event_id", "parent_id")


@query(f"""WITH {SQL_SESSION}, c AS (SELECT session_id, k % 20 AS call_id, turn FROM se WHERE kind = 'view'), r AS (SELECT session_id, k % 20 AS call_id, min(turn) AS result_turn FROM se WHERE kind = 'click' GROUP BY 1, 2),
n AS (SELECT c.session_id, c.call_id, c.turn, min(se.turn) AS at_turn FROM c JOIN se ON se.session_id = c.session_id AND se.turn >= c.turn + 3 GROUP BY ALL)
SELECT n.session_id, n.call_id, n.turn AS effective_turn, at_turn FROM n LEFT JOIN r USING (session_id, call_id) WHERE result_turn IS NULL OR result_turn >= at_turn""")
def unmatched_calls(spark, d):
    calls, results, every = _calls(spark, d)
    return ledger.running_calls(calls, results, every)


@query(f"""WITH {SQL_SESSION} SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 'born' ELSE 'refreshed' END AS kind, first_value(event_id) OVER w AS born_event
FROM se WHERE kind = 'error' WINDOW w AS (PARTITION BY session_id, k % 4 ORDER BY event_id)""")
def failure_signature_lifecycle(spark, d):
    f = session_events(spark, d).where("kind = 'error'").withColumn("signature", F.col("k") % 4)
    return ledger.signature_lifecycle(f).select("event_id", "kind", "born_event")


@query(f"""WITH {SQL_SESSION}, a AS (SELECT session_id, turn AS answer_turn, kind = 'purchase' AS g FROM se WHERE kind IN ('purchase', 'signup')),
q AS (SELECT session_id, turn FROM se WHERE kind = 'click'),
j AS (SELECT q.session_id, q.turn, min(answer_turn) AS answer_turn, arg_min(g, answer_turn) AS g FROM q LEFT JOIN a ON a.session_id = q.session_id AND a.answer_turn > q.turn GROUP BY ALL)
SELECT session_id, turn, answer_turn, CASE WHEN answer_turn IS NULL THEN 'active' WHEN g THEN 'retired' ELSE 'contradicted' END AS state FROM j""")
def approval_lifecycle(spark, d):
    e = session_events(spark, d)
    answers = e.select("session_id", "turn", (F.col("kind") == "purchase").alias("grants"), (F.col("kind") == "signup").alias("denies"))
    return ledger.approvals(e.where("kind = 'click'"), answers)


@query(f"WITH {SQL_SESSION} SELECT event_id, lead(turn) OVER (PARTITION BY session_id, k % 7 ORDER BY turn, event_id) AS retired_turn FROM se WHERE kind = 'purchase'")
def report_replacement(spark, d):
    w = session_events(spark, d).where("kind = 'purchase'").withColumn("path", F.col("k") % 7)
    return ledger.replaced_reports(w).select("event_id", "retired_turn")


@query(f"""WITH RECURSIVE {SQL_SESSION}, c AS (SELECT session_id, -1::BIGINT AS turn, '' AS chain FROM (SELECT DISTINCT session_id FROM se)
  UNION ALL SELECT c.session_id, se.turn, sha256(chain || props) FROM c JOIN se ON se.session_id = c.session_id AND se.turn = c.turn + 1)
SELECT session_id, max(turn) + 1 AS n_lines, arg_max(chain, turn) AS chain FROM c GROUP BY 1""")
def hash_chain(spark, d):
    lines = session_events(spark, d).select("session_id", F.col("turn").alias("line"), F.col("props").alias("raw"))
    return ledger.hash_chain(lines)


@query(f"""WITH {SQL_SESSION}, g AS (SELECT * FROM se WHERE NOT (session_id % 5 = 0 AND turn = 7)), l AS (SELECT session_id, turn + 1 AS line, k = 13 AS unknown, k % 41 = 7 AS bad FROM g),
c AS (SELECT session_id, count(*) AS n, max(line) AS top, count(*) FILTER (unknown) AS u, count(*) FILTER (bad) AS b FROM l GROUP BY 1),
i AS (SELECT session_id, k AS turn, row_number() OVER (PARTITION BY session_id, k ORDER BY event_id) - 1 AS idx FROM g),
t AS (SELECT session_id, count(*) AS n, count(DISTINCT idx) AS d, max(idx) AS top FROM i WHERE NOT (turn = 20 AND idx = 0) GROUP BY session_id, turn),
y AS (SELECT session_id, count(*) FILTER (n <> d OR top <> n - 1) AS gaps FROM t GROUP BY 1), f AS (SELECT session_id, count(*) AS fails FROM g WHERE k = 30 GROUP BY 1)
SELECT session_id, 'line_count' AS "check", n = top AS ok, n AS detail FROM c UNION ALL SELECT session_id, 'unrecognized', u = 0, u FROM c UNION ALL SELECT session_id, 'hashes', b = 0, b FROM c
UNION ALL SELECT session_id, 'contiguity', coalesce(gaps, 0) = 0, coalesce(gaps, 0) FROM c LEFT JOIN y USING (session_id) UNION ALL SELECT session_id, 'rule_failures', coalesce(fails, 0) = 0, coalesce(fails, 0) FROM c LEFT JOIN f USING (session_id)""")
def verify_checks(spark, d):
    e = session_events(spark, d).where("not (session_id % 5 = 0 and turn = 7)")
    sha = F.when(F.col("k") % 41 == 7, "damaged").otherwise(F.sha2(F.col("props").cast("binary"), 256))
    lines = e.select("session_id", (F.col("turn") + 1).alias("line"), F.col("props").alias("raw"), sha.alias("sha"), F.when(F.col("k") == 13, "unrecognized").otherwise("mapped").alias("status"))
    indexed = ledger.event_index(e.select("session_id", F.col("k").alias("turn"), F.col("event_id").alias("line"))).where("not (turn = 20 and event_idx = 0)")
    return ledger.verify(lines, indexed, e.where("k = 30").select("session_id"))


@query(f"WITH {SQL_SESSION} SELECT event_id, 'bel-' || substr(sha256(session_id || chr(10) || kind || chr(10) || event_id), 1, 12) AS belief_id FROM se")
def content_ids(spark, d):
    s = session_events(spark, d)
    return s.select("event_id", belief.content_id("bel-", *(F.col(c).cast("string") for c in ("session_id", "kind", "event_id")), length=12).alias("belief_id"))


@query()
def rule_fold_lost_ids(spark, d):
    """Rules over sessions in which every fourth result has lost the id of its call, but not its tool and command."""
    e = session_events(spark, d)
    command = F.when(F.col("k") % 3 == 0, "pytest -q").when(F.col("k") % 3 == 1, "make all").otherwise("ls")
    kind, check = F.col("kind"), F.col("k") % 3 < 2
    names = F.when(kind.isin("view", "signup"), F.when(check, "validation_call").otherwise("tool_call")).when(kind == "click", "edit").when(kind == "purchase", "report_write").otherwise("tool_result")
    call = F.when((kind == "error") & (F.col("k") % 4 == 0), F.lit(None)).otherwise(F.concat(F.lit("c"), (F.col("k") % 5).cast("string")))
    rows = e.select(
        F.col("session_id").cast("string").alias("session_id"), "event_id", "turn", names.alias("kind"), call.alias("call_id"), F.element_at(F.split(command, " "), 1).alias("tool"), command.alias("command"), (F.col("k") % 2).cast("long").alias("exit_code"),
        F.when(F.col("k") % 2 == 1, F.concat(F.lit("1:s"), (F.col("k") % 4).cast("string"))).alias("signature"), F.concat(F.lit("/p/"), (F.col("k") % 3).cast("string")).alias("path"), F.lit(False).alias("grants"), F.lit(False).alias("denies"),
    )
    return rules.fold(rows)


@query()
def rule_fold_beliefs(spark, d):
    e = session_events(spark, d)
    names = F.create_map(*map(F.lit, ["view", "validation_call", "click", "tool_result", "purchase", "edit", "signup", "approval_request", "error", "user_message"]))
    rows = e.select(
        F.col("session_id").cast("string").alias("session_id"), "event_id", "turn", names[F.col("kind")].alias("kind"), (F.col("k") % 3).cast("string").alias("call_id"), (F.col("k") % 2).cast("long").alias("exit_code"),
        F.concat(F.lit("s"), (F.col("k") % 4).cast("string")).alias("signature"), F.concat(F.lit("/p/"), (F.col("k") % 3).cast("string")).alias("path"), (F.col("k") % 5 == 0).alias("grants"), (F.col("k") % 5 == 1).alias("denies"),
    )
    return rules.fold(rows)


@query("""WITH t AS (SELECT conv_id AS session_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT session_id, turn, CASE WHEN p / n < 0.25 THEN 'early' WHEN p / n < 0.75 THEN 'middle' ELSE 'late' END AS position, greatest(1, (length(text) + 3) // 4) AS tokens FROM t""")
def turn_positions(spark, d):
    w = Window.partitionBy("conv_id")
    t = read(spark, d, "conversations").withColumns({"p": F.row_number().over(w.orderBy("turn")) - 1, "n": F.count("*").over(w)})
    return t.select(F.col("conv_id").alias("session_id"), "turn", belief.position_bucket(F.col("p"), F.col("n")).alias("position"), belief.approx_tokens(F.col("text")).alias("tokens"))
