"""Turns with tools and contexts, over events as turns, conversations and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import belief
from ..operators import capture, contexts, rules, timelines, turns
from ..sources import grouped
from . import query
from .tables import SQL_LEDGER, SQL_SESSION, read, session_events
from .tables import ledger as ledger_tables

#: Events as turns: clicks and views are an assistant's edits and commands, errors a user's turn with a failed result.
SQL_TURNS = SQL_SESSION + """,
tn AS (SELECT session_id, turn AS turn_idx, ts, kind, k, CASE WHEN kind IN ('view', 'click', 'purchase') THEN 'assistant' ELSE 'user' END AS role,
  CASE kind WHEN 'view' THEN CASE k % 4 WHEN 0 THEN 'pytest -q t' || k % 3 || '.py' WHEN 1 THEN 'git push' WHEN 2 THEN 'curl -s x' ELSE 'ls' END END AS cmd, CASE WHEN kind = 'click' THEN 'file=/a/F' || k % 5 || '.py' WHEN kind = 'purchase' THEN 'file=/out/report' || k % 2 || '.md' END AS file,
  kind = 'error' AS bad, kind IN ('error', 'signup') OR (kind = 'view' AND k % 3 = 0) AS has_result FROM se)"""


def session_turns(spark, d):
    e = session_events(spark, d)
    k, kind = F.col("k"), F.col("kind")
    command = F.when(k % 4 == 0, F.concat(F.lit("pytest -q t"), (k % 3).cast("string"), F.lit(".py"))).when(k % 4 == 1, "git push").when(k % 4 == 2, "curl -s x").otherwise("ls")
    use = lambda name, given: F.array(F.struct(F.lit(name).alias("name"), F.col("event_id").cast("string").alias("tool_use_id"), given.alias("input_summary")))
    uses = (
        F.when(kind == "view", use("Bash", command)).when(kind == "click", use("Edit", F.concat(F.lit("file=/a/F"), (k % 5).cast("string"), F.lit(".py"))))
        .when(kind == "purchase", use("Write", F.concat(F.lit("file=/out/report"), (k % 2).cast("string"), F.lit(".md")))).otherwise(F.expr("cast(array() as array<struct<name:string,tool_use_id:string,input_summary:string>>)"))
    )
    has = kind.isin("error", "signup") | ((kind == "view") & (k % 3 == 0))
    result = F.array(F.struct(F.col("event_id").cast("string").alias("tool_use_id"), F.concat(F.lit(" Boom "), (k % 4).cast("string")).alias("output_summary"), (kind == "error").alias("is_error")))
    results = F.when(has, result).otherwise(F.expr("cast(array() as array<struct<tool_use_id:string,output_summary:string,is_error:boolean>>)"))
    role = F.when(kind.isin("view", "click", "purchase"), "assistant").otherwise("user")
    return e.select("session_id", F.col("turn").alias("turn_idx"), F.col("ts").alias("timestamp"), role.alias("role"), F.lit("").alias("text"), F.lit(False).alias("is_meta"), uses.alias("tool_uses"), results.alias("tool_results"), "k", "kind")


SQL_REGIONS = """rg AS (SELECT *, CASE WHEN role = 'user' THEN CASE WHEN bad THEN 'failure_diagnosis' ELSE 'UNCLASSIFIED' END WHEN cmd LIKE 'git push%' THEN 'deploy_readiness' WHEN cmd LIKE 'curl%' THEN 'data_fetch' WHEN cmd LIKE 'pytest%' THEN 'validation'
  WHEN file LIKE '%report%' THEN 'report_generation' ELSE 'UNCLASSIFIED' END AS region, CASE WHEN bad THEN 'FAIL' WHEN cmd LIKE 'pytest%' AND has_result THEN 'PASS' ELSE 'UNKNOWN' END AS vs,
  CASE WHEN cmd IS NULL AND file IS NULL THEN 'none' WHEN has_result THEN 'full' ELSE 'partial' END AS cv FROM tn)"""


@query(f"WITH {SQL_TURNS}, {SQL_REGIONS} SELECT session_id, turn_idx, region FROM rg")
def turn_tool_regions(spark, d):
    return session_turns(spark, d).select("session_id", "turn_idx", turns.region()["region"].alias("region"))


@query(f"WITH {SQL_TURNS}, {SQL_REGIONS} SELECT session_id, turn_idx, region, vs AS validation_status, cv AS coverage_status FROM rg")
def ledger_entries(spark, d):
    return turns.ledger_entries(session_turns(spark, d))


@query(f"""WITH {SQL_TURNS}, {SQL_REGIONS}, a AS (SELECT 'region' AS aspect, region AS value FROM rg UNION ALL SELECT 'validation_status', vs FROM rg UNION ALL SELECT 'coverage_status', cv FROM rg), c AS (SELECT aspect, value, count(*) AS n FROM a GROUP BY aspect, value)
SELECT aspect, value, n, round(100 * n / sum(n) OVER (PARTITION BY aspect), 2) AS pct FROM c""")
def ledger_summary(spark, d):
    return turns.ledger_summary(turns.ledger_entries(session_turns(spark, d)))


@query(f"WITH {SQL_TURNS}, {SQL_REGIONS} SELECT session_id, count(*) AS n_entries, count(*) FILTER (region <> 'UNCLASSIFIED') AS n_classified, count(*) FILTER (vs = 'FAIL') AS n_failed FROM rg GROUP BY 1 HAVING n_failed > 0 ORDER BY n_failed DESC, session_id LIMIT 10")
def most_failing_sessions(spark, d):
    return turns.most_failing(turns.ledger_entries(session_turns(spark, d)))


@query(f"""WITH {SQL_TURNS} SELECT session_id, turn_idx, bad AS has_error, kind IN ('click', 'purchase') AS is_change, coalesce(cmd LIKE 'pytest%', false) AS is_validation, CASE WHEN cmd LIKE 'pytest%' AND has_result THEN 'PASS' END AS validation_status,
  coalesce(cmd LIKE 'git push%', false) AS is_deploy, kind = 'purchase' AS is_report FROM tn""")
def turn_tool_predicates(spark, d):
    p = turns.predicates()
    return session_turns(spark, d).select("session_id", "turn_idx", *(p[c].alias(c) for c in ("has_error", "is_change", "is_validation", "validation_status", "is_deploy", "is_report")))


@query(f"""WITH {SQL_TURNS} SELECT session_id, turn_idx, CASE WHEN cmd IS NOT NULL THEN 'Bash' WHEN kind = 'click' THEN 'Edit' WHEN kind = 'purchase' THEN 'Write' ELSE '' END AS tools, CASE WHEN bad THEN 'boom ' || k % 4 END AS error_kw,
  coalesce(CASE WHEN cmd LIKE 'pytest%' THEN 't' || k % 3 || '.py' END, lower(substr(file, 6)), '') AS file_paths, coalesce(split_part(cmd, ' ', 1), '') AS cmd_tokens FROM tn""")
def turn_signatures(spark, d):
    s = turns.signature()
    return session_turns(spark, d).select("session_id", "turn_idx", F.array_join(s["tools"], ",").alias("tools"), s["error_kw"].alias("error_kw"), F.array_join(s["file_paths"], ",").alias("file_paths"), F.array_join(s["cmd_tokens"], ",").alias("cmd_tokens"))


@query(f"""WITH {SQL_TURNS} SELECT session_id, count(*) AS n_turns, count(*) FILTER (cmd IS NOT NULL OR file IS NOT NULL) AS n_tool_uses, count(*) FILTER (bad) AS n_errors, min(ts) AS first_ts, max(ts) AS last_ts,
  round(epoch_us(max(ts)) / 86400e6 - epoch_us(min(ts)) / 86400e6, 2) AS days FROM tn GROUP BY ROLLUP (session_id)""")
def tool_inventory(spark, d):
    return turns.tool_inventory(session_turns(spark, d))


@query(f"WITH {SQL_TURNS} SELECT CASE kind WHEN 'view' THEN 'Bash' WHEN 'click' THEN 'Edit' ELSE 'Write' END AS tool, count(*) AS n FROM tn WHERE role = 'assistant' GROUP BY 1")
def tool_counts(spark, d):
    return turns.tool_counts(session_turns(spark, d))


@query(f"""WITH {SQL_TURNS}, a AS (SELECT session_id * 10 + k % 2 AS belief_id, session_id, turn_idx FROM tn WHERE k % 11 < 3), j AS (SELECT DISTINCT a.belief_id, coalesce(CASE WHEN cmd LIKE 'pytest%' THEN 't' || k % 3 || '.py' END, lower(substr(file, 6))) AS f, split_part(cmd, ' ', 1) AS c FROM a JOIN tn USING (session_id, turn_idx))
SELECT belief_id, coalesce(string_agg(DISTINCT f, ',' ORDER BY f), '') AS touched_files, coalesce(string_agg(DISTINCT c, ',' ORDER BY c), '') AS cmd_tokens FROM j GROUP BY 1""")
def fix_contexts(spark, d):
    t = session_turns(spark, d)
    lines = t.where("k % 11 < 3").select((F.col("session_id") * 10 + F.col("k") % 2).alias("belief_id"), "session_id", "turn_idx", F.when(F.col("k") % 2 == 0, "born").otherwise("refreshed").alias("event_type"))
    out = turns.fix_context(lines, t)
    return out.select("belief_id", F.array_join("touched_files", ",").alias("touched_files"), F.array_join("cmd_tokens", ",").alias("cmd_tokens"))


@query(f"""WITH {SQL_SESSION}, b AS (SELECT session_id, k % 4 AS n, list({{'t': turn, 'e': kind}} ORDER BY turn) AS ev FROM se GROUP BY ALL)
SELECT session_id, n AS belief_no, CASE WHEN n = 0 THEN 'user_approval_pending' ELSE 'other' END AS belief_name, list_filter(ev, lambda x: x.e = 'signup')[1].t AS birth_turn, list_filter(ev, lambda x: x.e IN ('purchase', 'error'))[-1].t AS retired_turn FROM b""")
def timeline_ends(spark, d):
    kinds = F.create_map(*map(F.lit, ["signup", "born", "view", "refreshed", "click", "refreshed", "purchase", "retired", "error", "contradicted"]))
    e = session_events(spark, d).groupBy("session_id", (F.col("k") % 4).alias("belief_no")).agg(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("turn_idx"), kinds[F.col("kind")].alias("event_type")))).alias("events"))
    return turns.timelines(e.withColumn("belief_name", F.when(F.col("belief_no") == 0, "user_approval_required").otherwise("other"))).drop("events")


@query("SELECT DISTINCT conv_id AS session_id FROM conversations WHERE conv_id IN (SELECT user_id FROM events)")
def eligible_sessions(spark, d):
    return turns.eligible(read(spark, d, "conversations").select(F.col("conv_id").alias("session_id")).distinct(), read(spark, d, "events").select(F.col("user_id").alias("session_id")))


@query("SELECT event_id FROM events WHERE event_type = (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)")
def mode_variant(spark, d):
    return contexts.with_mode(read(spark, d, "events"), "event_type").select("event_id")


@query("SELECT event_id, CASE event_type WHEN 'signup' THEN 'born' WHEN 'view' THEN 'reconfirmed' WHEN 'click' THEN 'weakened' ELSE 'active' END AS lifecycle FROM events")
def lifecycle_names(spark, d):
    names = F.create_map(*map(F.lit, ["signup", "born", "view", "strengthened", "click", "weakened"]))
    return read(spark, d, "events").select("event_id", contexts.lifecycle(F.try_element_at(names, F.col("event_type"))).alias("lifecycle"))


@query(f"""WITH {SQL_SESSION}, b AS (SELECT session_id * 100 + k % 7 AS belief_id, min(turn) AS first, max(turn) AS last, list({{'t': turn, 's': CASE kind WHEN 'error' THEN 'contradicted' WHEN 'purchase' THEN 'retired' WHEN 'click' THEN 'weakened' ELSE 'active' END}} ORDER BY turn) AS tr,
  list(turn) FILTER (kind IN ('view', 'signup')) AS w FROM se GROUP BY 1), c AS (SELECT *, list_filter(tr, lambda x: x.t <= 40) AS seen FROM b WHERE first <= 40)
SELECT belief_id, seen[-1].s AS state, CASE WHEN last > 40 THEN seen[-1].t ELSE last END AS last_updated, first <= 20 AND coalesce(list_max(list_filter(w, lambda t: t <= 40)), first) <= 20 AS outside FROM c WHERE seen[-1].s <> 'retired'""")
def context_candidates(spark, d):
    kinds = F.create_map(*map(F.lit, ["signup", "active", "view", "active", "click", "weakened", "purchase", "retired", "error", "contradicted"]))
    b = session_events(spark, d).groupBy((F.col("session_id") * 100 + F.col("k") % 7).alias("belief_id")).agg(
        F.min("turn").alias("turn_first_seen"), F.max("turn").alias("turn_last_updated"), F.array_sort(F.collect_list(F.struct("turn", kinds[F.col("kind")].alias("new_state")))).alias("revision_trail"), F.collect_list(F.when(F.col("kind").isin("view", "signup"), F.col("turn"))).alias("warrant_turns"),
    )
    return contexts.candidates(b, 40).select("belief_id", "state", "last_updated", "outside")


SQL_ARMS = """q AS (SELECT conv_id AS question_id, conv_id AS session_id, max(turn) - 1 AS at_turn FROM conversations GROUP BY 1),
pl AS (SELECT question_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) FILTER (turn > at_turn - 5) AS a, string_agg(role || ': ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) FILTER (turn > at_turn - 2) AS c
  FROM q JOIN conversations ON conv_id = session_id AND turn <= at_turn GROUP BY 1),
al AS (SELECT q.question_id, coalesce(a, '') AS a, CASE WHEN q.question_id % 3 > 0 THEN 'overlay ' || q.question_id ELSE '' END AS b, coalesce(c, '') AS c FROM q LEFT JOIN pl USING (question_id)),
ar AS (SELECT question_id, 'A' AS arm, a AS r FROM al UNION ALL SELECT question_id, 'B', b FROM al UNION ALL SELECT question_id, 'C', b || chr(10) || chr(10) || c FROM al)"""


@query(f"WITH {SQL_ARMS} SELECT question_id, arm, md5(r) AS digest, greatest(1, (length(r) + 3) // 4) AS token_count FROM ar")
def context_arms(spark, d):
    c = read(spark, d, "conversations")
    lines = c.select(F.col("conv_id").alias("session_id"), "turn", F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))
    q = c.groupBy(F.col("conv_id").alias("question_id")).agg(F.first("conv_id").alias("session_id"), (F.max("turn") - 1).alias("at_turn"))
    overlays = q.where("question_id % 3 > 0").select("question_id", F.concat(F.lit("overlay "), F.col("question_id").cast("string")).alias("text"))
    return contexts.arms(lines, q, overlays, 5, 2).select("question_id", "arm", F.md5(F.col("rendered").cast("binary")).alias("digest"), "token_count")


@query("""WITH e AS (SELECT event_type AS category, user_id AS actor, ts::DATE AS cutoff, value AS score, event_id AS id FROM events), b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY category, actor, cutoff ORDER BY score DESC, id) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY category, actor ORDER BY score DESC, id) AS k FROM b) SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY CASE WHEN k = 1 THEN 1 WHEN k <= 3 THEN 2 ELSE 3 END, score DESC, id) AS rank FROM o QUALIFY rank <= 40""")
def actor_diverse_selection(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("category"), F.col("user_id").alias("actor"), F.to_date("ts").alias("cutoff"), F.col("value").alias("score"), F.col("event_id").alias("id"))
    return contexts.by_actor(e, 40).select("category", "id", F.col("rank").cast("long").alias("rank"))


@query("""SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'invariant' ELSE 'decaying' END AS warrant_type, CASE WHEN event_type <> 'error' THEN CASE WHEN value = 0 OR event_type = 'click' THEN 1.0 ELSE value END END AS initial_confidence,
  CASE WHEN event_type <> 'error' THEN floor(value * 10 + 1) END AS half_life_seconds, CASE WHEN event_type = 'error' THEN 'UNKNOWN' END AS validation_status FROM events""")
def warrant_round_trip(spark, d):
    decaying = F.col("event_type") != "error"
    w = F.struct(
        F.when(decaying, "decaying").otherwise("invariant").alias("warrant_type"), F.col("ts").cast("string").alias("birth_timestamp"), F.lit(1).alias("support_n"), F.lit("covered").alias("coverage_status"), F.when(F.col("event_type") == "click", 0.0).otherwise(F.col("value")).alias("confidence"),
        F.lit(0.5).alias("distance_to_centroid"), F.lit(None).cast("double").alias("coverage_threshold"), (F.col("value") * 10 + 1).alias("half_life_seconds"), F.array(F.lit("e1")).alias("evidence_refs"), F.lit(None).cast("string").alias("validation_status"),
    )
    back = read(spark, d, "events").select(F.col("event_id").alias("id"), contexts.warrant_from_json(contexts.warrant_to_json(w)).alias("w"))
    return back.select("id", "w.warrant_type", "w.initial_confidence", "w.half_life_seconds", "w.validation_status")


@query("WITH " + SQL_LEDGER + """ SELECT session_id, belief_type, created_turn AS turn FROM b UNION ALL SELECT session_id, 'action_proposed', turn FROM se WHERE kind = 'purchase' UNION ALL SELECT session_id, 'validation_complete', turn FROM se WHERE kind = 'signup'""")
def belief_bag(spark, d):
    """The ledger's beliefs and two kinds of derived ones in one bag; nothing is merged."""
    beliefs, _ = ledger_tables(spark, d)
    e = session_events(spark, d)
    own = beliefs.select("session_id", "belief_type", F.col("created_turn").alias("turn"))
    of = lambda kind, name: e.where(F.col("kind") == kind).select("session_id", F.lit(name).alias("belief_type"), "turn")
    return contexts.bag(own, of("purchase", "action_proposed"), of("signup", "validation_complete"))


@query(f"""WITH {SQL_SESSION}, c AS (SELECT session_id, turn AS event_id, 'v' || k % 3 AS tool, CASE k % 2 WHEN 0 THEN 'pytest' ELSE 'ls' END AS command FROM se WHERE kind = 'view'), r AS (SELECT session_id, turn + 100000 * session_id AS event_id, 'v' || k % 3 AS tool, CASE k % 2 WHEN 0 THEN 'pytest' ELSE 'ls' END AS command FROM se WHERE kind = 'click'),
l AS (SELECT session_id, tool, command, max(event_id) AS p FROM c GROUP BY ALL) SELECT r.event_id, p AS parent_event FROM r JOIN l USING (session_id, tool, command) WHERE command = 'pytest'""")
def validation_parents(spark, d):
    e = session_events(spark, d)
    fields = [F.concat(F.lit("v"), (F.col("k") % 3).cast("string")).alias("tool_name"), F.when(F.col("k") % 2 == 0, "pytest").otherwise("ls").alias("command")]
    calls = e.where("kind = 'view'").select("session_id", F.col("turn").alias("event_id"), *fields)
    results = e.where("kind = 'click'").select("session_id", (F.col("turn") + 100000 * F.col("session_id")).alias("event_id"), F.lit(None).cast("long").alias("parent_id"), *fields)
    return capture.validation_parents(results, calls)


#: Turns of every branch of the region classifier, by k modulo 17: role, text, is_meta, commands and tools, failed result.
REGION_TURNS = [
    ("user", "<command-message>x</command-message><command-name>/evening</command-name>", True, [], False), ("user", "/add-actor ABC", True, [], False), ("user", "/unheard of", True, [], False), ("user", "<system-reminder>be brief</system-reminder>", True, [], False),
    ("user", "please ship it now", False, [], False), ("user", "no, that is wrong", False, [], False), ("user", "thanks", False, [], True), ("user", "thanks", False, [], False), ("assistant", "", False, [("WebSearch", "q")], False), ("assistant", "", False, [("Bash", "ls"), ("Bash", "curl -s x && git push")], False),
    ("assistant", "", False, [("Bash", "openssl ts -query")], False), ("assistant", "", False, [("Bash", "python build_risk_report.py")], False), ("assistant", "", False, [("Bash", "python scripts/run_pipeline.py --check")], False), ("assistant", "", False, [("Edit", "file=/a/page.html")], False),
    ("assistant", "Let me check what failed", False, [("Bash", "ls")], False), ("assistant", "fine", False, [("Read", "file=/a"), ("Read", "file=/b")], False), ("assistant", "fine", False, [("Read", "file=/a"), ("Edit", "file=/b")], False),
]


SQL_BRANCHES = f"""WITH {SQL_SESSION}, t AS (SELECT session_id, turn, k % 17 AS c FROM se)
SELECT session_id, turn AS turn_idx, CASE WHEN c IN (0, 12) THEN 'pipeline_run' WHEN c IN (1, 8) THEN 'data_fetch' WHEN c IN (4, 9) THEN 'deploy_readiness' WHEN c IN (5, 6, 14) THEN 'failure_diagnosis' WHEN c = 10 THEN 'evidence_sealing' WHEN c IN (11, 13) THEN 'report_generation' WHEN c = 15 THEN 'validation' ELSE 'UNCLASSIFIED' END AS region,
  CASE c WHEN 0 THEN 'slash_command=/evening' WHEN 1 THEN 'slash_command=/add-actor' WHEN 2 THEN 'unknown_slash_command=/unheard' WHEN 3 THEN 'system_reminder' WHEN 4 THEN 'user_deploy_intent' WHEN 5 THEN 'user_correction' WHEN 6 THEN 'tool_error_in_result' WHEN 7 THEN 'user_default' WHEN 8 THEN 'tool_name=WebSearch'
  WHEN 9 THEN 'bash_pattern=deploy_readiness:\\bgit push\\b' WHEN 10 THEN 'bash_pattern=evidence_sealing:openssl ts' WHEN 11 THEN 'bash_pattern=report_generation:build_.*report\\.py' WHEN 12 THEN 'bash_pattern=pipeline_run:scripts/run_pipeline\\.py' WHEN 13 THEN 'write_report_artifact' WHEN 14 THEN 'assistant_diagnosis_text' WHEN 15 THEN 'read_only_inspection' ELSE 'assistant_default' END AS reason FROM t"""


@query(SQL_BRANCHES)
def turn_region_branches(spark, d):
    e = session_events(spark, d)
    kinds = spark.createDataFrame([(i, r, t, m, [(n, "u", x) for n, x in uses], [("u", "out", True)] if bad else []) for i, (r, t, m, uses, bad) in enumerate(REGION_TURNS)], "c int, role string, text string, is_meta boolean, tool_uses array<struct<name:string,tool_use_id:string,input_summary:string>>, tool_results array<struct<tool_use_id:string,output_summary:string,is_error:boolean>>")
    t = e.select("session_id", F.col("turn").alias("turn_idx"), (F.col("k") % 17).cast("int").alias("c")).join(F.broadcast(kinds), "c")
    x = turns.region()
    return t.select("session_id", "turn_idx", x["region"].alias("region"), x["reason"].alias("reason"))


@query(f"""WITH b AS ({SQL_BRANCHES}), u AS (SELECT 'region' AS of, region AS value, region FROM b UNION ALL SELECT 'reason', reason, region FROM b UNION ALL SELECT 'session', session_id::VARCHAR, region FROM b), n AS (SELECT of, value, region, count(*) AS n FROM u GROUP BY ALL)
SELECT *, round(100 * n / CASE WHEN of = 'session' THEN sum(n) OVER (PARTITION BY of, value) ELSE sum(n) OVER (PARTITION BY of) END, 2) AS pct FROM n""")
def region_reasons(spark, d):
    return turns.region_reasons(turn_region_branches(spark, d))


@query(f"""WITH {SQL_TURNS}, g AS (SELECT session_id, turn_idx, CASE WHEN cmd IS NOT NULL THEN 'Bash' WHEN kind = 'click' THEN 'Edit' WHEN kind = 'purchase' THEN 'Write' END AS tool, CASE WHEN bad THEN 'boom ' || k % 4 END AS err,
  CASE WHEN cmd LIKE 'pytest%' THEN 't' || k % 3 || '.py' ELSE lower(substr(file, 6)) END AS path, split_part(cmd, ' ', 1) AS word FROM tn), p AS (SELECT a.session_id, a.turn_idx, coalesce(a.tool = b.tool, false) AS st, coalesce(a.err = b.err, false) AS se, coalesce(a.path = b.path, false) AS sp, coalesce(a.word = b.word, false) AS sw FROM g a JOIN g b ON a.session_id = b.session_id AND b.turn_idx = a.turn_idx - 4)
SELECT session_id, turn_idx, st AND se OR sp AND sw AS same FROM p""")
def signature_repeats(spark, d):
    """Whether a turn's signature matches that of the turn four before."""
    w = Window.partitionBy("session_id").orderBy("turn_idx")
    t = session_turns(spark, d).select("session_id", "turn_idx", turns.signature().alias("s"))
    t = t.withColumn("b", F.lag("s", 4).over(w)).where("b is not null")
    return t.select("session_id", "turn_idx", belief.signature_matches(F.col("s"), F.col("b")).alias("same"))


@query()
def belief_timelines(spark, d):
    """Eight beliefs of all sessions, with decay."""
    t = session_turns(spark, d)
    return timelines.instances(timelines.timelines(t.withColumn("region", turns.region()["region"])))


@query("""WITH c AS (SELECT conv_id AS session_id, count(*) AS n_turns, max(turn) AS last_turn FROM conversations GROUP BY 1), e AS (SELECT user_id AS session_id, count(*) AS n_events, count(DISTINCT event_type) AS n_names FROM events GROUP BY 1)
SELECT session_id, n_turns, last_turn, n_events, n_names FROM c JOIN e USING (session_id)""")
def grouped_sessions(spark, d):
    """Turns and timelines of sessions from tables bucketed by session: counts and join without a shuffle."""
    name = "".join(x if x.isalnum() else "_" for x in f"{d}_{spark.sparkContext.applicationId}".lower())[-100:]  # a warehouse outlives the session's catalog
    t = grouped.save(read(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", "text"), f"turns{name}", ("turn",))
    e = grouped.save(read(spark, d, "events").select(F.col("user_id").cast("long").alias("session_id"), "ts", "event_id", F.col("event_type").alias("name")), f"timelines{name}", ("ts", "event_id"))
    a = t.groupBy("session_id").agg(F.count("*").alias("n_turns"), F.max("turn").alias("last_turn"))
    b = e.groupBy("session_id").agg(F.count("*").alias("n_events"), F.size(F.collect_set("name")).cast("long").alias("n_names"))
    return a.hint("merge").join(b, "session_id")


def raw_lines(spark, d):
    """Events as rollout lines: views are shell calls, errors results of the latest of them, clicks patches and purchases reports
    with their results, signups questions and answers."""
    e = session_events(spark, d)
    k, kind, turn = F.col("k"), F.col("kind"), F.concat(F.lit("t"), F.col("turn").cast("string"))
    w = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    own, last = F.concat(F.lit("c"), F.col("event_id").cast("string")), F.concat(F.lit("c"), F.last(F.when(kind == "view", F.col("event_id")), ignorenulls=True).over(w).cast("string"))
    line = lambda top, sub, **more: F.to_json(F.struct(F.lit(top).alias("type"), F.struct(F.lit(sub).alias("type"), turn.alias("turn_id"), *(v.alias(n) for n, v in more.items())).alias("payload")))
    call = lambda name, given: line("response_item", "function_call", call_id=own, name=F.lit(name), arguments=given)
    result = lambda id_, output: line("response_item", "function_call_output", call_id=id_, output=output)
    shell = F.when(k % 4 == 0, F.concat(F.lit("pytest -q t"), (k % 3).cast("string"), F.lit(".py"))).when(k % 4 == 1, "git push").when(k % 4 == 2, "make all").otherwise("ls")
    patch = F.to_json(F.struct(F.concat(F.lit("*** Begin Patch\n*** Update File: /src/F"), (k % 5).cast("string"), F.lit(".py\n")).alias("input")))
    report = F.to_json(F.struct(F.concat(F.lit("/out/report"), (k % 2).cast("string"), F.lit("/summary.md")).alias("path")))
    ran = F.concat(F.lit("ran\nError "), (k % 4).cast("string"), F.lit("\nProcess exited with code "), (k % 2).cast("string"))
    asked = line("response_item", "message", role=F.lit("assistant"), content=F.array(F.struct(F.lit("text").alias("type"), F.lit("Shall I proceed?").alias("text"))))
    said = line("event_msg", "user_message", message=F.when(k % 3 == 0, "no, wait").otherwise("yes, go on"))
    lines = (
        F.when(kind == "view", F.array(call("exec_command", F.to_json(F.struct(shell.alias("cmd")))))).when(kind == "error", F.array(result(last, ran)))
        .when(kind == "click", F.array(call("apply_patch", patch), result(own, F.lit("Done.")))).when(kind == "purchase", F.array(call("write_file", report), result(own, F.lit("Wrote file")))).otherwise(F.array(F.when(k % 2 == 0, asked).otherwise(said)))
    )
    each = e.withColumn("lines", lines).select("session_id", "turn", F.posexplode("lines").alias("p", "raw"))
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("turn", "p")).cast("long")
    return each.select(F.col("session_id").cast("string").alias("session_id"), number.alias("line"), "raw")


@query("WITH " + SQL_SESSION + """,
ln AS (SELECT *, 'c' || event_id AS own, 'c' || last_value(CASE WHEN kind = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS latest,
  CASE k % 4 WHEN 0 THEN 'pytest -q t' || k % 3 || '.py' WHEN 1 THEN 'git push' WHEN 2 THEN 'make all' ELSE 'ls' END AS shell FROM se),
vw AS (SELECT session_id, event_id, shell FROM ln WHERE kind = 'view'),
ev AS (
  SELECT session_id, turn, 0 AS p, 'tool_call' AS event_type, own AS call_id, string_split(shell, ' ')[1] AS tool_name, shell AS command, '' AS paths, NULL AS outcome, NULL AS exit_code FROM ln WHERE kind = 'view'
  UNION ALL SELECT l.session_id, turn, 0, 'tool_result', latest, string_split(v.shell, ' ')[1], v.shell, CASE WHEN v.shell IS NULL THEN NULL ELSE '' END, CASE WHEN k % 2 = 0 THEN 'success' ELSE 'failure' END, k % 2 FROM ln l LEFT JOIN vw v ON v.session_id = l.session_id AND 'c' || v.event_id = l.latest WHERE kind = 'error'
  UNION ALL SELECT session_id, turn, q.p, CASE q.p WHEN 0 THEN 'tool_call' ELSE 'tool_result' END, own, CASE kind WHEN 'click' THEN 'apply_patch' ELSE 'write_file' END, '', CASE kind WHEN 'click' THEN '/src/F' || k % 5 || '.py' ELSE '/out/report' || k % 2 || '/summary.md' END,
    CASE q.p WHEN 1 THEN 'success' END, CASE q.p WHEN 1 THEN 0 END FROM ln, (VALUES (0), (1)) AS q(p) WHERE kind IN ('click', 'purchase')
  UNION ALL SELECT session_id, turn, 0, CASE k % 2 WHEN 0 THEN 'assistant_message' ELSE 'user_message' END, NULL, NULL, NULL, NULL, NULL, NULL FROM ln WHERE kind = 'signup')
SELECT session_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn, p) AS event_id, turn, event_type, call_id, tool_name, command, paths, outcome, exit_code::BIGINT AS exit_code FROM ev""")
def captured_events(spark, d):
    e = capture.normalise(raw_lines(spark, d))
    return e.select("session_id", "event_id", "turn", "event_type", "call_id", "tool_name", "command", F.array_join("paths", ",").alias("paths"), "outcome", F.col("exit_code").cast("long").alias("exit_code"))


@query()
def capture_overlay(spark, d):
    return capture.capture_overlay(raw_lines(spark, d), 1000, 200)


@query()
def captured_beliefs(spark, d):
    return rules.fold(capture.rule_rows(capture.normalise(raw_lines(spark, d))))


@query("SELECT doc_id::VARCHAR AS session_id, doc_id + 1 AS line, CASE WHEN text IS NULL THEN 'envelope missing required keys: raw_line' END AS fault FROM documents")
def envelope_check(spark, d):
    docs = read(spark, d, "documents")
    sent = docs.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("session_id"), (F.col("doc_id") + 1).alias("source_line_number"), F.col("text").alias("raw_line"))).alias("value"))
    return capture.envelopes(sent).select("session_id", "line", "fault")
