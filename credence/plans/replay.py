"""Session logs over conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import replay
from . import query
from .tables import SQL_SESSION, read, session_events

_BODY = " ".join(f"WHEN role = '{role}' AND regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN '{name}'" for role, rules in (("user", replay.USER_RULES), ("assistant", replay.ASSISTANT_RULES)) for name, p in rules)
SQL_REGION = f"CASE {_BODY} WHEN role IN ('user', 'assistant') THEN 'other' ELSE 'meta' END"


def _turns(spark, d):
    return read(spark, d, "conversations").withColumnRenamed("conv_id", "session_id")


@query(f"SELECT conv_id AS session_id, turn, {SQL_REGION} AS region FROM conversations")
def turn_region_classify(spark, d):
    return _turns(spark, d).select("session_id", "turn", replay.classify_turn(F.col("role"), F.col("text"))["region"].alias("region"))


@query(f"WITH r AS (SELECT {SQL_REGION} AS region FROM conversations) SELECT region, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM r GROUP BY 1")
def region_distribution(spark, d):
    t = _turns(spark, d).select(replay.classify_turn(F.col("role"), F.col("text"))["region"].alias("region"))
    return replay.distribution(t, "region").withColumn("share", F.round("share", 6))


@query("""SELECT conv_id AS session_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, cast(sum(length(text)) AS BIGINT) AS n_chars,
  min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY ROLLUP (conv_id)""")
def session_inventory(spark, d):
    return replay.inventory(_turns(spark, d))


@query("""WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY sha256(event_id || ':7'), event_id) AS k FROM events) SELECT event_id FROM r WHERE k <= 200""")
def stratified_sample(spark, d):
    return replay.sample(read(spark, d, "events"), "user_id", "event_id", 200, 7).select("event_id")


@query(f"""WITH {SQL_SESSION}, f AS (SELECT session_id, turn, k % 3 AS signature FROM se WHERE kind = 'error'),
n AS (SELECT *, count(*) OVER (PARTITION BY session_id, signature ORDER BY turn RANGE BETWEEN 19 PRECEDING AND CURRENT ROW) AS n FROM f) SELECT DISTINCT session_id, turn, signature, n FROM n WHERE n >= 3""")
def signature_recurrence(spark, d):
    f = session_events(spark, d).where("kind = 'error'").withColumn("signature", F.col("k") % 3)
    return replay.recurring_signatures(f)


@query(f"""WITH {SQL_SESSION}, t AS (SELECT session_id, turn, CASE WHEN kind = 'error' THEN k % 2 END AS s, kind = 'purchase' AND k > 60 AS ed FROM se),
j AS (SELECT a.session_id, a.turn, a.s, count(*) FILTER (b.s = a.s) AS n, min(b.turn) FILTER (b.s = a.s) AS f FROM t a JOIN t b ON b.session_id = a.session_id AND b.turn BETWEEN a.turn - 9 AND a.turn WHERE a.s IS NOT NULL GROUP BY ALL)
SELECT session_id, turn, s AS signature FROM j WHERE n >= 3 AND NOT EXISTS (SELECT 1 FROM t e WHERE e.session_id = j.session_id AND e.ed AND e.turn > j.f AND e.turn < j.turn)""")
def failure_loops(spark, d):
    e = session_events(spark, d)
    return replay.failure_loops(e.select("session_id", "turn", F.when(F.col("kind") == "error", F.col("k") % 2).alias("signature"), ((F.col("kind") == "purchase") & (F.col("k") > 60)).alias("is_edit")))


SQL_VERDICT = SQL_SESSION + """, q AS (SELECT session_id, ts, turn FROM se WHERE kind = 'purchase'),
tl AS (SELECT session_id, ts AS seen_at, CASE kind WHEN 'signup' THEN 'born' WHEN 'view' THEN 'refreshed' ELSE 'retired' END AS event FROM se WHERE kind IN ('signup', 'view', 'error')),
al AS (SELECT q.session_id, q.ts, arg_max(event, seen_at) AS event, max(seen_at) FILTER (event IN ('born', 'refreshed')) AS last_refresh FROM q JOIN tl ON tl.session_id = q.session_id AND seen_at <= q.ts GROUP BY ALL),
vd AS (SELECT q.session_id, q.turn, CASE WHEN event IS NULL OR event = 'retired' THEN 'NOT_APPLICABLE' WHEN floor(epoch(q.ts)) - floor(epoch(last_refresh)) > 36000 THEN 'SUPPRESS' ELSE 'ALLOW' END AS verdict FROM q LEFT JOIN al USING (session_id, ts))"""


def _verdicts(spark, d):
    e = session_events(spark, d)
    points = e.where("kind = 'purchase'").select("session_id", "ts", "turn")
    kinds = F.when(F.col("kind") == "signup", "born").when(F.col("kind") == "view", "refreshed").otherwise("retired")
    lines = e.where("kind in ('signup', 'view', 'error')").select("session_id", F.lit("deploy").alias("belief_name"), kinds.alias("event"), "ts")
    alive = replay.active_as_of(points.select("session_id", "ts"), lines)
    return replay.stale_verdicts(points, alive, 36000), e


@query(f"WITH {SQL_VERDICT} SELECT session_id, turn, verdict FROM vd")
def intervention_verdicts(spark, d):
    return _verdicts(spark, d)[0].select("session_id", "turn", "verdict")


@query(f"""WITH {SQL_VERDICT}, a AS (SELECT se.session_id, se.turn, verdict, max((kind = 'error' AND k > 50)::INT) OVER (PARTITION BY se.session_id ORDER BY se.turn ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS p
  FROM se LEFT JOIN vd USING (session_id, turn)), l AS (SELECT verdict AS rule, CASE WHEN p IS NULL THEN 'u' WHEN verdict = 'SUPPRESS' THEN CASE WHEN p = 1 THEN 'tp' ELSE 'fp' END ELSE CASE WHEN p = 1 THEN 'fn' ELSE 'tn' END END AS label FROM a WHERE verdict IS NOT NULL),
c AS (SELECT rule, count(*) FILTER (label = 'tp') AS tp, count(*) FILTER (label = 'fp') AS fp, count(*) FILTER (label = 'fn') AS fn, count(*) FILTER (label = 'tn') AS tn, count(*) FILTER (label = 'u') AS uncertain FROM l GROUP BY 1)
SELECT rule, tp, fp, fn, tn, uncertain, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS detection, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END, 6) AS fpr FROM c""")
def outcome_confusion(spark, d):
    v, e = _verdicts(spark, d)
    rows = e.join(v.select("session_id", "turn", "verdict"), ["session_id", "turn"], "left").withColumn("is_problem", (F.col("kind") == "error") & (F.col("k") > 50))
    labels = replay.label_outcomes(rows).where("verdict is not null").withColumnRenamed("verdict", "rule")
    out = replay.confusion(labels, "rule")
    return out.withColumns({"detection": F.round("detection", 6), "fpr": F.round("fpr", 6)})


@query(f"""WITH {SQL_SESSION}, e AS (SELECT session_id, k % 2 AS name, ts, CASE kind WHEN 'signup' THEN 'born' WHEN 'view' THEN 'refreshed' WHEN 'purchase' THEN 'retired' WHEN 'error' THEN 'contradicted' END AS kind FROM se WHERE kind <> 'click'),
g AS (SELECT *, floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) AS gap, lag(kind) OVER w AS before FROM e WINDOW w AS (PARTITION BY session_id, name ORDER BY ts, kind)),
s AS (SELECT *, sum((kind IN ('born', 'refreshed') AND (before IS NULL OR before IN ('retired', 'contradicted') OR coalesce(gap > -40000 * ln(0.3) / 0.6931471805599453, false)))::INT) OVER (PARTITION BY session_id, name ORDER BY ts, kind) AS episode FROM g)
SELECT session_id, name, cast(episode AS BIGINT) AS episode, min(ts) AS birth_ts, count(*) FILTER (kind IN ('born', 'refreshed')) AS n_refreshes,
  CASE WHEN arg_max(kind, ts) IN ('retired', 'contradicted') THEN arg_max(kind, ts) ELSE 'stale' END AS ended_by FROM s WHERE episode > 0 GROUP BY ALL""")
def decaying_tracker(spark, d):
    e = session_events(spark, d).where("kind <> 'click'")
    kinds = F.create_map(*map(F.lit, ["signup", "born", "view", "refreshed", "purchase", "retired", "error", "contradicted"]))
    rows = e.select("session_id", (F.col("k") % 2).alias("name"), "ts", kinds[F.col("kind")].alias("kind"))
    return replay.track(rows, 40000.0).select("session_id", "name", "episode", "birth_ts", "n_refreshes", "ended_by")


@query(f"""WITH {SQL_SESSION}, ev AS (SELECT session_id, CASE k % 2 WHEN 0 THEN 'pipeline_running' ELSE 'report_ready' END AS belief_name, k % 5 AS anchor, ts, CASE kind WHEN 'signup' THEN 'born' WHEN 'view' THEN 'refreshed' WHEN 'error' THEN 'retired' END AS event FROM se WHERE kind IN ('signup', 'view', 'error')),
pt AS (SELECT session_id, ts FROM se WHERE kind = 'purchase' AND k % 4 = 0),
st AS (SELECT p.session_id, p.ts, belief_name, anchor, min(e.ts) FILTER (event = 'born') AS birth_ts, max(e.ts) FILTER (event IN ('born', 'refreshed')) AS last_refresh, count(*) AS n_events, max((event = 'retired')::INT) AS ended FROM pt p JOIN ev e ON e.session_id = p.session_id AND e.ts <= p.ts GROUP BY ALL HAVING min(e.ts) FILTER (event = 'born') IS NOT NULL),
wt AS (SELECT *, CASE WHEN ended = 1 THEN 0 ELSE exp(-0.6931471805599453 * (epoch_us(ts) - epoch_us(last_refresh)) / 1e6 / CASE belief_name WHEN 'pipeline_running' THEN 1800 ELSE 14400 END) END AS weight FROM st),
ss AS (SELECT *, CASE WHEN ended = 1 THEN 'retired_before' WHEN weight < 0.3 THEN 'stale' ELSE 'active' END AS status FROM wt)
SELECT session_id, ts, belief_name, anchor, n_events, round(weight, 6) AS weight, status, row_number() OVER (PARTITION BY session_id, ts, belief_name, status ORDER BY last_refresh DESC, anchor) = 1 AS latest FROM ss""")
def belief_states(spark, d):
    from ..operators.timelines import HALF_LIFE

    e = session_events(spark, d)
    k, kinds = F.col("k"), F.create_map(*map(F.lit, ["signup", "born", "view", "refreshed", "error", "retired"]))
    events = e.where("kind in ('signup', 'view', 'error')").select("session_id", F.when(k % 2 == 0, "pipeline_running").otherwise("report_ready").alias("belief_name"), (k % 5).alias("anchor"), kinds[F.col("kind")].alias("event"), "ts")
    states = replay.states_at(e.where("kind = 'purchase' and k % 4 = 0"), events, HALF_LIFE)
    every = None
    for status in ("active", "stale", "retired_before"):
        own, last = states.where(F.col("status") == status), replay.latest_at(states, (status,)).select("session_id", "ts", "belief_name", "anchor", F.lit(True).alias("latest"))
        part = own.join(last, ["session_id", "ts", "belief_name", "anchor"], "left").withColumn("latest", F.coalesce("latest", F.lit(False)))
        every = part if every is None else every.unionByName(part)
    return every.select("session_id", "ts", "belief_name", "anchor", "n_events", F.round("weight", 6).alias("weight"), "status", "latest")
