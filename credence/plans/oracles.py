"""Oracle labels and interventions over events as sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import operational, oracles
from . import query
from .tables import SQL_SESSION, session_events

NAMES = ["validation_pending", "action_blocked", "pipeline_running", "pipeline_failed", "fix_attempted", "report_ready"]

#: A view gives birth to a belief that lives k % 13 turns (or stays, where that is 0); errors fail, purchases propose, signups validate.
SQL_ORACLE = SQL_SESSION + f""",
bf AS (SELECT session_id, {NAMES}[k % 6 + 1] AS name, turn AS b, CASE WHEN k % 13 > 0 THEN turn + k % 13 END AS r, CASE WHEN k % 13 > 9 THEN turn + k % 13 END AS c FROM se WHERE kind = 'view'),
pt AS (SELECT session_id, turn AS t FROM se WHERE turn % 3 = 0), lt AS (SELECT session_id, max(turn) AS lt FROM se GROUP BY 1), vc AS (SELECT session_id, turn FROM se WHERE kind = 'signup'),
lp AS (SELECT session_id, k % 4 AS s, turn, lag(turn, 2) OVER (PARTITION BY session_id, k % 4 ORDER BY turn) AS th FROM se WHERE kind = 'error'),
fx AS (SELECT DISTINCT session_id, b, r, (SELECT min(turn) FROM vc WHERE vc.session_id = bf.session_id AND turn >= b) AS v0, (SELECT min(turn) FROM vc WHERE vc.session_id = bf.session_id AND turn > b) AS v1 FROM bf WHERE name = 'fix_attempted'),
a1 AS (SELECT pt.session_id, t, count(name) AS n, count(name) FILTER (name IN ('user_approval_pending', 'validation_pending', 'pipeline_failed', 'pipeline_running', 'action_blocked')) AS bl, count(DISTINCT name) FILTER (name IN ('validation_pending', 'user_approval_pending', 'pipeline_running', 'pipeline_failed', 'action_blocked')) AS pn,
  count(name) FILTER (name IN ('validation_pending', 'user_approval_pending', 'pipeline_running', 'pipeline_failed', 'action_blocked')) AS pc FROM pt LEFT JOIN bf ON bf.session_id = pt.session_id AND b <= t AND (r IS NULL OR r > t) GROUP BY ALL),
a2 AS (SELECT pt.session_id, t, max({{'b': b, 'v': v0}}) AS f, count(b) FILTER (v1 IS NULL OR v1 > t) AS op FROM pt LEFT JOIN fx ON fx.session_id = pt.session_id AND b <= t AND (r IS NULL OR r > t) GROUP BY ALL),
a3 AS (SELECT pt.session_id, t, count(turn) FILTER (kind = 'error') AS er, count(turn) FILTER (kind = 'purchase' AND turn > t - 5) AS pr FROM pt LEFT JOIN se ON se.session_id = pt.session_id AND turn BETWEEN t - 19 AND t GROUP BY ALL),
a4 AS (SELECT pt.session_id, t, count(th) AS lo FROM pt LEFT JOIN lp ON lp.session_id = pt.session_id AND turn <= t AND th > t - 20 GROUP BY ALL), a5 AS (SELECT pt.session_id, t, count(c) AS co FROM pt LEFT JOIN bf ON bf.session_id = pt.session_id AND c BETWEEN t - 19 AND t GROUP BY ALL),
al AS (SELECT *, pr > 0 AND bl > 0 AS blocked, lo > 0 OR pn >= 2 OR co > 0 OR (pr > 0 AND bl > 0) AS pause, least(t + 20, lt) AS h FROM a1 JOIN a2 USING (session_id, t) JOIN a3 USING (session_id, t) JOIN a4 USING (session_id, t) JOIN a5 USING (session_id, t) JOIN lt USING (session_id)),
sc AS (SELECT session_id, t AS turn, 'validation_check' AS category, CASE WHEN f IS NULL OR f.b IS NULL THEN NULL WHEN f.v <= h THEN 'NEGATIVE' WHEN h < t + 20 THEN NULL ELSE 'POSITIVE' END AS oracle_class, CASE WHEN f IS NULL OR f.b IS NULL THEN NULL WHEN f.v <= h THEN 'validation_happened' WHEN h < t + 20 THEN 'indeterminate' ELSE 'validation_did_not_happen' END AS oracle_state FROM al
  UNION ALL SELECT session_id, t, 'repeated_failure', CASE WHEN er = 0 THEN NULL WHEN lo > 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END, CASE WHEN er = 0 THEN NULL WHEN lo > 0 THEN 'loop_present' ELSE 'no_loop' END FROM al
  UNION ALL SELECT session_id, t, 'approval_status', CASE WHEN pr = 0 THEN NULL WHEN blocked THEN 'POSITIVE' ELSE 'NEGATIVE' END, CASE WHEN pr = 0 THEN NULL WHEN blocked THEN 'action_blocked' ELSE 'action_ready' END FROM al
  UNION ALL SELECT session_id, t, 'completion_check', CASE WHEN n = 0 THEN NULL WHEN pc + op > 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END, CASE WHEN n = 0 THEN NULL WHEN pc + op > 0 THEN 'incomplete' ELSE 'complete' END FROM al
  UNION ALL SELECT session_id, t, 'readiness_check', CASE WHEN pause THEN 'POSITIVE' WHEN n = 0 THEN NULL ELSE 'NEGATIVE' END, CASE WHEN pause THEN 'should_pause' WHEN n = 0 THEN NULL ELSE 'should_proceed' END FROM al)"""


@query(f"WITH {SQL_ORACLE} SELECT session_id, turn, category, CASE WHEN oracle_class IS NULL THEN 'NA' ELSE 'APPLICABLE' END AS applicability, oracle_class, oracle_state FROM sc")
def oracle_scores(spark, d):
    e = session_events(spark, d)
    k, t, life = F.col("k"), F.col("turn"), F.col("k") % 13
    b = e.where("kind = 'view'").select("session_id", F.element_at(F.array(*map(F.lit, NAMES)), (k % 6).cast("int") + 1).alias("belief_name"), t.alias("birth_turn"), F.when(life > 0, t + life).alias("retired_turn"), F.when(life > 9, t + life).alias("contradicted_turn"))
    kind = F.col("kind")
    turns = e.select("session_id", "turn", (kind == "purchase").alias("proposes"), (kind == "error").alias("error"), F.when(kind == "error", k % 4).alias("signature"), (kind == "signup").alias("validated"))
    return oracles.score(e.where("turn % 3 = 0"), b, turns).drop("metric")


@query(f"""WITH {SQL_ORACLE}, n AS (SELECT session_id, turn, row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM se),
p AS (SELECT session_id, turn, s.share FROM n, (VALUES (0.25), (0.5), (0.75)) AS s(share) WHERE n >= 10 AND i = floor(n * s.share))
SELECT share::DOUBLE AS share, category, CASE WHEN oracle_class IS NULL THEN 'NA' ELSE 'APPLICABLE' END AS applicability, oracle_class, count(*) AS n FROM p JOIN sc USING (session_id, turn) GROUP BY ALL""")
def oracle_audit(spark, d):
    points = operational.audit_points(session_events(spark, d))
    return operational.audit(points, oracle_scores(spark, d))


SQL_RULES = SQL_SESSION + """,
x AS (SELECT session_id, turn, kind = 'purchase' AS dep, kind = 'click' AS chk, kind = 'error' AS er, CASE WHEN k % 5 = 0 THEN 'FAIL' END AS vs, k % 2 = 0 AS da, k % 3 > 0 AS aa, k % 4 = 0 AS fa, k % 7 > 1 AS pa, CASE WHEN k % 11 > 0 THEN (k % 11) / 11 END AS w, (k % 60) * 60 AS age FROM se),
r AS (SELECT session_id, turn, 'stale_deploy_prior' AS rule, CASE WHEN dep THEN CASE WHEN da AND aa AND coalesce(w >= 0.7, false) THEN 'SUPPRESS' ELSE 'ALLOW' END END AS verdict FROM x
  UNION ALL SELECT session_id, turn, 'stale_pipeline_prior', CASE WHEN NOT chk AND pa THEN CASE WHEN age > 1800 THEN 'SUPPRESS' ELSE 'ALLOW' END END FROM x UNION ALL SELECT session_id, turn, 'contradicted_fix_prior', CASE WHEN fa AND (vs = 'FAIL' OR er) THEN 'SUPPRESS' END FROM x)"""


@query(f"WITH {SQL_RULES} SELECT session_id, turn, rule, verdict FROM r WHERE verdict IS NOT NULL")
def intervention_rules(spark, d):
    k, kind = F.col("k"), F.col("kind")
    e = session_events(spark, d).select(
        "session_id", "turn", "ts", (kind == "purchase").alias("is_deploy"), (kind == "click").alias("is_status_check"), (kind == "error").alias("has_error"), F.when(k % 5 == 0, "FAIL").alias("validation_status"), (k % 2 == 0).alias("deploy_active"), (k % 3 > 0).alias("approval_active"),
        (k % 4 == 0).alias("fix_active"), (k % 7 > 1).alias("pipeline_active"), F.when(k % 11 > 0, (k % 11) / 11).alias("approval_weight"), (F.col("ts") - F.make_dt_interval(mins=(k % 60).cast("int"))).alias("pipeline_refresh"),
    )
    return oracles.interventions(e).drop("intervention_action")
