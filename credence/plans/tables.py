"""Views of the driver's tables in the shapes the operators take, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def k_of():
    return F.get_json_object("props", "$.k").cast("int")


def evidence(spark, sf_dir) -> DataFrame:
    """Events with a region (user_id modulo 8), an outcome (event_type) and their order."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", "value", (F.col("user_id") % 8).alias("region_id"), F.col("event_type").alias("outcome"), k_of().alias("k"), F.struct("ts", "event_id").alias("ord"))


def session_events(spark, sf_dir) -> DataFrame:
    """Events as a session's: session_id, turn (dense by order), kind and k."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("session_id"), (F.row_number().over(w) - 1).cast("long").alias("turn"), "ts", F.col("event_type").alias("kind"), "value", k_of().cast("long").alias("k"), "props")


TYPES = ["validation_pending", "user_approval_pending", "pipeline_failed", "fix_attempted", "report_ready"]
KIND = {"signup": "born", "view": "refreshed", "click": "confirmed", "error": "contradicted", "purchase": "retired"}


def ledger(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(beliefs, belief events): a belief for each session and k modulo 5."""
    e = session_events(spark, sf_dir)
    of = lambda values, i: F.element_at(F.array(*map(F.lit, values)), i.cast("int") + 1)
    kinds = F.create_map(*(F.lit(x) for pair in KIND.items() for x in pair))
    events = e.select(
        F.col("event_id").alias("belief_event_id"), "session_id", (F.col("session_id") * 100 + F.col("k") % 5).alias("belief_id"), kinds[F.col("kind")].alias("kind"),
        F.col("turn").alias("at_turn"), F.when(F.col("kind") == "error", F.col("turn") - F.col("k") % 3).alias("effective_turn"), of(["assistant", "user", "tool"], F.col("k") % 3).alias("authority"),
    )
    beliefs = events.groupBy("belief_id", "session_id").agg(F.min("at_turn").alias("created_turn"))
    beliefs = beliefs.withColumns({"belief_type": of(TYPES, F.col("belief_id") % 100), "claim": F.concat(F.lit("claim "), F.col("belief_id").cast("string"))})
    return beliefs, events


SQL_EVIDENCE = """ev AS (SELECT event_id, ts, user_id, value, user_id % 8 AS region_id, event_type AS outcome,
  cast(json_extract_string(props, '$.k') AS INT) AS k, row_number() OVER (ORDER BY ts, event_id) AS ord FROM events)"""
SQL_SESSION = """se AS (SELECT event_id, user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS turn, ts,
  event_type AS kind, value, cast(json_extract_string(props, '$.k') AS BIGINT) AS k, props FROM events)"""
SQL_LEDGER = SQL_SESSION + """,
be AS (SELECT event_id AS belief_event_id, session_id, session_id * 100 + k % 5 AS belief_id,
  CASE kind WHEN 'signup' THEN 'born' WHEN 'view' THEN 'refreshed' WHEN 'click' THEN 'confirmed' WHEN 'error' THEN 'contradicted' ELSE 'retired' END AS kind,
  turn AS at_turn, CASE WHEN kind = 'error' THEN turn - k % 3 END AS effective_turn,
  CASE k % 3 WHEN 0 THEN 'assistant' WHEN 1 THEN 'user' ELSE 'tool' END AS authority,
  coalesce(CASE WHEN kind = 'error' THEN turn - k % 3 END, turn) AS eff FROM se),
b AS (SELECT belief_id, session_id, min(at_turn) AS created_turn,
  CASE belief_id % 100 WHEN 0 THEN 'validation_pending' WHEN 1 THEN 'user_approval_pending' WHEN 2 THEN 'pipeline_failed' WHEN 3 THEN 'fix_attempted' ELSE 'report_ready' END AS belief_type,
  'claim ' || belief_id AS claim FROM be GROUP BY ALL)"""
SQL_STATE = SQL_LEDGER + """,
seen AS (SELECT * FROM be WHERE eff <= {turn}),
last AS (SELECT belief_id, arg_max(kind, {{'a': eff, 'b': at_turn, 'c': belief_event_id}}) AS kind, arg_max(at_turn, {{'a': eff, 'b': at_turn, 'c': belief_event_id}}) AS last_updated_turn,
  max(CASE authority WHEN 'tool' THEN 3 WHEN 'user' THEN 2 ELSE 1 END) AS rank_authority,
  list_sort(list(eff) FILTER (kind IN ('born', 'refreshed', 'confirmed'))) AS warrants FROM seen GROUP BY 1),
st AS (SELECT b.*, last.last_updated_turn, CASE rank_authority WHEN 3 THEN 'tool' WHEN 2 THEN 'user' ELSE 'assistant' END AS authority, rank_authority,
  coalesce(warrants, []) AS warrants, CASE WHEN kind IN ('born', 'refreshed', 'confirmed') THEN 'active' ELSE kind END AS state
  FROM b JOIN last USING (belief_id) WHERE created_turn <= {turn})"""
