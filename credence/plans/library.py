"""Regions, hypotheses, calibration, lifecycle and decisions over events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import belief
from ..operators import regions
from . import query
from .tables import SQL_EVIDENCE, evidence, read

SQL_SPLIT = "sp AS (SELECT ts AS split_at FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS r, count(*) OVER () AS n FROM events) WHERE r = floor(n * 0.7) + 1)"
SQL_DIST = """c AS (SELECT region_id, outcome, count(*) AS n, min(ord) AS f FROM {train} GROUP BY ALL),
d AS (SELECT region_id, outcome, n, sum(n) OVER (PARTITION BY region_id) AS total, row_number() OVER (PARTITION BY region_id ORDER BY n DESC, f) AS rank FROM c)"""
SQL_CAL = """h AS (SELECT region_id, max(total) AS n_train, max(CASE WHEN rank = 1 THEN outcome END) AS direction, list(outcome) AS outs, sum((n / total) * (n / total)) AS sq FROM d WHERE rank <= 3 GROUP BY 1),
t AS (SELECT h.region_id, h.n_train, h.direction, h.outs, h.sq, e.outcome, coalesce(d.n / d.total, 0) AS p FROM h LEFT JOIN {test} e USING (region_id)
  LEFT JOIN d ON d.region_id = h.region_id AND d.outcome = e.outcome AND d.rank <= 3),
cal AS (SELECT region_id, any_value(n_train) AS n_train, count(outcome) AS n_test, avg(CASE WHEN outcome IS NOT NULL THEN (direction = outcome)::INT END) AS top1,
  avg(CASE WHEN outcome IS NOT NULL THEN list_contains(outs, outcome)::INT END) AS top3, avg(CASE WHEN outcome IS NOT NULL THEN sq - 2 * p + 1 END) AS brier FROM t GROUP BY 1)"""
TRAIN = "(SELECT ev.* FROM ev, sp WHERE ts < split_at)"
TEST = "(SELECT ev.* FROM ev, sp WHERE ts >= split_at)"


def _split(spark, d):
    e = evidence(spark, d)
    at = F.broadcast(regions.split_point(e))
    both = e.crossJoin(at)
    return both.where("ts < split_at").drop("split_at"), both.where("ts >= split_at").drop("split_at")


@query(f"WITH {SQL_EVIDENCE}, {SQL_SPLIT} SELECT split_at FROM sp")
def chronological_split(spark, d):
    return regions.split_point(evidence(spark, d))


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00'")
def date_range_filter(spark, d):
    return regions.date_range(read(spark, d, "events"), "2024-01-05 00:00:00", "2024-01-12 00:00:00").select("event_id", "event_type")


@query(f"WITH {SQL_EVIDENCE}, {SQL_SPLIT}, {SQL_DIST.format(train=TRAIN)} SELECT region_id, outcome, n, round(n / total, 6) AS prob, rank FROM d")
def region_outcome_dist(spark, d):
    return regions.outcome_distribution(_split(spark, d)[0], "ord").select("region_id", "outcome", "n", F.round("prob", 6).alias("prob"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {SQL_EVIDENCE}, {SQL_SPLIT}, {SQL_DIST.format(train=TRAIN)} SELECT region_id, cast(max(total) AS BIGINT) AS n_train, max(CASE WHEN rank = 1 THEN outcome END) AS direction,
  round(max(CASE WHEN rank = 1 THEN n / total END), 6) AS conviction, string_agg(outcome, ',' ORDER BY rank) AS top3 FROM d WHERE rank <= 3 GROUP BY 1""")
def hypothesis_top3(spark, d):
    h = regions.hypotheses(regions.outcome_distribution(_split(spark, d)[0], "ord"))
    return h.select("region_id", "n_train", "direction", F.round("conviction", 6).alias("conviction"), F.array_join(F.transform("top3", lambda x: x["outcome"]), ",").alias("top3"))


def _calibration(spark, d):
    train, test = _split(spark, d)
    return regions.calibrate(regions.hypotheses(regions.outcome_distribution(train, "ord")), test)


@query(f"""WITH {SQL_EVIDENCE}, {SQL_SPLIT}, {SQL_DIST.format(train=TRAIN)}, {SQL_CAL.format(test=TEST)}
SELECT region_id, cast(n_train AS BIGINT) AS n_train, n_test, round(top1, 6) AS top1_accuracy, round(top3, 6) AS top3_accuracy, round(brier, 6) AS brier_score FROM cal""")
def region_calibration(spark, d):
    return _calibration(spark, d).select("region_id", "n_train", "n_test", F.round("top1", 6).alias("top1_accuracy"), F.round("top3", 6).alias("top3_accuracy"), F.round("brier", 6).alias("brier_score"))


A, B = "2024-01-11 00:00:00", "2024-01-21 00:00:00"
SQL_TWO = f"""WITH {SQL_EVIDENCE}, a AS (WITH {SQL_DIST.format(train=f"(SELECT * FROM ev WHERE ts < TIMESTAMP '{A}')")}, {SQL_CAL.format(test=f"(SELECT * FROM ev WHERE ts >= TIMESTAMP '{A}' AND ts < TIMESTAMP '{B}')")} SELECT region_id, top1 AS prior_top1 FROM cal),
b AS (WITH {SQL_DIST.format(train=f"(SELECT * FROM ev WHERE ts < TIMESTAMP '{B}')")}, {SQL_CAL.format(test=f"(SELECT * FROM ev WHERE ts >= TIMESTAMP '{B}')")} SELECT * FROM cal),
base AS (SELECT max(n) / sum(n) AS baseline FROM (SELECT count(*) AS n FROM ev WHERE ts >= TIMESTAMP '{B}' GROUP BY outcome)),
l AS (SELECT b.*, prior_top1, baseline, CASE WHEN n_test < 5 THEN 'retired' WHEN top1 < baseline THEN 'contradicted' WHEN top1 - prior_top1 >= 0.05 THEN 'strengthened'
  WHEN top1 - prior_top1 <= -0.05 THEN 'weakened' WHEN prior_top1 IS NULL AND top1 IS NOT NULL THEN 'strengthened' ELSE 'born' END AS to_state FROM b LEFT JOIN a USING (region_id), base)"""


@query(SQL_TWO + " SELECT region_id, n_test, round(top1, 6) AS top1, round(prior_top1, 6) AS prior_top1, to_state FROM l")
def lifecycle_two_pass(spark, d):
    out = regions.two_passes(evidence(spark, d), A, B, "ord")
    return out.select("region_id", "n_test", F.round("top1", 6).alias("top1"), F.round("prior_top1", 6).alias("prior_top1"), "to_state")


@query(SQL_TWO + """ SELECT region_id, CASE WHEN to_state = 'retired' THEN 'RETIRE' WHEN to_state = 'inverted' THEN 'INVERT' WHEN region_id = 3 THEN 'ESCALATE' WHEN top1 IS NULL OR n_test = 0 THEN 'INTERVENE'
  WHEN top1 < 0.2 THEN 'RECLUSTER' WHEN top1 < 0.5 THEN 'MONITOR' WHEN top1 >= 0.75 AND n_test >= 10 THEN 'PROMOTE' ELSE 'MONITOR' END AS decision FROM l""")
def region_decision(spark, d):
    rows = regions.two_passes(evidence(spark, d), A, B, "ord").withColumn("label", F.concat(F.lit("r"), F.col("region_id").cast("string")))
    return regions.decide(rows, belief.DecisionThresholds(escalate_labels=("r3",))).select("region_id", "decision")


@query(SQL_TWO + """ , d AS (SELECT *, CASE WHEN to_state = 'retired' THEN 'RETIRE' WHEN to_state = 'inverted' THEN 'INVERT' WHEN region_id = 3 THEN 'ESCALATE' WHEN top1 IS NULL OR n_test = 0 THEN 'INTERVENE'
  WHEN top1 < 0.2 THEN 'RECLUSTER' WHEN top1 < 0.5 THEN 'MONITOR' WHEN top1 >= 0.75 AND n_test >= 10 THEN 'PROMOTE' ELSE 'MONITOR' END AS decision FROM l)
SELECT region_id, decision, 'lifecycle: ' || to_state || CASE WHEN decision = 'RETIRE' THEN '; n_test=' || n_test WHEN decision = 'INVERT' THEN '' WHEN decision = 'ESCALATE' THEN '; label ''r3'' is high-severity' WHEN decision = 'INTERVENE' THEN '; no labeled test data available' ELSE '; top1=' || printf('%.2f', top1) || ', n_test=' || n_test END
  || CASE WHEN decision = 'RECLUSTER' THEN '; top1 ' || printf('%.2f', top1) || ' below recluster floor 0.20' WHEN decision = 'PROMOTE' THEN '; meets promote thresholds' WHEN decision = 'MONITOR' AND top1 >= 0.5 THEN '; does not yet clear promote thresholds' ELSE '' END AS reasons,
  CASE decision WHEN 'RETIRE' THEN 'stop scoring this region; reassess if evidence returns' WHEN 'INVERT' THEN 'flip the prior; reality is the inverse of what we thought' WHEN 'ESCALATE' THEN 'raise to senior approver; human review required' WHEN 'INTERVENE' THEN 'collect more outcomes before any automated action'
   WHEN 'RECLUSTER' THEN 'region is incoherent; refit clusters or increase k' WHEN 'PROMOTE' THEN 'treat as trusted region; route automatic decisions through it' ELSE CASE WHEN top1 < 0.5 THEN 'watch; do not promote until calibration improves' ELSE 'watch; revisit after more test observations accumulate' END END AS action FROM d""")
def region_decision_record(spark, d):
    rows = regions.two_passes(evidence(spark, d), A, B, "ord").withColumn("label", F.concat(F.lit("r"), F.col("region_id").cast("string")))
    x = belief.decision_record(F.col("to_state"), F.col("reason"), F.col("label"), F.col("top1"), F.col("n_test"), belief.DecisionThresholds(escalate_labels=("r3",)))
    said = F.transform(x["reasons"], lambda r: F.regexp_replace(r, r" \(.*\)$", ""))  # the life cycle's own reason is told by its own query
    return rows.select("region_id", x["decision"].alias("decision"), F.array_join(said, "; ").alias("reasons"), x["action"].alias("action"))


@query("""WITH v AS (SELECT source AS region_id, doc_id, lang AS label FROM documents), c AS (SELECT region_id, label, count(*) AS n, min(doc_id) AS f FROM v GROUP BY ALL)
SELECT region_id, label, n FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY n DESC, f, label) AS r FROM c) WHERE r = 1""")
def region_label_mode(spark, d):
    docs = read(spark, d, "documents").select(F.col("source").alias("region_id"), "doc_id", "lang")
    return regions.label_mode(docs, ["lang"], "doc_id")


@query("""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(v) AS c FROM x GROUP BY ALL), p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT vec_id, m.label, sum((v - c) * (v - c)) AS d FROM p JOIN m USING (i) GROUP BY ALL)
SELECT vec_id, cast(arg_min(label, d) AS INT) AS region_id, round(sqrt(min(d)), 4) AS distance FROM s GROUP BY 1""")
def nearest_centroid(spark, d):
    e = read(spark, d, "embeddings")
    c = regions.centroids(e, "label").withColumnRenamed("label", "region_id")
    return regions.nearest_centroid(e, c, "vec_id").select("vec_id", F.col("region_id").cast("int").alias("region_id"), F.round("distance", 4).alias("distance"))


@query()
def kmeans_regions(spark, d):
    return regions.fit_regions(read(spark, d, "embeddings"), 10)[1].select("vec_id", "region_id")


@query()
def mock_embed(spark, d):
    return regions.mock_embed(read(spark, d, "documents"), "doc_id")


@query("""SELECT event_id, round(CASE WHEN date_diff('second', ts, TIMESTAMP '2024-01-20 00:00:00') <= 0 THEN 0.9
  ELSE 0.9 * exp(-0.6931471805599453 * date_diff('second', ts, TIMESTAMP '2024-01-20 00:00:00') / 86400.0) END, 6) AS weight FROM events""")
def warrant_decay(spark, d):
    age = F.unix_seconds(F.lit("2024-01-20 00:00:00").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))
    return read(spark, d, "events").select("event_id", F.round(belief.decayed(F.lit(0.9), age, F.lit(86400.0)), 6).alias("weight"))


@query("""WITH w AS (SELECT event_id, event_type, CASE WHEN date_diff('second', ts, TIMESTAMP '2024-01-20 00:00:00') <= 0 THEN 0.9
  ELSE 0.9 * exp(-0.6931471805599453 * date_diff('second', ts, TIMESTAMP '2024-01-20 00:00:00') / 86400.0) END AS weight FROM events)
SELECT event_type, count(*) AS n, count(*) FILTER (weight >= 0.1) AS n_active FROM w GROUP BY 1""")
def belief_active(spark, d):
    age = F.unix_seconds(F.lit("2024-01-20 00:00:00").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))
    live = belief.is_active(belief.decayed(F.lit(0.9), age, F.lit(86400.0)))
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(live).alias("n_active"))


@query("""SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click') THEN 'unknown warrant type' WHEN value / 100 NOT BETWEEN 0 AND 1 THEN 'confidence outside [0, 1]'
  WHEN event_type = 'view' AND NOT coalesce(cast(json_extract_string(props, '$.k') AS INT) % 7 > 0, false) THEN 'half-life must be positive' END AS fault FROM events""")
def warrant_faults(spark, d):
    e = read(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "decaying").when(F.col("event_type") == "click", "invariant").otherwise("other")
    half = F.get_json_object("props", "$.k").cast("int") % 7
    return e.select("event_id", belief.warrant_fault(kind, F.col("value") / 100, half, F.lit("PASS")).alias("fault"))
