"""Outcome studies over orders: weekly average prices by nation, against all nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import studies
from . import query
from .tables import read

SQL_PRICES = """pr AS (SELECT c_nationkey AS ticker, date_trunc('week', o_orderdate) AS date, avg(o_totalprice) AS close FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
bm AS (SELECT date_trunc('week', o_orderdate) AS date, avg(o_totalprice) AS close FROM orders GROUP BY 1)"""
SQL_REL = SQL_PRICES + """,
f AS (SELECT *, lead(close, 5) OVER w / close - 1 AS fwd_5, lead(close, 20) OVER w / close - 1 AS fwd_20 FROM pr WINDOW w AS (PARTITION BY ticker ORDER BY date)),
g AS (SELECT date, lead(close, 5) OVER w / close - 1 AS ref_5, lead(close, 20) OVER w / close - 1 AS ref_20 FROM bm WINDOW w AS (ORDER BY date)),
rr AS (SELECT f.*, fwd_5 - ref_5 AS rel_5, fwd_20 - ref_20 AS rel_20, CASE ticker % 3 WHEN 0 THEN 'Constructive' WHEN 1 THEN 'Cautious' ELSE 'Ambiguous' END AS bucket, 's' || ticker % 5 AS state FROM f LEFT JOIN g USING (date))"""
METRICS = "count({0}) AS n, round(avg({0}), 6) AS mean, round(median({0}), 6) AS median, round(avg(({0} > 0)::INT), 6) AS share_up"
REGIME = """s AS (SELECT *, close / lag(close) OVER (ORDER BY date) - 1 AS change FROM bm),
v AS (SELECT *, CASE WHEN count(change) OVER w >= 20 THEN stddev_samp(change) OVER w END AS vol FROM s WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
rg AS (SELECT date, vol, CASE WHEN vol > (SELECT quantile_cont(vol, 0.5) FROM v) THEN 'high' WHEN vol IS NOT NULL THEN 'low' END AS regime FROM v)"""


def _prices(spark, d):
    orders, customer = read(spark, d, "orders"), read(spark, d, "customer")
    week = F.date_trunc("week", "o_orderdate").cast("timestamp_ntz").alias("date")
    j = orders.select("o_custkey", "o_orderdate", "o_totalprice").join(customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("ticker")), "o_custkey")
    return j.groupBy("ticker", week).agg(F.avg("o_totalprice").alias("close")), orders.groupBy(week).agg(F.avg("o_totalprice").alias("close"))


def _rows(spark, d):
    r = studies.relative_returns(*_prices(spark, d))
    b = F.when(F.col("ticker") % 3 == 0, "Constructive").when(F.col("ticker") % 3 == 1, "Cautious").otherwise("Ambiguous")
    return r.withColumns({"bucket": b, "state": F.concat(F.lit("s"), (F.col("ticker") % 5).cast("string"))})


def _six(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


def _metrics(df, *keys):
    return _six(df, "mean", "median", "share_up").select(*keys, "n", "mean", "median", "share_up")


@query(f"WITH {SQL_REL} SELECT ticker, date, round(rel_5, 6) AS rel_5, round(rel_20, 6) AS rel_20 FROM rr")
def forward_relative_return(spark, d):
    return _six(_rows(spark, d), "rel_5", "rel_20").select("ticker", "date", "rel_5", "rel_20")


@query(f"""WITH {SQL_REL}, m AS (SELECT bucket, count(rel_5) AS n, avg(rel_5) AS a, count(*) FILTER (bucket = 'Constructive' AND rel_5 > 0 OR bucket = 'Cautious' AND rel_5 < 0) AS hit,
  count(*) FILTER (bucket = 'Constructive' AND rel_5 <= 0) AS fp, count(*) FILTER (bucket = 'Cautious' AND rel_5 >= 0) AS fn FROM rr GROUP BY 1)
SELECT bucket, n, round(a, 6) AS mean, hit, fp, fn, round(a - (SELECT a FROM m WHERE bucket = 'Ambiguous'), 6) AS over_baseline FROM m""")
def bucket_metrics(spark, d):
    out = studies.bucket_metrics(_rows(spark, d), "rel_5")
    return _six(out, "mean", "over_baseline").select("bucket", "n", "mean", "hit", "fp", "fn", "over_baseline")


@query(f"WITH {SQL_REL} SELECT state, {METRICS.format('rel_20')} FROM rr GROUP BY 1")
def state_metrics(spark, d):
    return _metrics(_rows(spark, d).groupBy("state").agg(*studies.metrics("rel_20")), "state")


@query(f"WITH {SQL_REL}, {REGIME} SELECT date, round(vol, 6) AS vol, regime FROM rg")
def regime_vol(spark, d):
    return _six(studies.volatility_regime(_prices(spark, d)[1]), "vol").select("date", "vol", "regime")


@query(f"WITH {SQL_REL}, {REGIME} SELECT year(date) AS year, count(*) FILTER (regime = 'high') AS high, count(*) FILTER (regime = 'low') AS low FROM rg GROUP BY 1")
def regime_crosstab(spark, d):
    r = studies.volatility_regime(_prices(spark, d)[1]).withColumn("year", F.year("date").cast("long"))
    return studies.crosstab(r, "year", "regime", ["high", "low"])


@query(f"WITH {SQL_REL}, {REGIME} SELECT regime, bucket, {METRICS.format('rel_5')} FROM rr LEFT JOIN rg USING (date) WHERE regime IS NOT NULL GROUP BY CUBE (regime, bucket)")
def strata_cube(spark, d):
    r = studies.volatility_regime(_prices(spark, d)[1]).where("regime is not null").select("date", "regime")
    return _metrics(studies.strata(_rows(spark, d).join(r, "date"), "rel_5", ["regime", "bucket"]), "regime", "bucket")


@query(f"""WITH {SQL_REL}, {REGIME} SELECT regime, round(avg(rel_5) FILTER (bucket = 'Constructive') - avg(rel_5) FILTER (bucket = 'Cautious'), 6) AS gap FROM rr JOIN rg USING (date) WHERE regime IS NOT NULL GROUP BY 1""")
def regime_gap(spark, d):
    r = studies.volatility_regime(_prices(spark, d)[1]).where("regime is not null").select("date", "regime")
    return _six(studies.internal_gap(_rows(spark, d).join(r, "date"), "rel_5", ["regime"]), "gap")


MODES = [("primary", f"s{i}", b) for i, b in enumerate(["Constructive", "Constructive", "Ambiguous", "Cautious", "Cautious"])] + [("strict", f"s{i}", b) for i, b in enumerate(["Constructive", "Ambiguous", "Ambiguous", "Ambiguous", "Cautious"])]


@query(f"""WITH {SQL_REL}, m(mode, state, bucket) AS (VALUES {', '.join(map(str, MODES))}),
x AS (SELECT mode, m.bucket, count(rel_5) AS n, avg(rel_5) AS a FROM rr JOIN m USING (state) GROUP BY ALL)
SELECT mode, bucket, n, round(a, 6) AS mean, round(a - max(CASE WHEN mode = 'primary' THEN a END) OVER (PARTITION BY bucket), 6) AS change FROM x""")
def sensitivity_rebucket(spark, d):
    m = spark.createDataFrame(MODES, "mode string, state string, bucket string")
    return _six(studies.rebucket(_rows(spark, d).drop("bucket"), m, "rel_5"), "mean", "change").select("mode", "bucket", "n", "mean", "change")


@query(f"WITH {SQL_REL} SELECT round(quantile_cont(rel_20, 0.33), 6) AS p33, round(quantile_cont(rel_20, 0.5), 6) AS p50, round(quantile_cont(rel_20, 0.67), 6) AS p67 FROM rr")
def quantile_thresholds(spark, d):
    return _six(studies.quantile_thresholds(_rows(spark, d), "rel_20"), "p33", "p50", "p67")


@query(f"""WITH {SQL_REL}, e AS (SELECT user_id AS entity_id, date_trunc('week', ts - INTERVAL 1461 DAY) AS date, event_type FROM events), x AS (SELECT e.*, entity_id % 25 AS ticker FROM e)
SELECT event_type, count(*) AS n_events, {METRICS.format('rel_5')} FROM x LEFT JOIN rr ON rr.ticker = x.ticker AND rr.date = x.date GROUP BY 1""")
def lifecycle_event_study(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("entity_id"), F.date_trunc("week", F.expr("ts - interval 1461 day")).cast("timestamp_ntz").alias("date"), "event_type")
    entities = read(spark, d, "events").select(F.col("user_id").alias("entity_id")).distinct().withColumn("ticker", (F.col("entity_id") % 25).cast("int"))
    out = studies.event_study(e, entities, _rows(spark, d), "rel_5")
    return _metrics(out, "event_type", "n_events")


@query("""WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, max(n) AS n, min(n_chars) AS min, max(n_chars) FILTER (i = least(floor(n * 0.1), n - 1)) AS p10, max(n_chars) FILTER (i = least(floor(n * 0.5), n - 1)) AS p50,
  max(n_chars) FILTER (i = least(floor(n * 0.9), n - 1)) AS p90, max(n_chars) AS max FROM r GROUP BY 1""")
def order_stat_summary(spark, d):
    return studies.order_statistics(read(spark, d, "documents"), "n_chars", ["lang"])
