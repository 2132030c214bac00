"""Outcome studies: forward returns, buckets, regimes, sensitivity, and order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forward_returns(prices: DataFrame, horizons: tuple[int, ...] = (5, 20)) -> DataFrame:
    """Return over the next h rows of each ticker's own series; prices: ticker, date, close."""
    w = Window.partitionBy("ticker").orderBy("date")
    return prices.withColumns({f"fwd_{h}": F.try_divide(F.lead("close", h).over(w), F.col("close")) - 1 for h in horizons})


def relative_returns(prices: DataFrame, benchmark: DataFrame, horizons: tuple[int, ...] = (5, 20)) -> DataFrame:
    """Forward returns over those of the benchmark (date, close) from the same date on its own series."""
    own = forward_returns(prices, horizons)
    ref = forward_returns(benchmark.withColumn("ticker", F.lit("benchmark")), horizons).select("date", *(F.col(f"fwd_{h}").alias(f"ref_{h}") for h in horizons))
    out = own.join(ref, "date", "left")
    return out.withColumns({f"rel_{h}": F.col(f"fwd_{h}") - F.col(f"ref_{h}") for h in horizons})


def metrics(value: str) -> list[Column]:
    """n, mean, median and share above zero of the values that are there."""
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.avg((F.col(value) > 0).cast("double")).alias("share_up")]


def call(bucket: Column, value: Column) -> Column:
    """Hit, FP or FN of a bucket's call; zero counts as a miss, an ambiguous bucket makes none."""
    return F.when(value.isNull(), None).when(bucket == "Constructive", F.when(value > 0, "Hit").otherwise("FP")).when(bucket == "Cautious", F.when(value < 0, "Hit").otherwise("FN"))


def bucket_metrics(rows: DataFrame, value: str, bucket: str = "bucket", baseline: str = "Ambiguous") -> DataFrame:
    """Metrics and calls of each bucket, and its mean against the baseline bucket's."""
    rows = rows.withColumn("call", call(F.col(bucket), F.col(value)))
    out = rows.groupBy(bucket).agg(*metrics(value), *(F.count_if(F.col("call") == c).alias(c.lower()) for c in ("Hit", "FP", "FN")))
    base = F.max(F.when(F.col(bucket) == baseline, F.col("mean"))).over(Window.partitionBy(F.lit(1)))
    return out.withColumn("over_baseline", F.col("mean") - base)


def strata(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Metrics over all combinations of the strata and over each stratum's totals (cube)."""
    return rows.cube(*by).agg(*metrics(value))


def internal_gap(rows: DataFrame, value: str, by: list[str], bucket: str = "bucket") -> DataFrame:
    """Mean of the constructive minus mean of the cautious rows in each stratum."""
    side = lambda b: F.avg(F.when(F.col(bucket) == b, F.col(value)))
    return rows.groupBy(*by).agg((side("Constructive") - side("Cautious")).alias("gap"))


def volatility_regime(series: DataFrame, rows: int = 20, quantile: float = 0.5) -> DataFrame:
    """Sample deviation of the last ``rows`` changes and high/low against its quantile; series: date, close.

    A regime is one series for all tickers (an index): a row for each day."""
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    s = series.withColumn("change", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)
    frame = w.rowsBetween(-(rows - 1), 0)
    s = s.withColumn("vol", F.when(F.count("change").over(frame) >= rows, F.stddev_samp("change").over(frame)))
    limit = s.agg(F.percentile("vol", F.lit(quantile)).alias("limit"))
    return s.crossJoin(F.broadcast(limit)).withColumn("regime", F.when(F.col("vol").isNull(), None).when(F.col("vol") > F.col("limit"), "high").otherwise("low"))


def crosstab(rows: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    return rows.groupBy(a).pivot(b, values).count().na.fill(0)


def rebucket(rows: DataFrame, mapping: DataFrame, value: str) -> DataFrame:
    """Metrics of the same rows under each mode of a small mapping table (mode, state, bucket), and the change of the mean
    against the mode "primary"."""
    out = rows.join(F.broadcast(mapping), "state").groupBy("mode", "bucket").agg(*metrics(value))
    base = F.max(F.when(F.col("mode") == "primary", F.col("mean"))).over(Window.partitionBy("bucket"))
    return out.withColumn("change", F.col("mean") - base)


def quantile_thresholds(rows: DataFrame, value: str, quantiles: tuple[float, ...] = (0.33, 0.5, 0.67)) -> DataFrame:
    return rows.agg(*(F.percentile(value, F.lit(q)).alias(f"p{round(q * 100)}") for q in quantiles))


def event_study(events: DataFrame, entities: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """Metrics of the rows that lifecycle events fall on, by event type; events: entity_id, date, event_type; entities:
    entity_id, ticker; rows: ticker, date, value."""
    placed = events.join(entities, "entity_id", "left").join(rows, ["ticker", "date"], "left")
    return placed.groupBy("event_type").agg(F.count("*").alias("n_events"), *metrics(value))


def order_statistics(rows: DataFrame, value: str, by: list[str] | None = None, shares: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Minimum, maximum and the values at index floor(share * n) of each group's sorted values, not interpolated.

    Values are counted first, so a group holds a row for each distinct value."""
    by = by or []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).count()
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    upto = counts.withColumns({"upto": F.sum("count").over(w.orderBy(value)), "n": F.sum("count").over(w)})
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p), F.col("n") - 1), F.col(value)))
    return upto.groupBy(*by).agg(F.max("n").alias("n"), F.min(value).alias("min"), *(at(p).alias(f"p{round(p * 100)}") for p in shares), F.max(value).alias("max"))
