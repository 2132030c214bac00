"""Regions, empirical hypotheses, walk-forward calibration, lifecycle and decisions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import belief, vector


def date_range(events: DataFrame, start: str | None = None, end: str | None = None, ts: str = "ts") -> DataFrame:
    """Half-open [start, end); either bound may be missing."""
    if start is not None:
        events = events.where(F.col(ts) >= F.lit(start).cast(events.schema[ts].dataType))
    if end is not None:
        events = events.where(F.col(ts) < F.lit(end).cast(events.schema[ts].dataType))
    return events


def split_point(events: DataFrame, share: float = 0.7, ts: str = "ts") -> DataFrame:
    """One row, split_at: the order statistic at floor(share * n) of the timestamps.

    Rows are counted once, by second. Running counts inside each hour and over the hours (few rows) find the second that holds
    it; then only that second's rows are looked at again. No step sorts rows, and no window but that of the hours is in one task."""
    rows = events.where(F.col(ts).isNotNull()).select(F.col(ts).alias("split_at"))
    second = F.date_trunc("second", "split_at")
    counts = rows.groupBy(second.alias("s")).agg(F.count("*").alias("n")).withColumn("hour", F.date_trunc("hour", "s"))
    hours = counts.groupBy("hour").agg(F.sum("n").alias("m"))
    hours = hours.select("hour", (F.sum("m").over(Window.orderBy("hour")) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy(F.lit(1))).alias("total"))
    inside = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("hour").orderBy("s"))).join(hours, "hour")
    k = F.floor(F.col("total") * share) - F.col("before")
    at = inside.where((F.col("upto") > k) & (F.col("upto") - F.col("n") <= k)).select("s", (k - F.col("upto") + F.col("n")).alias("k"))
    values = rows.join(F.broadcast(at), second == F.col("s")).groupBy("split_at").agg(F.count("*").alias("n"), F.max("k").alias("k"))
    last = values.withColumn("upto", F.sum("n").over(Window.orderBy("split_at")))
    return last.where((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("n") <= F.col("k"))).select("split_at")


def outcome_distribution(train: DataFrame, order: str) -> DataFrame:
    """region_id, outcome, n, total, prob and rank (by count, ties by first seen); rows without outcome do not count."""
    counts = train.where("outcome is not null").groupBy("region_id", "outcome").agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    w = Window.partitionBy("region_id")
    return counts.withColumns({"total": F.sum("n").over(w), "rank": F.row_number().over(w.orderBy(F.desc("n"), "first_seen"))}).withColumn("prob", F.col("n") / F.col("total"))


def hypotheses(distribution: DataFrame, min_train: int = 1) -> DataFrame:
    """The empirical hypothesis of each region: direction, conviction, top3 and n_train."""
    top = distribution.where((F.col("rank") <= 3) & (F.col("total") >= min_train))
    return top.groupBy("region_id").agg(
        F.max("total").alias("n_train"),
        F.max(F.when(F.col("rank") == 1, F.col("outcome"))).alias("direction"),
        F.max(F.when(F.col("rank") == 1, F.col("prob"))).alias("conviction"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "outcome", "prob"))), lambda x: F.struct(x["outcome"].alias("outcome"), x["prob"].alias("prob"))).alias("top3"),
    )


def generate(train: DataFrame, make: Callable[[int, pd.DataFrame], dict | None], schema: str) -> DataFrame:
    """Hypotheses by a caller's function of one region's rows; None skips the region. A region must fit one task."""

    def run(key, rows):
        out = make(key[0], rows)
        return pd.DataFrame([out] if out is not None else [])

    return train.groupBy("region_id").applyInPandas(run, schema)


def calibrate(hypothesis: DataFrame, test: DataFrame) -> DataFrame:
    """Test accuracy of each hypothesis: n_test, top1, top3 and the mean Brier score over its support and the true outcome."""
    at = F.array_position(F.transform("top3", lambda x: x["outcome"]), F.col("outcome"))
    hit = F.when(at > 0, F.element_at("top3", at.cast("int"))["prob"]).otherwise(0.0)
    square = F.aggregate("top3", F.lit(0.0), lambda s, x: s + x["prob"] * x["prob"])
    known = hypothesis.join(test.where("outcome is not null").select("region_id", "outcome"), "region_id", "left")
    labelled = F.col("outcome").isNotNull()
    return known.groupBy("region_id").agg(
        F.first("n_train").alias("n_train"),
        F.count("outcome").alias("n_test"),
        F.avg(F.when(labelled, (F.col("direction") == F.col("outcome")).cast("double"))).alias("top1"),
        F.avg(F.when(labelled, (at > 0).cast("double"))).alias("top3"),
        F.avg(F.when(labelled, square - 2 * hit + 1)).alias("brier"),
    )


def with_lifecycle(now: DataFrame, thresholds: belief.LifecycleThresholds = belief.LifecycleThresholds()) -> DataFrame:
    """Rows with prior_state, prior_top1, top1, n_test, baseline and corr, and their to_state and reason."""
    step = belief.lifecycle(F.col("prior_state"), F.col("prior_top1"), F.col("top1"), F.col("n_test"), F.col("baseline"), F.col("corr"), thresholds)
    return now.withColumn("step", step).select("*", "step.to_state", "step.reason").drop("step")


def two_passes(events: DataFrame, first_cut: str, second_cut: str, order: str, ts: str = "ts") -> DataFrame:
    """Pass A trains on the first era and tests on the second; pass B trains on both, tests on the third, and takes A's
    state and top1 as its prior."""
    era1, era2, era3 = date_range(events, None, first_cut, ts), date_range(events, first_cut, second_cut, ts), date_range(events, second_cut, None, ts)
    none = F.lit(None)
    a = calibrate(hypotheses(outcome_distribution(era1, order)), era2)
    a = with_lifecycle(a.select("region_id", "top1", "n_test", none.cast("string").alias("prior_state"), none.cast("double").alias("prior_top1"), none.cast("double").alias("baseline"), none.cast("double").alias("corr")))
    a = a.select("region_id", F.col("to_state").alias("prior_state"), F.col("top1").alias("prior_top1"))
    b = calibrate(hypotheses(outcome_distribution(date_range(events, None, second_cut, ts), order)), era3)
    baseline = era3.where("outcome is not null").groupBy("outcome").count().agg((F.max("count") / F.sum("count")).alias("baseline"))
    return with_lifecycle(b.join(a, "region_id", "left").crossJoin(F.broadcast(baseline)).withColumn("corr", none.cast("double")))


def decide(rows: DataFrame, thresholds: belief.DecisionThresholds = belief.DecisionThresholds()) -> DataFrame:
    return rows.withColumn("decision", belief.decision(F.col("to_state"), F.col("label"), F.col("top1"), F.col("n_test"), thresholds))


def label_mode(members: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The most common value under the first keys of each region's members; ties by first seen."""
    values = members.select("region_id", order, F.explode(F.array(*keys)).alias("label")).where("label is not null")
    counts = values.groupBy("region_id", "label").agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    w = Window.partitionBy("region_id").orderBy(F.desc("n"), "first_seen", "label")
    return counts.withColumn("r", F.row_number().over(w)).where("r = 1").select("region_id", "label", "n")


def label_by(members: DataFrame, order: str, label_fn) -> DataFrame:
    """region_id and the label that ``label_fn(region_id, members)`` gives, members as a pandas frame in order.

    For regions that fit a task; of larger ones, pass the rows that the label is made of (``label_mode`` needs no such bound)."""
    import pandas as pd

    kind = dict(members.dtypes)["region_id"]

    def run(key, rows):
        return pd.DataFrame([(key[0], label_fn(key[0], rows.sort_values(order, kind="stable")))], columns=["region_id", "label"])

    return members.groupBy("region_id").applyInPandas(run, f"region_id {kind}, label string")


def centroids(points: DataFrame, by: str, vec: str = "embedding") -> DataFrame:
    """The mean vector of each group, one aggregate a dimension."""
    each = points.select(by, F.posexplode(vec).alias("d", "x")).groupBy(by, "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("centroid"))


MOST_CENTROIDS = 10_000


def nearest_centroid(points: DataFrame, regions: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """The region with the closest centroid (Euclidean, ties by region_id); regions: region_id, centroid.

    Regions are few by design (k of a clustering). They are taken as one row in blocks of MOST_CENTROIDS; a point is compared
    with a block inside its row, so only with more than one block are there rows to aggregate."""
    n = regions.count()
    blocks = max(1, -(-n // MOST_CENTROIDS))
    block = F.pmod(F.xxhash64("region_id"), F.lit(blocks))
    held = regions.groupBy(block.alias("block")).agg(F.collect_list(F.struct("region_id", "centroid")).alias("held")).drop("block")
    nearest = F.array_min(F.transform("held", lambda r: F.struct(vector.squared_distance(F.col(vec), r["centroid"]).alias("d"), r["region_id"].alias("region_id"))))
    each = points.select(key, vec).join(F.broadcast(held) if blocks == 1 else held).select(key, nearest.alias("m"))  # one row a block
    best = each if blocks == 1 else each.groupBy(key).agg(F.min("m").alias("m"))
    return best.select(key, "m.region_id", F.sqrt("m.d").alias("distance"))


def fit_regions(points: DataFrame, k: int, seed: int = 0, vec: str = "embedding", clusterer=None) -> tuple[DataFrame, DataFrame]:
    """(regions, points with region_id) of k-means, or of any other pyspark.ml clusterer that predicts ``prediction``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = points.withColumn("features", array_to_vector(F.col(vec)))
    model = (clusterer or KMeans(k=k, seed=seed)).fit(data)
    placed = model.transform(data).withColumnRenamed("prediction", "region_id").drop("features")
    return centroids(placed, "region_id", vec), placed


def mock_embed(texts: DataFrame, key: str, text: str = "text", dim: int = 64) -> DataFrame:
    """A deterministic unit vector for each text, seeded by its blake2b hash; for tests and offline runs."""
    if dim < 8:
        raise ValueError("at least 8 dimensions")

    @F.pandas_udf("array<float>")
    def embed(s: pd.Series) -> pd.Series:
        import hashlib

        import numpy as np

        def one(t):
            seed = int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=8).digest(), "little")
            v = np.random.default_rng(seed).standard_normal(dim).astype(np.float32)
            return v / max(float(np.linalg.norm(v)), 1e-12)

        return s.map(one)

    return texts.select(key, embed(text).alias("embedding"))


def external_embed(texts: DataFrame, key: str, adapter: Callable[[list[str]], list[list[float]]], text: str = "text", batch: int = 100) -> DataFrame:
    """Vectors from a caller's adapter, in batches."""

    def run(frames):
        for f in frames:
            for k in range(0, len(f), batch):
                part = f.iloc[k : k + batch]
                yield pd.DataFrame({key: part[key], "embedding": adapter(part[text].tolist())})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def cards(calibration: DataFrame, hypothesis: DataFrame, lifecycle: DataFrame, decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per region for a report: promoted first, then by top1."""
    out = calibration
    for other in (hypothesis.drop("n_train").withColumnRenamed("top3", "top3_outcomes"), lifecycle, decisions, labels):
        out = out.join(other, "region_id", "left")
    return out.orderBy(F.when(F.col("decision") == "PROMOTE", 0).otherwise(1), F.desc_nulls_last("top1"), "region_id")


def report_html(card_rows: DataFrame, title: str, most: int = 1000) -> str:
    """A page of region cards (regions are few; at most ``most`` are shown)."""
    from html import escape

    out = [f"<!doctype html><meta charset='utf-8'><title>{escape(title)}</title><h1>{escape(title)}</h1>"]
    for r in card_rows.limit(most).toLocalIterator():
        d = r.asDict()
        out.append(f"<section><h2>Region {escape(str(d.pop('region_id')))}</h2><dl>" + "".join(f"<dt>{escape(k)}</dt><dd>{escape('—' if v is None else str(v))}</dd>" for k, v in d.items()) + "</dl></section>")
    return "\n".join(out)


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)
