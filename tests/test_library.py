import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from credence.functions import belief
from credence.operators import regions


def life(spark, **kw):
    row = dict(region_id=1, prior_state="strengthened", prior_top1=0.5, top1=0.5, n_test=20, baseline=None, corr=None) | kw
    kinds = "region_id int, prior_state string, prior_top1 double, top1 double, n_test int, baseline double, corr double"
    return regions.with_lifecycle(spark.createDataFrame([tuple(row.values())], kinds)).first().to_state


@pytest.mark.parametrize(
    "change,state",
    [
        (dict(prior_state=None), "born"),
        (dict(prior_state=None, corr=-0.9), "born"),
        (dict(corr=-0.31, n_test=1), "inverted"),
        (dict(corr=-0.30), "strengthened"),
        (dict(n_test=4), "retired"),
        (dict(n_test=5), "strengthened"),
        (dict(prior_state="retired", n_test=10), "reopened"),
        (dict(prior_state="retired", n_test=9), "retired"),
        (dict(prior_state="retired", n_test=10, top1=None), "retired"),
        (dict(baseline=0.6), "contradicted"),
        (dict(top1=0.6), "strengthened"),
        (dict(top1=0.4), "weakened"),
        (dict(prior_state="born", prior_top1=None), "strengthened"),
        (dict(prior_state="weakened", top1=0.52), "weakened"),
    ],
)
def test_lifecycle(spark, change, state):
    assert life(spark, **change) == state


def decide(spark, **kw):
    row = dict(region_id=1, to_state="strengthened", label="x", top1=0.8, n_test=10) | kw
    df = spark.createDataFrame([tuple(row.values())], "region_id int, to_state string, label string, top1 double, n_test int")
    return regions.decide(df, belief.DecisionThresholds(escalate_labels=("bad",))).first().decision


@pytest.mark.parametrize(
    "change,want",
    [
        (dict(to_state="retired", label="bad"), "RETIRE"), (dict(to_state="inverted"), "INVERT"), (dict(label="bad", top1=None), "ESCALATE"), (dict(top1=None), "INTERVENE"), (dict(n_test=0), "INTERVENE"),
        (dict(top1=0.19), "RECLUSTER"), (dict(top1=0.2), "MONITOR"), (dict(top1=0.75), "PROMOTE"), (dict(top1=0.75, n_test=9), "MONITOR"), (dict(top1=0.6), "MONITOR"), (dict(to_state=None), "PROMOTE"),
    ],
)
def test_decision(spark, change, want):
    assert decide(spark, **change) == want


def test_weights(spark):
    rows = [(1.0, 0), (1.0, 3600), (0.8, 7200), (0.5, -5)]
    w = F.round(belief.decayed(F.col("c"), F.col("age"), F.lit(3600)), 6)
    assert [r[0] for r in spark.createDataFrame(rows, "c double, age int").select(w).collect()] == [1.0, 0.5, 0.2, 0.5]
    faults = spark.createDataFrame([("decaying", 0.5, 60, None), ("decaying", 1.5, 60, None), ("decaying", 0.5, 0, None), ("decaying", 0.5, None, None), ("invariant", None, None, "PASS"), ("invariant", None, None, "odd"), ("else", 0.1, 1, None)], "k string, c double, h int, s string")
    got = [r[0] for r in faults.select(belief.warrant_fault(F.col("k"), F.col("c"), F.col("h"), F.col("s"))).collect()]
    assert got == [None, "confidence outside [0, 1]", "half-life must be positive", "half-life must be positive", None, "unknown validation status", "unknown warrant type"]
    status = spark.createDataFrame([("PASS",), ("FAIL",), (None,)], "s string").select(belief.invariant_weight(F.col("s"))).collect()
    assert [r[0] for r in status] == [1.0, 0.0, 0.0]


def test_calibration(spark):
    train = [(1, "a", i) for i in range(3)] + [(1, "b", 3), (1, "c", 4), (1, "d", 5), (1, None, 6), (2, "z", 7), (3, "y", 8), (3, "x", 9)]
    test = [(1, "a"), (1, "b"), (1, "q"), (1, None), (2, "z")]
    h = regions.hypotheses(regions.outcome_distribution(spark.createDataFrame(train, "region_id int, outcome string, ord int"), "ord"))
    by = {r.region_id: r for r in h.collect()}
    assert (by[1].direction, by[1].n_train, by[1].conviction, [x.outcome for x in by[1].top3]) == ("a", 6, 0.5, ["a", "b", "c"])
    assert by[3].direction == "y"  # a tie goes to the first seen
    out = {r.region_id: r for r in regions.calibrate(h, spark.createDataFrame(test, "region_id int, outcome string")).collect()}
    p = [0.5, 1 / 6, 1 / 6]
    sq = sum(x * x for x in p)
    want = sum(sq - 2 * x + 1 for x in (0.5, 1 / 6, 0.0)) / 3
    assert out[1].n_test == 3 and abs(out[1].top1 - 1 / 3) < 1e-9 and abs(out[1].top3 - 2 / 3) < 1e-9 and abs(out[1].brier - want) < 1e-9
    assert out[2].top1 == 1.0 and out[2].brier == 0.0
    assert out[3].n_test == 0 and out[3].top1 is None and out[3].brier is None


def test_split_and_range(spark):
    base = dt.datetime(2026, 5, 1)
    rows = [(base + dt.timedelta(minutes=7 * (i // 2)),) for i in range(41)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    for share in (0.0, 0.3, 0.7, 0.99):
        assert regions.split_point(df, share).first()[0] == sorted(rows)[int(41 * share)][0]
    cut = (base + dt.timedelta(minutes=14)).isoformat(" ")
    assert regions.date_range(df, None, cut).count() == 4 and regions.date_range(df, cut).count() == 37


def test_embedding_and_regions(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, text string")
    e = {r.id: r.embedding for r in regions.mock_embed(texts, "id", dim=16).collect()}
    assert e[1] == e[2] != e[3] and abs(sum(x * x for x in e[3]) - 1) < 1e-5
    with pytest.raises(ValueError):
        regions.mock_embed(texts, "id", dim=4)
    seen = regions.external_embed(texts, "id", lambda t: [[float(len(x or ""))] for x in t], batch=2).collect()
    assert sorted(r.embedding[0] for r in seen) == [0.0, 1.0, 1.0]
    made = regions.generate(spark.createDataFrame([(1, "x"), (2, "y")], "region_id int, text string"), lambda region, rows: {"region_id": region, "n": len(rows)} if region == 1 else None, "region_id int, n int").collect()
    assert [tuple(r) for r in made] == [(1, 1)]
    points = spark.createDataFrame([(i, [float(i % 2 * 10 + i % 3), 1.0]) for i in range(30)], "id int, embedding array<float>")
    r, placed = regions.fit_regions(points, 2)
    assert r.count() == 2 and placed.groupBy("region_id").count().count() == 2
    near = regions.nearest_centroid(points, r, "id").join(placed.select("id", F.col("region_id").alias("p")), "id")
    assert near.where("region_id <> p").count() == 0


def test_report(spark):
    c = spark.createDataFrame([(1, 5, 0.5), (2, 9, 0.9)], "region_id int, n_test int, top1 double")
    d = spark.createDataFrame([(1, "PROMOTE"), (2, "MONITOR")], "region_id int, decision string")
    h = spark.createDataFrame([(1, 3, "a<b")], "region_id int, n_train int, direction string").withColumn("top3", F.array(F.lit("a")))
    none = spark.createDataFrame([], "region_id int")
    rows = regions.cards(c, h, none, d, none)
    page = regions.report_html(rows, "R & D")
    assert page.index("Region 1") < page.index("Region 2") and "a&lt;b" in page and "R &amp; D" in page
    assert isinstance(rows.toPandas(), pd.DataFrame)


def test_projection_is_the_principal_plane(spark):
    import numpy as np

    from credence.operators import operational

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)) * np.array([9, 4, 1, 0.5, 0.1])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, embedding array<double>")
    got = np.array([r.pca for r in operational.projection(df, 2).orderBy("id").collect()])
    axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:2]
    assert np.allclose(np.abs(got), np.abs(x @ axes.T), atol=1e-6)


def test_synthetic_events_are_the_same_each_time(spark):
    from credence.operators import operational

    a, b = (operational.synthetic_events(spark, 10).orderBy("timestamp", "id").collect() for _ in range(2))
    assert a == b and len(a) == 80 and len({r.metadata["tag"] for r in a}) == 8 and {r.outcome for r in a} == {"high", "moderate", "quiet"}


def test_top_chunks_meet_in_blocks(spark, monkeypatch):
    """Several blocks, equal vectors, zero and null ones, against plain cosines; queries and chunks are not joined as rows."""
    import random

    import numpy as np

    from credence.operators import retrieval

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "CHUNK_BLOCK", 20)
    rng = random.Random(7)
    v = [(i, [rng.gauss(0, 1) for _ in range(5)], i % 4) for i in range(150)]
    v += [(i, v[i % 3][1], i % 4) for i in range(150, 230)] + [(230, [0.0] * 5, 0), (231, None, 0)]
    chunks = spark.createDataFrame(v, "chunk_id long, embedding array<float>, label int").repartition(3)
    asked = chunks.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))
    out = retrieval.top_then_cutoff(asked, chunks, 40, F.col("label") < 2)
    assert "MapInArrow" in out._jdf.queryExecution().toString()
    single = {i: None if x is None else np.float32(x).astype(float) for i, x, _ in v}

    def cosine(a, b):
        if a is None or b is None or not a.any() or not b.any():
            return None
        total = lambda x, y: float(np.add.accumulate(x * y)[-1])
        return total(a, b) / (total(a, a) ** 0.5 * total(b, b) ** 0.5)

    want = set()
    for q in range(0, 232, 10):
        sims = [(i, label, cosine(single[q], single[i])) for i, _, label in v]
        order = sorted(sims, key=lambda x: (x[2] is None, -(x[2] or 0), x[0]))[:40]
        want |= {(q, i, k + 1) for k, (i, label, _) in enumerate(order) if label < 2}
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in out.collect()} == want


def test_askers_of_a_theme_are_dealt_to_tasks(spark, monkeypatch):
    """A theme that all share, and beliefs of several themes, against plain sets; no row a pair of asker and belief is made before the lists are cut."""
    from credence.operators import retrieval

    monkeypatch.setattr(retrieval, "ASKERS", 4)
    rows = [(i, i * 7 % 23, [0, i % 5, 5 + i % 3]) for i in range(120)] + [(200 + i, 3, [0, 9]) for i in range(30)]
    beliefs = spark.createDataFrame([(i, a) for i, a, _ in rows], "belief_id long, actor long")
    themes = spark.createDataFrame([(i, t) for i, _, ts in rows for t in ts], "belief_id long, theme long")
    out = retrieval.theme_expansion(beliefs, themes, "actor", 10)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "salt" in plan and "slice(filter(list" in plan
    want = set()
    for asker in {a for _, a, _ in rows}:
        mine = {t for _, a, ts in rows if a == asker for t in ts}
        want |= {(asker, i, k + 1) for k, i in enumerate(sorted(i for i, a, ts in rows if a != asker and mine & set(ts))[:10])}
    assert {tuple(r) for r in out.select("asker", "belief_id", "rank").collect()} == want
