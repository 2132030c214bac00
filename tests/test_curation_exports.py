"""Balanced selection against a sequential one, the vector cache, and exports that are equal byte by byte."""

import glob
import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from credence.operators import curation
from credence.plans import operational as plans
from credence.sources import exports, vector_cache

DATA = "/root/testdata/sf0.01"


def sequential(rows: pd.DataFrame, q: curation.Quotas):
    """Picks from all candidates, counted afresh each time."""
    rows = rows.sort_values("__o").to_dict("records")
    taken, out = set(), []
    for category in q.categories:
        mine = lambda: [x for x in out if x[0] == category]

        def pick(answer):
            lacking = [p for p, n in q.positions if sum(x[2] == p for x in mine()) < n][:1]
            for position in lacking + list(q.fallback):
                for i, r in enumerate(rows):
                    if i not in taken and (r["category"], r["answer"], r["position"]) == (category, answer, position) and sum(x[3] == r["session_id"] for x in out) < q.per_session:
                        taken.add(i)
                        out.append((category, answer, position, r["session_id"], r["turn"]))
                        return True
            return False

        for answer, n in q.classes:
            for _ in range(n):
                if not pick(answer):
                    break
        while len(mine()) < q.total:
            free = {a: sum(i not in taken and r["category"] == category and r["answer"] == a for i, r in enumerate(rows)) for a, _ in q.classes}
            if not any(pick(a) for a in sorted(free, key=lambda a: -free[a])):
                break
    return [(k + 1, *x) for k, x in enumerate(out)]


def compare(spark, pool, q):
    got = sorted(map(tuple, curation.curate(pool, q).collect()))
    want = sequential(curation.ordered(pool, q.seed).toPandas(), q)
    assert got == want
    return got


def test_scarce_sessions(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(9), t, rng.choice(["a", "b", "c"]), rng.choice(["POSITIVE", "NEGATIVE", "NEGATIVE", "NA"]), rng.choice(["early", "middle", "late"])) for t in range(300)]
    pool = spark.createDataFrame(rows, "session_id long, turn long, category string, answer string, position string")
    q = curation.Quotas(("a", "b", "c"))
    got = compare(spark, pool, q)
    assert max(pd.Series([r[4] for r in got]).value_counts()) <= 3 and len(got) == 27  # nine sessions, three each
    lacks = {(r.category, r.what): (r.wanted, r.got) for r in curation.shortfalls(curation.curate(pool, q), q, {"NEGATIVE": 3}).collect()}
    assert lacks["c", "total"] == (15, 0)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_whole_tables(spark):
    pool = plans.question_pool(spark, DATA)
    got = compare(spark, pool, plans.QUOTAS)
    assert len(got) == 75 and {c: sum(r[1] == c for r in got) for c in plans.QUOTAS.categories} == {c: 15 for c in plans.QUOTAS.categories}
    assert curation.shortlist(pool, plans.QUOTAS).count() <= 5 * 2 * 3 * 90


def test_vector_cache(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def embed(rows):
        return rows.withColumn("embedding", F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")))

    folder = str(tmp_path / "cache")
    texts = spark.createDataFrame([("a", "one"), ("b", None), ("c", "three"), ("a", "one")], "id string, text string")
    assert vector_cache.vectors(texts, "m", folder).where("embedding is null").count() == 4
    assert vector_cache.fill(texts, "m", folder, embed) == 3 and vector_cache.fill(texts, "m", folder, embed) == 0
    assert sorted((r.id, r.embedding[0]) for r in vector_cache.vectors(texts, "m", folder).collect()) == [("a", 3.0), ("a", 3.0), ("b", 1.0), ("c", 5.0)]
    changed = spark.createDataFrame([("a", "one"), ("c", "changed"), ("d", "new")], "id string, text string")
    assert vector_cache.missing(changed, "m", folder).count() == 2 and vector_cache.missing(changed, "other", folder).count() == 3
    # a fill that dies before its name is in the manifest shows nothing; doing it again, or twice, gives each key once
    name = embed(vector_cache.missing(changed, "m", folder)).drop("text")
    name.write.parquet(f"{folder}/part-lost")
    assert vector_cache.read(spark, folder).count() == 3
    assert vector_cache.fill(changed, "m", folder, embed) == 2 and vector_cache.read(spark, folder).count() == 5
    open(f"{folder}/manifest/part-lost", "w").close()
    assert vector_cache.read(spark, folder).count() == 5 and len(vector_cache.parts(spark, folder)) == 3 and asked.value == 0


def test_exports_are_equal_byte_by_byte(spark, tmp_path):
    rows = [(s, t, i, 2 * t + i + 1, f"e{s}-{t}-{i}", "tool_call", "2026-01-01", None, "success" if i else None, json.dumps({"z": [1, {"y": 2, "x": "payload:null"}], "a": s})) for s in range(20) for t in range(5) for i in range(2)]
    events = spark.createDataFrame(rows, "session_id long, turn long, event_idx int, line long, source_event_id string, event_type string, timestamp string, call_id string, outcome string, payload string")
    beliefs = spark.createDataFrame([(s * 10 + k, s, "t", f'a "claim" {k}', k) for s in range(20) for k in range(3)], "belief_id long, session_id long, belief_type string, claim string, created_turn long")
    intervals = spark.createDataFrame([(s * 10 + k, state, a, b) for s in range(20) for k in range(3) for state, a, b in (("active", k, k + 2), ("contradicted", k + 2, None))], "belief_id long, state string, from_turn long, to_turn long")
    made = []
    for n, folder in ((2, "a"), (7, "b")):
        out = exports.records(events.repartition(n), beliefs.repartition(n), intervals)
        manifest = {r.bucket: (r.n_sessions, r.n_lines, r.sha256) for r in exports.write(out, str(tmp_path / folder), files=4).collect()}
        files = {p.split("bucket=")[1].split("/")[0]: open(p, "rb").read() for p in glob.glob(str(tmp_path / folder / "lines/bucket=*/part-*"))}
        made.append((manifest, files))
    assert made[0] == made[1] and sum(m[1] for m in made[0][0].values()) == 200 and sum(m[0] for m in made[0][0].values()) == 20
    import hashlib

    for bucket, (_, _, sha) in made[0][0].items():
        raw = made[0][1][str(bucket)]
        assert hashlib.sha256(raw).hexdigest() == sha
        for line in raw.decode().splitlines():
            x = json.loads(line)
            assert line == json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            assert x["payload"] == {"a": x["session_id"], "z": [1, {"x": "payload:null", "y": 2}]}
            assert x["active_belief_counts"] == {s: n for s in ("active", "contradicted") if (n := sum(b["state"] == s for b in x["active_beliefs_at_turn"]))}
