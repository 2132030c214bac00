"""Tables grouped by session meet without a shuffle; replay files; labels by a function; wider signature matches."""

import json
import os

import pytest
from pyspark.sql import functions as F

from credence import plans
from credence.functions import belief
from credence.operators import regions
from credence.sources import grouped

DATA = "/root/testdata/sf0.001"
plans.load_all()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_no_shuffle_between_grouped_tables(spark):
    df = plans.QUERIES["grouped_sessions"](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("Bucketed: true") == 2
    assert df.count() > 0 and "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_sorted_turns_of_a_session_without_a_shuffle(spark):
    rows = [(s, t, f"x{t}") for s in range(40) for t in range(9)]
    t = grouped.save(spark.createDataFrame(rows, "session_id long, turn long, text string"), "grouped_turns", ("turn",), buckets=4)
    out = t.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.session_id: [x.text for x in r.turns] for r in out.collect()} == {s: [f"x{t}" for t in range(9)] for s in range(40)}


def test_replay_files(spark, tmp_path):
    good = {"as_of": "2026-01-02T00:00:00", "expectation_id": "e1", "question_handle": "q", "status": "active", "supporting_share": 0.5, "supporting_actors": ["A", "B"], "unknown": 1}
    (tmp_path / "replay_a.jsonl").write_text(json.dumps(good) + "\n\nnot json\n")
    (tmp_path / "replay_b.jsonl").write_text(json.dumps({**good, "expectation_id": "e2", "question_handle": None}) + "\n")
    got = grouped.replay(spark, str(tmp_path / "replay_*.jsonl")).orderBy("expectation_id").collect()
    assert [(r.expectation_id, r.family, str(r.as_of), r.supporting_actors) for r in got] == [("e1", "q", "2026-01-02", ["A", "B"]), ("e2", "", "2026-01-02", ["A", "B"])]


def test_labels_by_a_function(spark):
    members = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 5, "z")], "region_id int, ord int, text string")
    got = regions.label_by(members, "ord", lambda region, rows: f"{region}:{'/'.join(rows['text'])}")
    assert sorted(map(tuple, got.collect())) == [(1, "1:a/c"), (2, "2:z")]


def test_wider_signature_matches(spark):
    kind = "struct<tools:array<string>,error_words:array<string>,file_paths:array<string>,cmd_tokens:array<string>,exception_classes:array<string>>"
    base = (["Bash"], ["boom", "at", "line"], ["a.py"], ["pytest"], [])
    others = [
        ((["Bash"], ["boom", "at", "home"], [], [], []), True), ((["Edit"], ["boom", "at", "line"], [], [], []), False), ((["Bash"], ["other"], [], [], []), False),
        ((["Edit"], [], ["a.py"], ["pytest", "x"], []), True), ((["Edit"], [], ["a.py"], ["ls"], []), False), ((None, None, None, None, None), False),
    ]
    df = spark.createDataFrame([(base, o) for o, _ in others], f"a {kind}, b {kind}")
    assert [r[0] for r in df.select(belief.near_signature_matches(F.col("a"), F.col("b"))).collect()] == [want for _, want in others]
    both = spark.createDataFrame([(([], [], [], [], ["KeyError"]), ([], [], [], [], ["KeyError"]))], f"a {kind}, b {kind}")
    assert both.select(belief.near_signature_matches(F.col("a"), F.col("b"))).first()[0]
