"""Timelines of eight beliefs: batch against a plain walk over instances, and the stream against the batch."""

import datetime
import math
import random

from credence.operators import timelines
from credence.streaming.timelines import timelines_stream

USE, RESULT = "struct<name:string,tool_use_id:string,input_summary:string>", "struct<tool_use_id:string,output_summary:string,is_error:boolean>"
SCHEMA = f"session_id string, turn_idx long, timestamp timestamp, role string, text string, is_meta boolean, tool_uses array<{USE}>, tool_results array<{RESULT}>, region string"
BASH = lambda c: [("Bash", "u", c)]
#: Turns by their signals: role, text, tool uses, results, region.
TURNS = {
    "start": ("assistant", "", BASH("python scripts/run_pipeline.py"), [], "pipeline_run"), "looks": ("assistant", "", BASH("tail -f x.log"), [], "UNCLASSIFIED"), "done": ("assistant", "", BASH("echo pipeline complete"), [], "UNCLASSIFIED"),
    "error": ("user", "", [], [("u", "x", True)], "failure_diagnosis"), "diagnosis": ("assistant", "let me check", [], [], "failure_diagnosis"), "change": ("assistant", "", [("Edit", "u", "file=a.py")], [], "UNCLASSIFIED"),
    "pass": ("assistant", "", BASH("pytest -q"), [("u", "fine", False)], "validation"), "fail": ("assistant", "", BASH("pytest -q"), [("u", "bad", True)], "validation"), "unknown": ("assistant", "", BASH("pytest"), [], "validation"),
    "report": ("assistant", "", [("Write", "u", "file=/out/report.md")], [], "report_generation"), "correction": ("user", "that's not right", [], [], "UNCLASSIFIED"), "wish": ("user", "ok\nship it", [], [], "UNCLASSIFIED"),
    "hold": ("user", "wait a bit", [], [], "UNCLASSIFIED"), "deploy": ("assistant", "", BASH("git push origin"), [], "deploy_readiness"), "none": ("user", "thanks", [], [], "UNCLASSIFIED"),
}
START = datetime.datetime(2026, 1, 1)


def make(sessions, most, seed):
    rng, rows = random.Random(seed), []
    for s in range(sessions):
        at = START
        for i in range(rng.randrange(1, most)):
            at += datetime.timedelta(seconds=rng.choice([0, 5, 60, 300, 900, 4000, 30000]))
            role, said, uses, results, region = TURNS[rng.choice(list(TURNS))]
            rows.append((f"s{s}", i, at, role, said, False, uses, results, region))
    return rows


def walk(rows):
    """Instances (name, anchor, birth, last refresh, end, how) of one session's turns, from what each kind of turn is."""
    kinds = {v: k for k, v in ((k, (r, t, str(u), str(x), g)) for k, (r, t, u, x, g) in TURNS.items())}
    made = []
    lives = lambda n: timelines.HALF_LIFE[n] * math.log(1 / 0.3) / math.log(2)
    latest = lambda n: next((m for m in reversed(made) if m["n"] == n and m["end"] is None), None)
    for _, idx, at, role, said, _, uses, results, region in rows:
        k = kinds[role, said, str(uses), str(results), region]
        for m in made:
            if m["end"] is None and (at - m["last"]).total_seconds() > lives(m["n"]):
                m["end"], m["how"] = m["last"] + datetime.timedelta(seconds=lives(m["n"])), "lapsed"

        def new(n):
            made.append({"n": n, "a": idx, "b": at, "last": at, "end": None, "how": None})

        def close(n, how):
            m = latest(n)
            if m:
                m["end"], m["how"] = at, how
            return m

        def touch(n):
            m = latest(n)
            if m:
                m["last"] = at
            return m

        change = k in ("change", "report")  # a report is written by a tool that changes files
        if k == "start" and not latest("pipeline_running"):
            new("pipeline_running")
        if k == "looks":
            touch("pipeline_running")
        if k == "done":
            close("pipeline_running", "retired")
        if k == "error" and close("pipeline_running", "contradicted"):
            new("pipeline_failed")
        if k in ("error", "diagnosis"):
            touch("pipeline_failed")
            if not touch("issue_under_diagnosis"):
                new("issue_under_diagnosis")
        if change:
            close("issue_under_diagnosis", "retired")
            if any(m["n"] == "issue_under_diagnosis" for m in made):
                new("fix_attempted")
                if not latest("validation_pending"):
                    new("validation_pending")
        if k in ("pass", "fail"):
            close("fix_attempted", "retired" if k == "pass" else "contradicted")
        if k in ("pass", "fail", "unknown"):
            close("validation_pending", "retired")
        if k == "report" and not touch("report_ready"):
            new("report_ready")
        if k == "correction":
            close("report_ready", "contradicted")
        if k == "wish":
            if latest("report_ready") or not latest("deploy_pending"):
                new("deploy_pending")
            close("user_approval_required", "retired")
        if k == "hold":
            close("deploy_pending", "contradicted")
        if k == "deploy":
            close("deploy_pending", "retired")
            if not latest("deploy_pending"):
                new("user_approval_required")
    for m in made:
        if m["end"] is None:
            m["end"], m["how"] = m["last"] + datetime.timedelta(seconds=lives(m["n"])), "lapsed"
    return [(m["n"], m["a"], m["b"], m["last"], m["end"], m["how"]) for m in made]


def test_batch_against_a_plain_walk(spark):
    rows = make(40, 40, 1)
    got = timelines.instances(timelines.timelines(spark.createDataFrame(rows, SCHEMA).repartition(3))).collect()
    want = {(s, n, a): (b, last, end, how) for s in {r[0] for r in rows} for n, a, b, last, end, how in walk([r for r in rows if r[0] == s])}
    assert {n for _, n, _ in want} == set(timelines.HALF_LIFE) and {x[3] for x in want.values()} == {"retired", "contradicted", "lapsed"}
    assert len(got) == len(want)
    for r in got:
        b, last, end, how = want[r.session_id, r.belief_name, r.anchor]
        assert (r.birth_ts, r.last_refresh_ts, r.ended) == (b, last, how) and abs((r.ended_ts - end).total_seconds()) < 0.01


def test_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    rows = make(12, 40, 2)
    rng = random.Random(3)
    src = tmp_path / "in"
    src.mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    q = timelines_stream(spark.readStream.schema(SCHEMA).parquet(str(src))).writeStream.format("memory").queryName("lines").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        days = sorted({(r[2] - START).total_seconds() // 40000 for r in rows})
        for d in days:  # micro-batches in order of time, shuffled inside
            part = [r for r in rows if (r[2] - START).total_seconds() // 40000 == d]
            rng.shuffle(part)
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
            q.processAllAvailable()
        for k in range(3):  # the watermark goes on
            late = START + datetime.timedelta(days=400 + k)
            spark.createDataFrame([("push", k, late, "user", "", False, [], [], "UNCLASSIFIED")], SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
            q.processAllAvailable()
    finally:
        q.stop()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    plain = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    want = plain(timelines.timelines(spark.createDataFrame(rows, SCHEMA)))
    assert len(want) > 50 and plain(spark.table("lines")) == want
