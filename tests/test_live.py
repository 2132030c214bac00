"""Rules applied in a stream: the batch fold's rows, rollback of failed lines, dead letters."""

import json
import random

from pyspark.sql import functions as F

from credence.operators import capture, rules
from credence.streaming import live
from tests.test_capture import LINES, call, line, result

KINDS = "session_id string, line long, raw string, final boolean"


class Fragile(rules.Session):
    """Raises for edits of a certain file, after a rule that has already emitted."""

    def fix(self, turn, now, e):
        yield from super().fix(turn, now, e)
        if "/cursed" in (e.get("path") or ""):
            raise ValueError("cannot judge this file")


def run(spark, tmp_path, batches, session=rules.Session, name="live"):
    src = tmp_path / "in"
    src.mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    q = live.live(spark.readStream.schema(KINDS).parquet(str(src)), session).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        for rows in batches:
            spark.createDataFrame([(*r, False)[:4] for r in rows], KINDS).coalesce(1).write.mode("append").parquet(str(src))
            q.processAllAvailable()
    finally:
        q.stop()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    return spark.table(name)


def folded(spark, rows, session=rules.Session):
    return rules.fold_with_faults(capture.rule_rows(capture.normalise(spark.createDataFrame(rows, "session_id string, line long, raw string"))), session)


def more_lines():
    """A second session: a result with an unknown id, a call without one, a call that never ends, turns without ids."""
    return [
        call(0, "k1", "exec_command", cmd="make all"), result(0, "k9", "nothing\nProcess exited with code 2"), call(1, "k2", "write_file", path="/out/a.py"), result(1, "k2", "odd"),
        json.dumps({"type": "response_item", "payload": {"type": "function_call", "name": "exec_command", "arguments": json.dumps({"cmd": "pytest"})}}), result(2, "k1", "E  late\nProcess exited with code 1"),
        call(3, "k3", "edit_file", path="/out/a.py"), line("response_item/message", 5, role="assistant", content="Do you want me to stop?"), line("event_msg/user_message", 6, message="no, wait"), line("response_item/message", 7, role="assistant", content="Fine."),
    ]


def test_stream_gives_the_rows_of_the_fold(spark, tmp_path):
    rows = [("s", i + 1, x) for i, x in enumerate(LINES)] + [("t", i + 1, x) for i, x in enumerate(more_lines())]
    rng, batches = random.Random(1), []
    for k in range(0, 13, 4):  # each micro-batch has some lines of both sessions, shuffled, and replays
        part = [r for r in rows if k < r[1] <= k + 4] + [r for r in rows if r[1] == k]
        rng.shuffle(part)
        batches.append(part)
    got = run(spark, tmp_path, batches, name="shuffled")
    want = folded(spark, rows).where("fault is null").drop("fault")
    assert sorted(map(tuple, live.beliefs(got).collect())) == sorted(map(tuple, want.select(*rules.COLUMNS[:-1]).collect()))
    assert want.count() > 20 and want.where("kind = 'refreshed' or belief_type = 'pipeline_running'").count() > 1
    counts = {r.status: r["count"] for r in live.statuses(got).groupBy("status").count().collect()}
    assert counts == {"accepted": len(rows), "replayed": 5}


def test_a_failed_line_leaves_no_trace(spark, tmp_path):
    ok = [call(0, "c1", "exec_command", cmd="pytest"), result(0, "c1", "Boom error\nProcess exited with code 1"), call(1, "c2", "edit_file", path="/src/x")]
    bad, mended = call(2, "c3", "edit_file", path="/src/x/cursed"), call(2, "c3", "edit_file", path="/src/x/fine")
    after = [result(2, "c3", "Done."), call(3, "c4", "edit_file", path="/src/x/fine")]
    lines = [("a", i + 1, x) for i, x in enumerate([*ok, bad, *after])]
    again = [("a", 4, mended)] + [("a", 5 + i, x) for i, x in enumerate(after)]
    got = run(spark, tmp_path, [lines[:2], lines[2:], again, [("a", 0, "", True)], [("a", 7, "x")]], Fragile, "fragile").cache()
    statuses = [(r.line, r.status) for r in live.statuses(got).collect()]
    assert statuses == [(1, "accepted"), (2, "accepted"), (3, "accepted"), (4, "rule_failed"), (5, "out_of_order"), (6, "out_of_order"), (4, "accepted"), (5, "accepted"), (6, "accepted"), (6, "final"), (7, "finalized")]
    assert [tuple(r) for r in live.dead_letters(got).collect()] == [("a", 4, "fix", "ValueError", "cannot judge this file")]
    clean = [("a", i + 1, x) for i, x in enumerate([*ok, mended, *after])]
    want = folded(spark, clean).drop("fault")
    assert sorted(map(tuple, live.beliefs(got).collect())) == sorted(map(tuple, want.collect()))
    # batch: the session waits for the failed line, other sessions go on
    batch = folded(spark, lines + [("b", 1, ok[0])], Fragile)
    assert [tuple(r) for r in capture.dead_letters(batch).collect()] == [("a", 4, "fix", "ValueError", "cannot judge this file")]
    first = folded(spark, lines[:3]).drop("fault")
    assert sorted(map(tuple, batch.where("fault is null and session_id = 'a'").drop("fault").collect())) == sorted(map(tuple, first.collect()))
    assert batch.where("session_id = 'b'").count() == 1


def test_results_that_lost_their_ids(spark):
    base = {"exit_code": None, "signature": None, "path": None, "grants": False, "denies": False}
    rows = [
        ("validation_call", "c1", "pytest", "pytest -q", None), ("validation_call", None, "pytest", "pytest -q", None), ("validation_call", "c3", "make", "make", None), ("tool_call", "c4", "ls", "ls", None),
        ("tool_result", None, "pytest", "pytest -q", 0),  # ends both pending checks of this command
        ("tool_result", "c1", None, None, 1),  # nothing is pending for c1
        ("tool_result", None, "ls", "ls", 0), ("tool_result", None, None, None, 0),  # no validation, no pair
        ("tool_result", "zz", "make", "make", 3),  # an id that no call has
        ("tool_result", None, "make", "make", None),  # no exit code: nothing
    ]
    events = [{"event_id": i, "turn": 0, "kind": k, "call_id": c, "tool": t, "command": m, **base, "exit_code": x} for i, (k, c, t, m, x) in enumerate(rows)]
    state, out = rules.Session(), []
    for e in events:
        out += [(k, what, src) for k, _, what, _, _, src in state.step(e)]
    assert out == [("validation_pending", "born", 0), ("validation_pending", "born", 1), ("validation_pending", "born", 2), ("validation_pending", "retired", 4), ("validation_pending", "retired", 4), ("validation_complete", "born", 4), ("validation_pending", "contradicted", 8)]
    schema = "session_id string, event_id long, turn long, kind string, call_id string, tool string, command string, exit_code long, signature string, path string, grants boolean, denies boolean"
    df = spark.createDataFrame([("s", *(e[k] for k in schema.replace(",", "").split()[2::2])) for e in events], schema)
    assert sorted((r.belief_type, r.kind, r.source_event) for r in rules.fold(df).collect()) == sorted(out)
    assert rules.fold(df).where(F.col("session_id") != "s").count() == 0


def test_a_session_never_walks_all_its_calls():
    """Notices and results look only at what they end: walking every call or every pending check once a turn is quadratic."""

    class Unwalked(dict):
        def items(self):
            raise AssertionError("all calls walked")

    base = {"tool": "pytest", "command": "pytest -q", "exit_code": None, "signature": None, "path": None, "grants": False, "denies": False}
    state, out = rules.Session(calls=Unwalked()), []
    kinds = [("validation_call", "a", 0), ("validation_call", "b", 0), ("tool_result", "a", 1), ("validation_call", "b", 2), ("turn", None, 3), ("turn", None, 5), ("tool_result", None, 6)]
    for i, (kind, call, turn) in enumerate(kinds):
        out += [(x[1], x[2], x[4], x[5]) for x in state.step({**base, "event_id": i, "turn": turn, "kind": kind, "call_id": call, "exit_code": 0 if kind == "tool_result" else None})]
    assert out == [
        ("pending:a:0", "born", 0, 0), ("pending:b:1", "born", 0, 1), ("pending:a:0", "retired", 1, 2), ("complete:2", "born", 1, 2), ("pending:b:3", "born", 2, 3), ("running:b", "born", 2, 3),
        ("pending:b:1", "retired", 6, 6), ("pending:b:3", "retired", 6, 6), ("complete:6", "born", 6, 6),
    ]
