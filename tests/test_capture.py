import json

from pyspark.sql import functions as F

from credence.operators import capture
from credence.sources import jsonl


def line(kind, turn, **payload):
    top, sub = kind.split("/")
    return json.dumps({"timestamp": "2026-01-01T00:00:00Z", "type": top, "payload": {"type": sub, "turn_id": f"t{turn}", **payload}})


def call(turn, call_id, name, **arguments):
    return line("response_item/function_call", turn, call_id=call_id, name=name, arguments=json.dumps(arguments))


def result(turn, call_id, output):
    return line("response_item/function_call_output", turn, call_id=call_id, output=output)


LINES = [
    json.dumps({"type": "session_meta", "payload": {"id": "s"}}),
    call(0, "c1", "exec_command", cmd="pytest -q 'tests/a b'"),
    result(0, "c1", "E   boom\nError: it broke\nProcess exited with code 1"),
    call(1, "c2", "apply_patch", input="*** Begin\n*** Update File: /src/a.py\n*** Add File: /src/b.py\n"),
    result(1, "c2", "Done."),
    line("response_item/message", 2, role="assistant", content=[{"type": "text", "text": "It is fixed."}, {"type": "text", "text": "Shall I deploy?"}]),
    line("event_msg/user_message", 3, message="yes, go on"),
    call(4, "c3", "exec_command", cmd="pytest"),
    result(4, "c3", "ok\nProcess exited with code 0"),
    call(5, "c4", "write_file", path="/out/report.md"),
    result(5, "c4", "Wrote file"),
    line("response_item/message", 6, role="assistant", content="Can I push?"),
    json.dumps({"type": "odd"}),
]


def frame(spark):
    return spark.createDataFrame([("s", i + 1, x) for i, x in enumerate(LINES)], "session_id string, line long, raw string")


def test_normalised_fields(spark):
    got = {r.event_id: r for r in capture.normalise(frame(spark)).collect()}
    assert sorted(got) == [2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]
    assert (got[2].tool_name, got[2].command, got[2].turn) == ("pytest", "pytest -q 'tests/a b'", 0)
    assert (got[3].tool_name, got[3].parent_id, got[3].exit_code, got[3].outcome) == ("pytest", 2, 1, "failure")
    assert got[4].paths == ["/src/a.py", "/src/b.py"] and (got[5].exit_code, got[5].outcome, got[5].paths) == (0, "success", ["/src/a.py", "/src/b.py"])
    assert got[6].content == "It is fixed.\nShall I deploy?" and got[7].content == "yes, go on" and got[12].turn == 6


def test_lines_to_overlay(spark):
    events, beliefs, happened = capture.capture(frame(spark))
    rows = sorted((r.belief_type, r.kind, r.at_turn, r.authority) for r in happened.join(beliefs, "belief_id").collect())
    assert rows == sorted([
        ("validation_pending", "born", 0, "assistant"), ("validation_pending", "contradicted", 0, "tool"), ("pipeline_failed", "born", 0, "tool"), ("fix_attempted", "born", 1, "assistant"),
        ("user_approval_pending", "born", 2, "assistant"), ("user_approval_pending", "retired", 3, "user"), ("validation_pending", "born", 4, "assistant"), ("validation_pending", "retired", 4, "tool"),
        ("validation_complete", "born", 4, "tool"), ("fix_attempted", "retired", 4, "tool"), ("report_ready", "born", 5, "tool"), ("user_approval_pending", "born", 6, "assistant"), ("fix_attempted", "born", 5, "assistant"),
    ])
    text = capture.capture_overlay(frame(spark), 6, 500).first().text.split("\n")
    assert text[1].startswith("[active] action_blocked :: action_blocked — pipeline_failed, user_approval_pending (auth=tool, last=6)") or text[1].startswith("[active] user_approval_pending")
    assert len(text) == 1 + 6


def test_validation_parents(spark):
    calls = spark.createDataFrame([("s", 1, "pytest", "pytest -q"), ("s", 2, "ls", "ls"), ("s", 5, "pytest", "pytest -q"), ("s", 6, "ls", "make x")], "session_id string, event_id int, tool_name string, command string")
    results = spark.createDataFrame([("s", 7, 1, None, None), ("s", 8, 2, None, None), ("s", 9, None, "pytest", "pytest -q"), ("s", 10, None, "ls", "ls"), ("s", 11, None, "ls", "make x"), ("t", 12, None, "pytest", "pytest -q")], "session_id string, event_id int, parent_id int, tool_name string, command string")
    assert sorted(tuple(r) for r in capture.validation_parents(results, calls).collect()) == [(7, 1), (9, 5), (11, 6)]


def test_envelopes(spark):
    good = {"session_id": "s", "source_line_number": 1, "raw_line": "{}"}
    rows = [json.dumps(x) for x in (good, [1], {**good, "session_id": ""}, {**good, "source_line_number": 0}, {**good, "source_line_number": True}, {**good, "raw_line": 5}, {"session_id": "s"})] + ["no json"]
    got = capture.envelopes(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert [r.fault for r in got] == [None, "envelope must be a JSON object", "envelope session_id must be a non-empty string", "envelope source_line_number must be a positive integer", "envelope source_line_number must be a positive integer", "envelope raw_line must be a string", "envelope missing required keys: source_line_number, raw_line", "envelope must be a JSON object"]
    assert (got[0].session_id, got[0].line, got[0].raw) == ("s", 1, "{}")


def test_offsets_and_tools_of_sessions(spark, tmp_path):
    df = spark.createDataFrame([("2026-01-01T10:00:00+05:00",), ("2026-01-01T10:00:00Z",), ("2026-01-01 10:00:00.123456789",), ("bad",)], "t string")
    assert [str(r[0]) for r in df.select(jsonl.instant(F.col("t"))).collect()] == ["2026-01-01 05:00:00", "2026-01-01 10:00:00", "2026-01-01 10:00:00.123456", "None"]
    uses = [{"type": "text", "text": "look"}, {"type": "tool_use", "id": "u1", "name": "Bash", "input": {"command": "pytest -q " + "x" * 500}}, {"type": "tool_use", "id": "u2", "name": "Edit", "input": {"file_path": "/a.py"}}, {"type": "tool_use", "id": "u3", "name": "Odd", "input": {"k": 1}}]
    results = [{"type": "tool_result", "tool_use_id": "u1", "is_error": True, "content": [{"type": "text", "text": "boom"}, {"type": "text", "text": "twice"}]}, {"type": "tool_result", "tool_use_id": "u2", "content": "fine"}]
    (tmp_path / "one.jsonl").write_text("\n".join(json.dumps({"type": t, "uuid": t, "message": {"role": t, "content": c}}) for t, c in (("assistant", uses), ("user", results))))
    a, u = jsonl.load_sessions(spark, str(tmp_path)).orderBy("turn_idx").collect()
    assert a.text == "look" and [x.name for x in a.tool_uses] == ["Bash", "Edit", "Odd"]
    assert a.tool_uses[0].input_summary.endswith("… [+110 chars]") and a.tool_uses[1].input_summary == "file=/a.py" and a.tool_uses[2].input_summary == '{"k":1}'
    assert [tuple(x) for x in u.tool_results] == [("u1", "boom\ntwice", True), ("u2", "fine", False)]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 70) if i % 9 else "" for i in range(3000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text("one\r\ntwo")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {}
        for r in jsonl.numbered_lines(spark, str(tmp_path)).collect():
            got.setdefault(r.path[-7:], {})[r.line] = r.raw
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {"a.jsonl": {i + 1: x for i, x in enumerate(lines)}, "b.jsonl": {1: "one", 2: "two"}}


def test_lines_are_folded_once(spark):
    """The overlay reads what the rules gave from one store, and no second run of the rules is planned."""
    out = capture.capture_overlay(frame(spark), 6, 500)
    plan = out._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" in plan and plan.replace("InMemoryRelation", "").count("MapInArrow run") == plan.count("InMemoryRelation")
    spark.catalog.clearCache()
