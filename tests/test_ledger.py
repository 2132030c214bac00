import hashlib
import random

import pytest
from pyspark.sql import functions as F

from credence.operators import ledger, replay, rules
from credence.sources import jsonl

BELIEFS = [
    ("b1", "s", "validation_pending", "run the tests", 2), ("b2", "s", "fix_attempted", "patched the parser", 3), ("b3", "s", "user_approval_pending", "may I deploy", 4),
    ("b4", "s", "validation_complete", "tests pass", 9), ("b5", "t", "pipeline_failed", "exit 1", 1), ("b6", "s", "report_ready", "late", 11),
]
EVENTS = [
    (1, "b1", "born", 2, None, "tool"), (2, "b1", "refreshed", 5, None, "assistant"), (3, "b1", "retired", 9, None, "tool"), (4, "b2", "born", 3, None, "assistant"), (5, "b3", "born", 4, None, "user"),
    (6, "b3", "contradicted", 9, 8, "user"), (7, "b4", "born", 9, None, "tool"), (8, "b5", "born", 4, 1, "tool"), (9, "b6", "born", 11, None, "assistant"), (10, "b2", "confirmed", 7, None, "user"),
]


def tables(spark):
    b = spark.createDataFrame(BELIEFS, "belief_id string, session_id string, belief_type string, claim string, created_turn int")
    e = spark.createDataFrame(EVENTS, "belief_event_id int, belief_id string, kind string, at_turn int, effective_turn int, authority string")
    return b, e


def brute_state(turn):
    out = {}
    for belief, _, _, _, created in BELIEFS:
        seen = sorted(((eff if eff is not None else at), at, i, kind, auth) for i, b, kind, at, eff, auth in EVENTS if b == belief and (eff if eff is not None else at) <= turn)
        if seen and created <= turn:
            rank = max(("assistant", "user", "tool").index(x[4]) for x in seen)
            out[belief] = (ledger.STATE_OF[seen[-1][3]], ("assistant", "user", "tool")[rank], seen[-1][1], [x[0] for x in seen if x[3] in ("born", "refreshed", "confirmed")])
    return out


@pytest.mark.parametrize("turn", [0, 1, 4, 8, 9, 20])
def test_state_at(spark, turn):
    b, e = tables(spark)
    got = {r.belief_id: (r.state, r.authority, r.last_updated_turn, r.warrant_turns) for r in ledger.state_at(b, e, turn).collect()}
    assert got == brute_state(turn)
    now = {r.belief_id: r.state for r in ledger.intervals(e).where((F.col("from_turn") <= turn) & (F.col("to_turn").isNull() | (F.col("to_turn") > turn))).collect()}
    assert {k: v for k, v in now.items() if k in got} == {k: v[0] for k, v in got.items()}


def test_blocked_and_overlay(spark):
    b, e = tables(spark)
    r = ledger.action_blocked(ledger.state_at(b, e, 7), 7).where("session_id = 's'").first()
    assert (r.claim, r.authority, r.warrant_turns, r.created_turn, r.last_updated_turn) == ("action_blocked \u2014 validation_pending, user_approval_pending", "tool", [2, 5, 4], 2, 5)
    assert ledger.action_blocked(ledger.state_at(b, e, 9), 9).where("session_id = 's'").count() == 0
    ranked = [x.belief_id for x in ledger.rank_overlay(ledger.state_at(b, e, 7), 7).where("session_id = 's'").orderBy("rank").collect()]
    assert ranked == ["b1", "b3", "b2"]
    far = [x.belief_id for x in ledger.rank_overlay(ledger.state_at(b, e, 12), 12, k=4).where("session_id = 's'").orderBy("rank").collect()]
    assert far[0] == "b2"  # out of the window comes first
    text = {x.session_id: x for x in ledger.overlay(b, e, 7, 60).collect()}["s"]
    assert text.n_admitted + text.n_omitted == 4 and text.n_omitted > 0 and len(text.text) <= 60 * 4
    whole = ledger.overlay(b, e, 7, 500).where("session_id = 's'").first()
    used = sum((len(x) + 3) // 4 + 1 for x in whole.text.split("\n")[1:])
    assert whole.body_tokens == used and whole.text.split("\n") == [
        f"# Operational belief overlay (budget: 500 tokens, used: {used}, omitted: 0, K=20)",
        "[active] validation_pending :: run the tests (auth=tool, last=5)",
        "[active] action_blocked :: action_blocked \u2014 validation_pending, user_approval_pending (auth=tool, last=5)",
        "[active] user_approval_pending :: may I deploy (auth=user, last=4)",
        "[active] fix_attempted :: patched the parser (auth=user, last=7)",
    ] and whole.n_admitted == 4
    assert whole.admitted_by_type == "action_blocked=1,fix_attempted=1,user_approval_pending=1,validation_pending=1" and whole.omitted_by_type == ""
    counts = {r.session_id: (r.n_active, r.n_retired, r.n_contradicted) for r in ledger.state_counts(ledger.full_state(b, e, 9)).collect()}
    assert counts == {"s": (2, 1, 1), "t": (2, 0, 0)}


def test_latest_event_gives_the_observed_turn(spark):
    """A belief minted late (observed at 9, in effect from 4) was last updated at 9; superseded means retired; a running
    pipeline ranks as a blocker."""
    b = spark.createDataFrame([("r", "s", "pipeline_running", "running", 4), ("x", "s", "report_ready", "old report", 1), ("y", "s", "report_ready", "new report", 9)], "belief_id string, session_id string, belief_type string, claim string, created_turn int")
    e = spark.createDataFrame([(1, "r", "born", 9, 4, "tool"), (2, "x", "born", 1, None, "assistant"), (3, "x", "superseded", 5, None, "assistant"), (4, "y", "born", 9, None, "user")], "belief_event_id int, belief_id string, kind string, at_turn int, effective_turn int, authority string")
    got = {r.belief_id: (r.state, r.last_updated_turn, r.effective_turn) for r in ledger.state_at(b, e, 9).collect()}
    assert got == {"r": ("active", 9, 4), "x": ("retired", 5, 5), "y": ("active", 9, 9)}
    assert [r.belief_id for r in ledger.rank_overlay(ledger.full_state(b, e, 9), 9).orderBy("rank").collect()] == ["r", "y"]
    assert ledger.action_blocked(ledger.state_at(b, e, 9), 9).count() == 0


def test_pack_skips_what_does_not_fit(spark):
    rng = random.Random(3)
    rows = [(s, i, f"i{i}", rng.randrange(1, 20)) for s in range(20) for i in range(rng.randrange(1, 15))]
    got = {r.s: r for r in ledger.pack(spark.createDataFrame(rows, "s int, rank int, belief_id string, cost int"), 30, "cost", by="s").collect()}
    for s in range(20):
        used, yes, no = 0, [], []
        for _, _, item, cost in sorted(r for r in rows if r[0] == s):
            if used + cost <= 30:
                used, _ = used + cost, yes.append(item)
            else:
                no.append(item)
        assert (got[s].used, got[s].admitted, got[s].omitted) == (used, yes, no)


def test_turns(spark):
    rng = random.Random(4)
    lines = [(s, i, rng.choice([None, None, 1, 2, 3])) for s in range(30) for i in range(1, 20)]
    got = {(r.session_id, r.line): r.turn for r in ledger.resolve_turns(spark.createDataFrame(lines, "session_id int, line int, turn_id int")).collect()}
    for s in range(30):
        seen, now = {}, -1
        for _, i, t in [x for x in lines if x[0] == s]:
            if t is not None:
                now = seen.setdefault(t, len(seen))
            assert got[s, i] == now


def test_chain_and_checks(spark):
    rows = [("s", i, f"line {i}") for i in (2, 1, 3)]
    h = ""
    for i in (1, 2, 3):
        h = hashlib.sha256(h.encode() + f"line {i}".encode()).hexdigest()
    df = spark.createDataFrame(rows, "session_id string, line int, raw string")
    assert ledger.hash_chain(df).first().chain == h
    fin = ledger.finalize(df).first()
    assert (fin.n_lines, fin.sha) == (3, hashlib.sha256(b"line 1\nline 2\nline 3").hexdigest())
    lines = df.where("line <> 2").withColumns({"sha": F.when(F.col("line") == 1, "x").otherwise(F.sha2(F.col("raw").cast("binary"), 256)), "status": F.lit("unrecognized")})
    events = spark.createDataFrame([("s", 0, 0), ("s", 0, 2)], "session_id string, turn int, event_idx int")
    fails = spark.createDataFrame([("s",)], "session_id string")
    got = {r.check: (r.ok, r.detail) for r in ledger.verify(lines, events, fails).collect()}
    assert got == {"line_count": (False, 2), "unrecognized": (False, 2), "contiguity": (False, 1), "hashes": (False, 1), "rule_failures": (False, 1)}


def event(i, turn, kind, **kw):
    return {"session_id": "s", "event_id": i, "turn": turn, "kind": kind, "call_id": None, "exit_code": None, "signature": None, "path": None, "grants": None, "denies": None} | kw


LOG = [
    event(1, 0, "validation_call", call_id="c1"), event(2, 0, "tool_result", call_id="c1", exit_code=1, signature="1:boom"), event(3, 1, "edit", path="/a/b"), event(4, 1, "edit", path="/a/b/c"),
    event(5, 2, "validation_call", call_id="c2"), event(6, 2, "tool_result", call_id="c2", exit_code=0), event(7, 3, "approval_request"), event(8, 3, "user_message", grants=True, denies=True),
    event(9, 4, "approval_request"), event(10, 4, "user_message", denies=True), event(11, 5, "report_write", path="/r", exit_code=0), event(12, 5, "report_write", path="/r", exit_code=0),
    event(13, 6, "tool_call", call_id="slow"), event(14, 8, "user_message"), event(15, 9, "user_message"), event(16, 10, "tool_result", call_id="slow", exit_code=1, signature="1:boom"),
]
WANT = [
    ("validation_pending", "born", 0), ("validation_pending", "contradicted", 0), ("pipeline_failed", "born", 0), ("fix_attempted", "born", 1), ("fix_attempted", "retired", 1), ("fix_attempted", "born", 1),
    ("validation_pending", "born", 2), ("validation_pending", "retired", 2), ("validation_complete", "born", 2), ("fix_attempted", "retired", 2), ("user_approval_pending", "born", 3), ("user_approval_pending", "retired", 3),
    ("user_approval_pending", "born", 4), ("user_approval_pending", "contradicted", 4), ("report_ready", "born", 5), ("report_ready", "retired", 5), ("report_ready", "born", 5), ("pipeline_running", "born", 9), ("pipeline_failed", "refreshed", 10),
]


def test_rule_fold(spark):
    kinds = "session_id string, event_id long, turn long, kind string, call_id string, exit_code long, signature string, path string, grants boolean, denies boolean"
    order = [x.strip().split()[0] for x in kinds.split(",")]
    rows = [tuple((e | {"session_id": s})[k] for k in order) for s in ("s", "t") for e in LOG]
    random.Random(1).shuffle(rows)
    out = rules.fold(spark.createDataFrame(rows, kinds).repartition(4)).toPandas()
    for s in ("s", "t"):
        got = sorted((r.source_event if r.kind != "born" or r.belief_type != "pipeline_running" else 15, r.belief_type, r.kind, r.at_turn) for r in out[out.session_id == s].itertuples())
        assert sorted((a, b, c) for _, a, b, c in got) == sorted(WANT)
    running = out[(out.belief_type == "pipeline_running")].iloc[0]
    assert (running.effective_turn, running.at_turn) == (6, 9)


def test_running_calls_against_a_walk(spark):
    rng = random.Random(8)
    calls, results, turns, want = [], [], [], []
    for s in range(40):
        t = sorted(rng.sample(range(30), 12))
        turns += [(s, x) for x in t]
        for c in range(4):
            at = rng.choice(t)
            res = rng.choice([None] + [x for x in t if x >= at])
            calls.append((s, c, at))
            if res is not None:
                results.append((s, c, res))
            late = next((x for x in t if x >= at + 3), None)
            if late is not None and (res is None or res >= late):
                want.append((s, c, at, late))
    frame = lambda rows: spark.createDataFrame(rows, "session_id int, call_id int, turn int")
    got = ledger.running_calls(frame(calls), frame(results), spark.createDataFrame(turns, "session_id int, turn int")).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_sources(spark, tmp_path):
    p = tmp_path / "events.jsonl"
    p.write_text('# comment\n\n{"id": 1, "timestamp": "2026-02-01T09:00:00Z", "text": "x", "metadata": {"tag": "t"}, "outcome": "high"}\n{"id": "2", "timestamp": "2026-02-02 10:00:00"}\n')
    got = {r.id: r for r in jsonl.load_events(spark, str(p)).collect()}
    assert got["1"].metadata == {"tag": "t"} and str(got["1"].timestamp) == "2026-02-01 09:00:00" and got["2"].text == "" and got["2"].outcome is None
    p.write_text('{"id": 1, "timestamp"\n')
    with pytest.raises(Exception, match="bad event"):
        jsonl.load_events(spark, str(p)).collect()
    log = tmp_path / "abcdefghij" / "subagents"
    log.mkdir(parents=True)
    (log / "one.jsonl").write_text('{"type":"user","uuid":"u","message":{"role":"user","content":"hi"}}\nbroken\n{"type":"system"}\n{"type":"assistant","uuid":"v"}\n')
    rows = sorted(tuple(r) for r in jsonl.load_sessions(spark, str(log)).select("session_id", "turn_idx", "role", "text").collect())
    assert rows == [("subagent::abcdefgh::one", 0, "user", "hi"), ("subagent::abcdefgh::one", 1, "assistant", "")]
    roll = tmp_path / "r.jsonl"
    roll.write_text('{"type":"session_meta","payload":{"id":"S"}}\n\n{"type":"response_item","payload":{"type":"function_call","call_id":"c","turn_id":"t"}}\n{"type":"odd"}\n')
    c = [tuple(r) for r in jsonl.classify_lines(jsonl.load_rollout(spark, str(roll))).orderBy("line").select("session_id", "line", "status", "event_type", "call_id").collect()]
    assert c == [("S", 1, "ignored-known", None, None), ("S", 3, "mapped", "tool_call", "c"), ("S", 4, "unrecognized", None, None)]
    out = spark.createDataFrame([("Process exited with code 0",), ("Process exited with code 2",), ("hm",), ('"unclosed quote',), ("pytest -q",)], "o string")
    assert [r[0].outcome for r in out.select(jsonl.tool_outcome(F.col("o"))).collect()][:3] == ["success", "failure", "unknown"]
    assert [r.tool_name for r in jsonl.first_command_word(out, "o").collect()][3:] == ['"unclosed', "pytest"]
    jsonl.write_jsonl(spark.createDataFrame([(1, "x")], "b int, a string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"a":"x","b":1}'


def test_tracker_and_loops(spark):
    rows = [("s", "d", f"2026-01-01 0{h}:00:00", k) for h, k in ((0, "born"), (1, "refreshed"), (2, "retired"), (3, "retired"), (4, "refreshed"), (9, "refreshed"))]
    df = spark.createDataFrame(rows, "session_id string, name string, ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = [(r.episode, r.n_refreshes, r.ended_by) for r in replay.track(df, 3600.0).orderBy("episode").collect()]
    assert got == [(1, 2, "retired"), (2, 1, "stale"), (3, 1, "stale")]
    turns = [("s", t, "x" if t in (0, 1, 2, 5) else None, t == 4) for t in range(6)]
    loops = replay.failure_loops(spark.createDataFrame(turns, "session_id string, turn int, signature string, is_edit boolean")).collect()
    assert [(r.turn, r.signature) for r in loops] == [(2, "x")]
