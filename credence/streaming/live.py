"""Raw lines in, beliefs out: ordered, replay-safe ingest with the rules applied to each line as it is accepted.

Lines are parsed as columns (operators.capture.parsed) before the state. State by session: the next line, chain and end of
the session; the hash of each line, for replays; the number of each turn id; each call's tool, command and paths, for its
result; and the rules' session (operators.rules). A line's rules are all applied or none: if one raises, the line is not
accepted, the session is read again from the store and the lines accepted in this micro-batch are applied to it again, so
nothing of the failed line stays but its dead letter, and the same line may be sent again.

A micro-batch's lines of one session are sorted in one frame, so the trigger's limits bound it; hashes, turn ids and calls of
an open session are in the state store, on disk.

Rows that come out: one for each line with its status (as in streaming.ingest, or rule_failed with the fault), and one for
each belief event, with status null. Belief rows are those of operators.rules.fold over the accepted lines.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import text
from ..operators import capture, rules
from ..sources import jsonl

COLUMNS = ["session_id", "line", "status", "chain", "belief_id", "belief_type", "kind", "at_turn", "effective_turn", "source_event", "fault"]
OUT = "session_id string, line long, status string, chain string, belief_id string, belief_type string, kind string, at_turn long, effective_turn long, source_event long, fault struct<rule:string,kind:string,message:string>"


class Live(StatefulProcessor):
    def __init__(self, session: Callable[[], rules.Session] = rules.Session):
        self.make = session

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "next_line long, chain string, closed boolean, turn long, turns long")
        self.seen = handle.getMapState("seen", "line long", "sha string")
        self.turns = handle.getMapState("turns", "turn_id string", "turn long")
        self.calls = handle.getMapState("calls", "call_id string", "line long, tool string, command string, path string, report string, checks boolean, edits boolean")
        self.rules = handle.getValueState("rules", "pickled binary")

    def load(self) -> rules.Session:
        return pickle.loads(bytes(self.rules.get()[0])) if self.rules.exists() else self.make()

    def steps(self, e: dict, turn: int) -> list[dict]:
        """The rule rows of a mapped line, as operators.capture.rule_rows gives them."""
        kind, own = e["event_type"], {k: e[k] for k in ("tool", "command", "path", "report", "checks", "edits")}
        code = None
        if kind == "tool_result":
            if e["call_id"] is not None:
                known = self.calls.getValue((e["call_id"],)) if self.calls.containsKey((e["call_id"],)) else (None, None, None, None, None, False, False)
                own = dict(zip(own, known[1:]))
            # only a shell call whose command names no word is called exec_command
            code = e["shell_code"] if own["tool"] == "exec_command" else e["code"]
        base = {"turn": turn, "call_id": e["call_id"], "tool": own["tool"], "command": own["command"], "exit_code": code, "path": own["path"], "grants": e["grants"], "denies": e["denies"], "signature": None}
        first = {"tool_call": "validation_call" if own["checks"] else "tool_call", "tool_result": "tool_result"}.get(kind)
        first = first or ("approval_request" if e["asks"] else "user_message" if e["grants"] or e["denies"] else "turn")
        out = [base | {"event_id": 2 * e["line"], "kind": first, "signature": e["signature"] if kind == "tool_result" and code not in (None, 0) else None}]
        if kind == "tool_call" and own["edits"]:
            out.append(base | {"event_id": 2 * e["line"] + 1, "kind": "edit"})
        if kind == "tool_result" and code == 0 and own["edits"] and own["report"] is not None:
            out.append(base | {"event_id": 2 * e["line"] + 1, "kind": "report_write", "path": own["report"]})
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        following, chain, closed, turn, turns = self.at.get() if self.at.exists() else (1, "", False, -1, 0)
        frame = pd.concat(list(rows)).sort_values(["final", "line"], kind="stable")
        state, applied, out = self.load(), [], []
        said = lambda line, status, chain=None, fault=None: out.append((key[0], line, status, chain, *[None] * 6, fault))
        for e in frame.astype(object).where(frame.notna(), None).to_dict("records"):
            line = e["line"]
            if closed:
                said(line, "finalized")
                continue
            if e["final"]:
                closed = True
                for state_map in (self.seen, self.turns, self.calls):
                    state_map.clear()
                said(following - 1, "final", chain)
                continue
            sha = hashlib.sha256(e["raw"].encode()).hexdigest()
            if self.seen.containsKey((line,)):
                said(line, "replayed" if self.seen.getValue((line,))[0] == sha else "mutated")
                continue
            if line != following:
                said(line, "out_of_order")
                continue
            now, new_turn = turn, False
            if e["turn_id"] is not None:
                new_turn = not self.turns.containsKey((e["turn_id"],))
                now = turns if new_turn else self.turns.getValue((e["turn_id"],))[0]
            steps = self.steps(e, now) if e["status"] == "mapped" else []
            emitted: list[tuple] = []
            try:
                for x in steps:
                    emitted += state.step(x)
            except rules.RuleFault as fault:
                said(line, "rule_failed", fault={"rule": fault.rule, "kind": type(fault.cause).__name__, "message": str(fault)})
                state = self.load()
                for x in applied:
                    list(state.step(x))
                continue
            applied += steps
            chain = hashlib.sha256(chain.encode() + e["raw"].encode()).hexdigest()
            said(line, "accepted", chain)
            out += [(session, line, None, None, *x, None) for session, *x in rules.named(key[0], emitted)]
            following, turn = following + 1, now
            self.seen.updateValue((line,), (sha,))
            if new_turn:
                self.turns.updateValue((e["turn_id"],), (now,))
                turns += 1
            if e["event_type"] == "tool_call" and e["call_id"] is not None:
                self.calls.updateValue((e["call_id"],), (line, e["tool"], e["command"], e["path"], e["report"], e["checks"], e["edits"]))
        self.at.update((following, chain, closed, turn, turns))
        if closed:
            self.rules.clear()
        elif applied:
            self.rules.update((pickle.dumps(state),))
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def live(lines: DataFrame, session: Callable[[], rules.Session] = rules.Session) -> DataFrame:
    """Statuses and belief events of a streaming DataFrame (session_id, line, raw, and final where sessions are closed). Needs
    the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    final = F.coalesce("final", F.lit(False)) if "final" in lines.columns else F.lit(False)
    rows = lines.select(F.col("session_id").cast("string").alias("session_id"), F.col("line").cast("long").alias("line"), F.coalesce("raw", F.lit("")).alias("raw"), final.alias("final"))
    rows = capture.marks(capture.parsed(rows))
    code = lambda tool: F.when(F.col("output").isNotNull(), jsonl.tool_outcome(F.col("output"), F.lit(tool))["exit_code"]).cast("long")
    rows = rows.select(
        "session_id", "line", "raw", "final", "status", "event_type", "turn_id", "call_id", F.col("tool_name").alias("tool"), "command", F.nullif(F.array_join("paths", "\n"), F.lit("")).alias("path"), "report",
        "checks", "edits", "asks", "grants", "denies", code("").alias("code"), code("exec_command").alias("shell_code"), text.failure_signature(code(""), F.col("output")).alias("signature"),
    )
    return rows.groupBy("session_id").transformWithStateInPandas(Live(session), outputStructType=OUT, outputMode="append", timeMode="none")


def statuses(rows: DataFrame) -> DataFrame:
    return rows.where("status is not null").select("session_id", "line", "status", "chain")


def beliefs(rows: DataFrame) -> DataFrame:
    return rows.where("status is null").select(*rules.COLUMNS[:-1])


def dead_letters(rows: DataFrame) -> DataFrame:
    """session_id, event_id, rule_name, exception_class and exception_message of the lines whose rules raised."""
    return rows.where("status = 'rule_failed'").select("session_id", F.col("line").alias("event_id"), F.col("fault.rule").alias("rule_name"), F.col("fault.kind").alias("exception_class"), F.col("fault.message").alias("exception_message"))
