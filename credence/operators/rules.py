"""Beliefs derived from a session's events by an ordered fold.

The fold is one small state machine, used by sessions in batch (grouped by session) and in a stream (state by session, see
streaming.live). An event whose rules raise leaves no trace; it gives one dead letter, and the session waits for it:
later events of the session are not applied.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMITTED = "session_id string, belief_id string, belief_type string, kind string, at_turn long, effective_turn long, source_event long"
FOLDED = EMITTED + ", fault struct<rule:string,kind:string,message:string>"


class RuleFault(Exception):
    """An exception of a rule, with the rule's name."""

    def __init__(self, rule: str, cause: Exception):
        super().__init__(str(cause))
        self.rule, self.cause = rule, cause


@dataclass
class Session:
    """What the rules know of a session; ``active`` maps a type to its beliefs and their details.

    Pending validations are found by call and by tool and command, and calls wait for their notice in a heap by turn, so
    that no event walks all calls or all beliefs.

    A result belongs to the call of its id. One without an id, or with an id that no call has, belongs to the pending
    validations of its tool and command, and to the latest call of these if that is a validation; as tool and command decide
    that, ``validations`` holds one entry for each such pair, however often it was called."""

    active: dict[str, dict[str, object]] = field(default_factory=dict)
    pending_of: dict[object, dict[str, None]] = field(default_factory=dict)  # call id, or (tool, command): pending validations
    calls: dict[str, tuple[int, int, bool, int]] = field(default_factory=dict)  # call id: (turn, event, is a validation, first event with this id)
    waiting: list[tuple[int, int, str]] = field(default_factory=list)  # heap of (turn, event, call id) without notice
    validations: set[tuple[str, str]] = field(default_factory=set)
    signatures: dict[str, str] = field(default_factory=dict)
    noticed: set[str] = field(default_factory=set)
    turn: int = -1

    #: The rules of each kind of event, in order.
    RULES = {
        "validation_call": ("call", "pending"), "tool_call": ("call",), "tool_result": ("outcome", "failure"), "edit": ("superseded", "fix"),
        "report_write": ("report",), "approval_request": ("approval",), "user_message": ("answer",),
    }

    def step(self, e: dict) -> Iterator[tuple]:
        """The rules that one event emits; an event: event_id, turn, kind, call_id, tool, command, exit_code, signature, path
        (several as lines), grants, denies. Kinds without rules only advance the turn."""
        for name in ("running", *self.RULES.get(e["kind"], ())):
            try:
                yield from getattr(self, name)(int(e["turn"]), int(e["event_id"]), e)
            except Exception as cause:
                raise RuleFault(name, cause) from cause

    def _born(self, kind, key, turn, now, detail=""):
        self.active.setdefault(kind, {})[key] = detail
        if kind == "validation_pending":
            for name in (detail[0], detail[1:]):
                self.pending_of.setdefault(name, {})[key] = None
        return kind, key, "born", turn, turn, now

    def _end(self, kind, key, what, turn, now):
        detail = self.active[kind].pop(key)
        if kind == "validation_pending":
            for name in (detail[0], detail[1:]):
                self.pending_of[name].pop(key)
                if not self.pending_of[name]:
                    del self.pending_of[name]
        return kind, key, what, turn, turn, now

    def _of(self, kind):
        return list(self.active.get(kind, {}).items())

    def running(self, turn, now, e):
        if turn > self.turn:
            due = []
            while self.waiting and turn >= self.waiting[0][0] + 3:
                at, event, call = heapq.heappop(self.waiting)
                known = self.calls.get(call)
                if known is not None and known[:2] == (at, event):  # no result yet, and not called again since
                    self.noticed.add(call)
                    due.append((known[3], call, at, event))
            for _, call, at, event in sorted(due):
                yield ("pipeline_running", f"running:{call}", "born", turn, at, event)
            self.turn = turn

    def call(self, turn, now, e):
        checks = e["kind"] == "validation_call"
        call = e.get("call_id") or f"@{now}"
        self.calls[call] = (turn, now, checks, self.calls[call][3] if call in self.calls else now)
        if call not in self.noticed:
            heapq.heappush(self.waiting, (turn, now, call))
        if checks and e.get("tool") is not None and e.get("command") is not None:
            self.validations.add((e["tool"], e["command"]))
        yield from ()

    def pending(self, turn, now, e):
        call = e.get("call_id") or f"@{now}"
        yield self._born("validation_pending", f"pending:{call}:{now}", turn, now, (call, e.get("tool"), e.get("command")))

    def outcome(self, turn, now, e):
        code, pair = e.get("exit_code"), (e.get("tool"), e.get("command"))
        known = self.calls.pop(e.get("call_id") or "", None)
        if known is not None:
            validation, mine = known[2], list(self.pending_of.get(e["call_id"], ()))
        else:
            validation, mine = pair in self.validations, [] if None in pair else list(self.pending_of.get(pair, ()))
        if code is not None:
            for key in mine:
                yield self._end("validation_pending", key, "contradicted" if code else "retired", turn, now)
        if validation and code == 0:
            yield self._born("validation_complete", f"complete:{now}", turn, now)
            path = e.get("path")
            for key in [k for k, d in self._of("fix_attempted") if not path or _overlap(d, path)]:
                yield self._end("fix_attempted", key, "retired", turn, now)

    def failure(self, turn, now, e):
        if e.get("exit_code") != 0 and e.get("signature"):
            known = self.signatures.get(e["signature"])
            if known is None:
                self.signatures[e["signature"]] = f"failed:{now}"
                yield self._born("pipeline_failed", f"failed:{now}", turn, now)
            else:
                yield ("pipeline_failed", known, "refreshed", turn, turn, now)

    def superseded(self, turn, now, e):
        for key in [k for k, d in self._of("fix_attempted") if e.get("path") and _overlap(d, e["path"])]:
            yield self._end("fix_attempted", key, "retired", turn, now)

    def fix(self, turn, now, e):
        if e.get("path") and any(self.active.get(t) for t in ("pipeline_failed", "validation_pending", "validation_complete")):
            yield self._born("fix_attempted", f"fix:{now}", turn, now, e["path"])

    def report(self, turn, now, e):
        if e.get("exit_code") == 0:
            for key in [k for k, d in self._of("report_ready") if d == (e.get("path") or "")]:
                yield self._end("report_ready", key, "retired", turn, now)
            yield self._born("report_ready", f"report:{now}", turn, now, e.get("path") or "")

    def approval(self, turn, now, e):
        yield self._born("user_approval_pending", f"approval:{now}", turn, now)

    def answer(self, turn, now, e):
        if e.get("grants") or e.get("denies"):
            for key, _ in self._of("user_approval_pending"):
                yield self._end("user_approval_pending", key, "retired" if e.get("grants") else "contradicted", turn, now)


def _overlap(a: str, b: str) -> bool:
    """Whether one of the paths of a (one a line) is one of b's or lies below or above it."""
    pairs = [(x.rstrip("/"), y.rstrip("/")) for x in a.split("\n") for y in b.split("\n")]
    return any(x == y or x.startswith(y + "/") or y.startswith(x + "/") for x, y in pairs)


def named(session: str, rows: list[tuple]) -> list[tuple]:
    return [(session, f"belief:{session}:{key}", kind, what, at, eff, src) for kind, key, what, at, eff, src in rows]


COLUMNS = ["session_id", "belief_id", "belief_type", "kind", "at_turn", "effective_turn", "source_event", "fault"]


def fold_with_faults(events: DataFrame, session: Callable[[], Session] = Session) -> DataFrame:
    """All belief events of all sessions, and for each session whose rules raised one row with the fault (and nothing of its events from
    there on). A session's rows are read in batches in order, never as one frame."""
    text, number = pa.string(), pa.int64()
    fields = zip(COLUMNS, [text] * 4 + [number] * 3 + [pa.struct([("rule", text), ("kind", text), ("message", text)])])
    schema = pa.schema([*fields])

    def run(batches):
        now, state, failed = None, session(), False
        for batch in batches:
            out = []
            for e in batch.to_pylist():
                if e["session_id"] != now:
                    now, state, failed = e["session_id"], session(), False
                if failed:
                    continue
                try:
                    out += [(*x, None) for x in named(now, list(state.step(e)))]
                except RuleFault as fault:
                    failed = True
                    out.append((now, None, None, None, e["turn"], None, e["event_id"], {"rule": fault.rule, "kind": type(fault.cause).__name__, "message": str(fault)}))
            columns = zip(*out) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    e = events.withColumn("session_id", events["session_id"].cast("string"))
    return e.repartition("session_id").sortWithinPartitions("session_id", "event_id").mapInArrow(run, FOLDED)


def fold(events: DataFrame, session: Callable[[], Session] = Session) -> DataFrame:
    """All belief events of all sessions."""
    return fold_with_faults(events, session).where(F.col("fault").isNull()).drop("fault")
