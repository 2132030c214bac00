"""Timelines of eight decaying beliefs about a session's work.

A turn's signals are told by columns; an ordered tracker turns signals into belief events. A belief's weight halves every half
life after its last refresh; it lapses when the weight falls below STALE, at a time that is known at each refresh. Batch
and stream run the same tracker: the batch merges a session's turns with the times at which beliefs lapse, the stream
(streaming.timelines) has a timer for each belief. Several instances of a belief may be open; a signal meets the latest.

Events: session_id, belief_name, anchor (the turn of birth), event (born, refreshed, retired, contradicted, lapsed), ts,
turn_idx (null for lapses) and reason. A lapse stands at the time when the weight falls below STALE, not at the next turn.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import turns

#: Half lives in seconds, and the weight below which a belief is stale.
HALF_LIFE = {
    "pipeline_running": 30 * 60, "pipeline_failed": 60 * 60, "issue_under_diagnosis": 45 * 60, "fix_attempted": 15 * 60,
    "validation_pending": 10 * 60, "deploy_pending": 60 * 60, "report_ready": 4 * 60 * 60, "user_approval_required": 30 * 60,
}
STALE = 0.3
#: Milliseconds after a refresh at which a belief's weight is below STALE for the first time.
LIVES = {name: math.floor(1000 * half * math.log(1 / STALE) / math.log(2)) + 1 for name, half in HALF_LIFE.items()}
EVENTS = "session_id string, belief_name string, anchor long, event string, ts timestamp, turn_idx long, reason string"
COLUMNS = ["session_id", "belief_name", "anchor", "event", "ts", "turn_idx", "reason"]


def signals() -> Column:
    """The signals of a turn (role, text, tool_uses, tool_results, region), in the order in which they act."""
    assistant, user = F.col("role") == "assistant", F.col("role") == "user"
    said = F.coalesce("text", F.lit(""))
    p = turns.predicates()
    sees_done = F.coalesce(F.exists("tool_results", lambda r: text.matches_any(r["output_summary"], turns.PIPELINE_DONE)), F.lit(False))
    look = lambda c: F.array_compact(F.array(F.when(text.matches_any(c, turns.PIPELINE_LOOK), "looks"), F.when(text.matches_any(c, turns.PIPELINE_DONE) | sees_done, "done")))
    looks = F.when(assistant, F.flatten(F.transform(turns.commands(), look)))
    report = F.exists("tool_uses", lambda u: u["name"].isin("Write", "Edit") & F.coalesce(u["input_summary"], F.lit("")).rlike(r"(?i)\.(html|pdf|md)$") & F.contains(F.lower(u["input_summary"]), F.lit("report")))
    diagnoses = F.col("region") == "failure_diagnosis"
    rest = F.array_compact(F.array(
        F.when(user & p["has_error"], "error"), F.when(diagnoses, "diagnosis"), F.when(assistant & p["is_change"], "change"),
        F.when(assistant & p["is_validation"], F.concat(F.lit("validation:"), F.coalesce(p["validation_status"], F.lit("None")))),
        F.when(assistant & (F.coalesce(report, F.lit(False)) | (F.col("region") == "report_generation")), "report"), F.when(p["is_correction"], "correction"),
        F.when(user & text.matches_any(said, turns.DEPLOY_WISH), "wish"), F.when(user & text.matches_any(said, turns.DEPLOY_HOLD), "hold"), F.when(assistant & p["is_deploy"], "deploy"),
    ))
    none = F.expr("cast(array() as array<string>)")
    return F.concat(F.when(assistant & (F.col("region") == "pipeline_run") & p["is_pipeline"], F.array(F.lit("start"))).otherwise(none), F.coalesce(looks, none), rest)


@dataclass
class Tracker:
    """A session's open beliefs, as (anchor, time of the last refresh in ms) by name, oldest first."""

    open: dict[str, list[list[int]]] = field(default_factory=dict)
    diagnosed: bool = False

    def lapses(self, before: int) -> Iterator[tuple]:
        """Closes the beliefs that lapse at or before a time; their events, in order of time."""
        due = sorted((at + LIVES[name], name, anchor) for name, own in self.open.items() for anchor, at in own if at + LIVES[name] <= before)
        for when, name, anchor in due:
            self.open[name] = [x for x in self.open[name] if x[0] != anchor]
            yield name, anchor, "lapsed", when, None, "stale_decay"

    def deadlines(self) -> set[int]:
        return {at + LIVES[name] for name, own in self.open.items() for _, at in own}

    def turn(self, now: int, idx: int, given: list[str]) -> Iterator[tuple]:
        """What a turn's signals do, once lapsed beliefs are closed."""

        def has(name):
            return bool(self.open.get(name))

        def born(name):
            self.open.setdefault(name, []).append([idx, now])
            yield name, idx, "born", now, idx, None

        def refreshed(name, reason):
            if has(name):
                self.open[name][-1][1] = now
                yield name, self.open[name][-1][0], "refreshed", now, idx, reason

        def ended(name, event, reason):
            if has(name):
                yield name, self.open[name].pop()[0], event, now, idx, reason

        for s in given:
            kind, _, status = s.partition(":")
            if kind == "start" and not has("pipeline_running"):
                yield from born("pipeline_running")
            elif kind == "looks":
                yield from refreshed("pipeline_running", "status_check")
            elif kind == "done":
                yield from ended("pipeline_running", "retired", "completion_evidence")
            elif kind == "error" and has("pipeline_running"):
                yield from ended("pipeline_running", "contradicted", "tool_error_in_window")
                yield from born("pipeline_failed")
            elif kind == "diagnosis":
                yield from refreshed("pipeline_failed", "continued_diagnosis")
                self.diagnosed = True
                yield from refreshed("issue_under_diagnosis", "continued_diagnosis") if has("issue_under_diagnosis") else born("issue_under_diagnosis")
            elif kind == "change":
                yield from ended("issue_under_diagnosis", "retired", "transitioned_to_fix_attempted")
                if self.diagnosed:
                    yield from born("fix_attempted")
                    if not has("validation_pending"):
                        yield from born("validation_pending")
            elif kind == "validation":
                if status != "None":
                    yield from ended("fix_attempted", *(("retired", "validation_passed") if status == "PASS" else ("contradicted", "validation_failed")))
                yield from ended("validation_pending", "retired", f"validation_observed_{status}")
            elif kind == "report":
                yield from refreshed("report_ready", "new_report_artifact") if has("report_ready") else born("report_ready")
            elif kind == "correction":
                yield from ended("report_ready", "contradicted", "user_correction_on_report")
            elif kind == "wish":
                if has("report_ready") or not has("deploy_pending"):
                    yield from born("deploy_pending")
                yield from ended("user_approval_required", "retired", "user_provided_approval")
            elif kind == "hold":
                yield from ended("deploy_pending", "contradicted", "user_hold")
            elif kind == "deploy":
                yield from ended("deploy_pending", "retired", "deploy_executed")
                if not has("deploy_pending"):
                    yield from born("user_approval_required")


def rows_of(session: str, events) -> list[tuple]:
    return [(session, name, anchor, event, pd.Timestamp(ms, unit="ms"), idx, reason) for name, anchor, event, ms, idx, reason in events]


def signal_rows(session_turns: DataFrame) -> DataFrame:
    """session_id, turn_idx, at (ms) and signals of turns with a time."""
    at = F.unix_millis(F.col("timestamp").cast("timestamp"))
    return session_turns.where("timestamp is not null").select(F.col("session_id").cast("string").alias("session_id"), F.col("turn_idx").cast("long").alias("turn_idx"), at.alias("at"), signals().alias("signals"))


def frame(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=COLUMNS).astype({"turn_idx": "Int64", "anchor": "Int64"})


def timelines(session_turns: DataFrame) -> DataFrame:
    """All belief events of all sessions, lapses after the last turn included. turns: session_id, turn_idx, timestamp, role, text,
    tool_uses, tool_results, region."""

    def run(frames):
        now, state = None, Tracker()
        for f in frames:
            out = []
            for session, idx, at, given in zip(f["session_id"].tolist(), f["turn_idx"].tolist(), f["at"].tolist(), f["signals"].tolist()):
                if session != now:
                    out += rows_of(now, state.lapses(1 << 62)) if now is not None else []
                    now, state = session, Tracker()
                out += rows_of(session, [*state.lapses(at), *state.turn(at, idx, list(given))])
            yield frame(out)
        if now is not None:
            yield frame(rows_of(now, state.lapses(1 << 62)))

    return signal_rows(session_turns).repartition("session_id").sortWithinPartitions("session_id", "at", "turn_idx").mapInPandas(run, EVENTS)


def instances(events: DataFrame) -> DataFrame:
    """A row for each belief: birth_ts, last_refresh_ts, ended_ts, ended (retired, contradicted or lapsed), reason and the number of refreshes."""
    opens, ends = F.col("event").isin("born", "refreshed"), F.col("event").isin("retired", "contradicted", "lapsed")
    # of one belief and turn there is one birth; a belief that ends lapses no more
    return events.groupBy("session_id", "belief_name", "anchor").agg(
        F.min(F.when(opens, F.col("ts"))).alias("birth_ts"), F.max(F.when(opens, F.col("ts"))).alias("last_refresh_ts"), F.max(F.when(ends, F.col("ts"))).alias("ended_ts"),
        F.max(F.when(ends, F.col("event"))).alias("ended"), F.max(F.when(ends, F.col("reason"))).alias("reason"), F.count_if(F.col("event") == "refreshed").alias("n_refreshes"),
    )
