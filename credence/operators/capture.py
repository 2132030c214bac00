"""Capture end to end: raw log lines to normalised events, rules, the ledger's tables, and overlays."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources import jsonl
from . import ledger, rules

_NONE = "cast(array() as array<string>)"


def _json(path: str) -> Column:
    return F.get_json_object("raw", path)


def _content() -> Column:
    """The text of a message: its message, or its content as text, or the texts of its content's parts as lines."""
    content = F.coalesce(_json("$.payload.message"), _json("$.payload.content"))
    listed = F.startswith(F.ltrim(content), F.lit("["))
    part = lambda x: F.when(F.startswith(x, F.lit("{")), F.coalesce(F.nullif(F.get_json_object(x, "$.text"), F.lit("")), F.get_json_object(x, "$.content"))).otherwise(x)
    return F.when(listed, F.array_join(F.filter(F.transform(F.from_json(content, "array<string>"), part), lambda x: x.isNotNull()), "\n")).otherwise(F.coalesce(content, F.lit("")))


def parsed(lines: DataFrame) -> DataFrame:
    """Raw lines with what can be told from each line alone: status, event_type, turn_id, call_id, tool_name, command, paths, content and output."""
    t = jsonl.classify_lines(lines)
    given, name = _json("$.payload.arguments"), _json("$.payload.name")
    arg = lambda k: F.get_json_object(given, f"$.{k}")
    call = F.coalesce(F.col("event_type") == "tool_call", F.lit(False))
    shell = call & (name == "exec_command")
    patch = F.regexp_extract_all(F.coalesce(arg("input"), arg("patch"), F.lit("")), F.lit(r"(?m)^\*\*\* (?:Add File|Update File|Delete File|Move to): (.+)$"), F.lit(1))
    every = F.concat(F.array_compact(F.array(arg("path"), arg("file_path"))), F.coalesce(F.from_json(arg("paths"), "array<string>"), F.expr(_NONE)), F.when(name == "apply_patch", F.transform(patch, F.trim)).otherwise(F.expr(_NONE)))
    t = t.withColumns({
        "command": F.when(shell, F.coalesce(arg("cmd"), F.lit(""))).when(call, ""), "content": F.when(F.col("event_type").isin("assistant_message", "user_message"), _content()),
        "paths": F.when(call, F.array_distinct(F.filter(every, lambda p: p != ""))), "output": F.when(F.col("event_type") == "tool_result", F.coalesce(_json("$.payload.output"), F.lit(""))), "__name": name, "__shell": shell,
    })
    t = jsonl.first_command_word(t, "command")
    return t.withColumn("tool_name", F.when(F.col("__shell"), F.coalesce("tool_name", F.lit("exec_command"))).when(call, F.col("__name"))).drop("__name", "__shell")


def normalise(lines: DataFrame) -> DataFrame:
    """Events of classified raw lines (session_id, line, raw): event_id (the line), turn, event_type, call_id, parent_id,
    tool_name, command, paths, content, output, exit_code and outcome.

    A result takes tool, command and paths from the latest earlier event with its call id."""
    t = ledger.resolve_turns(parsed(lines)).where("status = 'mapped'")
    call = F.col("event_type") == "tool_call"
    w = Window.partitionBy("session_id", "call_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    known = lambda c: F.when((F.col("event_type") == "tool_result") & F.col("call_id").isNotNull(), F.last(F.when(call, F.col(c)), ignorenulls=True).over(w)).otherwise(F.col(c))
    t = t.withColumns({"parent_id": F.when((F.col("event_type") == "tool_result") & F.col("call_id").isNotNull(), F.last("line").over(w)), **{c: known(c) for c in ("tool_name", "command", "paths")}})
    said = jsonl.tool_outcome(F.col("output"), F.col("tool_name"))
    t = t.withColumns({"exit_code": F.when(F.col("output").isNotNull(), said["exit_code"]), "outcome": F.when(F.col("output").isNotNull(), said["outcome"])})
    return t.select("session_id", F.col("line").alias("event_id"), "turn", "event_type", "call_id", "parent_id", "tool_name", "command", "paths", "content", "output", "exit_code", "outcome")


def validation_parents(results: DataFrame, calls: DataFrame) -> DataFrame:
    """The validation call that each result belongs to: event_id and parent_event.

    By parent id where there is one; else the latest call of the session with this tool and command. No parent if that call is
    no validation. results: session_id, event_id, parent_id, tool_name, command; calls: session_id, event_id, tool_name, command."""
    checked = calls.withColumn("ok", text.is_validation(F.col("tool_name"), F.col("command")))
    direct = results.where("parent_id is not null").join(checked.select("session_id", F.col("event_id").alias("parent_id"), "ok"), ["session_id", "parent_id"]).where("ok").select("event_id", F.col("parent_id").alias("parent_event"))
    last = checked.where("tool_name is not null and command is not null").groupBy("session_id", "tool_name", "command").agg(F.max("event_id").alias("parent_event"), F.max_by("ok", "event_id").alias("ok")).where("ok")
    return direct.unionByName(results.where("parent_id is null").join(last, ["session_id", "tool_name", "command"]).select("event_id", "parent_event"))


def marks(events: DataFrame) -> DataFrame:
    """Events with what the rules ask of tool, command, paths and content: checks, edits, report (the first report path), asks, grants, denies."""
    said = lambda kind, bank: F.coalesce(F.col("event_type") == kind, F.lit(False)) & text.matches_any(F.col("content"), bank)
    return events.withColumns({
        "checks": text.is_validation(F.col("tool_name"), F.col("command")), "edits": F.coalesce(F.col("tool_name").isin(*text.EDIT_TOOLS), F.lit(False)),
        "report": F.get(F.filter("paths", lambda p: text.matches_any(p, text.REPORT_PATHS)), F.lit(0)), "asks": said("assistant_message", text.APPROVAL_REQUEST),
        "grants": said("user_message", text.APPROVAL_GRANT), "denies": said("user_message", text.APPROVAL_DENY),
    })


def rule_rows(events: DataFrame) -> DataFrame:
    """The rows that the rules fold reads, in order; an edit is a tool call too, a report's write is a result too, and an event
    without rules advances the turn."""
    kind, call, result = F.col("event_type"), F.col("event_type") == "tool_call", F.col("event_type") == "tool_result"
    events = marks(events)
    kinds = F.array_compact(F.array(
        F.when(call & F.col("checks"), "validation_call").when(call, "tool_call").when(result, "tool_result").when(F.col("asks"), "approval_request").when(F.col("grants") | F.col("denies"), "user_message").otherwise("turn"),
        F.when(call & F.col("edits"), "edit"), F.when(result & (F.col("exit_code") == 0) & F.col("edits") & F.col("report").isNotNull(), "report_write"),
    ))
    rows = events.select("*", F.posexplode(kinds).alias("k", "kind"))
    return rows.select(
        "session_id", (F.col("event_id") * 2 + F.col("k")).alias("event_id"), "turn", "kind", "call_id", F.col("tool_name").alias("tool"), "command", F.col("exit_code").cast("long").alias("exit_code"),
        F.when((F.col("kind") == "tool_result") & (F.col("exit_code") != 0), text.failure_signature(F.col("exit_code"), F.col("output"))).alias("signature"),
        F.when(F.col("kind") == "report_write", F.col("report")).otherwise(F.nullif(F.array_join("paths", "\n"), F.lit(""))).alias("path"), "grants", "denies",
    )


def to_ledger(emitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(beliefs, belief events) of the folded rules, whose authority is that of the event which they follow from."""
    e = emitted.withColumn("belief_event_id", F.struct("source_event", "belief_id").cast("string"))
    b = e.where("kind = 'born'").groupBy("belief_id", "session_id", "belief_type").agg(F.min("effective_turn").alias("created_turn"), F.min("event_id").alias("event"))
    claims = b.withColumn("claim", F.concat("belief_type", F.lit(" from line "), F.col("event").cast("string"))).drop("event")
    return claims, e.select("belief_event_id", "belief_id", "kind", "at_turn", "effective_turn", F.coalesce("authority", F.lit("assistant")).alias("authority"))


def capture(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, beliefs, belief events) of raw log lines (session_id, line, raw).

    What the rules give is read several times but folded once: it stays on the executors' disks. A row may follow from an event
    before the one at which the rules gave it."""
    events = normalise(lines)
    authority = F.when(F.col("event_type") == "tool_result", "tool").when(F.col("event_type") == "user_message", "user").otherwise("assistant")
    of = events.select(F.col("session_id").cast("string").alias("session_id"), "event_id", authority.alias("authority"))
    emitted = rules.fold(rule_rows(events)).withColumn("event_id", F.floor(F.col("source_event") / 2)).join(of, ["session_id", "event_id"], "left")
    return events, *to_ledger(emitted.persist(StorageLevel.DISK_ONLY))


def capture_overlay(lines: DataFrame, turn: int, budget: int, k: int = 20) -> DataFrame:
    """The overlay of each session as of ``turn``, from its raw lines."""
    _, beliefs, happened = capture(lines)
    return ledger.overlay(beliefs, happened, turn, budget, k)


def envelopes(rows: DataFrame) -> DataFrame:
    """session_id, line and raw of JSON envelopes (column value: session_id, source_line_number, raw_line), or the fault that
    keeps one out."""
    kind = lambda k: F.expr(f"schema_of_variant(variant_get(try_parse_json(value), '$.{k}', 'variant'))")
    body, get = F.expr("try_parse_json(value)"), lambda k: F.get_json_object("value", f"$.{k}")
    names = ("session_id", "source_line_number", "raw_line")
    missing = F.array_compact(F.array(*(F.when(kind(k).isNull(), k) for k in names)))
    number = get("source_line_number").try_cast("long")
    # fixed values: the texts of the faults
    fault = (
        F.when(body.isNull() | ~F.startswith(F.expr("schema_of_variant(try_parse_json(value))"), F.lit("OBJECT")), "envelope must be a JSON object")
        .when(F.size(missing) > 0, F.concat(F.lit("envelope missing required keys: "), F.array_join(missing, ", ")))
        .when((kind("session_id") != "STRING") | (get("session_id") == ""), "envelope session_id must be a non-empty string")
        .when((kind("source_line_number") != "BIGINT") | (number < 1), "envelope source_line_number must be a positive integer")
        .when(kind("raw_line") != "STRING", "envelope raw_line must be a string")
    )
    out = rows.withColumn("fault", fault)
    good = F.col("fault").isNull()
    return out.select(F.when(good, get("session_id")).alias("session_id"), F.when(good, number).alias("line"), F.when(good, get("raw_line")).alias("raw"), "fault")


def dead_letters(folded: DataFrame) -> DataFrame:
    """The audit rows of rule failures, of what rules.fold_with_faults returns: session_id, event_id, rule_name, exception_class, exception_message."""
    return folded.where("fault is not null").select("session_id", F.floor(F.col("source_event") / 2).alias("event_id"), F.col("fault.rule").alias("rule_name"), F.col("fault.kind").alias("exception_class"), F.col("fault.message").alias("exception_message"))
