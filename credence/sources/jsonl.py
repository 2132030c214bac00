"""JSON-lines sources and sinks with fixed schemas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

EVENT = "id string, timestamp string, text string, metadata map<string,string>, outcome string"
EVENT_STRUCT = "struct<id:string,timestamp:string,text:string,metadata:map<string,string>,outcome:string>"
TURN = "uuid string, parentUuid string, timestamp string, type string, cwd string, gitBranch string, isSidechain boolean, message struct<role:string,content:string>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 1) and raw of all lines of files. A file of any size is read split by split: lines are numbered inside
    a split, and the counts of the splits before it are added."""
    m = "_metadata.file_path", "_metadata.file_block_start"
    rows = spark.read.text(path, lineSep="\n").select(F.col(m[0]).alias("path"), F.col(m[1]).alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    counts = rows.groupBy("path", "block").agg(F.count("*").alias("n"))
    before = counts.select("path", "block", F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = rows.withColumn("k", F.row_number().over(Window.partitionBy("path", "block").orderBy("id")))
    return inside.join(before, ["path", "block"]).select("path", (F.col("k") + F.col("before")).cast("long").alias("line"), F.regexp_replace("value", "\r$", "").alias("raw"))


def instant(text) -> object:
    """A timestamp without zone from ISO text; an offset is applied (the session's zone is taken as UTC), digits beyond
    microseconds are dropped, bad text gives null."""
    cut = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    return F.try_to_timestamp(cut).cast("timestamp_ntz")


def load_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON lines; blank lines and those that start with # are skipped, bad ones raise with their place."""
    lines = numbered_lines(spark, path).where((F.trim("raw") != "") & ~F.startswith(F.ltrim("raw"), F.lit("#")))
    e = F.from_json("raw", EVENT)
    fault = F.raise_error(F.concat(F.lit("bad event at "), "path", F.lit(":"), F.col("line").cast("string")))
    lines = lines.withColumn("e", F.when(e.isNotNull() & e["id"].isNotNull() & e["timestamp"].isNotNull(), e).otherwise(fault.cast(EVENT_STRUCT)))
    ts = instant(F.col("e.timestamp"))
    empty = F.expr("cast(map() as map<string,string>)")
    return lines.select(F.col("e.id").alias("id"), ts.alias("timestamp"), F.coalesce("e.text", F.lit("")).alias("text"), F.coalesce("e.metadata", empty).alias("metadata"), F.col("e.outcome").alias("outcome"))


def session_id(path) -> object:
    """main::stem, or subagent::first 8 characters of the parent folder::stem."""
    stem = F.regexp_extract(path, r"([^/]+)\.jsonl$", 1)
    parent = F.regexp_extract(path, r"([^/]+)/subagents/[^/]+\.jsonl$", 1)
    return F.when(parent != "", F.concat(F.lit("subagent::"), F.substring(parent, 1, 8), F.lit("::"), stem)).otherwise(F.concat(F.lit("main::"), stem))


def _summary(name, given):
    """What is kept of a tool's input (JSON text): the command, the file, the pattern, else the whole, shortened."""
    field = lambda k: F.get_json_object(given, f"$.{k}")
    return (
        F.when(given.isNull(), "")
        .when(name == "Bash", text.shortened(F.coalesce(field("command"), F.lit("")), 400))
        .when(name.isin("Edit", "Write", "MultiEdit", "Read"), F.concat(F.lit("file="), F.coalesce(field("file_path"), F.lit("?"))))
        .when(name == "Grep", F.concat(F.lit("pattern="), F.substring(F.coalesce(field("pattern"), F.lit("?")), 1, 120)))
        .when(name == "Glob", F.concat(F.lit("pattern="), F.coalesce(field("pattern"), F.lit("?"))))
        .otherwise(text.shortened(given, 300))
    )


def parts_of(content) -> tuple:
    """(text, tool_uses, tool_results) of a message's content, which is text or a JSON array of parts."""
    listed = F.startswith(F.ltrim(content), F.lit("["))
    items = F.coalesce(F.when(listed, F.from_json(content, "array<string>")), F.expr("cast(array() as array<string>)"))
    get = lambda x, k: F.get_json_object(x, f"$.{k}")
    of = lambda kind: F.filter(items, lambda x: get(x, "type") == kind)
    said = F.array_join(F.filter(F.transform(items, lambda x: F.when(get(x, "type") == "text", get(x, "text")).when(get(x, "type").isNull(), x)), lambda x: x.isNotNull()), "\n")
    uses = F.transform(of("tool_use"), lambda x: F.struct(get(x, "name").alias("name"), get(x, "id").alias("tool_use_id"), _summary(get(x, "name"), get(x, "input")).alias("input_summary")))

    def output(x):
        inner = get(x, "content")
        blocks = F.from_json(inner, "array<string>")
        joined = F.array_join(F.filter(F.transform(blocks, lambda y: F.when(get(y, "type") == "text", get(y, "text"))), lambda y: y.isNotNull()), "\n")
        return text.shortened(F.coalesce(F.when(F.startswith(F.ltrim(inner), F.lit("[")), joined), inner, F.lit("")), 600)

    results = F.transform(of("tool_result"), lambda x: F.struct(get(x, "tool_use_id").alias("tool_use_id"), output(x).alias("output_summary"), F.coalesce(get(x, "is_error") == "true", F.lit(False)).alias("is_error")))
    return F.when(listed, said).otherwise(F.coalesce(content, F.lit(""))), uses, results


def load_sessions(spark: SparkSession, path: str) -> DataFrame:
    """User and assistant turns of session logs with their tool uses and results; bad lines are skipped; turn_idx counts the kept
    ones of a file."""
    t = numbered_lines(spark, path).withColumn("t", F.from_json("raw", TURN)).where(F.col("t.type").isin("user", "assistant"))
    idx = F.row_number().over(Window.partitionBy("path").orderBy("line")) - 1
    said, uses, results = parts_of(F.get_json_object("raw", "$.message.content"))
    return t.select(
        session_id(F.col("path")).alias("session_id"), idx.cast("long").alias("turn_idx"), F.col("t.uuid").alias("uuid"), F.col("t.parentUuid").alias("parent_uuid"), F.col("t.timestamp").alias("timestamp"), F.col("t.type").alias("role"),
        said.alias("text"), uses.alias("tool_uses"), results.alias("tool_results"), F.col("t.cwd").alias("cwd"), F.col("t.gitBranch").alias("git_branch"), F.coalesce("t.isSidechain", F.lit(False)).alias("is_sidechain"), text.is_meta(F.col("t.type"), said).alias("is_meta"),
    )


def load_rollout(spark: SparkSession, path: str) -> DataFrame:
    """Lines of rollout logs (session_id, line, raw); the first line must be a session_meta with an id; blank lines are
    skipped but counted."""
    lines = numbered_lines(spark, path)
    head = lines.where("line = 1").select("path", F.get_json_object("raw", "$.type").alias("kind"), F.get_json_object("raw", "$.payload.id").alias("session_id"))
    bad = F.raise_error(F.concat(F.lit("no session_meta in "), "path")).cast("string")
    head = head.select("path", F.when((F.col("kind") == "session_meta") & F.col("session_id").isNotNull(), F.col("session_id")).otherwise(bad).alias("session_id"))
    return lines.where(F.trim("raw") != "").join(head, "path").select("session_id", "line", "raw")


def classify_lines(lines: DataFrame) -> DataFrame:
    """status (mapped, ignored-known, unrecognized) and event_type of raw lines, by type, payload type and role."""
    kind, sub, role = (F.get_json_object("raw", p) for p in ("$.type", "$.payload.type", "$.payload.role"))
    event = (
        F.when((kind == "event_msg") & (sub == "user_message"), "user_message")
        .when((kind == "response_item") & (sub == "function_call"), "tool_call")
        .when((kind == "response_item") & (sub == "function_call_output"), "tool_result")
        .when((kind == "response_item") & (sub == "message") & (role == "assistant"), "assistant_message")
    )
    known = (kind == "session_meta") | (kind == "turn_context") | ((kind == "event_msg") & sub.isin("token_count", "agent_message", "agent_reasoning")) | ((kind == "response_item") & sub.isin("reasoning", "message"))
    status = F.when(event.isNotNull(), "mapped").when(F.coalesce(known, F.lit(False)), "ignored-known").otherwise("unrecognized")
    return lines.withColumns({"event_type": event, "status": status, "turn_id": F.get_json_object("raw", "$.payload.turn_id"), "call_id": F.get_json_object("raw", "$.payload.call_id")})


def tool_outcome(output, tool=None):
    """struct(exit_code, outcome) of a tool's output text: by the exit code it names; without one, a shell call is unknown and
    other tools have succeeded if a mark of success is there (exit code 0)."""
    code = F.nullif(F.regexp_extract(output, r"Process exited with code (\d+)", 1), F.lit("")).cast("int")
    tool = F.lit("") if tool is None else F.coalesce(tool, F.lit(""))
    marked = F.lit(False)
    for mark in text.SUCCESS_MARKS:
        marked = marked | F.coalesce(F.contains(output, F.lit(mark)), F.lit(False))
    said = F.when(code == 0, "success").when(code.isNotNull(), "failure").when((tool != "exec_command") & marked, "success").otherwise("unknown")
    return F.struct(F.coalesce(code, F.when(said == "success", 0)).alias("exit_code"), said.alias("outcome"))


def first_command_word(commands: DataFrame, column: str = "command") -> DataFrame:
    """The first shell word of a command, quotes honoured; plain splitting where the quoting is broken."""
    @F.pandas_udf("string")
    def first(s: pd.Series) -> pd.Series:
        import shlex

        def one(c):
            try:
                return next(iter(shlex.split(c or "")), None)
            except ValueError:
                return next(iter((c or "").split()), None)

        return s.map(one)

    return commands.withColumn("tool_name", first(column))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One compact JSON object a row, keys in alphabetical order."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.text(path)
