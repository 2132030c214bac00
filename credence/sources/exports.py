"""Session exports that are equal byte by byte, and the end of a session's lines.

An event is one line of JSON with its keys in alphabetical order at every level (a variant writes them so), the payload
parsed, and the beliefs that were active as of its turn. Sessions are dealt to a given number of files by a hash of their id,
so a file's bytes do not depend on the partitions of the run; each file is named with its lines and digest in a manifest that is
written last.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def canonical(json: str):
    """JSON text with sorted keys and no spaces, null where it is none."""
    return F.to_json(F.try_parse_json(json))


def records(events: DataFrame, beliefs: DataFrame, intervals: DataFrame) -> DataFrame:
    """session_id, turn, event_idx, line and json of each event.

    events: session_id, turn, event_idx, line, source_event_id, event_type, timestamp (string), call_id, outcome, payload (JSON text);
    beliefs: belief_id, session_id, belief_type, claim, created_turn; intervals: belief_id, state, from_turn, to_turn. A snapshot
    is made once for each (session, turn)."""
    live = intervals.where("state <> 'retired'").join(beliefs, "belief_id")
    turns = events.select("session_id", "turn").distinct()
    known = live.join(turns, "session_id").where((F.col("turn") >= F.greatest("from_turn", "created_turn")) & (F.col("to_turn").isNull() | (F.col("turn") < F.col("to_turn"))))
    one = F.struct(F.col("belief_id").cast("string").alias("belief_id"), "belief_type", "claim", "created_turn", "state")
    counts = lambda xs: F.map_from_entries(F.transform(F.array_sort(F.array_distinct(F.transform(xs, lambda x: x["state"]))), lambda s: F.struct(s, F.size(F.filter(xs, lambda x: x["state"] == s)))))
    state = known.groupBy("session_id", "turn").agg(F.array_sort(F.collect_list(one)).alias("active"))
    rows = events.join(state, ["session_id", "turn"], "left")
    none = F.expr("cast(array() as array<struct<belief_id:string,belief_type:string,claim:string,created_turn:bigint,state:string>>)")
    active = F.coalesce("active", none)
    body = F.to_json(F.struct(active.alias("active_beliefs_at_turn"), counts(active).alias("active_belief_counts"), "call_id", "event_idx", "event_type", F.col("outcome").alias("outcome_status"), F.lit(None).cast("string").alias("payload"), "session_id", "source_event_id", F.col("line").alias("source_line_number"), "timestamp", F.col("turn").alias("turn_idx")), {"ignoreNullFields": "false"})
    # the payload is put in as JSON, not as text
    whole = F.replace(body, F.lit('"payload":null'), F.concat(F.lit('"payload":'), F.coalesce(canonical("payload"), F.lit("null"))))
    return rows.select("session_id", "turn", "event_idx", "line", canonical(whole).alias("json"))


def write(rows: DataFrame, folder: str, files: int = 16) -> DataFrame:
    """Writes ``records`` to ``files`` text files and returns the manifest: bucket, n_sessions, n_lines and the sha256 of the file's lines."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(F.col("session_id").cast("string")), F.lit(files)).cast("int"))
    order = ("session_id", "turn", "event_idx", "line")
    ordered = dealt.repartition(files, "bucket").sortWithinPartitions("bucket", *order)
    ordered.select("bucket", F.col("json").alias("value")).write.partitionBy("bucket").text(f"{folder}/lines")
    named = ordered.select("bucket", F.col("session_id").cast("string").alias("session_id"), "json").mapInArrow(_summed, "bucket int, n_sessions long, n_lines long, sha256 string")
    named.coalesce(1).write.parquet(f"{folder}/manifest")
    return rows.sparkSession.read.parquet(f"{folder}/manifest")


def _summed(batches):
    """(bucket, sessions, lines, sha256) of runs of rows (bucket, session_id, json), hashed as they pass."""
    now, last, sessions, lines, digest, out = None, None, 0, 0, None, []
    for batch in batches:
        for bucket, session, line in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now:
                out += [(now, sessions, lines, digest.hexdigest())] if digest else []
                now, last, sessions, lines, digest = bucket, None, 0, 0, hashlib.sha256()
            sessions, last = sessions + (session != last), session
            lines += 1
            digest.update(line.encode() + b"\n")
    out += [(now, sessions, lines, digest.hexdigest())] if digest else []
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.string()))], names=["bucket", "n_sessions", "n_lines", "sha256"])


def admit(lines: DataFrame, closed: DataFrame) -> DataFrame:
    """``lines`` (session_id, line, raw) with a status: finalized for all lines of sessions that are closed (session_id), else replayed for
    an equal line that came before, mutated for another one of the same number, out_of_order after a gap, and accepted.

    Lines of a session are judged in the order of ``line``; of equal numbers the first raw text counts."""
    rows = lines.join(closed.select("session_id").distinct().withColumn("closed", F.lit(True)), "session_id", "left")
    same = Window.partitionBy("session_id", "line").orderBy("raw")
    place = Window.partitionBy("session_id").orderBy("line")
    first = F.first("raw").over(same)
    rows = rows.withColumns({"nth": F.row_number().over(same), "kept": first, "rank": F.dense_rank().over(place)})
    status = F.when(F.col("closed"), "finalized").when(F.col("rank") != F.col("line"), "out_of_order").when(F.col("nth") == 1, "accepted").when(F.col("raw") == F.col("kept"), "replayed").otherwise("mutated")
    return rows.select("session_id", "line", "raw", status.alias("status"))
