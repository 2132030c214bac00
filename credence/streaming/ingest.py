"""Ordered, replay-safe ingest of session lines as a stream.

State by session: the next line and the hash of the last. A line that was seen with the same hash is a replay and ignored;
with another hash it is a mutation and rejected; a line after a gap is rejected; others are accepted and chained. Rejected
lines come out with their status and change nothing. A row that is marked final closes its session: it comes out with the
number of accepted lines and the chain, the hashes of the lines are dropped from the state, and whatever comes later is
rejected as finalized. A micro-batch's lines of one session are sorted in one frame, so the trigger's limits (files or
offsets a trigger) bound it; the hashes of an open session's lines are in the state store, on disk. Envelopes that are no lines are told apart before (operators.capture.envelopes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "session_id string, line long, status string, chain string"


class Ingest(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "next_line long, chain string, closed boolean")
        self.seen = handle.getMapState("seen", "line long", "sha string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        following, chain, closed = self.at.get() if self.at.exists() else (1, "", False)
        frame = pd.concat(list(rows)).sort_values(["final", "line"], kind="stable")
        out = []
        for line, raw, final in zip(frame["line"].tolist(), frame["raw"].tolist(), frame["final"].tolist()):
            if closed:
                out.append((key[0], line, "finalized", None))
                continue
            if final:
                closed = True
                self.seen.clear()
                out.append((key[0], following - 1, "final", chain))
                continue
            sha = hashlib.sha256(raw.encode()).hexdigest()
            if self.seen.containsKey((line,)):
                status = "replayed" if self.seen.getValue((line,))[0] == sha else "mutated"
            elif line != following:
                status = "out_of_order"
            else:
                chain = hashlib.sha256(chain.encode() + raw.encode()).hexdigest()
                following, status = following + 1, "accepted"
                self.seen.updateValue((line,), (sha,))
            out.append((key[0], line, status, chain if status == "accepted" else None))
        self.at.update((following, chain, closed))
        yield pd.DataFrame(out, columns=["session_id", "line", "status", "chain"])

    def close(self) -> None:
        pass


def ingest(lines: DataFrame) -> DataFrame:
    """Status of each line of a streaming DataFrame (session_id, line, raw, and final where sessions are closed). Needs the
    RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    from pyspark.sql import functions as F

    keyed = lines.select(F.col("session_id").cast("string").alias("session_id"), F.col("line").cast("long").alias("line"), "raw", (F.coalesce("final", F.lit(False)) if "final" in lines.columns else F.lit(False)).alias("final"))
    return keyed.groupBy("session_id").transformWithStateInPandas(Ingest(), outputStructType=OUT, outputMode="append", timeMode="none")
