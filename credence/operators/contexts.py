"""Contexts and selections: candidates as of a turn, token cuts, arms, selection by actor, schema audits and warrants."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import belief

#: The schema version of warrants, life-cycle names, and fields that belief records must not or must have.
WARRANT_VERSION = "warrant-v0.1"
LIFECYCLE = ["born", "active", "reconfirmed", "weakened", "contradicted", "retired"]
LIFECYCLE_REMAP = {"strengthened": "reconfirmed"}
FORBIDDEN = ["answer_guidance", "prompt_hint", "caution_note", "instruction"]
REQUIRED = ["belief_id", "actor", "theme", "claim", "coverage_status", "confidence", "support_n", "lifecycle_state", "evidence_refs", "counterevidence_refs", "source_mix", "last_updated", "first_seen"]


def lifecycle(event: Column) -> Column:
    """A life-cycle name as it is, or by its new name, else active."""
    out = F.when(event.isin(*LIFECYCLE), event)
    for old, new in LIFECYCLE_REMAP.items():
        out = out.when(event == old, new)
    return out.otherwise("active")


def audit_schema(df: DataFrame, required: list[str] = REQUIRED, forbidden: list[str] = FORBIDDEN) -> DataFrame:
    """field and fault (missing or forbidden) of a table's columns."""
    faults = [(f, "missing") for f in required if f not in df.columns] + [(f, "forbidden") for f in forbidden if f in df.columns]
    return df.sparkSession.createDataFrame(faults, "field string, fault string")


def with_mode(rows: DataFrame, column: str = "variant") -> DataFrame:
    """The rows of the most frequent value of a column, the smallest of ties."""
    top = rows.groupBy(column).agg(F.count("*").alias("__n")).where(F.col(column).isNotNull()).orderBy(F.desc("__n"), column).limit(1).select(column)
    return rows.join(F.broadcast(top), column, "left_semi")  # one row


def candidates(beliefs: DataFrame, turn: int, k: int = 20) -> DataFrame:
    """Beliefs as of ``turn`` in the states active, weakened or contradicted, with last_updated held at the turn and whether
    both birth and last warrant are out of the window. beliefs: belief_id, turn_first_seen, turn_last_updated, warrant_turns
    and revision_trail (array of (turn, new_state), in order)."""
    seen = F.filter("revision_trail", lambda e: e["turn"] <= turn)
    state = F.coalesce(F.try_element_at(seen, F.lit(-1))["new_state"], F.lit("active"))
    last = F.coalesce("turn_last_updated", "turn_first_seen")
    held = F.when(last > turn, F.coalesce(F.array_max(F.transform(seen, lambda e: e["turn"])), F.col("turn_first_seen"))).otherwise(last)
    warrant = F.coalesce(F.array_max(F.filter("warrant_turns", lambda t: t <= turn)), F.col("turn_first_seen"))
    out = beliefs.where(F.col("turn_first_seen") <= turn).withColumns({"state": state, "last_updated": held, "outside": (F.col("turn_first_seen") <= turn - k) & (warrant <= turn - k)})
    return out.where(F.col("state").isin("active", "weakened", "contradicted"))


def cut_tokens(rows: DataFrame, column: str, cap: int, encode, decode) -> DataFrame:
    """``column`` held at ``cap`` tokens, with a note of how many went, and whether it was cut. ``encode`` and ``decode`` are a
    tokenizer's functions of text and of ids; they run in Arrow batches."""
    @F.pandas_udf("text string, was_cut boolean")
    def cut(s: pd.Series) -> pd.DataFrame:
        def one(t):
            ids = encode(t or "")
            return (t, False) if len(ids) <= cap else (f"{decode(ids[:cap])}\n[+{len(ids) - cap} tokens elided]", True)

        return pd.DataFrame([one(t) for t in s], columns=["text", "was_cut"])

    return rows.withColumn("__c", cut(F.col(column))).withColumns({column: F.col("__c.text"), "was_cut": F.col("__c.was_cut")}).drop("__c")


def last_turns(turns: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """The last k rendered turns up to each question's turn, joined by blank lines: question_id, payload, n_turns.

    turns: session_id, turn, line; questions: question_id, session_id, at_turn."""
    j = questions.join(turns, "session_id").where((F.col("turn") <= F.col("at_turn")) & (F.col("turn") > F.col("at_turn") - k))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n\n")
    return j.groupBy("question_id").agg(body.alias("payload"), F.count("*").alias("n_turns"))


def arms(turns: DataFrame, questions: DataFrame, overlays: DataFrame, k: int = 20, scratch: int = 3) -> DataFrame:
    """The contexts of three arms: A the last ``k`` turns, B the overlay, C the overlay and the last ``scratch`` turns; a
    question without an overlay or turns has empty ones. overlays: question_id, text."""
    q = questions.select("question_id")
    raw = lambda n: q.join(last_turns(turns, questions, n), "question_id", "left").select("question_id", F.coalesce("payload", F.lit("")).alias("p"))
    over = q.join(overlays.select("question_id", "text"), "question_id", "left").select("question_id", F.coalesce("text", F.lit("")).alias("o"))
    both = over.join(raw(scratch), "question_id").select("question_id", F.concat("o", F.lit("\n\n"), "p").alias("rendered"))
    out = raw(k).select("question_id", F.lit("A").alias("arm"), F.col("p").alias("rendered")).unionByName(over.select("question_id", F.lit("B").alias("arm"), F.col("o").alias("rendered"))).unionByName(both.select("question_id", F.lit("C").alias("arm"), "rendered"))
    return out.withColumn("token_count", belief.approx_tokens(F.col("rendered")))


def by_actor(rows: DataFrame, n: int, cap: int = 3) -> DataFrame:
    """Up to ``n`` candidates of each category, spread over actors: the best of each actor first, then the best others while an
    actor has fewer than ``cap``, then any. rows: category, actor, cutoff, score, id; one candidate for each (category, actor,
    cutoff) counts, the best, and ties go by id."""
    best = rows.withColumn("__r", F.row_number().over(Window.partitionBy("category", "actor", "cutoff").orderBy(F.desc("score"), "id"))).where("__r = 1").drop("__r")
    w = Window.partitionBy("category", "actor").orderBy(F.desc("score"), "id")
    phased = best.withColumn("of_actor", F.row_number().over(w))
    phase = F.when(F.col("of_actor") == 1, 1).when(F.col("of_actor") <= cap, 2).otherwise(3)
    return phased.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(phase, F.desc("score"), "id"))).where(F.col("rank") <= n).drop("of_actor")


def bag(*sources: DataFrame) -> DataFrame:
    """All rows of several belief sources; columns that a source lacks are null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


WARRANT = "schema_version string, warrant_type string, birth_timestamp string, support_n int, coverage_status string, confidence double, distance_to_centroid double, coverage_threshold double, relaxation_half_life_seconds int, evidence_refs array<string>, validation_status string"


KEPT = (
    "struct<warrant_type:string,birth_timestamp:string,support_n:int,coverage_status:string,confidence:double,distance_to_centroid:double,coverage_threshold:double,"
    "half_life_seconds:double,initial_confidence:double,evidence_refs:array<string>,validation_status:string>"
)


def warrant_to_json(w: Column) -> Column:
    """A warrant struct (the fields of WARRANT but the version; half_life_seconds as double) as JSON. The half-life is cut to
    whole seconds; the first confidence is not kept."""
    decaying = w["warrant_type"] == "decaying"
    return F.to_json(F.struct(
        F.lit(WARRANT_VERSION).alias("schema_version"), w["warrant_type"].alias("warrant_type"), w["birth_timestamp"].alias("birth_timestamp"), w["support_n"].alias("support_n"), w["coverage_status"].alias("coverage_status"),
        w["confidence"].alias("confidence"), w["distance_to_centroid"].alias("distance_to_centroid"), w["coverage_threshold"].alias("coverage_threshold"), F.when(decaying, w["half_life_seconds"].cast("int")).alias("relaxation_half_life_seconds"),
        F.when(~decaying, w["evidence_refs"]).alias("evidence_refs"), F.when(~decaying, w["validation_status"]).alias("validation_status"),
    ))


def warrant_from_json(json: Column) -> Column:
    """The warrant of a JSON text, or an error: the first confidence of a decaying one is its confidence, or 1.0 where that is
    null or zero; a missing support is 0, a missing coverage UNCLASSIFIED, a missing status UNKNOWN. The text is parsed once."""
    return F.get(F.transform(F.array(F.from_json(json, WARRANT)), _warrant), F.lit(0))


def _warrant(d: Column) -> Column:
    decaying = d["warrant_type"] == "decaying"
    # fixed values: the texts of the faults
    fault = (
        F.when(d["schema_version"].isNull() | (d["schema_version"] != WARRANT_VERSION), F.concat(F.lit("unsupported schema_version: "), F.coalesce(d["schema_version"], F.lit("none"))))
        .when(d["warrant_type"].isNull() | ~d["warrant_type"].isin("decaying", "invariant"), F.concat(F.lit("invalid warrant_type: "), F.coalesce(d["warrant_type"], F.lit("none"))))
        .when(decaying & d["relaxation_half_life_seconds"].isNull(), "decaying warrant requires relaxation_half_life_seconds")
    )
    kept = F.struct(
        d["warrant_type"].alias("warrant_type"), d["birth_timestamp"].alias("birth_timestamp"), F.coalesce(d["support_n"], F.lit(0)).alias("support_n"), F.coalesce(d["coverage_status"], F.lit("UNCLASSIFIED")).alias("coverage_status"),
        d["confidence"].alias("confidence"), d["distance_to_centroid"].alias("distance_to_centroid"), d["coverage_threshold"].alias("coverage_threshold"), F.when(decaying, d["relaxation_half_life_seconds"].cast("double")).alias("half_life_seconds"),
        F.when(decaying, F.coalesce(F.nullif(d["confidence"], F.lit(0.0)), F.lit(1.0))).alias("initial_confidence"), F.when(~decaying, F.coalesce(d["evidence_refs"], F.expr("cast(array() as array<string>)"))).alias("evidence_refs"),
        F.when(~decaying, F.coalesce(d["validation_status"], F.lit("UNKNOWN"))).alias("validation_status"),
    )
    return F.when(fault.isNull(), kept).otherwise(F.raise_error(fault).cast(KEPT))
