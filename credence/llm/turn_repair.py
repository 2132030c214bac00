"""Repair of conversation structure by a native fold over each conversation's turns.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?``: an optional system turn, then user and assistant
in turn. Windows mark the faults of each row (blank, duplicate, truncated). ``aggregate()`` then carries four states (nothing
yet, after a system turn, after a user turn, after an assistant turn) through the sorted turns, each with its cheapest
(cost, audit) struct, and ``least`` picks the cheapest, ties by the ASCII-least audit. Edits: Keep 0; Rerole to user or
assistant 3; Delete 4, required for blank and duplicate rows; Insert an empty user or assistant turn anywhere 3; a
truncated row that is not deleted adds 3.

Long conversations are cut in chunks of CHUNK turns. A chunk is folded from each of the four states that may lie before it,
and a second fold composes the chunks, so that no array holds a whole long conversation's turns and audits are copied once a
chunk, not once a turn. Cutting changes no result. An audit and the initials fix the repaired roles: the number of turns
that stay tells whether a system turn leads, and then roles alternate. Windows and the digest go through a conversation in
order, so they stream it in one task, with memory for a few rows.

Defined cases: a null role or text counts as one space (so such a text is blank and such a role fits no place), a null
conv_id is a conversation of its own and in keys one space, null turns come first; rows of one turn go by role, then text;
repeated rows are duplicates; a conversation without rows gets zeros, an empty audit and the digest of the empty string;
empty tables give empty results; very long texts are only read, moved and hashed; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Turns in one array.
CHUNK = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_STATE = "struct<cost:bigint,audit:string>"
_STATES = f"struct<s0:{_STATE},s1:{_STATE},s2:{_STATE},s3:{_STATE}>"
_SPACES = r"\x20\x09-\x0D"


def damage(conversations: DataFrame) -> DataFrame:
    """Planted faults, by the row's key: a row in twenty each is dropped, emptied, stripped of ``.!?``, doubled or made a user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(1), F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1))
    return rows.withColumn("k", kind).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies)).drop("col")


def faults(rows: DataFrame) -> DataFrame:
    """Each row with its place ``pos`` (from 1) in the conversation, its role's initial, its first fault (or null) and whether the step from
    the row before is illegal; rows: conv_id, turn, role, text without nulls in the last two."""
    ordered = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    same = Window.partitionBy("conv_id", "role", "text").orderBy("pos")
    last = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), -1, 1)
    fault = F.when(last == "", "blank").when(F.col("nth") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    step = F.concat(F.lag(initial).over(ordered), initial)
    rows = rows.select("conv_id", "turn", "role", "text", initial.alias("initial"), F.row_number().over(ordered).cast("long").alias("pos"), F.coalesce(~step.isin("su", "ua", "au"), F.lit(False)).alias("illegal"))
    return rows.withColumn("nth", F.row_number().over(same)).withColumn("fault", fault).drop("nth")


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _add(state: Column, cost, letter: str) -> Column:
    return F.when(state.isNotNull(), F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], F.lit(letter)).alias("audit")))


def _none() -> Column:
    return F.lit(None).cast(_STATE)


def _states(s0: Column, s1: Column, s2: Column, s3: Column) -> Column:
    return F.struct(s0.alias("s0"), s1.alias("s1"), s2.alias("s2"), s3.alias("s3"))


def _inserted(acc: Column) -> Column:
    """The states after up to two inserted turns; more only add to the cost."""
    one = lambda x: _states(x["s0"], x["s1"], F.least(x["s2"], _add(F.least(x["s0"], x["s1"], x["s3"]), F.lit(INSERT), "I")), F.least(x["s3"], _add(x["s2"], F.lit(INSERT), "I")))
    return _let(_let(acc, one), one)


def _turned(acc: Column, turn: Column) -> Column:
    """The states after a turn, which is kept, given another role or deleted."""

    def step(x: Column) -> Column:
        extra = F.when(turn["truncated"], TRUNCATED).otherwise(0)
        stays = lambda where, state, cost, letter: F.when(~turn["must_go"] & where, _add(state, cost + extra, letter))
        gone = lambda s: _add(s, F.lit(DELETE), "D")
        is_ = lambda c: turn["initial"] == c
        before_user, always = F.least(x["s0"], x["s1"], x["s3"]), F.lit(True)
        return _states(
            gone(x["s0"]),
            F.least(gone(x["s1"]), stays(is_("s"), x["s0"], F.lit(KEEP), "K")),
            F.least(gone(x["s2"]), stays(is_("u"), before_user, F.lit(KEEP), "K"), stays(always, before_user, F.lit(REROLE), "R")),
            F.least(gone(x["s3"]), stays(is_("a"), x["s2"], F.lit(KEEP), "K"), stays(always, x["s2"], F.lit(REROLE), "R")),
        )

    return _let(_inserted(acc), step)


def _start(k: int) -> Column:
    zero = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"))
    return _states(*(zero if j == k else _none() for j in range(4))).cast(_STATES)


def _composed(acc: Column, chunk: Column) -> Column:
    """The states after a chunk, from those before it and the chunk's own from each of them."""
    through = lambda s, part, j: F.when(acc[s].isNotNull() & part[j].isNotNull(), F.struct((acc[s]["cost"] + part[j]["cost"]).alias("cost"), F.concat(acc[s]["audit"], part[j]["audit"]).alias("audit")))
    return _states(*(F.least(*(through(f"s{k}", chunk["parts"][k], f"s{j}") for k in range(4))) for j in range(4)))


def plan(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, cost and audit of each conversation's cheapest repair; rows: as ``faults`` returns them."""
    turn = F.struct("pos", "initial", F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("must_go"), F.coalesce(F.col("fault") == "truncated", F.lit(False)).alias("truncated"))
    chunks = rows.groupBy("conv_id", F.floor((F.col("pos") - 1) / chunk).alias("chunk")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    fold = lambda k: F.aggregate("turns", _start(k), _turned)
    later = lambda k: F.when(F.col("chunk") > 0, fold(k))
    parts = chunks.select("conv_id", "chunk", F.array(fold(0), later(1), later(2), later(3)).alias("parts"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "parts"))).alias("chunks"))
    end = F.aggregate("chunks", _start(0), _composed, lambda acc: _let(_inserted(acc), lambda x: F.least(x["s0"], x["s3"])))
    return whole.select("conv_id", end.alias("end")).select("conv_id", "end.cost", "end.audit")


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, pos, nth, role, text: the turns of the repaired conversations, in order of (pos, nth).

    Inserted turns stand before the row whose pos they carry, those at the end behind the last."""
    letters = plans.select("conv_id", F.pmod(F.length(F.translate("audit", "D", "")), F.lit(2)).alias("lead"), F.posexplode(F.regexp_extract_all("audit", F.lit("I*[KRD]|I+$"), F.lit(0))))
    ordered = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    token = letters.select("conv_id", "lead", (F.col("pos") + 1).cast("long").alias("pos"), F.col("col").alias("token"))
    before = F.coalesce(F.sum(F.length(F.translate("token", "D", ""))).over(ordered), F.lit(0))
    token = token.withColumn("before", before).withColumnsRenamed({"conv_id": "t_conv", "pos": "t_pos"})
    both = token.join(rows, F.col("conv_id").eqNullSafe(F.col("t_conv")) & (F.col("pos") == F.col("t_pos")), "left")
    role = lambda k: F.when(F.pmod(F.col("before") + k - F.col("lead"), F.lit(2)) == 0, "user").otherwise("assistant")
    inserts = F.length(F.translate("token", "KRD", ""))
    end = F.substring("token", -1, 1)
    filled = F.transform(F.sequence(F.lit(1), inserts), lambda k: F.struct((k - 1).alias("nth"), role(k - 1).alias("role"), F.lit("").alias("text")))
    added = F.when(inserts > 0, filled).otherwise(F.array().cast("array<struct<nth:int,role:string,text:string>>"))
    own = F.struct(inserts.alias("nth"), F.when(end == "K", F.col("role")).otherwise(role(inserts)).alias("role"), F.col("text"))
    turns = F.when(end.isin("K", "R"), F.concat(added, F.array(own))).otherwise(added)
    return both.select(F.col("t_conv").alias("conv_id"), F.col("t_pos").alias("pos"), F.explode(turns).alias("x")).select("conv_id", "pos", "x.nth", "x.role", "x.text")


def _digests(batches):
    """(conv_id, digest) of runs of rows (conv_id, line) with equal ids, hashed as they pass."""
    id_, digest = None, None
    for batch in batches:
        ids, out = [], []
        for x, line in zip(batch.column(0).to_pylist(), batch.column(1)):
            if digest is None or x != id_:
                if digest is not None:
                    ids.append(id_)
                    out.append(digest.hexdigest())
                id_, digest = x, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(line.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["conv_id", "digest"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([id_], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "digest"])


def digest(turns: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its ``role:text`` lines."""
    common.small_batches(turns.sparkSession)
    lines = turns.select("conv_id", "pos", "nth", F.concat_ws(":", "role", "text").cast("binary").alias("line"))
    lines = lines.repartition(common.shuffle_parts(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "pos", "nth")
    return lines.select("conv_id", "line").mapInArrow(_digests, "conv_id long, digest string")


def report(conversations: DataFrame, rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each conv_id of ``conversations``: counts of the faults of ``rows`` (conv_id, turn, role, text), the cheapest
    repair's cost and audit, and the digest of what it gives."""
    marked = common.cut(faults(rows))
    has = lambda x: F.count(F.when(F.col("fault") == x, 1)).alias(x)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    counts = marked.groupBy("conv_id").agg(gaps, has("blank"), has("duplicate"), has("truncated"), F.count_if("illegal").alias("illegal"))
    plans = common.cut(plan(marked, chunk))
    every = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    match = lambda df, name: df.withColumnRenamed("conv_id", name)
    out = every.join(match(counts, "c"), F.col("id").eqNullSafe(F.col("c")), "left")
    out = out.join(match(plans, "p"), F.col("id").eqNullSafe(F.col("p")), "left")
    out = out.join(match(digest(repaired(marked, plans)), "d"), F.col("id").eqNullSafe(F.col("d")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(F.col("id").alias("conv_id"), *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
