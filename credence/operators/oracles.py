"""Five-category oracle labels of points in sessions, and the interventions at turns, from belief intervals.

All of a session's intervals and points meet in one ordered window with running sums for each kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import belief

#: Windows in turns, occurrences that make a loop, and the belief names that are pending or block.
RECENT, HORIZON, LOOKBACK, LOOP = 20, 20, 5, 3
PENDING = ("validation_pending", "user_approval_pending", "pipeline_running", "pipeline_failed", "action_blocked")
BLOCKING = ("user_approval_pending", "validation_pending", "pipeline_failed", "pipeline_running", "action_blocked")
#: Weights from which a belief has authority, and seconds after which a running pipeline is stale, of both versions.
AUTHORITY, STALE_SECONDS = 0.7, {"v0.1": 20 * 60, "v0.2": 30 * 60}
CATEGORIES = {"validation_check": "stale_validation_assumption", "repeated_failure": "repeated_failure_loop", "approval_status": "premature_action", "completion_check": "false_completion_claim", "readiness_check": "missing_pause"}


def cover_counts(points: DataFrame, intervals: DataFrame, kinds: list[str]) -> DataFrame:
    """n_<kind>, the number of intervals of each kind that cover each point (session_id, turn), beside the point's columns.

    intervals: session_id, kind, from_turn, to_turn (exclusive, null while open); empty ones count nothing."""
    real = intervals.where("to_turn is null or to_turn > from_turn")
    begin = real.select("session_id", F.col("from_turn").cast("long").alias("turn"), "kind", F.lit(1).alias("d"))
    end = real.where("to_turn is not null").select("session_id", F.col("to_turn").cast("long").alias("turn"), "kind", F.lit(-1).alias("d"))
    at = points.withColumns({"turn": F.col("turn").cast("long"), "__p": F.lit(True)})
    w = Window.partitionBy("session_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = at.unionByName(begin.unionByName(end), allowMissingColumns=True)
    sums = {f"n_{k}": F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("d"))).over(w), F.lit(0)) for k in kinds}
    return both.withColumns(sums).where("__p").drop("__p", "kind", "d")


def first_after(rows: DataFrame, events: DataFrame, name: str, strict: bool) -> DataFrame:
    """``rows`` (session_id, turn) with the turn of the first event at or after (``strict``: after) each."""
    both = rows.withColumns({"turn": F.col("turn").cast("long"), "__r": F.lit(True)}).unionByName(events.select("session_id", F.col("turn").cast("long").alias("turn"), F.col("turn").cast("long").alias("__t")), allowMissingColumns=True)
    w = Window.partitionBy("session_id").orderBy(F.desc("turn")).rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    return both.withColumn(name, F.min("__t").over(w)).where("__r").drop("__r", "__t")


def score(points: DataFrame, beliefs: DataFrame, turns: DataFrame) -> DataFrame:
    """session_id, turn, category, metric, applicability (APPLICABLE or NA), oracle_class (POSITIVE, NEGATIVE) and oracle_state.

    points: session_id, turn; beliefs: session_id, belief_name, birth_turn, retired_turn (null while active), contradicted_turn;
    turns: session_id, turn, proposes, error, signature (of a failure), validated (booleans but for the signature)."""
    points = points.select("session_id", "turn").distinct()
    validated = turns.where("validated").select("session_id", "turn")
    fixes = beliefs.where("belief_name = 'fix_attempted'").select("session_id", F.col("birth_turn").alias("turn"), "retired_turn").distinct()
    fixes = first_after(first_after(fixes, validated, "from_birth", False), validated, "after_birth", True)
    end_of = lambda a, b: F.least(a, b)  # noqa: E731 - least skips nulls
    span = lambda df, kind, start, end: df.select("session_id", (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), start.cast("long").alias("from_turn"), end.cast("long").alias("to_turn"))
    t, born, gone = F.col("turn"), F.col("birth_turn"), F.col("retired_turn")
    occur = Window.partitionBy("session_id", "signature").orderBy("turn")
    loops = turns.where("signature is not null").withColumn("third", F.lag("turn", LOOP - 1).over(occur)).where("third is not null")
    parts = [
        span(beliefs, "active", born, gone), span(beliefs.where(F.col("belief_name").isin(*BLOCKING)), "blocker", born, gone),
        *(span(beliefs.where(F.col("belief_name") == p), p, born, gone) for p in PENDING), span(fixes, "open_fix", t, end_of(gone, F.col("after_birth"))),
        span(turns.where("error"), "error", t, t + RECENT), span(turns.where("proposes"), "proposal", t, t + LOOKBACK), span(loops, "loop", t, F.col("third") + RECENT),
        span(beliefs.where("contradicted_turn is not null"), "contradicted", F.col("contradicted_turn"), F.col("contradicted_turn") + RECENT),
    ]
    kinds = ["active", "blocker", *PENDING, "open_fix", "error", "proposal", "loop", "contradicted"]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    at = cover_counts(points, every, kinds)
    # the latest fix that is active at the point; a session's fixes are few next to its turns
    f = fixes.select("session_id", F.col("turn").alias("fix_turn"), "retired_turn", "from_birth")
    on = points.withColumn("turn", t.cast("long")).join(f, "session_id").where((F.col("fix_turn") <= t) & (gone.isNull() | (gone > t)))
    latest = on.groupBy("session_id", "turn").agg(F.max(F.struct("fix_turn", "from_birth")).alias("fix"))
    last = turns.groupBy("session_id").agg(F.max("turn").cast("long").alias("last_turn"))
    at = at.join(latest, ["session_id", "turn"], "left").join(last, "session_id", "left").withColumn("last_turn", F.coalesce("last_turn", "turn"))
    n = lambda k: F.col(f"n_{k}")
    pending = sum(((n(p) > 0).cast("int") for p in PENDING), F.lit(0))
    waiting = sum((n(p) for p in PENDING), F.lit(0)) + n("open_fix")
    horizon = F.least(t + HORIZON, F.col("last_turn"))
    blocked = (n("proposal") > 0) & (n("blocker") > 0)
    pause = (n("loop") > 0) | (pending >= 2) | (n("contradicted") > 0) | blocked
    label = lambda name, cls, state: F.struct(F.lit(name).alias("category"), F.lit(CATEGORIES[name]).alias("metric"), F.when(cls.isNotNull(), "APPLICABLE").otherwise("NA").alias("applicability"), cls.alias("oracle_class"), state.alias("oracle_state"))
    none, yes, no = F.lit(None).cast("string"), F.lit("POSITIVE"), F.lit("NEGATIVE")
    fixed, seen = F.col("fix").isNotNull(), F.coalesce(F.col("fix.from_birth") <= horizon, F.lit(False))
    early = horizon < t + HORIZON
    labels = F.array(
        label("validation_check", F.when(~fixed, none).when(seen, no).when(early, none).otherwise(yes), F.when(~fixed, none).when(seen, "validation_happened").when(early, "indeterminate").otherwise("validation_did_not_happen")),
        label("repeated_failure", F.when(n("error") == 0, none).when(n("loop") > 0, yes).otherwise(no), F.when(n("error") == 0, none).when(n("loop") > 0, "loop_present").otherwise("no_loop")),
        label("approval_status", F.when(n("proposal") == 0, none).when(blocked, yes).otherwise(no), F.when(n("proposal") == 0, none).when(blocked, "action_blocked").otherwise("action_ready")),
        label("completion_check", F.when(n("active") == 0, none).when(waiting > 0, yes).otherwise(no), F.when(n("active") == 0, none).when(waiting > 0, "incomplete").otherwise("complete")),
        label("readiness_check", F.when(pause, yes).when(n("active") == 0, none).otherwise(no), F.when(pause, "should_pause").when(n("active") == 0, none).otherwise("should_proceed")),
    )
    return at.select("session_id", "turn", F.explode(labels).alias("l")).select("session_id", "turn", "l.*")


def weight(last_refresh: str, ts: str = "ts", half_life_seconds: float = 1800.0) -> Column:
    """What a belief weighs at ``ts`` that was last refreshed at ``last_refresh`` with full confidence."""
    age = F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(F.col(last_refresh).cast("timestamp"))
    return belief.decayed(F.lit(1.0), age.cast("double"), F.lit(half_life_seconds))


def interventions(turns: DataFrame, version: str = "v0.2") -> DataFrame:
    """rule, verdict (SUPPRESS or ALLOW) and intervention_action of the rules that apply to each turn.

    turns: session_id, turn, ts, is_deploy, is_status_check, has_error, validation_status, and what is alive then: deploy_active,
    approval_active, fix_active, pipeline_active (booleans), approval_weight (of the latest approval requirement, null if there
    was none), pipeline_refresh (time).

    A deploy is suppressed while an approval requirement is active with authority (v0.1: if one exists that has lost it). Any
    turn but a status check is held while the running pipeline's last refresh is too old. A fix's prior is retired by a
    failed validation (v0.1: only by that, and allowed where no fix is active; v0.2: by any error while one is)."""
    old = version == "v0.1"
    w = F.col("approval_weight")
    held = (w < AUTHORITY) if old else F.col("approval_active") & (w >= AUTHORITY)
    deploy = F.when(F.col("is_deploy"), F.when(F.col("deploy_active") & F.coalesce(held, F.lit(False)), "SUPPRESS").otherwise("ALLOW"))
    age = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.col("pipeline_refresh").cast("timestamp"))
    stale = F.when(~F.col("is_status_check") & F.col("pipeline_active") & age.isNotNull(), F.when(age > STALE_SECONDS[version], "SUPPRESS").otherwise("ALLOW"))
    failed = F.coalesce(F.col("validation_status") == "FAIL", F.lit(False))
    fix = F.when(failed, F.when(F.col("fix_active"), "SUPPRESS").otherwise("ALLOW")) if old else F.when(F.col("fix_active") & (failed | F.col("has_error")), "SUPPRESS")
    of = lambda rule, verdict, action: F.when(verdict.isNotNull(), F.struct(F.lit(rule).alias("rule"), verdict.alias("verdict"), F.lit(action).alias("intervention_action")))
    every = F.array_compact(F.array(of("stale_deploy_prior", deploy, "suppress_deploy"), of("stale_pipeline_prior", stale, "require_status_check"), of("contradicted_fix_prior", fix, "retire_fix_prior")))
    return turns.select("session_id", "turn", F.explode(every).alias("v")).select("session_id", "turn", "v.*")
