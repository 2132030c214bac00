"""Session logs: turn classification, inventories, samples, signatures, interventions and their outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import belief
from ..functions import text as texts

#: Ordered rules for user and assistant turns: region, pattern. The first that matches names the region.
USER_RULES = [("approval", r"(?i)\b(yes|ok|go ahead|approved?)\b"), ("correction", r"(?i)\b(no|wrong|instead|undo)\b"), ("request", r"(?i)\?|\b(please|can you|could you)\b")]
ASSISTANT_RULES = [("blocked", r"(?i)\b(cannot|can't|unable|blocked)\b"), ("validation", r"(?i)\b(test|tests|verify|check)\b"), ("fix", r"(?i)\b(fix|fixed|patch|edit)\b"), ("report", r"(?i)\b(report|summary|done)\b")]


def classify_turn(role: Column, text: Column, user_rules=USER_RULES, assistant_rules=ASSISTANT_RULES) -> Column:
    """struct(region, reason) of a turn, by ordered patterns for its role; their words end where ASCII words do."""
    pick = lambda name, why: F.struct(F.lit(name).alias("region"), F.lit(why).alias("reason"))

    def chain(rules):
        out = None
        for name, pattern in rules:
            hit = text.rlike(texts.plain_words(pattern))
            out = F.when(hit, pick(name, f"text matches {name}")) if out is None else out.when(hit, pick(name, f"text matches {name}"))
        return out.otherwise(pick("other", "no pattern"))

    return F.when(role == "user", chain(user_rules)).when(role == "assistant", chain(assistant_rules)).otherwise(pick("meta", "role"))


def inventory(turns: DataFrame) -> DataFrame:
    """By session, with the total of all sessions (session_id null): turns by role, characters, first and last turn."""
    return turns.rollup("session_id").agg(
        F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.count_if(F.col("role") == "assistant").alias("n_assistant"),
        F.sum(F.length("text")).cast("long").alias("n_chars"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"),
    )


def distribution(rows: DataFrame, by: str) -> DataFrame:
    n = rows.groupBy(by).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def sample(rows: DataFrame, by: str, key: str, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows of each stratum, in the order of a seeded hash of their key."""
    h = F.sha2(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"), 256)
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(h, key))).where(F.col("__r") <= most).drop("__r")


def recurring_signatures(failures: DataFrame, window: int = 20, least: int = 3) -> DataFrame:
    """Turns at which a signature has stood ``least`` times in the last ``window`` turns of its session."""
    w = Window.partitionBy("session_id", "signature").orderBy("turn").rangeBetween(-(window - 1), 0)
    return failures.withColumn("n", F.count("*").over(w)).where(F.col("n") >= least).select("session_id", "turn", "signature", "n").distinct()


def failure_loops(turns: DataFrame, rows: int = 10, least: int = 3) -> DataFrame:
    """Turns in a loop: ``least`` failures like this one in the last ``rows`` turns, and no edit between the first and the last
    of them. turns: session_id, turn, signature (null unless failed), is_edit."""
    w = Window.partitionBy("session_id").orderBy("turn").rowsBetween(-(rows - 1), 0)
    t = turns.withColumn("last", F.collect_list(F.struct("turn", "signature", "is_edit")).over(w))
    same = F.filter("last", lambda x: x["signature"] == F.col("signature"))
    first = F.array_min(F.transform(same, lambda x: x["turn"]))
    edited = F.exists("last", lambda x: x["is_edit"] & (x["turn"] > first) & (x["turn"] < F.col("turn")))
    return t.where(F.col("signature").isNotNull() & (F.size(same) >= least) & ~edited).select("session_id", "turn", "signature")


def active_as_of(points: DataFrame, timelines: DataFrame) -> DataFrame:
    """The latest-refreshed belief of each name that is alive at each point (session_id, ts).

    timelines: session_id, belief_name, event, ts (births, refreshes, retirements); a belief is alive if it was born and its
    last event is no retirement."""
    names = timelines.select("session_id", "belief_name").distinct()
    asked = points.select("session_id", "ts").distinct().join(names, "session_id")
    both = asked.unionByName(timelines.select("session_id", "belief_name", "ts", "event"), allowMissingColumns=True)
    w = Window.partitionBy("session_id", "belief_name").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    refresh = F.max(F.when(F.col("event").isin("born", "refreshed"), F.col("ts"))).over(w)
    last = both.withColumns({"now": F.max(F.when(F.col("event").isNotNull(), F.struct("ts", "event"))).over(w)["event"], "last_refresh": refresh})
    return last.where("event is null and now in ('born', 'refreshed')").select("session_id", "ts", "belief_name", "last_refresh")


def states_at(points: DataFrame, events: DataFrame, half_lives: dict[str, int], stale_below: float = 0.3) -> DataFrame:
    """Every belief that is born by each point (session_id, ts): belief_name, anchor, birth_ts, last_refresh, n_events, weight and
    status (active, stale or retired_before).

    events: session_id, belief_name, anchor, event, ts. A session's points meet its beliefs in one ordered window a belief."""
    key = ["session_id", "belief_name", "anchor"]
    asked = points.select("session_id", "ts").distinct().join(events.select(*key).distinct(), "session_id")
    w = Window.partitionBy(*key).orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    is_ = lambda *names: F.col("event").isin(*names)
    rows = asked.unionByName(events.select(*key, "ts", "event"), allowMissingColumns=True).withColumns({
        "birth_ts": F.min(F.when(is_("born"), F.col("ts"))).over(w), "last_refresh": F.max(F.when(is_("born", "refreshed"), F.col("ts"))).over(w),
        "ended": F.max(is_("retired", "contradicted").cast("int")).over(w), "n_events": F.count("event").over(w),
    })
    half = F.lit(None).cast("double")
    for name, seconds in half_lives.items():
        half = F.when(F.col("belief_name") == name, float(seconds)).otherwise(half)
    age = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("last_refresh").cast("timestamp"))) / 1e6
    weight = F.when(F.col("ended") == 1, 0.0).when(age <= 0, 1.0).otherwise(F.exp(-belief.LN2 * age / half))
    rows = rows.where("event is null and birth_ts is not null").withColumn("weight", weight)
    status = F.when(F.col("ended") == 1, "retired_before").when(F.col("weight") < stale_below, "stale").otherwise("active")
    return rows.select("session_id", "ts", "belief_name", "anchor", "birth_ts", "last_refresh", "n_events", "weight", status.alias("status"))


def latest_at(states: DataFrame, statuses: tuple[str, ...] = ("active",)) -> DataFrame:
    """Of ``states_at``, the belief of each point and name with the latest refresh among the given statuses."""
    w = Window.partitionBy("session_id", "ts", "belief_name").orderBy(F.desc("last_refresh"), "anchor")
    return states.where(F.col("status").isin(*statuses)).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def stale_verdicts(points: DataFrame, alive: DataFrame, max_age_seconds: int) -> DataFrame:
    """SUPPRESS where the named belief is alive but older than allowed, ALLOW where it is fresh, else NOT_APPLICABLE."""
    j = points.join(alive, ["session_id", "ts"], "left")
    age = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.col("last_refresh").cast("timestamp"))
    return j.withColumn("verdict", F.when(F.col("last_refresh").isNull(), "NOT_APPLICABLE").when(age > max_age_seconds, "SUPPRESS").otherwise("ALLOW"))


def label_outcomes(verdicts: DataFrame, look_ahead: int = 5) -> DataFrame:
    """TP, FP, FN or TN by whether one of the next rows of the session is a problem; UNCERTAIN where none follows."""
    w = Window.partitionBy("session_id").orderBy("turn").rowsBetween(1, look_ahead)
    p = F.max(F.col("is_problem").cast("int")).over(w) == 1
    return verdicts.withColumn("problem", p).withColumn("label", belief.outcome_label(F.col("verdict"), F.col("problem")))


def confusion(labels: DataFrame, by: str) -> DataFrame:
    out = labels.groupBy(by).agg(*(F.count_if(F.col("label") == x).alias(x.lower()) for x in ("TP", "FP", "FN", "TN", "UNCERTAIN")))
    return out.withColumns({"detection": F.try_divide("tp", F.col("tp") + F.col("fn")), "fpr": F.try_divide("fp", F.col("fp") + F.col("tn"))})


def track(events: DataFrame, half_life_seconds: float, stale_below: float = 0.3) -> DataFrame:
    """Episodes of decaying beliefs by (session_id, name): a birth opens one, refreshes keep it, a retirement or contradiction
    ends it, and so does decay below ``stale_below`` before the next event.

    events: session_id, name, ts, kind. Gaps and islands by windows: an event starts an episode if it is a birth or refresh and
    none is open, or the open one has gone stale."""
    w = Window.partitionBy("session_id", "name").orderBy("ts", "kind")
    live_for = -half_life_seconds * F.log(F.lit(stale_below)) / belief.LN2
    gap = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(w).cast("timestamp"))
    before = F.lag("kind").over(w)
    opens = F.col("kind").isin("born", "refreshed")
    starts = opens & (before.isNull() | before.isin("retired", "contradicted") | (gap > live_for))
    e = events.withColumns({"starts": starts, "gap": gap}).withColumn("episode", F.sum(F.col("starts").cast("int")).over(w))
    e = e.where("episode > 0")
    out = e.groupBy("session_id", "name", "episode").agg(F.min("ts").alias("birth_ts"), F.max(F.when(opens, F.col("ts"))).alias("last_refresh_ts"), F.count_if(opens).alias("n_refreshes"), F.max_by("kind", F.struct("ts", "kind")).alias("last_kind"))
    return out.withColumn("ended_by", F.when(F.col("last_kind").isin("retired", "contradicted"), F.col("last_kind")).otherwise("stale"))
