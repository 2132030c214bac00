"""Operational beliefs and their evaluation: exports, contexts, derived beliefs, audits, candidates and oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import belief, text

SYNTHETIC_THEMES = ["capacity", "pricing", "supply", "hiring", "security", "latency", "demand", "policy"]


def synthetic_events(spark: SparkSession, per_theme: int = 10) -> DataFrame:
    """Deterministic events: for each theme, one every nine days with a shift by theme, sorted by time."""
    n = len(SYNTHETIC_THEMES) * per_theme
    theme, j = F.expr(f"cast(id div {per_theme} as int)"), F.col("id") % per_theme
    ts = F.expr("timestamp_ntz'2026-02-01 09:00:00'") + F.make_dt_interval((j * 9 + theme % 3).cast("int"))
    outcomes = F.element_at(F.array(*map(F.lit, ["high", "moderate", "quiet"])), ((theme + j) % 3).cast("int") + 1)
    tag = F.element_at(F.array(*map(F.lit, SYNTHETIC_THEMES)), theme + 1)
    return spark.range(n).select(F.format_string("e%03d", "id").alias("id"), ts.alias("timestamp"), F.concat(tag, F.lit(" note "), j.cast("string")).alias("text"), F.create_map(F.lit("tag"), tag).alias("metadata"), outcomes.alias("outcome"))


def insert_missing(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Target with the rows whose keys it does not have; doing it twice changes nothing."""
    return target.unionByName(rows.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti"))


def session_export(events: DataFrame, beliefs: DataFrame, intervals: DataFrame) -> DataFrame:
    """Each event with the beliefs active as of its turn, as JSON with keys in alphabetical order.

    The state is joined by turn once for each (session, turn), not once for each event."""
    active = intervals.where("state = 'active'").join(beliefs.select("belief_id", "session_id", "created_turn"), "belief_id")
    turns = events.select("session_id", "turn").distinct()
    on = active.join(turns, "session_id").where((F.col("turn") >= F.greatest("from_turn", "created_turn")) & (F.col("to_turn").isNull() | (F.col("turn") < F.col("to_turn"))))
    state = on.groupBy("session_id", "turn").agg(F.array_sort(F.collect_list(F.col("belief_id").cast("string"))).alias("active_beliefs"))
    none = F.expr("cast(array() as array<string>)")
    out = events.join(state, ["session_id", "turn"], "left").withColumn("active_beliefs", F.coalesce("active_beliefs", none))
    body = F.to_json(F.struct("active_beliefs", "event_id", "kind", "session_id", "turn"))
    return out.select("session_id", "turn", "event_id", body.alias("json"))


def scan_chunks(events: DataFrame, start: str, end: str, universe: list[str]) -> tuple[DataFrame, DataFrame]:
    """(chunks, counters): events in the window with an actor of the universe, the first of each id; and why others went.

    events: event_id, date, actors, ord."""
    inside = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    known = F.array_intersect("actors", F.array(*map(F.lit, universe)))
    rows = events.withColumns({"inside": inside, "actors": known})
    counters = rows.agg(F.count("*").alias("n_read"), F.count_if(~F.col("inside")).alias("n_outside"), F.count_if(F.col("inside") & (F.size("actors") == 0)).alias("n_unknown"))
    w = Window.partitionBy("event_id").orderBy("ord")
    chunks = rows.where(F.col("inside") & (F.size("actors") > 0)).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "inside")
    return chunks, counters


def invoking_turn(results: DataFrame, uses: DataFrame) -> DataFrame:
    """Each tool result with the latest earlier turn of its session that used the tool by this id."""
    u = uses.select("session_id", "tool_use_id", F.col("turn").alias("use_turn"))
    j = results.join(u, ["session_id", "tool_use_id"], "left").withColumn("use_turn", F.when(F.col("use_turn") < F.col("turn"), F.col("use_turn")))
    return j.groupBy("session_id", "tool_use_id", "turn").agg(F.max("use_turn").alias("use_turn"))


def next_after(births: DataFrame, later: DataFrame) -> DataFrame:
    """The first later turn of the session after each birth turn; null if none. Both: session_id, turn."""
    both = births.select("session_id", "turn", F.lit(None).cast("long").alias("t")).unionByName(later.select("session_id", "turn", F.col("turn").cast("long").alias("t")))
    w = Window.partitionBy("session_id").orderBy(F.desc("turn")).rangeBetween(Window.unboundedPreceding, -1)  # later turns, in a frame that only grows
    return both.withColumn("next_turn", F.min("t").over(w)).where("t is null").select("session_id", "turn", "next_turn")


def as_of_trail(beliefs: DataFrame, turn: int) -> DataFrame:
    """State and last warrant of beliefs at a turn, from their revision trails; trail: array of (turn, new_state)."""
    seen = F.filter("trail", lambda e: e["turn"] <= turn)
    last = F.element_at(F.array_sort(seen), -1)
    warrants = F.filter("warrant_turns", lambda t: t <= turn)
    out = beliefs.where(F.col("birth_turn") <= turn)
    return out.withColumns({"state": F.when(F.size(seen) > 0, last["new_state"]).otherwise("active"), "last_warrant": F.coalesce(F.array_max(warrants), F.col("birth_turn"))})


def covering(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """n_begun (intervals that have begun) and n_open (those that cover it) for each point (session_id, turn).

    intervals: session_id, from_turn, to_turn (exclusive, null while open). Ends and points meet in one ordered window with
    running sums, not in a join of all with all."""
    kinds = [F.col("session_id"), F.col("from_turn").cast("long").alias("turn"), F.lit(1).alias("b"), F.lit(1).alias("o"), F.lit(False).alias("p")]
    begin = intervals.select(*kinds)
    end = intervals.where("to_turn is not null").select("session_id", F.col("to_turn").cast("long").alias("turn"), F.lit(0).alias("b"), F.lit(-1).alias("o"), F.lit(False).alias("p"))
    at = points.select("session_id", F.col("turn").cast("long").alias("turn")).distinct().withColumns({"b": F.lit(0), "o": F.lit(0), "p": F.lit(True)})
    w = Window.partitionBy("session_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = at.unionByName(begin).unionByName(end)
    return both.withColumns({"n_begun": F.sum("b").over(w), "n_open": F.sum("o").over(w)}).where("p").select("session_id", "turn", "n_begun", "n_open")


def actions(points: DataFrame, blockers: DataFrame, window: int = 5) -> DataFrame:
    """Whether an action was proposed in the last ``window`` turns and, if so, whether it is ready or blocked.

    points: session_id, turn, proposes; blockers: session_id, from_turn, to_turn (null while active)."""
    w = Window.partitionBy("session_id").orderBy("turn").rangeBetween(-(window - 1), 0)
    p = points.withColumn("proposed", F.max(F.col("proposes").cast("int")).over(w) == 1)
    out = p.withColumn("turn", F.col("turn").cast("long")).join(covering(points, blockers), ["session_id", "turn"])
    return out.select("session_id", "turn", F.when(~F.col("proposed"), "none").when(F.col("n_open") > 0, "blocked").otherwise("ready").alias("action"))


#: Half lives of derived beliefs in turns.
DERIVED_HALF_LIFE = {"validation_complete": 60, "action_ready": 5, "action_blocked": 5, "failure_signature_active": 10}


def derived_beliefs(turns: DataFrame, pending: DataFrame, fixes: DataFrame, blockers: DataFrame, window: int = 20, least: int = 3) -> DataFrame:
    """Beliefs that follow from turns and others: session_id, belief_type, turn_first_seen, turn_last_updated, lifecycle_state,
    decay_status, trigger.

    * validation_complete: a validation succeeds while one is pending; contradicted by the next fix.
    * action_ready, action_blocked: an action is proposed, with no or some blocker open at that turn.
    * failure_signature_active: a signature stands ``least`` times in the last ``window`` turns and did not a turn before; retired
      ``window`` turns after its last appearance in a row of such turns, if the session goes on so long.

    turns: session_id, turn, validated (success), proposes, signature (null unless failed); pending, blockers: session_id, from_turn,
    to_turn (exclusive, null while open); fixes: session_id, turn."""
    ends = turns.groupBy("session_id").agg(F.max("turn").alias("end"))
    open_at = lambda points, intervals: covering(points.select("session_id", "turn"), intervals).where("n_open > 0").select("session_id", "turn")
    done = turns.where("validated").select("session_id", "turn")
    done = done.join(open_at(done, pending), ["session_id", "turn"], "left_semi")
    after = next_after(done, fixes.select("session_id", "turn").distinct())
    complete = after.select("session_id", F.lit("validation_complete").alias("belief_type"), F.col("turn").alias("first"), F.coalesce("next_turn", "turn").alias("last"), F.when(F.col("next_turn").isNotNull(), "contradicted").otherwise("active").alias("state"), F.when(F.col("next_turn").isNotNull(), "new_fix_attempted").otherwise("validation_tool_success").alias("trigger"))
    asked = turns.where("proposes").select("session_id", "turn")
    stopped = open_at(asked, blockers).withColumn("blocked", F.lit(True))
    acts = asked.join(stopped, ["session_id", "turn"], "left")
    act = acts.select("session_id", F.when(F.col("blocked"), "action_blocked").otherwise("action_ready").alias("belief_type"), F.col("turn").alias("first"), F.col("turn").alias("last"), F.lit("active").alias("state"), F.lit("action_proposal").alias("trigger"))
    same = Window.partitionBy("session_id", "signature").orderBy("turn")
    seen = turns.where("signature is not null").withColumn("n", F.count("*").over(same.rangeBetween(-(window - 1), 0))).where(F.col("n") >= least)
    gap = F.col("turn") - F.lag("turn").over(same)
    runs = seen.withColumn("run", F.sum(F.coalesce(gap > window, F.lit(True)).cast("int")).over(same))
    loops = runs.groupBy("session_id", "signature", "run").agg(F.min("turn").alias("first"), F.max("turn").alias("seen")).join(ends, "session_id")
    aged = F.col("seen") + window <= F.col("end")
    loop = loops.select("session_id", F.lit("failure_signature_active").alias("belief_type"), "first", F.when(aged, F.col("seen") + window).otherwise(F.col("seen")).alias("last"), F.when(aged, "retired").otherwise("active").alias("state"), F.when(aged, "signature_aged_out").otherwise("recurrence").alias("trigger"))
    every = complete.unionByName(act).unionByName(loop).join(ends, "session_id")
    half = F.lit(None).cast("int")
    for name, turns_ in DERIVED_HALF_LIFE.items():
        half = F.when(F.col("belief_type") == name, turns_).otherwise(half)
    # only what is still open ages until the session ends; actions are judged at their own turn
    age = F.when((F.col("state") == "active") & ~F.col("belief_type").startswith("action"), F.col("end") - F.col("last")).otherwise(0)
    return every.select("session_id", "belief_type", F.col("first").alias("turn_first_seen"), F.col("last").alias("turn_last_updated"), F.col("state").alias("lifecycle_state"), belief.decay_status(age, half).alias("decay_status"), "trigger")


def audit_points(turns: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75), least: int = 10) -> DataFrame:
    """The turns at given shares of each session of at least ``least`` turns."""
    w = Window.partitionBy("session_id")
    t = turns.withColumns({"i": F.row_number().over(w.orderBy("turn")) - 1, "n": F.count("*").over(w)}).where(F.col("n") >= least)
    at = F.array(*(F.struct(F.lit(p).alias("share"), F.floor(F.col("n") * p).alias("k")) for p in shares))
    return t.withColumn("a", F.explode(at)).where("i = a.k").select("session_id", "turn", "a.share")


def last_turns(turns: DataFrame, points: DataFrame, k: int, most_chars: int = 200) -> DataFrame:
    """The last ``k`` turns up to each point, rendered and joined by blank lines, and their approximate tokens.

    Turns lie in slots of ``k``; a point asks two slots at most, so points are copied, not turns."""
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), F.col("role"), F.lit(": "), text.shortened(F.col("text"), most_chars))
    slot = lambda c: F.floor(c / k)
    asked = points.select("session_id", F.col("turn").alias("at")).distinct()
    asked = asked.withColumn("slot", F.explode(F.array_distinct(F.array(slot(F.col("at") - k + 1), slot(F.col("at"))))))
    j = turns.withColumn("slot", slot(F.col("turn"))).join(asked, ["session_id", "slot"]).where((F.col("turn") <= F.col("at")) & (F.col("turn") > F.col("at") - k)).withColumn("line", line)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n\n")
    return j.groupBy("session_id", F.col("at").alias("turn")).agg(F.count("*").alias("n_turns"), body.alias("context")).withColumn("tokens", belief.approx_tokens(F.col("context")))


def sweep(turns: DataFrame, points: DataFrame, ks: tuple[int, ...], caps: tuple[int, ...], budget: int = 6000) -> DataFrame:
    """Context sizes over all (k, cap): n points, tokens (mean, median, p90, max), how many overflow the budget, the share of contexts and of
    turns that lose text by the cap, and what share of the session's supporting and failed turns so far the window covers.

    turns: session_id, turn, text, supports, is_error. A window's sum is the difference of two running sums of the session, up to the
    point and up to k turns before, so no turn is copied for a window it stands in; only points leave the session's window."""
    chars = F.length("text")
    w = Window.partitionBy("session_id").orderBy("turn")
    upto = lambda x, k: F.coalesce(F.sum(x).over(w.rangeBetween(Window.unboundedPreceding, -k)), F.lit(0))
    inside = lambda x, k: upto(x, 0) - upto(x, k)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    one, supports, failed = F.lit(1), flag(F.col("supports")), flag(F.col("is_error"))
    cells = F.array(*(
        F.struct(F.lit(k).alias("k"), F.lit(c).alias("cap"), inside(F.least(chars, F.lit(c)), k).alias("chars"), inside(flag(chars > c), k).alias("cut"), inside(one, k).alias("seen"), F.try_divide(inside(supports, k), upto(supports, 0)).alias("support"), F.try_divide(inside(failed, k), upto(failed, 0)).alias("failed"))
        for k in ks for c in caps
    ))
    asked = points.select("session_id", "turn", F.lit(True).alias("asked")).distinct()
    each = turns.join(asked, ["session_id", "turn"], "left").withColumn("cells", cells).where("asked").select(F.explode("cells").alias("x")).select("x.*")
    each = each.withColumn("tokens", F.floor((F.col("chars") + 3) / 4))
    # exact order statistics from the counts of equal sizes, which are few next to the points
    sizes = each.groupBy("k", "cap", "tokens").agg(F.count("*").alias("m"))
    order = Window.partitionBy("k", "cap").orderBy("tokens")
    sizes = sizes.withColumns({"upto": F.sum("m").over(order), "n": F.sum("m").over(Window.partitionBy("k", "cap"))})
    at = lambda share: F.min(F.when(F.col("upto") > F.floor(F.col("n") * share), F.col("tokens")))
    ranks = sizes.groupBy("k", "cap").agg(at(0.5).alias("median"), at(0.9).alias("p90"), F.max("tokens").alias("most"))
    out = each.groupBy("k", "cap").agg(
        F.count("*").alias("n"), F.avg("tokens").alias("mean_tokens"), F.avg((F.col("cut") > 0).cast("int")).alias("cut_rate"), F.try_divide(F.sum("cut"), F.sum("seen")).alias("truncation"),
        F.count_if(F.col("tokens") > budget).alias("overflow"), F.avg("support").alias("support_coverage"), F.count("support").alias("n_support"), F.avg("failed").alias("error_coverage"), F.count("failed").alias("n_failed"),
    )
    return out.join(ranks, ["k", "cap"])


#: How many active and recently closed beliefs are listed, examples of a month, and the days that count as recent.
ACTIVE_CAP, RECENT_CAP, EXAMPLES, RECENT_DAYS = 12, 8, 3, 30


def narrative(beliefs: DataFrame, as_of: str) -> DataFrame:
    """By actor, section (active, attention, recently retired, older) and, of older ones, month of closing: how many there are, what is
    shown, and how many are not.

    Shown are the latest updated ones, up to the section's cap (all that need attention); of a month, the examples with the most support.
    beliefs: belief_id, actor, state, last_seen, support, claim."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("last_seen"))
    section = F.when(F.col("state").isin("weakened", "contradicted"), "attention").when(F.col("state") != "retired", "active").when(age <= RECENT_DAYS, "recently retired").otherwise("older")
    b = beliefs.withColumn("section", section).withColumn("month", F.when(F.col("section") == "older", F.date_format("last_seen", "yyyy-MM")).otherwise(""))
    older = F.col("section") == "older"
    first = F.when(older, -F.col("support")).otherwise(-F.unix_date("last_seen"))
    w = Window.partitionBy("actor", "section", "month").orderBy(first, "belief_id")
    cap = F.when(F.col("section") == "active", ACTIVE_CAP).when(F.col("section") == "recently retired", RECENT_CAP).when(older, EXAMPLES)
    r = b.withColumn("r", F.row_number().over(w)).withColumn("shown", cap.isNull() | (F.col("r") <= cap))
    claims = F.transform(F.array_sort(F.collect_list(F.when(F.col("shown"), F.struct("r", "claim")))), lambda x: x["claim"])
    return r.groupBy("actor", "section", "month").agg(F.count("*").alias("n"), F.array_join(claims, "; ").alias("shown"), F.count_if(~F.col("shown")).alias("omitted"))


def audit(points: DataFrame, scores: DataFrame) -> DataFrame:
    """Counts of oracle scores at the audit points by share of the session, category, applicability and class."""
    return points.join(scores, ["session_id", "turn"]).groupBy("share", "category", "applicability", "oracle_class").agg(F.count("*").alias("n"))


QUESTIONS = ["Is the fix at turn {turn} still trusted?", "What blocks the next action at turn {turn}?", "Which belief changed last before turn {turn}?"]


def candidates(turns: DataFrame, category: Column, applies: Column, total: str = "n") -> DataFrame:
    """Question candidates: where a category applies, with the position of the turn and a question text."""
    c = turns.where(applies).withColumn("category", category)
    return c.select("session_id", "turn", "category", belief.position_bucket(F.col("turn"), F.col(total)).alias("position"), text.from_template(QUESTIONS, F.col("turn"), F.col("category")).alias("question"))


def oracle(points: DataFrame, beliefs: DataFrame, belief_type: str, positive_state: str) -> DataFrame:
    """Whether a question about a belief type applies at each point (a belief of the type was born by then) and the answer.

    beliefs: session_id, belief_type, state, from_turn, to_turn."""
    b = beliefs.where(F.col("belief_type") == belief_type)
    born = covering(points, b.select("session_id", "from_turn", "to_turn")).select("session_id", "turn", F.col("n_begun").alias("n"))
    yes = covering(points, b.where(F.col("state") == positive_state).select("session_id", "from_turn", "to_turn")).select("session_id", "turn", F.col("n_open").alias("yes"))
    got = born.join(yes, ["session_id", "turn"])
    return got.select("session_id", "turn", F.when(F.col("n") == 0, "NA").otherwise("APPLICABLE").alias("applies"), F.when(F.col("n") == 0, None).when(F.col("yes") > 0, "POSITIVE").otherwise("NEGATIVE").alias("answer"))


def sliding_counts(events: DataFrame, length: str, step: str, ts: str = "ts") -> DataFrame:
    """Events by sliding window; the same code serves streams with a watermark."""
    return events.groupBy(F.window(ts, length, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def projection(points: DataFrame, k: int = 2, vec: str = "embedding") -> DataFrame:
    """Points with their first ``k`` principal components as ``pca``."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = points.withColumn("__v", array_to_vector(F.col(vec)))
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(data)
    return model.transform(data).withColumn("pca", vector_to_array("__p")).drop("__v", "__p")


def histogram(points: DataFrame, x: Column, y: Column, low: float, high: float, bins: int) -> DataFrame:
    """Counts on a square grid; points outside go to the border cells 0 and bins + 1."""
    cell = lambda c: F.width_bucket(c, F.lit(low), F.lit(high), F.lit(bins))
    return points.groupBy(cell(x).alias("x"), cell(y).alias("y")).agg(F.count("*").alias("n"))
