"""The belief ledger: turns, matching of calls and results, belief state as of a turn, overlays, hash chains and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import belief

#: What a belief event makes of the belief, the types that block actions, those that rank as blockers, and the overlay's texts.
STATE_OF = {"born": "active", "refreshed": "active", "confirmed": "active", "weakened": "contradicted", "contradicted": "contradicted", "superseded": "retired", "retired": "retired"}
BLOCKERS = ("validation_pending", "user_approval_pending", "pipeline_failed")
RANK_BLOCKERS = ("action_blocked", "validation_pending", "pipeline_failed", "pipeline_running", "user_approval_pending")
HEADER = "# Operational belief overlay (budget: {budget} tokens, used: {used}, omitted: {omitted}, K={k})"
BLOCKED_CLAIM = "action_blocked \u2014 "


def state_of(kind: Column) -> Column:
    out = F.lit("unknown")
    for k, v in STATE_OF.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def resolve_turns(lines: DataFrame) -> DataFrame:
    """turn for lines (session_id, line, turn_id nullable): dense numbers of turn ids by first appearance; a line without
    one takes the last before it, or -1."""
    w = Window.partitionBy("session_id").orderBy("line")
    lines = lines.withColumn("tid", F.last("turn_id", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("first_line", F.min("line").over(Window.partitionBy("session_id", "tid")))
    known = F.col("tid").isNotNull()
    rank = F.dense_rank().over(Window.partitionBy("session_id").orderBy(F.when(known, F.col("first_line")).asc_nulls_first()))
    nulls = F.max(F.when(known, 0).otherwise(1)).over(Window.partitionBy("session_id"))
    return lines.withColumn("turn", F.when(known, rank - 1 - nulls).otherwise(-1).cast("long")).drop("tid", "first_line")


def event_index(events: DataFrame) -> DataFrame:
    """The position of each event in its session's turn."""
    return events.withColumn("event_idx", (F.row_number().over(Window.partitionBy("session_id", "turn").orderBy("line")) - 1).cast("long"))


def parents(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Each result with the latest earlier call of its (session_id, call_id): parent_id, null if there is none.

    Calls and results meet in one ordered window, not in a join of all with all."""
    at = ["session_id", "call_id", F.col("event_id").cast("long").alias("event_id")]
    both = calls.select(*at, F.col("event_id").cast("long").alias("of")).unionByName(results.select(*at).distinct().withColumn("of", F.lit(None).cast("long")))
    w = Window.partitionBy("session_id", "call_id").orderBy("event_id").rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn("parent_id", F.max("of").over(w)).where("of is null").drop("of")


def running_calls(calls: DataFrame, results: DataFrame, turns: DataFrame, wait: int = 3) -> DataFrame:
    """Calls that count as still running: no result by the turn before the first turn at least ``wait`` later.

    calls: session_id, call_id, turn; results: session_id, call_id, turn; turns: session_id, turn. Gives effective_turn
    (of the call) and at_turn (when it was noticed)."""
    done = results.groupBy("session_id", "call_id").agg(F.min("turn").alias("result_turn"))
    asked = calls.select("session_id", "call_id", "turn").distinct().select("session_id", (F.col("turn") + wait).cast("long").alias("t"), "call_id", "turn")
    seen = turns.select("session_id", F.col("turn").cast("long").alias("t")).distinct()
    both = asked.unionByName(seen, allowMissingColumns=True)
    w = Window.partitionBy("session_id").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("at_turn", F.min(F.when(F.col("turn").isNull(), F.col("t"))).over(w)).where("turn is not null and at_turn is not null")
    out = found.join(done, ["session_id", "call_id"], "left")
    return out.where(F.col("result_turn").isNull() | (F.col("result_turn") >= F.col("at_turn"))).select("session_id", "call_id", F.col("turn").alias("effective_turn"), "at_turn")


def signature_lifecycle(failures: DataFrame) -> DataFrame:
    """A failure's first event of (session_id, signature) gives birth, later ones refresh; ``born_event`` is the first."""
    w = Window.partitionBy("session_id", "signature").orderBy("event_id")
    return failures.withColumns({"kind": F.when(F.row_number().over(w) == 1, "born").otherwise("refreshed"), "born_event": F.first("event_id").over(w)})


def approvals(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """The first later answer to each request: retired by a grant (which wins), contradicted by a denial.

    requests: session_id, turn; answers: session_id, turn, grants, denies (booleans)."""
    t = F.col("turn").cast("long").alias("t")
    a = answers.where("grants or denies").select("session_id", t, F.struct(F.col("turn").alias("answer_turn"), (~F.col("grants")).alias("no")).alias("said"))
    both = requests.select("session_id", t, "turn").distinct().unionByName(a, allowMissingColumns=True)
    w = Window.partitionBy("session_id").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, -1)  # later turns
    out = both.withColumn("a", F.min("said").over(w)).where("turn is not null").drop("t", "said")
    end = F.when(F.col("a.answer_turn").isNull(), "active").when(F.col("a.no"), "contradicted").otherwise("retired")
    return out.select("session_id", "turn", F.col("a.answer_turn").alias("answer_turn"), end.alias("state"))


def replaced_reports(writes: DataFrame) -> DataFrame:
    """Each report of (session_id, path) with the turn of the next one, which retires it."""
    return writes.withColumn("retired_turn", F.lead("turn").over(Window.partitionBy("session_id", "path").orderBy("turn", "event_id")))


def _key() -> Column:
    return F.struct("eff", "at_turn", "belief_event_id")


def _effective(events: DataFrame) -> DataFrame:
    return events.withColumn("eff", F.coalesce("effective_turn", "at_turn"))


def state_at(beliefs: DataFrame, events: DataFrame, turn: int) -> DataFrame:
    """Every belief that is visible at ``turn``, with its state, authority, warrant turns and the turns at which its latest
    event was observed (last_updated_turn) and took effect.

    beliefs: belief_id, session_id, belief_type, claim, created_turn; events: belief_event_id, belief_id, kind, at_turn,
    effective_turn, authority. One aggregation by belief, no look-up per belief."""
    seen = _effective(events).where(F.col("eff") <= turn)
    warrants = F.when(F.col("kind").isin("born", "refreshed", "confirmed"), F.col("eff"))
    last = seen.groupBy("belief_id").agg(
        F.max_by("kind", _key()).alias("kind"),
        F.max_by("at_turn", _key()).alias("last_updated_turn"),
        F.max_by("eff", _key()).alias("effective_turn"),
        F.max_by("authority", belief.authority_rank(F.col("authority"))).alias("authority"),
        F.array_sort(F.collect_list(warrants)).alias("warrant_turns"),
    )
    return beliefs.where(F.col("created_turn") <= turn).join(last, "belief_id").withColumn("state", state_of(F.col("kind")))


def intervals(events: DataFrame) -> DataFrame:
    """The state of each belief over all turns: half-open [from_turn, to_turn), to_turn null while it lasts."""
    w = Window.partitionBy("belief_id").orderBy("eff", "at_turn", "belief_event_id")
    out = _effective(events).withColumns({"from_turn": F.col("eff"), "to_turn": F.lead("eff").over(w)})
    return out.where(F.col("to_turn").isNull() | (F.col("from_turn") < F.col("to_turn"))).select("belief_id", state_of(F.col("kind")).alias("state"), "from_turn", "to_turn")


def action_blocked(state: DataFrame, turn: int) -> DataFrame:
    """One synthetic belief for each session that has an active blocker; the blockers' types and warrants in order of
    creation. A session's blockers are few."""
    b = state.where((F.col("state") == "active") & F.col("belief_type").isin(*BLOCKERS))
    warrants = F.when(F.size("warrant_turns") > 0, F.col("warrant_turns")).otherwise(F.array("last_updated_turn"))
    of = F.array_sort(F.collect_list(F.struct("created_turn", "belief_id", "belief_type", warrants.alias("warrants"))))
    out = b.groupBy("session_id").agg(
        of.alias("of"), F.max_by("authority", belief.authority_rank(F.col("authority"))).alias("authority"), F.min("created_turn").alias("created_turn"), F.max("last_updated_turn").alias("last_updated_turn")
    )
    return out.select(
        F.concat(F.lit("synthetic:action_blocked:"), F.col("session_id").cast("string"), F.lit(f":{turn}")).alias("belief_id"), "session_id", F.lit("action_blocked").alias("belief_type"),
        F.concat(F.lit(BLOCKED_CLAIM), F.array_join(F.col("of.belief_type"), ", ")).alias("claim"), F.lit("active").alias("state"), "authority", F.flatten("of.warrants").alias("warrant_turns"), "created_turn", "last_updated_turn",
    )


def full_state(beliefs: DataFrame, events: DataFrame, turn: int) -> DataFrame:
    """The state at ``turn`` with the synthetic blocked beliefs; belief ids are strings."""
    state = state_at(beliefs, events, turn)
    columns = ["belief_id", "session_id", "belief_type", "claim", "state", "authority", "warrant_turns", "created_turn", "last_updated_turn"]
    return state.withColumn("belief_id", F.col("belief_id").cast("string")).select(columns).unionByName(action_blocked(state, turn).select(columns))


def state_counts(state: DataFrame) -> DataFrame:
    """By session: active, retired and contradicted beliefs; synthetic ones count as active."""
    return state.groupBy("session_id").agg(*(F.count_if(F.col("state") == x).alias(f"n_{x}") for x in ("active", "retired", "contradicted")))


def out_of_window(turn: int, k: int) -> Column:
    """Born and last warranted at or before ``turn`` - ``k``."""
    first = F.when(F.size("warrant_turns") > 0, F.get("warrant_turns", F.lit(0))).otherwise(F.col("created_turn"))
    last = F.when(F.size("warrant_turns") > 0, F.element_at("warrant_turns", -1)).otherwise(F.col("created_turn"))
    return (first <= turn - k) & (last <= turn - k)


def rank_overlay(state: DataFrame, turn: int, k: int = 20) -> DataFrame:
    """Active beliefs of each session in overlay order: out of the window first, blockers, the latest, the strongest, by id."""
    tier = F.when(F.col("belief_type").isin(*RANK_BLOCKERS), 1).otherwise(5)
    w = Window.partitionBy("session_id").orderBy(F.when(out_of_window(turn, k), 0).otherwise(1), tier, F.desc("last_updated_turn"), F.desc(belief.authority_rank(F.col("authority"))), "belief_id")
    return state.where("state = 'active'").withColumn("rank", F.row_number().over(w))


def pack(ranked: DataFrame, budget: int, cost: str, by: str = "session_id", item: str = "belief_id", order: str = "rank") -> DataFrame:
    """Greedy packing in order with skipping: what does not fit is left out, later smaller ones may still fit.

    The items of one key are few (a session's beliefs); gives used, admitted and omitted for each key."""
    items = ranked.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, F.col(item).cast("string").alias("item"), F.col(cost).cast("long").alias("cost")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<string>)").alias("admitted"), F.expr("cast(array() as array<string>)").alias("omitted"))

    def step(acc, x):
        fits = acc["used"] + x["cost"] <= budget
        return F.struct(
            F.when(fits, acc["used"] + x["cost"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["admitted"], F.array(x["item"]))).otherwise(acc["admitted"]).alias("admitted"),
            F.when(fits, acc["omitted"]).otherwise(F.concat(acc["omitted"], F.array(x["item"]))).alias("omitted"),
        )

    return items.select(by, F.aggregate("items", start, step).alias("p")).select(by, "p.used", "p.admitted", "p.omitted")


def _by_type(items: Column) -> Column:
    """The counts of belief types, as "type=count" parts in alphabetical order."""
    types = F.transform(items, lambda x: x["belief_type"])
    return F.transform(F.array_sort(F.array_distinct(types)), lambda t: F.concat(t, F.lit("="), F.size(F.filter(types, lambda x: x == t)).cast("string")))


def overlay(beliefs: DataFrame, events: DataFrame, turn: int, budget: int, k: int = 20) -> DataFrame:
    """The rendered overlay of each session within ``budget`` tokens: a header, the admitted lines in order, and the counts of
    omitted types where they still fit; with the counts of admitted and omitted types."""
    state = full_state(beliefs, events, turn)
    line = belief.overlay_line(F.col("state"), F.col("belief_type"), F.col("claim"), F.col("authority"), F.col("last_updated_turn"))
    ranked = rank_overlay(state, turn, k).withColumn("line", line).withColumn("cost", belief.approx_tokens(F.col("line")) + 1)
    reserve = max(1, (len(HEADER.format(budget=budget, used=9999, omitted=99, k=k)) + 3) // 4) + 1
    packed = pack(ranked, max(0, budget - reserve), "cost")
    items = ranked.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rank", "belief_id", "belief_type", "line"))).alias("items"))
    j = packed.join(items, "session_id")
    inside = F.filter("items", lambda x: F.array_contains("admitted", x["belief_id"]))
    outside = F.filter("items", lambda x: F.array_contains("omitted", x["belief_id"]))
    top = F.format_string(HEADER.format(budget=budget, used="%d", omitted="%d", k=k), F.col("used"), F.size("omitted"))
    body = F.concat_ws("\n", top, F.transform(inside, lambda x: x["line"]))
    trial = F.concat(body, F.lit("\n# omitted: "), F.array_join(_by_type(outside), ", "))
    text = F.when((F.size("omitted") > 0) & (belief.approx_tokens(trial) <= budget), trial).otherwise(body)
    return j.select(
        "session_id", text.alias("text"), F.col("used").alias("body_tokens"), belief.approx_tokens(text).alias("tokens_used"), F.size("admitted").cast("long").alias("n_admitted"), F.size("omitted").cast("long").alias("n_omitted"),
        F.array_join(_by_type(inside), ",").alias("admitted_by_type"), F.array_join(_by_type(outside), ",").alias("omitted_by_type"),
    )


def rank_clusters(clustered: DataFrame) -> DataFrame:
    """Clusters of each session in overlay order, weakened and contradicted ones behind blockers; the last key is the sha256 of
    the representative. clustered: session_id, belief_type, state, last_updated_turn, authority_rank, all_outside, representative."""
    tier = F.when(F.col("belief_type").isin(*RANK_BLOCKERS), 1).when(F.col("state").isin("weakened", "contradicted"), 2).otherwise(5)
    w = Window.partitionBy("session_id").orderBy(F.when(F.col("all_outside"), 0).otherwise(1), tier, F.desc("last_updated_turn"), F.desc("authority_rank"), F.sha2(F.col("representative").cast("string").cast("binary"), 256))
    return clustered.withColumn("rank", F.row_number().over(w))


def clusters(beliefs: DataFrame) -> DataFrame:
    """One row per (session_id, belief_type, claim): how many, the last update, the highest authority, whether all are out of
    the window, and the representative: the latest active one, else the latest."""
    best = F.struct((F.col("state") == "active").cast("int"), "last_updated_turn", "belief_id")
    return beliefs.groupBy("session_id", "belief_type", "claim").agg(
        F.count("*").alias("n"), F.max("last_updated_turn").alias("last_updated_turn"), F.max(belief.authority_rank(F.col("authority"))).alias("authority_rank"), F.bool_and("outside").alias("all_outside"), F.max_by("belief_id", best).alias("representative"), F.max_by("state", best).alias("state")
    )


def hash_chain(lines: DataFrame) -> DataFrame:
    """The last link of each session's chain h = sha256(hex of the link before || bytes), in line order.

    A chain is sequential by definition; a session's lines meet in one array."""
    parts = F.array_sort(F.collect_list(F.struct("line", F.col("raw").cast("binary").alias("raw"))))
    link = F.aggregate(parts, F.lit(""), lambda h, x: F.sha2(F.concat(h.cast("binary"), x["raw"]), 256))
    return lines.groupBy("session_id").agg(F.count("*").alias("n_lines"), link.alias("chain"))


def verify(lines: DataFrame, events: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Checks of each session: lines contiguous from 1, no unrecognised line, event_idx contiguous in each turn, hashes true,
    no rule failures. lines: session_id, line, raw, sha, status; events: session_id, turn, event_idx."""
    per = lines.groupBy("session_id").agg(F.count("*").alias("n"), F.max("line").alias("top"), F.count_distinct("line").alias("d"), F.count_if(F.col("status") == "unrecognized").alias("unknown"), F.count_if(F.col("sha") != F.sha2(F.col("raw").cast("binary"), 256)).alias("bad"))
    turns = events.groupBy("session_id", "turn").agg(F.count("*").alias("n"), F.max("event_idx").alias("top"), F.count_distinct("event_idx").alias("d"))
    gaps = turns.groupBy("session_id").agg(F.count_if((F.col("n") != F.col("d")) | (F.col("top") != F.col("n") - 1)).alias("gaps"))
    out = per.join(gaps, "session_id", "left")
    fails = F.lit(0).cast("long")
    if failures is not None:
        out = out.join(failures.groupBy("session_id").agg(F.count("*").alias("fails")), "session_id", "left")
        fails = F.coalesce("fails", F.lit(0).cast("long"))
    entry = lambda name, ok, detail: F.struct(F.lit(name).alias("check"), ok.alias("ok"), detail.alias("detail"))
    gap = F.coalesce(F.col("gaps"), F.lit(0).cast("long"))
    checks = F.array(
        entry("line_count", (F.col("n") == F.col("top")) & (F.col("n") == F.col("d")), F.col("n")),
        entry("unrecognized", F.col("unknown") == 0, F.col("unknown")),
        entry("contiguity", gap == 0, gap),
        entry("hashes", F.col("bad") == 0, F.col("bad")),
        entry("rule_failures", fails == 0, fails),
    )
    return out.select("session_id", F.explode(checks).alias("c")).select("session_id", "c.check", "c.ok", "c.detail")


def finalize(lines: DataFrame) -> DataFrame:
    """Lines with content and a digest of the whole of each session."""
    full = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"]), "\n")
    return lines.groupBy("session_id").agg(F.count_if(F.trim("raw") != "").alias("n_lines"), F.sha2(full.cast("binary"), 256).alias("sha"))
