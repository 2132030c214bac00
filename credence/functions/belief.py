"""Weights, token estimates, ids and ordered classifications of beliefs, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = 0.6931471805599453
AUTHORITY = {"assistant": 1, "user": 2, "tool": 3}


def decayed(confidence: Column, age_seconds: Column, half_life_seconds: Column) -> Column:
    """Exponential decay by half-life; not before birth."""
    return F.when(age_seconds <= 0, confidence).otherwise(confidence * F.exp(-LN2 * age_seconds / half_life_seconds))


def invariant_weight(status: Column) -> Column:
    """1 while a validation passed, else 0."""
    return F.when(status == "PASS", 1.0).otherwise(0.0)


def is_active(weight: Column, threshold: float = 0.1) -> Column:
    return weight >= threshold


def warrant_fault(kind: Column, confidence: Column, half_life_seconds: Column, status: Column) -> Column:
    """Why a warrant is not valid, or null."""
    return (
        F.when(~kind.isin("decaying", "invariant") | kind.isNull(), "unknown warrant type")
        .when(~confidence.between(0.0, 1.0), "confidence outside [0, 1]")
        .when((kind == "decaying") & ~F.coalesce(half_life_seconds > 0, F.lit(False)), "half-life must be positive")
        .when((kind == "invariant") & ~F.coalesce(status.isin("PASS", "FAIL", "UNKNOWN"), F.lit(False)), "unknown validation status")
    )


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("long")


def content_id(prefix: str, *parts: Column, length: int = 64) -> Column:
    """A content-addressed id: prefix and the first hex digits of the sha256 of the parts, joined by newlines."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\n", *parts).cast("binary"), 256), 1, length))


def authority_rank(authority: Column) -> Column:
    out = F.lit(0)
    for name, rank in AUTHORITY.items():
        out = F.when(authority == name, rank).otherwise(out)
    return out


def overlay_line(state: Column, kind: Column, claim: Column, authority: Column, last_turn: Column) -> Column:
    return F.format_string("[%s] %s :: %s (auth=%s, last=%d)", state, kind, F.substring(claim, 1, 80), authority, last_turn)


def decay_status(age: Column, half_life: Column) -> Column:
    ratio = age / half_life
    return F.when(ratio < 0.5, "fresh").when(ratio < 1, "decaying").otherwise("stale")


def coverage_status(support: Column, refs: Column) -> Column:
    return F.when((support >= 3) & (refs >= 5), "covered").when((support <= 1) & (refs <= 2), "sparse").otherwise("partial")


def position_bucket(turn: Column, total: Column) -> Column:
    share = turn / total
    return F.when(share < 0.25, "early").when(share < 0.75, "middle").otherwise("late")


#: The defaults of both sets of thresholds.
@dataclass(frozen=True)
class LifecycleThresholds:
    inverted_corr: float = -0.30
    min_n_active: int = 5
    reopen_n: int = 10
    contradicted_vs_base: float = 0.0
    strengthened_delta: float = 0.05
    weakened_delta: float = 0.05


def lifecycle(prior_state: Column, prior_top1: Column, top1: Column, n: Column, baseline: Column, corr: Column, t: LifecycleThresholds = LifecycleThresholds()) -> Column:
    """struct(to_state, reason): the first rule that applies, from birth to holding the state."""
    delta = top1 - prior_top1
    two = lambda c: F.format_string("%.2f", c)
    step = lambda state, *reason: F.struct(F.lit(state).alias("to_state"), F.concat(*reason).alias("reason"))
    return (
        F.when(prior_state.isNull(), step("born", F.lit("first observation")))
        .when(corr < t.inverted_corr, step("inverted", F.lit("prior and actual ranks correlate at "), two(corr)))
        .when(n < t.min_n_active, step("retired", F.lit("too few observations: "), n.cast("string")))
        .when((prior_state == "retired") & (n >= t.reopen_n) & top1.isNotNull(), step("reopened", F.lit("observations again: "), n.cast("string")))
        .when(top1 < baseline - t.contradicted_vs_base, step("contradicted", F.lit("top1 "), two(top1), F.lit(" below baseline "), two(baseline)))
        .when(delta >= t.strengthened_delta, step("strengthened", F.lit("top1 up by "), two(delta)))
        .when(delta <= -t.weakened_delta, step("weakened", F.lit("top1 down by "), two(-delta)))
        .when(prior_top1.isNull() & top1.isNotNull(), step("strengthened", F.lit("first measured top1")))
        .otherwise(F.struct(prior_state.alias("to_state"), F.lit("no material change").alias("reason")))
    )


@dataclass(frozen=True)
class DecisionThresholds:
    recluster_top1: float = 0.20
    monitor_top1: float = 0.50
    promote_top1: float = 0.75
    promote_min_n_test: int = 10
    escalate_labels: tuple[str, ...] = ()


def decision(state: Column, label: Column, top1: Column, n_test: Column, t: DecisionThresholds = DecisionThresholds()) -> Column:
    """The decision class of a region: the first rule that applies."""
    return (
        F.when(state == "retired", "RETIRE")
        .when(state == "inverted", "INVERT")
        .when(label.isin(*t.escalate_labels) if t.escalate_labels else F.lit(False), "ESCALATE")
        .when(top1.isNull() | (n_test == 0), "INTERVENE")
        .when(top1 < t.recluster_top1, "RECLUSTER")
        .when(top1 < t.monitor_top1, "MONITOR")
        .when((top1 >= t.promote_top1) & (n_test >= t.promote_min_n_test), "PROMOTE")
        .otherwise("MONITOR")
    )


#: What is advised for each decision.
ADVICE = {
    "RETIRE": "stop scoring this region; reassess if evidence returns", "INVERT": "flip the prior; reality is the inverse of what we thought", "ESCALATE": "raise to senior approver; human review required",
    "INTERVENE": "collect more outcomes before any automated action", "RECLUSTER": "region is incoherent; refit clusters or increase k", "PROMOTE": "treat as trusted region; route automatic decisions through it",
    "WATCH": "watch; do not promote until calibration improves", "REVISIT": "watch; revisit after more test observations accumulate",
}


def decision_record(state: Column, state_reason: Column, label: Column, top1: Column, n_test: Column, t: DecisionThresholds = DecisionThresholds()) -> Column:
    """struct(decision, reasons, action): the decision, what speaks for it in order, and what is advised."""
    made = decision(state, label, top1, n_test, t)
    two, low = lambda c: F.format_string("%.2f", c), (top1 < t.monitor_top1)
    life = F.when(state.isNotNull(), F.concat(F.lit("lifecycle: "), state, F.lit(" ("), F.coalesce(state_reason, F.lit("")), F.lit(")")))
    own = (
        F.when(made == "RETIRE", F.concat(F.lit("n_test="), n_test.cast("string"))).when(made == "INVERT", None).when(made == "ESCALATE", F.concat(F.lit("label '"), label, F.lit("' is high-severity")))
        .when(made == "INTERVENE", "no labeled test data available").otherwise(F.concat(F.lit("top1="), two(top1), F.lit(", n_test="), n_test.cast("string")))
    )
    last = (
        F.when(made == "RECLUSTER", F.concat(F.lit("top1 "), two(top1), F.lit(f" below recluster floor {t.recluster_top1:.2f}"))).when(made == "PROMOTE", "meets promote thresholds")
        .when((made == "MONITOR") & ~low, "does not yet clear promote thresholds")
    )
    advice = F.when((made == "MONITOR") & low, ADVICE["WATCH"]).when(made == "MONITOR", ADVICE["REVISIT"])
    for name, words in ADVICE.items():
        advice = advice.when(made == name, words)
    return F.struct(made.alias("decision"), F.array_compact(F.array(life, own, last)).alias("reasons"), advice.alias("action"))


def outcome_label(verdict: Column, problem: Column) -> Column:
    """TP, FP, FN or TN of a suppress/allow verdict against what followed; UNCERTAIN if unknown."""
    return (
        F.when(problem.isNull(), "UNCERTAIN")
        .when(verdict == "SUPPRESS", F.when(problem, "TP").otherwise("FP"))
        .otherwise(F.when(problem, "FN").otherwise("TN"))
    )


def combined_label(oracle: Column, judge: Column) -> Column:
    """struct(label, conflict): the oracle's label where it has one, else the judge's."""
    label = F.when(F.coalesce(oracle, F.lit("NA")) != "NA", oracle).otherwise(judge)
    conflict = oracle.isNotNull() & judge.isNotNull() & (oracle != "NA") & (judge != "NA") & (oracle != judge)
    return F.struct(label.alias("label"), F.coalesce(conflict, F.lit(False)).alias("conflict"))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def signature_matches(a: Column, b: Column) -> Column:
    """Whether two turns' signatures (operators.turns.signature) are of one failure: a common tool and the same error, or a
    common file and a common command."""
    common = lambda name: F.coalesce(F.arrays_overlap(a[name], b[name]), F.lit(False))
    return common("tools") & F.coalesce(a["error_kw"] == b["error_kw"], F.lit(False)) | common("file_paths") & common("cmd_tokens")


def near_signature_matches(a: Column, b: Column, least: float = 0.5) -> Column:
    """The wider form: a common tool and error words of a Jaccard similarity of ``least``, a common file and command, or a common
    exception class. a, b: struct(tools, error_words, file_paths, cmd_tokens, exception_classes)."""
    common = lambda name: F.coalesce(F.arrays_overlap(a[name], b[name]), F.lit(False))
    near = F.coalesce(jaccard(a["error_words"], b["error_words"]) >= least, F.lit(False))
    return common("tools") & near | common("file_paths") & common("cmd_tokens") | common("exception_classes")


def path_overlap(a: Column, b: Column) -> Column:
    """Equal, or one an ancestor of the other."""
    a, b = F.regexp_replace(a, "/+$", ""), F.regexp_replace(b, "/+$", "")
    return (a == b) | F.startswith(a, F.concat(b, F.lit("/"))) | F.startswith(b, F.concat(a, F.lit("/")))


def normalized_signature(text: Column, most: int = 200) -> Column:
    """Volatile parts of an error text (times, line numbers, deep paths) replaced, in lower case, cut at ``most``."""
    text = F.regexp_replace(text, r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d)?(\.\d+)?Z?", "<ts>")
    text = F.regexp_replace(text, r"(/[^/\s:]+)+((/[^/\s:]+){3})", "<path>$2")
    text = F.regexp_replace(text, r":\d+(:\d+)?", ":<line>")
    return F.substring(F.lower(text), 1, most)


#: What looks like a path, a line number and a time in messages and arguments, and argument keys that change from call to call.
PATH, LINE_NUMBER, ISO_TIME = r"(?U)(?:/[\w\.-]+)+/?", r":\d+:", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
VOLATILE_KEYS = ["timestamp", "request_id", "uuid", "run_id", "id", "trace_id"]


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalized_arguments(text: Column) -> Column:
    """Arguments with paths cut to their last three parts, volatile keys dropped and white space collapsed."""
    text = _spaced(text)
    parts = lambda p: F.filter(F.split(p, "/"), lambda x: x != "")
    short = lambda p: F.when(F.size(parts(p)) > 3, F.concat(F.lit(".../"), F.array_join(F.slice(parts(p), -3, 3), "/"))).otherwise(F.array_join(parts(p), "/"))
    between, paths = F.split(text, PATH), F.transform(F.regexp_extract_all(text, F.lit(PATH), F.lit(0)), short)
    text = F.array_join(F.zip_with(between, paths, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    for key in VOLATILE_KEYS:
        text = F.regexp_replace(text, rf"(?iU)\b{key}\s*[=:]\s*[\"']?[\w\-]+[\"']?", "")
    return _spaced(text)


def normalized_error(text: Column, most: int = 200) -> Column:
    """A message in lower case with line numbers, paths and times masked and white space collapsed, cut at ``most``."""
    text = F.regexp_replace(F.lower(text), LINE_NUMBER, ":LINE:")
    text = F.regexp_replace(F.regexp_replace(text, PATH, "<PATH>/"), ISO_TIME, "<TS>")
    return F.substring(_spaced(text), 1, most)
