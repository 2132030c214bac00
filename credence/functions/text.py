"""Text rules: summaries, predicates over commands and paths, clamps and templates, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pattern banks, tried in order, tools that validate and edit, and the marks of a tool's success.
APPROVAL_REQUEST = [
    r"(?i)should I (proceed|continue|deploy|commit|push|run|delete|drop)", r"(?i)can I (proceed|continue|deploy|commit|push|run|delete|drop)", r"(?i)are you ok with",
    r"(?i)do you want me to", r"(?i)shall I", r"(?i)awaiting (your )?approval",
]
APPROVAL_GRANT = [r"(?i)^(yes|sure|go ahead|approved|proceed|do it|ok|okay)\b", r"(?i)\bsounds good\b", r"(?i)\bplease (do|proceed|continue)\b"]
APPROVAL_DENY = [r"(?i)^(no|stop|hold on|wait|don't|do not|cancel)\b", r"(?i)\b(reject|denied|refuse)\b"]
REPORT_PATHS = [r"report\.html$", r"report\.pdf$", r"report\.md$", r"REPORT[_\-].*\.md$", r"/reports/", r"summary\.(md|html|pdf)$"]
VALIDATION_TOOLS = ["pytest", "npm_test", "cargo_test", "go_test", "jest", "mocha", "lint", "typecheck", "mypy", "tsc", "eslint", "rubocop", "build", "make", "cargo_build", "go_build"]
VALIDATION_COMMANDS = [
    r"^pytest\b", r"^npm (run )?test\b", r"^cargo test\b", r"^go test\b", r"^npx jest\b", r"^mypy\b",
    r"^npx tsc\b", r"^eslint\b", r"^npm (run )?build\b", r"^make\b", r"^cargo build\b", r"^go build\b",
]
EDIT_TOOLS = ["write_file", "edit_file", "apply_patch"]
SUCCESS_MARKS = ["Patch applied", "Successfully applied", "Wrote file", "Created file", "Updated file", "Done."]


#: A word's edge: between [0-9A-Za-z_] and anything else. The JVM's own \b counts the letters of every script as a word's.
_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def plain_words(pattern: str) -> str:
    """The pattern with edges of ASCII words in place of \\b and, where it ignores case, the signs that fold to k and s."""
    fold = {"k": "[k\u212a]", "s": "[s\u017f]"} if pattern.startswith("(?i)") else {}
    return re.sub(r"\\.|\[[^\]]*\]|\(\?\w+\)|[ks]", lambda m: _EDGE if m[0] == r"\b" else fold.get(m[0], m[0]), pattern)


def first_match(text: Column, bank: list[str]) -> Column:
    """The text that the first matching pattern matches, or null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in bank))


def matches_any(text: Column, bank: list[str]) -> Column:
    out = F.lit(False)
    for p in bank:
        out = out | F.coalesce(text.rlike(p), F.lit(False))
    return out


def is_validation(tool: Column, command: Column) -> Column:
    return F.coalesce(tool.isin(*VALIDATION_TOOLS), F.lit(False)) | matches_any(command, VALIDATION_COMMANDS)


def has_report_path(paths: Column) -> Column:
    return F.coalesce(F.exists(paths, lambda p: matches_any(p, REPORT_PATHS)), F.lit(False))


def is_meta(role: Column, text: Column) -> Column:
    """A user turn that a tool wrote."""
    return (role == "user") & (F.startswith(text, F.lit("<command-message>")) | F.startswith(text, F.lit("<system-reminder>")))


def shortened(text: Column, most: int) -> Column:
    """Cut at ``most`` characters, with how many are missing."""
    over = F.length(text) - most
    return F.when(over > 0, F.concat(F.substring(text, 1, most), F.lit("… [+"), over.cast("string"), F.lit(" chars]"))).otherwise(text)


def first_line_of(output: Column, kind: str = "stderr") -> Column:
    """The first line that names an error, else the first line with content."""
    lines = F.filter(F.split(output, "\n"), lambda x: F.trim(x) != "")
    bad = F.filter(lines, lambda x: x.rlike(r"(?i)error|exception|traceback|fail")) if kind == "stderr" else lines
    return F.coalesce(F.get(bad, F.lit(0)), F.get(lines, F.lit(0)))


def failure_signature(exit_code: Column, output: Column) -> Column:
    return F.concat(F.coalesce(exit_code.cast("string"), F.lit("?")), F.lit(":"), F.coalesce(F.trim(first_line_of(output)), F.lit("")))


def clamped(value: Column, low: float, high: float, default: float) -> Column:
    """A number from untrusted text, held in [low, high]; the default where it is none."""
    return F.coalesce(F.least(F.greatest(value.try_cast("double"), F.lit(low)), F.lit(high)), F.lit(default))


def from_template(templates: list[str], turn: Column, category: Column) -> Column:
    """The template at (turn + length of the category) modulo their number, with {turn} filled in."""
    k = ((turn + F.length(category)) % len(templates)).cast("int") + 1
    return F.replace(F.element_at(F.array(*map(F.lit, templates)), k), F.lit("{turn}"), turn.cast("string"))


STATE_CLASS = {"signup": ("growing", 1), "purchase": ("growing", 1), "view": ("steady", 0), "click": ("steady", 0), "error": ("failing", -1)}


def state_class(state: Column) -> Column:
    """struct(state_class, direction) of a state; unknown states are neutral."""
    out = F.struct(F.lit("unknown").alias("state_class"), F.lit(0).alias("direction"))
    for name, (group, direction) in STATE_CLASS.items():
        out = F.when(state == name, F.struct(F.lit(group).alias("state_class"), F.lit(direction).alias("direction"))).otherwise(out)
    return out
