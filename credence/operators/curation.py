"""Balanced selection of questions under several quotas at once.

Categories are filled one after the other: each answer class up to its target, then open slots by the class of which more
is left; each pick goes to the turn position that is most wanted, and no session gives more than a cap over all
categories. Candidates stand in the order of a seeded hash, so the choice can be made again.

Whatever the input, few candidates can be chosen: with Q questions in all, of a category, class and position no more than the
first Q + a category's target can ever be looked at, once a session's own are cut to the cap, since each earlier pick
closes one candidate of a session at most beyond those the cap leaves. So Spark cuts every bin to that many by a top-k in
salted groups, and one task chooses among a number of rows that the quotas bound.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Quotas:
    """Defaults are fixed values: 15 of each category, 5 of each answer and 5 open, positions, and the cap of a session."""

    categories: tuple[str, ...]
    classes: tuple[tuple[str, int], ...] = (("POSITIVE", 5), ("NEGATIVE", 5))
    total: int = 15
    positions: tuple[tuple[str, int], ...] = (("middle", 8), ("early", 4), ("late", 3))
    fallback: tuple[str, ...] = ("middle", "late", "early")
    per_session: int = 3
    seed: int = 20260601


def ordered(candidates: DataFrame, seed: int) -> DataFrame:
    key = F.concat_ws(":", F.col("session_id").cast("string"), F.col("turn").cast("string"), F.lit(str(seed)))
    return candidates.withColumn("__o", F.sha2(key.cast("binary"), 256))


def shortlist(candidates: DataFrame, q: Quotas, salts: int = 16) -> DataFrame:
    """The candidates that can be chosen, with the number of all of their category and class."""
    bin_ = ["category", "answer", "position"]
    most = q.total * len(q.categories) + q.total
    asked = candidates.where(F.col("category").isin(*q.categories) & F.col("answer").isin(*(c for c, _ in q.classes)) & F.col("position").isin(*q.fallback))
    rows = ordered(asked, q.seed)
    counts = rows.groupBy("category", "answer").agg(F.count("*").alias("__all"))
    own = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*bin_, "session_id").orderBy("__o"))).where(F.col("__r") <= q.per_session)
    salted = own.withColumn("__s", F.pmod(F.xxhash64("__o"), F.lit(salts))).withColumn("__r", F.row_number().over(Window.partitionBy(*bin_, "__s").orderBy("__o"))).where(F.col("__r") <= most)
    best = salted.withColumn("__r", F.row_number().over(Window.partitionBy(*bin_).orderBy("__o"))).where(F.col("__r") <= most)
    return best.join(F.broadcast(counts), ["category", "answer"]).select("category", "answer", "position", "session_id", "turn", "__o", "__all")


def choose(rows: pd.DataFrame, q: Quotas) -> list[tuple]:
    """(pick, category, answer, position, session_id, turn) of the chosen rows, in order."""
    pools: dict[tuple, list[tuple]] = {}
    left: dict[tuple, int] = {}
    for r in rows.sort_values("__o").itertuples(index=False):
        category, answer, position, session, turn, _, everything = r
        pools.setdefault((category, answer, position), []).append((session, turn))
        left[category, answer] = everything
    used: dict[object, int] = {}
    out: list[tuple] = []

    def pick(category: str, answer: str, wanted: dict[str, int]) -> bool:
        first = next((p for p, n in wanted.items() if n > 0), None)
        for position in ([first] if first else []) + list(q.fallback):
            pool = pools.get((category, answer, position), [])
            at = next((i for i, (session, _) in enumerate(pool) if used.get(session, 0) < q.per_session), None)
            if at is not None:
                session, turn = pool.pop(at)
                used[session] = used.get(session, 0) + 1
                left[category, answer] -= 1
                wanted[position] = wanted.get(position, 0) - 1
                out.append((len(out) + 1, category, answer, position, session, turn))
                return True
        return False

    for category in q.categories:
        wanted, before = dict(q.positions), len(out)
        for answer, target in q.classes:
            for _ in range(target):
                if not pick(category, answer, wanted):
                    break
        while len(out) - before < q.total:
            order = sorted((c for c, _ in q.classes), key=lambda c: -left.get((category, c), 0))
            if not any(pick(category, c, wanted) for c in order):
                break
    return out


def curate(candidates: DataFrame, q: Quotas) -> DataFrame:
    """pick, category, answer, position, session_id and turn of the chosen candidates (session_id, turn, category, answer, position)."""
    few = shortlist(candidates, q)
    kinds = {f.name: f.dataType.simpleString() for f in few.schema.fields}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(choose(rows.drop(columns="__one"), q), columns=["pick", "category", "answer", "position", "session_id", "turn"])

    schema = f"pick long, category string, answer string, position string, session_id {kinds['session_id']}, turn {kinds['turn']}"
    return few.withColumn("__one", F.lit(1)).groupBy("__one").applyInPandas(run, schema)


def shortfalls(chosen: DataFrame, q: Quotas, floor: dict[str, int]) -> DataFrame:
    """What the selection lacks: (category, what, wanted, got) for totals, floors of answers and positions."""
    spark = chosen.sparkSession
    goals = [(c, "total", q.total) for c in q.categories] + [(c, a, n) for c in q.categories for a, n in floor.items()] + [(c, p, n) for c in q.categories for p, n in q.positions]
    got = chosen.select("category", F.explode(F.array(F.lit("total"), F.col("answer"), F.col("position"))).alias("what")).groupBy("category", "what").agg(F.count("*").alias("got"))
    out = spark.createDataFrame(goals, "category string, what string, wanted long").join(got, ["category", "what"], "left").na.fill(0, ["got"])
    return out.where("got < wanted")
