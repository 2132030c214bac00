"""Evidence joins, retrieval under a budget, and evaluation of arms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the given order; rows without a key go."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.where(F.col(key).isNotNull()).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def remaining(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def evidence(beliefs: DataFrame, events: DataFrame, days_before: int = 7, most: int = 50) -> DataFrame:
    """The latest ``most`` events of a belief's actor from ``days_before`` days before its first to its last day.

    beliefs: belief_id, actor, first_seen, last_seen; events: event_id, actor, date. An equi-join by actor and week keeps
    the band join from pairing an actor's whole history."""
    week = lambda c: F.floor(F.unix_date(c) / 7)
    b = beliefs.withColumn("from", F.date_sub("first_seen", days_before)).withColumn("week", F.explode(F.sequence(week(F.col("from")), week(F.col("last_seen")))))
    j = b.join(events.withColumn("week", week(F.col("date"))), ["actor", "week"]).where(F.col("date").between(F.col("from"), F.col("last_seen")))
    w = Window.partitionBy("belief_id").orderBy(F.desc("date"), F.desc("event_id"))
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("belief_id", "event_id", "date", "rank")


def counter_evidence(setbacks: DataFrame, events: DataFrame, days: int = 3) -> DataFrame:
    """Each belief's events of its actor within ``days`` days of a day on which it was contradicted or weakened: belief_id and
    event_ids (sorted, each once). setbacks: belief_id, actor, date; events: event_id, actor, date."""
    width = 2 * days + 1
    slot = lambda c: F.floor(F.unix_date(c) / width)
    s = setbacks.select("belief_id", "actor", F.col("date").alias("day")).distinct()
    s = s.withColumn("slot", F.explode(F.array_distinct(F.array(slot(F.date_sub("day", days)), slot(F.date_add("day", days))))))
    j = s.join(events.withColumn("slot", slot(F.col("date"))), ["actor", "slot"]).where(F.abs(F.datediff("date", "day")) <= days)
    return j.groupBy("belief_id").agg(F.array_sort(F.collect_set("event_id")).alias("event_ids"))


def loaded(rows: DataFrame, least: int = 30) -> DataFrame:
    """A corpus of files in order (file_rank, line, event_id, timestamp, title, text): the first row of each id, with the length of title
    and text and whether that is too short to say anything."""
    first = first_wins(rows.where("timestamp is not null"), "event_id", ["file_rank", "line"])
    size = F.length(F.trim(F.concat_ws(" ", "title", "text")))
    return first.withColumns({"combined_len": size, "degenerate": size < least})


def at_cutoff(beliefs: DataFrame, refs: DataFrame, chunks: DataFrame, cutoff: str) -> DataFrame:
    """Beliefs known at the cutoff, with the references that were there by then, their sources and how many
    there are of each, the most first.

    beliefs: belief_id, last_updated; refs: belief_id, chunk_id; chunks: chunk_id, ts, source."""
    known = beliefs.where(F.col("last_updated") <= F.lit(cutoff).cast("date"))
    by_source = refs.join(chunks.where(F.col("ts") <= F.lit(cutoff).cast("date")), "chunk_id").groupBy("belief_id", "source").agg(F.count("*").alias("n"))
    mix = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "source"))), lambda x: F.concat_ws(":", x["source"], -x["n"]))
    r = by_source.groupBy("belief_id").agg(F.sum("n").alias("n_refs"), F.count("source").alias("n_sources"), F.array_join(mix, ", ").alias("source_mix"))
    return known.join(r, "belief_id", "left").na.fill(0, ["n_refs", "n_sources"]).na.fill("", ["source_mix"])


def rank_beliefs(beliefs: DataFrame, cutoff: str, by: str, stale_first: bool = False) -> DataFrame:
    """Rank by match type, coverage, lifecycle (inverted for questions about stale assumptions), age, support x confidence."""
    cover = F.when(F.col("coverage") == "covered", 0).when(F.col("coverage") == "partial", 1).otherwise(2)
    life = F.when(F.col("state") == "active", 0).otherwise(1)
    age = F.datediff(F.lit(cutoff).cast("date"), F.col("last_updated"))
    w = Window.partitionBy(by).orderBy("match_type", cover, -life if stale_first else life, age, -(F.col("support") * F.col("confidence")), "belief_id")
    return beliefs.withColumn("rank", F.row_number().over(w))


#: Askers of a theme that one task meets, about.
ASKERS = 10_000


def theme_expansion(beliefs: DataFrame, themes: DataFrame, actor: str, most: int = 50) -> DataFrame:
    """Beliefs of other actors that share a theme with the actor's, at most ``most`` of each actor's, by belief_id.

    Of a theme, an actor's first ``most`` beliefs and of these the first 2 * ``most`` can be among an asker's first ones (of
    which up to ``most`` are its own), so a theme is one short list, of which each asker takes the first ``most`` of others. The
    askers of a theme with many of them are dealt to several tasks; such themes are one in ASKERS rows at most."""
    own = beliefs.join(themes, "belief_id").select("theme", F.col(actor).alias("actor"), "belief_id").distinct()
    mine = own.select("theme", F.col("actor").alias("asker")).distinct()
    first = own.withColumn("__r", F.row_number().over(Window.partitionBy("theme", "actor").orderBy("belief_id"))).where(F.col("__r") <= most)
    first = first.withColumn("__r", F.row_number().over(Window.partitionBy("theme").orderBy("belief_id"))).where(F.col("__r") <= 2 * most)
    lists = first.groupBy("theme").agg(F.array_sort(F.collect_list(F.struct("belief_id", "actor"))).alias("list"))
    hot = F.broadcast(mine.groupBy("theme").agg(F.ceil(F.count("*") / ASKERS).cast("int").alias("ways")).where("ways > 1"))
    ways = F.coalesce("ways", F.lit(1))
    dealt = mine.join(hot, "theme", "left").withColumn("salt", F.pmod(F.xxhash64("asker"), ways).cast("int"))
    copied = lists.join(hot, "theme", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), ways - 1)))
    others = F.slice(F.filter("list", lambda x: x["actor"] != F.col("asker")), 1, most)
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said outright: the lists are short beside what they become
    each = dealt.join(copied, ["theme", "salt"]).select("asker", F.pmod(F.xxhash64("theme"), F.lit(64)).alias("some"), others["belief_id"].alias("ids")).repartition(parts, "asker")
    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids")
    chosen = each.groupBy("asker", "some").agg(merged).groupBy("asker").agg(merged)
    return chosen.select("asker", F.posexplode("ids").alias("rank", "belief_id")).select("asker", "belief_id", (F.col("rank") + 1).alias("rank"))


#: Queries and chunks that one task compares, chunks' cuts at least, and similarities held at once.
QUERY_BLOCK, CHUNK_BLOCK, CUTS, CELLS = 2000, 50_000, 8, 1 << 21
#: How far a product of matrices may be from the similarity that decides.
NEAR = 1e-9


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two equally long arrays, summed in order; a zero vector's is -inf, after all others."""
    total = lambda x, y: np.add.reduce([x[:, k] * y[:, k] for k in range(x.shape[1])], axis=0) if x.shape[1] else np.zeros(len(x))
    lengths = np.sqrt(total(a, a)) * np.sqrt(total(b, b))
    return np.where(lengths > 0, total(a, b) / np.where(lengths > 0, lengths, 1.0), -np.inf)


def _leading(query: np.ndarray, chunk: np.ndarray, sim: np.ndarray, keep: np.ndarray, top: int):
    """Each query's first ``top`` rows, in order."""
    order = np.lexsort((chunk, -sim, query))
    query = query[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    order = order[place < top]
    return query[place < top], chunk[order], sim[order], keep[order]


def _best(top: int):
    """Each query's first ``top`` chunks of the rows (part, side, id, keep, vector): queries are side 0, chunks side 1."""

    def compare(ids, q, unit, least, held, chunk, keep, v):
        # equal vectors have one similarity, so the first of them by id are enough
        order = np.argsort(chunk, kind="stable")
        chunk, keep, v = chunk[order], keep[order], v[order]
        _, first, copy = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        copy = copy.ravel()
        members = np.argsort(copy, kind="stable")
        starts = np.searchsorted(copy[members], np.arange(len(first)))
        sizes = np.minimum(np.diff(np.append(starts, len(members))), top)
        v = v[first]
        length = np.sqrt((v * v).sum(axis=1))
        w = np.where(length[:, None] > 0, v / np.where(length > 0, length, 1.0)[:, None], 0.0)
        step = max(1, CELLS // len(v))
        for k in range(0, len(ids), step):
            about = unit[k : k + step] @ w.T
            about[:, length == 0] = -np.inf
            about[(q[k : k + step] == 0).all(axis=1)] = -np.inf
            if about.shape[1] > top:
                least[k : k + step] = np.maximum(least[k : k + step], np.partition(about, -top, axis=1)[:, -top] - NEAR)
            row, at = np.nonzero(about >= least[k : k + step, None])
            for j in range(0, len(row), CELLS // 32):
                r, x = row[j : j + CELLS // 32] + k, at[j : j + CELLS // 32]
                sim = _cosines(q[r], v[x])
                many = sizes[x]
                each = np.repeat(np.arange(len(x)), many)
                member = members[np.repeat(starts[x], many) + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)]
                held.append((r[each], chunk[member], sim[each], keep[member]))
                if sum(len(h[0]) for h in held) > CELLS:
                    held[:] = [_leading(*map(np.concatenate, zip(*held)), top)]
        if held:
            held[:] = [_leading(*map(np.concatenate, zip(*held)), top)]
            query, _, sim, _ = held[0]
            n = np.bincount(query, minlength=len(ids))
            full = np.flatnonzero(n >= top)
            least[full] = np.maximum(least[full], sim[np.cumsum(n)[full] - 1] - NEAR)

    def run(batches):
        now, asked, state, held = None, [], None, []

        def done():
            if held:
                query, chunk, sim, keep = held[0]
                for k in range(0, len(query), 50_000):
                    part = slice(k, k + 50_000)
                    bare = ~np.isfinite(sim[part])
                    yield pa.RecordBatch.from_arrays([pa.array(state[0][query[part]]), pa.array(chunk[part]), pa.array(keep[part]), pa.array(sim[part], mask=bare)], names=["query_id", "chunk_id", "keep", "sim"])

        for batch in batches:
            part, side, id_ = (batch.column(k).to_numpy() for k in range(3))
            keep = batch.column(3).to_numpy(zero_copy_only=False)
            v = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            edge = np.flatnonzero(np.diff(part) | np.diff(side)) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows]):
                if part[a] != now:
                    yield from done()
                    now, asked, state, held = part[a], [], None, []
                if side[a] == 0:
                    asked.append((id_[a:b].copy(), v[a:b].copy()))
                elif asked:
                    if state is None:
                        ids, q = map(np.concatenate, zip(*asked))
                        length = np.sqrt((q * q).sum(axis=1))
                        state = ids, q, q / np.where(length > 0, length, 1.0)[:, None], np.full(len(ids), -np.inf)
                    for k in range(a, b, CELLS // 512):
                        to = min(b, k + CELLS // 512)
                        compare(*state, held, id_[k:to], keep[k:to], v[k:to])
        yield from done()

    return run


def top_then_cutoff(queries: DataFrame, chunks: DataFrame, top: int, keep: Column) -> DataFrame:
    """The ``top`` most similar chunks of each query first, then those of them that pass ``keep``: query_id, chunk_id, sim and rank.
    queries: query_id, q; chunks: chunk_id, embedding (of one length); ids are whole numbers, and a query's id stands once.

    Queries in blocks of about QUERY_BLOCK and chunks in parts of about CHUNK_BLOCK meet in one task each. Products of matrices
    leave a few more chunks than ``top`` of each query, of which the similarities summed in order choose; a task sends ``top`` rows
    a query. Null and zero vectors have no similarity and come last."""
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = queries.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / QUERY_BLOCK)).cast("int").alias("qs")).join(chunks.agg(F.greatest(F.ceil(F.count("*") / CHUNK_BLOCK), F.lit(CUTS)).cast("int").alias("cs")))  # one row
    whole = lambda x: F.transform(x, lambda y: y.cast("double"))
    zero = lambda x: F.when(x.isNull() | F.exists(x, lambda y: y.isNull()), F.transform(F.sequence(F.lit(1), F.col("n")), lambda y: F.lit(0.0))).otherwise(whole(x))
    length = chunks.agg(F.coalesce(F.max(F.size("embedding")), F.lit(1)).alias("n"))
    sizes = sizes.join(length)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = queries.join(F.broadcast(sizes)).withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("qs"))).withColumn("cb", every("cs"))
    asked = asked.select((F.col("qb") * F.col("cs") + F.col("cb")).cast("long").alias("part"), F.lit(0).alias("side"), F.col("query_id").cast("long").alias("id"), F.lit(False).alias("keep"), zero(F.col("q")).alias("v"))
    met = chunks.join(F.broadcast(sizes)).withColumn("cb", F.pmod(F.xxhash64("chunk_id"), F.col("cs"))).withColumn("qb", every("qs"))
    met = met.select((F.col("qb") * F.col("cs") + F.col("cb")).cast("long").alias("part"), F.lit(1).alias("side"), F.col("chunk_id").cast("long").alias("id"), F.coalesce(keep, F.lit(False)).alias("keep"), zero(F.col("embedding")).alias("v"))
    rows = asked.unionByName(met).repartition(parts, "part").sortWithinPartitions("part", "side")
    best = rows.mapInArrow(_best(top), "query_id long, chunk_id long, keep boolean, sim double")
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "chunk_id")
    return best.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= top) & F.col("keep")).drop("keep")


def packed(ranked: DataFrame, budget: int = 6000, by: str = "query_id", item: str = "chunk_id", cost: str = "tokens") -> DataFrame:
    """The retrieved items of each query that fit a budget of tokens, in order of rank, skipping those that do not fit: item, rank and the
    tokens used up to it. A query's items are the first of a ranking, so they are few."""
    from .ledger import pack

    kept = pack(ranked, budget, cost, by, item).select(by, F.explode("admitted").alias("__item"))
    chosen = ranked.join(kept, (ranked[by] == kept[by]) & (ranked[item].cast("string") == F.col("__item")), "left_semi")
    return chosen.withColumn("used", F.sum(cost).over(Window.partitionBy(by).orderBy("rank")))


def label_rates(labels: DataFrame, by: list[str]) -> DataFrame:
    """Share of YES among labels that apply, in long form (by, label)."""
    applies = F.col("label") != "NA"
    return labels.groupBy(*by).agg(F.count_if(applies).alias("n"), F.try_divide(F.count_if(F.col("label") == "YES"), F.count_if(applies)).alias("yes_rate"))


def preference_rates(judgements: DataFrame, by: str = "axis") -> DataFrame:
    """Win and tie rates of each axis after mapping swapped positions back; judgements: axis, swapped, winner (first, second, tie)."""
    real = F.when(F.col("winner") == "tie", "tie").when((F.col("winner") == "first") != F.col("swapped"), "A").otherwise("B")
    j = judgements.withColumn("real", real)
    return j.groupBy(by).agg(F.count("*").alias("n"), *((F.count_if(F.col("real") == x) / F.count("*")).alias(f"{x.lower()}_rate") for x in ("A", "B", "tie")))


def swapped(key: Column, seed: int) -> Column:
    """Whether a question's answers change places, by a seeded hash."""
    return F.conv(F.substring(F.sha2(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"), 256), 1, 1), 16, 10).cast("int") % 2 == 1


def arm_class(rates: DataFrame, arm: str, rate: str, by: list[str], near: float = 0.02, ahead: float = 0.03) -> DataFrame:
    """How arm C stands to arm A: better beyond ``ahead``, equal within ``near``, worse beyond ``ahead``, else unclear."""
    p = rates.groupBy(*by).agg(*(F.max(F.when(F.col(arm) == x, F.col(rate))).alias(x.lower()) for x in ("A", "B", "C")))
    d = F.col("c") - F.col("a")
    return p.withColumn("outcome", F.when(d.isNull(), "incomplete").when(d >= ahead, "better").when(d <= -ahead, "worse").when(F.abs(d) <= near, "equal").otherwise("unclear"))


#: Points of percent that count as an effect, and below which two arms are equal; the outcomes' names.
EFFECT, NOISE = 3.0, 2.0
LADDER = {
    6: "A_wins_overall_audit_needed", 1: "clean_ladder_E_gt_D_gt_C_gt_B_gt_A", 2: "discipline_wins_compression_alone_does_not", 3: "warrants_do_not_add_over_lifecycle",
    4: "structure_alone_is_load_bearing", 5: "lifecycle_warrant_discipline_no_add_over_summary", 0: "unclassified_ladder_shape",
}
MODEL = {1: "full_replication", 2: "partial_replication", 5: "reversal", 3: "compression_equivalent", 4: "no_effect", 0: "unclassified"}
COMPRESSED = {"near_A": "compression_of_raw_log_does_not_help", "near_B_or_C": "compression_alone_explains_lift", "below_B": "substrate_transformation_does_meaningful_work", "between": "partial_substrate_contribution"}


def pivoted(rates: DataFrame, arms: tuple[str, ...], by: list[str], arm: str = "arm", rate: str = "rate") -> DataFrame:
    """The arms' rates in points of percent side by side."""
    return rates.groupBy(*by).agg(*(F.max(F.when(F.col(arm) == x, 100 * F.col(rate))).alias(x) for x in arms))


def _first(cases: list[tuple[int, Column]], names: dict[int, str]) -> Column:
    """struct(class, label) of the first case that holds, else of class 0."""
    made = lambda k: F.struct(F.lit(k).alias("class"), F.lit(names[k]).alias("label"))
    return F.coalesce(*(F.when(c, made(k)) for k, c in cases), made(0))


def ladder_class() -> Column:
    """struct(class, label) of the shape of arms A to E (columns, in points of percent)."""
    step = lambda x, y: F.col(x) - F.col(y)
    up, level = lambda x, y: step(x, y) >= EFFECT, lambda x, y: F.abs(step(x, y)) < NOISE
    return _first([
        (6, F.col("A") > F.greatest("B", "C", "D", "E") + EFFECT), (1, up("B", "A") & up("C", "B") & up("D", "C") & up("E", "D")), (2, up("C", "B") & up("D", "C") & up("E", "D") & level("B", "A")),
        (3, level("E", "D") & up("D", "C") & up("C", "B") & up("B", "A")), (4, level("E", "D") & level("D", "C") & up("C", "B") & up("B", "A")), (5, level("E", "B")),
    ], LADDER)


def compressed_class(p: str = "P") -> Column:
    """The label of the arm of compressed raw context (column ``p``) next to A, B and C; null where one is missing."""
    x, near = F.col(p), lambda other: F.abs(F.col(p) - F.col(other)) < NOISE
    known = x.isNotNull() & F.col("A").isNotNull() & F.col("B").isNotNull() & F.col("C").isNotNull()
    label = F.when(near("A"), COMPRESSED["near_A"]).when(near("B") | near("C"), COMPRESSED["near_B_or_C"]).when(x - F.col("B") <= -EFFECT, COMPRESSED["below_B"]).otherwise(COMPRESSED["between"])
    return F.when(known, label)


def model_class(p: str = "P") -> Column:
    """struct(class, label) of one model's arms A, B, C and ``p``; class null and label incomplete where one is missing."""
    over = lambda x, y: F.col(x) - F.col(y) >= EFFECT
    near = lambda x, y: F.abs(F.col(x) - F.col(y)) < NOISE
    b, c = over("B", "A") & over("B", p), over("C", "A") & over("C", p)
    beaten = over("A", "B") | over("A", "C") | over(p, "B") | over(p, "C")
    known = F.col(p).isNotNull() & F.col("A").isNotNull() & F.col("B").isNotNull() & F.col("C").isNotNull()
    found = _first([(1, b & c), (2, b != c), (5, beaten), (3, (near("B", p) | near("C", p)) & over(p, "A")), (4, near("B", "A") & near("C", "A"))], MODEL)
    return F.when(known, found).otherwise(F.struct(F.lit(None).cast("int").alias("class"), F.lit("incomplete").alias("label")))


def across_models(classes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, the counts of the classes and the outcome over all models; classes: class, a row a model."""
    has = lambda k: F.count_if(F.col("class") == k)
    n = F.count("*")
    outcome = (
        F.when(has(5) > 0, "reversal_halt_and_audit").when(has(4) > 0, "thesis_fails_on_at_least_one_model").when(has(3) > 0, "compression_finding_does_not_generalize")
        .when(has(1) == n, "full_cross_model_replication").when((has(1) == n - 1) & (has(2) == 1), "mostly_full_plus_one_partial").otherwise("mixed")
    )
    return classes.groupBy(*(by or [])).agg(n.alias("n"), *(has(k).alias(f"class_{k}") for k in range(6)), outcome.alias("outcome"))


def paired(answers: DataFrame, arms: tuple[str, str]) -> DataFrame:
    """Answers of two arms to the same question side by side."""
    side = lambda a: answers.where(F.col("arm") == a).select("question_id", F.col("answer").alias(f"answer_{a.lower()}"))
    return side(arms[0]).join(side(arms[1]), "question_id")


def quota(candidates: DataFrame, by: list[str], per_stratum: int, session: str, per_session: int, order: Column) -> DataFrame:
    """At most ``per_session`` candidates of a session in a stratum, then ``per_stratum`` of each stratum, in the given order."""
    c = candidates.withColumn("__o", order)
    c = c.withColumn("__s", F.row_number().over(Window.partitionBy(*by, session).orderBy("__o"))).where(F.col("__s") <= per_session)
    c = c.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("__o"))).where(F.col("__r") <= per_stratum)
    return c.drop("__o", "__s", "__r")


def map_remaining(wanted: DataFrame, done: DataFrame, keys: list[str], client, schema: str) -> DataFrame:
    """Calls an injected client (DataFrame batch to DataFrame batch) for what is not done; no client is shipped."""
    return remaining(wanted, done, keys).mapInPandas(lambda frames: (client(f) for f in frames), schema)
