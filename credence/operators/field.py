"""Semantic and expectation fields: densities, drift, dispersion, snapshots, grids and cohorts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector


def vector_sums(rows: DataFrame, by: list[str], vec: str) -> DataFrame:
    """k and the sum of the vectors of each group, one aggregate a dimension."""
    each = rows.select(*by, F.posexplode(vec).alias("d", "x")).groupBy(*by, "d").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count("*").alias("k"))
    return each.groupBy(*by).agg(F.max("k").alias("k"), F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("total"))


def window_totals(units: DataFrame, frames: dict[str, tuple[int, int]], vec: str = "u") -> DataFrame:
    """By actor and day with an event: for each name k_<name> and the sum of vectors <name> (null if empty) of its events from day + low to
    day + high, for frames name: (low, high).

    Events are summed by actor, day and dimension first, whatever the number and length of the windows; these are range
    frames over one partitioning."""
    day = F.unix_date("date").alias("d")
    daily = units.select("actor", day, F.posexplode(vec).alias("i", "x")).groupBy("actor", "d", "i").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count("*").alias("k"))
    each = Window.partitionBy("actor", "i").orderBy("d")
    over = daily.withColumns({f"{c}_{n}": F.sum(c).over(each.rangeBetween(*f)) for n, f in frames.items() for c in ("x", "k")})
    joined = lambda n: F.array_sort(F.collect_list(F.when(F.col(f"x_{n}").isNotNull(), F.struct("i", F.col(f"x_{n}").alias("x")))))
    out = over.groupBy("actor", "d").agg(*(c for n in frames for c in (F.max(f"k_{n}").alias(f"k_{n}"), joined(n).alias(n))))
    return out.select("actor", F.date_from_unix_date("d").alias("day"), *(c for n in frames for c in (f"k_{n}", F.when(F.size(n) > 0, F.transform(n, lambda s: s["x"])).alias(n))))


def dispersion_and_drift(events: DataFrame, days: int = 7, back: int = 7) -> DataFrame:
    """By actor and day: n, dispersion (1 - mean cosine between the window's members, by the closed form of unit vectors)
    and drift (1 - cosine with the centroid of the actor's window ``back`` days earlier, null if that is empty). events: actor,
    date, embedding."""
    units = events.withColumn("u", vector.unit(F.col("embedding"))).where(vector.norm(F.col("embedding")) > 0)
    sums = window_totals(units, {"now": (-days, 0), "before": (-days - back, -back)})
    k = F.col("k_now")
    mean = F.when(k > 1, (vector.dot(F.col("now"), F.col("now")) - k) / (k * (k - 1)))
    return sums.select("actor", "day", k.alias("n"), (1 - mean).alias("dispersion"), F.when(F.col("before").isNotNull(), 1 - vector.cosine(F.col("now"), F.col("before"))).alias("drift"))


def neighbour_actors(totals: DataFrame, name: str, top: int = 3) -> DataFrame:
    """The ``top`` other actors whose window centroids of a day are closest to an actor's; totals: as ``window_totals`` gives them.

    Centroids meet by day, so the pairs are those of the actors that have events on a day."""
    a = totals.select("day", "actor", F.col(name).alias("u"))
    pairs = a.join(a.select("day", F.col("actor").alias("other"), F.col("u").alias("v")), "day").where("actor <> other")
    w = Window.partitionBy("day", "actor").orderBy(F.desc("sim"), "other")
    ranked = pairs.withColumn("sim", vector.cosine(F.col("u"), F.col("v"))).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= top).select("actor", "day", F.col("rank").cast("long").alias("rank"), "other", "sim")


def member_centroids(storms: DataFrame, embeddings: DataFrame) -> DataFrame:
    """storm_id, the number of members with an embedding and their mean embedding (null where there is none).

    storms: storm_id, event_ids (array); embeddings: event_id, embedding."""
    members = storms.select("storm_id", F.explode("event_ids").alias("event_id"))
    sums = vector_sums(members.join(embeddings, "event_id"), ["storm_id"], "embedding")
    out = storms.select("storm_id").join(sums, "storm_id", "left")
    return out.select("storm_id", F.coalesce("k", F.lit(0)).alias("n"), F.transform("total", lambda x: x / F.col("k")).alias("centroid"))


#: Events that a task holds while those of their windows pass by, events from which on a slot is cut, its least cuts then, and similarities held at once.
BLOCK, SMALL, CUTS, CELLS = 16_384, 512, 8, 1 << 21


def _compared(days: int, least: float):
    """Sums of similarities of the rows (slot, block, side, d, actor, u, w): those of side 0 are held and compared with those of side 1."""

    def run(batches):
        now, held, own = None, [], None
        for batch in batches:
            slot, block, side, d, w = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3, 6))
            u = batch.column(5)
            vectors = u.flatten().to_numpy(zero_copy_only=False).reshape(len(u), -1)
            actor = batch.column(4).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.diff(slot) | np.diff(block) | np.diff(side) | np.diff(d)) + 1
            out = []
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows]):
                if (slot[a], block[a]) != now:
                    now, held, own = (slot[a], block[a]), [], None
                if side[a] == 0:
                    held.append((d[a:b].copy(), actor[a:b].copy(), vectors[a:b].copy()))
                elif held:
                    if own is None:
                        own = tuple(map(np.concatenate, zip(*held)))  # sorted by day and actor
                    lo, hi = np.searchsorted(own[0], [d[a] - days, d[a] + days + 1])
                    if lo < hi:
                        out += _sums(own[0][lo:hi], own[1][lo:hi], own[2][lo:hi], actor[a:b], vectors[a:b], w[a:b], int(d[a]), least)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in map(np.concatenate, zip(*out))], names=["actor", "d", "e", "s", "ws"])

    return run


def _sums(d, actor, u, others, v, w, e: int, least: float):
    """(actor, d, e, s, ws) of some events' similarities above ``least`` to other actors' events of the day ``e``."""
    head = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (actor[1:] != actor[:-1]))))
    step = max(1, CELLS // len(d))
    s, ws = np.zeros(len(d)), np.zeros(len(d))
    for k in range(0, len(others), step):
        sim = u @ v[k : k + step].T
        sim *= (sim > least) & (actor[:, None] != others[None, k : k + step])
        s += sim.sum(axis=1)
        ws += sim @ w[k : k + step]
    return [(actor[head], d[head], np.full(len(head), e, d.dtype), np.add.reduceat(s, head), np.add.reduceat(ws, head))]


def similar_sums(units: DataFrame, days: int, least: float) -> DataFrame:
    """By actor, its day d and a day e at most ``days`` away: s, the sum of the similarities above ``least`` of its events of d to other
    actors' events of e, and ws, that weighted by theirs. units: actor, d, u (of one length), w.

    Events lie in slots of days + 1 days, and a slot's in blocks of about BLOCK by their hash. A task holds one block, and the
    events of its slot and the two beside it pass by day by day, compared by matrix products; so a task's memory is bounded
    and events are copied once a block, not once a pair."""
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = units.schema["actor"].dataType.simpleString()
    rows = units.where("actor is not null").withColumn("slot", F.floor(F.col("d") / (days + 1)))
    n = F.count("*")
    cuts = rows.groupBy("slot").agg(F.greatest(F.ceil(n / BLOCK), F.least(F.lit(CUTS), F.ceil(n / SMALL))).cast("int").alias("cuts"))  # a row a slot
    plain = lambda slot, block, side: (slot.alias("slot"), block.cast("int").alias("block"), F.lit(side).alias("side"), F.col("d"), F.col("actor"), F.col("u"), F.col("w"))
    own = rows.join(F.broadcast(cuts), "slot").select(*plain(F.col("slot"), F.pmod(F.xxhash64("d", "u", "actor"), F.col("cuts")), 0))
    near = rows.withColumn("slot", F.explode(F.array(*(F.col("slot") + k for k in (-1, 0, 1))))).join(F.broadcast(cuts), "slot")
    field = near.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select(*plain(F.col("slot"), F.col("block"), 1))
    every = own.unionByName(field).repartition(parts, "slot", "block").sortWithinPartitions("slot", "block", "side", "d", "actor")
    return every.mapInArrow(_compared(days, least), f"actor {kind}, d int, e int, s double, ws double")


def density(events: DataFrame, days: int = 7, least: float = 0.3, weight: str | None = None) -> DataFrame:
    """By actor and day with an event: n, the density and, with a weight column, the weighted density.

    The density of an event is the sum of its similarities above ``least`` to other actors' events of the window, over the size
    of the whole field of the window; an actor's is the mean over its events of the window. Two events are compared once,
    not once a day: they stand together in the windows of the days from the later one to ``days`` after the earlier one, so
    their similarity is added at the first of these days and taken off after the last, and running sums give each day's."""
    unit = events.withColumn("u", vector.unit(F.col("embedding"))).where(vector.norm(F.col("embedding")) > 0)
    units = unit.select("actor", F.unix_date("date").alias("d"), "u", (F.lit(0.0) if weight is None else F.greatest(F.col(weight).cast("double"), F.lit(0.0))).alias("w"))
    pairs = similar_sums(units, days, least)
    both = pairs.groupBy("actor", F.greatest("d", "e").alias("first"), (F.least("d", "e") + days).alias("last")).agg(F.sum("s").alias("s"), F.sum("ws").alias("ws"))
    ends = F.explode(F.array(F.struct(F.col("first").alias("d"), F.col("s"), F.col("ws")), F.struct((F.col("last") + 1).alias("d"), (-F.col("s")).alias("s"), (-F.col("ws")).alias("ws"))))
    changes = both.select("actor", ends.alias("x")).select("actor", "x.*")
    own_days = units.groupBy("actor", "d").agg(F.count("*").alias("k"))
    w = Window.partitionBy("actor").orderBy("d")
    run = lambda c, frame: F.sum(c).over(frame)
    till_now, inside = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(-days, 0)
    rows = own_days.unionByName(changes, allowMissingColumns=True).select("actor", "d", F.col("k").isNotNull().alias("own"), run("k", inside).alias("n"), run("s", till_now).alias("s"), run("ws", till_now).alias("ws")).where("own")
    sizes = units.groupBy("d").agg(F.count("*").alias("m"))
    sizes = sizes.select("d", F.sum("m").over(Window.partitionBy(F.lit(1)).orderBy("d").rangeBetween(-days, 0)).alias("m"))  # one row a day
    value = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / F.col("n") / F.col("m")
    out = rows.join(F.broadcast(sizes), "d").select("actor", F.date_from_unix_date("d").alias("day"), "n", value("s").alias("density"), value("ws").alias("weighted"))
    return out if weight is not None else out.drop("weighted")


def novelty(events: DataFrame, days: int = 30) -> DataFrame:
    """By actor and day: 1 - cosine between the day's centroid and that of the window before it."""
    sums = window_totals(events.withColumn("u", vector.unit(F.col("embedding"))), {"now": (0, 0), "then": (-days, -1)})
    return sums.select("actor", "day", (1 - vector.cosine(F.col("now"), F.col("then"))).alias("novelty"))


def neighbours(points: DataFrame, groups: DataFrame, key: str, top: int = 3) -> DataFrame:
    """The ``top`` most similar points of each group's centroid; groups: id, centroid (few)."""
    pairs = points.crossJoin(F.broadcast(groups)).withColumn("sim", vector.cosine(F.col("embedding"), F.col("centroid")))
    w = Window.partitionBy("id").orderBy(F.desc("sim"), key)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("id", "rank", key, "sim")


def momentum(rows: DataFrame, value: str, lag: int = 7) -> DataFrame:
    """Difference to the row ``lag`` positions before in each actor's series, 0 where there is none."""
    return rows.withColumn("momentum", F.coalesce(F.col(value) - F.lag(value, lag).over(Window.partitionBy("actor").orderBy("day")), F.lit(0)))


def top_tokens(texts: DataFrame, by: str, order: str, top: int = 3, pattern: str = "[a-z]{3,}") -> DataFrame:
    """The most frequent tokens of each group; ties by first seen (order, position)."""
    t = texts.select(by, order, F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("p", "token"))
    n = t.groupBy(by, "token").agg(F.count("*").alias("n"), F.min(F.struct(order, "p")).alias("first"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), "first")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(by, "rank", "token", "n")


def snapshot(rows: DataFrame) -> DataFrame:
    """By day: active expectations, births, retirements, share statistics and concentration.

    rows: as_of, expectation_id, kind, ticker, event, days_alive, share."""
    kinds = rows.groupBy("as_of", "kind").agg(F.count("*").alias("n"))
    hhi = kinds.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("as_of"))).groupBy("as_of").agg(F.sum(F.col("p") * F.col("p")).alias("hhi"))
    base = rows.groupBy("as_of").agg(
        F.count("*").alias("n_active"),
        F.count_distinct("ticker").alias("n_tickers"),
        F.count_if(F.col("days_alive") == 0).alias("n_born"),
        F.count_if(F.col("event") == "retired").alias("n_retired"),
        F.avg("share").alias("share_mean"),
        F.min("share").alias("share_min"),
        F.max("share").alias("share_max"),
    )
    return base.join(hhi, "as_of")


def set_change(rows: DataFrame, day: str = "as_of", member: str = "expectation_id") -> DataFrame:
    """By day: the Jaccard distance of its set of members to the set of the day before in the series.

    A member is there on a day once; each day's members are joined with their own next day, so no day's set is gathered."""
    days = rows.select(day).distinct().withColumn("next", F.lead(day).over(Window.partitionBy(F.lit(1)).orderBy(day)))
    at = rows.select(day, member).distinct()
    size = at.groupBy(day).agg(F.count("*").alias("n"))
    both = at.join(F.broadcast(days), day).select(F.col("next").alias(day), member).join(at, [day, member]).groupBy(day).agg(F.count("*").alias("both"))
    chain = days.join(size, day).select(F.col("next").alias(day), F.col("n").alias("n_before"))
    out = size.join(chain, day, "left").join(both, day, "left").withColumn("both", F.coalesce("both", F.lit(0)))
    return out.select(day, "n", F.when(F.col("n_before").isNotNull(), 1 - F.col("both") / (F.col("n") + F.col("n_before") - F.col("both"))).alias("drift"))


def field_events(metrics: DataFrame, lag: int = 5) -> DataFrame:
    """Named events of a daily series (as_of, breadth, hhi, stress, churn, drift), compared with ``lag`` rows before."""
    w = Window.partitionBy(F.lit(1)).orderBy("as_of")
    m = metrics.withColumns({"d_breadth": F.col("breadth") - F.lag("breadth", lag).over(w), "d_hhi": F.col("hhi") - F.lag("hhi", lag).over(w)})
    names = F.array(
        F.when(F.col("d_breadth") <= -2, "narrowing"),
        F.when(F.col("d_hhi") <= -0.15, "fragmenting"),
        F.when(F.col("d_hhi") >= 0.15, "consolidating"),
        F.when(F.col("stress") >= 0.5, "stressing"),
        F.when(F.col("churn") >= 3, "churning"),
        F.when(F.col("drift") >= 0.5, "drifting"),
    )
    return m.select("as_of", F.explode(F.array_compact(names)).alias("event"))


def binned(x: Column, edges: list[float]) -> Column:
    out = F.lit(None).cast("int")
    for k in reversed(range(len(edges) - 1)):
        out = F.when((x >= edges[k]) & (x < edges[k + 1]), k).otherwise(out)
    return out


def grid(rows: DataFrame) -> DataFrame:
    """By day and cell of the 3 x 3 grid (direction, breadth): occupants, mean share, births and retirements; empty cells are
    there with zeros. rows: as_of, expectation_id, direction, breadth, share, days_alive, event."""
    placed = rows.withColumns({"x": binned(F.col("direction"), [-1.01, -0.2, 0.2, 1.01]), "y": binned(F.col("breadth"), [1, 4, 8, 101])})
    cells = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda a: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda b: F.struct(a.alias("x"), b.alias("y"))))))
    spine = rows.select("as_of").distinct().withColumn("c", cells).select("as_of", "c.x", "c.y")
    agg = placed.groupBy("as_of", "x", "y").agg(F.count("*").alias("density"), F.avg(1 - F.col("share")).alias("pressure"), F.count_if(F.col("days_alive") == 0).alias("born"), F.count_if(F.col("event") == "retired").alias("retired"))
    zero = F.lit(0).cast("long")
    return spine.join(agg, ["as_of", "x", "y"], "left").select("as_of", "x", "y", *(F.coalesce(c, zero).alias(c) for c in ("density", "born", "retired")), "pressure")


def grid_summary(daily: DataFrame) -> DataFrame:
    """By cell: mean density over all days, mean pressure over occupied days."""
    return daily.groupBy("x", "y").agg(F.avg("density").alias("density"), F.avg(F.when(F.col("density") > 0, F.col("pressure"))).alias("pressure"), F.sum("born").alias("born"), F.sum("retired").alias("retired"))


def parent_flux(rows: DataFrame) -> DataFrame:
    """By day and cell: births whose parent claims another cell that day come in (flux_in), and out of the parent's cell
    (flux_out). rows: as_of, expectation_id, parent_id, direction, breadth."""
    x, y = binned(F.col("direction"), [-1.01, -0.2, 0.2, 1.01]), binned(F.col("breadth"), [1, 4, 8, 101])
    placed = rows.select("as_of", "expectation_id", "parent_id", x.alias("x"), y.alias("y")).where("x is not null and y is not null")
    first = placed.groupBy("expectation_id").agg(F.min("as_of").alias("as_of"))
    born = placed.join(first, ["expectation_id", "as_of"]).where("parent_id is not null")
    parent = placed.select("as_of", F.col("expectation_id").alias("parent_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    moved = born.join(parent, ["as_of", "parent_id"]).where("x <> px or y <> py")
    ends = F.explode(F.array(F.struct("x", "y", F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("px").alias("x"), F.col("py").alias("y"), F.lit(0).alias("i"), F.lit(1).alias("o"))))
    return moved.select("as_of", ends.alias("e")).groupBy("as_of", "e.x", "e.y").agg(F.sum("e.i").alias("flux_in"), F.sum("e.o").alias("flux_out"))


def mortality(rows: DataFrame, days: int = 7) -> DataFrame:
    """By day: the number of retirements on it and on the ``days`` days before, and their rate to the mean number of rows of these days; rows:
    as_of, event."""
    daily = rows.groupBy("as_of").agg(F.count_if(F.col("event").isin("retired", "died")).alias("gone"), F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.unix_date("as_of")).rangeBetween(-days, 0)  # one row a day
    return daily.select("as_of", F.sum("gone").over(w).alias("mortality"), (F.sum("gone").over(w) / F.avg("n").over(w)).alias("rate"))


#: Statuses in which an expectation stands in the field.
STANDING = ("active", "weakening")


def age_bucket(days: Column) -> Column:
    """The ages by which expectations are counted."""
    return F.when(days <= 7, "0_7d").when(days <= 30, "8_30d").otherwise("31_plus")


def snapshot_counts(rows: DataFrame) -> DataFrame:
    """By day: the number of standing expectations of each kind, family, status and age, as (as_of, of, value, n)."""
    of = F.explode(F.array(*(F.struct(F.lit(name).alias("of"), F.coalesce(c.cast("string"), F.lit(none)).alias("value")) for name, c, none in (
        ("kind", F.col("kind"), "unknown"), ("family", F.col("family"), "?"), ("status", F.col("status"), "unknown"), ("age", age_bucket(F.col("days_alive")), "?")))))
    return rows.where(F.col("status").isin(*STANDING)).select("as_of", of.alias("x")).groupBy("as_of", "x.of", "x.value").agg(F.count("*").alias("n"))


def scope_metrics(rows: DataFrame, days: int = 7) -> DataFrame:
    """By day: breadth, concentration of families, alignment (mean share), refinement (share of children), stress (share of
    weakening ones), mortality (deaths of the day and the ``days`` before) and drift of the standing set.

    rows: as_of, expectation_id, parent_id, family, status, event, share; deaths count whatever the status."""
    standing = rows.where(F.col("status").isin(*STANDING))
    n = F.count("*")
    base = standing.groupBy("as_of").agg(n.alias("breadth"), F.avg("share").alias("alignment"), (F.count("parent_id") / n).alias("refinement"), (F.count_if(F.col("status") == "weakening") / n).alias("stress"))
    sizes = standing.groupBy("as_of", "family").agg(n.alias("k"))
    hhi = sizes.withColumn("p", F.col("k") / F.sum("k").over(Window.partitionBy("as_of"))).groupBy("as_of").agg(F.sum(F.col("p") * F.col("p")).alias("concentration"))
    return base.join(hhi, "as_of").join(mortality(rows, days).drop("rate"), "as_of").join(set_change(standing).select("as_of", "drift"), "as_of", "left")


def claims(rows: DataFrame) -> DataFrame:
    """Standing rows with the cell (x, y) that the expectation claimed at birth, kept for life, and whether it is born that day.

    rows: as_of, expectation_id, parent_id, status, event, direction, breadth (one a day of an expectation)."""
    life = Window.partitionBy("expectation_id")
    first = F.min_by(F.struct("as_of", "direction", "breadth"), "as_of").over(life)
    placed = rows.where(F.col("status").isin(*STANDING)).withColumn("f", first)
    return placed.select("as_of", "expectation_id", "parent_id", "status", binned(F.col("f.direction"), [-1.01, -0.2, 0.2, 1.01]).alias("x"), binned(F.col("f.breadth"), [1, 4, 8, 101]).alias("y"), (F.col("as_of") == F.col("f.as_of")).alias("born"))


def claim_grid(rows: DataFrame) -> DataFrame:
    """By day and cell, empty ones included: density, weakening, pressure (share of weakening), born, retired, flux_in and flux_out
    (births whose parent claims another cell). Deaths count for the cell that was claimed, on days on which the field stands."""
    placed = claims(rows)
    homes = placed.where("born").select("expectation_id", F.col("as_of").alias("birth"), "x", "y")
    died = rows.where("event = 'died'").select("as_of", "expectation_id").distinct().join(homes, "expectation_id").where("birth <= as_of").select("as_of", "x", "y", F.lit("retired").alias("what"))
    parents = homes.select(F.col("expectation_id").alias("parent_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    moved = placed.where("born and parent_id is not null").join(parents, "parent_id").where("x <> px or y <> py")
    flux = moved.select("as_of", F.explode(F.array(F.struct("x", "y", F.lit("flux_in").alias("what")), F.struct(F.col("px").alias("x"), F.col("py").alias("y"), F.lit("flux_out").alias("what")))).alias("e")).select("as_of", "e.x", "e.y", "e.what")
    kinds = F.array_compact(F.array(F.lit("density"), F.when(F.col("status") == "weakening", "weakening"), F.when(F.col("born"), "born")))
    each = placed.select("as_of", "x", "y", F.explode(kinds).alias("what")).unionByName(died).unionByName(flux)
    names = ("density", "weakening", "born", "retired", "flux_in", "flux_out")
    counts = each.groupBy("as_of", "x", "y").agg(*(F.count_if(F.col("what") == c).alias(c) for c in names))
    ends = F.sequence(F.lit(0), F.lit(2))
    spine = placed.select("as_of").distinct().select("as_of", F.explode(ends).alias("x")).select("as_of", "x", F.explode(ends).alias("y"))
    out = spine.join(counts, ["as_of", "x", "y"], "left").na.fill(0, names)
    return out.withColumn("pressure", F.coalesce(F.try_divide(F.col("weakening"), F.col("density")), F.lit(0.0)))


def claim_summary(daily: DataFrame) -> DataFrame:
    """By cell: mean density over all days, days occupied, mean pressure when occupied, and totals."""
    total = lambda c: F.sum(c).alias(c)
    return daily.groupBy("x", "y").agg(F.avg("density").alias("density"), F.count_if(F.col("density") > 0).alias("days_occupied"), F.coalesce(F.avg(F.when(F.col("density") > 0, F.col("pressure"))), F.lit(0.0)).alias("pressure"), *map(total, ("born", "retired", "flux_in", "flux_out")))


def occupants(rows: DataFrame) -> DataFrame:
    """Who stood in which cell: days_in_cell, stays (runs of days of the field without a gap), the longest of them, born_at, last status and outcome (retired if it ever
    died, else weakening or durable)."""
    placed = claims(rows)
    days = placed.select("as_of").distinct().select("as_of", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("as_of")).alias("day"))  # one row a day
    order = Window.partitionBy("expectation_id", "x", "y").orderBy("as_of")
    runs = placed.join(F.broadcast(days), "as_of").withColumn("run", F.col("day") - F.row_number().over(order))
    by_run = runs.groupBy("expectation_id", "x", "y", "run").agg(F.count("*").alias("n"), F.max(F.struct("as_of", "status")).alias("last"), F.min("as_of").alias("first"))
    each = by_run.groupBy("expectation_id", "x", "y").agg(F.sum("n").alias("days_in_cell"), F.count("*").alias("stays"), F.max("n").alias("longest"), F.min("first").alias("born_at"), F.max("last")["status"].alias("last_status"))
    died = rows.where("event = 'died'").select("expectation_id", F.lit(True).alias("died")).distinct()
    outcome = F.when(F.col("died"), "retired").when(F.col("last_status") == "weakening", "weakening").otherwise("durable")
    return each.join(died, "expectation_id", "left").withColumn("outcome", outcome).drop("died")


#: Limits of cohort reading, and the points of a question's pressure.
GROUP, FRAGMENTED, COHERENT, EMERGING, REPEATING = 3, 0.33, 0.66, 0.5, 0.66
POINTS = {"transitions": 10, "emerging": 15, "tension": 10}


def cohort_groups(members: DataFrame) -> DataFrame:
    """The classes of a question's members of at least GROUP: question_id, state_class, n, members (sorted), n_same (in it before
    too), n_known, and how it reads: emerging, repeating or neither. members: question_id, actor, state_class, prior_class."""
    same = F.col("prior_class") == F.col("state_class")
    g = members.where("state_class is not null").groupBy("question_id", "state_class").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("actor")).alias("members"), F.count_if(same).alias("n_same"), F.count("prior_class").alias("n_known"))
    any_known = F.max("n_known").over(Window.partitionBy("question_id")) > 0
    share = F.col("n_same") / F.col("n")
    reads = F.when(~any_known, None).when(share < EMERGING, "emerging").when(share >= REPEATING, "repeating")
    return g.withColumn("reads", reads).where(F.col("n") >= GROUP)


def cohort_state(cohorts: DataFrame, snapshot: DataFrame, prior: DataFrame, tension: list[str]) -> DataFrame:
    """Each question's cohort as a whole: members seen and missing, classes, dominant class with its share, cohesion in words,
    transitions, pressure and triggers. cohorts: question_id, cohort (array); snapshot: actor, state_class; prior: actor,
    prior_class. A cohort is a list of a question, so its members are few."""
    each = cohorts.select("question_id", F.explode(F.array_distinct("cohort")).alias("actor"))
    seen = each.join(snapshot, "actor").join(prior, "actor", "left")
    groups = cohort_groups(seen).groupBy("question_id").agg(
        F.count("*").alias("n_groups"), F.count_if(F.col("reads") == "emerging").alias("n_emerging"), F.count_if(F.col("reads") == "repeating").alias("n_repeating"), F.count_if(F.col("state_class").isin(*tension)).alias("n_tension"),
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "state_class"))).alias("g"),
    )
    sizes = seen.where("state_class is not null").groupBy("question_id", "state_class").agg(F.count("*").alias("n"))
    classes = sizes.groupBy("question_id").agg(F.count("*").alias("n_classes"), F.sum("n").alias("classified"), F.max("n").alias("top"), F.count_if(F.col("n") >= 2).alias("n_pairs"), F.min_by("state_class", F.struct(-F.col("n"), "state_class")).alias("dominant"))
    actors = seen.groupBy("question_id").agg(F.array_sort(F.collect_list("actor")).alias("in_snapshot"), F.count_if(F.col("state_class") != F.col("prior_class")).alias("transitions"))
    out = cohorts.join(actors, "question_id", "left").join(classes, "question_id", "left").join(groups, "question_id", "left")
    none, zero = F.expr("cast(array() as array<string>)"), F.lit(0).cast("long")
    out = out.withColumns({c: F.coalesce(c, zero) for c in ("n_classes", "n_pairs", "transitions", "n_groups", "n_emerging", "n_repeating", "n_tension")}).withColumn("in_snapshot", F.coalesce("in_snapshot", none))
    share = F.coalesce(F.col("top") / F.col("classified"), F.lit(0.0))
    name = lambda i: F.get("g", F.lit(i))["state_class"]
    # fixed values: how cohesion is worded
    words = (
        F.when(F.col("n_classes") == 0, "no cohort members found in current snapshot").when(share >= COHERENT, "cohort behaving as one coherent class")
        .when(share <= FRAGMENTED, F.format_string("cohort fragmented across %d distinct read classes", F.col("n_classes")))
        .when(F.col("n_groups") >= 2, F.concat(F.lit("cohort no longer one coherent class \u2014 "), name(0), F.lit(" and "), name(1), F.lit(" both visible"))).otherwise("cohort mixed; no single dominant pattern")
    )
    pressure = F.least(F.lit(100), POINTS["transitions"] * F.col("transitions") + POINTS["emerging"] * F.col("n_emerging") + POINTS["tension"] * F.col("n_tension"))
    return out.select(
        "question_id", "in_snapshot", F.array_sort(F.array_except("cohort", "in_snapshot")).alias("missing"), "n_classes", "dominant", F.round(share, 3).alias("share"), (share <= FRAGMENTED).alias("is_fragmented"), words.alias("cohesion"),
        "transitions", "n_emerging", "n_repeating", "n_tension", pressure.cast("long").alias("pressure"), (F.col("n_groups") >= 2).alias("split_ready"), ((share <= FRAGMENTED) & (F.col("n_pairs") >= 3) & (F.size("in_snapshot") >= 6)).alias("too_broad"),
    )


def short_words(text: Column, most: int = 130) -> Column:
    """A text in one line of at most ``most`` characters, cut before a word, with an ellipsis."""
    flat = F.trim(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, most - 1), r" [^ ]*$", ""), F.lit("\u2026")))


def cohort_split(states: DataFrame) -> DataFrame:
    """By question: members, shares of the state classes, the dominant class, cohesion (its share) and how it reads."""
    n = states.groupBy("question_id", "state_class").agg(F.count("*").alias("n"))
    w = Window.partitionBy("question_id")
    n = n.withColumns({"total": F.sum("n").over(w), "rank": F.row_number().over(w.orderBy(F.desc("n"), "state_class"))}).withColumn("share", F.col("n") / F.col("total"))
    top = n.groupBy("question_id").agg(F.max("total").alias("members"), F.count("*").alias("classes"), F.max(F.when(F.col("rank") == 1, F.col("state_class"))).alias("dominant"), F.max("share").alias("cohesion"))
    read = F.when(F.col("cohesion") >= 0.66, "coherent").when(F.col("cohesion") <= 0.33, "fragmented").otherwise("mixed")
    return top.withColumn("reads", read)


def lookback_state(rows: DataFrame, back: int = 5) -> DataFrame:
    """Each actor's state ``back`` rows before its last one, or its first where there are fewer; rows: actor, day, state."""
    w = Window.partitionBy("actor")
    r = rows.withColumn("r", F.row_number().over(w.orderBy(F.desc("day"))))
    return r.where(F.col("r") <= back + 1).groupBy("actor").agg(F.max_by("state", "r").alias("state"), F.max_by("day", "r").alias("day"))


def births(rows: DataFrame) -> DataFrame:
    """The first row of each expectation."""
    return rows.groupBy("expectation_id").agg(F.min("as_of").alias("born"))
