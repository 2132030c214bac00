"""N-gram Jaccard join by set-relation skipping.

A document's set has the distinct shingles of ``k`` words (the whole sequence where there are fewer). Two sets link if
100 * intersection >= percent * union. The result is each document's component under these links.

* Index level. Hash order gives all shingles a global position. For sets of up to s shingles, a link leaves at most
  d = floor(2 s (100 - percent) / (100 + percent)) shingles that are in one set only, so if the positions are cut into
  more than d blocks, linked sets agree on all but d whole blocks. The index has a list for each block content, by size
  class; a set is in the lists of its d + 1 fullest blocks, d being what its own links can leave, so that a shingle or two
  that unrelated texts share seldom tie them; a probe reads these lists and skips all others. Sets that could cross to the next size
  class are entered there too. Shingles that are frequent in a bounded sample are left out of the blocks where a set has
  enough others, so that common lines do not tie unrelated texts. A list is only ever streamed: each member is tied to the
  list's first one, inside a task before the shuffle and across tasks after it, so a list that a third of all sets are in
  sends one row a task.
* Answer level. Equal sets are one node and share all answers. The ties give candidate families, which no link leaves.
  Each set is first compared with its pivot, the set it shares most lists with, whose answer is known before its own: if
  they link, it takes over the pivot's answer (its component). A family that pivots join into one component is done, and
  all its other pairs are skipped. The other families are compared in blocks of bounded size, by size class, starting from
  the links with pivots; a pair is skipped when its members are already in one component, when their sizes are too far
  apart or when more position blocks differ than a link allows; the rest are intersected.

Words are hashed modulo two primes with their length, shingles, sets and blocks by 64-bit mixes of these. Defined cases: a
document without words, or with null text, has an empty set and links with nothing; rows with equal doc_ids and different
texts are separate rows that share an id; rows with a null doc_id are linked like others and count last in a component's
smallest id, which is null if there is no other; an empty table gives an empty result; very long texts are sets like
others; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

_SPACE = common.space_table()
FAMILY, ELEMENTS = 1500, 1_500_000  # sets and shingles that one task compares with each other
RATIO = 1.5
#: Frequent shingles: the text bytes they are looked for in, in how many of its documents one is, and how many are kept at most.
SAMPLE_BYTES, OFTEN, MOST_FREQUENT = 64 << 20, 4, 200_000
#: List entries that a task holds before it ties those of equal lists.
ENTRIES = 1_000_000
#: Task entries of open families that are broadcast at most (some ten MB); more are joined by a shuffle.
MOST_BROADCAST = 100_000
LEAST = -(1 << 63)


def class_bounds(most: int = 1 << 31) -> np.ndarray:
    b = [1]
    while b[-1] < most:
        b.append(max(b[-1] + 1, int(b[-1] * RATIO)))
    return np.array(b, np.int64)


_BOUNDS = class_bounds()


def differing(total: int, percent: int) -> int:
    """Most shingles in one set only, for two linked sets with ``total`` shingles together."""
    return total * (100 - percent) // (100 + percent)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one row after the other, and the rows' bounds."""
    data = common.lower_ascii(data)
    starts, ends, first = common.words(data, offsets, _SPACE)
    h = common.span_hash(common.prefix_hash(data), starts, ends)
    n = np.diff(first)
    rows = len(n)
    s = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        s = common.mix(s * np.uint64(7) + h[j : j + len(s)])
    begin = np.arange(len(s))
    row = np.searchsorted(first, begin, side="right") - 1
    inside = begin + k <= first[row + 1] if len(s) else np.zeros(0, bool)
    s, row = s[inside], row[inside]
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        whole = np.full(len(few), 11, np.uint64)
        for j in range(k - 1):
            has = n[few] > j
            whole[has] = common.mix(whole[has] * np.uint64(13) + h[first[few[has]] + j])
        s, row = np.concatenate((s, whole)), np.concatenate((row, few))
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    s, row = s[new], row[new]
    return s, np.searchsorted(row, np.arange(rows + 1))


def set_hashes(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(common.mix(s ^ np.uint64(0x1234567)))))
    return common.mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def block_edges(s: np.ndarray, count: int) -> np.ndarray:
    part = ((s >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    return np.searchsorted(part, np.arange(count + 1, dtype=np.uint64))


def block_sums(s: np.ndarray, count: int) -> np.ndarray:
    """One set's content hash for each of ``count`` position blocks."""
    edge = block_edges(s, count)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(common.mix(s))))
    return total[edge[1:]] - total[edge[:-1]]


def block_count(c: int, percent: int) -> tuple[int, int]:
    """Blocks of size class c, and how many of them may differ: so many more than d + 1 that a set seldom has as many
    empty blocks as must agree."""
    d = differing(2 * int(_BOUNDS[c + 1] - 1), percent)
    empty = (d + 1) * float(np.exp(-int(_BOUNDS[c]) * percent / 100 / (d + 1)))
    return d + 4 + int(empty + 3 * empty**0.5), d


def index_keys(s: np.ndarray, percent: int, frequent: np.ndarray | None = None) -> np.ndarray:
    """The lists that a set is entered in.

    Blocks are made of the shingles that are not ``frequent`` (sorted); linked sets agree on all but d of them too, where d
    is what a link of this set within the class can leave. A set with more than d filled blocks agrees on a filled one with
    any linked set. In the order of their shingles (most first) and keys, which is one order for all sets, at most d of
    either set's blocks stand before the first on which they agree, so the first d + 1 alone get lists: those that unrelated
    sets least agree on. Sets with fewer are entered in the lists of all filled blocks and of blocks of all shingles as
    well, by the same rule, and of empty blocks if need be. What counts as frequent changes the work, never the links."""
    n, out = len(s), []
    own = int(np.searchsorted(_BOUNDS, n, side="right")) - 1
    classes = [own, own + 1] if 100 * n >= percent * int(_BOUNDS[own + 1]) else [own]
    rare = s
    if frequent is not None and len(frequent):
        rare = s[frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] != s]
    for c in classes:
        count, _ = block_count(c, percent)
        d = differing(n + min(n * 100 // percent, int(_BOUNDS[c + 1]) - 1), percent)
        place = np.arange(count, dtype=np.uint64)
        for part, salt in ((rare, 2 * c), (s, 2 * c + 1)):
            held = np.diff(block_edges(part, count))
            keys = common.mix(common.mix(block_sums(part, count) + common.mix(np.array([salt * 1_000_003 + 17], np.uint64))[0]) + place)
            filled = np.flatnonzero(held)
            enough = len(filled) > d
            if enough:
                filled = filled[np.lexsort((keys[filled], -held[filled]))[: d + 1]]
            out.append(keys[filled] if enough or part is rare and rare is not s else keys)
            if enough or rare is s:
                break
    return np.concatenate(out)


def _shingles(k: int):
    def run(batches):
        for batch in batches:
            data, offsets = common.buffers(batch.column(0))
            for a, b in common.slices(offsets):
                s, _ = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], names=["s"])

    return run


def frequent_shingles(rows: DataFrame, n_bytes: int, k: int) -> np.ndarray:
    """The most frequent shingles (at most MOST_FREQUENT) of those in OFTEN or more distinct texts of a sample, sorted.

    The sample has about SAMPLE_BYTES of text, by the texts' hashes. It changes the work, never the links."""
    share = min(1.0, SAMPLE_BYTES / max(1, n_bytes))
    some = rows.where(F.pmod(F.xxhash64("uid"), F.lit(1_000_000)) < int(share * 1_000_000)).select("uid", "text").dropDuplicates(["uid"]).select("text")
    counts = some.mapInArrow(_shingles(k), "s long").groupBy("s").count().where(F.col("count") >= OFTEN)
    most = counts.orderBy(F.desc("count"), "s").limit(MOST_FREQUENT).select("s").toPandas()
    return np.sort(most["s"].to_numpy(np.int64).view(np.uint64))


def _nodes(k: int):
    """Each document's set by its hash."""

    def run(batches):
        for batch in batches:
            data, offsets = common.buffers(batch.column(2))
            for a, b in common.slices(offsets):
                s, bounds = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                size = np.diff(bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(offsets[a : b + 1])), pa.array(size), pa.array(set_hashes(s, bounds).view(np.int64), mask=size == 0)], names=["doc_id", "uid", "n_bytes", "n_shingles", "node"])

    return run


def combine(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each key its smallest node, and for all others a tie to it (key, node, lead, number of lists)."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    lead = node[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
    tie = ~head & (node != lead)
    pair, count = np.unique(np.stack((lead[tie], node[tie])), axis=1, return_counts=True)
    scattered = common.mix(pair[0].view(np.uint64) * np.uint64(3) + pair[1].view(np.uint64)).view(np.int64)
    none = np.zeros(int(head.sum()), np.int64)
    return np.concatenate((key[head], scattered)), np.concatenate((node[head], pair[1])), np.concatenate((none, pair[0])), np.concatenate((none, count))


def _probe(k: int, percent: int, frequent):
    """Entries (key, node, 0, 0) of the lists, one for each list and task, and ties (scattered key, node, lead, lists)."""

    def run(batches):
        seen: set[int] = set()
        keys, nodes, held = [], [], 0
        names = ["key", "node", "lead", "n"]
        for batch in batches:
            data, offsets = common.buffers(batch.column(0))
            for a, b in common.slices(offsets):
                s, bounds = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                for i, node in enumerate(set_hashes(s, bounds).view(np.int64).tolist()):
                    own = s[bounds[i] : bounds[i + 1]]
                    if len(own) and node not in seen:  # equal sets of one task are entered once
                        seen.add(node)
                        keys.append(index_keys(own, percent, frequent.value).view(np.int64))
                        nodes.append(np.full(len(keys[-1]), node))
                        held += len(keys[-1])
                if len(seen) > 200_000:
                    seen.clear()
                if held > ENTRIES:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, combine(np.concatenate(keys), np.concatenate(nodes)))), names=names)
                    keys, nodes, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, combine(np.concatenate(keys), np.concatenate(nodes)))), names=names)

    return run


def _ties(batches):
    """(first, node, lists) for the members of each list, and the ties that tasks found; rows are sorted by (key, node)."""
    key, lead, last = None, 0, 0
    for batch in batches:
        every = [c.to_numpy() for c in batch.columns]
        done = every[3] > 0
        if done.any():
            yield pa.RecordBatch.from_arrays([pa.array(every[2][done]), pa.array(every[1][done]), pa.array(every[3][done])], names=["a", "b", "n"])
        k, node = every[0][~done], every[1][~done]
        if not len(k):
            continue
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        if key is not None and k[0] == key:
            new[0] = False
        at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        first = np.where(at >= 0, node[np.maximum(at, 0)], lead)
        fresh = ~new & (node != first)
        fresh[1:] &= (node[1:] != node[:-1]) | new[1:]
        if not new[0] and node[0] == last:
            fresh[0] = False
        key, lead, last = k[-1], first[-1], node[-1]
        if fresh.any():
            yield pa.RecordBatch.from_arrays([pa.array(first[fresh]), pa.array(node[fresh]), pa.array(np.ones(int(fresh.sum()), np.int64))], names=["a", "b", "n"])


def _sets(k: int):
    """Rows (node, size, pivot, is_pivot, text) give these and shingles in place of the text."""

    def run(batches):
        for batch in batches:
            data, offsets = common.buffers(batch.column(4))
            for a, b in common.slices(offsets):
                s, bounds = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in range(4)), common.list_array(s.view(np.int64), bounds)], names=["node", "size", "pivot", "is_pivot", "shingles"])

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.concatenate((a, b))
    both.sort()
    common_count = int((both[1:] == both[:-1]).sum())
    return 100 * common_count >= percent * (len(both) - common_count)


def join_family(nodes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A forest (node, node) of the links between these sets' components, which are known in part by ``label``; with two sides,
    only pairs of both sides are compared."""
    m = len(nodes)
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    sets, size, side, nodes, label = [sets[i] for i in order], size[order], side[order], nodes[order], label[order].copy()
    two = side.min() != side.max()
    count = int(min(256, max(4, 2 * differing(2 * int(size.max()), percent) + 1)))
    blocks = np.array([block_sums(s, count) for s in sets])
    forest = []
    for i in range(m - 1):
        near = int(np.searchsorted(size, size[i] * 100 // percent, side="right"))  # sizes are ascending
        near = max(near, i + 1)
        j = np.arange(i + 1, near)
        j = j[label[j] != label[i]]
        if two:
            j = j[side[j] != side[i]]
        if not len(j):
            continue
        apart = (blocks[j] != blocks[i]).sum(axis=1)
        for x in j[apart <= (size[j] + size[i]) * (100 - percent) // (100 + percent)].tolist():
            if label[x] != label[i] and linked(sets[i], sets[x], percent):
                forest.append((int(nodes[i]), int(nodes[x])))
                label[label == label[x]] = label[i]
    return forest


def _families(percent: int):
    """Links of each task key's rows (key, side, node, label, shingles), which are sorted by key."""

    def run(batches):
        key, nodes, sets, side, label = None, [], [], [], []

        def done():
            if len(nodes) > 1:
                yield from join_family(np.array(nodes), sets, np.array(side), np.array(label), percent)

        out = []
        for batch in batches:
            keys, sides, ids, labels = (batch.column(k).to_pylist() for k in range(4))
            column = batch.column(4)
            values, edge = np.asarray(column.values).view(np.uint64), np.asarray(column.offsets)
            for i, x in enumerate(keys):
                if x != key:
                    out += done()
                    key, nodes, sets, side, label = x, [], [], [], []
                if not nodes or nodes[-1] != ids[i] or side[-1] != sides[i]:
                    nodes.append(ids[i])
                    side.append(sides[i])
                    label.append(labels[i])
                    sets.append(values[edge[i] : edge[i + 1]].copy())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
                out = []
        out += done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return run


_ENTRIES = "array<struct<key:string,side:int>>"


def task_keys(members: DataFrame, percent: int, per_task: int = FAMILY, elements: int = ELEMENTS) -> DataFrame:
    """node, label and entries (task key, side) of each family member; members: node, family, label, size.

    A small family is one task's; a large one is cut in blocks by size class, and each pair of blocks whose sizes can link
    is a task's."""
    total = members.groupBy("family").agg(F.count("*").alias("n"), F.sum("size").alias("e"))
    small = (F.col("n") <= per_task) & (F.col("e") <= elements)
    rows = members.join(total, "family")
    name = lambda *parts: F.concat_ws(":", F.col("family").cast("string"), *(x.cast("string") for x in parts))
    entry = lambda key, side: F.struct(key.alias("key"), side.cast("int").alias("side"))
    whole = rows.where(small).select("node", "label", F.array(entry(name(), F.lit(0))).alias("entries"))
    large = rows.where(~small).withColumn("c", _class_of_value(F.col("size")))
    shape = large.groupBy("family", "c").agg(F.ceil(F.greatest(F.count("*") / per_task, F.sum("size") / elements)).cast("int").alias("nb"))
    large = large.join(shape, ["family", "c"])
    large = large.join(shape.select("family", (F.col("c") - 1).alias("c"), F.col("nb").alias("nb_up")), ["family", "c"], "left").join(shape.select("family", (F.col("c") + 1).alias("c"), F.col("nb").alias("nb_down")), ["family", "c"], "left")
    large = large.withColumn("b", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    c, b = F.col("c"), F.col("b")
    to = lambda n: F.sequence(F.lit(0), n - 1)
    none = F.expr(f"cast(array() as {_ENTRIES})")
    own = F.transform(to(F.col("nb")), lambda x: entry(name(c, F.least(b, x), c, F.greatest(b, x)), (b > x).cast("int")))
    reaches_up = F.col("nb_up").isNotNull() & (_class_of_value(F.floor(F.col("size") * 100 / percent)) > c)
    reached = F.col("nb_down").isNotNull() & (_class_of_value(F.ceil(F.col("size") * percent / 100)) < c)
    up = F.when(reaches_up, F.transform(to(F.col("nb_up")), lambda x: entry(name(c, b, c + 1, x), F.lit(0)))).otherwise(none)
    down = F.when(reached, F.transform(to(F.col("nb_down")), lambda x: entry(name(c - 1, x, c, b), F.lit(1)))).otherwise(none)
    return whole.unionByName(large.select("node", "label", F.concat(own, up, down).alias("entries")))


def _class_of_value(x):
    return F.floor(F.log(x.cast("double")) / F.lit(float(np.log(RATIO)))).cast("int")


def link_components(docs: DataFrame, k: int = 3, percent: int = 90, parts: int | None = None, per_task: int = FAMILY, elements: int = ELEMENTS) -> DataFrame:
    """doc_id, n_shingles, node (hash of the set, null if empty) and component_id, a row for each row of ``docs``."""
    with common.shuffles_released(docs.sparkSession):
        return _link_components(docs, k, percent, parts, per_task, elements)


def _link_components(docs: DataFrame, k: int, percent: int, parts: int | None, per_task: int, elements: int) -> DataFrame:
    spark = docs.sparkSession
    common.small_batches(spark)
    parts = parts or common.shuffle_parts(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("uid"), common.binary().alias("text"))
    base = common.cut(rows.mapInArrow(_nodes(k), "doc_id long, uid long, n_bytes long, n_shingles long, node long"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(rows, base.agg(F.sum("n_bytes")).first()[0] or 0, k))
    keys = rows.select("text").mapInArrow(_probe(k, percent, frequent), "key long, node long, lead long, n long").repartition(parts, "key").sortWithinPartitions("key", "node")
    ties = common.cut(keys.mapInArrow(_ties, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))
    family = components(ties.select("a", "b")).withColumnRenamed("label", "family")
    place = F.struct(F.coalesce("doc_id", F.lit(LEAST)).alias("id"), "uid")
    first = common.cut(base.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min(place).alias("at"), F.first("n_shingles").alias("size")))
    # each set and its pivot, the set it shares most lists with
    pivot = common.cut(ties.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("pivot")).withColumnRenamed("b", "node"))
    asked = common.cut(pivot.groupBy("pivot").agg(F.count("*").alias("__n")))
    members = family.join(first, "node").join(pivot, "node", "left").join(asked.select(F.col("pivot").alias("node"), F.lit(True).alias("is_pivot")), "node", "left")
    members = common.cut(members.select("node", "family", "size", "pivot", F.coalesce("is_pivot", F.lit(False)).alias("is_pivot"), "at.id", "at.uid"))
    whole = rows.select(F.coalesce("doc_id", F.lit(LEAST)).alias("id"), "uid", "text").groupBy("id", "uid").agg(F.first("text").alias("text"))
    sets = common.cut(whole.join(members.drop("family"), ["id", "uid"]).select("node", "size", "pivot", "is_pivot", "text").mapInArrow(_sets(k), "node long, size long, pivot long, is_pivot boolean, shingles array<long>"))
    of = sets.where("pivot is not null").select(F.col("node").alias("b"), F.col("pivot").alias("a"), F.col("size").alias("b_size"), F.col("shingles").alias("b_set"))
    to = sets.where("is_pivot").select(F.col("node").alias("a"), F.col("size").alias("a_size"), F.col("shingles").alias("a_set"))
    pair = common.spread_join(of, to, ["a"], parts, asked.withColumnRenamed("pivot", "a"), asked.agg(F.sum("__n")).first()[0] or 0).where(100 * F.least("a_size", "b_size") >= percent * F.greatest("a_size", "b_size"))
    shared = F.size(F.array_intersect("a_set", "b_set"))
    known = common.cut(pair.where(100 * shared >= percent * (F.col("a_size") + F.col("b_size") - shared)).select("a", "b"))
    # each set but a family's first has one pivot, so a family with a link for each of them is one component
    mine = known.select(F.col("b").alias("node"), F.col("a").alias("label"))
    labelled = members.select("node", "family", "size").join(mine, "node", "left")
    open_ = labelled.groupBy("family").agg(F.count("*").alias("n"), F.count("label").alias("k")).where("k < n - 1").select("family")
    labelled = labelled.withColumn("label", F.coalesce("label", "node"))
    wanted = common.cut(task_keys(common.cut(labelled.join(open_, "family")), percent, per_task, elements))
    few = wanted.select(F.size("entries").alias("e")).agg(F.sum("e")).first()[0] or 0
    split = sets.select("node", "shingles").join(F.broadcast(wanted) if few <= MOST_BROADCAST else wanted, "node").select(F.explode("entries").alias("x"), "node", "label", "shingles").select("x.key", "x.side", "node", "label", "shingles")
    more = split.repartition(parts, "key").sortWithinPartitions("key", "side", "node").mapInArrow(_families(percent), "a long, b long")
    nodes = first.join(components(known.unionByName(more)), "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = nodes.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of = nodes.join(smallest, "label").select("node", "component_id")
    copies = base.where("node is not null").groupBy("node").agg(F.count("*").alias("__n"))
    placed = common.spread_join(base.where("node is not null"), of, ["node"], parts, copies, base.count()).select("doc_id", "n_shingles", "node", "component_id")
    return placed.unionByName(base.where("node is null").select("doc_id", "n_shingles", "node", F.col("doc_id").alias("component_id")))
