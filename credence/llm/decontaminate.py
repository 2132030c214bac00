"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Texts are lower-cased (A-Z) and cut into words; a pattern is a window of ``window`` consecutive words of a benchmark
item, or the whole item where it is shorter. For each pattern length, a shift table indexed by the hash of a block of
two words says how far the search may move on. The search moves through the texts in lanes of some hundred words, all
lanes of a slice together: a lane looks at the block that ends at its word, moves on by the block's shift, and never looks
at (or hashes) the words it skips. Where the shift is zero, the hash of the suffix block picks a bucket, the hash of all
the words picks the patterns to test, and a direct comparison of the words decides.

The benchmark is a stated query set. Its distinct items are dealt by hash to blocks of about ``block_bytes`` of text; one
block at a time is read and sent to the tasks while all documents stream past. A worker holds a block as its words and four
numbers a pattern, some ten times its text, and twice that while it is compiled. With one block (the common case)
there is no shuffle at all; with more, documents get a row key first, each block's hits are written to the shared folder,
and they are put together by that key, so the rows are the same for any number of blocks.

Defined cases: null or wordless text has no words and no hits; a null or wordless item matches nothing; a null item_id
is the string "null"; repeated rows each count and stay, with null ids too; an empty table on either side gives no hits; a
very long text is a row like any other; of other columns, those named in ``keep`` are passed through, but for n_words,
spans and items, which are replaced.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words that one lane of the search goes through.
LANE = 256
_GAP = common.alnum_gap_table()


@dataclass
class Patterns:
    """The patterns of one length."""

    length: int
    shift: np.ndarray  # by block hash, modulo the table's size
    suffix: np.ndarray  # sorted suffix-block hashes
    hashes: np.ndarray  # sorted distinct hashes of whole patterns
    bounds: np.ndarray  # of each hash, its patterns in the arrays below
    at: np.ndarray  # the first word of each pattern in the block's words
    item: np.ndarray  # the place of each pattern's item in the block
    block: Words  # the words of all items of the block
    names: list[str]  # their ids


class Words:
    """The words of all rows of a slice; they are hashed when they are looked at."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = common.lower_ascii(data)
        self.starts, self.ends, self.first = common.words(self.data, offsets, _GAP)
        self.prefix = None

    def hash(self, at: np.ndarray) -> np.ndarray:
        if self.prefix is None:
            self.prefix = common.prefix_hash(self.data)
        return common.span_hash(self.prefix, self.starts[at], self.ends[at])

    def block(self, at: np.ndarray, length: int) -> np.ndarray:
        """The hash of the block that ends at each word: two words, or one where patterns have one."""
        h = self.hash(at)
        return h if length < 2 else common.mix(self.hash(at - 1) * np.uint64(3) + h)

    def run(self, start: np.ndarray, length: int) -> np.ndarray:
        out = np.zeros(len(start), np.uint64)
        for k in range(length):
            out = common.mix(out * np.uint64(5) + self.hash(start + k))
        return out

    def text(self, start: int, length: int) -> bytes:
        return b" ".join(self.data[self.starts[k] : self.ends[k]].tobytes() for k in range(start, start + length))


def compile_patterns(items: list[tuple[str, str | None]], window: int = 10) -> list[Patterns]:
    """Pattern tables by length, from (item_id, text)."""
    data, offsets = common.buffers(pa.array([t or "" for _, t in items], pa.string()))
    w = Words(data, offsets)
    sizes = np.diff(w.first)
    lengths, names, out = np.minimum(sizes, window), [item for item, _ in items], []
    for m in np.unique(lengths[lengths > 0]).tolist():
        own = np.flatnonzero(lengths == m)
        many = sizes[own] - m + 1  # windows of each item
        item = np.repeat(own, many)
        at = np.repeat(w.first[own], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        b, size = min(2, m), 1 << min(24, max(12, int(8 * len(at)).bit_length()))
        shift = np.full(size, m - b + 1, np.uint8 if m < 256 else np.int64)
        for k in range(m - 1, b - 2, -1):  # the block that ends k words into a pattern allows a move of m - 1 - k
            np.minimum.at(shift, (w.block(at + k, m) & np.uint64(size - 1)).astype(np.int64), m - 1 - k)
        whole = w.run(at, m)
        order = np.argsort(whole, kind="stable")
        keys, begin = np.unique(whole[order], return_index=True)
        out.append(Patterns(m, shift, np.unique(w.block(at + m - 1, m)), keys, np.append(begin, len(order)), at[order], item[order].astype(np.int32), w, names))
    w.prefix = None  # from here on words are only compared
    return out


def _in_sorted(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


def visit(w: Words, p: Patterns) -> tuple[np.ndarray, np.ndarray, int]:
    """The words at which a pattern may end (shift zero), their rows, and the number of words looked at."""
    m, n = p.length, np.diff(w.first)
    row = np.flatnonzero(n >= m)
    begin, stop = w.first[row] + m - 1, w.first[row + 1]
    lanes = -(-(stop - begin) // LANE)
    row, step = np.repeat(row, lanes), np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    at = np.repeat(begin, lanes) + step * LANE
    stop = np.minimum(at + LANE, np.repeat(stop, lanes))
    found, rows, looked = [], [], 0
    while len(at):
        move = p.shift[(w.block(at, m) & np.uint64(len(p.shift) - 1)).astype(np.int64)]
        looked += len(at)
        zero = move == 0
        found.append(at[zero])
        rows.append(row[zero])
        at = at + np.maximum(move, 1)
        live = at < stop
        at, stop, row = at[live], stop[live], row[live]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found]), np.concatenate([none, *rows]), looked


def search(data: np.ndarray, offsets: np.ndarray, patterns: list[Patterns]) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Words before each row, a mask of hit words, and each row's items."""
    w = Words(data, offsets)
    hit, items = np.zeros(len(w.starts) + 1, np.int64), [set() for _ in range(len(offsets) - 1)]
    for p in patterns:
        m = p.length
        end, row, _ = visit(w, p)
        if not len(end):
            continue
        ok = _in_sorted(p.suffix, w.block(end, m))[1]
        end, row = end[ok], row[ok]
        if not len(end):
            continue
        test, ok = _in_sorted(p.hashes, w.run(end - m + 1, m))
        for e, r, t in zip(end[ok].tolist(), row[ok].tolist(), test[ok].tolist()):
            text = w.text(e - m + 1, m)
            same = [p.names[p.item[j]] for j in range(p.bounds[t], p.bounds[t + 1]) if p.block.text(p.at[j], m) == text]
            if same:
                hit[e - m + 1] += 1
                hit[e + 1] -= 1
                items[r].update(same)
    return w.first, np.cumsum(hit)[:-1] > 0, items


def _spans(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


_OUT = ("n_words", "spans", "items")
_compiled: dict[str, list[Patterns]] = {}


def _pass(rows: DataFrame, items: list[tuple[str, str | None]], window: int) -> DataFrame:
    """All columns of ``rows`` but the last one, the text, as __0, __1 and so on, with the hits of these items."""
    sent, name = rows.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    names = [f"__{k}" for k in range(len(rows.columns) - 1)]

    def run(batches):
        if name not in _compiled:  # a worker serves many tasks
            _compiled.clear()
            _compiled[name] = compile_patterns(sent.value, window)
        patterns = _compiled[name]
        for batch in batches:
            data, offsets = common.buffers(batch.column(batch.num_columns - 1))
            for a, b in common.slices(offsets):
                first, mask, found = search(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], patterns)
                out = [batch.column(k).slice(a, b - a) for k in range(batch.num_columns - 1)]
                part = [mask[first[i] : first[i + 1]] for i in range(b - a)]
                out += [pa.array(np.diff(first)), pa.array([_spans(x) if x.any() else [] for x in part], _SPAN), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(out, names=[*names, *_OUT])

    kept = "".join(f"{n} {f.dataType.simpleString()}, " for n, f in zip(names, rows.schema.fields[:-1]))
    return rows.mapInArrow(run, f"{kept}n_words long, spans array<struct<start:long,end:long>>, items array<string>")


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: tuple[str, ...] = ("doc_id",), block_bytes: int = 8 << 20) -> DataFrame:
    """Columns of ``keep`` with n_words, spans (hit word ranges [start, end)) and items (ids of items that occur, sorted)."""
    common.small_batches(docs.sparkSession)
    names = [c for c in keep if c not in _OUT]
    inner = [f"__{k}" for k in range(len(names))]
    rows = docs.select(*(F.col(c).alias(x) for c, x in zip(names, inner)), common.binary().alias("__text"))
    shown = [F.col(x).alias(c) for c, x in zip(names, inner)]
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    block = lambda k: [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()]
    if count == 1:
        return _pass(rows, block(0), window).select(*shown, *_OUT)
    rows = common.cut(rows.select(*inner, F.monotonically_increasing_id().alias("__row"), "__text"))
    found = []
    for k in range(count):
        part = _pass(rows.select("__row", "__text") if k else rows, block(k), window).withColumnRenamed("__0" if k else f"__{len(inner)}", "__row")
        found.append(common.cut(part.where(F.size("spans") > 0).select("__row", "spans", "items") if k else part))
    hits = found[0].where(F.size("spans") > 0).select("__row", "spans", "items")
    for more in found[1:]:
        hits = hits.unionByName(more)
    every = hits.groupBy("__row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = F.aggregate(
        F.array_sort("spans"),
        F.expr("cast(array() as array<struct<start:long,end:long>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    none = lambda kind: F.expr(f"cast(array() as array<{kind}>)")
    out = found[0].drop("spans", "items").join(every.withColumn("spans", merged), "__row", "left")
    return out.select(*shown, "n_words", F.coalesce("spans", none("struct<start:long,end:long>")).alias("spans"), F.coalesce("items", none("string")).alias("items"))


def n_hit(spans: str = "spans"):
    """Hit words: the total length of the spans, which do not touch each other."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
