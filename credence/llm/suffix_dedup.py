"""Suffix-array dedup: bytes covered by a ``length``-byte string that also starts elsewhere.

Texts are bytes and strings do not cross documents. The work is split so that equal strings always meet:

1. Every string of ``length`` bytes has an anchor, the smallest hash of the ``gram``-byte strings in it. Consecutive
   strings with one anchor form a segment. Equal strings have equal anchors, so only segments whose anchor occurs
   again can hold a repeat, and segments in which the anchor itself stands twice (text with a short period); the counts
   are aggregated by Spark. Segments whose anchor occurs again with one content only are repeats as a whole.
2. The other segments, one for each content, are dealt to buckets by anchor. A bucket's segments are joined with unique
   end marks; suffixes are sorted by prefix doubling as far as ``length`` asks, which gives a Burrows-Wheeler transform.
   A breadth-first backward extension then expands intervals: level by level it derives the common prefixes of
   neighbouring suffixes in increasing order and stops at ``length``. The neighbours left open agree on ``length`` bytes.
3. An anchor with more bytes than a bucket may hold is dealt to several buckets; there, the strings' hashes are counted
   across these buckets as well, so nothing is lost.

Contents are compared by two independent hashes modulo primes, 124 bits together. Anchors with very many segments (more
than a fixed share of all) are dealt to several tasks in each join.

Defined cases: null text is empty; overlapping repeats and repeats inside one document count; rows with equal doc_id and
text are two documents and repeat each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST = -(1 << 63)
GRAM, MOST_WINDOWS = 128, 1024
BUCKET_BYTES, BUCKET_MOST = 1_500_000, 3_000_000


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Anchor, both content hashes, row, start (in data), number of strings of each segment, and whether two of its own strings may be equal."""
    n = len(data)
    if n < length:
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), [z.view(np.uint64)] * 2, z, z, z, z.astype(bool)
    g = common.gram_hash(data, gram)
    w = length - gram + 1
    m = n - length + 1
    tiled = np.concatenate((g, np.full(-len(g) % w, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    ahead = np.minimum.accumulate(tiled, axis=1).ravel()
    behind = np.minimum.accumulate(tiled[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[:m], ahead[w - 1 : w - 1 + m])
    ok = np.ones(m, bool)
    for end in offsets[1:-1]:
        ok[max(0, end - length + 1) : min(end, m)] = False
    new = ok.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~ok[:-1]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], ok, [False])).astype(np.int8)) == -1)
    start = np.flatnonzero(new)
    stop = np.minimum(np.append(start[1:], m), edge[np.searchsorted(edge, start, side="right")]) if len(start) else start
    count = stop - start
    if len(start) and count.max() > MOST_WINDOWS:
        times = -(-count // MOST_WINDOWS)
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        stop = np.minimum(np.repeat(stop, times), np.repeat(start, times) + (step + 1) * MOST_WINDOWS)
        start = np.repeat(start, times) + step * MOST_WINDOWS
        count = stop - start
    row = np.searchsorted(offsets, start, side="right") - 1
    first, second = anchor_pairs(g, np.where(ok, low, 0), w)
    # pairs are in order of both ends: the first one that starts inside ends first
    inner = np.append(second, n)[np.searchsorted(first, start)] < stop - 1 + w
    contents = [common.span_hash(common.prefix_hash(data, family), start, stop - 1 + length) for family in (0, 1)]
    return low[start], contents, row, start, count, inner


def anchor_pairs(g: np.ndarray, low: np.ndarray, w: int):
    """Neighbouring places of one gram that is the smallest of some window each time, at most a window apart.

    Two equal strings of a segment have the anchor at one offset, and every window between them holds it too."""
    wide = np.concatenate((np.zeros(w - 1, np.uint64), low, np.zeros(w - 1 + -(len(low) + 2 * (w - 1)) % w, np.uint64))).reshape(-1, w)
    ahead = np.maximum.accumulate(wide, axis=1).ravel()
    behind = np.maximum.accumulate(wide[:, ::-1], axis=1)[:, ::-1].ravel()
    at = np.flatnonzero(g == np.maximum(behind[: len(g)], ahead[w - 1 : w - 1 + len(g)]))
    pair = np.flatnonzero((g[at[1:]] == g[at[:-1]]) & (at[1:] - at[:-1] <= w))
    return at[pair], at[pair + 1]


def sort_suffixes(symbols: np.ndarray, to_end: np.ndarray, length: int) -> np.ndarray:
    """Suffixes in the order of their first ``length`` symbols at least; a suffix that meets an end mark (symbol 0) is unlike all others."""
    n = len(symbols)
    padded = np.concatenate((symbols, np.zeros(7, np.int64)))
    key = np.zeros(n, np.int64)
    live = np.ones(n, bool)
    for k in range(7):  # seven symbols of nine bits; nothing behind an end mark counts
        key = (key << 9) | np.where(live, padded[k : k + n], 0)
        live &= to_end > k
    order = np.argsort(key, kind="stable")
    k, met = key[order], to_end[order] < 7
    new = np.ones(n, bool)
    new[1:] = (k[1:] != k[:-1]) | met[1:] | met[:-1]
    slot = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, slot, 0))
    h = 7
    single = new & np.append(new[1:], True)
    active = order[~single]
    while h < length and len(active):
        r = rank[active]
        key = r * n + rank[np.minimum(active + h, n - 1)]
        o = np.argsort(key, kind="stable")
        active, key, r = active[o], key[o], r[o]
        head = np.ones(len(r), bool)
        head[1:] = r[1:] != r[:-1]
        index = np.arange(len(r))
        place = r + index - np.maximum.accumulate(np.where(head, index, 0))
        new = head.copy()
        new[1:] |= key[1:] != key[:-1]
        met = to_end[active] < 2 * h
        new |= met
        new[1:] |= met[:-1]
        group = np.maximum.accumulate(np.where(new, index, 0))
        order[place] = active
        rank[active] = place[group]
        active = active[~(new & np.append(new[1:], True))]
        h *= 2
    return order


def open_neighbours(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """A mask of the rows that agree with the row before on ``length`` symbols, by backward extension on the transform."""
    n = len(symbols)
    bwt = symbols[order - 1]  # the symbol before the first suffix is the last end mark
    by = np.argsort(bwt.astype(np.uint16), kind="stable")
    last_first = np.empty(n, np.int64)
    last_first[by] = np.arange(n)
    same = bwt[by[1:]] == bwt[by[:-1]]
    following, before = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    following[by[:-1][same]] = by[1:][same]
    before[by[1:][same]] = by[:-1][same]
    is_open = np.ones(n + 1, bool)
    is_open[0] = is_open[n] = False
    marks = int((symbols == 0).sum())
    is_open[: marks + 1] = False  # end marks are unlike each other
    low, high = np.zeros(1, np.int64), np.full(1, n - 1, np.int64)
    for level in range(length):
        width = high - low + 1
        gid = np.repeat(np.arange(len(low)), width)
        rows = np.arange(len(gid)) + np.repeat(low - (np.cumsum(width) - width), width)
        mark = bwt[rows] > 0
        rows, gid = rows[mark], gid[mark]
        first, final = before[rows] < low[gid], following[rows] > high[gid]
        key = gid * 257 + bwt[rows]
        f, e = rows[first][np.argsort(key[first], kind="stable")], rows[final][np.argsort(key[final], kind="stable")]
        i, j = last_first[f], last_first[e]
        fresh = is_open[j + 1]
        low, high = i[fresh], j[fresh]
        is_open[high + 1] = False
        if level == 0:  # each end mark is an interval of its own
            low, high = (np.concatenate((np.arange(marks), x)) for x in (low, high))
        if not len(low):
            break
    return is_open[:n]


def repeated(contents: list[bytes], length: int) -> list[np.ndarray]:
    """For each byte string, a mask of the positions whose ``length`` bytes also start elsewhere in these strings."""
    sizes = np.array([len(c) for c in contents], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    symbols = np.zeros(int(starts[-1]), np.int64)
    inside = np.ones(len(symbols), bool)
    inside[starts[1:] - 1] = False
    symbols[inside] = np.frombuffer(b"".join(contents), np.uint8).astype(np.int64) + 1
    to_end = np.repeat(starts[1:] - 1, sizes + 1) - np.arange(len(symbols))
    order = sort_suffixes(symbols, to_end, length)
    agree = open_neighbours(symbols, order, length)
    hit = np.zeros(len(symbols), bool)
    hit[order] = agree | np.append(agree[1:], False)
    return [hit[a : a + max(0, n - length + 1)] for a, n in zip(starts[:-1], sizes)]


def _runs(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [{"a": int(x), "b": int(y)} for x, y in zip(edge[::2], edge[1::2])]


_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _find_segments(length: int, gram: int):
    def run(batches):
        for batch in batches:
            data, offsets = common.buffers(batch.column(2))
            for a, b in common.slices(offsets):
                local = offsets[a : b + 1] - offsets[a]
                key, content, row, start, count, inner = segments(data[offsets[a] : offsets[b]], local, length, gram)
                bounds = np.searchsorted(row, np.arange(b - a + 1))
                columns = [common.list_array(x, bounds) for x in (key.view(np.int64), content[0].view(np.int64), content[1].view(np.int64), (start - local[row]).astype(np.int32), count.astype(np.int32), inner.astype(np.int8))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *columns], names=["id", "uid", "keys", "contents", "others", "starts", "counts", "inner"])

    return run


def _cut_out(length: int):
    """The bytes of the listed segments of each document."""

    def run(batches):
        for batch in batches:
            out = []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [(w["bucket"], w["key"], w["content"], w["other"], w["copies"], w["split"], text[w["start"] : w["start"] + w["n"] - 1 + length]) for w in wanted]
            for k in range(0, len(out), 2000):
                yield pa.RecordBatch.from_pylist([dict(zip(_PIECE.names, x)) for x in out[k : k + 2000]], schema=_PIECE) if out else None

    return run


_PIECE = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("content", pa.int64()), ("other", pa.int64()), ("copies", pa.int64()), ("split", pa.bool_()), ("bytes", pa.binary())])


_SOLVED = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("content", pa.int64()), ("other", pa.int64()), ("runs", _RUNS), ("hashes", pa.list_(pa.struct([("h", pa.int64()), ("o", pa.int64())])))])


def _buckets(length: int):
    """Each bucket's segments with the runs of repeated strings, and the hashes of all strings where the anchor is split."""

    def done(rows):
        out = []
        for (bucket, key, content, other, copies, split, raw), mask in zip(rows, repeated([r[6] for r in rows], length)):
            if copies > 1:
                mask[:] = True
            hashes = []
            if split:
                at = np.arange(len(mask))
                h, o = (common.span_hash(common.prefix_hash(np.frombuffer(raw, np.uint8), f), at, at + length).view(np.int64).tolist() for f in (0, 1))
                hashes = [{"h": x, "o": y} for x, y in zip(h, o)]
            out.append({"bucket": bucket, "key": key, "content": content, "other": other, "runs": _runs(mask), "hashes": hashes})
        return pa.RecordBatch.from_pylist(out, schema=_SOLVED)

    def run(batches):
        now, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != now and rows:
                    yield done(rows)
                    rows = []
                now = row[0]
                rows.append(row)
        if rows:
            yield done(rows)

    return run


def _apply(length: int, digest: bool):
    def run(batches):
        for batch in batches:
            ids, texts, spans = (c.to_pylist() for c in batch.columns)
            out = []
            for text, found in zip(texts, spans):
                merged: list[list[int]] = []
                for x in sorted(found or [], key=lambda x: x["a"]):
                    if merged and x["a"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["b"])
                    else:
                        merged.append([x["a"], x["b"]])
                kept, at = [], 0
                for a, b in merged:
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]])
                out.append((len(text), len(text) - len(kept), merged, kept))
            columns = [batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())]
            if digest:
                columns += [pa.array([len(x[2]) for x in out], pa.int64()), pa.array([hashlib.sha256(x[3]).hexdigest() for x in out])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            else:
                columns += [pa.array([[{"start": a, "end": b} for a, b in x[2]] for x in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([x[3] for x in out], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return run


def dedup(docs: DataFrame, length: int = 400, gram: int | None = None, output: str = "kept", parts: int | None = None, bucket_bytes: int = BUCKET_BYTES, bucket_most: int = BUCKET_MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed and, with output "kept", spans (removed byte ranges) and kept (binary, the rest), with output
    "digest", n_spans and kept_sha256."""
    common.small_batches(docs.sparkSession)
    gram = gram or max(1, min(GRAM, length // 2))
    parts = parts or common.shuffle_parts(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("id"), F.xxhash64("text").alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), common.binary().alias("text"))
    found = common.cut(rows.select("id", "uid", "text").mapInArrow(_find_segments(length, gram), "id long, uid long, keys array<long>, contents array<long>, others array<long>, starts array<int>, counts array<int>, inner array<tinyint>"))
    zipped = F.arrays_zip("keys", "contents", "others", "starts", "counts", "inner")
    every = found.select("id", "uid", F.explode(zipped).alias("x")).select("id", "uid", F.col("x.keys").alias("key"), F.col("x.contents").alias("content"), F.col("x.others").alias("other"), F.col("x.starts").alias("start"), F.col("x.counts").alias("n"), F.col("x.inner").alias("inner"))
    both = F.struct("content", "other")
    again = common.cut(every.groupBy("key").agg(F.count("*").alias("c"), F.min(both).alias("lo"), F.max(both).alias("hi"), F.max("inner").alias("inner")).where("c > 1 or inner > 0").select("key", "c", ((F.col("lo") != F.col("hi")) | (F.col("c") == 1)).alias("mixed")))
    total = again.agg(F.sum("c")).first()[0] or 0
    matched = common.cut(common.spread_join(every.drop("inner"), again.select("key", "mixed"), ["key"], parts, again.select("key", F.col("c").alias("__n")), total))
    whole = matched.where(~F.col("mixed")).select("id", "uid", F.col("start").alias("a"), (F.col("start") + F.col("n") - 1 + length).alias("b"))
    # one segment of each content goes to a bucket
    one = matched.where("mixed").groupBy("key", "content", "other").agg(F.count("*").alias("copies"), F.min(F.struct("id", "uid", "start")).alias("at"), F.first("n").alias("n"))
    one = common.cut(one)
    sizes = one.groupBy("key").agg(F.sum(F.col("n") + length).alias("size"))
    buckets = max(1, -(-(sizes.agg(F.sum("size")).first()[0] or 0) // bucket_bytes))
    shared = F.ceil(F.col("size") / bucket_bytes)
    split = F.col("size") > bucket_most
    bucket = F.pmod(F.xxhash64("key") + F.when(split, F.pmod(F.xxhash64("content"), shared)).otherwise(0), F.lit(buckets)).cast("int")
    dealt = common.spread_join(one, sizes, ["key"], parts).withColumns({"bucket": bucket, "split": split})
    wanted = dealt.groupBy(F.col("at.id").alias("id"), F.col("at.uid").alias("uid")).agg(F.collect_list(F.struct("bucket", "key", "content", "other", "copies", "split", F.col("at.start").alias("start"), "n")).alias("wanted"))
    pieces = rows.join(wanted, ["id", "uid"]).select("text", "wanted").mapInArrow(_cut_out(length), "bucket int, key long, content long, other long, copies long, split boolean, bytes binary")
    of = ["key", "content", "other"]
    solved = common.cut(pieces.repartition(int(min(buckets, 4 * parts)), "bucket").sortWithinPartitions("bucket", *of).mapInArrow(_buckets(length), "bucket int, key long, content long, other long, runs array<struct<a:int,b:int>>, hashes array<struct<h:long,o:long>>"))
    runs = solved.select(*of, F.explode("runs").alias("r")).select(*of, F.col("r.a").alias("ra"), F.col("r.b").alias("rb"))
    if sizes.where(split).limit(1).count():
        strings = common.cut(solved.where(F.size("hashes") > 0).select("bucket", *of, F.posexplode("hashes").alias("p", "x")).select("bucket", *of, "p", "x.h", "x.o"))
        across = strings.groupBy("key", "h", "o").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).where("lo <> hi").select("key", "h", "o")
        runs = runs.unionByName(common.spread_join(strings, across, ["key", "h", "o"], parts).select(*of, F.col("p").cast("int").alias("ra"), (F.col("p") + 1).cast("int").alias("rb")))
    copies = one.select(*of, F.col("copies").alias("__n"))
    mixed = common.spread_join(matched.where("mixed"), runs.distinct(), of, parts, copies, total).select("id", "uid", (F.col("start") + F.col("ra")).alias("a"), (F.col("start") + F.col("rb") - 1 + length).alias("b"))
    spans = whole.unionByName(mixed).groupBy("id", "uid").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    kind = "n_spans long, kept_sha256 string" if output == "digest" else "spans array<struct<start:long,end:long>>, kept binary"
    return rows.join(spans, ["id", "uid"], "left").select("doc_id", "text", "spans").mapInArrow(_apply(length, output == "digest"), f"doc_id long, n_bytes long, n_removed long, {kind}")
