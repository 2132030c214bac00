"""Phrase collocations by PCY/DHP hashing: counts of next-length n-grams in buckets prune what is counted exactly.

Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at spaces and tabs into words. Pass m reads
all documents once. It counts the m-word phrases that may be frequent, exactly, and at the same time counts all next-length
phrases in hash buckets. An m-word phrase may be frequent if both of its (m - 1)-word parts are (Apriori) and its bucket
reached the least count in the pass before (PCY); next-length phrases with a part that this pass already left out are not
entered in buckets (DHP). Buckets and frequent parts are broadcast as bitmaps of ``1 << bits`` bits each, 2 x 64 MB at the
most whatever the corpus; a bit that is set by another phrase costs work, never a row, as counts that leave a pass are
exact: words are told apart by Arrow dictionaries and phrases by their words, not by hashes.

Tasks count slice by slice (a slice's memory does not grow with the input), send each distinct phrase and bucket once a
slice, and Spark sums them with map-side combine, so a phrase that every document has is a few rows a task.

A phrase's score is the least over its cuts of floor(1000000 a a / (l r)), in exact decimals. It is dropped if a longer
candidate that holds its words has 100 f >= 50 a. Each language's best come by a top-k in salted groups first.

Defined cases: null text counts as empty and null lang as ``und``; empty texts have no words and a language without words no
rows; empty tables give an empty result; rows that are equal count each; very long texts are read in slices cut between
words, with the words that a phrase may reach beyond the cut; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MOST_WORDS, LEAST, KEEP = 3, 10, 2000
#: Buckets are 2 to the power of so many, the more the more text there is (about one for 24 bytes), within these bounds: the largest bitmap has 64 MB.
BITS = (16, 29)
#: Buckets that one row of counts stands for.
SEGMENT = 1 << 16
#: Bytes of text that a task counts together.
SLICE = 4 << 20

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _BREAK.copy()
_GAP[[32, 9]] = True
_RAW = "lang string, phrase string, n long, segment int, at binary, many binary"
_RAW_NAMES = ["lang", "phrase", "n", "segment", "at", "many"]


def windows(data: np.ndarray, offsets: np.ndarray, reach: int, most: int = SLICE):
    """(first row, bytes, offsets, own): runs of rows of about ``most`` bytes; a longer row comes in parts that are cut before a
    gap, each with up to ``reach`` words of the next part. Only words that start below ``own`` are the part's."""
    for a, b in common.slices(offsets, most):
        lo, hi = int(offsets[a]), int(offsets[b])
        if hi - lo <= most:
            yield a, data[lo:hi], offsets[a : b + 1] - lo, hi - lo
            continue
        gaps = lo + np.flatnonzero(_GAP[data[lo:hi]])
        begin = lo
        while begin < hi:
            k = int(np.searchsorted(gaps, begin + most))
            end = int(gaps[k]) if k < len(gaps) else hi
            after = end
            for _ in range(reach):  # a word more: past the gap, up to the next gap that a word stands before
                while k < len(gaps) and (k + 1 == len(gaps) or gaps[k + 1] == gaps[k] + 1):
                    k += 1
                k += 1
                after = int(gaps[k]) if k < len(gaps) else hi
            yield a, data[begin:after], np.array([0, after - begin]), end - begin
            begin = end


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Each word's number and the distinct words."""
    size = ends - starts
    bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
    take = np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], size)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data[take])])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def bytes_hash(words: pa.Array) -> np.ndarray:
    """A hash of each string; equal strings have equal ones."""
    data, offsets = common.buffers(words)
    return common.span_hash(common.prefix_hash(data), offsets[:-1], offsets[1:])


_STEP = np.uint64(0x9E3779B97F4A7C15)


def chain(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase, from that of its first words and that of its last."""
    return common.mix(h * np.uint64(31) + word + _STEP)


class Bitmap:
    """``1 << bits`` bits; ``has`` looks hashes up. Segments that no row told of are zero."""

    def __init__(self, bits: int, rows=()):
        self.bits, self.packed = bits, np.zeros(1 << (bits - 3), np.uint8)
        for segment, packed in rows:
            part = np.frombuffer(packed, np.uint8)
            self.packed[segment * (SEGMENT >> 3) :][: len(part)] = part

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.bits)
        return (self.packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _bucket_rows(h: np.ndarray, bits: int, least: int) -> pa.RecordBatch | None:
    """The buckets' counts, up to ``least``, as a row for each segment: places and counts."""
    if not len(h):
        return None
    bucket, count = np.unique((h >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    segment = bucket // SEGMENT
    new = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    ends = np.concatenate((new[1:], [len(bucket)]))
    place, many = (bucket % SEGMENT).astype("<u2"), np.minimum(count, min(least, 255)).astype(np.uint8)
    at = pa.array([place[a:b].tobytes() for a, b in zip(new, ends)], pa.binary())
    none = pa.nulls(len(new), pa.string())
    return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(new), pa.int64()), pa.array(segment[new].astype(np.int32)), at, pa.array([many[a:b].tobytes() for a, b in zip(new, ends)], pa.binary())], names=_RAW_NAMES)


def _count_rows(lang: pa.Array, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(n), pa.binary())
    return pa.RecordBatch.from_arrays([lang.cast(pa.string()), phrase.cast(pa.string()), pa.array(n.astype(np.int64)), pa.nulls(len(n), pa.int32()), none, none], names=_RAW_NAMES)


def count_slice(data: np.ndarray, offsets: np.ndarray, own: int, langs: pa.DictionaryArray, m: int, last: bool, frequent, bucket, bits: int, least: int):
    """The rows of one slice in pass m: exact counts of its m-word phrases and, unless ``last``, of the buckets of longer ones."""
    data = common.lower_ascii(data)
    starts, ends, first = common.words(data, offsets, _GAP)
    if not len(starts):
        return
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    piece = np.searchsorted(np.flatnonzero(_BREAK[data]), starts) + row  # differs between words of different pieces or rows
    codes, words = word_codes(data, starts, ends)
    lang, names = langs.indices.to_numpy().astype(np.int64)[row], langs.dictionary
    key = lang * len(words) + codes
    word_hash = bytes_hash(words)[codes] ^ common.mix(bytes_hash(names.cast(pa.binary())) + np.uint64(1))[lang]
    n, mine = len(starts), starts < own
    # hashes of the phrases of 1 .. m + 1 words that begin at each word, and where they fit in a piece
    h, fits = [word_hash], [mine]
    for k in range(1, m if last else m + 1):
        h.append(np.concatenate((chain(h[-1][: n - k], word_hash[k:]), np.zeros(min(k, n), np.uint64)))[:n])
        inside = np.zeros(n, bool)
        inside[: max(0, n - k)] = piece[: max(0, n - k)] == piece[k:]
        fits.append(mine & inside)
    chosen = fits[m - 1]
    if m > 1:
        able = frequent.has(h[m - 2])
        able[: n - 1] &= able[1:].copy()
        able &= bucket.has(h[m - 1])
        chosen = chosen & able
    at = np.flatnonzero(chosen)
    if m == 1:
        total = np.bincount(lang[at], minlength=len(names))
        yield _count_rows(names, pa.nulls(len(names), pa.string()), total)
    if len(at):
        number = key[at]
        for k in range(1, m):
            number = np.unique(number, return_inverse=True)[1] * (int(key.max()) + 1) + key[at + k]
        _, where, times = np.unique(number, return_index=True, return_counts=True)
        where = at[where]
        phrase = words.take(pa.array(codes[where]))
        for k in range(1, m):
            phrase = pc.binary_join_element_wise(phrase, words.take(pa.array(codes[where + k])), b" ")
        yield _count_rows(names.take(pa.array(lang[where])), phrase, times)
    if not last:
        longer = fits[m]
        if m > 1:  # both m-word parts must be able to be frequent, also where the later one is the next slice's
            able[: n - 1] &= able[1:].copy()
            longer = longer & able
        rows = _bucket_rows(h[m][longer], bits, least)
        if rows is not None:
            yield rows


def _pass(m: int, last: bool, frequent, bucket, bits: int, least: int, most: int):
    def run(batches):
        f, b = (None if x is None else x.value for x in (frequent, bucket))
        held, size = [], 0

        def counted():
            table = pa.Table.from_batches(held).combine_chunks()
            langs = table.column(0).combine_chunks().dictionary_encode()
            langs = langs.chunk(0) if isinstance(langs, pa.ChunkedArray) else langs
            data, offsets = common.buffers(table.column(1))
            for a, part, bounds, own in windows(data, offsets, m, most):
                yield from count_slice(part, bounds, own, langs.slice(a, len(bounds) - 1), m, last, f, b, bits, least)

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= most:
                yield from counted()
                held, size = [], 0
        if held and sum(x.num_rows for x in held):
            yield from counted()

    return run


def _bit_rows(bits: int):
    """The segments of phrases (lang, phrase), for a bitmap of frequent ones."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                words = pc.split_pattern(batch.column(1).cast(pa.string()), " ")
                flat, bounds = words.flatten().cast(pa.binary()), np.asarray(words.offsets).astype(np.int64)
                own = common.mix(bytes_hash(batch.column(0).cast(pa.binary())) + np.uint64(1))
                each = bytes_hash(flat) ^ np.repeat(own, np.diff(bounds))
                h = each[bounds[:-1]]
                for k in range(1, int(np.diff(bounds).max())):
                    has = np.diff(bounds) > k
                    h[has] = chain(h[has], each[bounds[:-1][has] + k])
                yield _bucket_rows(h, bits, 1).select(["segment", "at", "many"])

    return run


def _bitmap_rows(least: int):
    """(segment, bits of the buckets with ``least`` counts) from sorted rows (segment, at, many)."""

    def run(batches):
        current, sums = None, np.zeros(SEGMENT, np.uint32)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([np.packbits(sums >= least, bitorder="little").tobytes()])], names=["segment", "bits"])
        for batch in batches:
            for segment, at, many in zip(*(c.to_pylist() for c in batch.columns)):
                if segment != current:
                    if current is not None:
                        yield row()
                    current = segment
                    sums[:] = 0
                place = np.frombuffer(at, "<u2")  # distinct within a row
                sums[place] = np.minimum(sums[place] + np.frombuffer(many, np.uint8), 1 << 16)
        if current is not None:
            yield row()

    return run


def bitmap(rows: DataFrame, bits: int, least: int) -> Bitmap:
    """The bitmap of the buckets that rows (segment, at, many) give ``least`` counts; ``1 << bits`` bits reach the driver at most."""
    rows = rows.select("segment", "at", "many").repartition(common.shuffle_parts(rows.sparkSession), "segment").sortWithinPartitions("segment")
    return Bitmap(bits, rows.mapInArrow(_bitmap_rows(min(least, 255)), "segment int, bits binary").collect())


def phrase_counts(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, bits: int | None = None, slice_bytes: int = SLICE) -> DataFrame:
    """lang, phrase, size (words) and n of all phrases of up to ``most_words`` words with at least ``least`` occurrences, and for each language
    a row of size 0 with all its words' number."""
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), common.binary().alias("text"))
    if bits is None:
        volume = rows.agg(F.sum(F.length("text"))).first()[0] or 0
        bits = min(max(BITS[0], math.ceil(math.log2(max(1, volume / 24)))), BITS[1])
    if not BITS[0] <= bits <= BITS[1]:
        raise ValueError("a bitmap has 2 ** 16 to 2 ** 29 bits")
    out, frequent, bucket = None, None, None
    for m in range(1, most_words + 1):
        last = m == most_words
        folder = common.shared_folder(spark, f"phrases-{m}")
        rows.mapInArrow(_pass(m, last, frequent, bucket, bits, least, slice_bytes), _RAW).write.parquet(f"{folder}/raw")
        raw = spark.read.schema(_RAW).parquet(f"{folder}/raw")
        summed = raw.where("segment is null").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("phrase").isNull() & (F.col("n") > 0))
        summed.select("lang", "phrase", F.when(F.col("phrase").isNull(), 0).otherwise(m).alias("size"), "n").write.parquet(f"{folder}/counts")
        counts = spark.read.schema("lang string, phrase string, size int, n long").parquet(f"{folder}/counts")
        out = counts if out is None else out.unionByName(counts)
        if not last:
            parts = counts.where("size > 0").select("lang", "phrase").mapInArrow(_bit_rows(bits), "segment int, at binary, many binary")
            frequent = spark.sparkContext.broadcast(bitmap(parts, bits, 1))
            bucket = spark.sparkContext.broadcast(bitmap(raw.where("segment is not null"), bits, least))
        common.remove(spark, f"{folder}/raw")
    return out


def _floor_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) for counts below 10 ** 14: both products are exact decimals of up to 38 digits (a is never above l or r)."""
    wide = lambda x: x.cast("decimal(14,0)")
    return F.call_function("div", (wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(8,0)")), (wide(left) * wide(right)))


def collocations(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, keep: int = KEEP, covered: int = 50, bits: int | None = None, slice_bytes: int = SLICE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``keep`` best phrases of 2 to ``most_words`` words."""
    spark = docs.sparkSession
    counts = phrase_counts(docs, most_words, least, bits, slice_bytes)
    phrases = counts.where("size > 0").select("lang", "phrase", "n")
    found = counts.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda x, y: F.array_join(F.slice("w", x, y), " ")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    side = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    cuts = cuts.withColumn("score", _floor_score(F.col("a"), F.col("l"), F.col("r")))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.a", "x.l", "x.r", "x.score")
    longer = found.where("size > 2").withColumn("long", F.explode(F.sequence(F.lit(2), F.col("size") - 1))).withColumn("from", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("long") + 1)))
    cover = longer.groupBy("lang", part(F.col("from"), F.col("long")).alias("phrase")).agg(F.max("a").alias("cover"))
    best = best.join(cover, ["lang", "phrase"], "left").where(F.col("cover").isNull() | (100 * F.col("cover") < covered * F.col("a"))).drop("cover")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(common.shuffle_parts(spark))).alias("salt")
    first = best.select("*", salt).withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= keep)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= keep)
    words = counts.where("size = 0").select("lang", "n")
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
