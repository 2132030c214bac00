"""Shared helpers: table access, shared folders, Arrow text buffers and word scanning."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch, so that a batch of long texts stays small next to an executor's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20
#: Bytes of text that a Python kernel looks at together; a little below a power of two, to which tables by place are rounded up.
SLICE_BYTES = (1 << 19) - (1 << 12)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by rows and bytes, for the kernels of this subpackage."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's, or one of our own in local mode where none is set (tests)."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="credence-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_released(spark: SparkSession):
    """The shuffle files of frames that are made and run inside go when their execution ends, not when the driver happens to
    collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared folder; nothing is created yet."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder below the shared one that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(counts: DataFrame, on: list[str], total: int, parts: int) -> DataFrame:
    """The keys of more than ``total / (2 * parts)`` rows, at most 2 * parts of them, with the number of ways to spread each;
    counts: the columns of ``on`` and __n."""
    limit = max(1, total // (2 * parts))
    return counts.where(F.col("__n") > limit).select(*on, F.ceil(F.col("__n") / limit).cast("int").alias("__ways"))


def spread_join(rows: DataFrame, side: DataFrame, on: list[str], parts: int | None = None, counts: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """Inner equi-join in which the rows of a hot key are dealt to several tasks, and the other side's rows of that key to each.

    ``counts`` (the key columns and __n) and ``total`` (at least the sum of __n) are found by an aggregation of ``rows``
    where they are not given. The hot keys are few by their definition, so they may be broadcast; all rows of both sides
    meet as in a plain join. Keys are not null."""
    parts = parts or shuffle_parts(rows.sparkSession)
    if counts is None:
        counts = cut(rows.groupBy(*on).agg(F.count("*").alias("__n")))
    if total is None:
        total = counts.agg(F.sum("__n")).first()[0] or 0
    found = hot_keys(counts, on, total, parts)
    few = found.collect()  # 2 * parts rows at most
    if not few:
        return rows.join(side, on)
    hot = rows.sparkSession.createDataFrame(few, found.schema)
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("__salt", F.when(F.col("__ways").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("__ways"))).cast("int")).drop("__ways")
    copied = side.join(F.broadcast(hot), on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__ways"), F.lit(1)) - 1))).drop("__ways")
    return dealt.join(copied, [*on, "__salt"]).drop("__salt")


def binary(text: str = "text"):
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a binary or string array (nulls as empty), starting at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Row ranges (a, b) of at most ``most`` bytes each; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


#: splitmix64 constants, fixed values.
_MIX_A, _MIX_B, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over uint64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


#: Two primes below 2**31, each with the number by which 2**31 exceeds it; fixed values.
PRIMES = ((2147483647, 1), (2147483629, 19))
#: Hash bases modulo the two primes, for independent families of hashes; fixed values.
BASES = ((1103515245, 1566083941), (1812433253, 1664525013))
_LOW31, _31 = np.uint64((1 << 31) - 1), np.uint64(31)
_BLOCK, _TABLE = 1 << 21, 1 << 21


def _reduce(x: np.ndarray, prime: int, over: int) -> np.ndarray:
    """x modulo the prime, for x < 2**63."""
    c = np.uint64(over)
    x = (x & _LOW31) + (x >> _31) * c
    x = (x & _LOW31) + (x >> _31) * c
    return np.minimum(x, x - np.uint64(prime))  # below the prime the difference wraps to something large


_tables: dict[tuple[int, int], np.ndarray] = {}


def _power_table(base: int, k: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) at least, modulo prime k."""
    prime, over = PRIMES[k]
    known = _tables.get((base, k))
    if known is None or len(known) < n:
        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate((out, _reduce(out * np.uint64(pow(base, len(out), prime)), prime, over)))
        _tables[base, k] = known = out
    return known


def _power(base: int, k: int, at: np.ndarray | slice, most: int) -> np.ndarray:
    """base**at modulo prime k; most: no exponent is above it. Beyond the table's bound two factors are looked up."""
    if most < _TABLE:
        return _power_table(base, k, most + 1)[at]
    prime, over = PRIMES[k]
    if isinstance(at, slice):
        at = np.arange(at.start, at.stop)
    return _reduce(_power_table(base, k, _TABLE)[at % _TABLE] * _power_table(pow(base, _TABLE, prime), k, most // _TABLE + 1)[at // _TABLE], prime, over)


class Prefix:
    """Prefix sums of a text's polynomials modulo two primes; ``family`` picks the bases."""

    def __init__(self, data: np.ndarray, family: int = 0):
        self.bases, self.sums = [b % p for b, (p, _) in zip(BASES[family], PRIMES)], []
        n, one = len(data), data.astype(np.uint64) + np.uint64(1)
        for k, base in enumerate(self.bases):
            s = np.zeros(n + 1, np.uint64)
            for a in range(0, n, _BLOCK):
                b = min(n, a + _BLOCK)
                np.cumsum(one[a:b] * _power(base, k, slice(a, b), b), out=s[a + 1 : b + 1])
                if a:
                    s[a + 1 : b + 1] += _reduce(s[a : a + 1], *PRIMES[k])
            self.sums.append(s)


def prefix_hash(data: np.ndarray, family: int = 0) -> Prefix:
    return Prefix(data, family)


def span_hash(s: Prefix, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span [start, end), wherever it stands: its polynomial modulo both primes, and its length."""
    out = np.zeros(len(start), np.uint64)
    for k, ((prime, over), base, sums) in enumerate(zip(PRIMES, s.bases, s.sums)):
        d = _reduce(sums[end] + np.uint64(prime << 31) - sums[start], prime, over)
        d = _reduce(d * _power(pow(base, -1, prime), k, start, len(sums)), prime, over)
        out |= d << np.uint64(31 * k)
    return mix(out + (end - start).astype(np.uint64) * _GOLD)


_ODD = np.uint64(0x2545F4914F6CDD1D)


def gram_hash(data: np.ndarray, gram: int) -> np.ndarray:
    """A fast hash of each ``gram`` bytes in a row, for sampling alone: different strings may well share it."""
    x = mix(data.astype(np.uint64) + _GOLD)
    width, out, done = 1, None, 0
    while True:  # hashes of runs of 1, 2, 4, ... bytes give that of the gram by its binary digits
        if gram & width:
            n = len(data) - done - width + 1
            out = x[done : done + n] if out is None else mix(out[:n] * _ODD + x[done : done + n])
            done += width
        if done == gram:
            return out
        x = x[: len(x) - width] * _ODD + x[width:]
        x ^= x >> np.uint64(29)
        width *= 2


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def space_table() -> np.ndarray:
    """True for the bytes that do not belong to a word of ``[^\\x20\\x09-\\x0D]+``."""
    t = np.zeros(256, bool)
    t[[32, 9, 10, 11, 12, 13]] = True
    return t


def alnum_gap_table() -> np.ndarray:
    """True for the bytes outside words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (text in lower case)."""
    t = np.zeros(256, bool)
    t[0x00:0x30] = t[0x3A:0x61] = t[0x7B:0x80] = True
    return t


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends and the number of words before each row (one more entry than rows); words do not cross rows."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~gap[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | first[1:n]
    a = np.flatnonzero(start)
    return a, np.flatnonzero(stop) + 1, np.searchsorted(a, offsets)


def list_array(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Values cut at bounds (one more than rows) as an Arrow list array."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))
