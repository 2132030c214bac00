"""Line dedup by winnowing over line hashes.

A document's lines are its ``\\n``-split lines with a word in them (blank lines have no hash). Every ``gram``
consecutive lines have a hash, and of every ``window`` consecutive grams the smallest hash (the last one of equals) is a
fingerprint with its position, so that two documents with ``min_lines`` = ``gram + window - 1`` or more common
consecutive lines share a fingerprint at the same place of the common run. With ``min_words``, lines and pairs of lines with
that many words are fingerprints by themselves too.

Fingerprints are counted by Spark, and only positions whose fingerprint occurs again go on. There a match is extended both
ways: up and down to each run of ``min_lines`` lines that holds the fingerprint (and to the line or pair of ``min_words``
words). These runs are joined with the first position, by (doc_id, text hash, line), of an equal run; what has an earlier
one is a later repeat. Overlapping and touching repeats of a document form its deleted spans, with the blank lines inside
them. As each run looks for its own first position, a line is deleted if and only if it lies in ``min_lines`` lines, or
in one or two lines with ``min_words`` words, that also stand somewhere earlier: longer repeats consist of such runs. No text
and no list of a document's lines meets another document's; all joins are on narrow rows, hot keys are dealt to several
tasks, and a document's own matches are as many as its lines.

Lines are compared by two independent hashes modulo primes, 124 bits together. Defined cases: null text stays null and
loses nothing; an overlapping repeat inside one document counts as a later run too; rows with equal doc_id and text are
the same document and lose the same lines; a null doc_id comes first; an empty table gives an empty result; other columns
pass through (those named n_lines, spans and n_removed are replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST = -(1 << 63)
#: A repeat of so many words is deleted by the queries, however few lines it has.
MIN_WORDS = 50
_SPACE = common.space_table()


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the window minima, the last of equal ones."""
    n = len(grams)
    if n == 0:
        return np.zeros(0, np.int64)
    w = min(window, n)
    seen = np.lib.stride_tricks.sliding_window_view(grams, w)
    return np.unique(np.arange(n - w + 1) + (w - 1) - np.argmin(seen[:, ::-1], axis=1))


def line_hashes(data: np.ndarray, offsets: np.ndarray):
    """For all rows: both hashes of the lines with a word, their line numbers in the row, their words, and bounds by row."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return [z.view(np.uint64)] * 2, z, z, np.zeros(len(offsets), np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero((np.concatenate(([False], data == 10)) | first)[:n])
    row = np.searchsorted(offsets, starts, side="right") - 1
    ends = np.append(starts[1:], n)
    ends = np.where((ends < offsets[row + 1]) | ((ends == offsets[row + 1]) & (data[ends - 1] == 10)), ends - 1, ends)
    number = np.arange(len(starts)) - np.searchsorted(starts, offsets[row])
    begun = np.concatenate(([0], np.cumsum(~_SPACE[data] & np.concatenate(([True], _SPACE[data[:-1]])))))
    # a row's first word may follow the last one of the row before without a space
    own = (starts > 0) & ~_SPACE[data[starts]] & ~_SPACE[data[np.maximum(starts - 1, 0)]]
    words = begun[ends] - begun[starts] + own
    full = words > 0
    hashes = [common.span_hash(common.prefix_hash(data, family), starts[full], ends[full]) for family in (0, 1)]
    return hashes, number[full], words[full], np.searchsorted(row[full], np.arange(len(offsets)))


def run_hash(h: np.ndarray, lines: int) -> np.ndarray:
    """A hash of each ``lines`` consecutive lines."""
    out = np.full(max(0, len(h) - lines + 1), lines, np.uint64)
    for k in range(lines):
        out = common.mix(out * np.uint64(3) + h[k : k + len(out)])
    return out


def _long(words: np.ndarray, lines: int, min_words: int | None) -> np.ndarray:
    """Where ``lines`` consecutive lines have ``min_words`` words together."""
    total = np.concatenate(([0], np.cumsum(words)))
    return np.flatnonzero(total[lines:] - total[:-lines] >= min_words) if min_words is not None and len(total) > lines else np.zeros(0, np.int64)


def _lines(gram: int, window: int, min_words: int | None):
    """Each document's lines and fingerprints."""

    def run(batches):
        for batch in batches:
            data, offsets = common.buffers(batch.column(2))
            for a, b in common.slices(offsets):
                (h, o), number, words, bounds = line_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                hashes, at, counts = [], [], np.zeros(b - a + 1, np.int64)
                for i in range(b - a):
                    own = h[bounds[i] : bounds[i + 1]]
                    g = run_hash(own, gram)
                    p = winnow(g, window)
                    hashes.append(g[p])
                    at.append(p)
                    for k in (1, 2):
                        p = _long(words[bounds[i] : bounds[i + 1]], k, min_words)
                        hashes.append(common.mix(run_hash(own, k)[p] + np.uint64(k)))
                        at.append(p)
                    counts[i + 1] = sum(map(len, at[-3:]))
                counts = np.cumsum(counts)
                kept = [common.list_array(x, bounds) for x in (h.view(np.int64), o.view(np.int64), number.astype(np.int32), words.astype(np.int32))]
                prints = [common.list_array(np.concatenate(hashes).view(np.int64), counts), common.list_array(np.concatenate(at).astype(np.int32), counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *kept, *prints], names=["id", "uid", "lines", "others", "numbers", "words", "prints", "places"])

    return run


def matched_runs(h: np.ndarray, o: np.ndarray, words: np.ndarray, places: np.ndarray, gram: int, min_lines: int, min_words: int | None):
    """(hash, other hash, first line, lines) of the runs around the places of repeated fingerprints."""
    out = []
    at = (places[:, None] + np.arange(gram - min_lines, 1)).ravel()
    for lines, found in ((min_lines, at), *((k, np.intersect1d(places, _long(words, k, min_words))) for k in (1, 2))):
        found = np.unique(found[(found >= 0) & (found + lines <= len(h))])
        if len(found):
            out.append((run_hash(h, lines)[found], run_hash(o, lines)[found], found, np.full(len(found), lines)))
    return [np.concatenate(x) for x in zip(*out)] if out else None


def _extend(gram: int, min_lines: int, min_words: int | None):
    def run(batches):
        for batch in batches:
            cols = [batch.column(k) for k in range(6)]
            for i in range(batch.num_rows):
                h, o, words, places = (np.asarray(cols[k][i].values) for k in (2, 3, 4, 5))
                runs = matched_runs(h.view(np.uint64), o.view(np.uint64), words.astype(np.int64), np.unique(places).astype(np.int64), gram, min_lines, min_words)
                if runs is not None:
                    n = len(runs[0])
                    same = [pa.array(np.full(n, c[i].as_py(), np.int64)) for c in cols[:2]]
                    yield pa.RecordBatch.from_arrays([pa.array(runs[0].view(np.int64)), pa.array(runs[1].view(np.int64)), *same, pa.array(runs[2].astype(np.int32)), pa.array(runs[3].astype(np.int32))], names=["h", "o", "id", "uid", "place", "n"])

    return run


def _join_up(batches):
    """The later runs of each document laid together, as spans of line numbers."""
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            number, found = np.asarray(batch.column(2)[i].values), batch.column(3)[i].values
            change = np.zeros(len(number) + 1, np.int64)
            place, n = np.asarray(found.field(0)), np.asarray(found.field(1))
            np.add.at(change, place, 1)
            np.add.at(change, place + n, -1)
            edge = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(change) > 0).astype(np.int8)))))
            out.append([{"start": int(number[a]), "end": int(number[b - 1]) + 1} for a, b in zip(edge[::2], edge[1::2])])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["id", "uid", "spans"])


def removed_spans(keyed: DataFrame, gram: int = 2, window: int = 2, min_words: int | None = None) -> DataFrame:
    """id, uid and the line spans [start, end) to delete, for documents that lose lines; keyed: id, uid, text."""
    common.small_batches(keyed.sparkSession)
    min_lines, parts = gram + window - 1, common.shuffle_parts(keyed.sparkSession)
    kind = "id long, uid long, lines array<long>, others array<long>, numbers array<int>, words array<int>, prints array<long>, places array<int>"
    lines = common.cut(keyed.select("id", "uid", common.binary().alias("text")).mapInArrow(_lines(gram, window, min_words), kind))
    prints = lines.select("id", "uid", F.explode(F.arrays_zip("prints", "places")).alias("x")).select("id", "uid", F.col("x.prints").alias("print"), F.col("x.places").alias("place"))
    where = F.struct("id", "uid", "place")
    again = common.cut(prints.groupBy("print").agg(F.count("*").alias("__n"), F.min(where).alias("a"), F.max(where).alias("b")).where("a <> b").select("print", "__n"))
    total = again.agg(F.sum("__n")).first()[0] or 0
    places = common.spread_join(prints, again.select("print"), ["print"], parts, again, total).groupBy("id", "uid").agg(F.collect_set("place").alias("places"))
    own = lines.dropDuplicates(["id", "uid"])
    held = own.select("id", "uid", "lines", "others", "words").join(places, ["id", "uid"])
    runs = common.cut(held.mapInArrow(_extend(gram, min_lines, min_words), "h long, o long, id long, uid long, place int, n int"))
    origin = common.cut(runs.groupBy("h", "o", "n").agg(F.count("*").alias("__n"), F.min(where).alias("first")).where("__n > 1"))
    total = origin.agg(F.sum("__n")).first()[0] or 0
    later = common.spread_join(runs, origin.drop("__n"), ["h", "o", "n"], parts, origin.select("h", "o", "n", "__n"), total).where(where != F.col("first"))
    found = later.groupBy("id", "uid").agg(F.collect_list(F.struct("place", "n")).alias("found"))
    return own.select("id", "uid", "numbers").join(found, ["id", "uid"]).mapInArrow(_join_up, "id long, uid long, spans array<struct<start:long,end:long>>")


def dedup(docs: DataFrame, gram: int = 2, window: int = 2, min_words: int | None = None) -> DataFrame:
    """``docs`` with the kept text and n_lines (lines of the old text), spans (deleted line ranges) and n_removed (lines).

    What goes are later repeats of ``gram + window - 1`` lines and, if given, of one or two lines with ``min_words`` words."""
    docs = docs.drop("n_lines", "spans", "n_removed")
    names = docs.columns
    keyed = docs.withColumns({"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)), "uid": F.xxhash64("text")}) if not {"id", "uid"} & set(names) else None
    if keyed is None:  # extra columns with our names step aside
        inner = docs.select(*(F.col(c).alias(f"{c}__kept" if c in ("id", "uid") else c) for c in names))
        out = dedup(inner, gram, window, min_words)
        return out.select(*(F.col(f"{c}__kept").alias(c) if c in ("id", "uid") else F.col(c) for c in names), "n_lines", "spans", "n_removed")
    spans = removed_spans(keyed, gram, window, min_words)
    out = keyed.join(spans, ["id", "uid"], "left")
    split = F.split("text", "\n")
    end = lambda k: F.when(k > 0, F.get("spans", k - 1)["end"]).otherwise(0).cast("int")
    start = lambda k: F.coalesce(F.get("spans", k)["start"], F.size(split)).cast("int")
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("spans")), lambda k: F.slice(split, end(k) + 1, start(k) - end(k))))
    out = out.withColumns({"n_lines": F.coalesce(F.size(split), F.lit(0)).cast("long"), "__kept": F.when(F.col("spans").isNotNull(), kept)})
    out = out.withColumns({"n_removed": F.coalesce(F.col("n_lines") - F.size("__kept"), F.lit(0).cast("long")), "text": F.when(F.col("spans").isNotNull(), F.array_join("__kept", "\n")).otherwise(F.col("text"))})
    return out.select(*names, "n_lines", "spans", "n_removed")
