"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are shares of character classes and of kinds of words, its repeats, its ends
and place, and the same of the line before and the line after it; transitions tie neighbouring labels. Labels are known for
documents only, so lines are labelled in rounds: all lines take their document's label and fit a model of lines by
themselves; then, in bad documents, lines that the model calls good become good (the worst line stays bad), and the field
is fitted to that, twice. A document's goodness is the mean of its lines' forward-backward marginals, weighted by length in
characters; a logistic curve that is fitted on the same sample turns it into a score.

Forward and backward messages are prefix and suffix products of 2 x 2 matrices, by doubling distances, so a batch of
documents is done together and a document of n lines takes log n steps. A document's first matrix has equal rows, which
makes the product forget the document before it.

The fit takes a bounded sample: of each label the PER_LABEL labelled ids with the smallest hashes, and of these the
documents with at most MOST_LINES lines and MOST_BYTES bytes. It is fitted on the driver; scoring is one pass without a shuffle.

Defined cases: null text counts as empty; an empty text is one empty line, as are all texts between line ends without
characters; rows that are equal get equal scores; ids with labels that disagree are not learned from; without labels to learn
from all documents get 0.5; an empty table gives an empty result; very long texts are rows like others; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The sample: documents of each label, and the lines and bytes that one may have.
PER_LABEL, MOST_LINES, MOST_BYTES = 2000, 200, 1 << 16
ROUNDS, STEPS, RATE, PENALTY = 2, 150, 0.1, 1e-3

_SPACE = common.space_table()


def _of(chars: str | bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[np.frombuffer(chars if isinstance(chars, bytes) else chars.encode(), np.uint8)] = True
    return t


_UPPER, _LOWER, _DIGIT = _of(bytes(range(65, 91))), _of(bytes(range(97, 123))), _of("0123456789")
_SYMBOL, _SHOUT, _POINT, _STOP = _of("#*$%&|<>@^~=+_/\\[]{}`"), _of("!?"), _of(".,;:'\"()-"), _of(".!?")
_HIGH, _START = _of(bytes(range(128, 256))), ~_of(bytes(range(128, 192)))
NAMES = ["upper", "digit", "symbol", "shout", "point", "high", "space", "n_chars", "n_words", "word_size", "short", "capital", "caps", "odd", "stutter", "repeat", "known_line", "stop", "begins", "empty", "first", "last"]


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and the number of lines before each row (one more than rows); each row has one at least."""
    brk = np.flatnonzero(data == 10)
    row = np.searchsorted(offsets, brk, side="right") - 1
    starts = np.concatenate((offsets[:-1], brk + 1))
    rows = np.concatenate((np.arange(len(offsets) - 1), row))
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    first = np.searchsorted(rows, np.arange(len(offsets)))
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[first[1:] - 1] = offsets[1:]
    return starts, ends, first


def _sums(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[ends] - total[starts]


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x NAMES) of all lines of all rows, their lengths in characters, and each row's first line."""
    starts, ends, first = lines_of(data, offsets)
    n = len(starts)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    chars = _sums(_START[data], starts, ends)
    size = np.maximum(chars, 1)
    out = np.zeros((n, len(NAMES)), np.float32)
    letters = np.maximum(_sums((_UPPER | _LOWER)[data], starts, ends), 1)
    out[:, 0] = _sums(_UPPER[data], starts, ends) / letters
    for k, table in enumerate((_DIGIT, _SYMBOL, _SHOUT, _POINT, _HIGH & _START | _of(bytes(range(192, 256))), _SPACE), 1):
        out[:, k] = _sums(table[data], starts, ends) / size
    w, e, _ = common.words(data, offsets, _SPACE)
    at = np.searchsorted(starts, w, side="right") - 1  # where empty texts share a start with the text behind them, the last has the words
    words = np.bincount(at, minlength=n)
    most = np.maximum(words, 1)
    of = lambda mask: np.bincount(at, mask, minlength=n) / most
    out[:, 7], out[:, 8] = np.log1p(chars) / 5, np.log1p(words) / 5
    if len(w):
        prefix = common.prefix_hash(data)
        h, long = common.span_hash(prefix, w, e), e - w
        out[:, 9], out[:, 10] = of(long) / 10, of(long <= 3)
        capital, lower = _UPPER[data[w]], _sums(_LOWER[data], w, e)
        out[:, 11], out[:, 12], out[:, 13] = of(capital), of(capital & (lower == 0) & (long > 1)), of(_sums((_SYMBOL | _SHOUT)[data], w, e) > 0)
        same = np.zeros(len(w), bool)
        same[1:] = (h[1:] == h[:-1]) & (at[1:] == at[:-1])
        order = np.lexsort((h, at))
        again = np.zeros(len(w), bool)
        again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (at[order[1:]] == at[order[:-1]])
        out[:, 14], out[:, 15] = of(same), of(again)
        lines = common.span_hash(prefix, starts, ends)
        order = np.lexsort((lines, row))
        again = np.zeros(n, bool)
        again[order[1:]] = (lines[order[1:]] == lines[order[:-1]]) & (row[order[1:]] == row[order[:-1]]) & (words[order[1:]] > 0)
        out[:, 16] = again
        last_word = np.zeros(n, np.int64)
        last_word[at] = np.arange(len(w))
        has = words > 0
        out[has, 17] = _STOP[data[e[last_word[has]] - 1]]
        out[has, 18] = _UPPER[data[w[np.searchsorted(at, np.flatnonzero(has))]]]
    out[:, 19] = words == 0
    out[first[:-1], 20] = 1
    out[first[1:] - 1, 21] = 1
    return out, chars, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and of the line after (zeros beyond a document's ends)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]], after[first[1:] - 1] = 0, 0
    return np.concatenate((x, before, after), axis=1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices (2, 2, n), scaled so that each largest entry is 1."""
    m = a[:, 0, None] * b[None, 0] + a[:, 1, None] * b[None, 1]
    return m / m.max(axis=(0, 1))


def marginals(score: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line and P(label before, label), 2 x 2 x lines, of each line but the first of its row (zeros there).

    score: log-odds of good by the line's features; start (2) and step (2 x 2): log-potentials of a row's first label and of transitions."""
    n = len(score)
    m = np.repeat(step[:, :, None], n, axis=2)
    m[:, :, first[:-1]] = np.broadcast_to(start, (2, 2))[:, :, None]
    m[:, 1] += score
    m = np.exp(m - m.max(axis=(0, 1)))
    ahead, back, d = m, m, 1
    while d < int(np.diff(first).max(initial=1)):
        ahead = np.concatenate((ahead[:, :, :d], _product(ahead[:, :, :-d], ahead[:, :, d:])), axis=2)
        back = np.concatenate((_product(back[:, :, :-d], back[:, :, d:]), back[:, :, -d:]), axis=2)
        d *= 2
    alpha = ahead.sum(axis=0)
    alpha /= alpha.sum(axis=0)
    beta = np.ones((2, n))
    beta[:, :-1] = back[:, :, 1:].sum(axis=1)
    beta[:, first[1:] - 1] = 1
    beta /= beta.sum(axis=0)
    good = alpha * beta
    pair = np.zeros((2, 2, n))
    pair[:, :, 1:] = alpha[:, None, :-1] * m[:, :, 1:] * beta[None, :, 1:]
    pair[:, :, first[:-1]] = 0
    total = pair.sum(axis=(0, 1))
    return good[1] / np.maximum(good.sum(axis=0), 1e-300), np.divide(pair, total, out=pair, where=total > 0)


class Model:
    """Weights of the field, and the curve from goodness to score."""

    def __init__(self, mean, scale, weights, start, step, curve):
        self.mean, self.scale, self.weights, self.start, self.step, self.curve = mean, scale, weights, start, step, curve

    def good(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        odds = ((x - self.mean) / self.scale) @ self.weights[1:] + self.weights[0]
        return marginals(np.clip(odds, -30, 30), first, self.start, self.step)[0]

    def score(self, x: np.ndarray, chars: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each document's score and each line's P(good)."""
        good = self.good(with_neighbours(x, first), first)
        return _sigmoid(self.curve[0] + self.curve[1] * goodness(good, chars, first)), good


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def goodness(good: np.ndarray, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean P(good) of each document's lines, weighted by characters (an empty line counts as one)."""
    weight = np.maximum(chars, 1)
    return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def _ascend(gradient, size: int, steps: int = STEPS) -> np.ndarray:
    """Parameters by Adam, with a step that shrinks to zero."""
    p, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for k in range(1, steps + 1):
        g = gradient(p)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p += RATE * (1 - k / (steps + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return p


def fit(features: np.ndarray, chars: np.ndarray, first: np.ndarray, label: np.ndarray) -> Model:
    """A model from the lines of sampled documents; label: each document's, 0 or 1."""
    x = with_neighbours(features.astype(np.float64), first)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-6] = 1
    z = np.concatenate((np.ones((len(x), 1)), (x - mean) / scale), axis=1)
    row, d = np.repeat(np.arange(len(label)), np.diff(first)), z.shape[1]
    y = label[row].astype(np.float64)
    own = z[:, : 1 + features.shape[1]]  # neighbours would tell the label of ordinary lines, too
    good = _sigmoid(own @ _ascend(lambda p: own.T @ (y - _sigmoid(own @ p)) / len(row) - PENALTY * p, own.shape[1]))
    # from here on both labels weigh alike, whatever their shares of the sample
    doc_weight = len(label) / (2 * np.maximum(np.bincount(label, minlength=2), 1))[label]
    for _ in range(ROUNDS):
        worst = np.minimum.reduceat(good, first[:-1])[row]
        y = np.where(label[row] == 1, 1, (good > 0.5) & (good > worst)).astype(np.int64)
        seen = np.zeros((2, 2, len(y)))
        seen[y[:-1], y[1:], np.arange(1, len(y))] = 1
        seen[:, :, first[:-1]] = 0
        begin = np.stack((1 - y[first[:-1]], y[first[:-1]]), axis=1)
        by_row = doc_weight[row]

        def gradient(p):
            p_good, pair = marginals(np.clip(z @ p[:d], -30, 30), first, p[d : d + 2], p[d + 2 :].reshape(2, 2))
            at = p_good[first[:-1]]
            g = [z.T @ (by_row * (y - p_good)), (doc_weight[:, None] * (begin - np.stack((1 - at, at), axis=1))).sum(axis=0), ((seen - pair) @ by_row).ravel()]
            return np.concatenate(g) / len(row) - PENALTY * p

        p = _ascend(gradient, d + 6)
        good = marginals(np.clip(z @ p[:d], -30, 30), first, p[d : d + 2], p[d + 2 :].reshape(2, 2))[0]
    model = Model(mean, scale, p[:d], p[d : d + 2], p[d + 2 :].reshape(2, 2), np.zeros(2))
    g = goodness(good, chars, first) - 0.5
    a = _ascend(lambda q: np.array([(doc_weight * (e := label - _sigmoid(q[0] + 10 * q[1] * g))).sum(), 10 * (doc_weight * e * g).sum()]) / len(label) - PENALTY * q, 2)
    model.curve = np.array([a[0] - 5 * a[1], 10 * a[1]])
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that labels are not learned from: the CRC of the id as text leaves 0 when divided by 5 (a null id counts as empty)."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _sampled(batches):
    for batch in batches:
        data, offsets = common.buffers(batch.column(1))
        for a, b in common.slices(offsets):
            x, chars, first = line_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            flat = x.astype(np.float32).ravel()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), common.list_array(flat, first * len(NAMES)), common.list_array(chars, first)], names=["label", "x", "chars"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL) -> Model | None:
    """The model of a bounded sample of labelled documents that are not held out; None if there are none."""
    common.small_batches(docs.sparkSession)
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc_id", "label")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = known.where("label = 0").orderBy(*order).limit(per_label).unionByName(known.where("label = 1").orderBy(*order).limit(per_label))
    text = common.binary()
    short = (F.octet_length("text") <= MOST_BYTES) & (F.length(F.translate("text", "\n", "")) > F.length("text") - MOST_LINES) | F.col("text").isNull()
    rows = docs.where(short).select("doc_id", text.alias("text")).join(F.broadcast(some), "doc_id")  # some: 2 * per_label rows at most
    # rows that share an id are as many as there are; one of each is enough
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text")
    got = rows.mapInArrow(_sampled, "label int, x array<float>, chars array<long>").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.label, len(r.x), r.x))
    chars = np.concatenate([np.array(r.chars) for r in got])
    x = np.concatenate([np.array(r.x, np.float32) for r in got]).reshape(-1, len(NAMES))
    return fit(x, chars, np.concatenate(([0], np.cumsum([len(r.chars) for r in got]))), np.array([r.label for r in got]))


def _scored(model, lines: bool):
    def run(batches):
        m = model.value
        for batch in batches:
            data, offsets = common.buffers(batch.column(1))
            for a, b in common.slices(offsets):
                x, chars, first = line_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if m is None:
                    score, good = np.full(b - a, 0.5), np.full(len(chars), 0.5)
                else:
                    score, good = m.score(x, chars, first)
                out = [batch.column(0).slice(a, b - a), pa.array(score)]
                yield pa.RecordBatch.from_arrays(out + [common.list_array(good, first)] * lines, names=["doc_id", "score"] + ["line_good"] * lines)

    return run


def score(docs: DataFrame, model: Model | None, lines: bool = False) -> DataFrame:
    """doc_id and score of each row; with ``lines`` also each line's P(good)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.binary().alias("text"))
    return rows.mapInArrow(_scored(spark.sparkContext.broadcast(model), lines), "doc_id long, score double" + ", line_good array<double>" * lines)
