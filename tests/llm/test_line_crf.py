"""Marginals against enumeration, features against plain code, held-out accuracy, and the defined cases."""

import itertools
import os
import random
import zlib

import numpy as np
import pytest

from credence.llm import line_crf, queries

DATA = "/root/testdata/sf0.01"


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    sizes = [1, 5, 1, 7, 2, 9]
    first = np.concatenate(([0], np.cumsum(sizes)))
    score, start, step = rng.normal(0, 3, first[-1]), rng.normal(0, 1, 2), rng.normal(0, 2, (2, 2))
    good, pair = line_crf.marginals(score, first, start, step)
    for a, n in zip(first, sizes):
        total, one, two = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for y in itertools.product((0, 1), repeat=n):
            p = np.exp(start[y[0]] + sum(step[y[i - 1], y[i]] for i in range(1, n)) + sum(score[a + i] * y[i] for i in range(n)))
            total += p
            one += p * np.array(y)
            for i in range(1, n):
                two[i, y[i - 1], y[i]] += p
        assert np.allclose(good[a : a + n], one / total) and np.allclose(np.moveaxis(pair, 2, 0)[a : a + n], two / total)


def test_long_chains_against_a_loop():
    rng = np.random.default_rng(2)
    n = 50_000
    score, start, step = rng.normal(0, 20, n), np.zeros(2), np.array([[5.0, -5.0], [-9.0, 5.0]])
    good, pair = line_crf.marginals(score, np.array([0, n]), start, step)
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    a[0] = start + [0, score[0]]
    for i in range(1, n):
        a[i] = np.logaddexp(a[i - 1, 0] + step[0], a[i - 1, 1] + step[1]) + [0, score[i]]
    for i in range(n - 2, -1, -1):
        b[i] = np.logaddexp(step[:, 0] + b[i + 1, 0], step[:, 1] + score[i + 1] + b[i + 1, 1])
    m = a + b
    assert np.isfinite(pair).all() and np.allclose(good, 1 / (1 + np.exp(np.clip(m[:, 0] - m[:, 1], -700, 700))), atol=1e-6)


def plain_features(text):
    lines = text.split("\n")
    out = []
    for i, line in enumerate(lines):
        words = [w for w in line.translate(str.maketrans("\t\x0b\x0c\r", "    ")).split(" ") if w]
        n, c = max(1, len(words)), max(1, len(line))
        size = lambda w: len(w.encode())
        letters = max(1, sum(x.isascii() and x.isalpha() for x in line))
        up, low = (lambda x: "A" <= x <= "Z"), (lambda x: "a" <= x <= "z")
        symbols = "#*$%&|<>@^~=+_/\\[]{}`"
        share = lambda f: sum(map(f, line)) / c
        of = lambda f: sum(map(f, words)) / n
        row = [sum(map(up, line)) / letters, share(lambda x: "0" <= x <= "9"), share(lambda x: x in symbols), share(lambda x: x in "!?"), share(lambda x: x in ".,;:'\"()-"), share(lambda x: x > "\x7f"), share(lambda x: x in " \t\x0b\x0c\r")]
        row += [np.log1p(len(line)) / 5, np.log1p(len(words)) / 5, of(size) / 10, of(lambda w: size(w) <= 3), of(lambda w: up(w[0])), of(lambda w: up(w[0]) and not any(map(low, w)) and size(w) > 1), of(lambda w: any(x in symbols + "!?" for x in w))]
        row += [sum(a == b for a, b in zip(words, words[1:])) / n, (len(words) - len(set(words))) / n, float(bool(words) and line in lines[:i])]
        row += [float(bool(words) and words[-1][-1] in ".!?"), float(bool(words) and up(words[0][0])), float(not words), float(i == 0), float(i == len(lines) - 1)]
        out.append(row)
    return out


def test_features_against_plain_code():
    rng = random.Random(2)
    parts = ["The", "the", "ÇA", "a|b", "W!!", "1.", "\n", "\n\n", " ", "  ", "\t", "x\x0b", "é.", "?", "AB"]
    texts = ["", "\n", "one line.", *("".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(60))) for _ in range(60)), ""]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    x, chars, first = line_crf.line_features(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for t, a, b in zip(texts, first, first[1:]):
        assert chars[a:b].tolist() == [len(line) for line in t.split("\n")]
        assert np.allclose(x[a:b], plain_features(t), atol=1e-5), repr(t)


def test_bad_lines_inside_a_document(spark):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["the", "tion", "of", "area", "then", "city"]) for _ in range(rng.randrange(5, 15))) + "."
    bad = lambda: " ".join(rng.choice(["BUY", "NOW", "$$$", "%%%", "FREE"]) + "!!" for _ in range(rng.randrange(5, 15)))
    docs = [(i, "\n".join([good(), *(bad() if i % 3 == 0 else good() for _ in range(4)), good()])) for i in range(300)]
    labels = [(i, int(i % 3 != 0), 0) for i, _ in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = line_crf.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = line_crf.score(df, model, lines=True).collect()
    assert all((r.score >= 0.3) == (r.doc_id % 3 != 0) for r in rows)
    lines = np.array([r.line_good for r in rows if r.doc_id % 3 == 0])
    assert (lines[:, 1:5] < 0.5).mean() > 0.95 and (lines[:, [0, 5]] > 0.5).mean() > 0.8


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_held_out_accuracy(spark):
    import pandas as pd

    got = queries.op11_line_crf(spark, DATA).toPandas()
    labels = pd.read_parquet(f"{DATA}/labels.parquet")
    assert len(got) == len(pd.read_parquet(f"{DATA}/documents.parquet", columns=["doc_id"])) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    x = got[got.held_out].merge(labels, on="doc_id")
    assert (x.predicted == x.quality).mean() > 0.97 and (x.predicted == (x.score >= 0.3)).all()


def test_cases(spark):
    schema = "doc_id long, text string, score double, line_good int, label string"
    docs = [(1, "Good text here.\nMore of it.", None, 1, "x"), (2, None, None, 1, "x"), (3, "", None, 1, "x"), (None, "Good text here.", 0.1, 1, "x"), (None, "Good text here.", 0.1, 1, "x"), (4, "word " * 200_000 + "\n" * 5000, None, 1, "x")]
    df = spark.createDataFrame(docs, schema)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert line_crf.train(df, none) is None
    assert [r.score for r in line_crf.score(df, None).collect()] == [0.5] * 6
    some = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (7, 1), (None, 1), (3, 0), (3, 1), (4, None)], "doc_id long, quality int")
    rows = line_crf.score(df, line_crf.train(df, some), lines=True).collect()
    assert all(0 <= r.score <= 1 for r in rows) and rows[1].score == rows[2].score and rows[3].score == rows[4].score
    assert [len(r.line_good) for r in rows] == [2, 1, 1, 1, 1, 5001]
    empty = spark.createDataFrame([], schema)
    assert line_crf.score(empty, line_crf.train(empty, none)).collect() == []
