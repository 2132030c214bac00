"""Collocations against plain counting, in small slices and with colliding buckets, and the defined cases."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from credence.llm import phrases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, most_words, least, keep, covered):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        cut = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = any(g == lang and len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in found.items())
        if not inside:
            out.append((lang, " ".join(p), a, f[lang, p[: cut[1]]], f[lang, p[cut[1] :]], n[lang], cut[0]))
    result = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        result += [(lang, i + 1, *x[1:]) for i, x in enumerate(own[:keep])]
    return sorted(result)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(g, t, 1, "x") for g, t in rows], "lang string, text string, n int, phrase string").repartition(3)
    return sorted(map(tuple, phrases.collocations(df, **kw).collect()))


def corpus(seed, docs, length):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "The", "é", "x\x1c", "Ça", "ß", "b-c", "(d)", "new", "york", "city", "a"]
    gaps = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", " ;", "\r\n", "\x0b", "!?"]
    one = lambda: rng.choice(["new york city", "the city of", *vocabulary]) + rng.choice(gaps)
    return [(rng.choice(["en", "fr", "", None]), "".join(one() for _ in range(rng.randrange(length)))) for _ in range(docs)]


def test_against_plain_counts(spark):
    rows = corpus(1, 40, 120) + [("en", None), ("en", ""), ("fr", " \t\n"), ("xx", "one"), ("en", "new york city " * 30)]
    want = plain(rows, 3, 5, 25, 50)
    assert len(want) > 40
    assert run(spark, rows, least=5, keep=25) == want
    assert run(spark, rows, least=5, keep=25, slice_bytes=100, bits=16) == want  # texts are cut between words


def test_four_words_and_other_limits(spark):
    rows = corpus(2, 15, 150)
    assert run(spark, rows, most_words=4, least=3, keep=1000, covered=70, slice_bytes=333) == plain(rows, 4, 3, 1000, 70)


def test_buckets_that_collide_cost_no_rows(spark, monkeypatch):
    monkeypatch.setattr(phrases.Bitmap, "has", lambda self, h: np.ones(len(h), bool))
    rows = corpus(3, 20, 60)
    assert run(spark, rows, least=4) == plain(rows, 3, 4, 2000, 50)


def test_pruning_is_by_buckets_and_parts():
    words = np.arange(5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    made = phrases._bucket_rows(np.concatenate((words, words[:10], words[:10])), 20, 3)
    rows = list(phrases._bitmap_rows(3)([made.select(["segment", "at", "many"])]))
    bits = phrases.Bitmap(20, [(r["segment"], r["bits"]) for b in rows for r in b.to_pylist()])
    assert bits.has(words[:10]).all() and bits.has(words).sum() < 30


def test_windows_cut_between_words():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["ab", "c", " ", ",", "  ", "defgh"]) for _ in range(rng.randrange(1, 80))).encode()
        data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        starts = []
        for _, part, bounds, own in phrases.windows(data, offsets, 2, 7):
            raw = part.tobytes()
            words = [(m.start(), m[0]) for m in re.finditer(rb"[^ ,]+", raw)]
            starts += [w for at, w in words if at < own]
            mine = [i for i, (at, _) in enumerate(words) if at < own]
            rest = re.findall(rb"[^ ,]+", text)[len(starts) :]
            if mine:  # up to two words follow the last own one
                assert [w for _, w in words[mine[-1] + 1 :]][:2] == rest[:2]
        assert starts == re.findall(rb"[^ ,]+", text)


def test_exact_beyond_64_bits(spark):
    values = [(10**13, 3 * 10**13, 7 * 10**13), (99_999_999_999, 10**11, 10**11 + 1), (3_037_000_500, 3_037_000_500, 3_037_000_501)]
    got = spark.createDataFrame(values, "a long, l long, r long").select(phrases._floor_score(F.col("a"), F.col("l"), F.col("r")).alias("s"), "a").collect()
    assert sorted((r.a, r.s) for r in got) == sorted((a, 1_000_000 * a * a // (x * y)) for a, x, y in values)


def test_empty_table(spark):
    assert run(spark, [], least=2) == [] == run(spark, [(None, None), ("en", "")], least=2)
