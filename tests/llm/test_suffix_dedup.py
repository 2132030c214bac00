import hashlib
import random

import numpy as np
import pytest

from credence.llm import suffix_dedup


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for x in raw:
        for p in range(len(x) - length + 1):
            seen[x[p : p + length]] = seen.get(x[p : p + length], 0) + 1
    out = []
    for x in raw:
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] > 1:
                gone[p : p + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        out.append((len(x), int(gone.sum()), list(zip(edge[::2].tolist(), edge[1::2].tolist())), bytes(b for b, g in zip(x, gone) if not g)))
    return out


def test_kernel_against_brute_force():
    rng = random.Random(1)
    for length in (1, 2, 5, 9, 30):
        for _ in range(15):
            base = "".join(rng.choice("abé\0") for _ in range(80))
            contents = []
            for _ in range(rng.randrange(1, 7)):
                a = rng.randrange(60)
                contents.append((base[a : a + rng.randrange(60)] + "".join(rng.choice("ab") for _ in range(rng.randrange(30)))).encode())
            contents += [b"a" * 50, b""]
            got = suffix_dedup.repeated(contents, length)
            count = {}
            for c in contents:
                for p in range(len(c) - length + 1):
                    count[c[p : p + length]] = count.get(c[p : p + length], 0) + 1
            for c, mask in zip(contents, got):
                assert mask.tolist() == [count[c[p : p + length]] > 1 for p in range(len(c) - length + 1)]


def corpus():
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh é日\n") for _ in range(n))
    passage, copy = text(90), text(300)
    rows = [text(rng.randrange(150)) for _ in range(25)]
    rows += [text(rng.randrange(40)) + passage[rng.randrange(20) : rng.randrange(60, 90)] + text(rng.randrange(40)) for _ in range(40)]
    for _ in range(15):
        p = rng.randrange(280)
        rows.append(copy[:p] + "#" + copy[p + rng.randrange(3) :])
    return rows + [copy] * 4 + [None, "", "x" * 3000, "ab" * 700, "short"]


@pytest.mark.parametrize("length,gram,most", [(40, None, 10**6), (40, 11, 500), (64, 32, 2000), (7, 3, 10**6)])
def test_against_brute_force(spark, length, gram, most):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, kept string, id int").repartition(4)
    small = dict(length=length, gram=gram, parts=4, bucket_bytes=min(most, 3000), bucket_most=most)
    got = {r.doc_id: r for r in suffix_dedup.dedup(df, **small).collect()}
    want = brute(texts, length)
    for i, w in enumerate(want):
        assert (got[i].n_bytes, got[i].n_removed, [(s.start, s.end) for s in got[i].spans], bytes(got[i].kept)) == w
    if most == 500:
        digest = {r.doc_id: r for r in suffix_dedup.dedup(df, output="digest", **small).collect()}
        assert all((digest[i].n_spans, digest[i].kept_sha256) == (len(w[2]), hashlib.sha256(w[3]).hexdigest()) for i, w in enumerate(want))


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "abc" * 30)] * 2 + [(None, None)], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix_dedup.dedup(df, length=20).collect()) == [0, 90, 90]
    assert suffix_dedup.dedup(df.where("false"), length=20).count() == 0


def test_repeats_inside_one_segment(spark):
    """Text with a short period has one anchor for all its strings; nothing else in the table repeats it."""
    rng = random.Random(5)
    line = "".join(rng.choice("abcdefgh \n") for _ in range(250))
    texts = ["abc" * 200, line * 3, line[:200] + line * 2, line[::-1] * 2, "".join(rng.choice("abcdefgh") for _ in range(900)), ("xy" * 300)[:401]]
    for period in (17, 128, 145, 200, 272, 273, 274, 300):
        body = "".join(rng.choice("klmnopqr é") for _ in range(period))
        texts.append((body * 6)[: rng.randrange(400 + period, 1400)])
    for length in (400, 130):
        for some in [[t] for t in texts[:2]] + [texts]:
            df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
            got = {r.doc_id: r for r in suffix_dedup.dedup(df, length=length, parts=2).collect()}
            assert [(got[i].n_bytes, got[i].n_removed, [(s.start, s.end) for s in got[i].spans], bytes(got[i].kept)) for i in range(len(some))] == brute(some, length)
    assert suffix_dedup.segments(np.frombuffer(texts[4].encode(), np.uint8), np.array([0, 900]), 400, 128)[5].sum() == 0


def test_hot_anchor_and_hash(spark):
    """A third of all rows hold one passage, in copies and in variants; Thue-Morse strings are told apart."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, thue = text(120), ["".join("ab"[(bin(i).count("1") + k) & 1] for i in range(1024)) for k in (0, 1)]
    texts = [text(60) + passage + text(rng.randrange(40)) for _ in range(40)] + [passage] * 40 + [text(200) for _ in range(120)] + [thue[0] + text(5), thue[1]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in suffix_dedup.dedup(df, length=64, parts=8).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 64)
    got = {r.doc_id: r.n_removed for r in suffix_dedup.dedup(df, length=1024, parts=8).collect()}
    assert got == {i: 0 for i in range(len(texts))}
