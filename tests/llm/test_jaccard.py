import random
import re
import time

import numpy as np
import pytest

from credence.llm import jaccard
from credence.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(x)] = root(y)
    low = {}
    for x, (i, _) in enumerate(sets):
        low[root(x)] = min(low.get(root(x), i), i)
    return sorted((i, len(s), low[root(x)]) for x, (i, s) in enumerate(sets))


def corpus(seed, families, copies, length, edits):
    rng = random.Random(seed)
    rows = []
    for _ in range(families):
        words = [rng.choice("abcdefghijklmnop") + str(rng.randrange(30)) for _ in range(length)]
        for _ in range(copies):
            w = list(words)
            for _ in range(rng.randrange(edits + 1)):
                p = rng.randrange(len(w))
                w[p : p + rng.randrange(2)] = [rng.choice("xyz") + str(rng.randrange(50))] * rng.randrange(2)
            rows.append(" ".join(w))
    return rows


ODD = [None, "", " \n", "one", "ONE", "one two", "one  two\n", "one two three", "one one one one one", "É é", "é É"] + ["same text here again and again"] * 5


@pytest.mark.parametrize("percent,k,per_task", [(90, 3, 512), (90, 3, 6), (80, 2, 5), (80, 5, 512)])
def test_against_brute_force(spark, percent, k, per_task):
    texts = corpus(percent + k, 4, 14, 90, 5) + corpus(2, 3, 8, 12, 1) + corpus(3, 2, 12, 400, 16) + ODD
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, node int, family string").repartition(5)
    got = jaccard.link_components(df, k, percent, parts=4, per_task=per_task)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, k, percent)


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "q r s t"), (None, None)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in jaccard.link_components(df).collect()), key=str) == [(1, 1), (1, 1), (None, None), (None, None)]
    assert jaccard.link_components(df.where("false")).count() == 0
    base = [f"w{i}" for i in range(60)]
    near = spark.createDataFrame([(None, " ".join(base)), (None, " ".join([*base, "end"])), (7, " ".join(["start", *base])), (None, "alone a b c d")] + [(9, " ".join(base))] * 5, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.link_components(near, parts=4).collect()) == [(0, 0), (0, 7), (0, 7), (7, 7)] + [(9, 7)] * 5


def test_weak_hashes_link_nothing(spark):
    """Thue-Morse words agree under polynomials modulo a power of two."""
    thue = ["".join("ab"[(bin(i).count("1") + k) & 1] for i in range(1024)) for k in (0, 1)]
    df = spark.createDataFrame([(1, f"one {thue[0]} two"), (2, f"one {thue[1]} two")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.link_components(df).collect()} == {(1, 1), (2, 2)}


def test_a_task_ties_its_own_entries():
    key, node = np.array([5, 5, 5, 9, 9, 1]), np.array([30, 10, 20, 10, 20, 40])
    k, n, lead, lists = jaccard.combine(key, node)
    assert sorted(zip(k[lists == 0].tolist(), n[lists == 0].tolist())) == [(1, 40), (5, 10), (9, 10)]
    assert sorted(zip(lead[lists > 0].tolist(), n[lists > 0].tolist(), lists[lists > 0].tolist())) == [(10, 20, 2), (10, 30, 1)]


def test_block_bound_is_tight():
    for total in range(2, 400):
        d = jaccard.differing(total, 90)
        for apart in (d, d + 1):
            if (total - apart) % 2 == 0:
                inter = (total - apart) // 2
                assert (100 * inter >= 90 * (total - inter)) == (apart <= d)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    edges = [e for e in edges if e[0] != e[1]]
    low = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.node: r.label for r in components(spark.createDataFrame(edges + [(5000, 5000)], "a long, b long")).collect()}
    assert got == low
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_take_few_partitions(spark, monkeypatch):
    """Rounds over few edges leave files by the edges and not by the shuffle partitions, whose number a cluster may fix; labels stay."""
    from credence.llm import common, components as module

    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)]
    df, real, seen = spark.createDataFrame(edges, "a long, b long"), common.cut, []
    monkeypatch.setattr(common, "cut", lambda d: seen.append((out := real(d)).rdd.getNumPartitions()) or out)
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert {r.node: r.label for r in components(df).collect()} == {x: 100 if x >= 100 else 0 for e in edges for x in e}
        assert seen[0] == 16 and set(seen[1:]) == {1}
        monkeypatch.setattr(module, "EDGES", 10)  # several partitions
        assert {r.node: r.label for r in components(df).collect()} == {x: 100 if x >= 100 else 0 for e in edges for x in e}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_shingles_do_not_cross_rows():
    raw = [b"a b c d", b"e f", b"", b"g h i"]
    off = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    _, bounds = jaccard.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), off, 3)
    assert np.diff(bounds).tolist() == [2, 1, 0, 1]


def test_frequent_shingles_change_no_link(spark, monkeypatch):
    """Components are the same whichever shingles count as frequent: none, all, or every other one."""
    rng = random.Random(11)
    rows = []
    for i in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(80)] + "one common line that all of these texts have".split()
        rows.append((3 * i, " ".join(words)))
        rows.append((3 * i + 1, " ".join([*words[:-1], "end"])))
        rows.append((3 * i + 2, " ".join([*words[:40], "x", "y", "z", *words[40:]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real, found = jaccard.frequent_shingles, []
    for choose in (lambda every: every[:0], lambda every: every, lambda every: every[::2]):
        def frequent(r, n, k, choose=choose):
            data = " ".join(t for _, t in rows).encode()
            every, _ = jaccard.shingle_sets(np.frombuffer(data, np.uint8), np.array([0, len(data)]), k)
            return choose(np.sort(every))

        monkeypatch.setattr(jaccard, "frequent_shingles", frequent)
        found.append({r.doc_id: r.component_id for r in jaccard.link_components(docs).collect()})
    monkeypatch.setattr(jaccard, "frequent_shingles", real)
    assert found[0] == found[1] == found[2] and len(set(found[0].values())) < len(rows)


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_list(percent):
    """Sets that just link share a list, within a size class and across two, with and without frequent shingles."""
    rng = np.random.default_rng(percent)
    for n in [*range(1, 40), 64, 65, 97, 150, 291, 350, 436, 437, 700]:
        for _ in range(6):
            both = np.unique(rng.integers(0, (1 << 64) - 1, 3 * n, dtype=np.uint64))
            gone = int(rng.integers(0, n + 1))
            come = int(rng.integers(0, n + 1))
            while 100 * (n - gone) < percent * (n + come):
                gone, come = gone * 9 // 10, come * 9 // 10
            a, b = np.sort(both[:n]), np.sort(both[gone : n + come])
            assert jaccard.linked(a, b, percent)
            often = np.sort(rng.choice(both, int(rng.integers(0, len(both))), replace=False))
            for frequent in (None, often):
                assert len(np.intersect1d(jaccard.index_keys(a, percent, frequent), jaccard.index_keys(b, percent, frequent)))


def test_shared_shingles_seldom_tie_unrelated_sets():
    """Sets of 400 that have twelve shingles in common share no list here, and enter no more lists than their links need."""
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, (1 << 64) - 1, 400, dtype=np.uint64) for _ in range(201)]
    sets = [np.unique(np.concatenate((a, b[:12]))) for a, b in zip(sets, sets[1:])]
    keys = [jaccard.index_keys(s, 80) for s in sets]
    assert max(map(len, keys)) <= 2 * (jaccard.differing(412 + 412 * 100 // 80, 80) + 1)
    assert not any(len(np.intersect1d(a, b)) for a, b in zip(keys, keys[1:]))


def test_shuffle_files_go_with_their_execution(spark):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}
    before = files()
    docs = spark.createDataFrame(list(enumerate(corpus(7, 3, 8, 60, 3))), "doc_id long, text string").repartition(3)
    jaccard.link_components(docs)  # nothing but what it does before its result is asked for
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
