import random

from credence.llm import line_dedup


def brute(rows, min_lines, min_words):
    """Every pair of equal lines is followed as far as the lines agree; nothing is known here of fingerprints."""
    docs = []
    for doc_id, text, uid in sorted(set(rows), key=lambda r: (r[0], r[2])):
        numbers = [i for i, x in enumerate((text or "").split("\n")) if x.strip(" \t\n\v\f\r")]
        docs.append(((doc_id, uid), [(text or "").split("\n")[i] for i in numbers], numbers))
    places = {}
    for d, (_, lines, _) in enumerate(docs):
        for i, x in enumerate(lines):
            places.setdefault(x, []).append((d, i))
    spans = {}
    for d, (key, lines, numbers) in enumerate(docs):
        covered = [False] * len(lines)
        for i in range(len(lines)):
            for e, j in places[lines[i]]:
                if (e, j) >= (d, i):
                    continue
                n = 0
                while i + n < len(lines) and j + n < len(docs[e][1]) and lines[i + n] == docs[e][1][j + n]:
                    n += 1
                for k in range(1, n + 1):
                    if k >= min_lines or min_words and sum(len(x.split()) for x in lines[i : i + k]) >= min_words and k <= 2:
                        covered[i : i + k] = [True] * k
        gone = set()
        i = 0
        while i < len(lines):
            if covered[i]:
                j = i
                while j + 1 < len(lines) and covered[j + 1]:
                    j += 1
                gone.update(range(numbers[i], numbers[j] + 1))
                i = j
            i += 1
        spans[key] = gone
    return sorted(((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in spans[i, u]), len(spans[i, u])) for i, t, u in rows), key=str)


def uids(df):
    from pyspark.sql import functions as F

    return {(r.doc_id, r.text): r.u for r in df.select("doc_id", "text", F.xxhash64("text").alias("u")).collect()}


def test_against_brute_force(spark):
    rng = random.Random(2)
    pool = [f"line {i}" for i in range(12)] + ["", "  ", "\u00e9"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 25)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, rows[0][1]), (104, "a\n" * 30), (105, "x\ny\nz\nx\ny\nz\nx\ny\nz"), (0, rows[0][1]), (106, "\n".join(map(str, range(400)))), (107, "z\n" + "\n".join(map(str, range(100, 300))))]
    rows += [(200, "x\ny"), (201, "p\nx\ny\nq"), (202, "p\nx\ny\nq")]
    df = spark.createDataFrame([(i, t, i, -i) for i, t in rows], "doc_id long, text string, uid int, spans int").repartition(4)
    of = uids(df)
    for gram, window, words in ((2, 2, None), (1, 1, None), (2, 4, 5), (3, 2, None), (2, 2, 4), (2, 1, 4)):
        got = sorted(((r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup(df, gram, window, words).collect()), key=str)
        assert got == brute([(i, t, of[i, t]) for i, t in rows], gram + window - 1, words)
    out = line_dedup.dedup(df)
    assert out.columns == ["doc_id", "text", "uid", "n_lines", "spans", "n_removed"] and line_dedup.dedup(df.where("false")).count() == 0


def test_equal_hashes_of_weaker_kinds(spark):
    """Thue-Morse lines agree under polynomials modulo a power of two, but are different lines."""
    thue = ["".join("ab"[(bin(i).count("1") + k) & 1] for i in range(1024)) for k in (0, 1)]
    df = spark.createDataFrame([(1, f"x\n{thue[0]}\ny"), (2, f"x\n{thue[1]}\ny")], "doc_id long, text string")
    assert [r.n_removed for r in line_dedup.dedup(df, 1, 1).orderBy("doc_id").collect()] == [0, 2]


def test_every_long_repeat_loses_lines(spark):
    """A run of gram + window - 1 lines that stands in an earlier document is found wherever it stands."""
    rng = random.Random(4)
    run = [f"shared {i}" for i in range(4)]
    rows = [(i, "\n".join([f"own {i} {k}" for k in range(rng.randrange(6))] + run + [f"more {i} {k}" for k in range(rng.randrange(6))])) for i in range(30)]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i == 0 else 4 for i in range(30)}


def test_long_runs_of_few_lines(spark):
    """One or two lines of fifty words go if they stand earlier together; pairs from different places do not add up."""
    rng = random.Random(6)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    one, a, b, short = line(60), line(30), line(25), line(49)
    x = [line(5) for _ in range(6)]
    rows = [(1, one), (2, f"own 2\n{one}\nmore"), (3, one), (4, f"{a}\n{b}"), (5, f"own 5\n\n{a}\n \n{b}\nmore"), (6, short), (7, f"own 7\n{short}")]
    rows += [(8, "\n".join(x[:2])), (9, "\n".join([x[1], x[2]])), (10, "\n".join(["own 10", *x[:3], "more"])), (11, "\n".join(["own 11", *x[:3], "more"])), (12, f"{b}\n{a}"), (13, None), (14, f"{one}\n{one}"), (15, f"{one}x"), (16, f"{b}\u00e9"), (17, f"{one}\n{short}"), (18, f"{one}\n{short}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    of = uids(df)
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup(df, min_words=50).collect()), key=str)
    assert got == brute([(i, t, of[i, t]) for i, t in rows], 3, 50)
    gone = {2: "own 2\nmore", 3: "", 5: "own 5\n\nmore", 14: "", 17: short, 18: ""}
    assert all(t == gone.get(i, t if i != 11 else "") for i, t, _ in got if i != 11) and dict((i, t) for i, t, _ in got)[10] == rows[9][1]


def test_the_queries_delete_long_single_lines(spark, tmp_path):
    import corpus_pipeline
    from credence.llm import queries

    line = " ".join(f"word{i}" for i in range(60))
    spark.createDataFrame([(1, line, "en", "s", 1), (2, f"own\n{line}", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_removed for r in queries.op8_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 1}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_runs(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()} == {1: line, 2: "own"}
