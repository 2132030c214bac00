import math
import random
import re

from credence.llm import quality

WORD, SPACE = re.compile(r"[^\x20\x09-\x0D]+"), "\x20\x09\x0a\x0b\x0c\x0d"


def base(t):
    t = t or ""
    w = WORD.findall(t)
    seen, covered = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                covered.update(range(i, i + 8))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def histograms(t, lang):
    t = t or ""
    w = WORD.findall(t)
    sets = [r"[A-Z]", r"[0-9]", r"[.,;:!?'\"()\-]", r"[#*$%&|<>@^~=+_/\\\[\]{}`]", r"[^\x00-\x7F]"]
    counts = [len(re.findall(p, t)) for p in sets]
    space = sum(c in SPACE for c in t)
    of = quality.COMMON_WORDS[lang]
    low = [x.lower() for x in w]
    words = [low.count(c) for c in of]
    return counts + [space, len(t) - sum(counts) - space], words + [len(w) - sum(words)]


def jsd(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    kl = lambda a, b: sum(x * math.log2(x / (x / 2 + y / 2)) for x, y in zip(a, b) if x)
    return math.sqrt(max(0.0, (kl(p, q) + kl(q, p)) / 2))


def rows():
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "Tion", "thea", "onre,", "st.", "in", "é", "x|y"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", "\n"]) for _ in range(n))
    out = [(i, text(rng.randrange(200)), rng.choice(["en", "fr", "xx", None])) for i in range(60)]
    out += [(100, None, "en"), (101, "", "en"), (102, "a " * 400, "en"), (103, "one two three four five six seven eight " * 9, "de"), (104, "%%% ### " * 50 + text(100), "en"), (105, "    x\x1cy\x0b z", "es")]
    return out + [(106, "DIES!! " + " ".join(f"W{i}!!" for i in range(300)), "en"), (0, out[0][1], out[0][2])]


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, g, 7) for i, t, g in data], "doc_id long, text string, lang string, n_words int").repartition(3)
    got = quality.judge(df).collect()
    reference = {}
    for i, t, lang in data:
        b = base(t)
        if lang in quality.COMMON_WORDS and not b[5] and b[0] >= 50:
            h = histograms(t, lang)
            old = reference.setdefault(lang, [[0] * len(x) for x in h])
            reference[lang] = [[x + y for x, y in zip(p, q)] for p, q in zip(old, h)]
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    rejected = 0
    for i, t, lang in data:
        b, r = base(t), by[i][0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == b, i
        kept = not b[5]
        if lang in reference and b[0]:
            d = [jsd(p, q) for p, q in zip(histograms(t, lang), reference[lang])]
            assert abs(r.class_distance - d[0]) < 1e-9 and abs(r.word_distance - d[1]) < 1e-9
            limits = [x + y / math.sqrt(b[0]) for x, y in (quality.MAX_CLASS_DISTANCE, quality.MAX_WORD_DISTANCE)]
            if kept and b[0] >= 50 and any(x > y for x, y in zip(d, limits)):
                kept, rejected = False, rejected + 1
        assert r.kept == kept
    assert rejected and len(by[0]) == 2 and len(got) == len(data)
    assert quality.judge(df.where("false")).count() == 0


def test_the_verdict_depends_on_labelled_documents_alone(spark):
    data = [r for r in rows() if r[0] < 100 or r[0] == 106]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").dropDuplicates(["doc_id"])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)] * 2, "doc_id long, quality int, toxic int")
    sample = quality.labelled(df, labels, 9)
    assert max(len([r for r in sample.collect() if r.lang == x]) for x in quality.COMMON_WORDS) == 9
    every = {r.doc_id: (r.class_distance, r.word_distance, r.kept) for r in quality.judge(df, sample=sample).collect()}
    fewer = df.where("doc_id < 40 or doc_id > 50")
    some = {r.doc_id: (r.class_distance, r.word_distance, r.kept) for r in quality.judge(fewer, sample=quality.labelled(fewer, labels, 9)).collect()}
    assert some == {i: every[i] for i in some} and not every[106][2]
    assert all(r.class_distance is None for r in quality.judge(df, sample=sample.where("false")).collect())


def test_clean_documents_stay(spark):
    """With labels: no document of good quality goes, most of bad quality go."""
    import os

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        return
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.judge(docs, sample=quality.labelled(docs, labels)).join(labels, "doc_id").where("n_words >= 20").select("quality", "kept").collect()
    good = [r.kept for r in out if r.quality == 1]
    bad = [r.kept for r in out if r.quality == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.3


def test_the_pipeline_fits_on_all_labelled_documents(spark, tmp_path, monkeypatch):
    """More labelled documents than PER_LANGUAGE: the later ones count too."""
    import corpus_pipeline

    asked = []
    real = quality.judge
    monkeypatch.setattr(quality, "judge", lambda docs, **kw: asked.append(kw["sample"].count()) or real(docs, **kw))
    text = " ".join(f"the word{i} of" for i in range(30))
    docs = spark.range(quality.PER_LANGUAGE + 7).selectExpr("id as doc_id", f"'{text}' as text", "'en' as lang", "'x' as source", "1L as n_chars")
    docs.selectExpr("doc_id", "1 as quality", "0 as toxic").write.parquet(str(tmp_path / "labels.parquet"))
    corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert asked == [quality.PER_LANGUAGE + 7]


def test_the_query_fits_on_all_labelled_documents(spark, tmp_path, monkeypatch):
    from credence.llm import queries

    asked = []
    real = quality.judge
    monkeypatch.setattr(quality, "judge", lambda docs, **kw: asked.append(kw["sample"].count()) or real(docs, **kw))
    docs = spark.range(quality.PER_LANGUAGE + 7).selectExpr("id as doc_id", "'the word of' as text", "'en' as lang", "'x' as source", "1L as n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs.selectExpr("doc_id", "1 as quality", "0 as toxic").write.parquet(str(tmp_path / "labels.parquet"))
    queries.op3_quality_rules(spark, str(tmp_path))
    assert asked == [quality.PER_LANGUAGE + 7]


def test_counts_of_odd_texts_without_a_string_for_each_character(spark):
    odd = ["The THE tHe the, the. (the) K İn in a IN\x0bA\x1cto for\x85of", "", None, "the", "a a\ta\n\na  ", "Σας ΣΑΣ é É 😀 x😀 [#*] {}|\\ 12٣", "de La LA que\r\nEL el. y", "a b c d e f g h " * 2 + "a"]
    data = [(i, t, g) for i, (t, g) in enumerate((t, g) for t in odd for g in ("en", "fr", "de", "es", "xx", None))]
    df = quality.features(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    for r in df.collect():
        classes, words = histograms(r.text, r.lang if r.lang in quality.COMMON_WORDS else "en")
        assert r.class_counts == classes and r.word_counts == (words if r.lang in quality.COMMON_WORDS else None), r
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(__w" not in plan and plan.count("regexp_extract_all(") <= len(quality.COMMON_WORDS)
