import random
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from credence.llm import pieces, token_counts  # noqa: E402
from credence.llm.queries import COUNT_RULES  # noqa: E402

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def edited(t, edits):
    out, at = [], 0
    for a, b, new in sorted(edits, key=lambda e: (e[0], e[1])):
        out += [t[at:a], new]
        at = b
    return "".join([*out, t[at:]])


def test_edits_against_encoding_again(spark):
    rng = random.Random(9)
    tk = Tokenizer.from_file(BYTE)
    rows = []
    for i in range(250):
        t = "".join(rng.choice("ab cD ,.!  \n' é日12s") for _ in range(rng.randrange(120)))
        marks = sorted(rng.sample(range(len(t) + 1), min(len(t) + 1, 2 * rng.randrange(6))))
        edits = [(a, b, "".join(rng.choice("x y,  é") for _ in range(rng.randrange(5)))) for a, b in zip(marks[::2], marks[1::2])]
        edits += [(p, p, " z") for p in marks[:1]]
        rng.shuffle(edits)
        rows.append((i, t, edits))
    rows += [(900, None, [(0, 0, "new text"), (0, 0, "er")]), (901, "", None), (902, "word " * 5000, [(25, 26, ""), (24990, 25000, "tail")]), (903, "a b", [(0, 3, "")])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>, n_tokens int").repartition(3)
    got = {r.doc_id: r for r in token_counts.count(df, BYTE, edits="edits").collect()}
    for i, t, edits in rows:
        assert got[i].n_tokens == len(tk.encode(t or "").ids)
        assert got[i].n_tokens_after == len(tk.encode(edited(t or "", edits or [])).ids), (t, edits)
    assert got[902].n_bytes_again < 60
    assert token_counts.count(df, BYTE, edits="edits", keep=("doc_id", "n_tokens", "text")).columns == ["doc_id", "text", "n_tokens", "n_edits", "n_tokens_after", "n_bytes_again"]
    by_rule = {r.doc_id: r for r in token_counts.count(spark.createDataFrame([(1, "mail a.b@c.example.com or +1 (555) 123-4567 now ***** ok"), (2, "none")], "doc_id long, text string"), BYTE, rules=COUNT_RULES).collect()}
    assert by_rule[1].n_edits == 3 and by_rule[1].n_tokens_after == len(tk.encode("mail <EMAIL> or <NUMBER> now * ok").ids) and by_rule[2].n_edits == 0
    assert token_counts.count(df.where("false"), BYTE).count() == 0
    with pytest.raises(ValueError):
        token_counts.byte_edits("abc", [(0, 2, ""), (1, 3, "")])


def test_a_stored_tree_takes_edits_again_and_again(spark, tmp_path):
    """Three rounds of edits, each on the table that the round before has written; trees stay those of the new texts."""
    rng = random.Random(10)
    tk = Tokenizer.from_file(BYTE)
    texts = {i: "".join(rng.choice("ab cD ,.!  \n' é日12s") for _ in range(rng.choice([0, 5, 80, 900, 3000]))) for i in range(60)}
    texts[99] = "x" * 4000
    now = token_counts.trees(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), BYTE, leaf_bytes=64)
    for turn in range(3):
        now.write.parquet(f"{tmp_path}/{turn}")
        todo = {}
        for i, t in texts.items():
            marks = sorted(rng.sample(range(len(t) + 1), min(len(t) + 1, 2 * rng.randrange(4))))
            todo[i] = [(a, b, rng.choice(["", "new words. ", " y, z" * 40, "é"])) for a, b in zip(marks[::2], marks[1::2]) if b - a < 400 or turn]
        given = spark.createDataFrame(list(todo.items()), "doc_id long, e array<struct<start:int,end:int,text:string>>")
        texts = {i: edited(t, todo[i]) for i, t in texts.items()}
        now = token_counts.edit(spark.read.parquet(f"{tmp_path}/{turn}").join(given, "doc_id"), BYTE, edits="e", leaf_bytes=64)
        rows = {r.doc_id: r for r in now.collect()}
        assert {i: r.text for i, r in rows.items()} == texts and {i: r.n_tokens_after for i, r in rows.items()} == {i: len(tk.encode(t).ids) for i, t in texts.items()}
        for i, r in rows.items():
            raw, at, tree = r.text.encode(), 0, token_counts.SumTree.stored(r.tree)
            for k, end in enumerate(r.leaf_ends):
                assert tree.node[tree.size + k] == len(tk.encode(raw[at:end].decode()).ids)
                assert tree.before(k) == len(tk.encode(raw[:at].decode()).ids)
                at = end
            assert at == len(raw)
        now = now.select("doc_id", "text", "leaf_ends", "tree")


def test_tree():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 64):
        counts = rng.integers(0, 9, n)
        tree = token_counts.SumTree(counts)
        for _ in range(20):
            if n:
                k = int(rng.integers(n))
                counts[k] = rng.integers(9)
                tree.set(k, int(counts[k]))
            assert tree.total() == counts.sum() and all(tree.before(k) == counts[:k].sum() for k in range(n))


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage against a plain version, on its own input."""
    from credence.llm import quality
    from tests.llm import test_jaccard, test_line_dedup, test_tokens_urls_leaks as leaks

    rng = random.Random(12)
    words = ["the", "of", "and", "tion", "thea", "onre,", "st.", "in", "reading", "house", "tree", "river"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = ["\n".join(line(rng.randrange(5, 30)) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    items = [(i, line(14)) for i in range(5)]
    texts += [texts[3], texts[3] + " more", texts[4].replace("the", "tree", 1), texts[5] + " " + items[2][1] + " end", None, "", "%%% &&& " * 200, "a b " * 100, "\n".join(texts[i].split("\n")[0] for i in range(20)), "x\n" + texts[7]]
    copy = line(60)
    texts += [copy, copy + " more", copy.replace("house", "tree", 1)]
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, kinds).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    d, now, seen = str(tmp_path), spark.createDataFrame(docs, kinds), []
    for name, stage in corpus_pipeline.STAGES:
        rows = sorted(tuple(r) for r in now.collect())
        out = stage(spark, now, d)
        got = sorted(tuple(r) for r in out.collect())
        if name == "quality rules":
            kept = {r.doc_id for r in quality.judge(now, sample=quality.labelled(now, labels)).collect() if r.kept}
            assert got == [r for r in rows if r[0] in kept] and 66 not in kept and 64 not in kept
        elif name == "line dedup":
            from pyspark.sql import functions as F

            uid = {r.doc_id: r.u for r in now.select("doc_id", F.xxhash64("text").alias("u")).collect()}
            want = {i: (t, n) for i, t, n in test_line_dedup.brute([(r[0], r[1], uid[r[0]]) for r in rows], 3, 50)}
            assert {r[0]: r[1] for r in got} == {i: t for i, (t, n) in want.items() if not n or t.strip()} and all(r[4] == len(r[1]) for r in got)
            assert any(n for _, n in want.values())
        elif name.startswith("n-gram"):
            stays = {low for _, _, low in test_jaccard.brute([(r[0], r[1]) for r in rows], 5, 80)}
            assert got == [r for r in rows if r[0] in stays] and len(got) < len(rows)
        elif name.startswith("benchmark"):
            hits = leaks.brute_leaks([(r[0], r[1]) for r in rows], [(str(i), t) for i, t in items], 10)
            assert got == [r for r in rows if not hits[r[0]][1]] and len(got) < len(rows)
        else:
            tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            assert {r.doc_id: r.n_tokens for r in out.collect()} == {r[0]: len(tk.encode(r[1]).ids) for r in rows}
        seen.append(Counter(got))
        out.write.parquet(str(tmp_path / name.split()[0]))
        now = spark.read.parquet(str(tmp_path / name.split()[0]))
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, d).collect()) == seen[-1]
    assert pieces.CACHE_PIECES > 0


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows, clashing columns, long texts and empty tables, stage by stage."""
    rng = random.Random(3)
    long = " ".join(f"word{rng.randrange(5000)} the of" for _ in range(30_000))
    good = [" ".join(f"word{rng.randrange(500)} the" for _ in range(60)) for _ in range(3)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, node string, spans int, n_tokens int, uid string, id int"
    odd = [(1, good[0]), (1, good[0]), (1, good[1]), (None, good[2]), (None, None), (3, None), (4, ""), (5, long)]
    rows = [(i, t, "en" if i != 5 else None, None, None, "x", 1, 2, "y", 3) for i, t in odd]
    docs = spark.createDataFrame(rows, kinds)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, None), (1, ""), (2, " ".join(long.split()[100:120]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, 1, None), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    left = {name: sorted((str(r.doc_id), len(r.text or "") if "text" in r else r.n_tokens) for r in stage(spark, docs, d).collect()) for name, stage in corpus_pipeline.STAGES}
    n = sorted((str(i), len(t or "")) for i, t in odd)
    assert left["quality rules"] == [x for x in n if x[1]]
    assert left["line dedup"] == [x for x in n if x[0] != "None" or x[1] == 0 or x[1] == len(good[2])]
    assert left["n-gram Jaccard join"] == n
    assert left["benchmark decontamination"] == [x for x in n if x[0] != "5"]
    assert len(left["BPE encoding and decoding"]) == len(odd)
    assert len(corpus_pipeline.run(spark, d).collect()) == 4
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.where("false"), d)
        assert out.count() == 0 and (out.columns == list(corpus_pipeline.COLUMNS) or stage is corpus_pipeline.encoding)
