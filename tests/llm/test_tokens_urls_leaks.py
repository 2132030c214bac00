import hashlib
import io
import random
import re
import sys

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from credence.llm import bpe, common, decontaminate, line_dedup, pieces, token_output, url_filter  # noqa: E402

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n\n", "a", "don't stop, it's  fine.\n\nI'll go", "x<|endoftext|> y<|startoftext|>z <|endoftext|>", "été  naïve\u00a0 b\u00a0\u00a0c \u3000 d",
    "A\u0301 \u0301x e\u0301,\u0301 ;\u037e", "\u2028 a \u2029b\x1c \x1d c\x85 d", "日本語 テキスト 12345 6７８", "Ünïcödé STRASSE İstanbul ΣΑΣ ς", "a.b,c;d:e!f?g|h|> <i", "tab\tcr\r\nff\x0cvt\x0bend", "word " * 3000, "%%% ### &&& $$$ ***", "\u200b zero\u200bwidth \ufeff bom", "'s 't 're x's,'s .'s",
]


def texts(n=150, seed=3):
    rng = random.Random(seed)
    alphabet = "ab eXY .,;'s\n\t\u00a0\u3000é\u0301日12|<>!?-"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(n)] + ["the same copy of a text."] * 3


def frame(spark, rows):
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(rows)], "doc_id long, text string, n_tokens long").repartition(3)


def test_token_files_round_trip(spark, tmp_path):
    rows = texts()
    tk = Tokenizer.from_file(BYTE)
    ids = [tk.encode(t or "", add_special_tokens=False).ids + [2] for t in rows]
    manifest = token_output.write(frame(spark, rows), str(tmp_path / "ids"), BYTE, frame_bytes=4096, parts=3)
    got = {r.doc_id: r for r in token_output.read(manifest).collect()}
    at = 0
    for i, want in enumerate(ids):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want, repr(rows[i])
        assert (got[i].start, got[i].n_tokens) == (at, len(want))
        at += len(want)
    one = token_output.digest(token_output.read(manifest)).where("doc_id = 5").first()
    assert one.ids_crc32 == token_output.crc32(np.array(ids[5]))
    none = token_output.write(frame(spark, rows).where("false"), str(tmp_path / "none"), BYTE, parts=2)
    assert none.count() == 0 and token_output.read(none).count() == 0


def test_reader_touches_only_the_asked_frame_and_notices_damage():
    sink = io.BytesIO()
    w = token_output.FrameWriter(sink, frame_bytes=40)
    docs = {i: np.arange(i, dtype="<u4") for i in range(30)}
    for i, ids in docs.items():
        w.add(i, ids.tobytes())
    w.close()
    raw = sink.getvalue()
    r = token_output.FrameReader(io.BytesIO(raw), len(raw))
    assert len(r.table) > 10 and all((r.get(i)[0] == ids).all() for i, ids in docs.items())
    assert r.frames_read == 30 and r.get(99) == []
    bad = bytearray(raw)
    bad[int(r.at[3]) + 6] ^= 1
    with pytest.raises(Exception):
        list(token_output.FrameReader(io.BytesIO(bytes(bad)), len(bad)).documents())


@pytest.mark.parametrize("mean", [2, 20, 256])
def test_bpe_equals_the_library(spark, mean):
    rows = texts(80, mean)
    tk = Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in bpe.encode(frame(spark, rows), WORD, mean_chunk=mean).collect()}
    for i, t in enumerate(rows):
        ids = tk.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids, repr(t)
        assert got[i].decoded == tk.decode(ids, skip_special_tokens=False)
    digest = bpe.encode(frame(spark, rows), WORD, output="digest").collect()
    plain = bpe.digest_columns(bpe.encode(frame(spark, rows), WORD)).collect()
    assert sorted(map(tuple, digest)) == sorted(map(tuple, plain))
    assert bpe.encode(frame(spark, rows).where("false"), WORD).count() == 0
    assert bpe.encode(frame(spark, rows), WORD, keep=("doc_id", "n_tokens")).columns == ["doc_id", "n_tokens", "ids", "decoded"]


def test_chunks_are_shared_and_joins_repaired():
    rng = random.Random(4)
    words = [f"{rng.choice('abcdefgh')}{rng.choice(['tion', 'ing', 'é', 'ly'])}{rng.choice('xyz')}" for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(n))
    passage = text(1500)
    docs = [text(rng.randrange(80)) + " " + passage + " " + text(rng.randrange(80)) for _ in range(20)] + ["x" * 5000, "日本語" * 500, "a <|endoftext|> b " * 60, ""]
    raw = [d.encode() for d in docs]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    tk = Tokenizer.from_file(WORD)
    for mean in (64, 256):
        coder = bpe.ChunkEncoder(pieces.encoder(WORD), mean)
        assert [x.tolist() for x in coder.texts(data, offsets)] == [tk.encode(d, add_special_tokens=False).ids for d in docs]
        assert coder.used > 2 * coder.encoded
    # chunks that were encoded wrongly at their edges are noticed and put together
    row = coder.lone([b"one two three fo", b"ur five six seven eig", b"ht nine ten"])
    row[1].ids[1] += 1
    assert coder.stitch(row, {}).tolist() == tk.encode("one two three four five six seven eight nine ten", add_special_tokens=False).ids and coder.merged == 1


def test_what_a_worker_keeps_is_small(monkeypatch):
    """Workers are reused, so what one holds after a stage counts in all later ones."""
    coder = pieces.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [f" {a}{b}{c}{d}".encode() for a in letters for b in letters for c in letters for d in letters][:400_000]
    for k in range(0, len(words), 20_000):
        coder.lookup(words[k : k + 20_000])
    assert sys.getsizeof(coder.known) + sum(sys.getsizeof(p) + sys.getsizeof(i) for p, i in coder.known.items()) < 40e6
    monkeypatch.setattr(common, "_tables", {})
    data = np.frombuffer(b"some words of a line\n" * 60_000, np.uint8)
    offsets = np.arange(0, len(data) + 1, 2100)
    for a, b in common.slices(offsets):
        line_dedup.line_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
    assert sum(x.nbytes for x in common._tables.values()) < 40e6


def test_token_files_encode_a_word_once(monkeypatch):
    """More distinct words than other operators keep: what op2 has encoded once it does not encode again."""
    coder = pieces.encoder(BYTE, token_output.CACHE_PIECES, token_output.CACHE_BYTES)
    asked, word = [], coder.word
    monkeypatch.setattr(coder, "word", lambda p: asked.append(p) or word(p))
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [f" {a}{b}{c}{d}".encode() for a in letters for b in letters for c in letters for d in letters][: pieces.CACHE_PIECES + 20_000]
    first = [coder.lookup(words[k : k + 20_000]) for k in range(0, len(words), 20_000)]
    assert [coder.lookup(words[k : k + 20_000]) for k in range(0, len(words), 20_000)] == first and len(asked) == len(words)
    assert sys.getsizeof(coder.known) + sum(sys.getsizeof(p) + sys.getsizeof(i) for p, i in coder.known.items()) < token_output.CACHE_BYTES


def test_cache_gives_way(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_PIECES", 3)
    coder = pieces.Encoder(BYTE)
    tk = Tokenizer.from_file(BYTE)
    for text in ("one two three four", "two five six", "one two"):
        data = np.frombuffer(text.encode(), np.uint8)
        cuts = np.append(np.flatnonzero(pieces.safe_cuts(data, np.array([0, len(data)]))), len(data))
        assert coder.encode(data, cuts)[0].tolist() == tk.encode(text).ids


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_leaks(docs, items, window):
    def cut(t):
        return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    out = {}
    for d, t in docs:
        w, hit, found = cut(t), set(), set()
        for item, text in items:
            iw = cut(text)
            m = min(len(iw), window)
            for j in range(len(iw) - m + 1 if m else 0):
                for k in range(len(w) - m + 1):
                    if w[k : k + m] == iw[j : j + m]:
                        hit.update(range(k, k + m))
                        found.add(item)
        out[d] = (len(w), sorted(hit), sorted(found))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 30])
def test_decontamination_against_brute_force(spark, block_bytes):
    rng = random.Random(5)
    vocabulary = ["a", "B", "cc", "É", "é", "x1", "日"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", " - "]) for _ in range(n))
    items = [(str(i), text(rng.choice([1, 2, 3, 4, 5, 8]))) for i in range(12)] + [("n", None), ("e", ""), ("p", "...")]
    items += [items[0], ("10", "zzz yyy a B cc qq rr")]
    docs = [(i, text(rng.randrange(60))) for i in range(60)] + [(100, None), (101, ""), (102, "zzz, yyy; A b\ncc qq rr!"), (103, items[3][1])]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, spans string")
    b = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.find(d, b, window=4, block_bytes=block_bytes).withColumn("n", decontaminate.n_hit()).collect()}
    for k, (n, hit, found) in brute_leaks(docs, items, 4).items():
        spans = [p for s in got[k].spans for p in range(s.start, s.end)]
        assert (got[k].n_words, spans, got[k]["items"], got[k].n) == (n, hit, found, len(hit))
    twice = spark.createDataFrame([(1, docs[3][1])] * 3 + [(None, docs[4][1])] * 2 + [(1, docs[5][1])], "doc_id long, text string")
    got = decontaminate.find(twice, b, window=4, block_bytes=block_bytes, keep=("doc_id", "n_words", "text"))
    want = brute_leaks([(i, docs[i][1]) for i in (3, 4, 5)], items, 4)
    assert got.columns == ["doc_id", "text", "n_words", "spans", "items"]
    assert sorted((r.n_words, len(r["items"])) for r in got.collect()) == sorted((want[i][0], len(want[i][2])) for i in (3, 3, 3, 4, 4, 5))
    assert decontaminate.find(d.where("false"), b).count() == 0
    assert {len(r.spans) for r in decontaminate.find(d, b.where("false")).collect()} == {0}


def test_the_search_skips():
    """Over text without the patterns' words, one word in nine is looked at."""
    rng = random.Random(2)
    w = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    patterns = decontaminate.compile_patterns([("1", w(40)), ("2", w(15))], 10)
    raw = w(20_000).encode()
    words = decontaminate.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    end, _, looked = decontaminate.visit(words, patterns[0])
    assert looked < 20_000 / 7 and len(end) < 50


def test_url_rules_against_brute_force(spark):
    rng = random.Random(7)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net", "com.net", "", "a..com", "acom"]
    paths = ["/", "/en/", "/en/7", "/en/77/x", "/e", "", "/de/8"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/7', '#t'])}" for _ in range(200)]
    urls += [None, "", "no scheme", "HTTP://A.COM/en/7", "x://", "://b.A.com?x/en/", "a://é.com/en/日"] + ["http://a.com/en/7"] * 50
    rules = [("com", "/en/", "block"), ("a.com", "/en/7", "allow"), ("a.com", "/en/7", "block"), ("net", "", "block"), ("x.net", "/e", "allow"), ("b.a.com", "/", "allow"), (None, "/", "block"), ("com", "/en/7", "allow"), ("", "/", "block"), ("m.net", "", "allow")]
    urls += [f"http://{'www.' * (i % 3)}a.com/en/{i}" for i in range(60)] + ["http://com./x", "http://.com/en/"]

    def brute(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1], m[2]) if m else ("", "")
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if h is not None and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        return host, path, best and best[3], best[2] if best else "allow"

    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string").repartition(5)
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.judge(pages, r, parts=7).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert {x.verdict for x in url_filter.judge(pages, r.where("false")).collect()} == {"allow"}
    assert url_filter.judge(pages.where("false"), r).count() == 0


def test_sha_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_kept_columns_of_any_name(spark):
    """Columns with the names of inner ones pass through bpe, decontamination, quality and repeated ids through token files."""
    from credence.llm import quality

    df = spark.createDataFrame([(1, "one two three", "x", 3, "r", "en"), (2, None, "y", 4, "s", "xx")], "doc_id long, text string, __text string, __row int, class_reference string, lang string")
    extra = ("doc_id", "__text", "__row", "class_reference")
    kept = lambda out: sorted(tuple(r[c] for c in extra) for r in out.collect())
    want = [(1, "x", 3, "r"), (2, "y", 4, "s")]
    assert kept(bpe.encode(df, WORD, keep=extra, output="digest")) == want
    bench = spark.createDataFrame([(i, f"two three {i}") for i in range(9)] + [(9, "two three")], "item_id long, text string")
    for size in (1 << 20, 40):
        out = decontaminate.find(df, bench, window=2, keep=extra, block_bytes=size)
        assert kept(out) == want and [r["items"] for r in out.orderBy("doc_id").collect()] == [[str(i) for i in range(10)], []]
    assert kept(quality.judge(df, keep_columns=extra)) == want


def test_rows_that_share_an_id_are_spread(spark, tmp_path):
    rows = [(7, f"text number {i}") for i in range(400)] + [(None, f"null {i}") for i in range(100)]
    manifest = token_output.write(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "ids"), BYTE, parts=4)
    files = manifest.collect()
    assert len(files) == 4 and max(f.n_docs for f in files) < 300
    got = token_output.read(manifest).collect()
    assert sorted((r.doc_id is not None, r.n_tokens) for r in got) == sorted((i is not None, len(Tokenizer.from_file(BYTE).encode(t, add_special_tokens=False).ids) + 1) for i, t in rows)
    assert sorted(r.start for r in got)[0] == 0


def test_nested_paths_of_many_rules(spark):
    """Paths nest in paths, on hosts that nest in hosts, with rules sent to parts as open ones."""
    rng = random.Random(8)
    part = lambda n: "/" + "/".join(rng.choice("ab") for _ in range(rng.randrange(n)))
    hosts = ["com", "x.com", "y.x.com", "z.y.x.com"]
    rules = list({(rng.choice(hosts), part(5)): rng.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [f"http://{rng.choice(['', 'w.', 'q.'])}{rng.choice(hosts)}{part(8)}" for _ in range(400)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string"), parts=5).collect()}
    for i, u in enumerate(urls):
        host, path = re.match(r"http://([^/]*)(.*)", u).groups()
        fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (max(fits)[2:] if fits else (None, "allow")), u
