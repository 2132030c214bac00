import re

from credence import plans

plans.load_all()


def brute(text):
    if text is None:
        return None
    text = re.sub(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d)?(\.\d+)?Z?", "<ts>", text, flags=re.A)
    text = re.sub(r"(/[^/\s:]+)+((/[^/\s:]+){3})", r"<path>\2", text, flags=re.A)
    return re.sub(r":\d+(:\d+)?", ":<line>", text, flags=re.A).lower()[:200]


def test_whole_texts_of_all_languages(spark, tmp_path):
    path = "".join(f"/folder{i}" for i in range(60))
    texts = [("en", f"Error in {path}/a.py:12:3 at 2024-01-02T03:04:05.6Z then " + "Word " * 60), ("de", "Fehler:7 é"), (None, "2024-01-02 03:04 " * 40), ("en", None), ("fr", "")]
    rows = [(i, lang, t) for i, (lang, t) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.signature for r in plans.QUERIES["normalized_signatures"](spark, str(tmp_path)).collect()}
    assert got == {i: brute(t) for i, _, t in rows}
    assert len(got[0]) == 200 and got[0] != brute(texts[0][1][:300])


def test_arguments_and_errors(spark):
    from pyspark.sql import functions as F

    from credence.functions import belief

    path = re.compile(r"(?:/[\w\.-]+)+/?")

    def collapsed(m):
        parts = m[0].strip("/").split("/")
        return "/".join(parts) if len(parts) <= 3 else ".../" + "/".join(parts[-3:])

    def arguments(t):
        t = path.sub(collapsed, t.strip())
        for key in belief.VOLATILE_KEYS:
            t = re.sub(rf"\b{key}\s*[=:]\s*[\"']?[\w\-]+[\"']?", "", t, flags=re.I)
        return re.sub(r"\s+", " ", t).strip()

    def error(t):
        t = path.sub("<PATH>/", re.sub(r":\d+:", ":LINE:", t.lower()))
        return re.sub(r"\s+", " ", re.sub(belief.ISO_TIME, "<TS>", t)).strip()[:200]

    texts = ["pytest /a/b/c/d.py --id=5f-3 x", "cat /a/b/ /x", "run_id: 'abc' UUID=9 /one/two/three/", " no  paths\there ", "Error in /root/dir/deep/file.py:12: bad\n at 2024-01-02T03:04:05Z", "/", "//a//b/c/d/e", "trace_id=a/b/c/d/e", "é /ü/ö.py:3:", "x" * 300]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(belief.normalized_arguments(F.col("t")), belief.normalized_error(F.col("t"))).collect()
    for t, r in zip(texts, got):
        assert tuple(r) == (arguments(t), error(t)), t
