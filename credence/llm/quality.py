"""Quality rules, with DataFrame functions alone.

Base rules need words, symbols, repeated lines and words that stand in repeated windows. The method compares two
histograms of a document with those of its language: character classes, and the language's common words among all words.
The language references are fitted on the documents that people have labelled as good (``labelled``: all of them, or
PER_LANGUAGE at most), so that a document's verdict does not depend on its neighbours; without them they are summed over
all documents that pass the base rules. The measure is the Jensen-Shannon distance (square root of the
divergence in bits, 0 to 1), and the limit falls with the number of words. Documents shorter than ``min_words``, or in a
language without a word list or without a labelled document, are not judged by it.

Defined cases: null or wordless text has no words and fails the base rules; a null language is one without a word
list; repeated rows each count and get the same verdict; an empty table gives an empty result; columns with the names
of computed ones are replaced, others pass through where ``keep_columns`` asks for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Frequent words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "que"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se"],
}
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Character classes by pattern; what is in none of them is the last class, mostly lower-case letters.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "stop": r"[.,;:!?'\"()\-]", "symbol": r"[#*$%&|<>@^~=+_/\\\[\]{}`]", "other": r"[^\x00-\x7F]"}
WINDOW = 8
#: Labelled documents that a language's reference is fitted on at most, those of the smallest ids.
PER_LANGUAGE = 5000
#: A document is rejected beyond base + slack / sqrt(words): sampling alone moves a document of n words by about
#: sqrt((K - 1) / (8 n ln 2)) from the reference of K bins, which is 1.0 / sqrt(n) for the classes and 1.3 / sqrt(n) for the words.
MIN_WORDS, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 50, (0.18, 1.2), (0.06, 2.4)


def _count(text: str, pattern: str) -> Column:
    """Characters of a class, by what is left without them: no string is made for each."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern + "+", ""))).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """Columns of ``docs`` with the base counts and both histograms (arrays of long)."""
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_counts", "word_counts", "base_failed", "kept")
    t = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("__w", F.array_remove(F.split(t, SPACE + "+"), ""))
    df = df.withColumns({"n_words": F.size("__w").cast("long"), "__h": F.transform("__w", lambda x: F.xxhash64(x))})
    for k in (1, 2, 4):  # hashes of runs of 1, 2, 4 words give that of 8
        df = df.withColumn("__h", F.transform("__h", lambda h, i: F.xxhash64(h, F.get("__h", i + k))))
    df = df.withColumn("__h", F.slice("__h", 1, F.greatest(F.size("__h") - (WINDOW - 1), F.lit(0))))
    placed = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))
    df = df.withColumn("__h", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), placed))
    same = lambda x, i: ((i > 0) & (F.get("__h", i - 1)["h"] == x["h"])) | (F.get("__h", i + 1)["h"] == x["h"])
    df = df.withColumn("__p", F.sort_array(F.transform(F.filter("__h", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(F.col("__p"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).cast("long").alias("n"), x.alias("last")), lambda a: a["n"])
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    df = df.withColumn("__l", lines)
    chars = F.length(t).cast("long")
    df = df.withColumns({
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "__rest": F.regexp_replace(t, r"[a-z\x20\x09-\x0D]+", ""),  # no class has a lower-case letter or white space
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
    })
    df = df.withColumns({"n_symbols": _count("__rest", "[#*$%&|<>]"), "__c": F.array(*(_count("__rest", p) for p in CLASSES.values())), "__space": chars - F.col("word_chars")})
    rest = chars - F.aggregate("__c", F.lit(0).cast("long"), lambda a, x: a + x) - F.col("__space")
    common_list = F.coalesce(*(F.when(F.col("lang") == k, F.array(*map(F.lit, v))) for k, v in COMMON_WORDS.items()))
    # the common words of the text's language, which are ASCII, in any case of letters
    found = F.coalesce(*(F.when(F.col("lang") == k, F.regexp_extract_all(t, F.lit(f"(?i)(?<!{WORD})(?:{'|'.join(v)})(?!{WORD})"), F.lit(0))) for k, v in COMMON_WORDS.items()))
    df = df.withColumns({"class_counts": F.concat("__c", F.array("__space", rest)), "__list": common_list, "__low": F.transform(found, lambda x: F.lower(x))})
    counts = F.array(*((F.size("__low") - F.size(F.array_remove("__low", F.get("__list", F.lit(i))))).cast("long") for i in range(len(COMMON_WORDS["en"]))))
    df = df.withColumn("__cw", F.when(F.col("__list").isNotNull(), counts))
    df = df.withColumn("word_counts", F.concat("__cw", F.array(F.col("n_words") - F.aggregate("__cw", F.lit(0).cast("long"), lambda a, x: a + x))))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("__w", "__h", "__p", "__l", "__rest", "__space", "__c", "__list", "__low", "__cw")


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)


def distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two count arrays of one length; null if either is null or has no counts."""
    a, b = F.transform(p, lambda x: x / _total(F.col(p))), F.transform(q, lambda x: x / _total(F.col(q)))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    each = F.zip_with(a, b, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    usable = (_total(F.col(p)) > 0) & (_total(F.col(q)) > 0)
    return F.when(usable, F.sqrt(F.greatest(F.lit(0.0), F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / 2)))


def labelled(docs: DataFrame, labels: DataFrame, per_language: int | None = PER_LANGUAGE) -> DataFrame:
    """lang and doc_id of the documents with a word list that a label calls good: all, or at most ``per_language`` of each language."""
    good = labels.where("quality = 1").select("doc_id").distinct()
    known = common.cut(docs.where(F.col("lang").isin(*COMMON_WORDS)).select("lang", "doc_id").distinct().join(good, "doc_id").select("lang", "doc_id"))
    if per_language is None:
        return known
    parts = [known.where(F.col("lang") == x).orderBy("doc_id").limit(per_language) for x in COMMON_WORDS]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def references(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per language with a word list: both histograms summed over its documents that pass the base rules."""
    n_class, n_word = len(CLASSES) + 2, len(COMMON_WORDS["en"]) + 1
    good = rows.where(F.col("lang").isin(*COMMON_WORDS) & ~F.col("base_failed") & (F.col("n_words") >= min_words))
    sums = lambda c, n: F.array(*(F.sum(F.get(c, F.lit(i))) for i in range(n)))
    return good.groupBy("lang").agg(sums("class_counts", n_class).alias("class_reference"), sums("word_counts", n_word).alias("word_reference"))


def judge(docs: DataFrame, min_words: int = MIN_WORDS, max_class: tuple[float, float] = MAX_CLASS_DISTANCE, max_word: tuple[float, float] = MAX_WORD_DISTANCE, keep_columns: tuple[str, ...] = ("doc_id",), sample: DataFrame | None = None) -> DataFrame:
    """``keep_columns`` (with doc_id where a sample is given) with all features, class_distance, word_distance and kept.

    Where the text is kept, it is looked at twice rather than written in between. The references have a row for each
    word list, so they may be broadcast."""
    made = ("class_reference", "word_reference")  # kept columns of these names step aside
    keep_columns = tuple(dict.fromkeys(keep_columns))
    rows = docs.select(*(F.col(c).alias(f"__kept_{c}" if c in made else c) for c in dict.fromkeys([*keep_columns, "lang", "text"])))
    rows = features(rows)
    narrow = rows if "text" in keep_columns else common.cut(rows.drop("text"))
    known = narrow if sample is None else narrow.join(common.cut(sample), ["lang", "doc_id"], "left_semi")
    joined = narrow.join(F.broadcast(common.cut(references(known, min_words))), "lang", "left")
    joined = joined.withColumns({"class_distance": distance("class_counts", "class_reference"), "word_distance": distance("word_counts", "word_reference")})
    beyond = lambda c, limit: F.coalesce(F.col(c), F.lit(0.0)) > limit[0] + limit[1] / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    far = beyond("class_distance", max_class) | beyond("word_distance", max_word)
    return joined.withColumn("kept", ~F.col("base_failed") & ~((F.col("n_words") >= min_words) & far)).drop(*made).withColumnsRenamed({f"__kept_{c}": c for c in made})
