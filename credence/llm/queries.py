"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, decontaminate, html_extract, jaccard, line_crf, line_dedup, oracles, phrases, quality, suffix_dedup, token_counts, token_output, turn_repair, url_filter


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(common.table(spark, sf_dir, "documents"), length=400, output="digest")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    manifest = token_output.write(docs, common.shared_folder(spark, "token-ids"), tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_output.digest(token_output.read(manifest))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    judged = quality.judge(docs, sample=quality.labelled(docs, common.table(spark, sf_dir, "labels"), per_language=None))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The edits of the query: personal data (an address needs its sign) and runs of symbols.
COUNT_RULES = [(r"[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "<EMAIL>", "@"), (r"\+?\d[\d ().-]{7,}\d", "<NUMBER>"), (r"([#*$%&!])\1{2,}", r"\1")]


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(common.table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), rules=COUNT_RULES)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(common.table(spark, sf_dir, "documents"), k=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(common.table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), output="digest")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(common.table(spark, sf_dir, "documents"), min_words=line_dedup.MIN_WORDS)
    return out.select("doc_id", "n_lines", "n_removed", F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_runs"), F.sha2(common.binary(), 256).alias("kept_sha256"))


#: The rules of the query: host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(common.table(spark, sf_dir, "pages"), least=html_extract.PAGES, whole=True).select("page_id", "url", "text", "n_chars")


def op11_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = line_crf.score(docs, line_crf.train(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", line_crf.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(common.table(spark, sf_dir, "documents"), most_words=3, least=10, keep=2000, covered=50)


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = common.table(spark, sf_dir, "conversations")
    return turn_repair.report(conversations, turn_repair.damage(conversations))


OP9_SQL = """
WITH r(host, path, verdict) AS (VALUES ('com','/en/','block'), ('example.com','/en/7','allow'), ('net','/de/','allow'),
  ('example.net','/de/8','block'), ('org','/es/','block')),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
  row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host) + length(r.path) DESC, length(r.host) DESC) AS k
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_token_output": op2_token_output,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_counts": op4_token_counts,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_decontaminate": op6_decontaminate,
    "op7_bpe": op7_bpe,
    "op8_line_dedup": op8_line_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_html_extract": op10_html_extract,
    "op11_line_crf": op11_line_crf,
    "op12_phrases": op12_phrases,
    "op13_turn_repair": op13_turn_repair,
}
SQL: dict[str, str] = {"op3_quality_rules": oracles.OP3_SQL, "op5_ngram_jaccard": oracles.OP5_SQL, "op6_decontaminate": oracles.OP6_SQL, "op9_url_filter": OP9_SQL, "op12_phrases": oracles.OP12_SQL, "op13_turn_repair": oracles.OP13_SQL}
