"""A corpus pipeline: quality rules, line dedup, near-duplicate join, benchmark decontamination and BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. Rows are told apart by doc_id and text; columns beside those of documents are left out.

Defined cases, for each stage: a document with null or empty text fails the base rules, so only the first stage meets
one in run(); given to a later stage, it loses no lines and is dropped there only if it had lines to lose, is linked with
nothing, has no hits and encodes to no ids. Rows equal in doc_id and text share each verdict; of such rows and of
ties in a group of near duplicates, all with the group's smallest doc_id stay (a null doc_id stays if its group has no other).
An empty table gives an empty result at each stage. Very long texts are rows like others. Columns of docs with the names
that operators compute are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import bpe, common, decontaminate, jaccard, line_dedup, quality
from credence.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the divergence rule go; the references are fitted on all documents labelled as good."""
    sample = quality.labelled(docs, common.table(spark, sf_dir, "labels"), per_language=None)
    keyed = docs.select(*COLUMNS).withColumn("uid", F.xxhash64("text"))
    kept = quality.judge(keyed, keep_columns=("doc_id", "uid"), sample=sample).where("kept").select(F.col("doc_id").alias("id"), F.col("uid").alias("u")).distinct()
    return keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("uid") == F.col("u")), "left_semi").select(*COLUMNS)


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go, and with them the documents in which no word is left."""
    out = line_dedup.dedup(docs.select(*COLUMNS), min_words=line_dedup.MIN_WORDS)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(left).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 on five-word shingles, the one with the smallest id stays."""
    linked = jaccard.link_components(docs, k=5, percent=80)
    stays = linked.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stays")).distinct()
    return docs.join(stays, F.col("doc_id").eqNullSafe(F.col("stays")), "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go."""
    found = decontaminate.find(docs, common.table(spark, sf_dir, "benchmark"), window=10, keep=COLUMNS)
    return found.where(F.size("spans") == 0).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text, as digests."""
    return bpe.encode(docs, tokenizer_path("word_bpe_49k.json"), keep=("doc_id", "lang", "source"), output="digest")


STAGES = [("quality rules", quality_rules), ("line dedup", line_runs), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("BPE encoding and decoding", encoding)]

#: The stages' hashes and tokenizers have no SQL form; the tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(*COLUMNS)
    folder = common.shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
