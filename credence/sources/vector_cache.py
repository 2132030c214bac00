"""A Parquet table of vectors by (id, model, hash of the text), filled in parts and safe to fill again.

A fill computes only what the table lacks: new ids, other models and changed texts. It writes its rows to a folder of its own
and then names that folder in the manifest by one small file, so a fill that dies leaves nothing that a reader sees. The
folder's name is the hash of what is filled, so a fill that runs twice writes the same name, and readers take one row a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["id", "model", "sha"]
ROWS = "id string, model string, sha string, embedding array<float>"


def keyed(texts: DataFrame, model: str) -> DataFrame:
    """texts: id, text; an empty or null text is embedded as its id."""
    text = F.when(F.coalesce(F.col("text"), F.lit("")) == "", F.col("id").cast("string")).otherwise(F.col("text"))
    return texts.select(F.col("id").cast("string").alias("id"), F.lit(model).alias("model"), F.sha2(text.cast("binary"), 256).alias("sha"), text.alias("text"))


def _store(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def parts(spark: SparkSession, folder: str) -> list[str]:
    """The folders that the manifest names."""
    fs, path = _store(spark, f"{folder}/manifest")
    return sorted(f"{folder}/{s.getPath().getName()}" for s in fs.listStatus(path)) if fs.exists(path) else []


def read(spark: SparkSession, folder: str) -> DataFrame:
    known = parts(spark, folder)
    rows = spark.read.schema(ROWS).parquet(*known) if known else spark.createDataFrame([], ROWS)
    return rows.dropDuplicates(KEYS)


def missing(texts: DataFrame, model: str, folder: str) -> DataFrame:
    """What the cache lacks: id, model, sha and text, a row a key."""
    have = read(texts.sparkSession, folder).where(F.col("model") == model).select(*KEYS)
    return keyed(texts, model).dropDuplicates(KEYS).join(have, KEYS, "left_anti")


def fill(texts: DataFrame, model: str, folder: str, embed: Callable[[DataFrame], DataFrame]) -> int:
    """Computes and appends the vectors that the cache lacks, and returns their number. ``embed`` adds ``embedding`` to rows with ``text``."""
    spark = texts.sparkSession
    lacks = missing(texts, model, folder)
    n, digest = lacks.agg(F.count("*"), F.sum(F.xxhash64(*KEYS).cast("decimal(38,0)"))).first()
    if not n:
        return 0
    name = f"part-{n}-{abs(int(digest)):x}"
    embed(lacks).select("id", "model", "sha", F.col("embedding").cast("array<float>").alias("embedding")).sortWithinPartitions("id").write.mode("overwrite").parquet(f"{folder}/{name}")
    fs, path = _store(spark, f"{folder}/manifest/{name}")
    fs.create(path, True).close()
    return n


def vectors(texts: DataFrame, model: str, folder: str) -> DataFrame:
    """id and embedding of each text as it now stands; null where the cache lacks it."""
    have = read(texts.sparkSession, folder).where(F.col("model") == model)
    return keyed(texts, model).drop("text").join(have, KEYS, "left").select("id", "embedding")
