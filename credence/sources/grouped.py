"""Tables bucketed and sorted by session, so that a session's turns, timelines and samples meet without a shuffle.

Written once, a grouped table keeps each session in one bucket in its own order. Joins on the session and windows by session
over such tables read bucket by bucket; the writer's shuffle is paid once, however many queries follow. Replay files, many
JSON-lines files under one glob, are read with a fixed schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 32
#: The fields of replay rows.
REPLAY = (
    "as_of string, expectation_id string, parent_expectation_id string, question_handle string, implied_kind string, status string, event string, days_alive int, supporting_share double, "
    "supporting_actors array<string>, statement string"
)


def save(rows: DataFrame, table: str, order: tuple[str, ...], by: str = "session_id", buckets: int = BUCKETS) -> DataFrame:
    """Writes rows as a table of the catalog, one file a bucket, and reads it back."""
    rows.repartition(buckets, by).write.mode("overwrite").bucketBy(buckets, by).sortBy(by, *order).format("parquet").saveAsTable(table)
    return read(rows.sparkSession, table)


def read(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def replay(spark: SparkSession, path: str) -> DataFrame:
    """Replay rows of all files that match ``path``: as_of as a date, family (the question's handle), and blank or bad lines left out."""
    rows = spark.read.schema(REPLAY + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null and expectation_id is not null").drop("_bad").withColumns({"as_of": F.to_date(F.substring("as_of", 1, 10)), "family": F.coalesce("question_handle", F.lit(""))})
