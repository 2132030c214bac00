import hashlib

from credence.streaming.ingest import ingest


def test_ordered_ingest(spark, tmp_path):
    src, kinds = tmp_path / "in", "session_id string, line long, raw string"
    batches = [[("a", 1, "x"), ("a", 2, "y"), ("b", 1, "p")], [("a", 2, "y"), ("a", 2, "other"), ("a", 4, "gap"), ("b", 2, "q")], [("a", 3, "z"), ("b", 2, "q")]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    src.mkdir()
    q = ingest(spark.readStream.schema(kinds).parquet(str(src))).writeStream.format("memory").queryName("ingested").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(src))
            q.processAllAvailable()
    finally:
        q.stop()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = sorted((r.session_id, r.line, r.status) for r in spark.table("ingested").collect())
    assert got == sorted([("a", 1, "accepted"), ("a", 2, "accepted"), ("b", 1, "accepted"), ("a", 2, "replayed"), ("a", 2, "mutated"), ("a", 4, "out_of_order"), ("b", 2, "accepted"), ("a", 3, "accepted"), ("b", 2, "replayed")])
    h = ""
    for x in "xyz":
        h = hashlib.sha256(h.encode() + x.encode()).hexdigest()
    assert [r.chain for r in spark.table("ingested").where("session_id = 'a' and line = 3").collect()] == [h]


def test_final_closes_a_session(spark, tmp_path):
    src, kinds = tmp_path / "in", "session_id string, line long, raw string, final boolean"
    batches = [[("a", 1, "x", False), ("a", 2, "y", None), ("b", 1, "p", False)], [("a", 0, "", True), ("b", 2, "q", False)], [("a", 3, "z", False), ("a", 1, "x", False), ("b", 3, "r", False)]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    src.mkdir()
    q = ingest(spark.readStream.schema(kinds).parquet(str(src))).writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(src))
            q.processAllAvailable()
    finally:
        q.stop()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = sorted((r.session_id, r.line, r.status) for r in spark.table("closed").collect())
    assert got == sorted([("a", 1, "accepted"), ("a", 2, "accepted"), ("b", 1, "accepted"), ("a", 2, "final"), ("b", 2, "accepted"), ("a", 3, "finalized"), ("a", 1, "finalized"), ("b", 3, "accepted")])
