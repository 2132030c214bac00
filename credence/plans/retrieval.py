"""Evidence joins, retrieval and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import belief
from ..operators import retrieval
from . import query
from .tables import k_of, read

SQL_BELIEFS = """bl AS (SELECT user_id * 10 + event_id % 3 AS belief_id, user_id AS actor, min(ts::DATE) + 10 AS first_seen, min(ts::DATE) + 12 AS last_seen FROM events GROUP BY ALL)"""


def _beliefs(spark, d):
    e = read(spark, d, "events")
    g = e.groupBy((F.col("user_id") * 10 + F.col("event_id") % 3).alias("belief_id"), F.col("user_id").alias("actor")).agg(F.min(F.to_date("ts")).alias("m"))
    return g.select("belief_id", "actor", F.date_add("m", 10).alias("first_seen"), F.date_add("m", 12).alias("last_seen"))


@query(f"""WITH {SQL_BELIEFS}, j AS (SELECT belief_id, event_id, ts::DATE AS date, row_number() OVER (PARTITION BY belief_id ORDER BY ts::DATE DESC, event_id DESC) AS rank
  FROM bl JOIN events ON user_id = actor AND ts::DATE BETWEEN first_seen - 7 AND last_seen) SELECT belief_id, event_id, rank FROM j WHERE rank <= 50""")
def evidence_range_join(spark, d):
    e = read(spark, d, "events").select("event_id", F.col("user_id").alias("actor"), F.to_date("ts").alias("date"))
    return retrieval.evidence(_beliefs(spark, d), e, 7, 50).select("belief_id", "event_id", F.col("rank").cast("long").alias("rank"))


@query("""WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS support, count(DISTINCT cast(json_extract_string(props, '$.k') AS INT) % 9) AS refs FROM events GROUP BY 1)
SELECT user_id, CASE WHEN support >= 3 AND refs >= 5 THEN 'covered' WHEN support <= 1 AND refs <= 2 THEN 'sparse' ELSE 'partial' END AS coverage FROM c""")
def coverage_status(spark, d):
    e = read(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("support"), F.count_distinct(k_of() % 9).alias("refs"))
    return e.select("user_id", belief.coverage_status(F.col("support"), F.col("refs")).alias("coverage"))


CUT = "2024-01-18"


@query(f"""WITH {SQL_BELIEFS}, kn AS (SELECT *, last_seen AS last_updated FROM bl WHERE last_seen <= DATE '{CUT}'),
rf AS (SELECT user_id * 10 + event_id % 3 AS belief_id, event_id AS chunk_id, ts::DATE AS ts, event_type AS source FROM events WHERE ts::DATE <= DATE '{CUT}'),
bs AS (SELECT belief_id, source, count(*) AS n FROM rf GROUP BY ALL), r AS (SELECT belief_id, sum(n)::BIGINT AS n_refs, count(*) AS n_sources, string_agg(source || ':' || n, ', ' ORDER BY n DESC, source) AS source_mix FROM bs GROUP BY 1),
x AS (SELECT kn.*, coalesce(n_refs, 0) AS n_refs, coalesce(n_sources, 0) AS n_sources, coalesce(source_mix, '') AS source_mix FROM kn LEFT JOIN r USING (belief_id))
SELECT belief_id, n_refs, n_sources, source_mix, row_number() OVER (PARTITION BY actor ORDER BY belief_id % 2, CASE WHEN n_refs >= 20 THEN 0 WHEN n_refs >= 10 THEN 1 ELSE 2 END, date_diff('day', last_updated, DATE '{CUT}'), -(n_refs * 0.5), belief_id) AS rank FROM x""")
def belief_rank_cutoff(spark, d):
    b = _beliefs(spark, d).withColumn("last_updated", F.col("last_seen"))
    e = read(spark, d, "events")
    refs = e.select((F.col("user_id") * 10 + F.col("event_id") % 3).alias("belief_id"), F.col("event_id").alias("chunk_id"))
    chunks = e.select(F.col("event_id").alias("chunk_id"), F.to_date("ts").alias("ts"), F.col("event_type").alias("source"))
    x = retrieval.at_cutoff(b, refs, chunks, CUT)
    cover = F.when(F.col("n_refs") >= 20, "covered").when(F.col("n_refs") >= 10, "partial").otherwise("sparse")
    x = x.withColumns({"match_type": F.col("belief_id") % 2, "coverage": cover, "state": F.lit("active"), "support": F.col("n_refs"), "confidence": F.lit(0.5)})
    return retrieval.rank_beliefs(x, CUT, "actor").select("belief_id", "n_refs", "n_sources", "source_mix", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {SQL_BELIEFS}, t AS (SELECT belief_id, actor, belief_id % 50 AS theme FROM bl), m AS (SELECT DISTINCT theme, actor AS asker FROM t),
o AS (SELECT DISTINCT asker, belief_id FROM m JOIN t USING (theme) WHERE actor <> asker)
SELECT asker, belief_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY asker ORDER BY belief_id) AS rank FROM o) WHERE rank <= 50""")
def theme_expansion(spark, d):
    b = _beliefs(spark, d)
    out = retrieval.theme_expansion(b, b.select("belief_id", (F.col("belief_id") % 50).alias("theme")), "actor", 50)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id AS chunk_id, label, list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))) AS sim FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM s) SELECT query_id, chunk_id, rank FROM r WHERE rank <= 150 AND label < 5""")
def chunk_topk_cutoff(spark, d):
    v = read(spark, d, "embeddings")
    out = retrieval.top_then_cutoff(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), v.withColumnRenamed("vec_id", "chunk_id"), 150, F.col("label") < 5)
    return out.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("""WITH RECURSIVE q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id AS chunk_id, label, list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))) AS sim FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM s), k AS (SELECT query_id, chunk_id, rank, greatest(1, (length(coalesce(text, '')) + 3) // 4) AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM r JOIN documents ON doc_id = chunk_id WHERE rank <= 150 AND label < 5),
p AS (SELECT query_id, 0::BIGINT AS i, 0::BIGINT AS used, NULL::BIGINT AS chunk_id FROM q UNION ALL SELECT p.query_id, k.i, CASE WHEN used + tokens <= 6000 THEN used + tokens ELSE used END, CASE WHEN used + tokens <= 6000 THEN k.chunk_id END FROM p JOIN k ON k.query_id = p.query_id AND k.i = p.i + 1)
SELECT p.query_id, p.chunk_id, k.rank, k.tokens, p.used FROM p JOIN k ON k.query_id = p.query_id AND k.i = p.i WHERE p.chunk_id IS NOT NULL""")
def chunk_pack(spark, d):
    v = read(spark, d, "embeddings")
    top = retrieval.top_then_cutoff(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), v.withColumnRenamed("vec_id", "chunk_id"), 150, F.col("label") < 5)
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), belief.approx_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    ranked = top.join(texts, "chunk_id").select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "tokens")
    return retrieval.packed(ranked)


@query("""WITH s AS (SELECT DISTINCT user_id * 10 + event_id % 3 AS belief_id, user_id AS actor, ts::DATE AS day FROM events WHERE event_type = 'error')
SELECT belief_id, count(DISTINCT event_id) AS n, md5(string_agg(DISTINCT event_id::VARCHAR, ',' ORDER BY event_id::VARCHAR)) AS ids FROM s JOIN events ON user_id = actor AND abs(date_diff('day', day, ts::DATE)) <= 3 GROUP BY 1""")
def counter_evidence(spark, d):
    e = read(spark, d, "events").select("event_id", F.col("user_id").alias("actor"), F.to_date("ts").alias("date"), "event_type")
    setbacks = e.where("event_type = 'error'").select((F.col("actor") * 10 + F.col("event_id") % 3).alias("belief_id"), "actor", "date")
    out = retrieval.counter_evidence(setbacks, e.select("event_id", "actor", "date"))
    ids = F.array_join(F.array_sort(F.transform("event_ids", lambda x: x.cast("string"))), ",")
    return out.select("belief_id", F.size("event_ids").cast("long").alias("n"), F.md5(ids.cast("binary")).alias("ids"))


@query("""WITH c AS (SELECT doc_id % 700 AS event_id, doc_id % 3 AS file_rank, doc_id AS line, source AS title, text FROM documents WHERE doc_id % 11 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY file_rank, line) AS r FROM c)
SELECT event_id, line, length(trim(title || coalesce(' ' || text, ''))) AS combined_len, length(trim(title || coalesce(' ' || text, ''))) < 30 AS degenerate FROM r WHERE r = 1""")
def corpus_loaded(spark, d):
    docs = read(spark, d, "documents")
    rows = docs.select((F.col("doc_id") % 700).alias("event_id"), (F.col("doc_id") % 3).alias("file_rank"), F.col("doc_id").alias("line"), F.when(F.col("doc_id") % 11 != 0, F.lit("2024-01-01")).alias("timestamp"), F.col("source").alias("title"), "text")
    return retrieval.loaded(rows).select("event_id", "line", F.col("combined_len").cast("long").alias("combined_len"), "degenerate")


SQL_LABELS = "lb AS (SELECT doc_id, doc_id % 3 AS arm, CASE WHEN doc_id % 7 = 0 THEN 'NA' WHEN quality = 1 THEN 'YES' ELSE 'NO' END AS label FROM labels)"


def _labels(spark, d):
    l = read(spark, d, "labels")  # noqa: E741
    return l.select("doc_id", (F.col("doc_id") % 3).alias("arm"), F.when(F.col("doc_id") % 7 == 0, "NA").when(F.col("quality") == 1, "YES").otherwise("NO").alias("label"), "toxic")


@query(f"WITH {SQL_LABELS} SELECT arm, count(*) FILTER (label <> 'NA') AS n, round(count(*) FILTER (label = 'YES') / count(*) FILTER (label <> 'NA'), 6) AS yes_rate FROM lb GROUP BY 1")
def label_rates(spark, d):
    return retrieval.label_rates(_labels(spark, d), ["arm"]).withColumn("yes_rate", F.round("yes_rate", 6))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN CASE WHEN quality = 1 THEN 'YES' ELSE 'NO' END ELSE CASE WHEN toxic = 1 THEN 'NO' ELSE 'YES' END END AS label,
  doc_id % 7 <> 0 AND (quality = 1) <> (toxic = 0) AS conflict FROM labels""")
def judge_combine(spark, d):
    both = belief.combined_label(F.col("label"), F.when(F.col("toxic") == 1, "NO").otherwise("YES"))
    return _labels(spark, d).select("doc_id", both["label"].alias("label"), both["conflict"].alias("conflict"))


@query("""WITH j AS (SELECT doc_id % 4 AS axis, CASE WHEN doc_id % 5 = 0 THEN 'tie' WHEN (quality = 1) <> (('0x' || substr(sha256(doc_id || ':11'), 1, 1))::INT % 2 = 1) THEN 'A' ELSE 'B' END AS w FROM labels)
SELECT axis, count(*) AS n, round(count(*) FILTER (w = 'A') / count(*), 6) AS a_rate, round(count(*) FILTER (w = 'B') / count(*), 6) AS b_rate, round(count(*) FILTER (w = 'tie') / count(*), 6) AS tie_rate FROM j GROUP BY 1""")
def preference_rates(spark, d):
    l = read(spark, d, "labels")  # noqa: E741
    j = l.select((F.col("doc_id") % 4).alias("axis"), retrieval.swapped(F.col("doc_id"), 11).alias("swapped"), F.when(F.col("doc_id") % 5 == 0, "tie").when(F.col("quality") == 1, "first").otherwise("second").alias("winner"))
    out = retrieval.preference_rates(j)
    return out.withColumns({c: F.round(c, 6) for c in ("a_rate", "b_rate", "tie_rate")})


@query(f"""WITH {SQL_LABELS}, r AS (SELECT doc_id % 5 AS model, arm, avg((label = 'YES')::INT) AS rate FROM lb WHERE label <> 'NA' GROUP BY ALL),
p AS (SELECT model, max(rate) FILTER (arm = 0) AS a, max(rate) FILTER (arm = 2) AS c FROM r GROUP BY 1)
SELECT model, CASE WHEN c - a IS NULL THEN 'incomplete' WHEN c - a >= 0.03 THEN 'better' WHEN c - a <= -0.03 THEN 'worse' WHEN abs(c - a) <= 0.02 THEN 'equal' ELSE 'unclear' END AS outcome FROM p""")
def arm_outcome_class(spark, d):
    l = _labels(spark, d).where("label <> 'NA'").withColumn("model", F.col("doc_id") % 5)  # noqa: E741
    arms = F.element_at(F.array(*map(F.lit, "ABC")), F.col("arm").cast("int") + 1)
    rates = l.groupBy("model", arms.alias("arm")).agg(F.avg((F.col("label") == "YES").cast("int")).alias("rate"))
    return retrieval.arm_class(rates, "arm", "rate", ["model"]).select("model", "outcome")


SQL_ARMS = """r AS (SELECT doc_id % 40 AS model, doc_id // 40 % 6 AS arm, avg((quality = 1)::INT) * 100 AS rate FROM labels GROUP BY ALL),
p AS (SELECT model, max(rate) FILTER (arm = 0) AS A, max(rate) FILTER (arm = 1) AS B, max(rate) FILTER (arm = 2) AS C, max(rate) FILTER (arm = 3) AS D, max(rate) FILTER (arm = 4) AS E, max(rate) FILTER (arm = 5) AS P FROM r GROUP BY 1),
m AS (SELECT model, CASE WHEN A IS NULL OR B IS NULL OR C IS NULL OR P IS NULL THEN NULL WHEN B - A >= 3 AND C - A >= 3 AND B - P >= 3 AND C - P >= 3 THEN 1 WHEN (B - A >= 3 AND B - P >= 3) <> (C - A >= 3 AND C - P >= 3) THEN 2
  WHEN A - B >= 3 OR A - C >= 3 OR P - B >= 3 OR P - C >= 3 THEN 5 WHEN (abs(B - P) < 2 OR abs(C - P) < 2) AND P - A >= 3 THEN 3 WHEN abs(B - A) < 2 AND abs(C - A) < 2 THEN 4 ELSE 0 END AS k FROM p)"""


def _arms(spark, d):
    l = read(spark, d, "labels")  # noqa: E741
    arm = F.element_at(F.array(*map(F.lit, "ABCDEP")), (F.expr("doc_id div 40") % 6).cast("int") + 1)
    rates = l.groupBy((F.col("doc_id") % 40).alias("model"), arm.alias("arm")).agg(F.avg((F.col("quality") == 1).cast("int")).alias("rate"))
    return retrieval.pivoted(rates, tuple("ABCDEP"), ["model"])


@query(f"""WITH {SQL_ARMS} SELECT model, k AS class, CASE WHEN k IS NULL THEN 'incomplete' ELSE ['unclassified', 'full_replication', 'partial_replication', 'compression_equivalent', 'no_effect', 'reversal'][k + 1] END AS label,
  CASE WHEN A > greatest(B, C, D, E) + 3 THEN 6 WHEN B - A >= 3 AND C - B >= 3 AND D - C >= 3 AND E - D >= 3 THEN 1 WHEN C - B >= 3 AND D - C >= 3 AND E - D >= 3 AND abs(B - A) < 2 THEN 2 WHEN abs(E - D) < 2 AND D - C >= 3 AND C - B >= 3 AND B - A >= 3 THEN 3
   WHEN abs(E - D) < 2 AND abs(D - C) < 2 AND C - B >= 3 AND B - A >= 3 THEN 4 WHEN abs(E - B) < 2 THEN 5 ELSE 0 END AS ladder,
  CASE WHEN k IS NULL THEN NULL WHEN abs(P - A) < 2 THEN 'compression_of_raw_log_does_not_help' WHEN abs(P - B) < 2 OR abs(P - C) < 2 THEN 'compression_alone_explains_lift' WHEN P - B <= -3 THEN 'substrate_transformation_does_meaningful_work' ELSE 'partial_substrate_contribution' END AS compressed FROM p JOIN m USING (model)""")
def model_outcomes(spark, d):
    x = retrieval.model_class()
    return _arms(spark, d).select("model", x["class"].alias("class"), x["label"].alias("label"), retrieval.ladder_class()["class"].alias("ladder"), retrieval.compressed_class().alias("compressed"))


@query(f"""WITH {SQL_ARMS} SELECT model % 8 AS family, count(*) AS n, count(*) FILTER (k = 0) AS class_0, count(*) FILTER (k = 1) AS class_1, count(*) FILTER (k = 2) AS class_2, count(*) FILTER (k = 3) AS class_3, count(*) FILTER (k = 4) AS class_4, count(*) FILTER (k = 5) AS class_5,
  CASE WHEN count(*) FILTER (k = 5) > 0 THEN 'reversal_halt_and_audit' WHEN count(*) FILTER (k = 4) > 0 THEN 'thesis_fails_on_at_least_one_model' WHEN count(*) FILTER (k = 3) > 0 THEN 'compression_finding_does_not_generalize' WHEN count(*) FILTER (k = 1) = count(*) THEN 'full_cross_model_replication'
   WHEN count(*) FILTER (k = 1) = count(*) - 1 AND count(*) FILTER (k = 2) = 1 THEN 'mostly_full_plus_one_partial' ELSE 'mixed' END AS outcome FROM m GROUP BY 1""")
def cross_model_outcome(spark, d):
    classes = _arms(spark, d).select((F.col("model") % 8).alias("family"), retrieval.model_class()["class"].alias("class"))
    return retrieval.across_models(classes, ["family"])


@query("SELECT a.doc_id // 3 AS question_id, a.quality AS answer_a, b.quality AS answer_b FROM labels a JOIN labels b ON a.doc_id // 3 = b.doc_id // 3 WHERE a.doc_id % 3 = 0 AND b.doc_id % 3 = 1")
def paired_answers(spark, d):
    l = read(spark, d, "labels").select(F.expr("doc_id div 3").alias("question_id"), F.when(F.col("doc_id") % 3 == 0, "A").when(F.col("doc_id") % 3 == 1, "B").alias("arm"), F.col("quality").alias("answer"))  # noqa: E741
    return retrieval.paired(l, ("A", "B"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark, d):
    return retrieval.remaining(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"), ["doc_id"])


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def first_wins_dedupe(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("key"))
    return retrieval.first_wins(docs, "key", ["doc_id"]).select("doc_id")


@query("""WITH c AS (SELECT event_id, event_type AS category, value < 50 AS positive, user_id, sha256(event_id || ':3') AS o FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY category, positive, user_id ORDER BY o) AS s FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY category, positive ORDER BY o) AS r FROM s WHERE s <= 3) SELECT event_id FROM r WHERE r <= 25""")
def stratified_quota(spark, d):
    c = read(spark, d, "events").select("event_id", F.col("event_type").alias("category"), (F.col("value") < 50).alias("positive"), "user_id")
    order = F.sha2(F.concat(F.col("event_id").cast("string"), F.lit(":3")).cast("binary"), 256)
    return retrieval.quota(c, ["category", "positive"], 25, "user_id", 3, order).select("event_id")
