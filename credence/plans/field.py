"""Fields over embeddings dated by the event of the same id, and over events as expectations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import field
from . import query
from .tables import read

SQL_POINTS = """pt AS (SELECT vec_id AS event_id, label AS actor, ts::DATE AS date, embedding::DOUBLE[] AS e FROM embeddings JOIN events ON vec_id = event_id),
un AS (SELECT event_id, actor, date, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM pt WHERE list_dot_product(e, e) > 0)"""
SQL_WINDOW = "wn AS (SELECT DISTINCT p.actor, p.date AS day, u.event_id, u.date, u.u FROM (SELECT DISTINCT actor, date FROM un) p JOIN un u ON u.actor = p.actor AND u.date BETWEEN p.date - INTERVAL {days} DAY AND p.date)"
SQL_SUM = "{name} AS (SELECT actor, day, max(k) AS k, list(x ORDER BY i) AS s FROM (SELECT actor, day, i, sum(x) AS x, count(*) AS k FROM (SELECT actor, day, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM {of}) GROUP BY ALL) GROUP BY ALL)"
COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"


def _points(spark, d):
    e, v = read(spark, d, "events"), read(spark, d, "embeddings")
    return v.join(e.select(F.col("event_id").alias("vec_id"), F.to_date("ts").alias("date")), "vec_id").select(F.col("vec_id").alias("event_id"), F.col("label").alias("actor"), "date", "embedding")


@query(f"""WITH {SQL_POINTS}, {SQL_WINDOW.format(days=7)}, {SQL_SUM.format(name='sm', of='wn')},
pw AS (SELECT DISTINCT p.actor, p.date AS day, u.event_id, u.u FROM (SELECT DISTINCT actor, date FROM un) p JOIN un u ON u.actor = p.actor AND u.date BETWEEN p.date - INTERVAL 14 DAY AND p.date - INTERVAL 7 DAY),
{SQL_SUM.format(name='sp', of='pw')}, l AS (SELECT sm.*, sp.s AS b FROM sm LEFT JOIN sp USING (actor, day))
SELECT actor, day, k AS n, round(CASE WHEN k > 1 THEN 1 - (list_dot_product(s, s) - k) / (k * (k - 1)) END, 4) AS dispersion, round(1 - {COS.format('s', 'b')}, 4) AS drift FROM l""")
def field_dispersion_drift(spark, d):
    out = field.dispersion_and_drift(_points(spark, d), 7)
    return out.select("actor", "day", "n", F.round("dispersion", 4).alias("dispersion"), F.round("drift", 4).alias("drift"))


def _sql_density(days: int, least: float) -> str:
    """The similarities of each window summed plainly, day by day."""
    return f"""WITH {SQL_POINTS}, {SQL_WINDOW.format(days=days)}, rl AS (SELECT vec_id AS event_id, vec_id % 4 AS r FROM embeddings), sp AS (SELECT event_id, actor, u, r, unnest(generate_series(date, date + INTERVAL {days} DAY, INTERVAL 1 DAY))::DATE AS day FROM un JOIN rl USING (event_id)),
sz AS (SELECT day, count(*) AS n FROM sp GROUP BY 1), pr AS (SELECT wn.actor, wn.day, r, list_dot_product(wn.u, sp.u) AS sim FROM wn JOIN sp ON sp.day = wn.day AND sp.actor <> wn.actor),
ct AS (SELECT actor, day, count(*) AS n FROM wn GROUP BY ALL), s AS (SELECT actor, day, sum(sim) AS sim, sum(sim * r) AS wsim FROM pr WHERE sim > {least} GROUP BY ALL)
SELECT ct.actor, ct.day, ct.n, round(coalesce(sim, 0) / ct.n / sz.n, 4) AS density, round(coalesce(wsim, 0) / ct.n / sz.n, 4) AS weighted FROM ct LEFT JOIN s USING (actor, day) JOIN sz USING (day)"""


def _density(spark, d, days: int, least: float):
    out = field.density(_points(spark, d).withColumn("r", F.col("event_id") % 4), days, least, "r")
    return out.select("actor", "day", "n", F.round("density", 4).alias("density"), F.round("weighted", 4).alias("weighted"))


@query(_sql_density(7, 0.05))
def field_density(spark, d):
    return _density(spark, d, 7, 0.05)


@query(_sql_density(30, 0.3))
def field_density_30d(spark, d):
    return _density(spark, d, 30, 0.3)


@query(f"""WITH {SQL_POINTS}, {SQL_WINDOW.format(days=7)}, {SQL_SUM.format(name='sm', of='wn')}, pr AS (SELECT a.actor, a.day, b.actor AS other, {COS.format('a.s', 'b.s')} AS sim FROM sm a JOIN sm b ON a.day = b.day AND a.actor <> b.actor)
SELECT actor, day, rank, other, round(sim, 4) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY actor, day ORDER BY sim DESC, other) AS rank FROM pr) WHERE rank <= 3""")
def field_neighbour_actors(spark, d):
    from ..functions import vector

    units = _points(spark, d).withColumn("u", vector.unit(F.col("embedding"))).where(vector.norm(F.col("embedding")) > 0)
    out = field.neighbour_actors(field.window_totals(units, {"now": (-7, 0)}), "now")
    return out.withColumn("sim", F.round("sim", 4))


@query(f"""WITH {SQL_POINTS}, {SQL_WINDOW.format(days=30)}, td AS (SELECT actor, date AS day, u FROM un), bf AS (SELECT * FROM wn WHERE date < day),
{SQL_SUM.format(name='a', of='td')}, {SQL_SUM.format(name='b', of='bf')}
SELECT actor, day, round(1 - {COS.format('a.s', 'b.s')}, 4) AS novelty FROM a LEFT JOIN b USING (actor, day)""")
def field_novelty(spark, d):
    return field.novelty(_points(spark, d), 30).select("actor", "day", F.round("novelty", 4).alias("novelty"))


@query(f"""WITH c AS (SELECT label AS id, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY 1),
s AS (SELECT id, vec_id, {COS.format('embedding::DOUBLE[]', 'c')} AS sim FROM embeddings, c)
SELECT id, vec_id, rank, round(sim, 4) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, vec_id) AS rank FROM s) WHERE rank <= 3""")
def field_neighbors(spark, d):
    from ..operators.regions import centroids

    v = read(spark, d, "embeddings")
    out = field.neighbours(v.select("vec_id", "embedding"), centroids(v, "label").withColumnRenamed("label", "id"), "vec_id")
    return out.select("id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("sim", 4).alias("sim"))


@query("""WITH c AS (SELECT user_id AS actor, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL)
SELECT actor, day, n, coalesce(n - lag(n, 7) OVER (PARTITION BY actor ORDER BY day), 0) AS momentum FROM c""")
def density_momentum(spark, d):
    n = read(spark, d, "events").groupBy(F.col("user_id").alias("actor"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return field.momentum(n, "n")


@query("""WITH t AS (SELECT lang, doc_id, regexp_extract_all(lower(text), '[a-z]{3,}') AS w FROM documents), x AS (SELECT lang, doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS p FROM t),
c AS (SELECT lang, token, count(*) AS n, min(doc_id * 1000000 + p) AS f FROM x GROUP BY ALL)
SELECT lang, rank, token, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, f) AS rank FROM c) WHERE rank <= 3""")
def top_tokens(spark, d):
    out = field.top_tokens(read(spark, d, "documents"), "lang", "doc_id")
    return out.withColumn("rank", F.col("rank").cast("long"))


SQL_EXP = """ex AS (SELECT ts::DATE AS as_of, user_id AS expectation_id, event_type AS kind, user_id % 25 AS ticker, CASE WHEN event_type = 'purchase' THEN 'retired' ELSE 'held' END AS event,
  value % 5 < 1 AS young, cast(json_extract_string(props, '$.k') AS INT) AS k FROM events),
xp AS (SELECT *, CASE WHEN young THEN 0 ELSE 3 END AS days_alive, k / 100 AS share FROM ex)"""


def _expectations(spark, d):
    e = read(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.to_date("ts").alias("as_of"), F.col("user_id").alias("expectation_id"), F.col("event_type").alias("kind"), (F.col("user_id") % 25).alias("ticker"),
        F.when(F.col("event_type") == "purchase", "retired").otherwise("held").alias("event"), F.when(F.col("value") % 5 < 1, 0).otherwise(3).alias("days_alive"), (k / 100).alias("share"), k.alias("k"),
    )


SQL_SNAP = """sn AS (SELECT as_of, count(*) AS n_active, count(DISTINCT ticker) AS n_tickers, count(*) FILTER (days_alive = 0) AS n_born, count(*) FILTER (event = 'retired') AS n_retired,
  avg(share) AS share_mean, min(share) AS share_min, max(share) AS share_max FROM xp GROUP BY 1),
kd AS (SELECT as_of, sum(p * p) AS hhi FROM (SELECT as_of, count(*) / sum(count(*)) OVER (PARTITION BY as_of) AS p FROM xp GROUP BY as_of, kind) GROUP BY 1)"""


@query(f"WITH {SQL_EXP}, {SQL_SNAP} SELECT as_of, n_active, n_tickers, n_born, n_retired, round(share_mean + 1e-9, 6) AS share_mean, share_min, share_max, round(hhi + 1e-9, 6) AS hhi FROM sn JOIN kd USING (as_of)")
def expectation_snapshot(spark, d):
    s = field.snapshot(_expectations(spark, d))
    return s.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("share_mean", "hhi")})  # no ties to round


SQL_DRIFT = """dy AS (SELECT as_of, lead(as_of) OVER (ORDER BY as_of) AS next FROM (SELECT DISTINCT as_of FROM xp)), st AS (SELECT DISTINCT as_of, expectation_id FROM xp),
sz AS (SELECT as_of, count(*) AS n FROM st GROUP BY 1), bo AS (SELECT b.as_of, count(*) AS c FROM st a JOIN dy USING (as_of) JOIN st b ON b.as_of = dy.next AND b.expectation_id = a.expectation_id GROUP BY 1),
dr AS (SELECT sz.as_of, sz.n, CASE WHEN p.n IS NOT NULL THEN 1 - coalesce(c, 0) / (sz.n + p.n - coalesce(c, 0)) END AS drift FROM sz LEFT JOIN dy ON dy.next = sz.as_of LEFT JOIN sz p ON p.as_of = dy.as_of LEFT JOIN bo ON bo.as_of = sz.as_of)"""


@query(f"WITH {SQL_EXP}, {SQL_DRIFT} SELECT as_of, n, round(drift, 6) AS drift FROM dr")
def field_metrics(spark, d):
    return field.set_change(_expectations(spark, d)).withColumn("drift", F.round("drift", 6))


@query(f"""WITH {SQL_EXP}, {SQL_SNAP}, {SQL_DRIFT}, m AS (SELECT as_of, n_tickers AS breadth, hhi, share_mean AS stress, n_born AS churn, drift FROM sn JOIN kd USING (as_of) JOIN dr USING (as_of)),
l AS (SELECT *, breadth - lag(breadth, 5) OVER (ORDER BY as_of) AS d_b, hhi - lag(hhi, 5) OVER (ORDER BY as_of) AS d_h FROM m)
SELECT as_of, event FROM (SELECT as_of, unnest([CASE WHEN d_b <= -2 THEN 'narrowing' END, CASE WHEN d_h <= -0.15 THEN 'fragmenting' END, CASE WHEN d_h >= 0.15 THEN 'consolidating' END,
  CASE WHEN stress >= 0.5 THEN 'stressing' END, CASE WHEN churn >= 3 THEN 'churning' END, CASE WHEN drift >= 0.5 THEN 'drifting' END]) AS event FROM l) WHERE event IS NOT NULL""")
def field_events(spark, d):
    x = _expectations(spark, d)
    m = field.snapshot(x).join(field.set_change(x), "as_of")
    return field.field_events(m.select("as_of", F.col("n_tickers").alias("breadth"), "hhi", F.col("share_mean").alias("stress"), F.col("n_born").alias("churn"), "drift"))


SQL_GRID = """pl AS (SELECT *, k % 21 / 10.0 - 1 AS direction, 1 + k % 12 AS breadth FROM xp), bx AS (SELECT *, CASE WHEN direction < -0.2 THEN 0 WHEN direction < 0.2 THEN 1 ELSE 2 END AS x,
  CASE WHEN breadth < 4 THEN 0 WHEN breadth < 8 THEN 1 ELSE 2 END AS y FROM pl),
ag AS (SELECT as_of, x, y, count(*) AS density, count(*) FILTER (days_alive = 0) AS born, count(*) FILTER (event = 'retired') AS retired, avg(1 - share) AS pressure FROM bx GROUP BY ALL),
gr AS (SELECT d.as_of, a.v AS x, b.v AS y, coalesce(density, 0) AS density, coalesce(born, 0) AS born, coalesce(retired, 0) AS retired, pressure
  FROM (SELECT DISTINCT as_of FROM xp) d, (VALUES (0), (1), (2)) a(v), (VALUES (0), (1), (2)) b(v) LEFT JOIN ag ON ag.as_of = d.as_of AND ag.x = a.v AND ag.y = b.v)"""


def _grid(spark, d):
    x = _expectations(spark, d)
    return field.grid(x.withColumns({"direction": F.col("k") % 21 / 10.0 - 1, "breadth": 1 + F.col("k") % 12}))


@query(f"WITH {SQL_EXP}, {SQL_GRID} SELECT as_of, x, y, density, born, retired, round(pressure, 6) AS pressure FROM gr")
def spatial_grid(spark, d):
    return _grid(spark, d).withColumn("pressure", F.round("pressure", 6))


@query(f"WITH {SQL_EXP}, {SQL_GRID} SELECT x, y, round(avg(density), 6) AS density, round(avg(CASE WHEN density > 0 THEN pressure END), 6) AS pressure, cast(sum(born) AS BIGINT) AS born, cast(sum(retired) AS BIGINT) AS retired FROM gr GROUP BY ALL")
def spatial_summary(spark, d):
    return field.grid_summary(_grid(spark, d)).withColumns({"density": F.round("density", 6), "pressure": F.round("pressure", 6)})


@query("""WITH n AS (SELECT user_id % 40 AS question_id, event_type AS c, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY question_id) AS t, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, c) AS k FROM n)
SELECT question_id, cast(max(t) AS BIGINT) AS members, count(*) AS classes, max(CASE WHEN k = 1 THEN c END) AS dominant, round(max(n / t), 6) AS cohesion,
  CASE WHEN max(n / t) >= 0.66 THEN 'coherent' WHEN max(n / t) <= 0.33 THEN 'fragmented' ELSE 'mixed' END AS reads FROM r GROUP BY 1""")
def cohort_split_state(spark, d):
    s = read(spark, d, "events").select((F.col("user_id") % 40).alias("question_id"), F.col("event_type").alias("state_class"))
    return field.cohort_split(s).withColumn("cohesion", F.round("cohesion", 6))


@query("""WITH e AS (SELECT user_id AS actor, ts, event_id, event_type AS state FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY ts DESC, event_id DESC) AS r FROM e)
SELECT actor, state FROM (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY r DESC) AS k FROM r WHERE r <= 6) WHERE k = 1""")
def lookback_state(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("actor"), F.struct("ts", "event_id").alias("day"), F.col("event_type").alias("state"))
    return field.lookback_state(e).select("actor", "state")


@query("SELECT user_id AS expectation_id, min(ts::DATE) AS born FROM events GROUP BY 1")
def expectation_births(spark, d):
    return field.births(_expectations(spark, d))


@query("""WITH m AS (SELECT label AS storm_id, vec_id FROM embeddings WHERE vec_id % 3 = 0), x AS (SELECT storm_id, i, avg(x) AS x, count(*) AS n FROM (SELECT storm_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM m JOIN embeddings USING (vec_id)) GROUP BY ALL)
SELECT storm_id, max(n) AS n, round(sqrt(sum(x * x)), 5) AS norm FROM x GROUP BY 1""")
def storm_centroids(spark, d):
    """Storms are a fixture: of each label, every third vector is a member; vectors are joined whole."""
    v = read(spark, d, "embeddings")
    storms = v.where("vec_id % 3 = 0").groupBy(F.col("label").alias("storm_id")).agg(F.collect_list("vec_id").alias("event_ids"))
    out = field.member_centroids(storms, v.select(F.col("vec_id").alias("event_id"), "embedding"))
    return out.select("storm_id", "n", F.round(F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x * x)), 5).alias("norm"))


SQL_LINEAGE = """xp AS (SELECT ts::DATE AS as_of, user_id AS expectation_id, CASE WHEN user_id % 4 > 0 THEN user_id - user_id % 4 END AS parent_id, (cast(json_extract_string(props, '$.k') AS INT) % 21 - 10) / 10 AS direction,
  1 + cast(json_extract_string(props, '$.k') AS INT) % 12 AS breadth, CASE WHEN event_type = 'error' THEN 'retired' ELSE event_type END AS event, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id) AS r FROM events),
ex AS (SELECT * FROM xp WHERE r = 1)"""


def _lineage_rows(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, d, "events").select(
        F.to_date("ts").alias("as_of"), F.col("user_id").alias("expectation_id"), F.when(F.col("user_id") % 4 > 0, F.col("user_id") - F.col("user_id") % 4).alias("parent_id"), ((k % 21 - 10) / 10).alias("direction"), (1 + k % 12).alias("breadth"),
        F.when(F.col("event_type") == "error", "retired").otherwise(F.col("event_type")).alias("event"), "event_id",
    )


def _lineage(spark, d):
    """One row a day of an expectation."""
    from pyspark.sql import Window

    return _lineage_rows(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("expectation_id", "as_of").orderBy("event_id"))).where("r = 1")


@query(f"""WITH {SQL_LINEAGE}, pl AS (SELECT as_of, expectation_id, parent_id, CASE WHEN direction < -0.2 THEN 0 WHEN direction < 0.2 THEN 1 ELSE 2 END AS x, CASE WHEN breadth < 4 THEN 0 WHEN breadth < 8 THEN 1 ELSE 2 END AS y FROM ex),
bn AS (SELECT * FROM pl WHERE parent_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY expectation_id ORDER BY as_of) = 1), mv AS (SELECT bn.as_of, bn.x, bn.y, pl.x AS px, pl.y AS py FROM bn JOIN pl ON pl.as_of = bn.as_of AND pl.expectation_id = bn.parent_id WHERE bn.x <> pl.x OR bn.y <> pl.y)
SELECT as_of, x, y, cast(sum(i) AS BIGINT) AS flux_in, cast(sum(o) AS BIGINT) AS flux_out FROM (SELECT as_of, x, y, 1 AS i, 0 AS o FROM mv UNION ALL SELECT as_of, px, py, 0, 1 FROM mv) GROUP BY ALL""")
def grid_flux(spark, d):
    return field.parent_flux(_lineage(spark, d))


@query(f"""WITH {SQL_LINEAGE}, dy AS (SELECT as_of, count(*) AS n, count(*) FILTER (event = 'retired') AS g FROM xp GROUP BY 1)
SELECT a.as_of, cast(sum(b.g) AS BIGINT) AS mortality, round(sum(b.g) / avg(b.n), 6) AS rate FROM dy a JOIN dy b ON b.as_of BETWEEN a.as_of - 7 AND a.as_of GROUP BY 1""")
def field_mortality(spark, d):
    """Every retirement counts, whatever else happens to the expectation that day."""
    return field.mortality(_lineage_rows(spark, d)).withColumn("rate", F.round("rate", 6))


#: Expectations with families, statuses, deaths and shares.
SQL_STANDING = SQL_LINEAGE + """,
st AS (SELECT as_of, expectation_id, parent_id, direction, breadth, event AS kind, 'f' || expectation_id % 6 AS family, CASE WHEN event = 'view' THEN 'weakening' WHEN event = 'signup' AND expectation_id % 3 = 0 THEN 'dormant' ELSE 'active' END AS status,
  CASE WHEN event = 'retired' AND expectation_id % 2 = 0 THEN 'died' ELSE 'stable' END AS event, breadth / 12 AS share, as_of - min(as_of) OVER (PARTITION BY expectation_id) AS days_alive FROM ex),
sd AS (SELECT * FROM st WHERE status IN ('active', 'weakening'))"""


def _standing(spark, d):
    from pyspark.sql import Window

    x, kind, id_ = _lineage(spark, d), F.col("event"), F.col("expectation_id")
    return x.select(
        "as_of", "expectation_id", "parent_id", "direction", "breadth", kind.alias("kind"), F.concat(F.lit("f"), (id_ % 6).cast("string")).alias("family"), F.when(kind == "view", "weakening").when((kind == "signup") & (id_ % 3 == 0), "dormant").otherwise("active").alias("status"),
        F.when((kind == "retired") & (id_ % 2 == 0), "died").otherwise("stable").alias("event"), (F.col("breadth") / 12).alias("share"), F.datediff("as_of", F.min("as_of").over(Window.partitionBy("expectation_id"))).alias("days_alive"),
    )


@query(f"""WITH {SQL_STANDING}, u AS (SELECT as_of, unnest([{{'o': 'kind', 'v': kind}}, {{'o': 'family', 'v': family}}, {{'o': 'status', 'v': status}}, {{'o': 'age', 'v': CASE WHEN days_alive <= 7 THEN '0_7d' WHEN days_alive <= 30 THEN '8_30d' ELSE '31_plus' END}}]) AS x FROM sd)
SELECT as_of, x.o AS of, x.v AS value, count(*) AS n FROM u GROUP BY ALL""")
def expectation_counts(spark, d):
    return field.snapshot_counts(_standing(spark, d))


@query(f"""WITH {SQL_STANDING}, b AS (SELECT as_of, count(*) AS breadth, avg(share) AS alignment, count(parent_id) / count(*) AS refinement, count(*) FILTER (status = 'weakening') / count(*) AS stress FROM sd GROUP BY 1),
h AS (SELECT as_of, sum(p * p) AS concentration FROM (SELECT as_of, count(*) / sum(count(*)) OVER (PARTITION BY as_of) AS p FROM sd GROUP BY as_of, family) GROUP BY 1),
g AS (SELECT as_of, count(*) FILTER (event = 'died') AS g FROM st GROUP BY 1), m AS (SELECT a.as_of, cast(sum(b.g) AS BIGINT) AS mortality FROM g a JOIN g b ON b.as_of BETWEEN a.as_of - 7 AND a.as_of GROUP BY 1),
dy AS (SELECT as_of, lag(as_of) OVER (ORDER BY as_of) AS prev FROM b), bo AS (SELECT dy.as_of, count(*) AS c FROM dy JOIN sd x ON x.as_of = dy.as_of JOIN sd y ON y.as_of = dy.prev AND y.expectation_id = x.expectation_id GROUP BY 1)
SELECT b.as_of, b.breadth, round(b.alignment, 4) AS alignment, round(b.refinement, 4) AS refinement, round(b.stress, 4) AS stress, round(concentration, 4) AS concentration, mortality,
  round(CASE WHEN q.breadth IS NOT NULL THEN 1 - coalesce(c, 0) / (b.breadth + q.breadth - coalesce(c, 0)) END, 4) AS drift FROM b JOIN h USING (as_of) JOIN m USING (as_of) JOIN dy USING (as_of) LEFT JOIN b q ON q.as_of = dy.prev LEFT JOIN bo ON bo.as_of = b.as_of""")
def field_scope_metrics(spark, d):
    out = field.scope_metrics(_standing(spark, d))
    return out.withColumns({c: F.round(c, 4) for c in ("alignment", "refinement", "stress", "concentration", "drift")})


SQL_CLAIMS = SQL_STANDING + """,
ho AS (SELECT expectation_id, as_of AS birth, parent_id, CASE WHEN direction < -0.2 THEN 0 WHEN direction < 0.2 THEN 1 ELSE 2 END AS x, CASE WHEN breadth < 4 THEN 0 WHEN breadth < 8 THEN 1 ELSE 2 END AS y FROM sd QUALIFY row_number() OVER (PARTITION BY expectation_id ORDER BY as_of) = 1),
cl AS (SELECT sd.as_of, sd.expectation_id, sd.status, ho.x, ho.y, sd.as_of = birth AS born FROM sd JOIN ho USING (expectation_id)), days AS (SELECT as_of, row_number() OVER (ORDER BY as_of) AS day FROM (SELECT DISTINCT as_of FROM sd)),
mv AS (SELECT a.birth AS as_of, a.x, a.y, b.x AS px, b.y AS py FROM ho a JOIN ho b ON b.expectation_id = a.parent_id WHERE a.x <> b.x OR a.y <> b.y),
dd AS (SELECT DISTINCT as_of, expectation_id, x, y FROM st JOIN ho USING (expectation_id) WHERE event = 'died' AND birth <= as_of),
dg AS (SELECT d.as_of, a.v AS x, b.v AS y, (SELECT count(*) FROM cl c WHERE c.as_of = d.as_of AND c.x = a.v AND c.y = b.v) AS density, (SELECT count(*) FROM cl c WHERE c.as_of = d.as_of AND c.x = a.v AND c.y = b.v AND status = 'weakening') AS weakening,
  (SELECT count(*) FROM cl c WHERE c.as_of = d.as_of AND c.x = a.v AND c.y = b.v AND born) AS born, (SELECT count(*) FROM dd c WHERE c.as_of = d.as_of AND c.x = a.v AND c.y = b.v) AS retired,
  (SELECT count(*) FROM mv c WHERE c.as_of = d.as_of AND c.x = a.v AND c.y = b.v) AS flux_in, (SELECT count(*) FROM mv c WHERE c.as_of = d.as_of AND c.px = a.v AND c.py = b.v) AS flux_out
  FROM days d, (VALUES (0), (1), (2)) a(v), (VALUES (0), (1), (2)) b(v)),
gd AS (SELECT *, CASE WHEN density > 0 THEN weakening / density ELSE 0 END AS pressure FROM dg)"""


@query(f"WITH {SQL_CLAIMS} SELECT as_of, x, y, density, weakening, born, retired, flux_in, flux_out, round(pressure, 4) AS pressure FROM gd")
def claim_grid(spark, d):
    return field.claim_grid(_standing(spark, d)).withColumn("pressure", F.round("pressure", 4))


@query(f"""WITH {SQL_CLAIMS} SELECT x, y, round(avg(density), 4) AS density, count(*) FILTER (density > 0) AS days_occupied, round(coalesce(avg(pressure) FILTER (density > 0), 0), 4) AS pressure, sum(born)::BIGINT AS born, sum(retired)::BIGINT AS retired, sum(flux_in)::BIGINT AS flux_in, sum(flux_out)::BIGINT AS flux_out FROM gd GROUP BY ALL""")
def claim_summary(spark, d):
    out = field.claim_summary(field.claim_grid(_standing(spark, d)))
    return out.withColumns({"density": F.round("density", 4), "pressure": F.round("pressure", 4)})


@query(f"""WITH {SQL_CLAIMS}, rn AS (SELECT cl.*, day - row_number() OVER (PARTITION BY expectation_id ORDER BY cl.as_of) AS run FROM cl JOIN days USING (as_of)), br AS (SELECT expectation_id, x, y, run, count(*) AS n FROM rn GROUP BY ALL),
lt AS (SELECT expectation_id, arg_max(status, as_of) AS last_status, min(as_of) AS born_at FROM cl GROUP BY 1)
SELECT expectation_id, x, y, sum(n)::BIGINT AS days_in_cell, count(*) AS stays, max(n) AS longest, any_value(born_at) AS born_at, any_value(last_status) AS last_status,
  CASE WHEN count(dead) > 0 THEN 'retired' WHEN any_value(last_status) = 'weakening' THEN 'weakening' ELSE 'durable' END AS outcome FROM br JOIN lt USING (expectation_id) LEFT JOIN (SELECT DISTINCT expectation_id, 1 AS dead FROM st WHERE event = 'died') USING (expectation_id) GROUP BY expectation_id, x, y""")
def claim_occupants(spark, d):
    return field.occupants(_standing(spark, d))


SQL_COHORT = """ev AS (SELECT user_id AS actor, event_type AS c, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events),
sn AS (SELECT actor, c AS state_class FROM ev WHERE r = 1 AND actor % 9 <> 2), pr AS (SELECT actor, c AS prior_class FROM ev WHERE r = 6),
mb AS (SELECT actor % 6 AS question_id, actor FROM (SELECT DISTINCT user_id AS actor FROM events)), se AS (SELECT question_id, actor, state_class, prior_class FROM mb JOIN sn USING (actor) LEFT JOIN pr USING (actor)),
gr AS (SELECT question_id, state_class, count(*) AS n, count(*) FILTER (state_class = prior_class) AS same, count(prior_class) AS known, string_agg(actor::VARCHAR, ',' ORDER BY actor::VARCHAR) AS members FROM se GROUP BY ALL),
gg AS (SELECT *, CASE WHEN max(known) OVER (PARTITION BY question_id) = 0 THEN NULL WHEN same / n < 0.5 THEN 'emerging' WHEN same / n >= 0.66 THEN 'repeating' END AS reads FROM gr), gb AS (SELECT * FROM gg WHERE n >= 3)"""


def _cohorts(spark, d):
    from pyspark.sql import Window

    e = read(spark, d, "events").select(F.col("user_id").cast("string").alias("actor"), F.col("user_id").alias("id"), "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))).alias("r"))
    cohorts = e.select("id", "actor").distinct().groupBy((F.col("id") % 6).alias("question_id")).agg(F.collect_list("actor").alias("cohort"))
    snapshot = e.where("r = 1 and id % 9 <> 2").select("actor", F.col("event_type").alias("state_class"))
    return cohorts, snapshot, e.where("r = 6").select("actor", F.col("event_type").alias("prior_class"))


@query(f"WITH {SQL_COHORT} SELECT question_id, state_class, n, members, same AS n_same, known AS n_known, reads FROM gb")
def cohort_groups(spark, d):
    cohorts, snapshot, prior = _cohorts(spark, d)
    seen = cohorts.select("question_id", F.explode("cohort").alias("actor")).join(snapshot, "actor").join(prior, "actor", "left")
    return field.cohort_groups(seen).withColumn("members", F.array_join("members", ","))


@query(f"""WITH {SQL_COHORT}, ac AS (SELECT question_id, string_agg(actor::VARCHAR, ',' ORDER BY actor::VARCHAR) AS in_snapshot, count(*) AS m, count(*) FILTER (state_class <> prior_class) AS transitions FROM se GROUP BY 1),
ms AS (SELECT question_id, coalesce(string_agg(actor::VARCHAR, ',' ORDER BY actor::VARCHAR) FILTER (actor NOT IN (SELECT actor FROM sn)), '') AS missing FROM mb GROUP BY 1),
cl AS (SELECT question_id, count(*) AS n_classes, sum(n) AS t, max(n) AS top, count(*) FILTER (n >= 2) AS pairs, arg_min(state_class, {{'a': -n, 'b': state_class}}) AS dominant FROM gr GROUP BY 1),
gx AS (SELECT question_id, count(*) AS ng, count(*) FILTER (reads = 'emerging') AS em, count(*) FILTER (reads = 'repeating') AS rp, count(*) FILTER (state_class = 'error') AS te, list(state_class ORDER BY n DESC, state_class) AS g FROM gb GROUP BY 1)
SELECT question_id, in_snapshot, missing, n_classes, dominant, round(top / t, 3) AS share, top / t <= 0.33 AS is_fragmented, CASE WHEN top / t >= 0.66 THEN 'cohort behaving as one coherent class' WHEN top / t <= 0.33 THEN 'cohort fragmented across ' || n_classes || ' distinct read classes'
  WHEN coalesce(ng, 0) >= 2 THEN 'cohort no longer one coherent class \u2014 ' || g[1] || ' and ' || g[2] || ' both visible' ELSE 'cohort mixed; no single dominant pattern' END AS cohesion, transitions, coalesce(em, 0) AS n_emerging, coalesce(rp, 0) AS n_repeating, coalesce(te, 0) AS n_tension,
  least(100, 10 * transitions + 15 * coalesce(em, 0) + 10 * coalesce(te, 0)) AS pressure, coalesce(ng, 0) >= 2 AS split_ready, top / t <= 0.33 AND pairs >= 3 AND m >= 6 AS too_broad FROM ac JOIN ms USING (question_id) JOIN cl USING (question_id) LEFT JOIN gx USING (question_id)""")
def cohort_state(spark, d):
    out = field.cohort_state(*_cohorts(spark, d), ["error"])
    return out.withColumns({"in_snapshot": F.array_join("in_snapshot", ","), "missing": F.array_join("missing", ",")})
