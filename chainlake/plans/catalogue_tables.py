"""Queries over attributes, catalogues, vectors and p values."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlake.functions import clean as C
from chainlake.operators import conditional as D
from chainlake.operators import markov as M
from chainlake.operators import matching as J
from chainlake.operators import stats as V
from chainlake.operators import validation as I
from chainlake.operators import vectors as K
from chainlake.operators.sequences import adjacent
from chainlake.plans.registry import ATTRIBUTES, ORDERS, PAIRS, customer_attributes, event_sequences, matrix_sql, order_sequences, query, read, rounded, vectors

RAW = ["yes", "No, never", "Northern", "no, but yes", "TRUE", "0.0", "n/a", "???", "--", " ", None, "about 12.5 years", "3 or 4", "us", "new york-city", "M", "Caucasian", "self employed", "Not  Available", "plain text"]
VALUES = "raw(id, value) AS (VALUES " + ", ".join(f"({i}, {'NULL' if v is None else chr(39) + v + chr(39)})" for i, v in enumerate(RAW)) + ")"
MISSING = "CASE WHEN value IS NULL OR regexp_matches(trim(value), '(?i)^(missing|none|nan|n/a|na|unknown|not found|not available|not reported|\\?+|-+|_+)?$') THEN 'Unknown' ELSE trim(value) END"


def _raw(spark):
    return spark.createDataFrame(list(enumerate(RAW)), "id int, value string")


@query(f"WITH {VALUES} SELECT id, {MISSING} AS value FROM raw")
def clean_missing(spark, sf):
    return _raw(spark).select("id", C.standardize_missing(F.col("value")).alias("value"))


@query(f"""WITH {VALUES}, l AS (SELECT *, lower(trim(value)) AS v FROM raw) SELECT id, CASE WHEN regexp_matches(v, '^(yes|true)') OR v IN ('y', '1', '1.0') THEN 'Yes'
  WHEN regexp_matches(v, '^(no|false)') OR v IN ('n', '0', '0.0') THEN 'No' WHEN contains(v, 'no') AND NOT contains(v, 'yes') THEN 'No'
  WHEN contains(v, 'yes') AND NOT contains(v, 'no') THEN 'Yes' ELSE value END AS value FROM l""")
def clean_yes_no(spark, sf):
    return _raw(spark).select("id", C.standardize_yes_no(F.col("value")).alias("value"))


@query(f"""WITH {VALUES}, l AS (SELECT *, regexp_extract(value, '(\\d+(?:\\.\\d+)?)', 1) AS f FROM raw)
  SELECT id, CASE WHEN length(f) > 0 THEN f ELSE value END AS value, coalesce(try_cast(nullif(regexp_extract(value, '(\\d+)', 1), '') AS DOUBLE), 0.0::DOUBLE) AS number FROM l""")
def clean_numeric(spark, sf):
    return _raw(spark).select("id", C.standardize_numeric(F.col("value")).alias("value"), C.numeric_value(F.col("value")).alias("number"))


@query(f"""WITH {VALUES}, l AS (SELECT *, regexp_replace(trim(value), '\\s+', ' ', 'g') AS one FROM raw)
  SELECT id, CASE WHEN upper(one) IN ('USA', 'US', 'U.S.', 'U.S.A.') THEN 'United States' WHEN upper(one) IN ('UK', 'U.K.') THEN 'United Kingdom'
    ELSE array_to_string(list_transform(regexp_extract_all(one, '[A-Za-z]+|[^A-Za-z]+'), lambda r: upper(r[1]) || lower(r[2:])), '') END AS value FROM l""")
def clean_location(spark, sf):
    return _raw(spark).select("id", C.standardize_location(F.col("value")).alias("value"))


@query(f"""WITH {VALUES} SELECT id, CASE WHEN lower(trim(value)) IN ('m', 'male') THEN 'Male' WHEN lower(trim(value)) IN ('f', 'female') THEN 'Female' ELSE value END AS sex,
  CASE WHEN lower(trim(value)) IN ('white', 'caucasian') THEN 'White' ELSE value END AS race FROM raw""")
def clean_category(spark, sf):
    return _raw(spark).select("id", C.standardize_category(F.col("value"), C.SEXES).alias("sex"), C.standardize_category(F.col("value"), C.RACES).alias("race"))


@query("""SELECT * FROM (VALUES ('12', 12.0::DOUBLE), ('12-15', 12.0), ('-5', 9999.0), ('Childhood', 9999.0), (' 0', 0.0), (NULL, 9999.0)) t(age, parsed)""")
def parse_age(spark, sf):
    ages = spark.createDataFrame([(a,) for a in ("12", "12-15", "-5", "Childhood", " 0", None)], "age string")
    return ages.select("age", C.parse_age(F.col("age")).alias("parsed"))


EAV = [(1, "Sex", "m", 0), (1, "Physically abused?", "Yes, often", 1), (1, "Number of victims", "about 3", 2), (2, "Sex", "Female", 0), (2, "Physically abused?", "never", 1), (2, "Sex", "F", 2), (3, "Number of victims", "4", 0), (3, "Physically abused?", None, 1)]


def _eav(spark):
    return spark.createDataFrame(EAV, "entity int, heading string, value string, source_row int").withColumn("heading_key", F.lower("heading"))


EAV_SQL = "eav(entity, heading, value, source_row) AS (VALUES " + ", ".join(f"({e}, '{h}', {'NULL' if v is None else chr(39) + v + chr(39)}, {s})" for e, h, v, s in EAV) + ")"


@query("""SELECT * FROM (VALUES (1, 'Sex', 'Male', 0), (1, 'Physically abused', 'Yes', 1), (1, 'Number of victims', '3', 2), (2, 'Sex', 'Female', 0), (2, 'Physically abused', 'never', 1),
  (2, 'Sex', 'Female', 2), (3, 'Number of victims', '4', 0), (3, 'Physically abused', 'Unknown', 1)) t(entity, heading, value, source_row)""")
def clean_eav(spark, sf):
    return C.clean_attributes(_eav(spark)).select("entity", "heading", "value", "source_row")


@query(f"WITH {EAV_SQL} SELECT lower(heading) AS heading_key, entity, min_by(value, source_row) FILTER (WHERE value IS NOT NULL) AS first_value, max_by(value, source_row) FILTER (WHERE value IS NOT NULL) AS last_value FROM eav GROUP BY ALL HAVING count(value) > 0")
def eav_first_vs_last(spark, sf):
    eav = _eav(spark).where("value IS NOT NULL")
    first = D.condition_map(eav, first=True).withColumnRenamed("value", "first_value")
    return first.join(D.condition_map(eav).withColumnRenamed("value", "last_value"), ["heading_key", "entity"])


@query(f"""WITH {EAV_SQL}, e AS (SELECT DISTINCT entity FROM eav), h AS (SELECT DISTINCT lower(heading) AS heading_key FROM eav), m AS (SELECT lower(heading) AS heading_key, entity, max_by(value, source_row) AS value FROM eav WHERE value IS NOT NULL GROUP BY ALL)
  SELECT heading_key, entity, coalesce(value, 'Unknown') AS value FROM e CROSS JOIN h LEFT JOIN m USING (heading_key, entity)""")
def condition_map_unknown(spark, sf):
    eav = _eav(spark)
    return D.assigned(eav, eav.where("value IS NOT NULL").unionByName(eav.where("value IS NULL"))).select("heading_key", "entity", "value")


@query("SELECT * FROM (VALUES (1, 1, 0, 3.0::DOUBLE, 0, 0), (2, 0, 0, 0.0, 0, 0), (3, 0, 0, 4.0, 0, 0)) t(entity, abused, male, victims, education, employed)")
def feature_vectors(spark, sf):
    return C.feature_vectors(_eav(spark))


@query("SELECT c_custkey AS entity, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'BUILDING' ELSE c_mktsegment END AS value FROM customer")
def merge_categories(spark, sf):
    attr = customer_attributes(spark, sf).where("heading = 'Segment'")
    return C.merge_similar(attr, "Segment", [["BUILDING", "MACHINERY"], ["alone"]]).select("entity", "value")


@query("SELECT 'Segment' AS heading, count(DISTINCT c_mktsegment) AS values_before, count(DISTINCT CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'BUILDING' ELSE c_mktsegment END) AS values_after FROM customer")
def quality_report(spark, sf):
    attr = customer_attributes(spark, sf)
    return J.quality_report(attr, C.merge_similar(attr, "Segment", [["BUILDING", "MACHINERY"]]))


LEFT, RIGHT = ["Type1_A_B", "Type1_X_2005", "Type1_Only_Left", "Type1_C_D__2012_"], ["Type2_a_b_clean_clean", "Type2_X_2005_clean", "Type2_only_right", "Type2_c_d"]


def _names(spark):
    return (spark.createDataFrame([(n,) for n in x], "name string") for x in (LEFT, RIGHT))


@query("SELECT * FROM (VALUES ('a_b', 'Type1_A_B', 'Type2_a_b_clean_clean'), ('x_2005', 'Type1_X_2005', 'Type2_X_2005_clean')) t(key, left_name, right_name)")
def match_inner(spark, sf):
    return J.matched(*_names(spark))


@query("SELECT * FROM (VALUES ('Type1_A_B', 'Type2_a_b_clean_clean'), ('Type1_X_2005', 'Type2_X_2005_clean'), ('Type1_Only_Left', NULL), ('Type1_C_D__2012_', 'Type2_c_d')) t(left_name, right_name)")
def match_fuzzy(spark, sf):
    return J.fuzzy(*_names(spark))


@query("SELECT 2::BIGINT AS n_matched, 2::BIGINT AS left_only, 2::BIGINT AS right_only, 0.5::DOUBLE AS left_rate, 0.5::DOUBLE AS right_rate")
def match_stats(spark, sf):
    return J.match_statistics(*_names(spark))


@query("SELECT 'left' AS side, c_custkey AS entity FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT 'right', o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def match_validate(spark, sf):
    return J.unmatched(read(spark, sf, "customer").select(F.col("c_custkey").alias("entity")), read(spark, sf, "orders").select(F.col("o_custkey").alias("entity")), "entity")


COND = f"""WITH {ORDERS}, {ATTRIBUTES}, {matrix_sql()}, groups AS (SELECT heading_key, value, count(DISTINCT entity) AS n FROM attr GROUP BY ALL HAVING count(DISTINCT entity) >= 5),
  gc AS (SELECT heading_key, value, from_state, to_state, count(*) AS c FROM attr JOIN pairs USING (entity) GROUP BY ALL),
  cells AS (SELECT heading_key, value, a.state AS from_state, b.state AS to_state FROM groups, states a, states b),
  gm0 AS (SELECT cells.*, coalesce(c, 0)::BIGINT AS cnt FROM cells LEFT JOIN gc USING (heading_key, value, from_state, to_state)),
  gm AS (SELECT *, CASE WHEN sum(cnt) OVER w > 0 THEN cnt::DOUBLE / sum(cnt) OVER w ELSE 1.0::DOUBLE / (SELECT count(*) FROM states) END AS prob FROM gm0 WINDOW w AS (PARTITION BY heading_key, value, from_state)),
  both_m AS (SELECT gm.*, m.prob AS q FROM gm JOIN matrix m USING (from_state, to_state)) """


def _conditional(spark, sf):
    seq = order_sequences(spark, sf)
    return D.conditional_matrices(seq, customer_attributes(spark, sf)), M.transition_matrix(seq)


@query(COND + "SELECT heading_key, value, from_state, to_state, cnt, round(prob, 6) AS prob FROM gm")
def transition_matrix_conditional(spark, sf):
    return rounded(_conditional(spark, sf)[0])


@query(COND + """, sp AS (SELECT heading_key, value, prob, row_number() OVER (PARTITION BY heading_key, value ORDER BY prob) AS r FROM both_m), sq AS (SELECT heading_key, value, q, row_number() OVER (PARTITION BY heading_key, value ORDER BY q) AS r FROM both_m),
  w1 AS (SELECT heading_key, value, avg(abs(prob - q)) AS w1 FROM sp JOIN sq USING (heading_key, value, r) GROUP BY ALL)
  SELECT heading_key, value, round(sum(abs(prob - q)), 6) AS l1, round(sum(abs(prob - q)) / 2, 6) AS tv, round(sqrt(sum((prob - q) ** 2)), 6) AS frobenius, round(any_value(w1), 6) AS w1 FROM both_m JOIN w1 USING (heading_key, value) GROUP BY ALL""")
def conditional_insights_l1_tv_fro_w1(spark, sf):
    return rounded(D.distances(*_conditional(spark, sf), "heading_key", "value"))


@query(COND + """, t AS (SELECT heading_key, value, trunc(prob * 1000)::INT AS a, trunc(q * 1000)::INT AS b FROM both_m), u AS (SELECT *, sum(a) OVER w AS ra, sum(b) OVER w AS rb FROM t WHERE a + b > 0 WINDOW w AS (PARTITION BY heading_key, value)),
  e AS (SELECT *, ra * (a + b)::DOUBLE / (ra + rb) AS ea, rb * (a + b)::DOUBLE / (ra + rb) AS eb FROM u)
  SELECT heading_key, value, round(sum((a - ea) ** 2 / ea + (b - eb) ** 2 / eb), 6) AS chi2, count(*) - 1 AS dof FROM e GROUP BY ALL""")
def conditional_chi2_stat(spark, sf):
    return rounded(D.chi2_statistic(*_conditional(spark, sf), "heading_key", "value"))


@query(COND + """, l AS (SELECT heading_key, value, round(prob, 9) AS v, 1 AS a FROM both_m UNION ALL SELECT heading_key, value, round(q, 9), 0 FROM both_m),
  s AS (SELECT heading_key, value, v, sum(a) AS a, sum(1 - a) AS b FROM l GROUP BY ALL),
  c AS (SELECT heading_key, value, abs(sum(a) OVER u::DOUBLE / sum(a) OVER w - sum(b) OVER u::DOUBLE / sum(b) OVER w) AS d FROM s WINDOW w AS (PARTITION BY heading_key, value), u AS (PARTITION BY heading_key, value ORDER BY v))
  SELECT heading_key, value, round(max(d), 6) AS ks FROM c GROUP BY ALL""".replace("sum(a) OVER u::DOUBLE", "(sum(a) OVER u)::DOUBLE").replace("sum(b) OVER u::DOUBLE", "(sum(b) OVER u)::DOUBLE"))
def conditional_ks_stat(spark, sf):
    return rounded(D.ks_statistic(*_conditional(spark, sf), "heading_key", "value"))


@query(f"""WITH {ORDERS}, {ATTRIBUTES}, t AS (SELECT count(DISTINCT entity) AS total, count(DISTINCT state) AS k FROM seq),
  g AS (SELECT heading_key, value, count(DISTINCT a.entity) AS n, count(DISTINCT s.entity) AS n_sequences, count(DISTINCT state) AS n_states FROM attr a LEFT JOIN seq s USING (entity) GROUP BY ALL)
  SELECT heading_key, value, n, n_sequences, n_states, n >= 5 AND n <= 0.8 * total AND n_sequences >= 3 AND n_states >= 0.5 * k AS passes FROM g, t""")
def quick_significance(spark, sf):
    return D.quick_significance(order_sequences(spark, sf), customer_attributes(spark, sf))


@query()
def conditional_insights(spark, sf):
    return D.insights(order_sequences(spark, sf), customer_attributes(spark, sf))


ROLL = COND + ", ins AS (SELECT heading_key, value, sum(abs(prob - q)) AS l1 FROM both_m GROUP BY ALL) "


@query(ROLL + "SELECT heading_key, count(*) AS n_insights, count(*) FILTER (WHERE l1 > 0.5) AS n_large, round(avg(l1), 6) AS mean_l1, max_by(value, round(l1, 9)) AS top_value FROM ins GROUP BY ROLLUP (heading_key)")
def insight_rollup(spark, sf):
    ins = D.distances(*_conditional(spark, sf), "heading_key", "value")
    return rounded(ins.rollup("heading_key").agg(F.count(F.lit(1)).alias("n_insights"), F.count_if(F.col("l1") > 0.5).alias("n_large"), F.avg("l1").alias("mean_l1"), F.max_by("value", F.round("l1", 9)).alias("top_value")))


@query(ROLL + "SELECT CASE WHEN l1 < 0.2 THEN 'negligible' WHEN l1 < 0.5 THEN 'small' WHEN l1 < 0.8 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n FROM ins GROUP BY 1")
def effect_buckets(spark, sf):
    ins = D.distances(*_conditional(spark, sf), "heading_key", "value")
    l1 = F.col("l1")
    return ins.groupBy(F.when(l1 < 0.2, "negligible").when(l1 < 0.5, "small").when(l1 < 0.8, "medium").otherwise("large").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(COND + "SELECT heading_key, value, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY heading_key), 6) AS share FROM groups")
def group_statistics(spark, sf):
    g = D.large_groups(customer_attributes(spark, sf))
    return rounded(g.withColumn("share", F.col("n") / F.sum("n").over(M.Window.partitionBy("heading_key"))))


VEC = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), dims AS (SELECT id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
  cent AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM dims GROUP BY ALL) GROUP BY 1),
  dist AS (SELECT id, label, v, c, list_distance(v, c) AS d, list_cosine_similarity(v, c) AS cosine FROM v JOIN cent USING (label)) """


@query(f"WITH {VEC} SELECT label, i - 1 AS i, round(avg(x), 5) AS x FROM dims GROUP BY ALL")
def prototypes(spark, sf):
    p = K.prototypes(vectors(spark, sf)).select("label", F.posexplode("centroid").alias("i", "x"))
    return rounded(p.withColumn("i", F.col("i").cast("long")), 5)


@query(f"WITH {VEC} SELECT label, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM v), 5) AS share, round(avg(d), 5) AS mean_distance, round(stddev_pop(d), 5) AS std_distance FROM dist GROUP BY 1")
def cluster_profile(spark, sf):
    return rounded(K.cluster_profile(vectors(spark, sf)), 5)


@query(f"WITH {VEC} SELECT * FROM (SELECT label, id, round(cosine, 5) AS cosine, row_number() OVER (PARTITION BY label ORDER BY round(cosine, 9) DESC, id) AS rank FROM dist) WHERE rank <= 3")
def representatives(spark, sf):
    return rounded(K.representatives(vectors(spark, sf)), 5)


@query(f"WITH {VEC} SELECT id, arg_min(c.label, list_distance(v.v, c.c)) AS predicted FROM v, cent c GROUP BY id")
def nearest_prototype(spark, sf):
    df = vectors(spark, sf)
    return K.nearest_prototype(df, K.prototypes(df))


@query(f"""WITH {VEC}, p AS (SELECT a.id, a.label, b.label AS other, avg(list_distance(a.v, b.v)) AS d FROM v a, v b WHERE a.id <> b.id GROUP BY ALL),
  s AS (SELECT id, label, max(d) FILTER (WHERE label = other) AS a, min(d) FILTER (WHERE label <> other) AS b FROM p GROUP BY ALL)
  SELECT label, round(avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette, count(*) AS n FROM s GROUP BY 1""")
def silhouette_exact(spark, sf):
    return rounded(K.silhouette(vectors(spark, sf)), 5)


@query(f"""WITH {VEC}, m AS (SELECT list(x ORDER BY i) AS m FROM (SELECT i, avg(x) AS x FROM dims GROUP BY 1)), s AS (SELECT label, count(*) AS n, any_value(c) AS c, sum(d * d) AS within FROM dist GROUP BY 1)
  SELECT round((sum(n * list_distance(c, m) ** 2) / (count(*) - 1)) / (sum(within) / (sum(n) - count(*))), 4) AS calinski_harabasz, round(sum(within), 4) AS inertia FROM s, m""")
def calinski_harabasz(spark, sf):
    return rounded(K.calinski_harabasz(vectors(spark, sf)), 4)


@query(f"""WITH {VEC}, s AS (SELECT label, any_value(c) AS c, avg(d) AS spread FROM dist GROUP BY 1)
  SELECT round(avg(r), 5) AS davies_bouldin FROM (SELECT a.label, max((a.spread + b.spread) / list_distance(a.c, b.c)) AS r FROM s a, s b WHERE a.label <> b.label GROUP BY 1)""")
def davies_bouldin(spark, sf):
    return rounded(K.davies_bouldin(vectors(spark, sf)), 5)


TWO = "l AS (SELECT vec_id AS id, label, (vec_id % 7)::INT AS other FROM embeddings), x AS (SELECT label, other, count(*) AS c FROM l GROUP BY ALL), a AS (SELECT label, count(*) AS c FROM l GROUP BY 1), b AS (SELECT other, count(*) AS c FROM l GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM l)"


def _two(spark, sf):
    return vectors(spark, sf).select("id", "label", F.pmod("id", F.lit(7)).cast("int").alias("other"))


@query(f"""WITH {TWO}, t AS (SELECT (SELECT sum(c * (c - 1) / 2) FROM x) AS ij, (SELECT sum(c * (c - 1) / 2) FROM a) AS i, (SELECT sum(c * (c - 1) / 2) FROM b) AS j, (SELECT n * (n - 1) / 2 FROM n) AS m)
  SELECT round((ij - i * j / m) / ((i + j) / 2 - i * j / m), 6) AS ari FROM t""")
def ari(spark, sf):
    return rounded(K.adjusted_rand(_two(spark, sf), "label", "other"))


@query(f"""WITH {TWO}, mi AS (SELECT sum(x.c / n * ln(x.c * n / (a.c * b.c))) AS mi FROM x JOIN a USING (label) JOIN b USING (other), n), ha AS (SELECT sum(-c / n * ln(c / n)) AS h FROM a, n), hb AS (SELECT sum(-c / n * ln(c / n)) AS h FROM b, n)
  SELECT round(mi / ((ha.h + hb.h) / 2), 6) AS nmi FROM mi, ha, hb""")
def nmi(spark, sf):
    return rounded(K.normalized_mutual_information(_two(spark, sf), "label", "other"))


RUNS = "runs AS (SELECT 0 AS run, vec_id AS id, label FROM embeddings UNION ALL SELECT 1, vec_id, (vec_id % 7)::INT FROM embeddings), co AS (SELECT x.id AS a, y.id AS b, count(*)::DOUBLE / 2 AS agree FROM runs x JOIN runs y ON x.run = y.run AND x.label = y.label AND x.id < y.id GROUP BY ALL)"


def _runs(spark, sf):
    two = _two(spark, sf)
    return two.select(F.lit(0).alias("run"), "id", "label").unionByName(two.select(F.lit(1).alias("run"), "id", F.col("other").alias("label")))


@query(f"WITH {RUNS} SELECT agree, count(*) AS n_pairs FROM co GROUP BY 1")
def coassociation(spark, sf):
    return K.coassociation(_runs(spark, sf)).groupBy("agree").agg(F.sum("n_pairs").alias("n_pairs"))


@query(f"""WITH {RUNS}, bt AS (SELECT a, b, agree FROM co UNION ALL SELECT b, a, agree FROM co), l AS (SELECT vec_id AS id, label FROM embeddings)
  SELECT x.id, round(coalesce(sum(agree) FILTER (WHERE y.label = x.label), 0) / (SELECT count(*) FROM l z WHERE z.label = x.label), 6) AS confidence FROM l x LEFT JOIN bt ON bt.a = x.id LEFT JOIN l y ON y.id = bt.b GROUP BY x.id, x.label""")
def confidence(spark, sf):
    return rounded(K.confidence(_runs(spark, sf), _two(spark, sf).select("id", "label")))


EDGES = "e AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.3)"


@query(f"WITH {EDGES} SELECT a, b, round(similarity, 5) AS similarity FROM e")
def similarity_edges(spark, sf):
    return rounded(K.similarity_edges(vectors(spark, sf), 0.3), 5)


@query(f"""WITH {EDGES}, d AS (SELECT x, count(*) AS d FROM (SELECT a AS x FROM e UNION ALL SELECT b FROM e) GROUP BY 1)
  SELECT (SELECT count(*) FROM d) AS n_nodes, (SELECT round(avg(d), 6) FROM d) AS average_degree, (SELECT count(*) FROM e) AS n_edges,
    (SELECT count(*) FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b) AS n_triangles""")
def network_stats(spark, sf):
    return rounded(K.similarity_network(vectors(spark, sf), 0.3))


@query(f"""WITH {VEC}, core AS (SELECT id, label, v FROM (SELECT *, quantile_cont(d, 0.85) OVER (PARTITION BY label) AS lim FROM dist) WHERE d <= lim),
  cd AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM core) GROUP BY ALL) GROUP BY 1)
  SELECT label, count(*) AS n_core, round(avg(1.0 / (1.0 + list_distance(v, c))), 5) AS representativeness FROM core JOIN cd USING (label) GROUP BY 1""")
def archetypes(spark, sf):
    return rounded(K.archetypes(vectors(spark, sf)), 5)


P = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216, 0.222, 0.251, 0.269, 0.275, 0.34, 0.341, 0.384, 0.569, 0.594, 0.696]
P_SQL = "p(id, p) AS (VALUES " + ", ".join(f"({i}, {v}::DOUBLE)" for i, v in enumerate(P)) + ")"


@query(f"""WITH {P_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS rank, count(*) OVER () AS m FROM p)
  SELECT id, p, rank, round(least(1.0, min(p * m / rank) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS bh, round(least(1.0, p * m), 6) AS bonferroni,
    bool_and(p <= rank::DOUBLE / m * 0.05::DOUBLE) OVER (ORDER BY rank) AS stop_first FROM r""")
def p_value_corrections(spark, sf):
    return rounded(V.adjusted(spark.createDataFrame(list(enumerate(P)), "id int, p double")))


@query(f"""WITH {ORDERS}, r AS (SELECT o_orderpriority AS g, o_totalprice AS x FROM orders), c AS (SELECT x, count(*) AS c FROM r GROUP BY 1), k AS (SELECT x, coalesce(sum(c) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / 2.0::DOUBLE AS rank FROM c),
  s AS (SELECT g, sum(rank) AS r, count(*) AS n FROM r JOIN k USING (x) GROUP BY 1), t AS (SELECT sum(n)::DOUBLE AS n, sum(r * r / n) AS s, count(*) AS k FROM s)
  SELECT round(12.0::DOUBLE / (n * (n + 1)) * s - 3 * (n + 1), 4) AS h, n::BIGINT AS n, k FROM t""")
def kruskal_h(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("x"))
    return rounded(V.kruskal_h(o, "g", "x"), 4)


@query("""WITH e AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS k FROM (SELECT DISTINCT user_id AS entity FROM events))
  SELECT entity, ((k * 1103515245 + 12345) % 2147483648) // 65536 % 5 AS fold FROM e""")
def group_folds(spark, sf):
    return V.folds(event_sequences(spark, sf))


@query()
def permutation_label_null(spark, sf):
    return I.silhouette_permutation(vectors(spark, sf))


@query()
def kmeans_states(spark, sf):
    return K.kmeans(vectors(spark, sf), 5)


@query()
def gmm_types(spark, sf):
    return K.gaussian_types(vectors(spark, sf))


@query()
def pca_2d(spark, sf):
    return K.principal(vectors(spark, sf))


@query()
def k_search(spark, sf):
    return K.k_scores(vectors(spark, sf), range(3, 8))


@query(f"WITH {ORDERS}, {PAIRS} SELECT entity, count(*) AS n_pairs FROM pairs GROUP BY 1")
def pair_counts(spark, sf):
    return adjacent(order_sequences(spark, sf)).groupBy("entity").agg(F.count(F.lit(1)).alias("n_pairs"))
