"""Queries over reports, the choice of k and entity vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlake.functions import text as T
from chainlake.operators import entities as E
from chainlake.operators import markov as M
from chainlake.operators import reports as P
from chainlake.operators import selection as O
from chainlake.plans.registry import SEQ, event_sequences, query, read, rounded, vectors

INSIGHTS = """ins AS (SELECT p_brand AS heading, p_type AS value, count(*) AS n, round((count(*) % 13)::DOUBLE / 10, 6) AS l1, round((sum(p_partkey) % 97)::DOUBLE / 97, 6) AS p FROM part GROUP BY ALL)"""


def _insights(spark, sf):
    """A table of the shape of insights: effect and p value derived from counts."""
    g = read(spark, sf, "part").groupBy(F.col("p_brand").alias("heading"), F.col("p_type").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("s"))
    return g.select("heading", "value", "n", F.round(F.pmod("n", F.lit(13)) / 10, 6).alias("l1"), F.round(F.pmod("s", F.lit(97)) / 97, 6).alias("p"))


@query(f"""WITH {INSIGHTS} SELECT CASE WHEN l1 < 0.1 THEN 'negligible' WHEN l1 < 0.3 THEN 'small' WHEN l1 < 0.5 THEN 'medium' ELSE 'large' END AS by_l1,
  CASE WHEN l1 > 0.8 THEN 'Large' WHEN l1 > 0.5 THEN 'Medium' WHEN l1 > 0.2 THEN 'Small' ELSE 'Negligible' END AS by_cohen, count(*) AS n FROM ins GROUP BY ALL""")
def effect_categories(spark, sf):
    return _insights(spark, sf).groupBy(P.effect_category(F.col("l1")).alias("by_l1"), P.effect_category(F.col("l1"), "cohen").alias("by_cohen")).agg(F.count(F.lit(1)).alias("n"))


VALIDATION = f"""WITH {INSIGHTS}, m AS (SELECT *, count(*) OVER () AS m FROM ins), r AS (SELECT count(*) AS n_tests, round(avg(n), 6) AS mean_n, min(n) AS min_n, count(*) FILTER (WHERE n < 10) AS small_samples,
  count(*) FILTER (WHERE l1 > 0.8) AS n_large, count(*) FILTER (WHERE l1 BETWEEN 0.5 AND 0.8) AS n_medium, count(DISTINCT p) AS n_distinct_p, count(*) FILTER (WHERE p < 0.05) AS n_significant,
  count(*) FILTER (WHERE p < 0.05::DOUBLE / m) AS n_bonferroni, count(*) FILTER (WHERE p < 0.05 AND n < 10) AS n_small_significant, min(p) AS min_p, max(p) AS max_p, round(avg(p), 6) AS mean_p FROM m) """


@query(VALIDATION + "SELECT * FROM r")
def validation_report(spark, sf):
    return rounded(P.validation(_insights(spark, sf)))


@query(VALIDATION + "SELECT s AS silhouette, CASE WHEN s > 0.5 THEN 'Good' WHEN s > 0.25 THEN 'Moderate' ELSE 'Poor but realistic for behavioral data' END AS clustering, CASE WHEN s < 0.1 AND small_samples > n_tests * 0.2 THEN 'Limited validity - concerns: Many small sample sizes, Poor clustering quality' WHEN s < 0.1 THEN 'Moderate validity - concern: Poor clustering quality' WHEN small_samples > n_tests * 0.2 THEN 'Moderate validity - concern: Many small sample sizes' ELSE 'High validity - results are trustworthy' END AS validity FROM r, (VALUES (0.05::DOUBLE), (0.3), (0.6)) t(s)")
def verdicts(spark, sf):
    r = P.validation(_insights(spark, sf)).join(spark.createDataFrame([(0.05,), (0.3,), (0.6,)], "silhouette double"))
    return r.select("silhouette", P.clustering_verdict(F.col("silhouette")).alias("clustering"), P.validity_verdict(F.col("small_samples"), F.col("n_tests"), F.col("n_significant"), F.col("silhouette")).alias("validity"))


@query(f"WITH {INSIGHTS} SELECT CASE WHEN heading IN ('Brand#11', 'Brand#12') THEN 'first' ELSE 'second' END AS family, count(*) AS n, count(*) FILTER (WHERE p < 0.05) AS n_significant, round(avg(l1), 6) AS mean_l1 FROM ins WHERE heading IN ('Brand#11', 'Brand#12', 'Brand#21') GROUP BY 1")
def insight_families(spark, sf):
    return rounded(P.families(_insights(spark, sf), {"first": ["Brand#11", "Brand#12"], "second": ["Brand#21"]}))


@query(f"WITH {SEQ}, per AS (SELECT entity, count(*) AS n FROM seq GROUP BY 1) SELECT count(*) AS n_entities, sum(n)::BIGINT AS n_events, round(avg(n), 6) AS average_length, min(n) AS shortest, max(n) AS longest FROM per")
def run_summary(spark, sf):
    return rounded(P.run_summary(event_sequences(spark, sf), _insights(spark, sf))[0])


@query(f"WITH {INSIGHTS} SELECT * FROM ins ORDER BY l1 DESC, heading, value LIMIT 5")
def top_insights(spark, sf):
    return P.run_summary(event_sequences(spark, sf), _insights(spark, sf))[1]


@query(f"""WITH {SEQ}, s AS (SELECT grp, state, c::DOUBLE / sum(c) OVER (PARTITION BY grp) AS share FROM (SELECT entity % 7 AS grp, state, count(*) AS c FROM seq GROUP BY ALL))
  SELECT grp, arg_min(state, (-share, state)) AS state, round(max(share), 6) AS pi, max(share) > 0.5 AS dominant FROM s GROUP BY grp""")
def dominant_states(spark, sf):
    c = event_sequences(spark, sf).groupBy(F.pmod("entity", F.lit(7)).alias("grp"), "state").agg(F.count(F.lit(1)).alias("c"))
    return rounded(P.dominant_states(c.withColumn("pi", F.col("c") / F.sum("c").over(M.Window.partitionBy("grp"))), "grp"))


CASES = ["Smith v. Jones at Cook County Court", "The FBI rang 555-123-4567", "Folsom State Prison and Folsom Prison", "Case No. 12 and Docket No. 7", "12 Main Street, Mercy Hospital", "SSN 123-45-6789", "nothing here"]


@query("""SELECT * FROM (VALUES (0, '[CASE] at [COURT]'), (1, 'The [AGENCY] rang [PHONE]'), (2, '[PRISON] and [PRISON]'), (3, '[CASE_NUMBER] and [CASE_NUMBER]'), (4, '[ADDRESS], [MEDICAL_FACILITY]'), (5, 'SSN [SSN]'), (6, 'nothing here')) t(id, text)""")
def redaction(spark, sf):
    return spark.createDataFrame(list(enumerate(CASES)), "id int, text string").select("id", T.redact(F.col("text")).alias("text"))


@query("SELECT * FROM (VALUES ('[CASE]', 1), ('[COURT]', 1), ('[AGENCY]', 1), ('[PHONE]', 1), ('[PRISON]', 2), ('[CASE_NUMBER]', 2), ('[ADDRESS]', 1), ('[MEDICAL_FACILITY]', 1), ('[SSN]', 1)) t(placeholder, n)")
def redaction_report(spark, sf):
    return P.placeholder_counts(redaction(spark, sf), "text")


SCORES = [(2, 0.20, 90.0, 2.5, 500.0), (3, 0.35, 120.0, 1.9, 300.0), (4, 0.35, 140.0, 1.7, 190.0), (5, 0.30, 130.0, 1.8, 170.0), (6, 0.05, 100.0, 2.2, 160.0)]
SCORES_SQL = "scores(k, silhouette, calinski_harabasz, davies_bouldin, inertia) AS (VALUES " + ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for k, a, b, c, d in SCORES) + ")"


def _scores(spark):
    return spark.createDataFrame(SCORES, "k long, silhouette double, calinski_harabasz double, davies_bouldin double, inertia double")


@query(f"""WITH {SCORES_SQL}, v AS (SELECT unnest([arg_max(k, (silhouette, -k)), arg_max(k, (calinski_harabasz, -k)), arg_min(k, (davies_bouldin, k))]) AS k FROM scores) SELECT k, count(*) AS n_votes FROM v GROUP BY k ORDER BY n_votes DESC, k LIMIT 1""")
def k_votes(spark, sf):
    return O.votes(_scores(spark))


@query(f"""WITH {SCORES_SQL}, c AS (SELECT k, abs((inertia - 160) / 340 - (1 - (k - 2) / 4.0::DOUBLE)) AS d FROM scores),
  v AS (SELECT unnest([arg_max(k, (silhouette, -k)), arg_max(k, (calinski_harabasz, -k)), arg_min(k, (davies_bouldin, k)), (SELECT arg_max(k, (d, -k)) FROM c)]) AS k FROM scores) SELECT k, count(*) AS n_votes FROM v GROUP BY k ORDER BY n_votes DESC, k LIMIT 1""")
def k_votes_with_elbow(spark, sf):
    return O.votes(_scores(spark), elbow=True)


@query(f"""WITH {SCORES_SQL} SELECT k, round(0.4::DOUBLE * silhouette / max(silhouette) OVER () + 0.3::DOUBLE * calinski_harabasz / max(calinski_harabasz) OVER ()
  + 0.3::DOUBLE * (max(davies_bouldin) OVER () - davies_bouldin) / (max(davies_bouldin) OVER () - min(davies_bouldin) OVER ()), 6) AS score FROM scores""")
def k_weighted(spark, sf):
    return rounded(O.weighted(_scores(spark)))


EFFECTS = f"""WITH {INSIGHTS}, {SCORES_SQL}, e AS (SELECT n % 5 + 2 AS k, l1 AS effect FROM ins),
  c AS (SELECT k, count(*) FILTER (WHERE effect > 0.1)::DOUBLE / count(*) AS rate, coalesce(avg(effect) FILTER (WHERE effect > 0.1), 0.0::DOUBLE) AS mean_effect FROM e GROUP BY k),
  j AS (SELECT *, 0.3::DOUBLE * silhouette + 0.7::DOUBLE * rate * mean_effect AS score FROM c JOIN scores USING (k) WHERE silhouette >= 0.1) """


def _effects(spark, sf):
    return _insights(spark, sf).select((F.pmod("n", F.lit(5)) + 2).alias("k"), F.col("l1").alias("effect"))


@query(EFFECTS + "SELECT k, round(rate, 6) AS rate, round(mean_effect, 6) AS mean_effect, round(score, 6) AS score FROM j")
def k_conditional_effect(spark, sf):
    return rounded(O.conditional_effect(_effects(spark, sf), _scores(spark)))


@query(EFFECTS + "SELECT k, round(0.3::DOUBLE * silhouette + 0.7::DOUBLE * score, 6) AS score FROM j")
def k_multi_objective(spark, sf):
    return rounded(O.multi_objective(_effects(spark, sf), _scores(spark)))


@query()
def k_score_table(spark, sf):
    return O.score_table(vectors(spark, sf), range(2, 5))


SHARES = f"""WITH {SEQ}, sh AS (SELECT e.entity, s.state, coalesce(c, 0)::DOUBLE / sum(coalesce(c, 0)) OVER (PARTITION BY e.entity) AS share FROM (SELECT DISTINCT entity FROM seq) e CROSS JOIN (SELECT DISTINCT state FROM seq) s
  LEFT JOIN (SELECT entity, state, count(*) AS c FROM seq GROUP BY ALL) c ON c.entity = e.entity AND c.state = s.state) """


@query(SHARES + "SELECT entity, state, round(share, 6) AS share FROM sh")
def state_shares(spark, sf):
    return rounded(E.state_shares(event_sequences(spark, sf)))


@query(SHARES + ", l AS (SELECT entity, array_to_string(list(printf('%.9f', share) ORDER BY state), ' ') AS v FROM sh GROUP BY 1) SELECT entity, v || ' ' || printf('%.9f', coalesce(c_nationkey, 0)::DOUBLE) AS v FROM l LEFT JOIN customer ON c_custkey = entity")
def multimodal_vectors(spark, sf):
    attr = read(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), "c_nationkey")
    v = E.shares_with_attributes(event_sequences(spark, sf), attr, "c_nationkey")
    return v.select("entity", F.array_join(F.transform("v", lambda x: F.format_string("%.9f", x)), " ").alias("v"))


@query("SELECT vec_id % 10 AS entity, i - 1 AS i, round(avg(x), 5) AS x FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL")
def mean_vectors(spark, sf):
    v = vectors(spark, sf).withColumn("entity", F.pmod("id", F.lit(10)))
    return rounded(E.mean_vectors(v, "entity"), 5)


@query()
def mean_matrices_by_label(spark, sf):
    seq = event_sequences(spark, sf)
    m = M.transition_matrix(seq.withColumn("who", F.col("entity")), "who").withColumnRenamed("who", "entity")
    return rounded(E.mean_matrices(m, seq.select("entity", F.pmod("entity", F.lit(3)).alias("label")).distinct()))


@query()
def state_regression(spark, sf):
    """Whether an entity ever has the least common state, from its customer row."""
    seq = event_sequences(spark, sf)
    rare = seq.groupBy("state").count().orderBy("count", "state").first()["state"]
    attr = read(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), "c_acctbal", "c_nationkey")
    return E.regression(E.state_target(seq, rare).join(attr, "entity"), ["c_acctbal", "c_nationkey"])
