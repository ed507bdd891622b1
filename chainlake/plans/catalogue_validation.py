"""Queries of tests by permutation and resampling, standard texts, vectors along sequences, and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlake.functions import standardise as N
from chainlake.functions import text as C
from chainlake.operators import ensembles as E
from chainlake.operators import markov as M
from chainlake.operators import sequences as S
from chainlake.operators import stats, trajectory
from chainlake.operators import validation as V
from chainlake.operators import vectors as K
from chainlake.plans.registry import PAIRS, SEQ, event_sequences, query, read, rounded, vectors

#: The order of a replicate's shuffle, as in ``validation.shuffled``.
KEY = "md5(rep || ':' || {k})"


def _sides(spark, sf):
    """The matrices of entities of even and of odd number, as cells."""
    seq = event_sequences(spark, sf).withColumn("side", F.pmod("entity", F.lit(2)).cast("long"))
    m = M.transition_matrix(seq.select("side", "entity", "pos", "state"), "side")
    order = F.row_number().over(V.Window.partitionBy("side").orderBy("from_state", "to_state")) - 1
    size = F.count(F.lit(1)).over(V.Window.partitionBy("side"))
    return m.withColumn("i", order).select((F.col("side") * size + F.col("i")).cast("long").alias("k"), F.col("prob").alias("value"))


CELLS = f"""WITH {SEQ}, st AS (SELECT DISTINCT state FROM seq), {PAIRS}, cnt AS (SELECT entity % 2 AS side, from_state, to_state, count(*) AS c FROM pairs GROUP BY ALL),
  g AS (SELECT s.side, a.state AS f, b.state AS t, coalesce(c, 0) AS c FROM range(0, 2) s(side), st a, st b LEFT JOIN cnt ON cnt.side = s.side AND from_state = a.state AND to_state = b.state),
  cells AS (SELECT row_number() OVER (ORDER BY side, f, t) - 1 AS k, CASE WHEN sum(c) OVER w > 0 THEN c::DOUBLE / sum(c) OVER w ELSE 1.0::DOUBLE / (SELECT count(*) FROM st) END AS value FROM g WINDOW w AS (PARTITION BY side, f))"""


def _permuted(cells: str, distance: str, reps: int) -> str:
    return f"""{cells}, n AS (SELECT count(*) // 2 AS m FROM cells), many AS (SELECT rep, value, row_number() OVER (PARTITION BY rep ORDER BY CASE WHEN rep < 0 THEN '' ELSE {KEY.format(k="k")} END, k) - 1 AS place FROM cells, range(-1, {reps}) r(rep)),
  d AS (SELECT rep, place % m AS i, max(value) FILTER (WHERE place < m) - max(value) FILTER (WHERE place >= m) AS d FROM many, n GROUP BY ALL),
  x AS (SELECT rep, round({distance}, 12) AS x FROM d GROUP BY rep), o AS (SELECT x AS observed FROM x WHERE rep < 0)
  SELECT round(observed, 6) AS observed, round(avg(x), 6) AS permuted_mean, round(stddev_pop(x), 6) AS permuted_std, round(avg((x >= observed)::INT), 6) AS p_value, round((observed - avg(x)) / stddev_pop(x), 4) AS effect_size FROM x, o WHERE rep >= 0 GROUP BY observed"""


def _rounded_test(df):
    return rounded(df.withColumn("effect_size", F.round("effect_size", 4)))


@query(_permuted(CELLS, "sqrt(sum(d * d))", 200))
def matrix_difference_permutation(spark, sf):
    return _rounded_test(V.pooled_permutation(_sides(spark, sf), 200))


SHARES = f"""WITH {SEQ}, c AS (SELECT entity % 2 AS side, state, count(*) AS c FROM seq GROUP BY ALL),
  cells AS (SELECT row_number() OVER (ORDER BY side, state) - 1 AS k, c::DOUBLE / sum(c) OVER (PARTITION BY side) AS value FROM c)"""


def _shares(spark, sf):
    c = event_sequences(spark, sf).groupBy(F.pmod("entity", F.lit(2)).alias("side"), "state").agg(F.count(F.lit(1)).alias("c"))
    share = F.col("c") / F.sum("c").over(V.Window.partitionBy("side"))
    # A row per side and state: the states of two sides.
    return c.select((F.row_number().over(V.Window.orderBy("side", "state")) - 1).cast("long").alias("k"), share.alias("value"))


@query(f"SELECT observed, greatest(p_value, 1.0::DOUBLE / 500) AS p_value FROM ({_permuted(SHARES, 'sum(abs(d))', 500)})")
def stationary_permutation(spark, sf):
    found = rounded(V.pooled_permutation(_shares(spark, sf), 500, "l1"))
    return found.select("observed", V.floored(F.col("p_value"), 500).alias("p_value"))


@query(SHARES + """, one AS (SELECT * FROM cells WHERE k < (SELECT count(*) // 2 FROM cells)), n AS (SELECT count(*) AS n FROM one),
  drawn AS (SELECT rep, slot, ((((rep * 1000003 + slot) * 1103515245 + 12345) % 2147483648) // 65536) % n AS k FROM n, range(0, 300) a(rep), range(0, (SELECT n FROM n)) b(slot)),
  p AS (SELECT rep, slot, value / sum(value) OVER (PARTITION BY rep) AS p FROM drawn JOIN one USING (k))
  SELECT slot AS k, round(quantile_cont(p, 0.025), 6) AS low, round(quantile_cont(p, 0.975), 6) AS high FROM p GROUP BY slot""")
def stationary_bootstrap_ci(spark, sf):
    cells = _shares(spark, sf)
    return rounded(V.resampled_vector(cells.where(F.col("k") < cells.count() // 2), 300))


@query(f"""WITH {SEQ}, v AS (SELECT row_number() OVER (ORDER BY entity) - 1 AS k, count(*)::DOUBLE AS x FROM seq GROUP BY entity), n AS (SELECT count(*) AS n FROM v),
  d AS (SELECT rep, ((((rep * 1000003 + slot) * 1103515245 + 12345) % 2147483648) // 65536) % n AS k FROM n, range(0, 200) a(rep), range(0, (SELECT n FROM n)) b(slot)),
  m AS (SELECT rep, avg(x) AS m FROM d JOIN v USING (k) GROUP BY rep)
  SELECT round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def bootstrap_mean_length(spark, sf):
    seq = event_sequences(spark, sf)
    values = seq.groupBy("entity").agg(F.count(F.lit(1)).cast("double").alias("x")).join(stats.indexed(seq), "entity").select("k", "x")
    return rounded(V.bootstrap_metric(values, 200, V.weighted_mean))


@query(f"""WITH {SEQ}, many AS (SELECT rep, entity, list(state ORDER BY CASE WHEN rep < 0 THEN '' ELSE {KEY.format(k="entity || ':' || pos")} END, pos) AS s FROM seq, range(-1, 20) r(rep) GROUP BY ALL),
  c AS (SELECT rep, count(*) FILTER (WHERE len(list_filter(range(1, len(s) + 1), lambda i: s[i] = 'error' AND list_contains(s[1:i - 1], 'signup'))) > 0) AS c, count(*) AS n FROM many GROUP BY rep), o AS (SELECT c AS observed, n FROM c WHERE rep < 0),
  k AS (SELECT count(DISTINCT state) AS k FROM seq)
  SELECT observed, o.n, round(observed::DOUBLE / o.n, 6) AS frequency, round(power(1.0::DOUBLE / k, 2), 6) AS expected, round(observed::DOUBLE / o.n * k * k, 6) AS fold,
    (SELECT round(sum(exp(lgamma(o.n + 1) - lgamma(j + 1) - lgamma(o.n - j + 1) + j * ln(power(1.0::DOUBLE / k, 2)) + (o.n - j) * ln(1 - power(1.0::DOUBLE / k, 2)))), 6) FROM range(0, 100000) t(j) WHERE j >= observed AND j <= o.n) AS binomial_p,
    round(avg((c.c >= observed)::INT), 6) AS permutation_p FROM c, o, k WHERE rep >= 0 GROUP BY observed, o.n, k""")
def pattern_significance(spark, sf):
    return rounded(V.pattern_significance(event_sequences(spark, sf), ["signup", "error"], 20))


@query(f"""WITH {SEQ}, c AS (SELECT state, entity % 2 AS side, count(*) AS c FROM seq GROUP BY ALL), s AS (SELECT state, side, c::DOUBLE / sum(c) OVER (PARTITION BY side) AS p FROM c),
  w AS (SELECT state, count(*)::DOUBLE / (SELECT count(*) FROM seq) AS q FROM seq GROUP BY 1), l AS (SELECT side, sum(abs(p - q)) AS l1 FROM s JOIN w USING (state) GROUP BY 1)
  SELECT side, round(l1, 6) AS l1, CASE WHEN l1 < 0.1 THEN 'negligible' WHEN l1 < 0.3 THEN 'small' WHEN l1 < 0.5 THEN 'medium' ELSE 'large' END AS category FROM l""")
def half_effect_categories(spark, sf):
    seq = event_sequences(spark, sf).withColumn("side", F.pmod("entity", F.lit(2)).cast("long"))
    c = seq.groupBy("side", "state").agg(F.count(F.lit(1)).alias("c"))
    p = c.withColumn("p", F.col("c") / F.sum("c").over(V.Window.partitionBy("side")))
    total = c.groupBy("state").agg(F.sum("c").alias("t"))
    q = total.withColumn("q", F.col("t") / F.sum("t").over(V.Window.partitionBy()))
    return rounded(p.join(q, "state").groupBy("side").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("l1")).withColumn("category", V.effect_category(F.col("l1"))))


@query(f"WITH {SEQ} SELECT entity, count(*) AS n, count(DISTINCT state) AS n_states, round(count(DISTINCT state)::DOUBLE / count(*), 6) AS diversity FROM seq GROUP BY 1")
def entity_diversity(spark, sf):
    return rounded(S.diversity(event_sequences(spark, sf)))


@query(f"""WITH {SEQ}, g AS (SELECT entity, state AS a, lead(state) OVER w AS b, lead(state, 2) OVER w AS c FROM seq WINDOW w AS (PARTITION BY entity ORDER BY pos))
  SELECT count(*) AS cnt, count(DISTINCT entity) AS n_sequences FROM g WHERE a = 'click' AND b = 'purchase' AND c = 'click'""")
def pattern_frequency(spark, sf):
    return S.pattern_frequency(event_sequences(spark, sf), ["click", "purchase", "click"])


@query(f"""WITH {SEQ}, q AS (SELECT quantile_cont(age, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM seq), bounds AS (SELECT i AS window_id, q[i + 1] AS lo, q[i + 2] AS hi FROM q, range(0, 4) t(i)),
  one AS (SELECT min(window_id) AS window_id FROM bounds WHERE 10.0 BETWEEN lo AND hi), inside AS (SELECT b.window_id, entity, pos, state FROM seq JOIN bounds b ON age BETWEEN lo AND hi),
  st AS (SELECT DISTINCT state FROM inside), ps AS (SELECT * FROM (SELECT window_id, state AS f, lead(state) OVER (PARTITION BY window_id, entity ORDER BY pos) AS t FROM inside) WHERE t IS NOT NULL),
  g AS (SELECT one.window_id, a.state AS from_state, b.state AS to_state, (SELECT count(*) FROM ps WHERE ps.window_id = one.window_id AND f = a.state AND t = b.state) AS cnt FROM one, st a, st b)
  SELECT window_id, from_state, to_state, cnt, round(CASE WHEN sum(cnt) OVER w > 0 THEN cnt::DOUBLE / sum(cnt) OVER w ELSE 0.0::DOUBLE END, 6) AS prob FROM g WINDOW w AS (PARTITION BY from_state)""")
def matrix_for_time(spark, sf):
    return rounded(M.matrix_at(event_sequences(spark, sf), 10.0))


RELABEL = "(event_id % 4)::BIGINT"


@query(f"""WITH r AS (SELECT user_id AS entity, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, ({RELABEL})::VARCHAR AS state FROM events WHERE event_id % 11 <> 0)
  , f AS (SELECT entity, state, lead(state) OVER (PARTITION BY entity ORDER BY pos) AS nxt FROM r) SELECT state AS from_state, nxt AS to_state, count(*) AS cnt FROM f WHERE nxt IS NOT NULL GROUP BY ALL""")
def relabelled_transitions(spark, sf):
    events = read(spark, sf, "events")
    seq = S.numbered(events.withColumnRenamed("user_id", "entity"), "entity", "ts", "event_id").select("entity", "pos", F.col("event_type").alias("state"), "event_id")
    labels = events.where("event_id % 11 <> 0").select("event_id", F.pmod("event_id", F.lit(4)).cast("long").alias("label"))
    return S.adjacent(S.relabelled(seq, labels, "event_id")).groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("cnt"))


@query(f"""WITH {SEQ}, e AS (SELECT DISTINCT entity, (substr(md5('0:' || entity), 1, 4) >= '8000')::INT AS part FROM seq)
  SELECT part, count(DISTINCT entity) AS n_entities, count(*) AS n_events, count(DISTINCT state) AS n_states FROM seq JOIN e USING (entity) GROUP BY 1""")
def split_sample(spark, sf):
    seq = event_sequences(spark, sf)
    parts = S.split_entities(seq)
    one = lambda p: S.of_part(seq, parts, p).agg(F.lit(p).alias("part"), F.countDistinct("entity").alias("n_entities"), F.count(F.lit(1)).alias("n_events"), F.countDistinct("state").alias("n_states"))
    return one(0).unionByName(one(1))


#: The counts of the longest sequences first, by SQL: a matched entity is one with orders too.
@query("""SELECT user_id AS entity, count(*) AS n, list(event_type ORDER BY ts, event_id)[1] AS first_state, list(event_type ORDER BY ts, event_id)[-1] AS last_state
  FROM events WHERE user_id IN (SELECT o_custkey FROM orders) GROUP BY 1""")
def matched_sequences(spark, sf):
    seq = event_sequences(spark, sf)
    both = seq.join(read(spark, sf, "orders").select(F.col("o_custkey").alias("entity")), "entity", "left_semi")
    return both.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.min_by("state", "pos").alias("first_state"), F.max_by("state", "pos").alias("last_state"))


@query(f"""WITH {SEQ}, t AS (SELECT label AS entity, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos, embedding AS v FROM embeddings),
  d AS (SELECT a.entity, sqrt(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: power(a.v[i]::DOUBLE - b.v[i]::DOUBLE, 2)))) AS d FROM t a JOIN t b ON a.entity = b.entity AND b.pos = a.pos + 1)
  SELECT entity, round(avg(d), 4) AS mean, round(stddev_pop(d), 4) AS std, round(sum(d), 3) AS total FROM d GROUP BY 1""")
def embedding_paths(spark, sf):
    x = vectors(spark, sf).withColumn("v", F.col("v").cast("array<double>"))
    found = K.path_distances(S.numbered(x.withColumnRenamed("label", "entity"), "entity", "id").select("entity", "pos", "v"))
    return found.select("entity", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.round("total", 3).alias("total"))


@query("""WITH w AS (SELECT vec_id // 4 AS id, i AS place, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) t(i)) SELECT id, round(sum(m), 4) AS total, round(max(m), 5) AS most FROM (SELECT id, place, avg(x) AS m FROM w GROUP BY ALL) GROUP BY id""")
def imputed_embeddings(spark, sf):
    """Four neighbouring rows count as an event and its variants."""
    x = vectors(spark, sf).select(F.floor(F.col("id") / 4).alias("id"), F.col("v").cast("array<double>").alias("v"))
    m = K.mean_of_variants(x)
    return m.select("id", F.round(F.aggregate("v", F.lit(0.0), lambda a, b: a + b), 4).alias("total"), F.round(F.array_max("v"), 5).alias("most"))


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("SELECT row, col, round(c, 6) AS corr FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS row, '{b}' AS col, corr({a}, {b}) AS c FROM lineitem" for a in NUMBERS for b in NUMBERS) + ")")
def correlation_heatmap(spark, sf):
    x = read(spark, sf, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in NUMBERS])
    return rounded(K.correlation(x, list(NUMBERS)))


@query("""WITH c AS (SELECT ep, label, row_number() OVER (PARTITION BY ep ORDER BY md5(ep || ':' || label), label) AS r FROM (SELECT DISTINCT label FROM embeddings), range(0, 10) e(ep)),
  x AS (SELECT ep, vec_id AS id, e.label, embedding AS v, row_number() OVER (PARTITION BY ep, e.label ORDER BY md5(ep || ':' || vec_id), vec_id) AS r FROM embeddings e JOIN c ON c.label = e.label AND c.r <= 3),
  p AS (SELECT ep, label, list(m ORDER BY i) AS p FROM (SELECT ep, label, i, avg(v[i]::DOUBLE) AS m FROM x, range(1, 65) t(i) WHERE r <= 5 GROUP BY ALL) GROUP BY ALL),
  d AS (SELECT x.ep, id, x.label, p.label AS named, round(list_sum(list_transform(range(1, 65), lambda i: power(v[i]::DOUBLE - p[i], 2))), 9) AS d FROM x JOIN p ON p.ep = x.ep WHERE r > 5 AND r <= 15),
  b AS (SELECT ep, id, label, first(named ORDER BY d, named) AS named FROM d GROUP BY ALL) SELECT ep AS episode, count(*) AS n_queries, count(*) FILTER (WHERE named = label) AS n_right FROM b GROUP BY 1""")
def episodic_accuracy(spark, sf):
    return K.episodes(vectors(spark, sf).withColumn("v", F.col("v").cast("array<double>")), 10)


@query("""WITH t AS (SELECT doc_id AS id, unnest(regexp_extract_all(regexp_replace(lower(text), '[^a-z0-9_]', ' ', 'g'), '[a-z0-9_]{2,}')) AS term FROM documents WHERE lang = 'en' AND text IS NOT NULL),
  c AS (SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM t GROUP BY 1) SELECT term, df, cf, round(ln((1 + (SELECT count(*) FROM documents WHERE lang = 'en' AND text IS NOT NULL)) / (1 + df)::DOUBLE) + 1, 6) AS idf FROM c ORDER BY cf DESC, term LIMIT 500""")
def tfidf_vocabulary(spark, sf):
    docs = read(spark, sf, "documents").where("lang = 'en' AND text IS NOT NULL")
    plain = F.regexp_replace(F.lower("text"), "[^a-z0-9_]", " ")
    return rounded(C.term_weights(docs.select(F.col("doc_id").alias("id"), plain.alias("text"))))


@query("""WITH d AS (SELECT doc_id AS id, regexp_extract_all(regexp_replace(lower(text), '[^a-z0-9_]', ' ', 'g'), '[a-z0-9_]{2,}') AS w FROM documents WHERE lang = 'en' AND text IS NOT NULL), n AS (SELECT count(*) AS n FROM d),
  t AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM d) GROUP BY ALL),
  v AS (SELECT term, ln((1 + (SELECT n FROM n)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM t GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 500), x AS (SELECT id, term, tf * idf AS w FROM t JOIN v USING (term)),
  y AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM x)
  SELECT id, first(term ORDER BY round(weight, 9) DESC, term) AS top_term, round(max(weight), 6) AS top_weight, count(*) AS n_terms FROM y GROUP BY id""")
def tfidf_top_terms(spark, sf):
    docs = read(spark, sf, "documents").where("lang = 'en' AND text IS NOT NULL")
    plain = F.regexp_replace(F.lower("text"), "[^a-z0-9_]", " ")
    w = C.tf_idf(docs.select(F.col("doc_id").alias("id"), plain.alias("text"))).withColumn("r", F.struct((-F.round("weight", 9)).alias("w"), "term"))
    return rounded(w.groupBy("id").agg(F.min("r")["term"].alias("top_term"), F.max("weight").alias("top_weight"), F.count(F.lit(1)).alias("n_terms")))


_SQL_LISTS = "".join(f", '{a}', '{b}', 'g')" for a, b in [(p.replace("(?i)", "(?i)"), x) for p, x in N.lists()])


@query("WITH t AS (SELECT c_custkey AS id, 'John Smith of ' || n_name || ' met Mary in NY  and ' || c_name AS text FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT id, trim(regexp_replace(regexp_replace(" + "regexp_replace(" * 3 + "text" + _SQL_LISTS + r", '\[PERSON\]\s+\[PERSON\]', '[PERSON]', 'g'), '\s+', ' ', 'g')) AS text FROM t")
def standardised_names(spark, sf):
    c, n = read(spark, sf, "customer"), read(spark, sf, "nation")
    text = F.concat(F.lit("John Smith of "), "n_name", F.lit(" met Mary in NY  and "), "c_name")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("id"), N.standardise_names(text).alias("text"))


@query()
def synonym_variants(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("John stole from a house in Texas and was arrested by "), "c_name").alias("text"))
    return N.variants(c)


@query()
def clustering_subsample_stability(spark, sf):
    return V.subsample_stability(vectors(spark, sf), 4, 3)


@query()
def clustering_noise_robustness(spark, sf):
    return V.noise_robustness(vectors(spark, sf).withColumn("v", F.col("v").cast("array<double>")), 4, 2)


@query()
def clustering_bootstrap_stability(spark, sf):
    return V.bootstrap_stability(vectors(spark, sf), 4, 3)


@query()
def trajectory_risk(spark, sf):
    """Types by mixture, and each entity's risk beside its type."""
    seq = event_sequences(spark, sf)
    kinds = trajectory.types(trajectory.features(seq), restarts=2)
    return trajectory.risk(seq).join(kinds, "entity")


@query()
def ensemble_consensus(spark, sf):
    return E.consensus(E.ensemble_runs(vectors(spark, sf), 4, ("kmeans", "bisecting"), 2), 4)


@query()
def robust_clusters(spark, sf):
    return E.robust_clusters(vectors(spark, sf), range(3, 6), ("kmeans", "bisecting"))


@query()
def gaussian_clusters(spark, sf):
    return E.clustered(vectors(spark, sf), 4, "gaussian", components=8)


@query()
def multi_view_clusters(spark, sf):
    x = vectors(spark, sf)
    halves = [x.select("id", F.slice("v", a, 32).alias("v")) for a in (1, 33)]
    return E.clustered(E.views_joined(*halves), 4)


@query()
def entity_matrix_clusters(spark, sf):
    return E.entity_clusters(event_sequences(spark, sf))
