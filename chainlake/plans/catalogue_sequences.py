"""Queries over sequences: transitions, higher orders, windows, patterns, change points, trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlake.operators import markov as M
from chainlake.operators import patterns as X
from chainlake.operators import sequences as S
from chainlake.operators import trajectory as R
from chainlake.plans.registry import PAIRS, SEQ, event_sequences, matrix_sql, query, rounded

MATRIX = f"WITH {SEQ}, {matrix_sql()} "
ROUNDED = "SELECT from_state, to_state, cnt, round(prob, 6) AS prob FROM matrix"


@query(MATRIX + ROUNDED)
def transition_matrix_global(spark, sf):
    return rounded(M.transition_matrix(event_sequences(spark, sf)))


@query(f"WITH {SEQ}, {matrix_sql('0.0::DOUBLE')} " + ROUNDED)
def transition_matrix_zero_rows(spark, sf):
    return rounded(M.transition_matrix(event_sequences(spark, sf), zero_rows=True))


@query(MATRIX + ROUNDED)
def transition_matrix_sliced(spark, sf):
    """The same counts through slices of 16 positions, for entities too long for one task."""
    seq = event_sequences(spark, sf)
    counts = S.adjacent_sliced(seq, 16).groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("cnt"))
    total = F.sum("cnt").over(M.Window.partitionBy("from_state"))
    return rounded(M.grid(seq.select("state").distinct()).join(counts, ["from_state", "to_state"]).withColumn("prob", F.col("cnt") / total))


@query(MATRIX + "SELECT round(sum(CASE WHEN prob > 0 THEN -prob * log2(prob) ELSE 0.0 END), 6) AS entropy FROM matrix")
def transition_entropy_total(spark, sf):
    return rounded(M.entropy_total(M.transition_matrix(event_sequences(spark, sf))))


@query(MATRIX + "SELECT round(avg(h), 6) AS entropy FROM (SELECT from_state, sum(-(prob + 1e-10) * log2(prob + 1e-10)) AS h FROM matrix GROUP BY 1)")
def transition_entropy_rowmean(spark, sf):
    return rounded(M.entropy_row_mean(M.transition_matrix(event_sequences(spark, sf))))


@query(
    f"WITH RECURSIVE {SEQ}, {matrix_sql()}, walk AS (SELECT 0 AS step, state, 1.0::DOUBLE / (SELECT count(*) FROM states) AS pi FROM states "
    "UNION ALL SELECT step + 1, m.to_state, sum(pi * prob) FROM walk JOIN matrix m ON m.from_state = walk.state WHERE step < 100 GROUP BY ALL) "
    "SELECT state, round(pi, 6) AS pi FROM walk WHERE step = 100"
)
def stationary_distribution(spark, sf):
    return rounded(M.stationary(M.transition_matrix(event_sequences(spark, sf))))


GRAMS = f"""WITH {SEQ}, grams AS (SELECT * FROM (SELECT entity, pos, state AS s1, lead(state) OVER w AS s2, lead(state, 2) OVER w AS s3 FROM seq
  WINDOW w AS (PARTITION BY entity ORDER BY pos)) WHERE s3 IS NOT NULL), chain AS (SELECT s1 || '>' || s2 AS ctx, s3 AS next, count(*) AS cnt FROM grams GROUP BY ALL),
  probs AS (SELECT *, cnt::DOUBLE / sum(cnt) OVER (PARTITION BY ctx) AS prob FROM chain) """


def _chain(spark, sf):
    return M.higher_order(event_sequences(spark, sf), 2)


@query(GRAMS + "SELECT ctx, next, cnt, round(prob, 6) AS prob FROM probs")
def higher_order_probs(spark, sf):
    return rounded(_chain(spark, sf).withColumn("ctx", F.array_join("ctx", ">")))


@query(GRAMS + "SELECT ctx || '>' || next AS gram, cnt FROM chain")
def ngram_counts_order2(spark, sf):
    grams = S.ngrams(event_sequences(spark, sf), 3).groupBy("gram").agg(F.count(F.lit(1)).alias("cnt"))
    return grams.withColumn("gram", F.array_join("gram", ">"))


@query(GRAMS + "SELECT * FROM (SELECT ctx, next, cnt, round(prob, 6) AS prob, row_number() OVER (PARTITION BY ctx ORDER BY prob DESC, next) AS rank FROM probs) WHERE rank <= 3")
def predict_next_topk(spark, sf):
    return rounded(M.predict_next(_chain(spark, sf)).withColumn("ctx", F.array_join("ctx", ">")))


@query(GRAMS + "SELECT ctx || '>' || next AS pattern, cnt FROM chain WHERE cnt >= 5 ORDER BY cnt DESC, pattern LIMIT 10")
def common_patterns_topn(spark, sf):
    return M.common_patterns(_chain(spark, sf)).withColumn("pattern", F.array_join("pattern", ">"))


@query(GRAMS + """SELECT s1 || '>' || s2 || '>' || s3 AS gram, count(*) AS occurrences, count(DISTINCT entity) AS n_sequences,
  round(count(DISTINCT entity)::DOUBLE / (SELECT count(DISTINCT entity) FROM seq), 6) AS support FROM grams GROUP BY 1
  HAVING count(*) >= floor(0.05::DOUBLE * (SELECT count(DISTINCT entity) FROM seq))""")
def critical_patterns(spark, sf):
    return rounded(M.critical_patterns(event_sequences(spark, sf))).withColumn("gram", F.array_join("gram", ">"))


@query(f"""WITH {SEQ} SELECT entity, string_agg(state, '>' ORDER BY pos) AS states, count(*) AS n, count(DISTINCT state) AS n_states,
  round(count(DISTINCT state)::DOUBLE / count(*), 6) AS diversity FROM seq GROUP BY entity""")
def sequence_assembly(spark, sf):
    s = S.assembled(event_sequences(spark, sf))
    distinct = F.size(F.array_distinct("states"))
    return rounded(s.select("entity", F.array_join("states", ">").alias("states"), "n", distinct.cast("long").alias("n_states"), (distinct / F.col("n")).alias("diversity")))


BOUNDS = """q AS (SELECT quantile_cont(age, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM seq),
  bounds AS (SELECT i AS window_id, q[i + 1] AS start, q[i + 2] AS "end" FROM q, range(0, 4) t(i))"""
WINDOWS = f"""WITH {SEQ}, {BOUNDS}, inside AS (SELECT window_id, entity, pos, state FROM seq JOIN bounds ON age BETWEEN start AND "end"),
  ps AS (SELECT * FROM (SELECT window_id, state AS from_state, lead(state) OVER (PARTITION BY window_id, entity ORDER BY pos) AS to_state FROM inside) WHERE to_state IS NOT NULL),
  st AS (SELECT DISTINCT state FROM inside), cells AS (SELECT w.window_id, a.state AS from_state, b.state AS to_state FROM (SELECT DISTINCT window_id FROM inside) w, st a, st b),
  g AS (SELECT window_id, from_state, to_state, coalesce(c, 0)::BIGINT AS cnt FROM cells LEFT JOIN (SELECT window_id, from_state, to_state, count(*) AS c FROM ps GROUP BY ALL) USING (window_id, from_state, to_state)),
  m AS (SELECT *, CASE WHEN sum(cnt) OVER w > 0 THEN cnt::DOUBLE / sum(cnt) OVER w ELSE 0.0::DOUBLE END AS prob FROM g WINDOW w AS (PARTITION BY window_id, from_state)) """


@query(f'WITH {SEQ}, {BOUNDS} SELECT window_id, round(start, 6) AS start, round("end", 6) AS "end" FROM bounds')
def time_window_bounds(spark, sf):
    return rounded(M.window_bounds(event_sequences(spark, sf)))


@query(WINDOWS + "SELECT window_id, from_state, to_state, cnt, round(prob, 6) AS prob FROM m")
def time_window_matrices(spark, sf):
    return rounded(M.window_matrices(event_sequences(spark, sf)))


@query(WINDOWS + """, d AS (SELECT a.window_id, abs(a.prob - b.prob) AS d FROM m a JOIN m b ON b.window_id = a.window_id + 1 AND a.from_state = b.from_state AND a.to_state = b.to_state)
  SELECT window_id, round(sqrt(sum(d * d)), 6) AS frobenius, round(max(d), 6) AS max_change, count(*) FILTER (WHERE d > 0.1) AS n_changed FROM d GROUP BY 1""")
def time_window_compare(spark, sf):
    return rounded(M.window_changes(M.window_matrices(event_sequences(spark, sf))))


def _levels(longest: int, support: float) -> str:
    """Patterns by level: l1 ... hold a sequence's patterns with the earliest place of their end, f1 ... the frequent ones."""
    least = f"(SELECT greatest(floor({support}::DOUBLE * count(DISTINCT entity)), 1) FROM seq)"
    out = f"""WITH {SEQ}, after AS (SELECT a.entity, a.p, b.state, min(b.pos) AS q FROM (SELECT entity, pos - 1 AS p FROM seq) a JOIN seq b ON a.entity = b.entity AND b.pos > a.p GROUP BY ALL),
  l1 AS (SELECT entity, [state] AS pattern, q FROM after WHERE p = 0)"""
    for i in range(1, longest + 1):
        out += f""", f{i} AS (SELECT pattern, count(*) AS n_sequences FROM l{i} GROUP BY 1 HAVING count(*) >= {least})"""
        if i < longest:
            out += f""", l{i + 1} AS (SELECT l.entity, list_append(l.pattern, after.state) AS pattern, after.q FROM l{i} l JOIN f{i} USING (pattern) JOIN after ON after.entity = l.entity AND after.p = l.q)"""
    return out + ", freq AS (" + " UNION ALL ".join(f"SELECT * FROM f{i}" for i in range(1, longest + 1)) + ") "


#: The defaults of the miner.
SUPPORT, LONGEST = 0.1, 5
FREQUENT = _levels(LONGEST, SUPPORT)


@query(FREQUENT + "SELECT array_to_string(pattern, '>') AS pattern, n_sequences FROM freq WHERE len(pattern) > 1")
def frequent_subsequences(spark, sf):
    return X.frequent_subsequences(event_sequences(spark, sf), SUPPORT, LONGEST).withColumn("pattern", F.array_join("pattern", ">"))


def _rules(spark, sf, strict):
    seq = event_sequences(spark, sf)
    frequent = X.frequent_subsequences(seq, SUPPORT, LONGEST, 1)
    rules = X.association_rules(frequent, seq.select("entity").distinct().count(), strict=strict)
    return rounded(rules.withColumns({c: F.array_join(c, ">") for c in ("antecedent", "consequent")}))


CUT_PATTERNS = """, n AS (SELECT count(DISTINCT entity) AS n FROM seq), cut AS (SELECT pattern[1:i] AS a, pattern[i + 1:] AS c, n_sequences FROM freq, range(1, 5) t(i) WHERE i < len(pattern)) """


@query(FREQUENT + CUT_PATTERNS + "SELECT array_to_string(a, '>') AS antecedent, array_to_string(c, '>') AS consequent, round(n_sequences::DOUBLE / n, 6) AS support, 1.0::DOUBLE AS confidence, 1.0::DOUBLE AS lift FROM cut, n")
def association_rules(spark, sf):
    return _rules(spark, sf, False)


@query(FREQUENT + CUT_PATTERNS + """SELECT array_to_string(a, '>') AS antecedent, array_to_string(c, '>') AS consequent, round(cut.n_sequences::DOUBLE / n, 6) AS support, round(cut.n_sequences::DOUBLE / fa.n_sequences, 6) AS confidence,
  round(cut.n_sequences::DOUBLE / fa.n_sequences / (fc.n_sequences::DOUBLE / n), 6) AS lift FROM cut JOIN freq fa ON fa.pattern = a JOIN freq fc ON fc.pattern = c, n WHERE cut.n_sequences::DOUBLE / fa.n_sequences >= 0.5""")
def association_rules_strict(spark, sf):
    return _rules(spark, sf, True)


CUTS = f"""WITH {SEQ}, st AS (SELECT DISTINCT state AS s FROM seq), hot AS (SELECT entity, pos, s, (state = s)::INT AS hit FROM seq, st),
  pre AS (SELECT entity, pos - 1 AS cut, s, count(*) OVER e AS n, sum(hit) OVER e AS total, coalesce(sum(hit) OVER (PARTITION BY entity, s ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
    FROM hot WINDOW e AS (PARTITION BY entity, s)) """
KL = CUTS + """, div AS (SELECT entity, cut, n, CASE WHEN bool_or(b > 0 AND total = b) THEN 1e308::DOUBLE ELSE
    sum(CASE WHEN b = 0 OR total = b THEN 0.0::DOUBLE ELSE b::DOUBLE / cut * ln((b::DOUBLE / cut) / ((total - b)::DOUBLE / (n - cut))) END) END AS divergence
    FROM pre WHERE cut >= 3 AND cut < n - 3 GROUP BY ALL),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(divergence, 9) DESC, cut) AS r FROM div) WHERE r <= 5) """


@query(KL + "SELECT entity, cut, n, round(divergence, 6) AS divergence FROM top")
def change_points_kl(spark, sf):
    return rounded(X.kl_change_points(event_sequences(spark, sf)))


@query(KL + """SELECT a.state AS state_before, b.state AS state_after, count(*) AS n, round(avg(cut::DOUBLE / n), 6) AS mean_position
  FROM top JOIN seq a ON a.entity = top.entity AND a.pos = cut JOIN seq b ON b.entity = top.entity AND b.pos = cut + 1 GROUP BY ALL""")
def change_point_events(spark, sf):
    seq = event_sequences(spark, sf)
    return rounded(X.change_point_events(seq, X.kl_change_points(seq)))


@query(CUTS + """, full_pre AS (SELECT entity, s, cut, b, n FROM pre UNION ALL SELECT DISTINCT entity, s, n, total, n FROM pre),
  mid AS (SELECT *, greatest(3, n // 10) AS w FROM pre),
  lr AS (SELECT mid.entity, mid.cut, mid.b - lo.b AS l, hi.b - mid.b AS r FROM mid JOIN full_pre lo ON lo.entity = mid.entity AND lo.s = mid.s AND lo.cut = mid.cut - w
    JOIN full_pre hi ON hi.entity = mid.entity AND hi.s = mid.s AND hi.cut = mid.cut + w WHERE mid.cut >= w AND mid.cut < mid.n - w),
  ex AS (SELECT *, (l + r) / 2.0::DOUBLE AS e, count(*) OVER (PARTITION BY entity, cut) AS k FROM lr WHERE l + r > 0),
  chi AS (SELECT entity, cut, sum(CASE WHEN k = 2 THEN power(abs(l - e) - least(0.5::DOUBLE, abs(l - e)), 2) / e + power(abs(r - e) - least(0.5::DOUBLE, abs(r - e)), 2) / e
    ELSE power(l - e, 2) / e + power(r - e, 2) / e END) AS chi2 FROM ex WHERE k > 1 GROUP BY ALL),
  lim AS (SELECT *, quantile_cont(chi2, 0.9) OVER (PARTITION BY entity) AS lim FROM chi)
  SELECT entity, cut, round(chi2, 6) AS chi2 FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY cut) AS r FROM lim WHERE round(chi2, 9) > round(lim, 9)) WHERE r <= 5""")
def change_points_chi2(spark, sf):
    return rounded(X.chi2_change_points(event_sequences(spark, sf)))


@query()
def change_points_binary(spark, sf):
    return X.binary_segmentation(event_sequences(spark, sf))


@query()
def life_phases(spark, sf):
    return X.life_phases(event_sequences(spark, sf))


SEVERITY = "CASE state WHEN 'purchase' THEN 3.0::DOUBLE WHEN 'click' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"
TRAJECTORY = f"""WITH {SEQ}, x AS (SELECT *, {SEVERITY} AS sev, age - lag(age) OVER w AS gap, lead(state) OVER w AS nxt, count(*) OVER (PARTITION BY entity) AS n FROM seq WINDOW w AS (PARTITION BY entity ORDER BY pos)),
  f AS (SELECT entity, count(*) AS n, count(DISTINCT state) AS n_states, count(DISTINCT state)::DOUBLE / count(*) AS diversity, min_by(age, pos) AS first_age, max_by(age, pos) AS last_age,
    max_by(age, pos) - min_by(age, pos) AS duration, CASE WHEN avg(gap) > 0 THEN 1.0::DOUBLE / avg(gap) ELSE 0.0::DOUBLE END AS rate, coalesce(stddev_pop(1.0 / gap) FILTER (WHERE gap > 0), 0.0::DOUBLE) AS rate_std,
    count(DISTINCT state || '>' || nxt) AS n_transitions, coalesce(regr_slope(sev * pos / n, pos::DOUBLE), 0.0::DOUBLE) AS severity_slope, max(sev * pos / n) AS max_severity,
    avg((sev >= 3)::INT) FILTER (WHERE pos > n - 3) AS recent FROM x GROUP BY entity),
  mv AS (SELECT entity, state, nxt, count(*) AS c FROM x WHERE nxt IS NOT NULL GROUP BY ALL),
  en AS (SELECT entity, -sum(p * ln(p)) AS transition_entropy FROM (SELECT entity, c::DOUBLE / sum(c) OVER (PARTITION BY entity) AS p FROM mv) GROUP BY 1) """


@query(TRAJECTORY + """SELECT entity, n, n_states, round(diversity, 6) AS diversity, round(first_age, 6) AS first_age, round(last_age, 6) AS last_age, round(duration, 6) AS duration, round(rate, 4) AS rate,
  round(rate_std, 2) AS rate_std, n_transitions, round(severity_slope, 6) AS severity_slope, round(max_severity, 6) AS max_severity,
  round(coalesce(transition_entropy, 0.0::DOUBLE), 6) AS transition_entropy FROM f LEFT JOIN en USING (entity)""")
def trajectory_features(spark, sf):
    f = R.features(event_sequences(spark, sf)).drop("recent")
    return rounded(f.withColumn("rate", F.round("rate", 4)).withColumn("rate_std", F.round("rate_std", 2)))


#: Event types as texts that the severity rules know.
TEXTS = {"purchase": "armed robbery", "click": "drug offence", "signup": "violent assault", "error": "murder"}
CRIMES = f"""WITH {SEQ}, t AS (SELECT entity, pos, age, CASE state WHEN 'purchase' THEN 'armed robbery' WHEN 'click' THEN 'drug offence' WHEN 'signup' THEN 'violent assault' WHEN 'error' THEN 'murder' ELSE state END AS state FROM seq) """


def _crimes(spark, sf):
    named = F.create_map(*[F.lit(v) for kv in TEXTS.items() for v in kv])
    return event_sequences(spark, sf).withColumn("state", F.coalesce(F.element_at(named, F.col("state")), F.col("state")))


@query(CRIMES + """, x AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n,
    CASE WHEN regexp_matches(state, 'murder|kill') THEN 10 WHEN regexp_matches(state, 'violen|assault|rape') THEN 7 WHEN regexp_matches(state, 'armed|weapon') THEN 5 WHEN regexp_matches(state, 'drug|theft') THEN 3 ELSE 1 END::DOUBLE AS sev,
    CASE WHEN contains(state, 'violen') THEN 'v' WHEN contains(state, 'drug') THEN 'd' WHEN regexp_matches(state, 'theft|robbery') THEN 'p' WHEN regexp_matches(state, 'sex|rape') THEN 's' END AS kind FROM t),
  f AS (SELECT entity, CASE WHEN max(n) >= 3 THEN count(*) FILTER (WHERE pos > n - 3 AND regexp_matches(state, 'violen|murder|assault')) / 3.0::DOUBLE ELSE 0 END AS recent,
    CASE WHEN max(n) >= 3 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, regr_slope(sev, pos::DOUBLE) / 2)) ELSE 0 END AS escalation, CASE WHEN max_by(age, pos) <> 0 AND max_by(age, pos) < 25 THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS age_factor,
    count(DISTINCT kind) / 4.0::DOUBLE AS versatility FROM x GROUP BY entity), r AS (SELECT *, 0.15::DOUBLE + 0.25::DOUBLE * recent + 0.2::DOUBLE * escalation + 0.1::DOUBLE * age_factor + 0.15::DOUBLE * versatility AS risk FROM f)
  SELECT entity, round(recent, 6) AS recent, round(escalation, 6) AS escalation, age_factor, versatility, round(risk, 6) AS risk,
    CASE WHEN risk < 0.3 THEN 'Low Risk' WHEN risk < 0.5 THEN 'Moderate Risk' WHEN risk < 0.7 THEN 'High Risk' ELSE 'Very High Risk' END AS level,
    CASE WHEN risk < 0.3 THEN 'Standard supervision' WHEN risk < 0.5 THEN 'Enhanced monitoring' WHEN risk < 0.7 THEN 'Intensive supervision' ELSE 'Maximum supervision and intervention' END AS action FROM r""")
def risk_score(spark, sf):
    return rounded(R.risk(_crimes(spark, sf)))


@query(CRIMES + """, l AS (SELECT entity, pos, age, state, (entity % 4)::BIGINT AS type FROM t), c AS (SELECT type, state, count(*) AS c FROM l GROUP BY ALL),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY c DESC, state) AS r FROM c) WHERE r <= 10),
  v AS (SELECT type, count(*) AS listed, count(*) FILTER (WHERE regexp_matches(state, 'violen|murder|assault')) AS n_violent, coalesce(sum(c) FILTER (WHERE regexp_matches(state, 'violen|murder|assault')), 0) AS occ FROM top GROUP BY 1),
  w AS (SELECT type, count(DISTINCT entity) AS n_entities, count(*)::DOUBLE / count(DISTINCT entity) AS avg_length, avg(age) AS mean_age FROM l GROUP BY 1),
  y AS (SELECT *, 0.3::DOUBLE * avg_length + 2 * n_violent + 0.1::DOUBLE * greatest(0.0::DOUBLE, 25 - mean_age) AS risk FROM w JOIN v USING (type))
  SELECT type, CASE WHEN avg_length < 5 THEN 'Brief' WHEN avg_length < 10 THEN 'Moderate' ELSE 'Extended' END || ' ' || CASE WHEN occ > 0.3 * listed THEN 'High-Violence' WHEN occ > 0 THEN 'Mixed-Severity' ELSE 'Non-Violent' END || ' Trajectory' AS name,
    n_entities, round(avg_length, 6) AS avg_length, round(mean_age, 6) AS mean_age, n_violent, round(risk, 6) AS risk, row_number() OVER (ORDER BY risk, type) - 1 AS risk_rank FROM y""")
def trajectory_profiles(spark, sf):
    seq = _crimes(spark, sf)
    return rounded(R.profiles(seq, seq.select("entity", F.pmod("entity", F.lit(4)).cast("long").alias("type")).distinct()))


@query(f"""WITH {SEQ}, h AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM seq), g AS (SELECT entity, mode_e, mode_l FROM
    (SELECT entity, min(state) FILTER (WHERE pos <= n // 2) AS mode_e, min(state) FILTER (WHERE pos > n // 2) AS mode_l FROM h WHERE n >= 6 GROUP BY 1)),
  c AS (SELECT mode_e AS early_type, mode_l AS late_type, count(*) AS n FROM g GROUP BY ALL) SELECT *, round(n::DOUBLE / sum(n) OVER (PARTITION BY early_type), 6) AS prob FROM c""")
def trajectory_type_changes(spark, sf):
    h = S.half_split(event_sequences(spark, sf)).where("n >= 6")
    half = lambda early: h.where(F.col("early") == early).groupBy("entity").agg(F.min("state").alias("type"))
    return rounded(R.type_changes(half(True), half(False)))


@query(f"""WITH {SEQ}, h AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM seq)
  SELECT entity, count(*) FILTER (WHERE pos <= n // 2) AS n_early, count(*) FILTER (WHERE pos > n // 2) AS n_late, mode_early, mode_late FROM h
  JOIN (SELECT entity, min(state) FILTER (WHERE pos <= n // 2) AS mode_early, min(state) FILTER (WHERE pos > n // 2) AS mode_late FROM h GROUP BY 1) USING (entity) GROUP BY ALL""")
def early_late_split(spark, sf):
    h = S.half_split(event_sequences(spark, sf))
    late = ~F.col("early")
    return h.groupBy("entity").agg(F.count_if("early").alias("n_early"), F.count_if(late).alias("n_late"), F.min(F.when(F.col("early"), F.col("state"))).alias("mode_early"), F.min(F.when(late, F.col("state"))).alias("mode_late"))


@query()
def trajectory_types(spark, sf):
    return R.types(R.features(event_sequences(spark, sf)))


@query(f"""WITH {SEQ}, a AS (SELECT entity, list(state ORDER BY pos) AS s, count(*) AS n FROM seq GROUP BY 1 HAVING count(*) >= 5),
  st AS (SELECT entity, t AS step, s[(t * (n - 1)) // 4 + 1] AS state FROM a, range(0, 5) r(t))
  SELECT a.step, a.state AS from_state, b.state AS to_state, count(*) AS n FROM st a JOIN st b ON a.entity = b.entity AND b.step = a.step + 1 GROUP BY ALL""")
def sankey_links(spark, sf):
    st = S.time_steps(S.assembled(event_sequences(spark, sf))).withColumn("step", F.col("step").cast("long"))
    nxt = st.select("entity", (F.col("step") - 1).alias("step"), F.col("state").alias("to_state"))
    return st.join(nxt, ["entity", "step"]).groupBy("step", F.col("state").alias("from_state"), "to_state").agg(F.count(F.lit(1)).alias("n"))


@query(MATRIX + "SELECT from_state, to_state, round(prob, 6) AS prob FROM matrix WHERE prob > 0")
def edge_list(spark, sf):
    return rounded(M.transition_matrix(event_sequences(spark, sf)).where("prob > 0").select("from_state", "to_state", "prob"))


@query(f"""WITH {SEQ}, {PAIRS}, d(rep, k) AS (SELECT r, k FROM range(0, 50) a(r), range(0, (SELECT count(DISTINCT entity) FROM seq)) b(k)),
  e AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT entity FROM seq)),
  draw AS (SELECT rep, (((rep * 1000003 + k) * 1103515245 + 12345) % 2147483648) // 65536 % (SELECT max(n) FROM e) AS k FROM d),
  c AS (SELECT e.k, from_state, to_state, count(*) AS c FROM pairs JOIN e USING (entity) GROUP BY ALL),
  b AS (SELECT rep, from_state, to_state, sum(c) AS c FROM draw JOIN c USING (k) GROUP BY ALL),
  p AS (SELECT rep, from_state, to_state, c::DOUBLE / sum(c) OVER (PARTITION BY rep, from_state) AS p FROM b)
  SELECT from_state, to_state, round(avg(p), 6) AS mean_prob, round(quantile_cont(p, 0.025), 6) AS low, round(quantile_cont(p, 0.975), 6) AS high FROM p GROUP BY ALL""")
def bootstrap_matrix_ci(spark, sf):
    from chainlake.operators.stats import bootstrap_matrix

    return rounded(bootstrap_matrix(event_sequences(spark, sf), 50))
