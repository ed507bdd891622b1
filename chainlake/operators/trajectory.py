"""Features, types and risk of whole sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severity of the states of the event table; other tables bring their own map.
SEVERITY = {"purchase": 3.0, "click": 2.0}


def severity(state: Column, known: dict[str, float] = SEVERITY) -> Column:
    entries = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.element_at(entries, state), F.lit(1.0))


def text_severity(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike("violen|murder|assault|rape"), 3).when(low.rlike("drug|theft|robbery"), 2).otherwise(1)


def features(seq: DataFrame) -> DataFrame:
    """One row per entity: size, diversity, ages, rates, transitions and their entropy, severity slope and maximum.

    ``recent`` is the share of the last three states with severity 3. ``rate`` is 1 over the mean of all gaps, 0 where that
    is not positive; ``rate_std`` looks at positive gaps alone; the entropy of transitions is in nats; the slope of a
    single state is 0. All steps stay with the entity, so rows are shuffled once.
    """
    w = Window.partitionBy("entity").orderBy("pos")
    x = seq.withColumn("gap", F.col("age") - F.lag("age").over(w)).withColumn("next", F.lead("state").over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("entity")))
    x = x.withColumn("sev", severity(F.col("state"))).withColumn("placed", F.col("sev") * F.col("pos") / F.col("n"))
    positive = F.when(F.col("gap") > 0, F.col("gap"))
    moves = x.where(F.col("next").isNotNull()).groupBy("entity", "state", "next").agg(F.count(F.lit(1)).alias("c"))
    share = F.col("c") / F.sum("c").over(Window.partitionBy("entity"))
    moves = moves.withColumn("p", share).groupBy("entity").agg(F.count(F.lit(1)).alias("n_transitions"), (-F.sum(F.col("p") * F.ln("p"))).alias("transition_entropy"))
    rows = x.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("state").alias("n_states"),
        (F.countDistinct("state") / F.count(F.lit(1))).alias("diversity"),
        F.min_by("age", "pos").alias("first_age"),
        F.max_by("age", "pos").alias("last_age"),
        (F.max_by("age", "pos") - F.min_by("age", "pos")).alias("duration"),
        F.when(F.avg("gap") > 0, 1.0 / F.avg("gap")).otherwise(0.0).alias("rate"),
        F.coalesce(F.stddev_pop(F.try_divide(F.lit(1.0), positive)), F.lit(0.0)).alias("rate_std"),
        F.coalesce(F.regr_slope("placed", F.col("pos").cast("double")), F.lit(0.0)).alias("severity_slope"),
        F.max("placed").alias("max_severity"),
        F.avg(F.when(F.col("pos") > F.col("n") - 3, (F.col("sev") >= 3).cast("int"))).alias("recent"),
    )
    none = {"n_transitions": F.coalesce("n_transitions", F.lit(0)), "transition_entropy": F.coalesce("transition_entropy", F.lit(0.0))}
    return rows.join(moves, "entity", "left").withColumns(none)


VIOLENT = "violen|murder|assault"
#: Share of the risk that a named type brings; any other name brings 0.5.
TYPE_RISK = {"Low-Risk": 0.2, "Moderate-Risk": 0.5, "High-Risk": 0.8, "Chronic-Offender": 0.9}


def event_severity(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike("murder|kill"), 10.0).when(low.rlike("violen|assault|rape"), 7.0).when(low.rlike("armed|weapon"), 5.0).when(low.rlike("drug|theft"), 3.0).otherwise(1.0)


def crime_type(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("violen"), "violent").when(low.contains("drug"), "drug").when(low.rlike("theft|robbery"), "property").when(low.rlike("sex|rape"), "sexual")


def risk(seq: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """entity, recent, escalation, age_factor, versatility, risk, level, action from (entity, pos, state, age).

    ``recent``: violent share of the last three events, 0 for fewer than three; ``escalation``: half the slope of
    severity over position, between 0 and 1; ``age_factor``: 0.3 under 25 (by the last age; NULL and 0 count as
    unknown), else 0.1; ``versatility``: distinct crime types of four. ``types`` (entity, type) brings names. One
    aggregation over one window.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("entity"))
    x = seq.withColumn("n", n)
    last = (F.col("pos") > F.col("n") - 3) & F.lower("state").rlike(VIOLENT)
    parts = x.groupBy("entity").agg(
        F.when(F.max("n") >= 3, F.count_if(last) / 3).otherwise(0.0).alias("recent"),
        F.when(F.max("n") >= 3, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.regr_slope(event_severity(F.col("state")), F.col("pos").cast("double")) / 2))).otherwise(0.0).alias("escalation"),
        F.when((F.max_by("age", "pos") != 0) & (F.max_by("age", "pos") < 25), 0.3).otherwise(0.1).alias("age_factor"),
        (F.countDistinct(crime_type(F.col("state"))) / 4).alias("versatility"),
    )
    kind = F.lit(0.5)
    if types is not None:
        parts = parts.join(types.select("entity", "type"), "entity", "left")
        kind = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in TYPE_RISK.items() for v in kv]), F.col("type")), F.lit(0.5))
    score = 0.3 * kind + 0.25 * F.col("recent") + 0.2 * F.col("escalation") + 0.1 * F.col("age_factor") + 0.15 * F.col("versatility")
    named = parts.withColumn("risk", score).withColumn("level", risk_level(F.col("risk")))
    return named.withColumn("action", risk_action(F.col("risk"))).select("entity", "recent", "escalation", "age_factor", "versatility", "risk", "level", "action")


def risk_level(score: Column) -> Column:
    return F.when(score < 0.3, "Low Risk").when(score < 0.5, "Moderate Risk").when(score < 0.7, "High Risk").otherwise("Very High Risk")


def risk_action(score: Column) -> Column:
    return F.when(score < 0.3, "Standard supervision").when(score < 0.5, "Enhanced monitoring").when(score < 0.7, "Intensive supervision").otherwise("Maximum supervision and intervention")


def profiles(seq: DataFrame, labels: DataFrame, top: int = 10) -> DataFrame:
    """type, n_entities, avg_length, mean_age, violent_share and risk rank of the types in ``labels`` (entity, type).

    ``n_violent`` counts violent events among a type's ``top`` commonest (ties by name). The name has a length class
    and a severity class: over 0.3 violent occurrences per listed event, any, none. Risk is 0.3 * average length + 2 *
    violent events listed + 0.1 * years of the mean age under 25; ranks from 0, ascending.
    """
    x = seq.join(labels.select("entity", "type"), "entity")
    common = x.groupBy("type", "state").agg(F.count(F.lit(1)).alias("c"))
    common = common.withColumn("r", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("c"), "state"))).where(F.col("r") <= top)
    violent = F.lower("state").rlike(VIOLENT)
    listed = common.groupBy("type").agg(F.count(F.lit(1)).alias("listed"), F.count_if(violent).alias("n_violent"), F.sum(F.when(violent, F.col("c")).otherwise(0)).alias("occurrences"))
    whole = x.groupBy("type").agg(F.countDistinct("entity").alias("n_entities"), (F.count(F.lit(1)) / F.countDistinct("entity")).alias("avg_length"), F.avg("age").alias("mean_age"))
    y = whole.join(listed, "type")
    risk = 0.3 * F.col("avg_length") + 2 * F.col("n_violent") + 0.1 * F.greatest(F.lit(0.0), 25 - F.coalesce("mean_age", F.lit(25.0)))
    length = F.when(F.col("avg_length") < 5, "Brief").when(F.col("avg_length") < 10, "Moderate").otherwise("Extended")
    severe = F.when(F.col("occurrences") > 0.3 * F.col("listed"), "High-Violence").when(F.col("occurrences") > 0, "Mixed-Severity").otherwise("Non-Violent")
    y = y.withColumn("risk", risk).withColumn("name", F.concat_ws(" ", length, severe, F.lit("Trajectory")))
    return y.withColumn("risk_rank", (F.row_number().over(Window.orderBy("risk", "type")) - 1).cast("long")).select("type", "name", "n_entities", "avg_length", "mean_age", "n_violent", "risk", "risk_rank")


def type_changes(early: DataFrame, late: DataFrame) -> DataFrame:
    """early_type, late_type, n, prob: how entities' types go from their early to their late half."""
    both = early.select("entity", F.col("type").alias("early_type")).join(late.select("entity", F.col("type").alias("late_type")), "entity")
    n = both.groupBy("early_type", "late_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy("early_type")))


TYPE_FEATURES = ["n", "diversity", "duration", "severity_slope", "max_severity"]
#: Rows of one task of a pass, at least; fewer than so many a task cost more to start than to read.
PASS_ROWS = 8192


def drawn(data: DataFrame, runs: int, size: int) -> np.ndarray:
    """(run, slot, feature): ``size`` rows (entity, features) of each run, those with the smallest hashes, repeated if there are fewer."""

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for run in range(runs):
                yield x.nsmallest(size, f"h{run}")[[f"h{run}", "entity", "x"]].set_axis(["h", "entity", "x"], axis=1).assign(run=run)

    hashed = data.select("entity", vector_to_array("features").alias("x"), *[F.xxhash64("entity", F.lit(run)).alias(f"h{run}") for run in range(runs)])
    rank = F.row_number().over(Window.partitionBy("run").orderBy("h", "entity"))
    few = hashed.mapInPandas(least, f"h long, entity {dict(data.dtypes)['entity']}, x array<double>, run int").withColumn("r", rank).where(F.col("r") <= size)
    rows = [[r["x"] for r in found] for found in _by_run(few.collect(), runs)]
    return np.array([[x[i % len(x)] for i in range(size)] for x in rows])


def _by_run(rows: list, runs: int) -> list[list]:
    return [sorted((r for r in rows if r["run"] == run), key=lambda r: r["r"]) for run in range(runs)]


def weighted_densities(x: np.ndarray, weight: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """(row, run, kind): density of the row by the kind, times its weight; with pseudo-inverses, as Spark's mixture has them."""
    out = np.empty((len(x), *weight.shape))
    for run, kind in np.ndindex(weight.shape):
        values, vectors = np.linalg.eigh(cov[run, kind])
        kept = values > np.finfo(float).eps * values.max() * len(values)
        root = vectors[:, kept] / np.sqrt(values[kept])
        apart = ((x - mean[run, kind]) @ root) ** 2
        logarithm = -0.5 * (len(values) * np.log(2 * np.pi) + np.log(values[kept]).sum() + apart.sum(axis=1))
        out[:, run, kind] = np.finfo(float).eps + weight[run, kind] * np.exp(logarithm)
    return out


def mixtures(data: DataFrame, k: int, restarts: int, passes: int = 50, tolerance: float = 0.01) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Weights, means, covariances and log-likelihood of the likeliest of some full-covariance mixtures of (entity, features).

    By the steps of Spark's ``GaussianMixture``, but all restarts go through one pass over the rows, which gives some sums
    by restart and kind; a restart stops by itself. First kinds are of five rows each, drawn by a hash of the entity, so
    they do not depend on how rows lie in partitions.
    """
    first = drawn(data, restarts, 5 * k).reshape(restarts, k, 5, -1)
    wide = first.shape[-1]
    weight, mean = np.full((restarts, k), 1 / k), first.mean(axis=2)
    cov = np.eye(wide) * first.var(axis=2)[..., None]
    likely, before, open_runs = np.full(restarts, -np.inf), np.full(restarts, np.inf), np.arange(restarts)
    vectors = data.select(vector_to_array("features").alias("x"))
    for _ in range(passes):
        now = tuple(p[open_runs] for p in (weight, mean, cov))

        def sums(batches: Iterator[pd.DataFrame], now: tuple = now) -> Iterator[pd.DataFrame]:
            """Of each restart and kind: responsibility, and by it the rows and their products; of each restart: log-likelihood."""
            total = 0
            for batch in batches:
                if len(batch):
                    x = np.stack(batch["x"])
                    p = weighted_densities(x, *now)
                    whole = p.sum(axis=2)
                    p /= whole[..., None]
                    products = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
                    each = np.concatenate([np.ones((len(x), 1)), x, products], axis=1)
                    total = total + np.concatenate([(p.reshape(len(x), -1).T @ each).ravel(), np.log(whole).sum(axis=0)])
            if not np.isscalar(total):
                yield pd.DataFrame({"s": [total.tolist()]})

        s = np.sum([r["s"] for r in vectors.mapInPandas(sums, "s array<double>").collect()], axis=0)
        score, s = s[-len(open_runs) :], s[: -len(open_runs)].reshape(len(open_runs), k, -1)
        r = s[..., 0]
        weight[open_runs] = r / r.sum(axis=1)[:, None]
        mean[open_runs] = middle = s[..., 1 : wide + 1] / r[..., None]
        cov[open_runs] = s[..., wide + 1 :].reshape(len(open_runs), k, wide, wide) / r[..., None, None] - middle[..., :, None] * middle[..., None, :]
        before[open_runs], likely[open_runs] = likely[open_runs], score
        open_runs = open_runs[np.abs(score - before[open_runs]) > tolerance]
        if not len(open_runs):
            break
    best = int(np.argmax(likely))
    return weight[best], mean[best], cov[best], float(likely[best])


def types(found: DataFrame, k: int = 4, restarts: int = 10) -> DataFrame:
    """entity, type, probability: the likeliest of some full-covariance mixtures over standardised features."""
    kind = f"entity {dict(found.dtypes)['entity']}, type int, probability double"
    rows = found.select("entity", *TYPE_FEATURES).persist()
    n = rows.count()
    if not n:
        return found.sparkSession.createDataFrame([], kind)
    raw = VectorAssembler(inputCols=TYPE_FEATURES, outputCol="raw").transform(rows.coalesce(max(1, min(n // PASS_ROWS, found.sparkSession.sparkContext.defaultParallelism))))
    data = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(raw).transform(raw).select("entity", "features").persist()
    weight, mean, cov, _ = mixtures(data, k, restarts)

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                p = weighted_densities(np.stack(x["x"]), weight[None], mean[None], cov[None])[:, 0]
                yield pd.DataFrame({"entity": x["entity"], "type": p.argmax(axis=1).astype("int32"), "probability": p.max(axis=1) / p.sum(axis=1)})

    return data.select("entity", vector_to_array("features").alias("x")).mapInPandas(named, kind)
