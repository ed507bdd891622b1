"""Entity vectors: state shares, mean vectors, matrices by group, and prediction of a state from attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlake.operators.stats import draw, indexed


def state_shares(seq: DataFrame) -> DataFrame:
    """entity, state, share, over all states of the table; 0 where an entity lacks one."""
    counts = seq.groupBy("entity", "state").agg(F.count(F.lit(1)).alias("c"))
    full = counts.select("entity").distinct().join(seq.select("state").distinct()).join(counts, ["entity", "state"], "left")
    c = F.coalesce("c", F.lit(0))
    return full.select("entity", "state", (c / F.sum(c).over(Window.partitionBy("entity"))).alias("share"))


def mean_vectors(df: DataFrame, key: str) -> DataFrame:
    """key, i, x: mean of each element of ``v``, long, with partial sums."""
    return df.select(key, F.posexplode("v").alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))


def shares_with_attributes(seq: DataFrame, attributes: DataFrame, *columns: str) -> DataFrame:
    """entity, v: state shares in order of states, then the attribute columns (NULL or absent: 0)."""
    s = state_shares(seq).groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("state", "share"))).alias("s"))
    parts = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    return s.join(attributes.select("entity", *columns), "entity", "left").select("entity", F.concat(F.col("s.share"), F.array(*parts)).alias("v"))


def mean_matrices(matrices: DataFrame, labels: DataFrame) -> DataFrame:
    """label, from_state, to_state, prob: mean of the entity matrices (entity, from_state, to_state, prob) of a label."""
    sizes = labels.groupBy("label").agg(F.countDistinct("entity").alias("n"))
    sums = matrices.join(labels.select("entity", "label"), "entity").groupBy("label", "from_state", "to_state").agg(F.sum("prob").alias("s"))
    return sums.join(sizes, "label").select("label", "from_state", "to_state", (F.col("s") / F.col("n")).alias("prob"))


def regression(features: DataFrame, columns: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """One row on a logistic regression of ``y`` (0 or 1) on ``columns`` by stratified k-fold: n, accuracy and F1 (means).

    Folds are dealt per class. The penalty is that of C = 1: regParam = 1 / n. A table with one class has no model:
    accuracy and F1 are NULL.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(features.select("entity", F.col("y").cast("double").alias("label"), *[F.col(c).cast("double") for c in columns]))
    rows = rows.join(indexed(rows), "entity").withColumn("fold", F.pmod(F.row_number().over(Window.partitionBy("label").orderBy(draw(F.lit(seed).cast("long"), F.col("k"), F.lit(1 << 15)), "k")), F.lit(k)))
    rows = rows.select("entity", "label", "features", "fold").cache()
    n, classes = rows.agg(F.count(F.lit(1)), F.countDistinct("label")).first()
    scored = None
    for fold in range(k if classes == 2 else 0):
        train = rows.where(F.col("fold") != fold)
        fitted = LogisticRegression(regParam=1.0 / max(1, n), maxIter=100).fit(train).transform(rows.where(F.col("fold") == fold)).select("fold", "label", "prediction")
        scored = fitted if scored is None else scored.unionByName(fitted)
    if scored is None:
        return features.sparkSession.createDataFrame([(n, None, None)], "n long, accuracy double, f1 double")
    hit = F.count_if((F.col("label") == 1) & (F.col("prediction") == 1))
    per = scored.groupBy("fold").agg(F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("accuracy"), F.coalesce(F.try_divide(2 * hit, F.sum("label") + F.sum("prediction")), F.lit(0.0)).alias("f1"))
    return per.agg(F.lit(n).cast("long").alias("n"), F.avg("accuracy").alias("accuracy"), F.avg("f1").alias("f1"))


def state_target(seq: DataFrame, state: str) -> DataFrame:
    """entity, y: whether an entity is ever in a state."""
    return seq.groupBy("entity").agg(F.max((F.col("state") == state).cast("int")).alias("y"))


def regressions(targets: dict[str, DataFrame], feature_sets: dict[str, list[str]], k: int = 5, seed: int = 42) -> DataFrame:
    """target, features, n, accuracy, f1, best: every target (entity, y, columns) on every set of columns.

    ``best`` marks the most accurate target of a set, the first by name of equals; a target without a model is none.
    """
    out = None
    for target, rows in targets.items():
        for name, columns in feature_sets.items():
            one = regression(rows, columns, k, seed).select(F.lit(target).alias("target"), F.lit(name).alias("features"), "n", "accuracy", "f1")
            out = one if out is None else out.unionByName(one)
    first = F.row_number().over(Window.partitionBy("features").orderBy(F.desc_nulls_last("accuracy"), "target"))
    return out.withColumn("best", (first == 1) & F.col("accuracy").isNotNull())
