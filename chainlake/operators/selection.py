"""Choice of k from a table of scores (k, silhouette, calinski_harabasz, davies_bouldin, inertia), in Spark expressions.

Score tables have one row per k, so windows over all of them are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainlake.operators.vectors import as_features, calinski_harabasz, davies_bouldin

def everything():
    return Window.partitionBy()


def score_table(df: DataFrame, ks: range, seed: int = 42) -> DataFrame:
    """k with its four scores; each k is one distributed fit over cached features."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    data = as_features(df).select("id", "v", "features").cache()
    out = None
    for k in ks:
        model = KMeans(k=k, seed=seed, maxIter=20).fit(data)
        labelled = model.transform(data)
        silhouette = float(ClusteringEvaluator().evaluate(labelled))
        named = labelled.select("id", "v", F.col("prediction").alias("label"))
        row = calinski_harabasz(named).join(davies_bouldin(named)).select(F.lit(k).cast("long").alias("k"), F.lit(silhouette).alias("silhouette"), "calinski_harabasz", "davies_bouldin", "inertia")
        out = row if out is None else out.unionByName(row)
    return out


def votes(scores: DataFrame, elbow: bool = False) -> DataFrame:
    """k: what most criteria choose; the lowest of equals. With ``elbow`` the knee of the inertia votes too."""
    best = [F.max_by("k", F.struct("silhouette", -F.col("k"))), F.max_by("k", F.struct("calinski_harabasz", -F.col("k"))), F.min_by("k", F.struct("davies_bouldin", "k"))]
    if elbow:
        scores = scores.withColumn("chord", chord_distance(F.col("k").cast("double"), F.col("inertia")))
        best.append(F.max_by("k", F.struct("chord", -F.col("k"))))
    cast = scores.agg(F.array(*best).alias("v")).select(F.explode("v").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n_votes"))
    return cast.orderBy(F.desc("n_votes"), "k").limit(1)


def chord_distance(x: Column, y: Column) -> Column:
    """Distance of each point of a curve, both axes scaled to 0..1, from the line between its ends."""
    unit = lambda c: F.try_divide(c - F.min(c).over(everything()), F.max(c).over(everything()) - F.min(c).over(everything()))
    first = F.first(y).over(everything().orderBy(x).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    falls = F.when(first == F.max(y).over(everything()), F.lit(1)).otherwise(F.lit(-1))
    line = F.when(falls > 0, 1 - unit(x)).otherwise(unit(x))
    return F.coalesce(F.abs(unit(y) - line) / F.sqrt(F.lit(2.0)), F.lit(0.0))


def weighted(scores: DataFrame) -> DataFrame:
    """k, score: 0.4 silhouette + 0.3 Calinski-Harabasz, both over their maximum, + 0.3 reversed Davies-Bouldin in its range."""
    share = lambda c: F.when(F.max(c).over(everything()) > 0, F.col(c) / F.max(c).over(everything())).otherwise(0.0)
    top, low = F.max("davies_bouldin").over(everything()), F.min("davies_bouldin").over(everything())
    reverse = F.when(top > low, (top - F.col("davies_bouldin")) / (top - low)).otherwise(1.0)
    return scores.select("k", (0.4 * share("silhouette") + 0.3 * share("calinski_harabasz") + 0.3 * reverse).alias("score"))


def conditional_effect(effects: DataFrame, silhouettes: DataFrame, least_effect: float = 0.1, least_silhouette: float = 0.1) -> DataFrame:
    """k, rate, mean_effect, score from effects (k, effect of one condition) and silhouettes (k, silhouette).

    ``rate`` is the share of conditions with an effect over ``least_effect``, ``mean_effect`` their mean; the score is
    0.3 silhouette + 0.7 rate * mean_effect. A k with a smaller silhouette than ``least_silhouette`` is left out.
    """
    over = F.col("effect") > least_effect
    e = effects.groupBy("k").agg((F.count_if(over) / F.count(F.lit(1))).alias("rate"), F.coalesce(F.avg(F.when(over, F.col("effect"))), F.lit(0.0)).alias("mean_effect"))
    s = silhouettes.select("k", "silhouette").where(F.col("silhouette") >= least_silhouette)
    return e.join(s, "k").select("k", "rate", "mean_effect", (0.3 * F.col("silhouette") + 0.7 * F.col("rate") * F.col("mean_effect")).alias("score"))


def multi_objective(effects: DataFrame, silhouettes: DataFrame, strict: bool = False) -> DataFrame:
    """k, score: 0.3 silhouette + 0.7 effect score; the effect score holds the silhouette already unless ``strict``."""
    e = conditional_effect(effects, silhouettes).join(silhouettes.select("k", "silhouette"), "k")
    effect = F.col("rate") * F.col("mean_effect") if strict else F.col("score")
    return e.select("k", (0.3 * F.col("silhouette") + 0.7 * effect).alias("score"))


def clamped(k: int, n: int, default: int = 5) -> int:
    """The k to apply to n rows: at most n // 2, at least 2; the default where none was chosen."""
    return max(2, min(k or default, n // 2))
