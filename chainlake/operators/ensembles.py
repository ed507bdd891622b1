"""Clusterings by several methods, their consensus, and clusters of entities by their matrices."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlake.functions.special import average_linkage_labels, ward_linkage
from chainlake.operators.markov import entity_matrices
from chainlake.operators.vectors import k_scores

METHODS = ("kmeans", "bisecting", "gaussian")
#: Rows that a method with n by n distances takes at most; it raises beyond.
DENSE_ROWS = 5000


def _features(vectors: DataFrame, components: int | None) -> DataFrame:
    rows = vectors.select("id", array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("raw"))
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(rows).transform(rows).select("id", "features")
    if not components:
        return scaled
    return PCA(k=components, inputCol="features", outputCol="pc").fit(scaled).transform(scaled).select("id", F.col("pc").alias("features"))


def clustered(vectors: DataFrame, k: int, method: str = "kmeans", seed: int = 42, components: int | None = None) -> DataFrame:
    """id, cluster of rows (id, v), standardised and, with ``components``, projected on principal axes.

    ``kmeans``, ``bisecting`` and ``gaussian`` run on Spark; ``ward`` needs all distances and takes at most ``DENSE_ROWS`` rows.
    """
    rows = _features(vectors, components)
    if method == "ward":
        return _ward(rows, k)
    kinds = {"kmeans": lambda: KMeans(k=k, seed=seed, maxIter=30), "bisecting": lambda: BisectingKMeans(k=k, seed=seed), "gaussian": lambda: GaussianMixture(k=k, seed=seed, maxIter=30)}
    if method not in kinds:
        raise ValueError(f"unknown method {method}; known are {', '.join((*kinds, 'ward'))}")
    return kinds[method]().fit(rows).transform(rows).select("id", F.col("prediction").alias("cluster"))


def _ward(rows: DataFrame, k: int) -> DataFrame:
    held = _bounded(rows)
    points = np.array([r["features"].toArray() for r in held])
    label = list(range(len(points)))
    names = {i: [i] for i in range(len(points))}
    for step, (a, b, *_) in enumerate(ward_linkage(points)[: max(0, len(points) - k)]):
        names[len(points) + step] = names.pop(int(a)) + names.pop(int(b))
    for c, members in enumerate(sorted(names.values(), key=min)):
        for i in members:
            label[i] = c
    return rows.sparkSession.createDataFrame([(r["id"], c) for r, c in zip(held, label, strict=True)], f"id {dict(rows.dtypes)['id']}, cluster int")


def _bounded(rows: DataFrame) -> list:
    held = rows.orderBy("id").limit(DENSE_ROWS + 1).collect()
    if len(held) > DENSE_ROWS:
        raise ValueError(f"more than {DENSE_ROWS} rows: take a method without a distance for each two rows")
    return held


def ensemble_runs(vectors: DataFrame, k: int, methods: tuple[str, ...] = METHODS, iterations: int = 2, noise: float = 0.01, seed: int = 42) -> DataFrame:
    """run, id, cluster of each method and iteration; the rows of each iteration get normal noise of deviation ``noise``."""
    out = None
    for i in range(iterations):
        moved = vectors.select("id", F.posexplode("v").alias("at", "x"))
        u = lambda salt, i=i: (F.pmod(F.xxhash64("id", "at", F.lit(i), F.lit(salt)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
        moved = moved.withColumn("x", F.col("x").cast("double") + noise * F.sqrt(-2 * F.ln(u(1))) * F.cos(6.283185307179586 * u(2)))
        moved = moved.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("v"))
        for j, method in enumerate(methods):
            found = clustered(moved, k, method, seed + i).select(F.lit(i * len(methods) + j).alias("run"), "id", "cluster")
            out = found if out is None else out.unionByName(found)
    return out


def consensus(runs: DataFrame, k: int) -> DataFrame:
    """id, cluster: average linkage on one minus the share of runs that put two rows together.

    Rows with the same clusters in all runs are one point, so the matrix has a row per distinct combination, of which
    there may be ``DENSE_ROWS``. Points count once, whatever the number of their rows.
    """
    n = runs.select("run").distinct().count()
    profile = runs.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "cluster"))), lambda s: s["cluster"]).alias("p"))
    points = [tuple(r["id"]) for r in _bounded(profile.select(F.col("p").alias("id")).distinct())]
    x = np.array(points).reshape(len(points), n)
    together = (x[:, None] == x[None]).mean(axis=2)
    label = average_linkage_labels(together, min(k, len(points)))
    named = runs.sparkSession.createDataFrame([(list(p), int(c)) for p, c in zip(points, label, strict=True)], "p array<int>, cluster int")
    return profile.join(named, "p").select("id", "cluster")


def robust_clusters(vectors: DataFrame, ks: range = range(3, 7), methods: tuple[str, ...] = METHODS, seed: int = 42) -> DataFrame:
    """id, cluster, k of the consensus at the k whose clusters have the best silhouette."""
    scores = k_scores(vectors, ks, seed)
    k = scores.agg(F.max_by("k", F.struct("silhouette", -F.col("k")))).first()[0]
    return consensus(ensemble_runs(vectors, k, methods, 1, seed=seed), k).withColumn("k", F.lit(k))


def entity_clusters(seq: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """entity, cluster by k-means on the entities' flattened matrices."""
    cells = entity_matrices(seq).select(F.col("entity").alias("id"), array_to_vector("cells").alias("features"))
    return KMeans(k=k, seed=seed, maxIter=30).fit(cells).transform(cells).select(F.col("id").alias("entity"), F.col("prediction").alias("cluster"))


def views_joined(*views: DataFrame) -> DataFrame:
    """id, v: the standardised vectors of several views (id, v), one after the other."""
    out = None
    for i, view in enumerate(views):
        one = _features(view, None).select("id", F.col("features").alias(f"f{i}"))
        out = one if out is None else out.join(one, "id")
    from pyspark.ml.functions import vector_to_array

    return out.select("id", F.concat(*[vector_to_array(f"f{i}") for i in range(len(views))]).alias("v"))
