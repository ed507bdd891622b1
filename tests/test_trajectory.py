"""Types of trajectories, fitted by passes that all restarts share."""

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from chainlake.operators import trajectory as R


def rows(spark, seed=1, n=150):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(6 * c, 1 + 0.2 * c, (n, 5)) for c in range(3)])
    return x, spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], ["entity", *R.TYPE_FEATURES])


def density(x, weight, mean, cov):
    out = []
    for w, m, c in zip(weight, mean, cov):
        d = x - m
        out.append(w * np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d)) / np.sqrt(np.linalg.det(2 * np.pi * c)))
    return np.array(out).T


def test_types_share_passes_and_do_not_depend_on_partitions(spark):
    x, df = rows(spark)
    spark.sparkContext.setJobGroup("types", "types")
    found = {r["entity"]: (r["type"], r["probability"]) for r in R.types(df, 3, 6).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("types"))
    spark.sparkContext.setJobGroup("other", "other")
    assert jobs < 90
    again = {r["entity"]: (r["type"], r["probability"]) for r in R.types(df.repartition(5, F.col("n")), 3, 6).collect()}
    assert all(found[k][0] == again[k][0] and abs(found[k][1] - again[k][1]) < 1e-6 for k in found)
    assert len({(i // 150, found[i][0]) for i in found}) == 3
    assert R.types(df.limit(0), 3, 2).count() == 0
    assert {r["type"] for r in R.types(df.limit(1), 2, 2).collect()} <= {0, 1}


def test_steps_of_a_mixture(spark):
    x, _ = rows(spark, 2, 40)
    data = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x)], ["entity", "features"])
    first = R.drawn(data, 4, 15).reshape(4, 3, 5, 5)
    best = None
    for run in range(4):
        w, m, c = np.full(3, 1 / 3), first[run].mean(axis=1), np.array([np.diag(s.var(axis=0)) for s in first[run]])
        before, score = np.inf, -np.inf
        for _ in range(50):
            p = density(x, w, m, c) + np.finfo(float).eps
            before, score = score, np.log(p.sum(axis=1)).sum()
            r = p / p.sum(axis=1)[:, None]
            w, m = r.mean(axis=0), (r.T @ x) / r.sum(axis=0)[:, None]
            c = np.array([(r[:, [k]] * x).T @ x / r[:, k].sum() - np.outer(m[k], m[k]) for k in range(3)])
            if abs(score - before) <= 0.01:
                break
        best = max(best or (-np.inf,), (score, w, m, c), key=lambda b: b[0])
    weight, mean, cov, likely = R.mixtures(data, 3, 4)
    assert abs(likely - best[0]) < 1e-3
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip((weight, mean, cov), best[1:]))
