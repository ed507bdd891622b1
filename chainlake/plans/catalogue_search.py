"""Queries of searches for the number of clusters, over several vector tables, and of several regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlake.operators import conditional as D
from chainlake.operators import entities as E
from chainlake.operators import search as H
from chainlake.operators import vectors as K
from chainlake.operators.sequences import numbered
from chainlake.plans.registry import customer_attributes, event_sequences, query, read, rounded, vectors


@query()
def k_search_methods(spark, sf):
    """Three searches by silhouette; each k is fitted once."""
    data = vectors(spark, sf).select("id", "v").persist()
    score = lambda k: K.k_scores(data, range(k, k + 1)).first()["silhouette"]
    ks = range(3, 9)
    methods = {"patient": lambda f: H.patient(f, ks), "spread": lambda f: H.spread(f, ks, 2, 2), "screened": lambda f: H.screened(f, f, ks)}
    return H.compared(methods, score, spark)


@query()
def model_ranking(spark, sf):
    """The halves of the vectors count as two models."""
    x = vectors(spark, sf)
    return H.model_ranking(H.model_scores({"first": x.select("id", F.slice("v", 1, 32).alias("v")), "second": x.select("id", F.slice("v", 33, 32).alias("v"))}, range(3, 6)))


@query()
def validated_search(spark, sf):
    """Five neighbouring vectors count as the history of a customer: totals of the second part beside its null."""
    x = vectors(spark, sf).select("id", "v").withColumn("entity", (F.floor(F.col("id") / 5) + 1).cast("long"))
    found = H.validated_search(numbered(x, "entity", "id"), D.condition_map(customer_attributes(spark, sf)), range(3, 6))
    return rounded(found["totals"].join(found["null_summary"]))


@query()
def state_regressions(spark, sf):
    """The two least common states on two sets of columns."""
    seq = event_sequences(spark, sf).persist()
    rare = [r["state"] for r in seq.groupBy("state").count().orderBy("count", "state").limit(2).collect()]
    attr = read(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), "c_acctbal", "c_nationkey")
    return E.regressions({s: E.state_target(seq, s).join(attr, "entity") for s in rare}, {"basic": ["c_acctbal"], "extended": ["c_acctbal", "c_nationkey"]})


@query()
def pca_3d(spark, sf):
    return K.principal(vectors(spark, sf), 3)
