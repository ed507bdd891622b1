"""Searches for the number of clusters: with few evaluations, over several vector tables, and validated on a split sample."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlake.functions.special import chi2_counts
from chainlake.operators import conditional as D
from chainlake.operators.markov import transition_matrix
from chainlake.operators.sequences import of_part, running_total, split_entities
from chainlake.operators.validation import kmeans_labels, shuffled
from chainlake.operators.vectors import k_scores

Score = Callable[[int], float]
#: Clusterings of a smaller silhouette score 0; weights of silhouette and effects in a score.
LEAST_SILHOUETTE, SILHOUETTE_WEIGHT, EFFECT_WEIGHT = 0.1, 0.3, 0.7


def patient(score: Score, ks: Iterable[int], patience: int = 3) -> dict[int, float]:
    """Scores of ks in turn, until ``patience`` in a row are no better than the best so far."""
    found, best, idle = {}, -1.0, 0
    for k in ks:
        found[k] = score(k)
        idle = 0 if found[k] > best else idle + 1
        best = max(best, found[k])
        if idle >= patience:
            break
    return found


def spread(score: Score, ks: Iterable[int], first: int = 3, more: int = 5, seed: int = 42) -> dict[int, float]:
    """Scores of ``first`` drawn ks, then of ``more``, each the one farthest from all before it (the lowest of equals)."""
    left = list(ks)
    found = {int(k): score(int(k)) for k in np.random.default_rng(seed).choice(left, min(first, len(left)), replace=False)}
    for _ in range(more):
        left = [k for k in left if k not in found]
        if not left:
            break
        k = max(left, key=lambda k: min((abs(k - other) for other in found), default=0))
        found[k] = score(k)
    return found


def screened(quick: Score, score: Score, ks: Iterable[int], top: int = 3) -> dict[int, float]:
    """Scores of the ``top`` ks by a quick score."""
    return {k: score(k) for k in sorted(ks, key=quick, reverse=True)[:top]}


def best_of(found: dict[int, float]) -> int:
    """The k of the largest score, the first evaluated of equals."""
    return max(found, key=found.get)


def compared(methods: dict[str, Callable[[Score], dict[int, float]]], score: Score, spark) -> DataFrame:
    """method, k, score, n_evaluated of each search; a k that several methods ask for is evaluated once."""
    held = cache(score)
    rows = []
    for name, method in methods.items():
        found = method(held)
        k = best_of(found)
        rows.append((name, k, float(found[k]), len(found)))
    return spark.createDataFrame(rows, "method string, k long, score double, n_evaluated long")


def model_scores(views: dict[str, DataFrame], ks: range, seed: int = 42) -> DataFrame:
    """model, k, silhouette, inertia of several vector tables (id, v) of the same rows."""
    out = None
    for name, view in views.items():
        one = k_scores(view, ks, seed).select(F.lit(name).alias("model"), "k", "silhouette", "inertia")
        out = one if out is None else out.unionByName(one)
    return out


def model_ranking(scores: DataFrame) -> DataFrame:
    """model, best_k, best_silhouette, rank: models by their best silhouette, ties by name. A row per model."""
    best = scores.groupBy("model").agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("best_k"), F.max("silhouette").alias("best_silhouette"))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("best_silhouette"), "model")))


def group_effects(seq: DataFrame, conditions: DataFrame, least: int = D.MIN_GROUP) -> DataFrame:
    """heading_key, value, n, effect, p_value of each group's matrix against that of all.

    ``effect`` is the Frobenius distance, ``p_value`` that of chi square on the cells as truncated percents.
    """
    whole = transition_matrix(seq).select("from_state", "to_state", F.col("prob").alias("q"))
    both = D.conditional_matrices(seq, conditions, least).join(whole, ["from_state", "to_state"])
    d = F.col("prob") - F.col("q")
    cells = F.array_sort(F.collect_list(F.struct("from_state", "to_state", "prob", "q")))
    held = both.groupBy("heading_key", "value").agg(cells.alias("cells"), F.sqrt(F.sum(d * d)).alias("effect"))
    p = F.pandas_udf(lambda a, b: pd.Series([chi2_counts(np.asarray(x), np.asarray(y), 100)[1] for x, y in zip(a, b, strict=True)], dtype=float), "double")
    found = held.join(D.large_groups(conditions, least), ["heading_key", "value"])
    return found.select("heading_key", "value", "n", "effect", p("cells.prob", "cells.q").alias("p_value"))


def corrected(effects: DataFrame, alpha: float = 0.05) -> DataFrame:
    """n_effects, n_significant, n_bonferroni, n_bh, n_stop_first, mean_effect over all tests of a table; a row per group, so few.

    ``n_bh`` is Benjamini-Hochberg's count, ``n_stop_first`` that of the ranks before the first that fails its line.
    """
    m = F.count(F.lit(1)).over(Window.partitionBy())
    ranked = effects.withColumn("m", m).withColumn("rank", F.row_number().over(Window.orderBy("p_value", "heading_key", "value")))
    under = lambda limit: F.count_if(F.col("p_value") < limit)
    passes = F.col("p_value") <= F.col("rank") / F.col("m") * alpha
    bh = F.coalesce(F.max(F.when(passes, F.col("rank"))), F.lit(0)).cast("long")
    stop = F.coalesce(F.min(F.when(~passes, F.col("rank"))) - 1, F.count(F.lit(1))).cast("long")
    return ranked.agg(F.count(F.lit(1)).alias("n_effects"), under(alpha).alias("n_significant"), under(alpha / F.col("m")).alias("n_bonferroni"), bh.alias("n_bh"), stop.alias("n_stop_first"), F.coalesce(F.avg("effect"), F.lit(0.0)).alias("mean_effect"))


def permuted_conditions(conditions: DataFrame, runs: int) -> DataFrame:
    """run (from 1), heading_key, entity, value: each run deals a heading's values anew, in the order of an md5.

    Rows and shuffled rows are numbered over all ranges in order of their heading, so no task holds a heading.
    """
    rows = conditions.select("heading_key", "entity", "value")
    placed = running_total(rows, ["heading_key", "entity", "value"], F.lit(1), "at").withColumn("at", F.col("at").cast("long"))
    total = rows.count()
    many = placed.select("heading_key", "at").join(F.broadcast(rows.sparkSession.range(1, runs + 1).select(F.col("id").alias("run"))))
    mixed = running_total(many.withColumn("key", shuffled(F.col("run"), F.col("at"))), ["run", "heading_key", "key", "at"], F.lit(1), "place")
    given = mixed.select("run", F.col("at").alias("from_at"), (F.col("place") - (F.col("run") - 1) * total).cast("long").alias("at"))
    dealt = given.join(placed.select("at", "heading_key", "entity"), "at")
    return dealt.join(placed.select(F.col("at").alias("from_at"), "value"), "from_at").select("run", "heading_key", "entity", "value")


def null_effects(seq: DataFrame, conditions: DataFrame, runs: int = 100, least: int = D.MIN_GROUP, alpha: float = 0.05) -> DataFrame:
    """run, n_effects, n_significant, mean_effect when the values of each heading are shuffled; all runs in one plan."""
    many = permuted_conditions(conditions, runs).withColumn("heading_key", F.concat_ws("\n", F.col("run").cast("string"), "heading_key")).drop("run")
    found = group_effects(seq, many, least).withColumn("run", F.substring_index("heading_key", "\n", 1).cast("long"))
    per = found.groupBy("run").agg(F.count(F.lit(1)).alias("n_effects"), F.count_if(F.col("p_value") < alpha).alias("n_significant"), F.avg("effect").alias("mean_effect"))
    every = seq.sparkSession.range(1, runs + 1).select(F.col("id").alias("run"))
    return every.join(per, "run", "left").select("run", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_effects", "n_significant")], "mean_effect")


def null_summary(null: DataFrame) -> DataFrame:
    """Mean, deviation, largest and upper percentiles of the significant effects of the runs."""
    x = F.col("n_significant")
    return null.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.max(x).alias("most"), F.percentile(x, F.lit(0.95)).alias("p95"), F.percentile(x, F.lit(0.99)).alias("p99"))


def sequence_of(events: DataFrame, labels: DataFrame) -> DataFrame:
    """entity, pos, state of events (id, entity, pos) with clusters (id, cluster) as states."""
    return events.join(labels, "id").select("entity", "pos", F.col("cluster").cast("string").alias("state"))


def effect_rate(seq: DataFrame, conditions: DataFrame) -> float:
    """Share of the groups of the least size or more that pass the quick look."""
    row = D.quick_significance(seq, conditions).where(F.col("n") >= D.MIN_GROUP).agg(F.avg(F.col("passes").cast("int"))).first()
    return float(row[0] or 0.0)


def validated_search(events: DataFrame, conditions: DataFrame, ks: range, runs: int = 100, share: float = 0.5, seed: int = 42) -> dict[str, DataFrame]:
    """The k chosen on one part of the entities, and its effects on the other part, which had no say in it.

    ``events`` has id, entity, pos and v. Tables: scores (k, silhouette, rate, score), effects, totals (with Bonferroni and
    Benjamini-Hochberg), null (per run) and null_summary. Runs shuffle attributes under one clustering of the second part.
    """
    parts = split_entities(events, share, seed).persist()
    one, other = (of_part(events, parts, p).persist() for p in (0, 1))
    known = of_part(conditions, parts, 0)
    rows = []
    for k, silhouette, _ in k_scores(one, ks, seed).orderBy("k").collect():
        rate = effect_rate(sequence_of(one, kmeans_labels(one.select("id", "v"), k, seed)), known) if silhouette >= LEAST_SILHOUETTE else 0.0
        rows.append((k, silhouette, rate, SILHOUETTE_WEIGHT * silhouette + EFFECT_WEIGHT * rate if silhouette >= LEAST_SILHOUETTE else 0.0))
    spark = events.sparkSession
    chosen = best_of({k: score for k, _, _, score in rows})
    seq = sequence_of(other, kmeans_labels(other.select("id", "v"), chosen, seed)).persist()
    rest = of_part(conditions, parts, 1)
    effects, null = group_effects(seq, rest), null_effects(seq, rest, runs)
    return {
        "scores": spark.createDataFrame(rows, "k long, silhouette double, rate double, score double").withColumn("chosen", F.col("k") == chosen),
        "effects": effects,
        "totals": corrected(effects),
        "null": null,
        "null_summary": null_summary(null),
    }
