"""Transitions by attribute: one aggregation for all (heading, value) groups, compared with the whole population."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlake.functions.special import chi2_counts, permutation_p
from chainlake.operators.markov import grid, stationary, transition_matrix
from chainlake.operators.sequences import adjacent

MIN_GROUP = 5


def condition_map(attributes: DataFrame, first: bool = False) -> DataFrame:
    """One value of each (heading_key, entity): the last by source_row, or the first."""
    pick = F.min_by if first else F.max_by
    return attributes.groupBy("heading_key", "entity").agg(pick("value", "source_row").alias("value"))


def assigned(entities: DataFrame, attributes: DataFrame) -> DataFrame:
    """A value for every entity and heading, ``Unknown`` where it has none. Headings are a small dimension."""
    headings = attributes.select("heading_key").distinct()
    known = condition_map(attributes)
    return entities.select("entity").distinct().join(headings).join(known, ["heading_key", "entity"], "left").withColumn("value", F.coalesce("value", F.lit("Unknown")))


def large_groups(conditions: DataFrame, least: int = MIN_GROUP) -> DataFrame:
    return conditions.groupBy("heading_key", "value").agg(F.countDistinct("entity").alias("n")).where(F.col("n") >= least)


def conditional_matrices(seq: DataFrame, conditions: DataFrame, least: int = MIN_GROUP) -> DataFrame:
    """heading_key, value, from_state, to_state, cnt, prob of the groups with ``least`` entities; empty rows uniform.

    Sequences are paired and counted per entity once; only those counts meet the attributes.
    """
    per_entity = adjacent(seq).groupBy("entity", "from_state", "to_state").agg(F.count(F.lit(1)).alias("c"))
    groups = large_groups(conditions, least)
    counts = conditions.join(per_entity, "entity").groupBy("heading_key", "value", "from_state", "to_state").agg(F.sum("c").alias("cnt"))
    keys = ["heading_key", "value"]
    full = grid(seq.select("state").distinct(), *keys, of=groups).join(counts, [*keys, "from_state", "to_state"], "left")
    w = Window.partitionBy(*keys, "from_state")
    total, k = F.sum("cnt").over(w), F.count(F.lit(1)).over(w)
    return full.select(*keys, "from_state", "to_state", F.coalesce("cnt", F.lit(0)).alias("cnt"), F.when(total > 0, F.coalesce("cnt", F.lit(0)) / total).otherwise(1.0 / k).alias("prob"))


def distances(groups: DataFrame, whole: DataFrame, *keys: str) -> DataFrame:
    """L1, total variation, Frobenius and Wasserstein-1 (of the sorted cells) between each group's matrix and the whole.

    One aggregation: a group holds as many cells as the states have pairs.
    """
    both = groups.join(whole.select("from_state", "to_state", F.col("prob").alias("q")), ["from_state", "to_state"])
    d = F.col("prob") - F.col("q")
    cells = lambda c: F.array_sort(F.collect_list(c)).alias(c)
    one = both.groupBy(*keys).agg(F.sum(F.abs(d)).alias("l1"), F.sqrt(F.sum(d * d)).alias("frobenius"), cells("prob"), cells("q"))
    gaps = F.aggregate(F.zip_with("prob", "q", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return one.select(*keys, "l1", (F.col("l1") / 2).alias("tv"), "frobenius", (gaps / F.size("prob")).alias("w1"))


def chi2_statistic(groups: DataFrame, whole: DataFrame, *keys: str, scale: int = 1000) -> DataFrame:
    """Pearson's statistic and degrees of freedom of truncated pseudo-counts; columns of zeros are left out."""
    both = groups.join(whole.select("from_state", "to_state", F.col("prob").alias("q")), ["from_state", "to_state"])
    cells = both.withColumn("a", (F.col("prob") * scale).cast("int")).withColumn("b", (F.col("q") * scale).cast("int")).where("a + b > 0")
    w = Window.partitionBy(*keys)
    cells = cells.withColumn("ra", F.sum("a").over(w)).withColumn("rb", F.sum("b").over(w))
    total = F.col("ra") + F.col("rb")
    ea, eb = F.col("ra") * (F.col("a") + F.col("b")) / total, F.col("rb") * (F.col("a") + F.col("b")) / total
    part = (F.col("a") - ea) ** 2 / ea + (F.col("b") - eb) ** 2 / eb
    return cells.groupBy(*keys).agg(F.sum(part).alias("chi2"), (F.count(F.lit(1)) - 1).alias("dof"))


def ks_statistic(groups: DataFrame, whole: DataFrame, *keys: str) -> DataFrame:
    """The largest difference of the two empirical distributions of matrix cells."""
    both = groups.join(whole.select("from_state", "to_state", F.col("prob").alias("q")), ["from_state", "to_state"])
    long = both.select(*keys, F.explode(F.array(F.struct(F.round("prob", 9).alias("v"), F.lit(1).alias("s")), F.struct(F.round("q", 9).alias("v"), F.lit(0).alias("s")))).alias("x")).select(*keys, "x.v", "x.s")
    steps = long.groupBy(*keys, "v").agg(F.sum("s").alias("a"), F.sum(1 - F.col("s")).alias("b"))
    w = Window.partitionBy(*keys)
    upto = w.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = F.abs(F.sum("a").over(upto) / F.sum("a").over(w) - F.sum("b").over(upto) / F.sum("b").over(w))
    return steps.withColumn("d", d).groupBy(*keys).agg(F.max("d").alias("ks"))


def insights(seq: DataFrame, conditions: DataFrame, threshold: float = 0.1, n_permutations: int = 1000) -> DataFrame:
    """heading_key, value, n, l1, tv, chi2, p values of each group's stationary distribution against the whole's.

    A group is kept if its L1 distance is over ``threshold`` or its permutation p is under 0.05. One task call sees
    one group's two k-vectors.
    """
    matrices = conditional_matrices(seq, conditions)
    own = stationary(matrices, "heading_key", "value")
    whole = stationary(transition_matrix(seq)).select("state", F.col("pi").alias("pi_all"))
    both = own.join(whole, "state").join(large_groups(conditions), ["heading_key", "value"])

    def test(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("state")
        a, b = block["pi"].to_numpy(), block["pi_all"].to_numpy()
        chi2, p = chi2_counts(a, b)
        l1 = float(np.abs(a - b).sum())
        return pd.DataFrame({"heading_key": block["heading_key"].iloc[:1], "value": block["value"].iloc[:1], "n": block["n"].iloc[:1], "l1": l1, "tv": l1 / 2, "chi2": chi2, "chi2_p": p, "permutation_p": permutation_p(a, b, n_permutations)})

    found = both.groupBy("heading_key", "value").applyInPandas(test, "heading_key string, value string, n long, l1 double, tv double, chi2 double, chi2_p double, permutation_p double")
    return found.where((F.col("l1") > threshold) | (F.col("permutation_p") < 0.05))


def quick_significance(seq: DataFrame, conditions: DataFrame, share: float = 0.5) -> DataFrame:
    """heading_key, value, n, n_sequences, n_states, passes: the group is neither small nor nearly all, and varied."""
    total = seq.agg(F.countDistinct("entity").alias("total"), F.countDistinct("state").alias("k"))
    found = conditions.join(seq.select("entity", "state"), "entity", "left").groupBy("heading_key", "value").agg(
        F.countDistinct("entity").alias("n"), F.countDistinct(F.when(F.col("state").isNotNull(), F.col("entity"))).alias("n_sequences"), F.countDistinct("state").alias("n_states")
    )
    ok = (F.col("n") >= MIN_GROUP) & (F.col("n") <= 0.8 * F.col("total")) & (F.col("n_sequences") >= 3) & (F.col("n_states") >= share * F.col("k"))
    return found.join(F.broadcast(total)).select("heading_key", "value", "n", "n_sequences", "n_states", ok.alias("passes"))
