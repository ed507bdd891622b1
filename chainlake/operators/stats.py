"""Inference: draws by integer arithmetic that any engine can repeat, bootstrap, corrections, rank tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlake.operators.sequences import adjacent, running_total


def draw(rep: Column, slot: Column, n: Column) -> Column:
    """A number in 0..n-1 from a linear congruence of the replicate and the slot."""
    x = F.pmod((rep * 1000003 + slot) * 1103515245 + 12345, F.lit(2147483648))
    return F.pmod(F.floor(x / 65536), n)


def indexed(entities: DataFrame) -> DataFrame:
    """entity, k: consecutive numbers in order of entity, dealt out by range so that no task sorts all."""
    return running_total(entities.select("entity").distinct(), ["entity"], F.lit(1), "k").select("entity", F.col("k").cast("long").alias("k"))


def draws(spark: SparkSession, reps: int, n: int) -> DataFrame:
    """rep, k, weight: how often each of n items is drawn in each replicate of n draws with replacement."""
    slots = spark.range(reps * n).select(F.floor(F.col("id") / n).alias("rep"), F.pmod("id", F.lit(n)).alias("slot"))
    return slots.select("rep", draw(F.col("rep"), F.col("slot"), F.lit(n)).alias("k")).groupBy("rep", "k").agg(F.count(F.lit(1)).alias("weight"))


def bootstrap_matrix(seq: DataFrame, reps: int, level: float = 0.95) -> DataFrame:
    """from_state, to_state, mean_prob, low, high over replicates that draw entities; rows without an exit are absent."""
    index = indexed(seq)
    n = index.count()
    counts = adjacent(seq).join(index, "entity").groupBy("k", "from_state", "to_state").agg(F.count(F.lit(1)).alias("c"))
    drawn = draws(seq.sparkSession, reps, n).join(counts, "k").groupBy("rep", "from_state", "to_state").agg(F.sum(F.col("weight") * F.col("c")).alias("c"))
    p = drawn.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("rep", "from_state")))
    tail = (1 - level) / 2
    return p.groupBy("from_state", "to_state").agg(F.avg("p").alias("mean_prob"), F.percentile("p", F.lit(tail)).alias("low"), F.percentile("p", F.lit(1 - tail)).alias("high"))


def adjusted(p_values: DataFrame, alpha: float = 0.05) -> DataFrame:
    """id, p, rank, bh, bonferroni, stop_first: Benjamini-Hochberg and Bonferroni adjusted p values.

    ``stop_first`` holds for ranks before the first that fails its BH line, which may reject fewer than BH itself.
    The family is a result table of tests, so one window over all of it is small.
    """
    w = Window.orderBy("p", "id")
    m = F.count(F.lit(1)).over(Window.partitionBy())
    r = p_values.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("m", m)
    onward = Window.orderBy("rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return r.select(
        "id",
        "p",
        "rank",
        F.least(F.lit(1.0), F.min(F.col("p") * F.col("m") / F.col("rank")).over(onward)).alias("bh"),
        F.least(F.lit(1.0), F.col("p") * F.col("m")).alias("bonferroni"),
        F.bool_and(F.col("p") <= F.col("rank") / F.col("m") * alpha).over(upto).alias("stop_first"),
    )


def kruskal_h(df: DataFrame, group: str, value: str) -> DataFrame:
    """h, n, k: the Kruskal-Wallis statistic without tie correction, on average ranks.

    Values are counted first, so ranks come from running sums over distinct values.
    """
    counts = running_total(df.groupBy(value).agg(F.count(F.lit(1)).alias("c")), [value], F.col("c"), "before")
    ranks = counts.select(value, (F.col("before") + (F.col("c") + 1) / 2).alias("rank"))
    sums = df.join(ranks, value).groupBy(group).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n_group"))
    total = sums.agg(F.sum("n_group").cast("double").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n_group")).alias("s"), F.count(F.lit(1)).alias("k"))
    return total.select((12.0 / (F.col("n") * (F.col("n") + 1)) * F.col("s") - 3 * (F.col("n") + 1)).alias("h"), F.col("n").cast("long").alias("n"), "k")


def folds(entities: DataFrame, k: int = 5) -> DataFrame:
    """entity, fold by a congruence of the entity's number."""
    return indexed(entities).select("entity", draw(F.lit(0).cast("long"), F.col("k"), F.lit(k)).alias("fold"))
