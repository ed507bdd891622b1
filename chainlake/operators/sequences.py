"""Sequences of states: long tables (entity, pos, state[, age]) and what is read off adjacent positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, entity: str, *order: str) -> DataFrame:
    """``pos``, from 1, in the given order within the entity."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(entity).orderBy(*order)).cast("long"))


def in_order(*by: str) -> Window:
    return Window.partitionBy(*(by or ("entity",))).orderBy("pos")


def adjacent(seq: DataFrame, *by: str) -> DataFrame:
    """from_state, to_state of each two neighbours, with the partition columns (``entity`` if none is named)."""
    keys = by or ("entity",)
    pairs = seq.select(*keys, F.col("state").alias("from_state"), F.lead("state").over(in_order(*keys)).alias("to_state"))
    return pairs.where(F.col("to_state").isNotNull())


def adjacent_sliced(seq: DataFrame, width: int) -> DataFrame:
    """Like :func:`adjacent` for entities too long for one task: slices of ``width`` positions, stitched at their ends.

    Only the first state of each slice is shuffled a second time, so a hot entity costs as many tasks as it has slices.
    ``pos`` must have been assigned at the scan.
    """
    cut = seq.withColumn("slice", F.floor((F.col("pos") - 1) / width))
    inside = cut.select("entity", "slice", F.col("state").alias("from_state"), F.lead("state").over(in_order("entity", "slice")).alias("to_state")).where("to_state IS NOT NULL")
    ends = cut.groupBy("entity", "slice").agg(F.max_by("state", "pos").alias("from_state"), F.min_by("state", "pos").alias("head"))
    heads = ends.select("entity", (F.col("slice") - 1).alias("slice"), F.col("head").alias("to_state"))
    seams = ends.select("entity", "slice", "from_state").join(heads, ["entity", "slice"])
    return inside.select("entity", "from_state", "to_state").unionByName(seams.select("entity", "from_state", "to_state"))


def assembled(seq: DataFrame) -> DataFrame:
    """entity, states (ordered array), n."""
    rows = seq.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("pos", "state"))).alias("rows"))
    return rows.select("entity", F.col("rows.state").alias("states"), F.size("rows").cast("long").alias("n"))


def ngrams(seq: DataFrame, n: int) -> DataFrame:
    """entity, gram: all runs of n neighbours, by ``lead`` so that no array of a whole sequence is built."""
    w = in_order()
    parts = [F.col("state"), *[F.lead("state", i).over(w) for i in range(1, n)]]
    return seq.select("entity", F.array(*parts).alias("gram"), parts[-1].alias("last")).where(F.col("last").isNotNull()).select("entity", "gram")


def contains_pattern(states: Column, pattern: Column) -> Column:
    """Order-preserving containment with gaps, greedy from the left; the empty pattern is in every sequence."""
    walked = F.aggregate(states, F.lit(0), lambda p, s: F.when((p < F.size(pattern)) & (s == F.get(pattern, p)), p + 1).otherwise(p))
    return walked == F.size(pattern)


def state_codes(seq: DataFrame) -> DataFrame:
    """state, code: codes from 0 in ascending order of states."""
    return seq.select("state").distinct().withColumn("code", F.dense_rank().over(Window.orderBy("state")) - 1)


def time_steps(seq_arrays: DataFrame, steps: int = 5) -> DataFrame:
    """entity, step, state at ``steps`` evenly spaced places (whole-number part) of sequences that are long enough."""
    long_enough = seq_arrays.where(F.size("states") >= steps)
    at = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda t: F.struct(t.alias("step"), F.get("states", (t * (F.size("states") - 1) / (steps - 1)).cast("int")).alias("state")))
    return long_enough.select("entity", F.explode(at).alias("x")).select("entity", "x.step", "x.state")


def half_split(seq: DataFrame) -> DataFrame:
    """Adds n and early (the first n // 2 positions)."""
    n = F.count(F.lit(1)).over(Window.partitionBy("entity"))
    return seq.withColumn("n", n).withColumn("early", F.col("pos") <= F.floor(F.col("n") / 2))


def running_total(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each, in the order of the columns ``order``.

    Ranges of the order are dealt to tasks; each sums its own, and the ranges' totals, one row each, are summed on the
    driver. No task sees all rows. The dealt rows are persisted, as the bounds of ranges are drawn anew by each plan.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.withColumn("own_value", value).repartitionByRange(n, *order).withColumn("own_range", F.spark_partition_id()).persist()
    totals = {r["own_range"]: r["n"] for r in dealt.groupBy("own_range").agg(F.sum("own_value").alias("n")).collect()}
    starts, at = [], 0
    for part in sorted(totals):
        starts.append((part, at))
        at += totals[part]
    first = spark.createDataFrame(starts, "own_range int, own_start long")
    before = Window.partitionBy("own_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("own_inside", F.coalesce(F.sum("own_value").over(before), F.lit(0)))
    return inside.join(first, "own_range").withColumn(name, F.col("own_start") + F.col("own_inside")).drop("own_value", "own_range", "own_start", "own_inside")


def diversity(seq: DataFrame) -> DataFrame:
    """entity, n, n_states, diversity: distinct states over states."""
    distinct = F.countDistinct("state")
    return seq.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), distinct.alias("n_states"), (distinct / F.count(F.lit(1))).alias("diversity"))


def pattern_frequency(seq: DataFrame, pattern: list[str]) -> DataFrame:
    """cnt, n_sequences of one run of neighbours."""
    wanted = F.array(*[F.lit(x) for x in pattern])
    return ngrams(seq, len(pattern)).where(F.col("gram") == wanted).agg(F.count(F.lit(1)).alias("cnt"), F.countDistinct("entity").alias("n_sequences"))


def relabelled(seq: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """entity, pos, state with the states of ``labels`` (key, label), joined by the event's key and never by its place.

    Events without a label keep none and go.
    """
    return seq.join(labels.select(key, F.col("label").cast("string").alias("new_state")), key).select("entity", "pos", F.col("new_state").alias("state"))


def split_entities(entities: DataFrame, share: float = 0.5, seed: int = 0) -> DataFrame:
    """entity, part (0 or 1): 0 for a share of the entities by the first digits of an md5, alike in every run and engine."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("entity").cast("string")).cast("binary")), 1, 4)
    return entities.select("entity").distinct().withColumn("part", (digits >= f"{int(65536 * share):04x}").cast("int"))


def of_part(df: DataFrame, parts: DataFrame, part: int) -> DataFrame:
    """The rows of ``df`` whose entity is in that part."""
    return df.join(parts.where(F.col("part") == part).select("entity"), "entity", "left_semi")
