"""Change points, life phases, frequent subsequences and association rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlake.operators.sequences import assembled, running_total

INFINITE = 1e308


def prefix_counts(seq: DataFrame) -> DataFrame:
    """entity, cut, n, state, before, after: how often each state stands before and from each cut on (cut = length before).

    Running sums over one-hot rows; states are few, so each position gives k rows.
    """
    states = seq.select(F.col("state").alias("s")).distinct()
    hot = seq.join(states).select("entity", "pos", "s", (F.col("state") == F.col("s")).cast("long").alias("hit"))
    w = Window.partitionBy("entity", "s")
    before = F.coalesce(F.sum("hit").over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return hot.select("entity", (F.col("pos") - 1).alias("cut"), F.count(F.lit(1)).over(w).alias("n"), F.col("s").alias("state"), before.alias("before"), (F.sum("hit").over(w) - before).alias("after"))


def kl_change_points(seq: DataFrame, min_segment: int = 3, most: int = 5) -> DataFrame:
    """entity, cut, divergence: the ``most`` cuts with the largest KL divergence of before from after (natural log).

    Cuts leave ``min_segment`` states on the left and more than that on the right is not asked: cut < n - min_segment.
    A state lost after the cut makes the divergence infinite, given as 1e308. Ties go to the smaller cut.
    """
    c = prefix_counts(seq).where((F.col("cut") >= min_segment) & (F.col("cut") < F.col("n") - min_segment))
    p, q = F.col("before") / F.col("cut"), F.col("after") / (F.col("n") - F.col("cut"))
    term = F.when(F.col("before") == 0, F.lit(0.0)).when(F.col("after") == 0, F.lit(None)).otherwise(p * F.ln(p / q))
    lost = F.max((F.col("before") > 0) & (F.col("after") == 0))
    scored = c.groupBy("entity", "cut", "n").agg(F.when(lost, F.lit(INFINITE)).otherwise(F.sum(term)).alias("divergence"))
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc(F.round("divergence", 9)), "cut"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def change_point_events(seq: DataFrame, cuts: DataFrame) -> DataFrame:
    """state_before, state_after, n of the states on both sides of the cuts, and the mean normalised cut."""
    left = seq.select("entity", F.col("pos").alias("cut"), F.col("state").alias("state_before"))
    right = seq.select("entity", (F.col("pos") - 1).alias("cut"), F.col("state").alias("state_after"))
    found = cuts.join(left, ["entity", "cut"]).join(right, ["entity", "cut"])
    return found.groupBy("state_before", "state_after").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("cut") / F.col("n")).alias("mean_position"))


def chi2_change_points(seq: DataFrame, min_segment: int = 3, most: int = 5) -> DataFrame:
    """Cuts whose chi-squared between the windows on both sides is over the entity's 90th percentile; the first few.

    The window is max(min_segment, n // 10), different for each entity, so counts come from running sums: the count in
    a window is the difference of two prefixes. With two states the deviations are lessened by a half (Yates); cuts with
    one state on both sides have no statistic and are left out of the percentile.
    """
    c = prefix_counts(seq)
    w = F.greatest(F.lit(min_segment), F.floor(F.col("n") / 10))
    at = c.select("entity", "cut", "n", "state", "before", w.alias("w"))
    total = c.groupBy("entity", "state").agg(F.max(F.col("before") + F.col("after")).alias("total"), F.max("n").alias("n"))
    ends = at.select("entity", "state", "cut", "before").unionByName(total.select("entity", "state", F.col("n").alias("cut"), F.col("total").alias("before")))
    mid = at.where((F.col("cut") >= F.col("w")) & (F.col("cut") < F.col("n") - F.col("w")))
    lo = ends.select("entity", "state", F.col("cut").alias("lo"), F.col("before").alias("b_lo"))
    hi = ends.select("entity", "state", F.col("cut").alias("hi"), F.col("before").alias("b_hi"))
    both = mid.withColumn("lo", F.col("cut") - F.col("w")).withColumn("hi", F.col("cut") + F.col("w")).join(lo, ["entity", "state", "lo"]).join(hi, ["entity", "state", "hi"])
    both = both.select("entity", "cut", (F.col("before") - F.col("b_lo")).alias("left"), (F.col("b_hi") - F.col("before")).alias("right")).where("left + right > 0")
    # Both windows are of one size, so a state's expected count is the mean of the two.
    d, n = F.abs(F.col("left") - F.col("right")), F.col("left") + F.col("right")
    less = F.greatest(d - 1, F.lit(0))
    scored = both.groupBy("entity", "cut").agg(F.count(F.lit(1)).alias("states"), F.sum(d * d / n).alias("plain"), F.sum(less * less / n).alias("corrected"))
    scored = scored.where("states > 1").select("entity", "cut", F.when(F.col("states") == 2, F.col("corrected")).otherwise(F.col("plain")).alias("chi2"))
    limit = F.percentile("chi2", F.lit(0.9)).over(Window.partitionBy("entity"))
    rank = F.row_number().over(Window.partitionBy("entity").orderBy("cut"))
    return scored.withColumn("limit", limit).where(F.round("chi2", 9) > F.round("limit", 9)).withColumn("rank", rank).where(F.col("rank") <= most).select("entity", "cut", "chi2")


def binary_splits(x: np.ndarray, min_segment: int, most: int) -> list[tuple[int, float]]:
    """(cut, gain) of greedy splits of one series, ascending: always the best cut there is, up to ``most``.

    The gain is a segment's variance less those of its two parts, unweighted, so it may be negative. Of equal gains the
    first cut counts.
    """
    s, s2 = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    var = lambda a, b: (s2[b] - s2[a]) / (b - a) - ((s[b] - s[a]) / (b - a)) ** 2
    segments, cuts = [(0, len(x))], []
    while len(cuts) < most:
        best = None
        for a, b in sorted(segments):
            t = np.arange(a + min_segment, b - min_segment)
            if len(t):
                gain = np.round(var(a, b) - var(a, t) - var(t, b), 12)
                i = int(gain.argmax())
                if best is None or gain[i] > best[0]:
                    best = (float(gain[i]), int(t[i]), a, b)
        if best is None:
            break
        gain, t, a, b = best
        segments.remove((a, b))
        segments += [(a, t), (t, b)]
        cuts.append((t, gain))
    return sorted(cuts)


def binary_segmentation(seq: DataFrame, min_segment: int = 3, most: int = 5) -> DataFrame:
    """entity, cut, gain: ``binary_splits`` of each entity's state codes (from 0, in ascending order of states)."""

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        cuts = binary_splits(rows.sort_values("pos")["code"].to_numpy(float), min_segment, most)
        return pd.DataFrame({"entity": [rows["entity"].iloc[0]] * len(cuts), "cut": [t for t, _ in cuts], "gain": [g for _, g in cuts]}).astype({"cut": "int64", "gain": "float64"})

    code = F.dense_rank().over(Window.orderBy("state")) - 1
    codes = seq.select("state").distinct().withColumn("code", code)
    kind = dict(seq.dtypes)["entity"]
    return seq.join(codes, "state").select("entity", "pos", "code").groupBy("entity").applyInPandas(split, f"entity {kind}, cut long, gain double")


def phase_features(seq: DataFrame, strict: bool = False) -> DataFrame:
    """state, age, position and text length of every event.

    ``position`` is the event's number among all events of all entities, in order, over its sequence's length; with
    ``strict`` its number within its own sequence.
    """
    rows = seq.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("entity")))
    rows = rows.withColumn("k", F.col("pos") - 1) if strict else running_total(rows, ["entity", "pos"], F.lit(1), "k")
    return rows.select("entity", "pos", "state", F.col("age").cast("double").alias("age"), (F.col("k") / F.col("n")).alias("position"), F.length("state").cast("double").alias("text_length"))


def life_phases(seq: DataFrame, phases: int = 5, seed: int = 42, strict: bool = False) -> DataFrame:
    """phase (0 is the youngest), n, mean/min/max age, name and the most frequent states, by k-means on three features."""
    raw = VectorAssembler(inputCols=["age", "position", "text_length"], outputCol="raw").transform(phase_features(seq, strict))
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(raw).transform(raw)
    label = KMeans(k=phases, seed=seed, initSteps=5).fit(scaled).transform(scaled).select("state", "age", "prediction")
    stats = label.groupBy("prediction").agg(F.avg("age").alias("mean_age"), F.min("age").alias("min_age"), F.max("age").alias("max_age"), F.count(F.lit(1)).alias("n"))
    per_state = label.groupBy("prediction", "state").count()
    top = per_state.withColumn("r", F.row_number().over(Window.partitionBy("prediction").orderBy(F.desc("count"), "state"))).where("r <= 5").groupBy("prediction").agg(F.array_sort(F.collect_list(F.struct("r", "state"))).alias("t"))
    return stats.join(top, "prediction").select((F.row_number().over(Window.orderBy("mean_age")) - 1).alias("phase"), "n", "mean_age", "min_age", "max_age", phase_name(F.col("mean_age")).alias("name"), F.col("t.state").alias("top_states"))


def phase_name(age):
    return F.when(age < 12, "Early Childhood").when(age < 18, "Adolescence").when(age < 25, "Early Adulthood").when(age < 40, "Middle Adulthood").otherwise("Late Adulthood")


def next_places(codes: np.ndarray, kinds: int) -> np.ndarray:
    """(place, state): where after each place (0 is the start) a state stands first, from 1; 0 if it does not."""
    n = len(codes)
    at = np.full((n + 1, kinds), n + 1, dtype=np.int64)
    at[np.arange(n), codes] = np.arange(1, n + 1)
    at = np.minimum.accumulate(at[::-1], axis=0)[::-1]
    return np.where(at > n, 0, at)


#: Patterns of a level that a batch counts in one array; more are sorted.
DENSE = 1 << 22


def frequent_subsequences(seq: DataFrame, support: float = 0.1, longest: int = 5, shortest: int = 2) -> DataFrame:
    """pattern, n_sequences of the patterns (gaps allowed) of up to ``longest`` states in int(support * n) sequences.

    Level by level: a task walks the frequent patterns in each of its sequences, to the earliest place where each ends, and
    counts what comes next. What goes on is one row of a batch and pattern, none of a sequence and pattern. The frequent
    patterns are held on the driver, as those that come out are. A sequence, as codes of frequent states, is one row.
    """
    spark = seq.sparkSession
    n = seq.select("entity").distinct().count()
    least = max(int(support * n), 1)
    held = seq.select("entity", "state").distinct().groupBy("state").agg(F.count(F.lit(1)).alias("n_sequences")).where(F.col("n_sequences") >= least)
    single = [(r["state"], r["n_sequences"]) for r in held.orderBy("state").collect()]
    found = [([s], c) for s, c in single] if shortest <= 1 <= longest else []
    names, kinds = pa.array([s for s, _ in single], pa.string()), len(single)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = batch.column("states")
            codes = pc.index_in(states.flatten().cast(pa.string()), names)
            row = pc.list_parent_indices(states).to_numpy()[codes.is_valid().to_numpy(zero_copy_only=False)]
            starts = np.searchsorted(row, np.arange(len(states) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(starts), codes.drop_null())], ["codes"])

    whole = assembled(seq.where(F.col("entity").isNotNull()).select("entity", "pos", "state")).select("states")
    codes = whole.mapInArrow(coded, "codes array<int>").persist()
    # Of each level, patterns in order: which of the level before they go on from, and their last state.
    levels = [(np.zeros(kinds, np.int64), np.arange(kinds))]
    patterns = [[s] for s, _ in single]
    for _ in range(2, longest + 1):
        if not patterns:
            break

        def counts(batches: Iterator[pa.RecordBatch], levels: list = tuple(levels)) -> Iterator[pa.RecordBatch]:
            many = len(levels[-1][0]) * kinds
            for batch in batches:
                total, keys = np.zeros(many if many <= DENSE else 0, np.int64), []
                column = batch.column("codes")
                flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
                for i, j in zip(ends[:-1], ends[1:]):
                    own, mine = np.unique(flat[i:j], return_inverse=True)
                    if not len(own):
                        continue
                    after = next_places(mine, len(own))
                    column_of = np.full(kinds, -1)
                    column_of[own] = np.arange(len(own))
                    ends_at = np.zeros(1, np.int64)
                    held = np.ones(1, bool)
                    for before, state in levels:
                        there = held[before] & (column_of[state] >= 0)
                        place = np.zeros(len(before), np.int64)
                        place[there] = after[ends_at[before[there]], column_of[state[there]]]
                        ends_at, held = place, place > 0
                    alive = np.flatnonzero(held)
                    row, col = np.nonzero(after[ends_at[alive]])
                    key = alive[row] * kinds + own[col]
                    if many <= DENSE:
                        total[key] += 1
                    else:
                        keys.append(key)
                hit, c = (np.flatnonzero(total), total[total > 0]) if many <= DENSE else np.unique(np.concatenate([*keys, np.empty(0, np.int64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(c)], ["key", "c"])

        next_level = codes.mapInArrow(counts, "key long, c long").groupBy("key").agg(F.sum("c").alias("n_sequences")).where(F.col("n_sequences") >= least)
        rows = sorted((r["key"], r["n_sequences"]) for r in next_level.collect())
        key = np.array([k for k, _ in rows], dtype=np.int64)
        patterns = [[*patterns[k // kinds], names[k % kinds].as_py()] for k, _ in rows]
        levels.append((key // max(kinds, 1), key % max(kinds, 1)))
        found += [(p, c) for p, (_, c) in zip(patterns, rows)] if len(levels) >= shortest else []
    codes.unpersist()
    return spark.createDataFrame(found, "pattern array<string>, n_sequences long")


def association_rules(frequent: DataFrame, n: int, confidence: float = 0.5, strict: bool = False) -> DataFrame:
    """antecedent, consequent, support, confidence, lift of the splits of the frequent patterns of ``n`` sequences.

    By default the antecedent is counted among the sequences that hold the whole pattern, as the lift's base is too: both
    are then 1. With ``strict`` all sequences that hold the antecedent, or the consequent, count. These are frequent
    themselves, so ``frequent`` (of patterns from one state on) has their counts.
    """
    cut = frequent.where(F.size("pattern") > 1).select("pattern", "n_sequences", F.explode(F.sequence(F.lit(1), F.size("pattern") - 1)).alias("i"))
    rules = cut.select(F.slice("pattern", F.lit(1), F.col("i")).alias("antecedent"), F.expr("slice(pattern, i + 1, size(pattern) - i)").alias("consequent"), "n_sequences", (F.col("n_sequences") / n).alias("support"))
    if not strict:
        return rules.select("antecedent", "consequent", "support", F.lit(1.0).alias("confidence"), F.lit(1.0).alias("lift"))
    side = lambda name, c: frequent.select(F.col("pattern").alias(name), F.col("n_sequences").alias(c))
    both = rules.join(side("antecedent", "ca"), "antecedent").join(side("consequent", "cc"), "consequent")
    conf = F.col("n_sequences") / F.col("ca")
    return both.select("antecedent", "consequent", "support", conf.alias("confidence"), (conf / (F.col("cc") / n)).alias("lift")).where(F.col("confidence") >= confidence)
