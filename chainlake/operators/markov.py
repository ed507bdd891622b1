"""Markov operators over adjacent states: dense transition matrices in long form, entropy, higher orders, windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlake.operators.sequences import adjacent, ngrams


def grid(states: DataFrame, *groups: str, of: DataFrame | None = None) -> DataFrame:
    """All (from_state, to_state), for each group if any; states are few, so the grid is k x k."""
    a = states.select(F.col("state").alias("from_state"))
    b = states.select(F.col("state").alias("to_state"))
    pairs = a.join(b)
    return of.select(*groups).distinct().join(pairs) if groups else pairs


def transition_matrix(seq: DataFrame, *groups: str, zero_rows: bool = False) -> DataFrame:
    """from_state, to_state, cnt, prob over all observed states, for each group.

    A state without an exit has probability 1/k everywhere, or 0 with ``zero_rows``. All groups are counted in one
    aggregation with partial counts before the shuffle.
    """
    states = seq.select("state").distinct()
    keys = [*groups, "entity"]
    counts = adjacent(seq, *keys).groupBy(*groups, "from_state", "to_state").agg(F.count(F.lit(1)).alias("cnt"))
    full = grid(states, *groups, of=seq if groups else None).join(counts, [*groups, "from_state", "to_state"], "left")
    total = F.sum("cnt").over(Window.partitionBy(*groups, "from_state"))
    k = F.count(F.lit(1)).over(Window.partitionBy(*groups, "from_state"))
    empty = F.lit(0.0) if zero_rows else 1.0 / k
    return full.select(*groups, "from_state", "to_state", F.coalesce("cnt", F.lit(0)).alias("cnt"), F.when(total > 0, F.coalesce("cnt", F.lit(0)) / total).otherwise(empty).alias("prob"))


def _plogp(p):
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)


def entropy_total(matrix: DataFrame) -> DataFrame:
    return matrix.agg(F.sum(_plogp(F.col("prob"))).alias("entropy"))


def entropy_row_mean(matrix: DataFrame) -> DataFrame:
    """Mean over rows of the entropy with 1e-10 added to each probability."""
    p = F.col("prob") + 1e-10
    rows = matrix.groupBy("from_state").agg(F.sum(-p * F.log2(p)).alias("h"))
    return rows.agg(F.avg("h").alias("entropy"))


def stationary(matrix: DataFrame, *groups: str) -> DataFrame:
    """state, pi for each group: the left eigenvector at the eigenvalue nearest 1, normalised by absolute values.

    A group's block is k x k, so one group is one small numpy call.
    """

    def solve(block: pd.DataFrame) -> pd.DataFrame:
        p = block.pivot(index="from_state", columns="to_state", values="prob").sort_index().sort_index(axis=1)
        values, vectors = np.linalg.eig(p.to_numpy().T)
        v = np.abs(np.real(vectors[:, np.argmin(np.abs(values - 1))]))
        out = pd.DataFrame({"state": p.index, "pi": v / v.sum()})
        for g in groups:
            out[g] = block[g].iloc[0]
        return out

    kinds = dict(matrix.dtypes)
    schema = ", ".join([f"state {kinds['from_state']}", "pi double", *[f"`{g}` {kinds[g]}" for g in groups]])
    keyed = matrix if groups else matrix.withColumn("all", F.lit(1))
    return keyed.groupBy(*(groups or ("all",))).applyInPandas(solve, schema)


def higher_order(seq: DataFrame, order: int = 2) -> DataFrame:
    """ctx (array of ``order`` states), next, cnt, prob of the observed contexts."""
    grams = ngrams(seq, order + 1).groupBy("gram").agg(F.count(F.lit(1)).alias("cnt"))
    split = grams.select(F.slice("gram", 1, order).alias("ctx"), F.element_at("gram", -1).alias("next"), "cnt")
    return split.withColumn("prob", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("ctx")))


def predict_next(chain: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` likeliest next states of each context; ties by state. Unseen contexts have none."""
    rank = F.row_number().over(Window.partitionBy("ctx").orderBy(F.desc("prob"), "next"))
    return chain.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)


def common_patterns(chain: DataFrame, least: int = 5, top: int = 10) -> DataFrame:
    found = chain.select(F.concat("ctx", F.array("next")).alias("pattern"), "cnt").where(F.col("cnt") >= least)
    return found.orderBy(F.desc("cnt"), F.array_join("pattern", ">")).limit(top)


def critical_patterns(seq: DataFrame, order: int = 3, support: float = 0.05) -> DataFrame:
    """Runs whose total occurrences reach int(support * sequences): occurrences, sequences that hold them, support."""
    n = seq.select(F.countDistinct("entity").alias("n_entities"))
    found = ngrams(seq, order).groupBy("gram").agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct("entity").alias("n_sequences"))
    return found.join(n).where(F.col("occurrences") >= F.floor(F.lit(support) * F.col("n_entities"))).select("gram", "occurrences", "n_sequences", (F.col("n_sequences") / F.col("n_entities")).alias("support"))


def window_bounds(seq: DataFrame, windows: int = 4) -> DataFrame:
    """window_id (from 0), start, end: quantiles of age, linearly interpolated."""
    q = seq.agg(F.percentile("age", F.array(*[F.lit(i / windows) for i in range(windows + 1)])).alias("q"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: F.struct(i.cast("long").alias("window_id"), F.get("q", i).alias("start"), F.get("q", i + 1).alias("end")))
    return q.select(F.explode(rows).alias("w")).select("w.*")


def window_matrices(seq: DataFrame, windows: int = 4) -> DataFrame:
    """A matrix for each window, closed at both ends; events are filtered first and then paired, bridging gaps."""
    bounds = window_bounds(seq, windows)
    inside = seq.join(F.broadcast(bounds), F.col("age").between(F.col("start"), F.col("end"))).select("window_id", "entity", "pos", "state")
    return transition_matrix(inside, "window_id", zero_rows=True)


def window_changes(matrices: DataFrame) -> DataFrame:
    """For each window and the next: Frobenius norm, largest change, number of changes over 0.1."""
    a = matrices.select("window_id", "from_state", "to_state", F.col("prob").alias("p"))
    b = matrices.select((F.col("window_id") - 1).alias("window_id"), "from_state", "to_state", F.col("prob").alias("q"))
    d = F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))
    both = a.join(b, ["window_id", "from_state", "to_state"]).withColumn("d", d)
    return both.groupBy("window_id").agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("frobenius"), F.max("d").alias("max_change"), F.count_if(F.col("d") > 0.1).alias("n_changed"))


def simulate(matrix: DataFrame, start: str, length: int, seed: int = 0) -> list[str]:
    """A walk over a k x k matrix, reproducible from the seed."""
    rows: dict[str, list[tuple[str, float]]] = {}
    for r in matrix.orderBy("from_state", "to_state").collect():
        rows.setdefault(r["from_state"], []).append((r["to_state"], r["prob"]))
    rng, out = np.random.default_rng(seed), [start]
    while len(out) < length:
        nxt, p = zip(*rows[out[-1]], strict=True)
        total = sum(p)
        out.append(nxt[rng.choice(len(nxt), p=[x / total for x in p])] if total > 0 else out[-1])
    return out


def irreducible(matrix: DataFrame) -> bool:
    """Whether every state reaches every other, by squaring the k x k reachability matrix."""
    p = matrix.toPandas().pivot(index="from_state", columns="to_state", values="prob").to_numpy()
    reach = (p > 0) | np.eye(len(p), dtype=bool)
    for _ in range(int(np.ceil(np.log2(max(2, len(p)))))):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    return bool(reach.all())


def entity_matrices(seq: DataFrame) -> DataFrame:
    """entity, cells: each entity's flattened matrix (rows without an exit uniform), in order of (from, to)."""
    rows = transition_matrix(seq.withColumn("who", F.col("entity")), "who")
    return rows.groupBy(F.col("who").alias("entity")).agg(F.array_sort(F.collect_list(F.struct("from_state", "to_state", "prob"))).alias("m")).select("entity", F.col("m.prob").alias("cells"))


def last_states(seq: DataFrame, order: int) -> DataFrame:
    """entity, ctx: the last ``order`` states, for prediction."""
    back = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("pos")))
    tail = seq.withColumn("back", back).where(F.col("back") <= order)
    return tail.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("pos", "state"))).alias("t")).where(F.size("t") == order).select("entity", F.col("t.state").alias("ctx"))


def window_of(bounds: DataFrame, age: float) -> DataFrame:
    """The first window that holds an age (both ends count)."""
    return bounds.where(F.lit(age).between(F.col("start"), F.col("end"))).agg(F.min("window_id").alias("window_id"))


def matrix_at(seq: DataFrame, age: float, windows: int = 4) -> DataFrame:
    """The matrix of the first window that holds an age; empty if none does."""
    return window_matrices(seq, windows).join(window_of(window_bounds(seq, windows), age), "window_id")
