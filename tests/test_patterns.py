"""Frequent patterns counted in the map stage, against brute force."""

import itertools

import numpy as np

from chainlake.operators import patterns


def contains(seq, pattern):
    it = iter(seq)
    return all(x in it for x in pattern)


def table(spark, seqs):
    return spark.createDataFrame([(e, i + 1, s) for e, x in seqs.items() for i, s in enumerate(x)], "entity long, pos long, state string")


def shuffled_rows(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_frequent_patterns_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    seqs = {i: [["a", "b", "c", None, "rare%d" % i][x] for x in rng.choice(5, rng.integers(1, 12), p=[0.3, 0.3, 0.2, 0.15, 0.05])] for i in range(40)}
    least = int(0.15 * len(seqs))
    want = {p: n for size in range(1, 5) for p in itertools.product(["a", "b", "c", None], repeat=size) if (n := sum(contains(v, p) for v in seqs.values())) >= least}
    for dense in (1 << 22, 0):
        monkeypatch.setattr(patterns, "DENSE", dense)
        got = {tuple(r["pattern"]): r["n_sequences"] for r in patterns.frequent_subsequences(table(spark, seqs), 0.15, 4, 1).collect()}
        assert got == want
    assert patterns.frequent_subsequences(table(spark, {})).count() == 0
    assert {tuple(r["pattern"]) for r in patterns.frequent_subsequences(table(spark, {1: ["x"]}), 0.5, 3, 1).collect()} == {("x",)}


def test_no_row_for_each_sequence_and_pattern(spark):
    rng = np.random.default_rng(2)
    df = table(spark, {i: ["abcd"[x] for x in rng.integers(0, 4, 30)] for i in range(200)}).persist()
    rows = []
    for longest in (2, 4):
        before = shuffled_rows(spark)
        assert patterns.frequent_subsequences(df, 0.1, longest).count() == sum(4**i for i in range(2, longest + 1))
        rows.append(shuffled_rows(spark) - before)
    assert rows[1] - rows[0] < 8 * (4**3 + 4**4) + 100
