"""Searches against plain Python and numpy."""

import numpy as np

from chainlake.functions.special import chi2_counts
from chainlake.operators import search as H


def test_strategies():
    seen = []

    def score(k):
        seen.append(k)
        return {3: 0.2, 4: 0.5, 5: 0.5, 6: 0.4, 7: 0.1, 8: 0.9}[k]

    assert H.patient(score, range(3, 9), 3) == {3: 0.2, 4: 0.5, 5: 0.5, 6: 0.4, 7: 0.1}
    assert seen == [3, 4, 5, 6, 7] and H.best_of({3: 0.1, 4: 0.5, 5: 0.5}) == 4
    assert H.screened(lambda k: -k, score, range(3, 9), 2) == {3: 0.2, 4: 0.5}
    assert len(H.spread(score, range(3, 9), 2, 2)) == 4 and set(H.spread(score, range(3, 9), 3, 9)) == set(range(3, 9))


def test_methods_share_evaluations(spark):
    calls = []

    def score(k):
        calls.append(k)
        return -abs(k - 5.0)

    got = H.compared({"a": lambda f: H.patient(f, range(3, 9)), "b": lambda f: H.screened(f, f, range(3, 9))}, score, spark).collect()
    assert [(r["method"], r["k"]) for r in got] == [("a", 5), ("b", 5)] and sorted(calls) == [3, 4, 5, 6, 7, 8]


def matrix(seqs, states):
    at = {s: i for i, s in enumerate(states)}
    m = np.zeros((len(states),) * 2)
    for s in seqs:
        for a, b in zip(s, s[1:]):
            m[at[a], at[b]] += 1
    total = m.sum(axis=1, keepdims=True)
    return np.where(total > 0, m / np.maximum(total, 1), 1 / len(states))


def history(seed=4, n=60):
    rng = np.random.default_rng(seed)
    seqs = {e: [str(x) for x in rng.choice(3, 9, p=[0.7, 0.2, 0.1] if e % 2 else [0.1, 0.3, 0.6])] for e in range(n)}
    return seqs, {e: "odd" if e % 2 else "even" for e in seqs}


def frames(spark, seqs, value):
    seq = spark.createDataFrame([(e, i + 1, s) for e, x in seqs.items() for i, s in enumerate(x)], "entity long, pos long, state string")
    rows = [(h, e, v) for e, v in value.items() for h, v in (("half", v), ("few", str(e // 3)), ("same", "x"))]
    return seq, spark.createDataFrame(rows, "heading_key string, entity long, value string")


def test_group_effects_and_totals(spark):
    seqs, value = history()
    seq, conditions = frames(spark, seqs, value)
    got = {(r["heading_key"], r["value"]): r for r in H.group_effects(seq, conditions).collect()}
    assert set(got) == {("half", "odd"), ("half", "even"), ("same", "x")}
    whole = matrix(seqs.values(), "012")
    for (heading, name), r in got.items():
        m = matrix([s for e, s in seqs.items() if heading == "same" or value[e] == name], "012")
        assert abs(r["effect"] - np.sqrt(((m - whole) ** 2).sum())) < 1e-9
        assert abs(r["p_value"] - chi2_counts(m.ravel(), whole.ravel(), 100)[1]) < 1e-9
    p = [0.001, 0.03, 0.02, 0.9, 0.041]
    effects = spark.createDataFrame([("h", str(i), 1.0, x) for i, x in enumerate(p)], "heading_key string, value string, effect double, p_value double")
    r = H.corrected(effects).first()
    assert (r["n_effects"], r["n_significant"], r["n_bonferroni"], r["n_bh"], r["n_stop_first"]) == (5, 4, 1, 3, 3)
    assert H.corrected(effects.limit(0)).first()["n_effects"] == 0


def test_shuffled_conditions_keep_their_headings(spark):
    seqs, value = history()
    seq, conditions = frames(spark, seqs, value)
    runs = {}
    for r in H.permuted_conditions(conditions, 3).collect():
        runs.setdefault((r["run"], r["heading_key"]), {})[r["entity"]] = r["value"]
    assert len(runs) == 9
    for (_, heading), given in runs.items():
        want = {r["entity"]: r["value"] for r in conditions.where(conditions.heading_key == heading).collect()}
        assert given.keys() == want.keys() and sorted(given.values()) == sorted(want.values())
    half = [runs[i, "half"] for i in (1, 2, 3)]
    assert half[0] != half[1] != half[2] and all(x != value for x in half)
    seen = H.corrected(H.group_effects(seq, conditions)).first()["n_significant"]
    null = H.null_effects(seq, conditions, 6)
    assert {r["run"]: r["n_effects"] for r in null.collect()} == dict.fromkeys(range(1, 7), 3)
    assert seen == 2 and H.null_summary(null).first()["mean"] < seen
    assert [r["n_effects"] for r in H.null_effects(seq, conditions.limit(0), 2).collect()] == [0, 0]


def test_validated_search(spark):
    seqs, value = history(6, 80)
    _, conditions = frames(spark, seqs, value)
    rng = np.random.default_rng(9)
    rows = [(e * 100 + i, e, i + 1, [float(x) for x in 9 * np.eye(3)[int(s)] + rng.normal(0, 0.1, 3)]) for e, x in seqs.items() for i, s in enumerate(x)]
    found = H.validated_search(spark.createDataFrame(rows, "id long, entity long, pos long, v array<double>"), conditions, range(2, 5), runs=4)
    scores = found["scores"].collect()
    assert [r["k"] for r in scores if r["chosen"]] == [3] and len(scores) == 3
    assert {(r["heading_key"], r["value"]) for r in found["effects"].collect()} == {("half", "odd"), ("half", "even"), ("same", "x")}
    assert found["totals"].first()["n_significant"] == 2 and found["null"].count() == 4
