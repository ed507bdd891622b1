"""Files to results and back: sources, matching, settings, the whole analysis, and operators by brute force."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainlake.functions import standardise
from chainlake.operators import ensembles, patterns, sequences, stats, validation
from chainlake.plans import pipeline
from chainlake.sources import files

EVENTS = {"A_2001": (15, 20, 25), "b": (18, 23, 28), "C": (16, 21, 26), "only_here": (1, 2)}
TEXTS = ("Born in the city", "Stole a car, was arrested", "Sent to prison for theft")


@pytest.fixture
def folders(tmp_path):
    events, attributes = tmp_path / "events", tmp_path / "attributes"
    events.mkdir()
    attributes.mkdir()
    for name, ages in EVENTS.items():
        (events / f"Type1_{name}.csv").write_text("Date,Age,Life Event\n" + "".join(f'{2000 + a},{a},"{t}"\n' for a, t in zip(ages, TEXTS, strict=False)))
    for name in ("A", "B", "C", "absent"):
        (attributes / f"Type2_{name}.csv").write_text(f"Heading,Value\nSex,Male\nPhysically abused?,{'Yes' if name < 'C' else 'No'}\n")
    return str(events), str(attributes)


def test_events_and_attributes(spark, folders):
    rows = files.read_events(spark, folders[0]).collect()
    assert Counter(r["entity_id"] for r in rows) == {k: len(v) for k, v in EVENTS.items()}
    assert sorted(r["age"] for r in rows if r["entity_id"] == "b") == [18, 23, 28]
    assert {r["text"] for r in rows} == set(TEXTS)
    long = files.read_attributes(spark, folders[1])
    assert long.count() == 8 and {r["heading_key"] for r in long.collect()} == {"sex", "physically abused"}


def test_matched_scan(spark, folders):
    events, attributes = files.read_matched(spark, *folders)
    assert {r["entity"] for r in events.collect()} == {"a", "b", "c"} == {r["entity"] for r in attributes.collect()}
    assert events.count() == 9


def test_results_round_trip(spark, tmp_path):
    seq = files.demo_events(spark)
    assert seq.orderBy("entity", "pos").collect() == files.demo_events(spark).orderBy("entity", "pos").collect()
    files.write_results({"events": seq}, str(tmp_path / "r"))
    back = files.read_results(spark, str(tmp_path / "r"), "events")["events"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, seq.collect()))
    files.write_partitioned(seq, str(tmp_path / "p"), "state")
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "p")).select(*seq.columns).collect())) == sorted(map(str, seq.collect()))
    files.write_json(seq, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == seq.count()
    assert "## events" in files.markdown({"events": seq}, 2) and files.output_paths("/x/")["markov"] == "/x/markov"


def test_analysis_from_files(spark, folders, tmp_path):
    config = pipeline.Config(k=2, min_group=1, match_only=True, output=str(tmp_path / "out"), vocabulary=20)
    tables = pipeline.analyse_files(spark, *folders, config)
    assert {"sequences", "transitions", "stationary", "conditional", "insights", "trajectories", "risk"} <= set(tables)
    assert tables["sequences"].count() == 3 and tables["trajectories"].count() == 3
    sums = tables["transitions"].groupBy("from_state").agg(F.sum("prob").alias("p")).collect()
    assert all(abs(r["p"] - 1) < 1e-9 for r in sums)
    back = files.read_results(spark, files.output_paths(config.output)["analysis"], "stationary")["stationary"]
    assert back.count() == tables["stationary"].count()
    assert "## transitions" in pipeline.report(tables)


def test_settings(spark, folders, tmp_path):
    events, attributes, config = pipeline.arguments(["in", "--attributes", "at", "--k", "0", "--redact", "--threshold", "0.2"])
    assert (events, attributes, config.k, config.redact, config.threshold) == ("in", "at", 0, True, 0.2)
    for bad in ({"k": 1}, {"order": 0}, {"threshold": 3}, {"k_min": 5, "k_max": 4}):
        with pytest.raises(ValueError):
            pipeline.Config(**bad)
    with pytest.raises(ValueError):
        pipeline.validated(spark, str(tmp_path), None, pipeline.Config())
    with pytest.raises(ValueError):
        pipeline.validated(spark, folders[0], None, pipeline.Config(match_only=True))
    pipeline.validated(spark, *folders, pipeline.Config())
    with pytest.raises(ValueError):
        pipeline.vectorize(spark.createDataFrame([(1, "x")], "id long, text string"), "other")


def test_temporal_report(spark):
    found = pipeline.temporal_report(files.demo_events(spark, 12, 12), 3)
    assert all(df.count() >= 0 for df in found.values()) and found["life_phases"].count() == 3 and found["patterns"].count() > 0


def brute_cuts(x, least, most):
    segments, cuts = [(0, len(x))], []
    for _ in range(most):
        best = None
        for a, b in sorted(segments):
            for t in range(least, b - a - least):
                part = x[a:b]
                gain = round(np.var(part) - np.var(part[:t]) - np.var(part[t:]), 12)
                if best is None or gain > best[0]:
                    best = (gain, a + t, (a, b))
        if best is None:
            break
        segments.remove(best[2])
        segments += [(best[2][0], best[1]), (best[1], best[2][1])]
        cuts.append(best[1])
    return sorted(cuts)


def test_binary_splits_equal_brute_force():
    rng = np.random.default_rng(2)
    for n in (1, 6, 7, 15, 40):
        for _ in range(6):
            x = rng.integers(0, 4, n).astype(float)
            assert [t for t, _ in patterns.binary_splits(x, 3, 5)] == brute_cuts(x, 3, 5)
    assert len(patterns.binary_splits(rng.integers(0, 4, 60).astype(float), 3, 5)) == 5


def contains(seq, pattern):
    it = iter(seq)
    return all(x in it for x in pattern)


def test_frequent_subsequences_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    seqs = {i: ["abcd"[x] for x in rng.integers(0, 4, rng.integers(2, 9))] for i in range(20)}
    df = spark.createDataFrame([(i, k + 1, s) for i, v in seqs.items() for k, s in enumerate(v)], "entity long, pos long, state string")
    least = max(int(0.2 * len(seqs)), 1)
    want = {p: n for size in range(2, 5) for p in itertools.product("abcd", repeat=size) if (n := sum(contains(v, p) for v in seqs.values())) >= least}
    frequent = patterns.frequent_subsequences(df, 0.2, 4, 1)
    assert {tuple(r["pattern"]): r["n_sequences"] for r in frequent.collect() if len(r["pattern"]) > 1} == want
    count = lambda p: sum(contains(v, p) for v in seqs.values())
    rules = {(tuple(r["antecedent"]), tuple(r["consequent"])): (round(r["confidence"], 9), round(r["lift"], 9)) for r in patterns.association_rules(frequent, 20, 0.5, strict=True).collect()}
    expected = {(p[:i], p[i:]): (round(n / count(p[:i]), 9), round(n / count(p[:i]) / (count(p[i:]) / 20), 9)) for p, n in want.items() for i in range(1, len(p)) if n / count(p[:i]) >= 0.5}
    assert rules == expected
    assert all(r["confidence"] == 1.0 for r in patterns.association_rules(frequent, 20).collect())


def test_chi2_with_two_states(spark):
    """Windows of size 3 in sequences of a and b alone: Yates' correction; windows of one state have no statistic."""
    states = "aaabbbababbbaaab" * 2
    df = spark.createDataFrame([(1, i + 1, s) for i, s in enumerate(states)], "entity long, pos long, state string")
    scores = {}
    for t in range(3, len(states) - 3):
        left, right = Counter(states[t - 3 : t]), Counter(states[t : t + 3])
        if len(left | right) > 1:
            e = {s: (left[s] + right[s]) / 2 for s in "ab"}
            scores[t] = sum(2 * max(abs(left[s] - e[s]) - 0.5, 0) ** 2 / e[s] for s in "ab")
    limit = np.percentile(list(scores.values()), 90)
    want = sorted(t for t, v in scores.items() if v > limit + 1e-9)[:5]
    assert sorted(r["cut"] for r in patterns.chi2_change_points(df).collect()) == want


def test_order_over_all_rows(spark):
    rng = np.random.default_rng(3)
    values = [int(x) for x in rng.integers(0, 50, 500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long").repartition(7)
    got = {r["id"]: r["t"] for r in sequences.running_total(df, ["id"], F.col("v"), "t").collect()}
    assert got == {i: sum(values[:i]) for i in range(500)}
    plan = stats.indexed(df.withColumnRenamed("id", "entity"))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_standard_names_and_variants(spark):
    df = spark.createDataFrame([(1, "John  Smith stole a house in Texas"), (2, None), (3, "")], "id long, text string")
    got = {r["id"]: r["t"] for r in df.select("id", standardise.standardise_names(F.col("text")).alias("t")).collect()}
    assert got == {1: "[PERSON] stole a house [LOCATION] [LOCATION]", 2: None, 3: ""}
    names = df.where("id = 1").select(standardise.replaced_names(F.col("text")).alias("n")).first()["n"]
    assert names == ["John", "Smith", "Texas", "in"]
    rows = standardise.variants(df.where("id = 1")).collect()
    assert len(rows) == 3 and rows == standardise.variants(df.where("id = 1")).collect()
    assert all(r["text"] != got[1].lower() for r in rows)


def test_consensus_and_ward(spark):
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(c, 0.1, (12, 3)) for c in (0, 5, 10)])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>")
    truth = [i // 12 for i in range(36)]
    for found in (ensembles.clustered(df, 3, "ward"), ensembles.clustered(df, 3), ensembles.consensus(ensembles.ensemble_runs(df, 3, ("kmeans", "bisecting"), 1), 3)):
        label = {r["id"]: r["cluster"] for r in found.collect()}
        assert len({(truth[i], label[i]) for i in range(36)}) == 3 == len(set(label.values()))
    same = ensembles.clustered(df, 3)
    assert validation.rand_index(same, same).first()["ari"] == 1.0
    with pytest.raises(ValueError):
        ensembles.clustered(df, 3, "other")
