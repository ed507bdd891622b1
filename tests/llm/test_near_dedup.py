"""Near-duplicate classes against a brute force that shares no code with the operator."""

import re
from collections import Counter

import numpy as np
from awkward import ROWS, SF, frame

from chainlake.llm import near_dedup


def bag_of(text):
    words = re.findall(r"\w+", (text or "").lower())
    k = min(5, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    union = sum(a.values()) + sum(b.values()) - both
    return both / union if union else 0.0


def brute_labels(texts):
    """Class labels of distinct texts: their words are equal, or their bags overlap by 0.8."""
    bags = [bag_of(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            small, large = sorted((sum(a.values()), sum(b.values())))
            equal = (texts[i] or "") == (texts[j] or "")
            if equal or (large and small >= 0.8 * large and similarity(a, b) >= 0.8):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def groups(keys):
    by = {}
    for i, k in enumerate(keys):
        by.setdefault(k, []).append(i)
    return sorted(by.values())


def check(spark, rows):
    """Rows are told apart by their order, as (doc_id, text) need not be unique."""
    rows = [(*r, i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id long")
    want = brute_labels([t for _, t, _ in rows])
    ids = Counter((i, t) for i, t, _ in rows)
    found = near_dedup.classified(df).collect()
    marks = {r["class_id"]: (r["t1"], r["t2"]) for r in df.select("class_id", *near_dedup.text_marks()).collect()}
    by = {(r["doc_id"], r["t1"], r["t2"]): r for r in found}
    assert len(found) == len(rows) and len(by) == len(ids)
    got = [by[(i, *marks[n])] for i, t, n in rows]
    assert groups([r["class_id"] for r in got]) == groups(want)
    size = Counter(want)
    assert [r["class_size"] for r in got] == [size[k] for k in want]
    for members in groups(want):
        least = min((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        assert got[members[0]]["class_id"] == least or got[members[0]]["class_id"] < 0
    kept = near_dedup.one_of_each(df)
    assert kept.columns == df.columns
    left = [r["class_id"] for r in kept.collect()]
    assert sorted(want[i] for i in left) == sorted(set(want))
    for i in left:
        ids_of = [rows[j][0] for j in range(len(rows)) if want[j] == want[i] and rows[j][0] is not None]
        assert rows[i][0] == min(ids_of, default=None)


def test_documents_equal_brute_force(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    chain = [f"chain{i}" for i in range(100)]
    for i in range(12):  # each near to the next, the ends far apart
        rows.append((10_000 + i, " ".join(chain)))
        chain[3 + 8 * i % 97] = f"other{i}"
    check(spark, rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r["class_id"] >= 0 for r in near_dedup.near_duplicates(df).collect())


def test_repeated_and_missing_ids_equal_brute_force(spark):
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    c = " ".join(f"c{i}" for i in range(60))
    check(spark, [(1, a), (1, b), (3, b + " more"), (1, a), (1, a), (2, c)])
    check(spark, [(None, a), (None, b), (7, a), (None, c + " end"), (None, c), (None, None), (None, "")])
    check(spark, [(9, a), (9, b), (3, b), (9, None), (9, ""), (4, "!!!"), (5, "!!!"), (6, "???")])
    check(spark, [(r[0], r[1]) for r in ROWS])


def test_awkward_tables(spark, odd, empty):
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.one_of_each(empty).count() == 0
    clash = odd
    for name in ("dropped_id", "stays", "row", "t1", "fate_doc_id", "own_t1", "rep", "bag", "a.b"):
        clash = clash.withColumn(name, near_dedup.F.lit("x"))
    kept = near_dedup.one_of_each(clash)
    assert kept.columns == clash.columns and kept.count() == 6
    assert near_dedup.near_duplicates(clash).count() == len(ROWS)


def test_recall_at_the_threshold(spark):
    """Pairs of similarity 0.8 to 0.85, the hardest that count."""
    rng = np.random.default_rng(9)
    rows, pairs = [], []
    for k in range(300):
        words = [f"p{k}w{x}" for x in rng.integers(0, 10_000, 200)]
        other = list(words)
        for at in rng.choice(range(0, 200, 8), 4, replace=False):
            other[at] = f"new{k}"
        if 0.8 <= similarity(bag_of(" ".join(words)), bag_of(" ".join(other))) <= 0.85:
            pairs.append((2 * k, 2 * k + 1))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    of = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) >= 200 and sum(of[a] == of[b] for a, b in pairs) >= 0.99 * len(pairs)


def test_a_star_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 4)
    base = [f"s{i}" for i in range(120)]
    rows = []
    for i in range(30):
        words = list(base)
        words[i * 4 % 120] = f"own{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"u{i}x{j}" for j in range(50))) for i in range(10)]
    check(spark, rows)
    assert frame(spark, []).count() == 0
