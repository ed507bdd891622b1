"""The byte networks against a forward pass in loops and numeric gradients; held-out accuracy; odd labels and tables."""

from collections import Counter

import numpy as np
import pytest
from awkward import LONG, ROWS, SF, frame
from pyspark.sql import functions as F

from chainlake.llm import classifiers
from chainlake.llm.bytenet import ByteNet, windows_of


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def small_net(**changed):
    net = ByteNet(**({"widths": (2, 3), "filters": 3, "stride": 1, "window": 16, "overlap": 2, "classes": 3, "seed": 4} | changed))
    net.p["c"] += np.linspace(-0.3, 0.4, len(net.p["c"])).astype(np.float32)
    return net


def forward(net, text):
    """The network in loops: every filter at every place of every window."""
    raw = (text or "").encode()
    step = net.window - net.overlap
    cuts = [raw[i * step : i * step + net.window] for i in range(max(1, -(-(len(raw) - net.overlap) // step)))]
    pooled = []
    for cut in cuts:
        x = cut + bytes(net.window - len(cut))
        values = []
        for i, w in enumerate(net.widths):
            for k in range(net.filters):
                values.append(max(sum(float(net.p[f"t{i}"][j, x[at + j], k]) for j in range(w)) for at in range(0, net.window - w + 1, net.stride)))
        pooled.append([np.tanh(v + c) for v, c in zip(values, net.p["c"], strict=True)])
    n = len(pooled[0])
    f = [sum(p[k] for p in pooled) / len(pooled) for k in range(n)] + [max(p[k] for p in pooled) for k in range(n)]
    z = [sum(a * float(w) for a, w in zip(f, net.p["w"][:, c], strict=True)) + float(net.p["b"][c]) for c in range(net.p["w"].shape[1])]
    e = np.exp(np.array(z) - max(z))
    return e / e.sum()


@pytest.mark.parametrize("stride", [1, 2])
def test_forward_equals_loops(stride):
    net = small_net(stride=stride)
    texts = ["", None, "a", "short text", "exactly sixteen!", "é" * 30, "a longer text of several windows " * 5]
    assert np.allclose(net.probabilities(texts), [forward(net, t) for t in texts], atol=1e-5)
    alone = [net.probabilities([t])[0] for t in texts]
    assert np.allclose(net.probabilities(texts), alone, atol=1e-6)


def test_windows_cover_every_byte_and_every_short_run():
    text = "".join(chr(33 + i % 90) for i in range(1000))
    x, owner = windows_of([text, "", None], 64, 3)
    held = {bytes(r[i : i + 4]) for r in x[owner == 0] for i in range(61)}
    assert {text[i : i + 4].encode() for i in range(997)} <= held and (owner == 1).sum() == (owner == 2).sum() == 1


def test_gradients_equal_differences():
    net = small_net()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts, y, weight = ["some words here and there, over windows", "otra cosa", "drei"], np.array([0, 1, 2]), np.array([1.0, 2.0, 0.5])
    x, owner = windows_of(texts, net.window, net.overlap)

    def loss():
        out = np.empty((len(x), len(net.p["c"])))
        for i, w in enumerate(net.widths):
            h = sum(net.p[f"t{i}"][j][x[:, j : net.window - w + 1 + j]] for j in range(w))
            out[:, i * net.filters : (i + 1) * net.filters] = h.max(axis=1)
        z = net.features(out, owner) @ net.p["w"] + net.p["b"]
        z -= z.max(axis=1, keepdims=True)
        log = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return -(weight * log[np.arange(3), y]).sum() / weight.sum()

    found = net.gradients(x, owner, y, weight)
    rng = np.random.default_rng(0)
    for name, g in found.items():
        places = [tuple(rng.integers(0, s) for s in g.shape) for _ in range(20)]
        if name.startswith("t"):
            places += [tuple(p) for p in np.argwhere(g != 0)[:: max(1, (g != 0).sum() // 15)]]
        for at in places:
            kept, eps = net.p[name][at], 1e-5
            net.p[name][at] = kept + eps
            up = loss()
            net.p[name][at] = kept - eps
            down = loss()
            net.p[name][at] = kept
            assert abs((up - down) / (2 * eps) - g[at]) < 1e-3 * max(1, abs(g[at])), (name, at)


def test_quality(spark, odd, empty, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = classifiers.quality_model(docs, labels)
    held = classifiers.scored_quality(docs, *model).join(labels, "doc_id").where(classifiers.remainder(F.col("doc_id"), 4) == 2).collect()
    assert np.mean([(r["score"] >= 0.7) == (r["quality"] == 1) for r in held]) >= 0.8
    got = classifiers.scored_quality(odd, *model).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ROWS) and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(round(r["score"], 6))
    assert by[1] == by[2] and by[3] == by[4] and all(len(v) == 1 for v in by.values())
    assert classifiers.quality_model(empty, labels.limit(0)) == (None, 0.5)
    assert classifiers.scored_quality(empty, None, 0.5).count() == 0


def test_quality_without_two_classes(spark, odd):
    def labels(*rows):
        return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")

    ids = [r["id"] for r in spark.range(1, 60).where(classifiers.remainder(F.col("id"), 4) != 2).collect()]
    docs = frame(spark, [(i, f"text {i}", "en", "a") for i in ids])
    model, share = classifiers.quality_model(docs, labels(*[(i, 1, 0) for i in ids]))
    assert model is None and share == 1.0
    # Labels without texts give no network but a share.
    model, share = classifiers.quality_model(docs.limit(0), labels((ids[0], 1, 0), (ids[1], 1, 0), (ids[2], 1, 0), (ids[3], 0, 0)))
    assert model is None and share == 0.75
    assert {r["score"] for r in classifiers.scored_quality(odd, model, share).collect()} == {0.75}
    # Repeated labels count once, conflicting ones as each; NULL, other labels and unknown documents are left out.
    rows = [(ids[0], 1, 0)] * 3 + [(ids[1], 1, 0), (ids[1], 0, 0), (None, 1, 0), (ids[2], 5, 0), (ids[3], None, 0), (10**9, 1, 0)]
    model, share = classifiers.quality_model(docs, labels(*rows))
    assert model is not None and 0.5 < share < 1


def test_long_texts_train_too(spark):
    ids = [r["id"] for r in spark.range(1, 60).where(classifiers.remainder(F.col("id"), 4) != 2).collect()]
    docs = frame(spark, [(i, (LONG if k % 2 else "!!! ??? ") * (1 if k % 2 else 4000), "en", "a") for k, i in enumerate(ids)])
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    texts, y, counts = classifiers.sample(labels.select("doc_id", F.col("quality").alias("label")), docs, 20)
    assert len(texts) == 40 and {len(t) for t in texts} == {classifiers.MAX_CHARS} and sum(counts.values()) == len(ids) and sum(y) == 20


def test_language(spark, odd, empty, docs):
    model = classifiers.language_model(docs)
    got = {r["doc_id"]: r for r in classifiers.identified(odd, *model).collect()}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[7]["lang_pred"] == "und" and got[1]["lang_pred"] != "und"
    assert Counter(r["doc_id"] for r in classifiers.identified(odd, *model).collect()) == Counter(r[0] for r in ROWS)
    held = classifiers.identified(docs, *model).join(docs.select("doc_id", "lang"), "doc_id").where(classifiers.remainder(F.col("doc_id"), 5) == 0).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.9
    assert classifiers.identified(empty, *classifiers.language_model(empty)).count() == 0


def test_one_language(spark, empty):
    docs = frame(spark, [(i, f"some text {i}", "en", "a") for i in range(20)] + [(50, "123", None, None), (51, None, "en", "a")])
    model, classes = classifiers.language_model(docs)
    assert model is None and classes == ["en"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in classifiers.identified(docs, model, classes).collect()}
    assert got[3] == ("en", 1.0) and got[50] == got[51] == ("und", 0.0)
    clash = docs.withColumn("a.b", F.lit("x"))
    kept = classifiers.with_language(clash)
    assert kept.columns == clash.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(20))
    assert classifiers.with_language(empty).count() == 0


def test_language_filter_keeps_documents(spark, docs, odd):
    kept = {r["doc_id"] for r in classifiers.with_language(docs).collect()}
    some = {r["doc_id"] for r in docs.collect() if r["text"] and any(map(str.isalpha, r["text"]))}
    assert kept <= some and len(kept) >= 0.98 * len(some)
    assert Counter(r["doc_id"] for r in classifiers.with_language(odd).collect())[9] in (0, 2)
