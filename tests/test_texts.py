"""Texts: patterns run once a text, terms counted where the text is."""

import math
from collections import Counter

import numpy as np

from chainlake.functions import standardise, text


def test_patterns_run_once_for_each_text(spark):
    df = spark.createDataFrame([(1, "John Smith stole a house"), (2, None), (3, "")], "id long, text string").coalesce(1)
    found = standardise.variants(df)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 5 and plan.index("Generate explode") < plan.index("regexp_replace")
    assert found.rdd.getNumPartitions() > 1
    rows = {(r["id"], r["variant"]): r["text"] for r in found.collect()}
    words = [{"[person]"}, {"stole", "took", "robbed"}, {"a"}, {"house", "home", "residence"}]
    for v in range(3):
        said = rows[1, v].removeprefix("The event: ").removesuffix(" occurred").split(" ")
        assert len(said) == 4 and all(w in s for w, s in zip(said, words))
        assert rows[2, v] is None and rows[3, v] in ("The event: ", " occurred")


def test_terms_are_counted_where_the_text_is(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join("w%d" % x for x in rng.zipf(1.6, 30) % 40)) for i in range(60)] + [(60, ""), (3, "w1 w1 extra"), (None, "w2 more"), (None, "w2")]
    df = spark.createDataFrame(rows, "id long, text string")
    docs = {}
    for i, t in rows:
        docs.setdefault(i, Counter()).update(w for w in t.split() if len(w) > 1)
    cf, held = sum(docs.values(), Counter()), Counter(w for d in docs.values() for w in d)
    top = sorted(cf, key=lambda w: (-cf[w], w))[:12]
    idf = {w: math.log((1 + len(rows)) / (1 + held[w])) + 1 for w in top}
    got = {r["term"]: (r["df"], r["cf"], round(r["idf"], 9)) for r in text.term_weights(df, 12).collect()}
    assert got == {w: (held[w], cf[w], round(idf[w], 9)) for w in top}
    want = {}
    for i, d in docs.items():
        length = math.sqrt(sum((d[w] * idf[w]) ** 2 for w in top))
        want |= {(i, w): round(d[w] * idf[w] / length, 9) for w in top if d[w]}
    weights = text.tf_idf(df, 12)
    assert {(r["id"], r["term"]): round(r["weight"], 9) for r in weights.collect()} == want
    unique = text.tf_idf(df.where("id > 3"), 12)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in unique
