"""The license scan against a search word by word, over licence texts, awkward rows and common words."""

import re
from collections import Counter

from awkward import ROWS, SF

from chainlake.llm import licenses


def words_of(text):
    return [w for w in re.split(licenses.GAP, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


def brute(text):
    w = words_of(text)
    base, base_labels, labels, most = [], set(), set(), 0
    for t in licenses.TEMPLATES:
        key = t.key.split()
        whole = (t.text or t.key).split()
        offset = next(i for i in range(len(whole)) if whole[i : i + len(key)] == key)
        for s in range(len(w) - len(key) + 1):
            if w[s : s + len(key)] == key:
                labels.add(t.label)
                if t.base:
                    base.append(s)
                    base_labels.add(t.label)
                most = max(most, sum(0 <= s + j - offset < len(w) and w[s + j - offset] == x for j, x in enumerate(whole)))
    return len(w), len(base), min(base, default=None), max(base, default=None), tuple(sorted(base_labels)), tuple(sorted(labels)), 1 - 1 / (1 + most)


def got(df):
    return [(r["doc_id"], (r["n_words"], r["n_base"], r["first_word"], r["last_word"], tuple(r["base_labels"]), tuple(r["labels"]), r["score"])) for r in licenses.scan(df).collect()]


def test_scan_equals_brute_force(spark):
    texts = [t.text or t.key for t in licenses.TEMPLATES]
    texts += [" ".join(texts), "License: " + texts[3].upper(), "cc by cc by nc cc-by", "general public general public license license", "the the of and to any in 2 0 by", "all rights, Reserved. All  rights reserved"]
    texts += ["gpl general\npublic\tlicense é general public license", "by cc", "cc", "license public general", "reserved", "permission is hereby granted free of charge to any other person"]
    texts += ["x " * 3000 + t + " y" * 10 for t in texts[:6]] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(got(df)) == [(i, brute(t)) for i, t in enumerate(texts)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert sorted(got(docs)) == sorted((r["doc_id"], brute(r["text"])) for r in docs.collect())


def test_common_words_have_no_postings(spark):
    rows = [(i, "permission to use copy modify and or distribute this software") for i in range(3)] + [(9 + i, "to use and or this copy") for i in range(50)]
    cut = licenses.words_of(spark.createDataFrame(rows, "doc_id long, text string"))
    counts = licenses.document_counts(cut)
    isc = next(t for t in licenses.TEMPLATES if t.label == "isc")
    assert {w for _, w in licenses.indexed_words(isc, counts)} <= {"permission", "modify", "distribute", "software"}
    assert counts["and"] == 53 and counts["permission"] == 3


def test_places_come_from_the_postings(spark):
    """Without the postings of the rarest word nothing is found: the index is the way to the places."""
    df = licenses.words_of(spark.createDataFrame([(1, "cc by and cc by")], "doc_id long, text string"))
    t = licenses.TEMPLATES[0]
    for index, want in ((["cc", "by"], [0, 3]), (["by"], None)):
        row = df.select(licenses.places(licenses.rare_postings(licenses.F.col("words"), index), licenses.F.col("words"), t, [(0, "cc"), (1, "by")]).alias("p")).first()
        assert row["p"] == want


def test_awkward_tables(spark, odd, empty):
    assert Counter(got(odd)) == Counter((r[0], brute(r[1])) for r in ROWS)
    assert licenses.scan(empty).count() == 0
