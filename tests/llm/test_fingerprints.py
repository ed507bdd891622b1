"""Fingerprints, edited texts, likenesses and counts of near ones against a brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash
from awkward import LONG, ROWS, SF

from chainlake.llm import fingerprints


def brute_fingerprint(text):
    """Votes in plain integers; the terms' hashes are the operator's definition, so they are computed again by hand."""
    words = [xxhash.xxh3_64_intdigest(w) for w in re.findall(r"\w+", (text or "").lower())]
    if not words:
        return xxhash.xxh3_64_intdigest(text or "")
    k, mask, total = min(5, len(words)), (1 << 64) - 1, [0] * 64
    for i in range(len(words) - k + 1):
        h = k
        for w in words[i : i + k]:
            h = (h * 0x9E3779B97F4A7C15 + w) & mask
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
            h ^= h >> shift
            h = h * factor & mask if factor else h
        for b in range(64):
            total[b] += 1 if h >> b & 1 else -1
    return sum(1 << b for b in range(64) if total[b] > 0)


def brute(rows):
    rows = [(i, t or "") for i, t in rows]
    out = []
    for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1], strict=True):
        edited = a[: len(a) - len(a) // 4] + b[: len(a) // 4]
        x, y, z = brute_fingerprint(a), brute_fingerprint(edited), brute_fingerprint(b)
        like = lambda p, q: 1 - bin(p ^ q).count("1") / 64
        out.append((i, len(a), hashlib.sha256(edited.encode()).hexdigest(), f"{x:016x}", f"{y:016x}", like(x, y), like(x, z)))
    return out


def test_rows_equal_brute_force(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    some = docs.where("n_chars < 3000") if "n_chars" in docs.columns else docs
    rows = sorted((r["doc_id"], r["text"]) for r in some.collect() if len(r["text"] or "") < 4000)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    columns = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    for parts in (1, 7):
        got = [tuple(r[c] for c in columns) for r in fingerprints.with_edits(df.repartition(parts)).collect()]
        assert sorted(got) == sorted(brute(rows))
    got = fingerprints.with_edits(odd.where("doc_id is null or doc_id not in (5, 6)")).collect()
    short = sorted(((r[0], r[1]) for r in ROWS if r[0] not in (5, 6)), key=lambda r: (r[0] is not None, r[0] or 0))
    assert Counter(tuple(r[c] for c in columns) for r in got) == Counter(brute(short))
    assert fingerprints.with_edits(empty).count() == 0
    alone = spark.createDataFrame([(3, "one two three four five six seven eight")], "doc_id long, text string")
    assert [tuple(r[c] for c in columns) for r in fingerprints.with_edits(alone).collect()] == brute([(3, "one two three four five six seven eight")])


def test_long_texts(spark, odd):
    got = {(r["doc_id"], r["n_chars"]): r for r in fingerprints.with_edits(odd).collect()}
    assert got[1, len(ROWS[0][1])]["fingerprint"] == got[2, len(ROWS[0][1])]["fingerprint"]
    assert got[5, len(LONG)]["near_edited"] > got[4, 0]["near_next"]


def near_values():
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)]
    near = [b ^ (1 << int(rng.integers(62))) ^ (1 << int(rng.integers(62))) for b in base for _ in range(4)]
    return base + near + [base[0] ^ 0b1111, base[0]]


def test_near_counts_equal_brute_force(spark, monkeypatch):
    values = sorted(set(near_values()))
    df = spark.createDataFrame([(v,) for v in near_values()] + [(None,)], "fingerprint long")
    near = lambda a, b, r: a != b and bin((a ^ b) & (2**64 - 1)).count("1") <= r
    for rows, radius, blocks in ((2048, 3, 6), (3, 3, 6), (3, 2, 5), (2048, 0, 1)):
        monkeypatch.setattr(fingerprints, "BUCKET_ROWS", rows)
        want = {a: n for a in values if (n := sum(near(a, b, radius) for b in values))}
        assert {r["fingerprint"]: r["n_near"] for r in fingerprints.near_counts(df, radius, blocks).collect()} == want
    assert {(r[0], r[1]) for r in fingerprints.near_fingerprints(df, df).collect()} == {(a, b) for a in values for b in values if near(a, b, 3)}
    assert fingerprints.near_counts(df.limit(0)).count() == 0 and fingerprints.near_fingerprints(df, df.limit(0)).count() == 0


def test_query_counts_near_fingerprints(spark):
    rows = fingerprints.op2_document_fingerprints(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000
    values = {int(r["fingerprint"], 16) for r in rows}
    for r in rows:
        own = int(r["fingerprint"], 16)
        assert r["n_near"] == sum(v != own and (v ^ own).bit_count() <= 3 for v in values)
