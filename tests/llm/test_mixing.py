"""The mix against one that is put together by hand, its permutations, draws and bounds."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from awkward import SF, frame
from pyspark.sql import functions as F

from chainlake.llm import mixing


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 257, 1000, 4099])
def test_permutation(spark, n):
    order = mixing.Permutation(n, n)
    image = [order.at(i) for i in range(n)]
    assert sorted(image) == list(range(n)) and [order.where(x) for x in image] == list(range(n))
    keys = F.array(*[F.struct(F.lit(j).alias("j"), *[F.lit(v).cast("bigint").alias(c) for c, v in zip("mcd", k, strict=True)]) for j, k in enumerate(order.keys)])
    got = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(order.a).cast("bigint"), F.lit(order.b).cast("bigint"), F.lit(n).cast("bigint"), keys, order.walks).alias("x"))
    assert [r["x"] for r in got.orderBy("id").collect()] == image
    if n >= 1000:  # no arithmetic progression: steps between neighbours are many
        assert len({(b - a) % n for a, b in zip(image, image[1:], strict=False)}) > n // 4


def test_draws_are_multinomial(spark):
    sources = [{"slots": 30_000, "first": 0}, {"slots": 10_000, "first": 30_000}, {"slots": 24_000, "first": 40_000}]
    rows = mixing.drawn(spark, sources, 3).collect()
    by = defaultdict(dict)
    for r in rows:
        by[r["shard"]][r["place"]] = r["count"]
    assert len(by) == 250 and all(sum(c.values()) == mixing.SHARD_SLOTS for c in by.values())
    for place, s in enumerate(sources):
        p = s["slots"] / 64_000
        c = np.array([x.get(place, 0) for x in by.values()])
        assert abs(c.mean() - mixing.SHARD_SLOTS * p) < 4 * np.sqrt(mixing.SHARD_SLOTS * p * (1 - p) / 250)
        assert 0.7 < c.var() / (mixing.SHARD_SLOTS * p * (1 - p)) < 1.35
    assert sorted(map(str, rows)) != sorted(map(str, mixing.drawn(spark, sources, 4).collect()))


def by_hand(rows, sources, slots):
    """Words taken of each row: every source's words in a line, cut into blocks, read slot by slot."""
    taken = Counter()
    for place, s in enumerate(sources):
        line = [r["row"] for r in sorted((r for r in rows if r["place"] == place), key=lambda r: r["start"]) for _ in range(r["size"])]
        assert len(line) == s["size"]
        blocks = [line[i : i + mixing.BLOCK_WORDS] for i in range(0, len(line), mixing.BLOCK_WORDS)]
        mine = sorted((r for r in slots if r["place"] == place), key=lambda r: r["i"])
        assert [r["i"] for r in mine] == list(range(s["slots"]))
        left = s["words"]
        for i in range(s["slots"]):
            part = blocks[s["order"].at(i % s["n"])][:left]
            assert mine[i]["block"] == s["order"].at(i % s["n"])
            left -= len(part)
            taken.update(part)
        assert left == 0
    return taken


def test_mix_equals_one_by_hand(spark, odd, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for block, shard in ((256, 256), (50, 8)):
        monkeypatch.setattr(mixing, "BLOCK_WORDS", block)
        monkeypatch.setattr(mixing, "SHARD_SLOTS", shard)
        for df in (docs, odd):
            table = mixing.sized(df)
            sources = mixing.plan(table, mixing.WEIGHTS, mixing.SHARE, mixing.MOST, 11)
            rows = mixing.located(mixing.placed(table, sources), sources).collect()
            slots = mixing.slots_of(spark, sources, 11).collect()
            sizes = Counter(r["shard"] for r in slots)
            assert all(n == shard for s, n in sizes.items() if s != max(sizes))
            want = by_hand(rows, sources, slots)
            got = mixing.mix(mixing.placed(table, sources), sources, 11).groupBy("row").agg(F.sum(F.col("hi") - F.col("lo")).alias("n")).collect()
            assert {r["row"]: r["n"] for r in got} == dict(want)
            assert all(want[r["row"]] <= 2 * r["size"] for r in rows)


def test_taken_words(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (docs, odd):
        got = [r.asDict() for r in mixing.taken_words(df).collect()]
        sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in df.select("text").collect()]
        assert sorted(r["size"] for r in got) == sorted(sizes)
        assert all(0 <= r["taken"] <= 2 * r["size"] and (r["taken"] > 0) == (r["shards"] > 0) for r in got)
        assert sorted(map(str, got)) == sorted(str(r.asDict()) for r in mixing.taken_words(df.repartition(5)).collect())
    by = defaultdict(lambda: [0, 0.0])
    for r in mixing.taken_words(docs).join(docs.select("doc_id", "source"), "doc_id").collect():
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1] = r["target"]
    assert all(abs(t - g) <= 1 for t, g in by.values())
    assert mixing.taken_words(empty).count() == 0 and mixing.mixed(empty).count() == 0 and mixing.mixed_blocks(empty).count() == 0


def test_mixed_texts_hold_the_taken_words(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (docs, odd):
        got = mixing.mixed(df)
        assert got.columns == df.columns and got.dtypes == df.dtypes
        words = defaultdict(int)
        for r in got.collect():
            assert r["n_chars"] == len(r["text"])
            words[r["doc_id"]] += len(re.findall(mixing.TOKEN, r["text"]))
        want = defaultdict(int)
        for r in mixing.taken_words(df).collect():
            want[r["doc_id"]] += r["taken"]
        assert words == {k: v for k, v in want.items() if v}


def test_blocks_of_a_shard_are_of_fixed_length_and_mixed_sources(spark):
    rows = mixing.mixed_blocks(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    sizes, sources = Counter(), defaultdict(set)
    for r in rows:
        sizes[r["shard"], r["slot"]] += r["hi"] - r["lo"]
        sources[r["shard"]].add(r["source"])
    assert sum(n == mixing.BLOCK_WORDS for n in sizes.values()) >= len(sizes) - 3 * len(set().union(*sources.values()))
    assert all(len(s) > 1 for s in sources.values())
    assert all(r["at"] + r["hi"] - r["lo"] <= mixing.BLOCK_WORDS for r in rows)


def test_one_source_and_one_word(spark):
    got = mixing.taken_words(frame(spark, [(1, "word", "en", "a")])).collect()
    assert [(r["size"], r["taken"]) for r in got] == [(1, 2)] or [(r["size"], r["taken"]) for r in got] == [(1, 1)]
    assert [r["taken"] for r in mixing.taken_words(frame(spark, [(1, None, None, None), (2, "", None, None)])).collect()] == [0, 0]
