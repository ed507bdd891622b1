"""The ten operators against brute force, exact round trips and held-out accuracy, with awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from awkward import LONG, ROWS, SF
from pyspark.sql import functions as F

from chainlake.llm import common, decontamination, line_dedup, near_dedup, secrets, token_output
from chainlake.llm.common import WordHashes, hashed_words, shared_dir, shingle_hashes

def test_tokens_round_trip(spark, odd, empty):
    from tokenizers import Tokenizer

    path = shared_dir(spark, "tokens")
    token_output.write_tokens(odd, path, token_output.tokenizer_path(), 4)
    rows = token_output.read_tokens(spark, path).orderBy("start").collect()
    t = Tokenizer.from_file(token_output.tokenizer_path())
    want = [(r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    assert [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rows] == want
    assert [r["start"] for r in rows] == np.cumsum([0] + [len(i) for _, i in want])[:-1].tolist()
    assert [r["ids_crc32"] for r in rows] == [zlib.crc32(np.asarray(i, "<u4").tobytes()) for _, i in want]
    assert token_output.read_document(spark, path, 5).tolist() == dict(want)[5]
    assert token_output.token_output(empty).count() == 0


def test_encoder_equals_library():
    e = token_output.Encoder(token_output.tokenizer_path())
    texts = ["don't STOP'LL 12é½ª ", "a\x85b\xa0c\x1cd", "<|endoftext|>x", "ΣΑΣ naïve", "", "İstanbul"]
    assert [np.frombuffer(b, "<u4").tolist() for b in e.encode(texts)] == [[*x.ids, 1] for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    e = rng.integers(0, 2**63, 60).astype(np.uint64)
    a = rng.integers(1, 9, 60)
    b = np.where(rng.random(60) < 0.7, a, rng.integers(1, 9, 60))
    reg = near_dedup.signatures(np.concatenate([e, e]), np.concatenate([a, b]), np.repeat([0, 1], 60), 2, 4096)
    assert abs((reg[0] == reg[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_secrets():
    inner = "token: abcdef123456"
    layered = secrets.base64.b64encode(zlib.compress(inner.encode())).decode()
    for text in (f"see {layered} now", "see password%3D" + "%68unter22", "x \\u0070assword=hunter22 y", "k " + secrets.base64.b64encode(f"go {layered} on and on".encode()).decode()):
        found = secrets.scan_text(text)
        assert [f.kind for f in found if f.depth > 0] == ["assign"], text
        assert 0 <= found[0].start < found[0].end <= len(text)
    assert secrets.scan_text(None) == [] and secrets.scan_text("token=abc") == []
    text = "API_KEY: 'abcdef' AKIA" + "A" * 16 + " " + "0a" * 12
    assert [(f.kind, f.start) for f in secrets.scan_text(text)] == [("assign", 0), ("access", 18), ("hex", 39)]


def test_secrets_in_awkward_layers(monkeypatch):
    import gzip
    from urllib.parse import quote

    b64 = lambda raw: secrets.base64.b64encode(raw).decode()
    inner = b"password=hunter22secret"
    filler = "é word ".encode() * 50
    texts = {
        "later member": b64(gzip.compress(b"nothing") + gzip.compress(inner)),
        "Latin-1": b64("caf\xe9 password=hunter22 caf\xe9".encode("latin-1")),
        "UTF-16": b64("password=hunter22 é".encode("utf-16")),
        "UTF-16 BE": b64("password=hunter22 é".encode("utf-16-be")),
        "percent": "see caf%E9%20password%3Dhunter22",
        "not printable": b64(bytes(range(30)) + b" password=hunter22"),
        "compressed, percent": "data=" + quote(zlib.compress(inner)),
        "compressed, backslash": "".join(f"\\x{b:02x}" for b in zlib.compress(inner)),
        "compressed twice": b64(gzip.compress(zlib.compress(inner))),
        "truncated": b64(zlib.compress(inner + filler)[:-6]),
    }
    texts |= {f"prefix {x}": x + b64(b"my password=hunter22 is long") for x in ("https://host/a/", "ab-", "key_", "abcde-f/")}
    texts |= {f"compressed behind {x}": x + b64(gzip.compress(inner)) for x in ("a/", "ab-", "abc_", "abcd/")}
    for name, text in texts.items():
        assert "assign" in {f.kind for f in secrets.scan_text(text) if f.depth > 0}, name
    for step, window, overlap in ((64, 1024, 128), (1000, 4096, 1000)):
        for name, size in (("STEP", step), ("WINDOW", window), ("OVERLAP", overlap)):
            monkeypatch.setattr(secrets, name, size)
        for before in range(0, 9000, 271):
            raw = (filler * 30)[:before] + b" " + inner + b" " + filler * 20
            assert "assign" in {f.kind for f in secrets.scan_text(b64(zlib.compress(raw)))}, before
    assert secrets.scan_text("%25" * 3000) == []


def test_secret_behind_sixteen_megabytes():
    raw = ("é" * (1 << 20) * 9).encode() + b" password=hunter22secret"
    assert [f.kind for f in secrets.scan_text(secrets.base64.b64encode(zlib.compress(raw)).decode())] == ["assign"]



def brute_lines(rows):
    held = defaultdict(set)
    key = lambda x: (lambda k: k if len(k) >= 40 else None)(re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")))
    for i, t in rows:
        for x in (t or "").split("\n"):
            if key(x):
                held[key(x)].add(i)
    return {i: "\n".join(x for x in (t or "").split("\n") if not (key(x) and len(held[key(x)]) >= 5 and i != max(held[key(x)]))) for i, t in rows}


def test_line_dedup_and_its_reversal(spark, docs, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows += [(5000 + i, f"{'é' * 39}\n  Shared line of more than forty characters, É \t\nown {i}") for i in range(6)] + [(6000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    store = line_dedup.LineStore.build(df)
    assert {r["doc_id"]: r["kept"] for r in line_dedup.deduped(df, store).collect()} == brute_lines(rows)
    first, rest = df.where("doc_id % 3 = 0"), df.where("doc_id % 3 != 0")
    both = line_dedup.LineStore.build(first).insert(rest)
    assert sorted(both.refs.collect()) == sorted(store.refs.collect())
    back = both.delete(rest.select("doc_id"))
    assert sorted(back.refs.collect()) == sorted(line_dedup.LineStore.build(first).refs.collect())
    assert {r["doc_id"]: r["kept"] for r in line_dedup.deduped(first, back).collect()} == brute_lines([r for r in rows if r[0] % 3 == 0])
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.deduped(odd, line_dedup.LineStore.build(odd)).collect()]
    assert Counter(got) == Counter((i, len((t or "").split("\n")), 0, t or "") for i, t, *_ in ROWS)
    assert line_dedup.deduped(empty, line_dedup.LineStore.build(empty)).count() == 0


def test_filters_grow_with_the_store(spark, empty, monkeypatch):
    """An empty store grows by inserts as one built at once; hot lines are spread over parts of a shard."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 64)
    monkeypatch.setattr(line_dedup, "SHARD_POSTINGS", 100)
    rows = [(i, "\n".join(f"a line that stands in many documents, number {(i * 7 + j) % 300}" for j in range(20)) + "\nthe same long line in every single document of all") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    grown = line_dedup.LineStore.build(empty).insert(df.where("doc_id < 50")).insert(df.where("doc_id >= 50"))
    built = line_dedup.LineStore.build(df)
    assert built.shards > 4 and grown.shards >= built.shards // 2
    keys = sorted(map(tuple, built.refs.where("n_docs >= 5").select("k1", "k2").collect()))
    held = {r["shard"]: line_dedup.CuckooFilter.from_bytes(bytes(r["slots"])) for r in grown.filters.collect()}
    assert len(held) > 1 and all(held[k1 % grown.shards].contains(np.array([k2])).all() for k1, k2 in keys)
    for store in (grown, built):
        assert {r["doc_id"]: r["kept"] for r in line_dedup.deduped(df, store).collect()} == brute_lines(rows)
        assert store.maybe_repeated(store.postings).count() >= store.postings.join(store.refs.where("n_docs >= 5"), ["k1", "k2"]).count()


def test_filters_rule_out_what_is_rare(spark):
    rows = [(i, f"a line of its own that no other document holds: {i}\nthe line that all of the documents share with each other") for i in range(400)]
    store = line_dedup.LineStore.build(spark.createDataFrame(rows, "doc_id long, text string"))
    assert 400 <= store.maybe_repeated(store.postings).count() < 420


def test_rows_without_an_id_are_documents_of_their_own(spark):
    line = "a line that is long enough to count as a repeated one"
    rows = [(None, f"{line}\nown {i}") for i in range(4)] + [(None, f"{line}\nown 0"), (7, f"{line}\nlast")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["kept"]) for r in line_dedup.deduped(df, line_dedup.LineStore.build(df)).collect())
    assert got == sorted([(-1, f"own {i}") for i in (0, 0, 1, 2, 3)] + [(7, f"{line}\nlast")])


def test_cuckoo_filter():
    keys = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 3000)
    f = line_dedup.CuckooFilter.sized(3000)
    assert f.insert(keys) and f.contains(keys).all()
    f.delete(keys[:1000])
    assert f.contains(keys[1000:]).all() and f.contains(keys[:1000]).mean() < 0.02


def test_decontamination(spark, docs, odd, empty):
    cache = WordHashes()
    sets = lambda t: set(shingle_hashes(hashed_words(t, cache)).tolist())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = LONG.split()
    items += [(900, " ".join(words[20_000:20_040])), (901, " ".join([*words[5_000:5_030], "novel", *words[5_030:5_060]])), (902, "lazy dog"), (903, None), (904, "")]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").union(odd.where("doc_id != 9").select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 5000)).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contained(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for i, t in rows:
        s = sets(t)
        want |= {(i, q) for q, x in items if (k := sets(x)) and q != 902 and len(s & k) / len(k) >= 0.8}
        want |= {(i, 902)} if re.search(r"\blazy dog\b", (t or "").lower()) else set()
    assert got == want and (5005, 901) in got
    assert decontamination.contained(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontamination.contained(df, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_small_items_in_long_texts_equal_brute_force(spark):
    cache = WordHashes()
    sets = lambda t: set(shingle_hashes(hashed_words(t, cache)).tolist())
    rng = np.random.default_rng(7)
    texts = [(i, " ".join(f"w{x}" for x in rng.integers(0, 5000, 3000))) for i in range(8)]
    words = [t.split() for _, t in texts]
    items = []
    for n in [*range(5, 13), 16, 20]:
        for _ in range(40):
            at = int(rng.integers(0, 3000 - n))
            items.append((len(items), " ".join(words[int(rng.integers(0, 8))][at : at + n])))
        items.append((len(items), " ".join([*words[0][100 : 100 + n], "novel"])))
    items += [(len(items), "a b c d e " * 4), (len(items) + 1, "w1 w2 w3 w4 w5 w6")]
    texts.append((8, "x " * 500 + "a b c d e " * 9))
    index = decontamination.ItemIndex(items)
    got = {(t, i, round(s, 9)) for t, i, s in index.matches([hashed_words(t, cache) for _, t in texts])}
    want = {(i, q, round(len(s & k) / len(k), 9)) for i, t in texts for s in [sets(t)] for q, x in items if (k := sets(x)) and len(s & k) / len(k) >= 0.8}
    assert got == want and len(want) >= 400
    df, things = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contained(df, things).collect()} == {x[:2] for x in want}


def test_decontaminated_keeps_clean_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, "all rights reserved"), (3, None)], "item_id long, text string")
    clash = odd.withColumn("hit_id", F.lit(1)).withColumn("item_id", F.lit(2)).withColumn("a.b", F.lit("x"))
    got = decontamination.decontaminated(clash, items)
    assert got.columns == clash.columns
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(i for i, *_ in ROWS if i not in (1, 2, 9))
    assert decontamination.decontaminated(empty, items).count() == 0
    assert decontamination.decontaminated(odd, items.limit(0)).count() == len(ROWS)
    found = Counter((r["doc_id"], r["item_id"]) for r in decontamination.contained(odd, items).collect())
    assert found == Counter({(1, 1): 1, (2, 1): 1, (9, 2): 2})


def test_decontamination_in_blocks_of_items(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(tuple, decontamination.contained(docs, items).collect()))
    clean = sorted(r["doc_id"] for r in decontamination.decontaminated(docs, items).collect())
    real = decontamination.item_blocks
    monkeypatch.setattr(decontamination, "item_blocks", lambda x: real(x, 600))
    assert len(list(decontamination.item_blocks(items))) > 1
    assert sorted(map(tuple, decontamination.contained(docs, items).collect())) == whole
    assert sorted(r["doc_id"] for r in decontamination.decontaminated(docs, items).collect()) == clean
    assert set(clean) == {r["doc_id"] for r in docs.collect()} - {r[0] for r in whole}


def test_pipeline(spark, docs):
    import corpus_pipeline

    df = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = near_dedup.stored(stage(spark, df, SF), "test")
        assert df.columns == docs.columns
    got = corpus_pipeline.STAGES[-1][1](spark, df, SF)
    assert got.count() == df.count() and set(got.columns) >= {"doc_id", "start", "n_tokens", "ids_crc32"}


def test_blocks_find_the_links_of_a_whole_bucket(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    base = np.arange(100, dtype=np.uint64)
    sets = []
    for _ in range(60):
        s = base.copy()
        s[rng.choice(100, rng.integers(0, 25), replace=False)] = rng.integers(1000, 2**31, 1)
        sets.append(np.unique(s).tobytes())
    members = spark.createDataFrame([(0, 7, i, i) for i in range(60)], "band int, key long, rep long, label long")
    bags = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(sets)], "rep long, bag binary")
    want = [(i, j) for i in range(60) for j in range(i + 1, 60) if near_dedup.overlap(np.frombuffer(sets[i], np.uint64), np.frombuffer(sets[j], np.uint64)) >= 0.8]

    def classes(pairs):
        label = list(range(60))
        for a, b in pairs:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
        return label

    for rows, columns in ((512, 4096), (7, 16)):
        monkeypatch.setattr(near_dedup, "BLOCK_ROWS", rows)
        monkeypatch.setattr(near_dedup, "COLUMNS", columns)
        got = [(r["a"], r["b"]) for r in near_dedup.blocked_links(members, bags, 0.8).collect()]
        assert set(got) <= set(want)
        assert classes(got) == classes(want)


def test_runs_hold_all_rows_in_bounded_parts():
    texts = ["x" * common.TEXT_BYTES, None, "", "y" * 10, "z" * (common.TEXT_BYTES - 5)] + ["w"] * 7
    parts = list(common.runs(pa.RecordBatch.from_pydict({"text": texts, "n": list(range(12))}), 4))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert all(p.num_rows <= 4 and (p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= common.TEXT_BYTES) for p in parts)
    assert list(common.runs(pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())}), 4)) == []
