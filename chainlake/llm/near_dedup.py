"""Near-duplicates: BagMinHash signatures of shingle multisets, banding, verified multiset overlap, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.llm.common import THRESHOLD, U64, WordHashes, as_signed, discard, hashed_words, mix, record_batches, runs, shingle_hashes, stored, table

#: 25 bands of 5 registers: a pair of weighted similarity 0.8 shares no band with probability 5e-5.
BANDS, ROWS = 25, 5
#: A block of a bucket has about so many rows and bytes; its overlaps are counted so many tokens at a time.
BLOCK_ROWS, BLOCK_BYTES, COLUMNS = 512, 1 << 22, 4096
_C1, _C2, _C3 = U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03), U64(0x8CB92BA72F3D8DD7)


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """BagMinHash registers (n bags, m registers) of elements with integer weights; ``owner`` is each element's bag.

    The discretised weight axis is cut into the intervals [0, 1), [1, 2), [2, 4), [4, 8) ... Over each (element,
    interval) runs a Poisson process whose rate for each register is the interval's length. Points come in ascending
    order; a point has a register and a place on the weight axis and counts where the place is below the weight, so
    an interval that the weight cuts is thinned to its part. A register keeps its smallest point. A process ends when
    it has passed the largest register of its bag. Two bags agree in a register with probability equal to their
    weighted Jaccard similarity. Empty bags keep infinite registers.
    """
    reg = np.full(n * m, np.inf)
    if not len(elements):
        return reg.reshape(n, m)
    levels = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64) + 1, 1)
    at = np.repeat(np.arange(len(elements)), levels)
    k = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    lo = np.where(k == 0, 0, 1 << np.maximum(k - 1, 0))
    length = np.maximum(lo, 1)
    seed = mix(elements[at] ^ (k.astype(U64) * _C1))
    own, weight, x, step = owner[at], weights[at], np.zeros(len(at)), np.zeros(1, dtype=U64)
    while len(seed):
        step += U64(1)
        r = mix(seed + step * _C2)
        u = ((r >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53
        x = x - np.log(u) / (m * length)
        q = mix(r ^ _C3)
        j = ((q & U64(0xFFFFFFFF)) * U64(m) >> U64(32)).astype(np.int64)
        place = lo + ((q >> U64(32)).astype(np.float64) * 2.0**-32 * length)
        cell = own * m + j
        hit = (np.floor(place) < weight) & (x < reg[cell])
        np.minimum.at(reg, cell[hit], x[hit])
        worst = reg.reshape(n, m).max(axis=1)
        go = x < worst[own]
        seed, own, weight, x, lo, length = seed[go], own[go], weight[go], x[go], lo[go], length[go]
    return reg.reshape(n, m)


def band_keys(reg: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each row of registers."""
    bits = np.ascontiguousarray(reg).view(U64).reshape(len(reg), -1)
    key = np.zeros((len(reg), bands), dtype=U64) + np.arange(bands, dtype=U64) * _C3
    for i in range(rows):
        key = mix(key * _C1 + bits[:, i : bands * rows : rows])
    return key


def bag(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct five-word shingles of a whole text, given its hashed words, and how often each occurs."""
    return np.unique(shingle_hashes(words), return_counts=True)


def content_keys(text: str | None, words: np.ndarray) -> tuple[int, int]:
    """128 bits that are equal for texts with the same words; without words, for equal texts. NULL is empty."""
    h = xxhash.xxh3_128_intdigest(words.tobytes() if len(words) else b"\0" + (text or "").encode("utf-8", "surrogatepass"))
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def expanded(elements: np.ndarray, counts: np.ndarray) -> bytes:
    """The multiset as a sorted set of 64-bit hashes of (shingle, occurrence): overlaps of multisets are set overlaps."""
    at = np.repeat(elements, counts)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.unique(mix(at + nth.astype(U64) * _C2)).tobytes()


def overlap(x: np.ndarray, y: np.ndarray) -> float:
    """The weighted Jaccard similarity of two expanded multisets, each sorted and distinct."""
    if not len(x) or not len(y):
        return 0.0
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return both / (len(x) + len(y) - both)


def signed_texts(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, t1, t2 (hashes of the text as it is), k1, k2 (content key) and the band keys of every row.

    A text without words has no bands.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64()))])
    cache = WordHashes()

    def f(c: dict[str, list]) -> dict[str, object]:
        words = [hashed_words(t, cache) for t in c["text"]]
        bags = [bag(w) for w in words]
        keys = [content_keys(t, w) for t, w in zip(c["text"], words, strict=True)]
        sizes = [len(e) for e, _ in bags]
        reg = signatures(np.concatenate([e for e, _ in bags]), np.concatenate([w for _, w in bags]), np.repeat(np.arange(len(bags)), sizes), len(bags), bands * rows)
        band = as_signed(band_keys(reg, bands, rows))
        return {n: c[n] for n in ("doc_id", "t1", "t2")} | {"k1": [k for k, _ in keys], "k2": [k for _, k in keys], "bands": [b.tolist() if n else [] for b, n in zip(band, sizes, strict=True)]}

    return docs.select("doc_id", *text_marks(), "text").mapInArrow(record_batches(f, schema, 256), "doc_id long, t1 long, t2 long, k1 long, k2 long, bands array<long>")


def text_marks() -> list:
    """Two hashes that tell texts apart; NULL has its own."""
    return [F.xxhash64(F.lit(1), "text").alias("t1"), F.xxhash64(F.lit(2), "text").alias("t2")]


def verified(stars: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity of the pairs (centre, rep) whose multiset overlap is at least ``threshold``; a < b.

    A centre's partners are dealt into blocks of about ``BLOCK_ROWS``, and its bag goes to each block once, not to each
    pair. A task reads blocks one after the other, the centre's bag first.
    """
    size = stars.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = stars.join(size, "centre").select("centre", "rep", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"))
    heads = dealt.select("centre", "block").distinct()
    heads = heads.join(bags.withColumnRenamed("rep", "centre"), "centre").select("centre", "block", F.lit(None).cast("long").alias("rep"), "bag")
    rows = heads.unionByName(dealt.join(bags, "rep").select("centre", "block", "rep", "bag"))
    rows = rows.repartition("centre", "block").sortWithinPartitions("centre", "block", F.col("rep").asc_nulls_first())
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(0, U64)
        for batch in (part for whole in batches for part in runs(whole, 4096)):
            found: list[tuple[int, int, float]] = []
            for centre, rep, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                own = np.frombuffer(raw.as_buffer(), U64) if raw.is_valid else np.empty(0, U64)
                if rep is None:
                    held = own.copy()
                elif (s := overlap(held, own)) >= threshold:
                    found.append((min(centre, rep), max(centre, rep), s))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], type=t.type) for k, t in enumerate(schema)], schema=schema)

    return rows.mapInArrow(f, "a long, b long, similarity double")


def block_links(bags: list[bytes], labels: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """Links between rows ``first`` and rows ``second`` with different labels, thinned to a spanning forest.

    Overlaps of all pairs come from products of 0/1 matrices over the tokens that two rows share, some columns at a
    time; the pairs themselves are never listed.
    """
    sets = [np.frombuffer(b, U64) for b in bags]
    size = np.array([len(x) for x in sets], np.float64)
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[at]
    order = np.argsort(column, kind="stable")
    order = order[np.searchsorted(column[order], 0) :]
    column, owner = column[order], owner[order]
    both = np.zeros((len(first), len(second)))
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        both += m[first] @ m[second].T
    union = size[first][:, None] + size[second][None] - both
    hit = (both >= threshold * union) & (both > 0) & (labels[first][:, None] != labels[second][None])
    root = np.arange(len(sets))
    found = []
    for i, j in np.argwhere(hit):
        x, y = first[i], second[j]
        if root[x] != root[y]:
            root[root == root[y]] = root[x]
            found.append((x, y, float(both[i, j] / union[i, j])))
    return found


def blocked_links(members: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity: links between members (band, key, rep, label) of one bucket that have different labels.

    A bucket is dealt by hash into blocks of about ``BLOCK_ROWS`` rows and ``BLOCK_BYTES`` bytes, and each two blocks
    are one task's group, so that a bucket of any size has groups of bounded size, and only links leave them.
    """
    size = members.join(bags.select("rep", F.length("bag").alias("bytes")), "rep").groupBy("band", "key")
    size = size.agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    rows = members.join(size, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("band", "key", "rep", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).join(bags, "rep")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def f(t: pa.Table) -> pa.Table:
        rep, label, block = (t.column(c).to_numpy() for c in ("rep", "label", "block"))
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = block_links(t.column("bag").to_pylist(), label, first, second, threshold) if len(first) and len(second) and label.min() != label.max() else []
        pairs = [(min(rep[x], rep[y]), max(rep[x], rep[y]), s) for x, y, s in found]
        return pa.Table.from_arrays([pa.array([p[k] for p in pairs], type=c.type) for k, c in enumerate(schema)], schema=schema)

    return rows.groupBy("band", "key", "i", "j").applyInArrow(f, "a long, b long, similarity double").dropDuplicates(["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node that can be reached) over the edges (a, b).

    Each round every node takes the smallest label around it, then the label of that label. Rounds end when nothing
    changes; their number grows as the logarithm of the longest path. Each round is written to the shared folder.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = stored(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        discard(labels)
        labels = new
        if new.where("old != label").isEmpty():
            discard(both)
            return labels


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class), class_size and n_links of every row of ``docs``.

    A class is a connected component of links; two texts are linked if their five-word shingle multisets overlap by
    ``threshold`` or more (weighted Jaccard), or if their words are the same. Texts without a word are linked only to
    equal texts; NULL counts as empty. ``n_links`` counts verified links of the row's distinct text to others that
    were needed to find the class. NULL doc_ids and repeated rows are rows of their texts' classes. A class all of whose
    doc_ids are NULL, and a class whose smallest doc_id another class has too (rows of one doc_id with unlike texts),
    take a negative class_id from their smallest content key; among the latter that of the smallest key keeps the doc_id.
    Other columns are ignored, whatever their names; an empty table gives an empty result.

    Copies meet in one aggregation and go on as one representative, named by a number of its own. A band's bucket is a
    star: its smallest and its largest member are compared with the others, so a bucket of n texts gives 2n pairs. Buckets
    whose members end in more than one component are then compared whole, block by block, and only links come out
    (``blocked_links``).
    """
    return classified(docs, threshold, bands, rows).select("doc_id", "class_id", "class_size", "n_links")


def classified(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``near_duplicates`` with t1 and t2 of every row."""
    texts = stored(signed_texts(docs, bands, rows), "signatures")
    reps = texts.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")).alias("row"))
    # Numbers are unique in the table as written, and are read from it ever after.
    reps = stored(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")
    band = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    bucket = band.groupBy("band", "key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last")
    shared = stored(band.join(bucket, ["band", "key"]), "buckets")
    star = shared.select(F.col("first").alias("centre"), "rep").unionByName(shared.where("rep != first").select(F.col("last").alias("centre"), "rep")).where("centre != rep").distinct()
    star = stored(star, "pairs")
    schema = pa.schema([("rep", pa.int64()), ("bag", pa.binary())])
    cache = WordHashes()

    def f(c: dict[str, list]) -> dict[str, object]:
        return {"rep": c["rep"], "bag": [expanded(*bag(hashed_words(t, cache))) for t in c["text"]]}

    # Of each wanted text the row of its smallest doc_id, so copies do not meet in one task; texts are dealt once, whatever
    # their number, and rows equal in all meet where they are.
    key = ["at", "t1", "t2"]
    at = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("at")
    wanted = stored(reps.join(shared.select("rep").distinct(), "rep").select("rep", "row.doc_id", "row.t1", "row.t2").select("rep", at, "t1", "t2"), "wanted")
    marked = docs.select(at, *text_marks(), "text").join(wanted.hint("merge"), key).dropDuplicates(key).select("rep", "text")
    bags = stored(marked.mapInArrow(record_batches(f, schema, 256), "rep long, bag binary"), "bags")
    links = stored(verified(star, bags, threshold).dropDuplicates(["a", "b"]), "links")
    label = components(links)

    member = shared.join(label.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    open_ = member.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("band", "key")
    member = stored(member.join(open_, ["band", "key"]).select("band", "key", "rep", "label"), "open")
    more = stored(blocked_links(member, bags, threshold), "links")
    if not more.isEmpty():
        star_links, links = links, stored(links.unionByName(more).dropDuplicates(["a", "b"]), "links")
        discard(star_links, label)
        label = components(links)

    degree = links.select(F.col("a").alias("rep")).unionAll(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    members = reps.select("k1", "k2", "rep", "copies", "least").join(label.select(F.col("node").alias("rep"), "label"), "rep", "left").join(degree, "rep", "left")
    members = members.select("k1", "k2", "copies", "least", F.coalesce("label", "rep").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    sizes = stored(members.groupBy("label").agg(F.sum("copies").alias("class_size"), F.min("least").alias("least"), F.min(F.struct("k1", "k2")).alias("key")), "sizes")
    owner = sizes.groupBy("least").agg(F.min("key").alias("owner"))
    own = F.col("least").isNotNull() & (F.col("key") == F.col("owner"))
    named = sizes.join(owner.withColumnRenamed("least", "owned"), F.col("least").eqNullSafe(F.col("owned")))
    named = named.select("label", "class_size", F.when(own, F.col("least")).otherwise(-1 - F.xxhash64("key").bitwiseAND((1 << 62) - 1)).alias("class_id"))
    classes = stored(members.join(named, "label").select("k1", "k2", "class_id", "class_size", "n_links"), "classes")
    discard(reps, shared, star, wanted, bags, member, more, links, label, sizes)
    return texts.join(classes, ["k1", "k2"]).select("doc_id", "t1", "t2", "class_id", "class_size", "n_links")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: that with the smallest doc_id (NULL after all others).

    Rows of that doc_id in the class are told apart by their text's hash; of rows equal in doc_id and text, of which a
    class may hold many, any one stays. Columns keep their names, whatever these are; an empty table stays empty.
    """
    rows = classified(docs, threshold).groupBy("class_id", "doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("times"))
    rows = stored(rows, "fates")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    kept = rows.groupBy("class_id").agg(F.min(order).alias("kept"))
    fate = rows.join(kept, "class_id").where((F.col("times") > 1) | (order != F.col("kept"))).select("doc_id", "t1", "t2", order.eqNullSafe(F.col("kept")).alias("stays"))
    # Rows without a fate stay. The list grows with the documents, so it is never sent whole, and plans are alike at all sizes.
    fate = stored(fate.select(*[F.col(c).alias(f"fate_{c}") for c in ("doc_id", "t1", "t2")], "stays"), "fates")
    marks = [F.col("doc_id").alias("own_doc_id"), *(m.alias(f"own_{n}") for m, n in zip(text_marks(), ("t1", "t2"), strict=True))]
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *marks)
    same = [F.col(f"own_{c}").eqNullSafe(F.col(f"fate_{c}")) for c in ("doc_id", "t1", "t2")]
    joined = wrapped.join(fate.hint("merge"), same, "left")
    out = joined.where(F.col("stays").isNull())
    if not fate.where("stays").isEmpty():
        out = out.unionByName(joined.where("stays").dropDuplicates(["own_doc_id", "own_t1", "own_t2"]))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
