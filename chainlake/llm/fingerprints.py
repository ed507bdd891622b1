"""SimHash fingerprints: weighted term hashes vote on signed bits; permuted block tables find near fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.llm.common import U64, WordHashes, hashed_words, record_batches, runs, shingle_hashes, stored, table

BITS = 64
RADIUS = 3
BLOCKS = 6
#: A bucket of a block table is compared in blocks of about so many fingerprints.
BUCKET_ROWS = 2048


def votes(text: str | None, cache: WordHashes) -> int:
    """The 64-bit SimHash of a whole text. Terms are its five-word shingles, weighted by how often they occur.

    A text without a word (NULL and empty texts too) is one term: itself. A tie of votes gives a 0 bit.
    """
    terms = shingle_hashes(hashed_words(text, cache))
    if not len(terms):
        return xxhash.xxh3_64_intdigest(text or "")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(terms), 8192):
        part = terms[at : at + 8192]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(terms)).tobytes(), "big")


def likeness(a: int, b: int) -> float:
    """1 for equal fingerprints, 0 for opposite ones."""
    return 1.0 - (a ^ b).bit_count() / BITS


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (64 bits in a long) of every row's whole ``text``; other columns are ignored."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.int64())])
    cache = WordHashes()

    def f(c: dict[str, list]) -> dict[str, object]:
        return {"doc_id": c["doc_id"], "fingerprint": np.array([votes(t, cache) for t in c["text"]], dtype=U64).view(np.int64)}

    return docs.select("doc_id", "text").mapInArrow(record_batches(f, schema), "doc_id long, fingerprint long")


def masks_of(radius: int, blocks: int) -> tuple[list[int], list[int]]:
    """The bits of each block, and those of each table: ``blocks - radius`` blocks."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("0 <= radius < blocks <= 64 is needed")
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [(((1 << (hi - lo)) - 1) << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    return masks, [sum(masks[b] for b in c) for c in combinations(range(blocks), blocks - radius)]


def block_tables(df: DataFrame, name: str, radius: int, blocks: int) -> DataFrame:
    """The distinct fingerprints, as ``name``, in each table t under the bits that it is looked up by."""
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks_of(radius, blocks)[1]]
    one = df.select(F.col("fingerprint").alias(name)).where(F.col(name).isNotNull()).distinct()
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col(name).bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)])
    return one.select(name, F.explode(keys).alias("k")).select(name, "k.t", "k.bits")


def near_fingerprints(queries: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs (query_fp, near_fp, distance) of distinct fingerprints within ``radius`` bits.

    Two fingerprints that differ in at most ``radius`` bits agree in ``blocks - radius`` of the blocks. There is one
    table for each choice of those blocks; its key is their bits, so a lookup is an equality join and none is missed.
    Both sides are made distinct first: copies of a document cost nothing. The result is as large as the queries have
    near fingerprints; ``near_counts`` counts without listing. NULL fingerprints are near nothing; an empty side gives an
    empty result; other columns are ignored.
    """
    pairs = block_tables(queries, "query_fp", radius, blocks).join(block_tables(index, "near_fp", radius, blocks), ["t", "bits"])
    distance = F.bit_count(F.col("query_fp").bitwiseXOR(F.col("near_fp")))
    return pairs.withColumn("distance", distance).where((F.col("distance") <= radius) & (F.col("query_fp") != F.col("near_fp"))).select("query_fp", "near_fp", "distance").distinct()


def block_counts(fps: np.ndarray, first: np.ndarray, second: np.ndarray, t: int, radius: int, masks: list[int], chosen: list[int]) -> np.ndarray:
    """For each of ``fps`` how many others are within the radius and agree in table ``t`` and in none before it.

    ``first`` and ``second`` are the places of a bucket's two blocks, of which each pair counts once on either side.
    """
    x = fps[first][:, None] ^ fps[second][None]
    near = np.bitwise_count(x) <= radius
    near &= x != 0
    for m in chosen[:t]:
        near &= (x & U64(m)) != 0
    counts = np.zeros(len(fps), np.int64)
    np.add.at(counts, first, near.sum(axis=1))
    if first is not second:
        np.add.at(counts, second, near.sum(axis=0))
    return counts


def near_counts(index: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """fingerprint and n_near of each distinct fingerprint that has others within ``radius`` bits.

    The same tables as in ``near_fingerprints``, each against itself. A bucket is dealt by hash into blocks of about
    ``BUCKET_ROWS`` and each two blocks are one bounded piece of work, from which counts come out and no pairs; a pair is
    counted in the first table that it agrees in. NULL fingerprints are near nothing; an empty table gives an empty one.
    """
    masks, chosen = masks_of(radius, blocks)
    held = block_tables(index, "fp", radius, blocks)
    size = held.groupBy("t", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "bits", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("parts"))
    rows = held.join(size, ["t", "bits"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("t", "bits", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "fp")
    rows = rows.repartition("t", "bits", "i", "j").sortWithinPartitions("t", "bits", "i", "j")
    schema = pa.schema([("fingerprint", pa.int64()), ("n", pa.int64())])

    def counted(group: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        fps, part = group["fp"].view(U64), group["part"]
        i, j = group["i"][0], group["j"][0]
        first = np.flatnonzero(part == i)
        n = block_counts(fps, first, first if i == j else np.flatnonzero(part == j), int(group["t"][0]), radius, masks, chosen)
        return group["fp"][n > 0], n[n > 0]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def groups() -> Iterator[dict[str, np.ndarray]]:
            """Groups of equal keys; the last one of a batch may go on in the next."""
            nonlocal held
            for batch in batches:
                new = {n: batch.column(i).to_numpy() for i, n in enumerate(batch.schema.names)}
                held = {n: np.concatenate([held[n], v]) for n, v in new.items()} if held else new
                ends = np.flatnonzero(np.any([held[k][1:] != held[k][:-1] for k in ("t", "bits", "i", "j")], axis=0)) + 1
                for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False):
                    yield {n: v[a:b] for n, v in held.items()}
                if len(ends):
                    held = {n: v[ends[-1] :] for n, v in held.items()}
            if held and len(held["fp"]):
                yield held

        fps, ns, size = [], [], 0
        for group in groups():
            fp, n = counted(group)
            fps.append(fp)
            ns.append(n)
            size += len(fp)
            if size >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(fps)), pa.array(np.concatenate(ns))], schema=schema)
                fps, ns, size = [], [], 0
        if fps:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(fps)), pa.array(np.concatenate(ns))], schema=schema)

    return rows.mapInArrow(f, "fingerprint long, n long").groupBy("fingerprint").agg(F.sum("n").alias("n_near"))


#: What ``with_edits`` finds for a document, and of the ends of a task's range the document itself.
_EDITS = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fp", pa.int64()), ("edited_fp", pa.int64()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("end", pa.int32()), ("text", pa.string())]
)
_EDITS_DDL = "doc_id long, n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, near_next double, part int, end int, text string"


def edit(doc_id: int | None, text: str, fp: int, after: str, next_fp: int, cache: WordHashes) -> tuple:
    """The row of one document, given the one after it."""
    n = len(text)
    edited = text[: n - n // 4] + after[: n // 4]
    edited_fp = votes(edited, cache)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, n, sha, fp - (fp >> 63 << 64), edited_fp - (edited_fp >> 63 << 64), likeness(fp, edited_fp), likeness(fp, next_fp), None, None, None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(_EDITS)], schema=_EDITS)


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last quarter comes from the next document.

    Documents are in the order of doc_id; rows with NULL doc_id come first; rows of equal doc_id follow by a hash of their
    text, then by text. After the last comes the first; a lone document is its own successor. NULL texts are empty. Other
    columns are ignored, whatever their names; an empty table gives an empty result.

    Spark deals ranges of that order to tasks and sorts them, so texts are shuffled once. A task hands out its first and
    last document besides; two such documents a task are joined with those of the tasks beside it.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    # NULL ids sort before every other id.
    ordered = docs.select(F.col("doc_id").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    dealt = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("mark")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "mark", "text")
    dealt = dealt.select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        rows: list[tuple] = []
        last = None
        for batch in (x for whole in batches for x in runs(whole, 256)):
            for doc_id, text, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fp = votes(text, cache)
                if last is None:
                    rows.append((doc_id, None, None, None, None, None, None, part, 0, text))
                else:
                    rows.append(edit(*last, text, fp, cache))
                last = (doc_id, text, fp)
            yield _batch(rows)
            rows.clear()
        if last is not None:
            yield _batch([(last[0], None, None, None, None, None, None, part, 1, last[1])])

    found = stored(dealt.mapInArrow(run, _EDITS_DDL), "edits")
    inner, ends = found.where("end IS NULL"), found.where("end IS NOT NULL")
    # Two short rows a task. The last document of a task is followed by the first of the next task that has any.
    parts = sorted({r["part"] for r in ends.select("part").collect()})
    after = dict(zip(parts, [*parts[1:], *parts[:1]], strict=True))
    follows = spark.createDataFrame(list(after.items()), "part int, next_part int")
    lasts = ends.where("end = 1").select("doc_id", "text", "part").join(follows, "part")
    heads = ends.where("end = 0").select(F.col("part").alias("next_part"), F.col("text").alias("after"))

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in (x for whole in batches for x in runs(whole, 64)):
            yield _batch([edit(i, t, votes(t, cache), a, votes(a, cache), cache) for i, t, a in zip(*(c.to_pylist() for c in batch.columns), strict=True)])

    crossing = lasts.join(heads, "next_part").select("doc_id", "text", "after").mapInArrow(join_ends, _EDITS_DDL)
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return inner.unionByName(crossing).select("doc_id", "n_chars", "edited_sha256", digits("fp").alias("fingerprint"), digits("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "fp")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With n_near: how many other distinct fingerprints of the table are within the radius of the document's own."""
    found = stored(with_edits(table(spark, sf_dir, "documents")), "fingerprints")
    near = near_counts(found.select(F.col("fp").alias("fingerprint"))).withColumnRenamed("fingerprint", "fp")
    return found.join(near, "fp", "left").drop("fp").withColumn("n_near", F.coalesce("n_near", F.lit(0)))
