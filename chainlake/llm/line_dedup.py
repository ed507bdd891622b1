"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts of line keys.

The state is three tables. ``postings``: (k1, k2, doc_id), each long line's 128-bit key in each document that holds it.
``refs``: per key the exact number of documents and the largest doc_id. ``filters``: per shard of the key space a
cuckoo filter of the keys that reach the least number of documents. A line is looked up in the filter first; only
lines that it may hold go on to the exact counts, so a false positive never drops a line. Inserting documents raises
counts, deleting them lowers counts, and keys that cross the limit enter or leave the filters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.llm.common import U64, discard, mix, record_batches, stored, table

MIN_CHARS, MIN_DOCS = 40, 5
SPACE = b" \t\n\x0b\x0c\r"
#: A shard's filter has at most so many keys before there are more shards; a task looks up about so many postings of a shard.
SHARD_KEYS, SHARD_POSTINGS = 16_384, 1 << 20


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key's second bucket is its first xor a hash of the fingerprint."""

    SLOTS, KICKS = 4, 500

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of 2")
        self.buckets = buckets
        self.slots = np.zeros((buckets, self.SLOTS), np.uint16) if slots is None else slots

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(1, int(np.ceil(np.log2(max(1, keys) / (cls.SLOTS * 0.8))))))

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        slots = np.frombuffer(raw, np.uint16).reshape(-1, cls.SLOTS).copy()
        return cls(len(slots), slots)

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys.astype(np.int64).view(U64))
        f = np.maximum((h >> U64(48)).astype(np.uint16), np.uint16(1))
        one = (h & U64(self.buckets - 1)).astype(np.int64)
        return f, one, one ^ self._jump(f)

    def _jump(self, f: np.ndarray) -> np.ndarray:
        return (mix(f.astype(U64)) & U64(self.buckets - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        f, one, two = self._places(keys)
        return (self.slots[one] == f[:, None]).any(axis=1) | (self.slots[two] == f[:, None]).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if there was no room for all; the filter must then be built anew, larger."""
        rng = np.random.default_rng(len(keys))
        for f, one, two in zip(*self._places(keys), strict=True):
            for at in (one, two):
                free = np.flatnonzero(self.slots[at] == 0)
                if len(free):
                    self.slots[at, free[0]] = f
                    break
            else:
                at = two
                for _ in range(self.KICKS):
                    s = rng.integers(self.SLOTS)
                    f, self.slots[at, s] = self.slots[at, s], f
                    at = at ^ int(self._jump(np.array([f]))[0])
                    free = np.flatnonzero(self.slots[at] == 0)
                    if len(free):
                        self.slots[at, free[0]] = f
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Takes one copy of each key's fingerprint out; the keys must have been inserted."""
        for f, one, two in zip(*self._places(keys), strict=True):
            for at in (one, two):
                held = np.flatnonzero(self.slots[at] == f)
                if len(held):
                    self.slots[at, held[0]] = 0
                    break


def line_key(line: bytes) -> tuple[int, int] | None:
    """The key of one line (UTF-8), None if the stripped line has under 40 code points."""
    line = line.strip(SPACE)
    if len(line) < MIN_CHARS or len(line) < 4 * MIN_CHARS and len(line) - sum(b & 0xC0 == 0x80 for b in line) < MIN_CHARS:
        return None
    h = xxhash.xxh3_128_intdigest(line.lower())  # of bytes: A-Z alone change
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def own_id() -> Column:
    """doc_id; a row without one is a document of its own, told apart by its text, with an id below -2**62."""
    return F.coalesce("doc_id", F.lit(-(1 << 63)) + F.xxhash64("text").bitwiseAND((1 << 62) - 1))


def postings_of(docs: DataFrame) -> DataFrame:
    """Distinct (k1, k2, doc_id) of the long lines of every row."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64())])

    def f(c: dict[str, list]) -> dict[str, object]:
        rows = [(*k, d) for d, t in zip(c["doc_id"], c["text"], strict=True) for k in {line_key(x) for x in lines_of(t)} - {None}]
        return dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in schema.names}

    return docs.select(own_id().alias("doc_id"), "text").mapInArrow(record_batches(f, schema), "k1 long, k2 long, doc_id long")


@dataclass
class LineStore:
    """The state after some inserts and deletions. Updates give a new store; the old one stays as it was."""

    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int = MIN_DOCS

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = MIN_DOCS) -> LineStore:
        """A store of all of ``docs``: the insertion of all into an empty store."""
        spark = docs.sparkSession
        empty = spark.createDataFrame([], "k1 long, k2 long, doc_id long")
        refs = spark.createDataFrame([], "k1 long, k2 long, n_docs long, keeper long")
        filters = spark.createDataFrame([], "shard int, slots binary")
        return cls(empty, refs, filters, 0, min_docs).insert(docs)

    def insert(self, docs: DataFrame) -> LineStore:
        """Documents whose ids are in the store already add only their new lines."""
        new = postings_of(docs).distinct()
        new = stored(new.join(self.postings, ["k1", "k2", "doc_id"], "left_anti") if self.shards else new, "new-lines")
        delta = new.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("more"), F.max("doc_id").alias("last"))
        if not self.shards:
            refs = stored(delta.select("k1", "k2", F.col("more").alias("n_docs"), F.col("last").alias("keeper")), "refs")
            return self._after(new, refs)
        refs = self.refs.join(delta, ["k1", "k2"], "full").select(
            "k1", "k2", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("keeper", "last").alias("keeper")
        )
        refs = stored(refs, "refs")
        postings = stored(self.postings.unionByName(new), "postings")
        discard(new)
        return self._after(postings, refs)

    def delete(self, doc_ids: DataFrame) -> LineStore:
        """``doc_ids`` has a column doc_id; ids that the store does not hold, and NULL, change nothing.

        Rows inserted without an id go by the id that ``own_id`` gave them.
        """
        ids = doc_ids.select("doc_id").distinct()
        gone = stored(self.postings.join(ids, "doc_id", "left_semi"), "gone-lines")
        postings = stored(self.postings.join(ids, "doc_id", "left_anti").select("k1", "k2", "doc_id"), "postings")
        touched = gone.select("k1", "k2").distinct()
        anew = postings.join(touched, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        refs = stored(self.refs.join(touched, ["k1", "k2"], "left_anti").unionByName(anew), "refs")
        discard(gone)
        return self._after(postings, refs)

    def _after(self, postings: DataFrame, refs: DataFrame) -> LineStore:
        """The store with these postings and counts. Filters that would pass ``SHARD_KEYS`` are built anew, in more shards."""
        hot = refs.where(F.col("n_docs") >= self.min_docs).count()
        if not self.shards or hot > self.shards * SHARD_KEYS:
            shards = max(1, -(-hot // (SHARD_KEYS // 2)))
            return LineStore(postings, refs, self._updated(self.filters.limit(0), refs, None, shards), shards, self.min_docs)
        return LineStore(postings, refs, self._updated(self.filters, refs, self.refs, self.shards), self.shards, self.min_docs)

    def _shard(self, shards: int):
        return F.pmod(F.col("k1"), F.lit(shards)).cast("int").alias("shard")

    def _updated(self, filters: DataFrame, refs: DataFrame, before: DataFrame | None, shards: int) -> DataFrame:
        """``filters`` with the keys that reached the limit put in and those that fell below it taken out."""
        limit = self.min_docs
        now = refs.where(F.col("n_docs") >= limit).select("k1", "k2", F.lit(1).alias("now"))
        if before is None:
            was = now.limit(0).select("k1", "k2", F.col("now").alias("was"))
        else:
            was = before.where(F.col("n_docs") >= limit).select("k1", "k2", F.lit(1).alias("was"))
        keys = now.join(was, ["k1", "k2"], "full").select(self._shard(shards), "k2", "now", "was")

        def update(held: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            if not len(keys) and not len(held):
                return pd.DataFrame({"shard": [], "slots": []})
            shard = int(keys["shard"].iloc[0] if len(keys) else held["shard"].iloc[0])
            now, was = keys["now"].notna().to_numpy(), keys["was"].notna().to_numpy()
            k = keys["k2"].to_numpy(np.int64)
            filt, ok = CuckooFilter.from_bytes(held["slots"].iloc[0]) if len(held) else CuckooFilter.sized(int(now.sum())), True
            filt.delete(k[was & ~now])
            ok = filt.insert(k[now & ~was])
            size = filt.buckets
            while not ok:  # no room left: twice as large, from the exact counts
                size *= 2
                filt = CuckooFilter(size)
                ok = filt.insert(k[now])
            return pd.DataFrame({"shard": [shard], "slots": [filt.to_bytes()]})

        found = filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(update, "shard int, slots binary")
        return stored(found, "filters")

    def maybe_repeated(self, postings: DataFrame) -> DataFrame:
        """``postings`` without the rows that the filters rule out.

        Each shard's postings are dealt by doc_id into parts of about ``SHARD_POSTINGS``, and a part gets its shard's filter
        and then the postings, so that filters of any total size meet postings of any number, and a hot line is spread.
        """
        shard = self._shard(self.shards)
        rows = postings.select("k1", "k2", "doc_id", shard)
        parts = rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SHARD_POSTINGS).cast("int").alias("parts"))
        none = lambda t, n: F.lit(None).cast(t).alias(n)
        sent = self.filters.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), none("long", "k1"), none("long", "k2"), none("long", "doc_id"), "slots")
        asked = rows.join(parts, "shard").select("shard", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), "k1", "k2", "doc_id", none("binary", "slots"))
        both = sent.unionByName(asked).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("k2").asc_nulls_first())

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, filt = None, None
            for batch in batches:
                shard, part = batch.column("shard").to_numpy(), batch.column("part").to_numpy()
                cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(part) != 0)) + 1).tolist(), batch.num_rows]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    group = batch.slice(lo, hi - lo)
                    if hi > lo and (key := (shard[lo], part[lo])) != at:
                        at = key
                        raw = group.column("slots")[0]
                        filt = CuckooFilter.from_bytes(raw.as_buffer()) if raw.is_valid else None
                        group = group.slice(1 if filt else 0)
                    if filt is not None and group.num_rows:
                        k2 = group.column("k2").to_numpy()
                        yield group.select(["k1", "k2", "doc_id"]).filter(pa.array(filt.contains(k2)))

        return both.mapInArrow(f, "k1 long, k2 long, doc_id long")

    def drops(self) -> DataFrame:
        """doc_id and ``keys``, the keys whose lines the document loses."""
        hot = self.refs.where(F.col("n_docs") >= self.min_docs).select("k1", "k2", "keeper")
        lost = self.maybe_repeated(self.postings).join(hot, ["k1", "k2"]).where("doc_id != keeper")
        return lost.groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("keys"))


def deduped(docs: DataFrame, store: LineStore) -> DataFrame:
    """doc_id, n_lines, n_dropped and ``kept`` (the text without the dropped lines) of every row of ``docs``.

    A NULL or empty text is one empty line. Rows of equal doc_id are one document with the lines of all; rows without a
    doc_id are documents of their own, told apart by their text, below all ids. The dropped keys of a document are at most
    its lines. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])

    def f(c: dict[str, list]) -> dict[str, object]:
        out: dict[str, list] = {n: [] for n in schema.names}
        for doc_id, text, keys in zip(c["doc_id"], c["text"], c["keys"], strict=True):
            lines = lines_of(text)
            gone = {(k["k1"], k["k2"]) for k in keys or ()}
            kept = [x for x in lines if line_key(x) not in gone] if gone else lines
            for n, v in zip(schema.names, (doc_id, len(lines), len(lines) - len(kept), b"\n".join(kept).decode("utf-8", "surrogatepass")), strict=True):
                out[n].append(v)
        return out

    rows = docs.select("doc_id", "text", own_id().alias("at")).join(store.drops().withColumnRenamed("doc_id", "at"), "at", "left").select("doc_id", "text", "keys")
    return rows.mapInArrow(record_batches(f, schema), "doc_id long, n_lines long, n_dropped long, kept string")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return deduped(docs, LineStore.build(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), k AS (
  SELECT doc_id, line, i, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), hot AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), said AS (
  SELECT doc_id, line, i, hot.key IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN hot USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM said GROUP BY doc_id"""
