"""Benchmark decontamination: shingle lookup for small items, size-partitioned MinHash search for others, verified exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chainlake.llm.common import SHINGLE, THRESHOLD, U64, WordHashes, hashed_words, mix, record_batches, rows_kept, shingle_hashes, table

#: Hash functions of a signature. A window of 2S shingles that holds 0.8 of an item of n is missed with probability 5e-7
#: for n = S and up to 1.2e-3 for n just above S/2; one that holds all of it with 2e-10 and up to 1e-4.
HASHES = 32
#: Items of at most so many distinct shingles are found by shingle lookup, which misses none.
LOOKED_UP = 16
#: Items go through in blocks of at most so many shingles, so what is sent to the tasks is bounded.
BLOCK_SHINGLES = 2_000_000
_C2 = U64(0xD1B54A32D192ED03)


class ItemIndex:
    """A block of items: small ones by shingle, signatures of others, by size class.

    Of an item of n shingles, of which a text must hold k, one of any n - k + 1 is in that text; the item's rarest ones
    are looked up. Items of S/2 < n <= S shingles beyond ``LOOKED_UP`` are looked for in windows of 2S.
    """

    def __init__(self, items: list[tuple[int, str | None]], hashes: int = HASHES, threshold: float = THRESHOLD):
        self.threshold = threshold
        cache = WordHashes()
        self.ids = [i for i, _ in items]
        self.words = [hashed_words(t, cache) for _, t in items]
        self.shingles = [np.unique(shingle_hashes(w)) for w in self.words]
        self.seeds = mix(np.arange(1, hashes + 1, dtype=U64) * _C2)
        #: Items of fewer than five words have one shingle, of their own length, and are looked up as runs of words.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        classes: dict[int, list[int]] = {}
        for i, (w, s) in enumerate(zip(self.words, self.shingles, strict=True)):
            if 0 < len(w) < SHINGLE:
                k, v = self.short.get(len(w), (np.empty(0, U64), np.empty(0, np.int64)))
                self.short[len(w)] = (np.append(k, s[0]), np.append(v, i))
            elif len(w):
                classes.setdefault(1 << int(len(s) - 1).bit_length() if len(s) > LOOKED_UP else 0, []).append(i)
        self.short = {k: (h[o := np.argsort(h)], v[o]) for k, (h, v) in self.short.items()}
        self.rare = self._rare(classes.pop(0, []))
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for size, members in sorted(classes.items()):
            sig = np.array([[mix(self.shingles[i] ^ seed).min() for seed in self.seeds] for i in members], dtype=U64)
            self.classes[size] = [(col[o := np.argsort(col)], np.asarray(members)[o]) for col in sig.T]

    def _rare(self, places: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Shingles to look up, ascending, and the places of their items."""
        own = [self.shingles[i] for i in places]
        _, at, count = np.unique(np.concatenate([np.empty(0, U64), *own]), return_inverse=True, return_counts=True)
        keys, members, done = [np.empty(0, U64)], [np.empty(0, np.int64)], 0
        for i, q in zip(places, own, strict=True):
            n = len(q)
            need = next((k for k in range(1, n) if k / n >= self.threshold), n)
            keys.append(q[np.argsort(count[at[done : done + n]], kind="stable")[: n - need + 1]])
            members.append(np.full(n - need + 1, i))
            done += n
        k, m = np.concatenate(keys), np.concatenate(members)
        return k[o := np.argsort(k)], m[o]

    def candidates(self, s: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Rows (text, item place), distinct: the item shares a looked up shingle with that text or a register with a window of it.

        ``s`` holds the shingles of all texts of a batch, one after the other. A window is two neighbouring blocks.
        """
        full = np.flatnonzero(lengths)
        first = (np.cumsum(lengths) - lengths)[full]
        plans = []
        for size, tables in self.classes.items():
            count = -(-lengths[full] // size)
            owner = np.repeat(np.arange(len(full)), count)
            at = first[owner] + size * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
            more = np.append(owner[1:] == owner[:-1], False)
            plans.append((tables, at, full[owner], more))
        found: list[np.ndarray] = []
        keys, members = self.rare
        if len(keys) and len(full):
            lo = np.searchsorted(keys, s, "left")
            hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == s)
            n = np.searchsorted(keys, s[hit], "right") - lo[hit]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            text = np.searchsorted(np.cumsum(lengths), hit, "right")
            found.append(np.stack([np.repeat(text, n), members[np.repeat(lo[hit], n) + nth]], axis=1))
        for h, seed in enumerate(self.seeds if len(full) and plans else ()):
            x = mix(s ^ seed)
            for tables, at, owner, more in plans:
                low = np.minimum.reduceat(x, at)
                window = np.where(more, np.minimum(low, np.append(low[1:], U64(0))), low)
                keys, members = tables[h]
                lo = np.searchsorted(keys, window, "left")
                hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == window)
                hi = np.searchsorted(keys, window[hit], "right")
                n = hi - lo[hit]
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found.append(np.stack([np.repeat(owner[hit], n), members[np.repeat(lo[hit], n) + nth]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)

    def matches(self, texts: list[np.ndarray]) -> list[tuple[int, int, float]]:
        """(place of the text, item id, share of its shingles that the text holds) with at least the threshold."""
        shingles = [shingle_hashes(w) if len(w) >= SHINGLE else np.empty(0, U64) for w in texts]
        out = []
        held: tuple[int, np.ndarray] = (-1, np.empty(0, U64))
        for t, i in self.candidates(np.concatenate(shingles), np.array([len(x) for x in shingles])).tolist() if texts else ():
            if held[0] != t:
                held = (t, np.unique(shingles[t]))
            q = self.shingles[i]
            at = np.searchsorted(held[1], q)
            share = float((held[1][np.minimum(at, len(held[1]) - 1)] == q).mean())
            if share >= self.threshold:
                out.append((t, self.ids[i], share))
        for k, (keys, members) in self.short.items():
            for t, words in enumerate(texts):
                if len(words) >= k:
                    runs = np.unique(shingle_hashes(words, k))
                    lo, hi = np.searchsorted(keys, runs, "left"), np.searchsorted(keys, runs, "right")
                    out += [(t, self.ids[i], 1.0) for a, b in zip(lo[hi > lo], hi[hi > lo], strict=True) for i in members[a:b]]
        return out


def item_blocks(items: DataFrame, limit: int = BLOCK_SHINGLES):
    """Blocks of (item_id, text) of at most ``limit`` words in all, by ascending id, each read by the driver at once."""
    block, size = [], 0
    for r in items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        n = len((r["text"] or "").split())
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    if block:
        yield block


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, hashes: int = HASHES) -> DataFrame:
    """doc_id, item_id, containment of all pairs in which the document holds ``threshold`` of the item's shingles.

    Whole texts, five-word shingles, sets. An item of one to four words must stand in the document as it is. Items or
    documents without a word (NULL, empty) match nothing. Repeated rows are searched each; repeated items count each.
    The documents are not shuffled; items go through in blocks of bounded size.
    """
    spark = docs.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("containment", pa.float64())])
    out = None
    for block in item_blocks(items):
        sent = spark.sparkContext.broadcast(block)
        built: dict[str, ItemIndex] = {}
        cache = WordHashes()

        def f(c: dict[str, list], sent=sent, built=built, cache=cache) -> dict[str, object]:
            index = built.get("index") or built.setdefault("index", ItemIndex(sent.value, hashes, threshold))
            hits = [(c["doc_id"][t], i, s) for t, i, s in index.matches([hashed_words(t, cache) for t in c["text"]])]
            return dict(zip(schema.names, map(list, zip(*hits, strict=True)), strict=True)) if hits else {n: [] for n in schema.names}

        found = docs.select("doc_id", "text").mapInArrow(record_batches(f, schema), "doc_id long, item_id long, containment double")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, containment double")


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, hashes: int = HASHES) -> DataFrame:
    """``docs`` without the rows that hold an item, in the map stage: no row is shuffled, whatever its other columns.

    Rows without a text stay, and repeated rows stay or go alike. Blocks of items follow each other in one pass.
    """
    for block in item_blocks(items):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        built: dict[str, ItemIndex] = {}
        cache = WordHashes()

        def clean(texts, sent=sent, built=built, cache=cache):
            index = built.get("index") or built.setdefault("index", ItemIndex(sent.value, hashes, threshold))
            out = np.ones(len(texts), bool)
            out[[t for t, _, _ in index.matches([hashed_words(t, cache) for t in texts])]] = False
            return out

        docs = rows_kept(docs, clean, 512)
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
