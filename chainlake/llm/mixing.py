"""Mixing sources to target weights: fixed-length blocks of words, multinomial counts per output shard, index permutations.

A source's words are packed into blocks of ``BLOCK_WORDS``; only its last block is shorter. The mix is a row of slots, cut
into shards of ``SHARD_SLOTS``. Each shard's count of slots of each source is a seeded multinomial draw by the sources'
shares. The slots that a source was drawn above its target are then dealt to the sources drawn below theirs, so the sums
are the targets. Slot i of a source holds the block that the source's Feistel permutation gives for i mod (its number of
blocks), and blocks are joined to slots by that index.

Everything runs on DataFrame functions. One row per source reaches the driver: sources are a catalogue, of at most some
thousands, and stand in the plan as literals.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlake.llm.common import n_partitions, stored, table

TOKEN = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: Words in a block and slots in an output shard, of whatever input.
BLOCK_WORDS, SHARD_SLOTS = 256, 256
#: Shards that are summed together before their sums are.
SHARD_GROUP = 4096
#: Rounds of a permutation and the prime that its round functions work by.
ROUNDS, PRIME = 6, (1 << 31) - 1


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Shares of ``share`` times all sizes by weight, none above ``most`` times its size.

    What a source cannot take is dealt to those below their bound by weight, until none is above.
    """
    goal = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                goal[i] = left * weights[i] / total
            break
        for i in full:
            goal[i] = most * sizes[i]
        left -= sum(goal[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return goal


class Permutation:
    """A pseudorandom permutation of 0 to n-1: a Feistel network over pairs (l < a, r < b) with a * b just above n.

    Rounds add, in turn, a function of r to l (mod a) and of l to r (mod b). An index that leaves the range is put through
    again until it is back (cycle walking). Fewer than ``a`` pairs lie outside, so the longest walk is found beforehand
    and ``index`` needs no open-ended loop.
    """

    def __init__(self, n: int, key: int):
        self.n = max(1, n)
        self.a = math.isqrt(self.n - 1) + 1
        self.b = -(-self.n // self.a)
        rng = np.random.default_rng(key)
        self.keys = [tuple(int(x) for x in rng.integers(1, PRIME, 3)) for _ in range(ROUNDS)]
        outside = np.arange(self.n, self.a * self.b)
        # What the range is sent to outside; from there every walk leads back.
        outside = outside[self.undo(outside) < self.n]
        self.walks = 1
        while len(outside):
            self.walks += 1
            outside = self.once(outside)
            outside = outside[outside >= self.n]

    def _f(self, x, key):
        m, c, d = key
        y = (x * m + c) % PRIME
        return (y * y % PRIME * d + m) % PRIME

    def once(self, x):
        """One pass of the network over integers or arrays of them."""
        left, right = x // self.b, x % self.b
        for j, key in enumerate(self.keys):
            if j % 2:
                right = (right + self._f(left, key)) % self.b
            else:
                left = (left + self._f(right, key)) % self.a
        return left * self.b + right

    def undo(self, x):
        left, right = x // self.b, x % self.b
        for j, key in reversed(list(enumerate(self.keys))):
            if j % 2:
                right = (right - self._f(left, key)) % self.b
            else:
                left = (left - self._f(right, key)) % self.a
        return left * self.b + right

    def at(self, i: int) -> int:
        x = self.once(i)
        while x >= self.n:
            x = self.once(x)
        return x

    def where(self, block: int) -> int:
        """The index whose image is ``block``."""
        x = self.undo(block)
        while x >= self.n:
            x = self.undo(x)
        return x


def permuted(i: Column, a: Column, b: Column, n: Column, keys: Column, walks: int) -> Column:
    """``Permutation.at`` as an expression; a, b, n and the keys belong to the row's source."""

    def f(x: Column, k: Column) -> Column:
        y = (x * k["m"] + k["c"]) % PRIME
        return F.transform(F.array(y), lambda v: (v * v % PRIME * k["d"] + k["m"]) % PRIME)[0]

    def round_(s: Column, k: Column) -> Column:
        odd = k["j"] % 2 == 1
        left = F.when(odd, s["l"]).otherwise((s["l"] + f(s["r"], k)) % a)
        right = F.when(odd, (s["r"] + f(s["l"], k)) % b).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    def once(x: Column) -> Column:
        start = F.struct(F.floor(x / b).cast("bigint").alias("l"), (x % b).alias("r"))
        return F.aggregate(keys, start, round_, lambda s: s["l"] * b + s["r"])

    again = F.sequence(F.lit(1), F.lit(walks))
    # The first pass is taken whatever the index, others only from outside the range.
    return F.aggregate(again, i.cast("bigint"), lambda x, step: F.when((step > 1) & (x < n), x).otherwise(once(x)))


def sized(docs: DataFrame, *others: Column) -> DataFrame:
    """A stored table row, doc_id, source, size, mark (a hash of the text) and ``others`` of every row; NULL texts have size 0."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TOKEN)).cast("long")
    return stored(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("mark"), *others).withColumn("row", F.monotonically_increasing_id()), "mixing")


def plan(table: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: int) -> list[dict]:
    """One entry per source, by code point and NULL last: size, rows, target, words (the target in whole words, at most ``most``
    times the size), blocks, slots, words of the last slot, permutation and the source's place."""
    found = table.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    goal = targets([r["size"] for r in found], [weights[i % len(weights)] for i in range(len(found))], share, most)
    out, first = [], 0
    for i, r in enumerate(found):
        size, n = r["size"], -(-r["size"] // BLOCK_WORDS)
        words = min(round(goal[i]), math.floor(most * size))
        order = Permutation(n, seed * 1_000_003 + i)
        passes, rest = divmod(words, size) if size else (0, 0)
        # Slots of the last pass: all blocks are whole but the last, which has the slot ``short``.
        tail, short = size - (n - 1) * BLOCK_WORDS, order.where(n - 1) if n else 0
        before = lambda k, tail=tail, short=short: k * BLOCK_WORDS - (BLOCK_WORDS - tail) * (k > short)
        more = -(-rest // BLOCK_WORDS)
        more += before(more) < rest
        slots = passes * n + more
        last = rest - before(more - 1) if more else (tail if n and order.at(n - 1) == n - 1 else BLOCK_WORDS)
        out.append({"source": r["source"], "rows": r["rows"], "size": size, "target": goal[i], "words": words, "n": n, "slots": slots, "last": last, "first": first, "order": order})
        first += slots
    return out


def of(sources: list[dict], what: str, index: Column, kind: str = "bigint") -> Column:
    """The value of the source with that place."""
    return F.element_at(F.array(*[F.lit(s[what]).cast(kind) for s in sources]), (index + 1).cast("int"))


def placed(table: DataFrame, sources: list[dict]) -> DataFrame:
    """``table`` with ``place``, its source's place. The catalogue is a range, so the planner knows its size."""
    names = F.array(*[F.lit(s["source"]).cast("string") for s in sources]) if sources else F.array(F.lit(None).cast("string"))
    known = table.sparkSession.range(len(sources)).select(F.get(names, F.col("id").cast("int")).alias("source_name"), F.col("id").cast("int").alias("place"))
    return table.join(known, table["source"].eqNullSafe(known["source_name"])).drop("source_name")


def found_in(x: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most x, by halving."""

    def find(lo: int, hi: int) -> Column:
        mid = (lo + hi) // 2
        return F.lit(lo) if lo == hi else F.when(x < F.lit(bounds[mid]), find(lo, mid)).otherwise(find(mid + 1, hi))

    return find(0, len(bounds))


def drawn(spark: SparkSession, sources: list[dict], seed: int) -> DataFrame:
    """shard, place, count: each shard's multinomial draw of ``SHARD_SLOTS`` slots (the last shard: of the rest).

    Every slot of a shard draws a source with probability by its share of all slots, from a hash of the seed and the slot.
    """
    total = sum(s["slots"] for s in sources)
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(max(total, 1)))
    slot = spark.range(total).select(F.floor(F.col("id") / SHARD_SLOTS).cast("bigint").alias("shard"), found_in(u, [s["first"] for s in sources[1:]]).alias("place"))
    return slot.groupBy("shard", "place").agg(F.count(F.lit(1)).alias("count"))


def slots_of(spark: SparkSession, sources: list[dict], seed: int) -> DataFrame:
    """shard, place, i (the source's slot), block, pass and words of every slot of the mix.

    Shards hold what they drew. A source's slots are numbered through its shards. Where the draw gave a source more slots
    than its target has, those beyond go to the sources that were given fewer.
    """
    counts = stored(drawn(spark, sources, seed).withColumn("set", F.floor(F.col("shard") / SHARD_GROUP).cast("bigint")), "draw")
    sums = counts.groupBy("place", "set").agg(F.sum("count").alias("n"))
    totals = {r["place"]: r["n"] for r in sums.groupBy("place").agg(F.sum("n").alias("n")).collect()}
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("place", "set", F.coalesce(F.sum("n").over(earlier("place", "set")), F.lit(0)).alias("set_start"))
    numbered = counts.withColumn("inside", F.coalesce(F.sum("count").over(earlier("place", "set", "shard")), F.lit(0))).join(sums, ["place", "set"])
    numbered = numbered.withColumn("from", F.col("set_start") + F.col("inside"))
    slot = numbered.select("shard", "place", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("count") - 1)).alias("i"))
    if not sources:
        none = F.lit(0).cast("long")
        return slot.select("shard", "place", "i", none.alias("block"), none.alias("pass"), none.alias("words"))

    over = [max(0, totals.get(k, 0) - s["slots"]) for k, s in enumerate(sources)]
    under = [max(0, s["slots"] - totals.get(k, 0)) for k, s in enumerate(sources)]
    before = lambda v: [sum(v[:k]) for k in range(len(v))]
    fixed = [{"drawn": totals.get(k, 0), "over": a, "under": b} for k, (a, b) in enumerate(zip(before(over), before(under), strict=True))]
    rank = of(fixed, "over", F.col("place")) + F.col("i") - of(sources, "slots", F.col("place"))
    slot = slot.withColumn("rank", F.when(F.col("i") >= of(sources, "slots", F.col("place")), rank))
    ends = [a + b for a, b in zip(before(under), under, strict=True)][:-1]
    slot = slot.withColumn("to", F.when(F.col("rank").isNotNull(), found_in(F.col("rank"), ends)))
    slot = slot.withColumn("i", F.when(F.col("to").isNull(), F.col("i")).otherwise(of(fixed, "drawn", F.col("to")) + F.col("rank") - of(fixed, "under", F.col("to"))))
    slot = slot.withColumn("place", F.coalesce("to", "place"))

    orders = [{"a": s["order"].a, "b": s["order"].b, "n": s["order"].n} for s in sources]
    key = lambda s: F.array(*[F.struct(F.lit(j).alias("j"), *[F.lit(v).cast("bigint").alias(c) for c, v in zip("mcd", k, strict=True)]) for j, k in enumerate(s["order"].keys)])
    keys = F.element_at(F.array(*[key(s) for s in sources]), F.col("place") + 1)
    slot = slot.withColumns({c: of(orders, c, F.col("place")) for c in "abn"}).withColumn("keys", keys)
    block = permuted(F.col("i") % F.col("n"), F.col("a"), F.col("b"), F.col("n"), F.col("keys"), max(s["order"].walks for s in sources))
    words = F.when(F.col("i") == of(sources, "slots", F.col("place")) - 1, of(sources, "last", F.col("place"))).otherwise(F.lit(BLOCK_WORDS))
    return slot.select("shard", "place", "i", block.alias("block"), F.floor(F.col("i") / F.col("n")).cast("long").alias("pass"), words.alias("words"))


def located(rows: DataFrame, sources: list[dict]) -> DataFrame:
    """Rows with place, each with its start among its source's words.

    A source's rows are dealt to buckets by a hash of doc_id and text, in number as the source has rows, and summed in two
    levels (in a bucket, and over the buckets' totals), so a source or a doc_id with a third of all rows is spread over
    many tasks. The order stands on doc_id and text alone; only rows equal in both are interchangeable.
    """
    total = sum(s["rows"] for s in sources)
    each = max(1, total // (2 * n_partitions(rows.sparkSession)))
    buckets = [{"k": max(1, s["rows"] // each)} for s in sources] or [{"k": 1}]
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(5), "doc_id", "mark"), of(buckets, "k", F.col("place"))))
    sums = rows.groupBy("place", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("place", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("bucket_start"))
    inside = Window.partitionBy("place", "bucket").orderBy("doc_id", "mark", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(sums, ["place", "bucket"]).withColumn("start", F.col("bucket_start") + F.col("inside")).drop("bucket", "bucket_start", "inside")


def pieces(rows: DataFrame) -> DataFrame:
    """place, block, row, the words lo to hi of the document that lie in that block, and where in it they start."""
    first, last = F.floor(F.col("start") / BLOCK_WORDS), F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS)
    cut = rows.where("size > 0").select("row", "place", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    at = F.col("block") * BLOCK_WORDS - F.col("start")
    return cut.select("place", "block", "row", F.greatest(at, F.lit(0)).alias("lo"), F.least(at + BLOCK_WORDS, F.col("size")).alias("hi"), F.greatest(-at, F.lit(0)).alias("at"))


def mix(rows: DataFrame, sources: list[dict], seed: int) -> DataFrame:
    """The mix: shard, place, i, block, pass, and of each document in that slot ``row`` and its words lo to hi."""
    slots = slots_of(rows.sparkSession, sources, seed)
    # Neither side is ever sent whole: both grow with the words.
    joined = pieces(located(rows, sources)).join(slots.hint("merge"), ["place", "block"])
    joined = joined.withColumn("hi", F.least("hi", F.col("lo") + F.col("words") - F.col("at"))).where("hi > lo")
    return joined.select("shard", "place", "i", "block", "pass", "row", "lo", "hi", "at")


def mixed_blocks(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11) -> DataFrame:
    """The mix as output shards hold it: shard, slot (its order there), source, pass, doc_id, lo, hi, at.

    A row is the words lo to hi of a document, which stand from word ``at`` of a slot's block. Slots of a shard are in a
    pseudorandom order. NULL texts and texts without words are in no block.
    """
    table = sized(docs)
    sources = plan(table, weights, share, most, seed)
    found = mix(placed(table, sources), sources, seed).join(table.select("row", "doc_id", "source"), "row")
    return found.select("shard", F.xxhash64(F.lit(seed), "place", "i").alias("slot"), "source", "pass", "doc_id", "lo", "hi", "at")


def taken_words(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target, taken and shards (that hold some of it) of every row of ``docs``.

    NULL texts have size 0; a NULL source is a source, the last. Repeated rows each have their own place. An empty
    table gives an empty result. Other columns are ignored.
    """
    table = sized(docs)
    sources = plan(table, weights, share, most, seed)
    rows = placed(table, sources)
    words = mix(rows, sources, seed).groupBy("row", "shard").agg(F.sum(F.col("hi") - F.col("lo")).alias("n"))
    words = words.groupBy("row").agg(F.sum("n").alias("taken"), F.count(F.lit(1)).alias("shards"))
    known = sources or [{"size": 0, "target": 0.0}]
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(words, "row", "left").select("doc_id", "size", of(known, "size", F.col("place")).alias("source_size"), of(known, "target", F.col("place"), "double").alias("target"), none("taken"), none("shards"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11) -> DataFrame:
    """The mix in the columns of ``docs``: a row per document and pass with the words that pass takes from it.

    A document that is taken whole keeps its text as it is; else its taken words are joined by spaces, and ``n_chars``
    is counted anew. A document without words has nothing to take. Columns keep their names, whatever these are.
    """
    table = sized(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all_columns"))
    sources = plan(table, weights, share, most, seed)
    rows = placed(table.select("row", "doc_id", "source", "size", "mark"), sources)
    ranges = mix(rows, sources, seed).groupBy("row", "pass").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("ranges"), F.sum(F.col("hi") - F.col("lo")).alias("words"))
    joined = table.select("row", "size", "all_columns").join(ranges, "row")
    text = F.col("all_columns.text")
    some = F.flatten(F.transform("ranges", lambda r: F.slice("found", (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int"))))
    whole = F.col("words") == F.col("size")
    joined = joined.withColumn("found", F.when(~whole, F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))).withColumn("mixed_text", F.when(whole, text).otherwise(F.array_join(some, " ")))
    changed = {"text": F.col("mixed_text")} | ({"n_chars": F.length("mixed_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(f"all_columns.`{c}`").alias(c) for c in docs.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))
