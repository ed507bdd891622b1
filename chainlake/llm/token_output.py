"""Token ids as compact binary shards: a shared zstandard dictionary, one frame per document, an offset index.

File format (Parquet rows, so that any store that Spark reaches can hold it). ``<path>/dictionary`` has one row:
``dict_hash`` (hex sha256) and ``dictionary`` (bytes). ``<path>/blocks`` has a row per block of consecutive documents
of a shard, in ascending doc_id order: ``shard``, ``block``, ``first_doc``, ``last_doc``, ``dict_hash``, ``doc_ids``,
``n_tokens``, ``offsets`` (n + 1 byte offsets), ``block_start`` (tokens before it in its shard), ``n_block_tokens`` and ``frames``, the concatenated zstandard frames.
Frame i decompresses, with the dictionary named by its hash, to the ids of document i as little-endian unsigned
32-bit integers. A short document is reached by min/max statistics on first_doc/last_doc and one slice of ``frames``.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlake.llm.common import n_partitions, runs, shared_dir, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Documents, and code points in each, that the dictionary is trained on at most; the dictionary's bytes.
DICT_DOCS, DICT_DOC_CHARS, DICT_BYTES = 512, 65_536, 65_536
#: A block is closed at this many tokens.
BLOCK_TOKENS = 1 << 18

_LETTER = "a-zªµºß-öø-ÿ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces(dict):
    """piece -> its ids, in two generations. When the younger one is full it becomes the older, and what was in that is
    forgotten unless it was met again since. A piece that is in neither is noted in ``new`` and looked up as None."""

    LIMIT = 500_000

    def __init__(self, older: dict[str, bytes] | None = None):
        super().__init__()
        self.older: dict[str, bytes] = {} if older is None else older
        self.new: set[str] = set()

    def __missing__(self, piece: str) -> bytes | None:
        held = self.older.get(piece)
        if held is None:
            self.new.add(piece)
        else:
            self[piece] = held
        return held

    def aged(self) -> Pieces:
        """These pieces, or if they are too many a new generation with these as the older one."""
        if len(self) <= self.LIMIT:
            return self
        self.older = {}
        return Pieces(self)


class Encoder:
    """Encodes whole texts as the library does, with the pieces of Latin-1 texts looked up in a table.

    The tokenizer cuts a text into pieces that it encodes one by one. For a text of Latin-1 characters without
    special tokens the cut is exactly ``_PIECE`` on the lower-cased text, so each distinct piece is given to the
    library once. All other texts are given to the library whole.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Pieces()
        vocabulary = self.tokenizer.get_vocab()
        #: Whether an id ends a piece: its token has the suffix of word ends.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        suffix = json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"]
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder per process and tokenizer."""
        return cls._made.get(path) or cls._made.setdefault(path, cls(path))

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> None:
        """Give new pieces to the library, many to a text with spaces between, and cut its ids at word ends."""
        ids = np.frombuffer(self.library([" ".join(pieces)])[0], "<u4")
        at = np.flatnonzero(self.ends[ids]) + 1
        if len(at) != len(pieces):
            self.known.update(zip(pieces, self.library(pieces), strict=True))
            return
        raw, cut = ids.tobytes(), [0, *(4 * at).tolist()]
        self.known.update((p, raw[a:b]) for p, a, b in zip(pieces, cut, cut[1:], strict=False))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text with the end id, as little-endian unsigned 32-bit integers."""
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        cut: list[list[str] | None] = []
        for text in texts:
            text = text or ""
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                cut.append(None)
            else:
                cut.append(None if "<|" in text else _PIECE.findall(text.lower()))
        known = self.known = self.known.aged()
        found = [pieces and list(map(known.__getitem__, pieces)) for pieces in cut]
        new = list(known.new)
        known.new.clear()
        for at in range(0, len(new), 1024):
            self.learn(new[at : at + 1024])
        rest = iter(self.library([t or "" for t, pieces in zip(texts, cut, strict=True) if pieces is None]))
        out = []
        for pieces, ids in zip(cut, found, strict=True):
            if pieces is None:
                out.append(next(rest) + end)
            else:
                out.append(b"".join(ids if None not in ids else [known[p] if i is None else i for p, i in zip(pieces, ids, strict=True)]) + end)
        return out


def train_dictionary(df: DataFrame, tokenizer: str, docs: int = DICT_DOCS, doc_chars: int = DICT_DOC_CHARS) -> bytes:
    """A zstandard dictionary trained on the id arrays of the ``docs`` documents with the smallest hashes.

    The bound is the parameter ``docs``; texts of over ``doc_chars`` code points are not training samples.
    With too few samples to train on, the dictionary is raw content: the samples themselves.
    """
    chosen = (
        df.where(F.length("text").between(1, doc_chars))
        .select("doc_id", F.xxhash64("doc_id", F.lit(17)).alias("h"))
        .orderBy("h", "doc_id")
        .limit(docs)
        .select("doc_id")
        .collect()
    )
    ids = df.sparkSession.createDataFrame([(r["doc_id"],) for r in chosen if r["doc_id"] is not None], "doc_id long").distinct()
    # Ids first, then the texts of that bounded list: no task sends more than its share of the sample.
    sample = df.where(F.length("text").between(1, doc_chars)).join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "text").collect()
    sample.sort(key=lambda r: (r["doc_id"], r["text"]))
    coded = Encoder.of(tokenizer).encode([r["text"] for r in sample])
    try:
        return zstandard.train_dictionary(DICT_BYTES, coded, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(coded)[:DICT_BYTES]


_BLOCK = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("first_doc", T.LongType()),
        T.StructField("last_doc", T.LongType()),
        T.StructField("dict_hash", T.StringType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("n_tokens", T.ArrayType(T.LongType())),
        T.StructField("offsets", T.ArrayType(T.LongType())),
        T.StructField("block_start", T.LongType()),
        T.StructField("n_block_tokens", T.LongType()),
        T.StructField("frames", T.BinaryType()),
    ]
)
_ARROW_BLOCK = pa.schema(
    [
        ("shard", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("dict_hash", pa.string()), ("doc_ids", pa.list_(pa.int64())),
        ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("block_start", pa.int64()), ("n_block_tokens", pa.int64()), ("frames", pa.binary()),
    ]
)


def write_tokens(df: DataFrame, path: str, tokenizer: str, n_shards: int | None = None) -> None:
    """Encode ``doc_id, text`` and write the format above, shards in ascending order of doc_id.

    A NULL text is empty: its ids are the end id alone. Rows with NULL doc_id come first; repeated doc_ids keep all
    their rows, ordered by a hash of the text, then by text. Other columns are ignored. An empty table gives no block. One shuffle moves the
    texts; each task holds one Arrow batch and one block.
    """
    spark = df.sparkSession
    n = n_shards or n_partitions(spark)
    docs = df.select("doc_id", "text")
    dictionary = train_dictionary(docs, tokenizer)
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(dict_hash, bytearray(dictionary))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        shard, block, before, size = TaskContext.get().partitionId(), 0, 0, 0
        ids: list = []
        counts: list[int] = []
        frames: list[bytes] = []

        def close() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
            known = [i for i in ids if i is not None]
            row = [shard, block, known[0] if known else None, known[-1] if known else None, dict_hash, list(ids), list(counts), offsets, before, size, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, _ARROW_BLOCK, strict=True)], schema=_ARROW_BLOCK)

        for whole in batches:
            for batch in runs(whole, 256):
                for doc_id, coded in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                    ids.append(doc_id)
                    counts.append(len(coded) // 4)
                    size += counts[-1]
                    frames.append(squeeze.compress(coded))
                    if size >= BLOCK_TOKENS:
                        yield close()
                        block, before, size = block + 1, before + size, 0
                        ids, counts, frames = [], [], []
        if ids:
            yield close()

    order = F.col("doc_id").asc_nulls_first()
    # With the hash in the ranges, a doc_id (or NULL) of very many rows is spread over shards too.
    marked = docs.withColumn("mark", F.xxhash64("text")).repartitionByRange(n, order, F.col("mark"))
    marked.sortWithinPartitions(order, "mark", "text").drop("mark").mapInArrow(encode, _BLOCK).write.parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32 and ids (binary), a row per document.

    ``start`` counts the ids of all documents before it. The totals of shards (one row each, as many as there were
    partitions) are summed on the driver; each block knows how many tokens of its shard are before it.
    """
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    stored = spark.read.parquet(f"{path}/dictionary").first()
    dictionary, dict_hash = bytes(stored["dictionary"]), stored["dict_hash"]
    totals = blocks.groupBy("shard").agg(F.sum("n_block_tokens").alias("n")).orderBy("shard").collect()
    starts: dict[int, int] = {}
    at = 0
    for r in totals:
        starts[r["shard"]] = at
        at += r["n"]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for whole in batches:
            for k in range(whole.num_rows):
                b = whole.slice(k, 1).to_pylist()[0]
                if b["dict_hash"] != dict_hash:
                    raise ValueError(f"block {b['shard']}/{b['block']} was written with another dictionary")
                blob, off = b["frames"], b["offsets"]
                ids = [expand.decompress(blob[off[i] : off[i + 1]]) for i in range(len(off) - 1)]
                n = [len(x) // 4 for x in ids]
                if n != b["n_tokens"]:
                    raise ValueError(f"block {b['shard']}/{b['block']} does not hold what its index says")
                first = starts[b["shard"]] + b["block_start"]
                start = first + np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b["doc_ids"], pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())], schema=schema
                )

    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def read_document(spark: SparkSession, path: str, doc_id: int) -> np.ndarray | None:
    """The ids of one document: reads only blocks whose range holds it and expands one frame."""
    rows = (
        spark.read.parquet(f"{path}/blocks")
        .where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
        .withColumn("i", F.array_position("doc_ids", F.lit(doc_id).cast("long")).cast("int"))
        .where("i > 0")
        .select("dict_hash", F.expr("substring(frames, int(offsets[i-1]) + 1, int(offsets[i] - offsets[i-1]))").alias("frame"))
        .limit(1)
        .collect()
    )
    if not rows:
        return None
    d = spark.read.parquet(f"{path}/dictionary").where(F.col("dict_hash") == rows[0]["dict_hash"]).first()
    expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(d["dictionary"])) if d["dictionary"] else None)
    return np.frombuffer(expand.decompress(bytes(rows[0]["frame"])), dtype="<u4")


def token_output(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` in the format above to the shared folder and return what the files hold, without the ids."""
    spark = docs.sparkSession
    path = shared_dir(spark, "tokens")
    write_tokens(docs, path, tokenizer or tokenizer_path())
    return read_tokens(spark, path).drop("ids")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))
