"""What the operators share: table reading, shared storage, words and shingles."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

SHINGLE = 5
THRESHOLD = 0.8
WORD = re.compile(r"\w+")
#: Between Spark and Python go batches of about so many bytes, and functions are handed about so many bytes of text at once.
ARROW_BYTES = 8 << 20
TEXT_BYTES = 2 << 20

U64 = np.uint64
_MUL = U64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the one that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset,
    as in local tests, a temporary folder is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="chainlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches for Python stay at about ``ARROW_BYTES`` while a query runs; a task holds some of them beside Spark's heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(ARROW_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts lineage: a lost executor costs a reread, never a second run of what is above.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    with small_batches(spark):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote. Only for those that nothing will read again, not even after a lost task."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def n_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 step)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHashes(dict):
    """word -> 64-bit hash; forgets everything when it has grown large."""

    LIMIT = 100_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def hashed_words(text: str | None, cache: WordHashes) -> np.ndarray:
    found = words_of(text)
    return np.fromiter(map(cache.__getitem__, found), dtype=U64, count=len(found))


def shingle_hashes(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of k words; a text of 1 to k-1 words is one shingle; no word, no shingle."""
    n = len(words)
    if n == 0:
        return np.empty(0, dtype=U64)
    k = min(k, n)
    m = n - k + 1
    h = np.full(m, k, dtype=U64)
    for j in range(k):
        h *= _MUL
        h += words[j : m + j]
    return mix(h)


def as_signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=U64).view(np.int64)


def runs(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of at most ``rows`` rows and, beyond one row, of about ``TEXT_BYTES`` bytes of text."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        fit = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_BYTES, "right"))
        to = min(max(fit, at + 1), at + rows)
        yield batch.slice(at, to - at)
        at = to


def record_batches(f: Callable[[dict[str, list]], dict[str, object]], schema: pa.Schema, rows: int = 512) -> Callable:
    """A ``mapInArrow`` function that hands ``f`` python columns of one of the ``runs`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in runs(whole, rows):
                out = f({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], type=x.type) for x in schema], schema=schema)

    return run


def rows_kept(docs: DataFrame, keep: Callable[[list[str | None]], np.ndarray], rows: int) -> DataFrame:
    """``docs`` without the rows for whose texts ``keep`` is false, in the map stage; columns may have any names."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = docs.columns.index("text")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in runs(whole, rows)):
            yield batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_()))

    return plain.mapInArrow(f, plain.schema).toDF(*docs.columns)
