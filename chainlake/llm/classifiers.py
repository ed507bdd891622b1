"""Quality and language: byte convolutional networks fitted on a bounded sample of labelled rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlake.llm.bytenet import ByteNet
from chainlake.llm.common import record_batches, rows_kept, table

#: Labelled documents that a network is fitted on at most (per class), the code points read of each at most (from a place by a
#: hash of doc_id), steps of Adam.
QUALITY_DOCS, LANGUAGE_DOCS, MAX_CHARS, STEPS = 900, 400, 20_000, 500
QUALITY_NET = {"widths": (6,), "filters": 24, "stride": 1, "window": 1024, "overlap": 64}
LANGUAGE_NET = {"widths": (2, 3, 4), "filters": 8, "stride": 1, "window": 512, "overlap": 3}
THRESHOLD = 0.7
UNDETERMINED = "und"
#: The filter rejects a text whose best language has a score below this share above that of even classes.
LANGUAGE_MARGIN = 0.2


def remainder(doc_id: Column, n: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1))


def sample(labelled: DataFrame, docs: DataFrame, per_class: int) -> tuple[list[str], list, dict]:
    """Texts and labels of at most ``per_class`` rows of each label, and how many rows each label has in all.

    ``labelled`` has doc_id and label. Rows are chosen by the smallest hash of doc_id, whatever the input's size or
    order; their texts alone are read, by a join with that bounded list. Of a text longer than ``MAX_CHARS`` a stretch of
    that length is read, from a place by a hash of doc_id; NULL texts are empty.
    """
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    # The least of each label's parts first, so a label of most rows is no single task's.
    chosen = labelled.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(64)))
    for keys in (("label", "part"), ("label",)):
        by = Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id")
        chosen = chosen.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= per_class).drop("nth")
    chosen = chosen.select("doc_id", "label").collect()
    if not chosen:
        return [], [], counts
    small = docs.sparkSession.createDataFrame([(r["doc_id"], r["label"]) for r in chosen], ["doc_id", "label"])
    text = F.coalesce("text", F.lit(""))
    place = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.greatest(F.length(text) - MAX_CHARS, F.lit(0)) + 1).cast("int") + 1
    rows = docs.select("doc_id", F.substr(text, place, F.lit(MAX_CHARS)).alias("text")).join(F.broadcast(small), "doc_id").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"], r["label"]))
    rows = [rows[i] for i in np.random.default_rng(5).permutation(len(rows))]
    kept, seen = [], dict.fromkeys(counts, 0)
    for r in rows:  # a doc_id of several rows has several texts
        if seen[r["label"]] < per_class:
            seen[r["label"]] += 1
            kept.append(r)
    return [r["text"] for r in kept], [r["label"] for r in kept], counts


def fitted(texts: list[str], labels: list, counts: dict, net: dict, steps: int = STEPS) -> tuple[ByteNet, list]:
    """A network and its classes in order. Classes weigh as often as they are in the table, so scores are calibrated."""
    classes = sorted(set(labels))
    y = np.array([classes.index(v) for v in labels])
    share = np.bincount(y, minlength=len(classes))
    weight = np.array([counts[v] for v in classes]) / share
    return ByteNet(**net, classes=len(classes)).fit(texts, y, weight[y], steps), classes


def quality_model(docs: DataFrame, labels: DataFrame, per_class: int = QUALITY_DOCS) -> tuple[ByteNet | None, float]:
    """A network and the share of label 1, from rows of ``labels`` (doc_id, quality) whose documents are not held out.

    No network without texts of two classes. Repeated label rows count once; a document with both labels counts as each.
    Labels other than 0 and 1, and NULL doc_ids, are left out.
    """
    labelled = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 4) != 2)).select("doc_id", F.col("quality").alias("label")).distinct()
    texts, y, counts = sample(labelled, docs, per_class)
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    return (fitted(texts, y, counts, QUALITY_NET)[0] if len(set(y)) > 1 else None), share


def scored_quality(docs: DataFrame, model: ByteNet | None, share: float) -> DataFrame:
    """doc_id and score, the probability of label 1, of every row's whole text (NULL as empty).

    Without a model (no labels, or of one class) the score is the share of label 1, 0.5 if there are no labels. Rows of
    equal text have equal scores, rows with NULL or repeated doc_id are scored each; very long texts are read whole, window
    by window; other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def f(c: dict[str, list]) -> dict[str, object]:
        p = np.full(len(c["text"]), share) if model is None else model.probabilities(c["text"])[:, 1].astype(np.float64)
        return {"doc_id": c["doc_id"], "score": np.clip(p, 0.0, 1.0)}

    return docs.select("doc_id", "text").mapInArrow(record_batches(f, schema, 128), "doc_id long, score double")


def language_model(docs: DataFrame, per_class: int = LANGUAGE_DOCS) -> tuple[ByteNet | None, list]:
    """Fitted on documents with a language that are not held out; with one language there is no network."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 5) != 0)).select("doc_id", F.col("lang").alias("label")).distinct()
    texts, y, counts = sample(labelled, docs, per_class)
    return fitted(texts, y, counts, LANGUAGE_NET) if len(set(y)) > 1 else (None, sorted(set(y)))


def identified(docs: DataFrame, model: ByteNet | None, classes: list) -> DataFrame:
    """doc_id, lang_pred and score of every row's whole text; ``und`` with score 0 for a text without a letter.

    NULL and empty texts have no letter. With one learned language every other text has that, with score 1; with none
    all are ``und``. Equal probabilities go to the first language by code point. Rows of equal text have equal results, rows
    with NULL or repeated doc_id are scored each; other columns are ignored, whatever their names; an empty table gives
    an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def f(c: dict[str, list]) -> dict[str, object]:
        some = [t is not None and any(map(str.isalpha, t)) for t in c["text"]]
        if model is None:
            best = [(classes[0], 1.0) if classes else (UNDETERMINED, 0.0)] * len(some)
        else:
            p = model.probabilities(c["text"]).astype(np.float64)
            best = [(classes[i], min(1.0, float(row[i]))) for i, row in zip(p.argmax(axis=1), p, strict=True)]
        best = [b if s else (UNDETERMINED, 0.0) for b, s in zip(best, some, strict=True)]
        return {"doc_id": c["doc_id"], "lang_pred": [b[0] for b in best], "score": [b[1] for b in best]}

    return docs.select("doc_id", "text").mapInArrow(record_batches(f, schema, 128), "doc_id long, lang_pred string, score double")


def with_language(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that have no language: no letter (NULL and empty texts too), or classes about even.

    That is a best score of at most 1 + ``LANGUAGE_MARGIN`` times that of even classes. Repeated rows stay or go alike;
    columns keep their names, whatever these are; an empty table stays empty.
    """
    model, classes = language_model(docs)
    least = (1 + LANGUAGE_MARGIN) / max(1, len(classes))

    def keep(texts: list[str | None]) -> np.ndarray:
        some = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
        return some & (model.probabilities(texts).max(axis=1) > least) if model is not None and some.any() else some

    return rows_kept(docs, keep, 128)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored_quality(docs, *quality_model(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identified(docs, *language_model(docs))
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
