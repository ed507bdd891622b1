"""The analysis as one function: event files or sequences, and attributes, in; result tables out."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.functions.text import normalize, redact, term_weights, tf_idf
from chainlake.operators import conditional, ensembles, markov, patterns, sequences, trajectory
from chainlake.operators.vectors import k_scores
from chainlake.sources.files import markdown, output_paths, read_attributes, read_events, read_matched, write_results


@dataclass(frozen=True)
class Config:
    """Settings of a run. With ``k`` 0 the number of clusters is the best of ``k_min`` to ``k_max`` by silhouette."""

    order: int = 2
    min_group: int = conditional.MIN_GROUP
    threshold: float = 0.1
    output: str | None = None
    k: int = 5
    k_min: int = 3
    k_max: int = 8
    method: str = "kmeans"
    vocabulary: int = 500
    redact: bool = False
    match_only: bool = False
    seed: int = 42

    def __post_init__(self):
        if self.order < 1 or self.min_group < 1 or not 0 <= self.threshold <= 2:
            raise ValueError("order and min_group must be positive, threshold between 0 and 2")
        if self.k == 1 or self.k < 0 or not 2 <= self.k_min <= self.k_max:
            raise ValueError("k must be 0 or at least 2, and 2 <= k_min <= k_max")


def arguments(argv: list[str] | None = None) -> tuple[str, str | None, Config]:
    """Events path, attributes path and settings of a command line."""
    parser = argparse.ArgumentParser(description="Analyse event histories")
    parser.add_argument("events")
    parser.add_argument("--attributes")
    for f in fields(Config):
        name = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            parser.add_argument(name, action="store_true")
        else:
            parser.add_argument(name, type=str if f.default is None else type(f.default), default=f.default)
    given = vars(parser.parse_args(argv))
    return given.pop("events"), given.pop("attributes"), Config(**given)


def validated(spark: SparkSession, events: str, attributes: str | None, config: Config) -> None:
    """Raises ValueError unless the events folder has a file and, to match, attributes are given."""
    if config.match_only and not attributes:
        raise ValueError("match_only needs attributes")
    for path, pattern in ((events, "Type1_*.csv"), (attributes, None)):
        if path is None:
            continue
        at = spark._jvm.org.apache.hadoop.fs.Path(path if pattern is None or path.endswith(".csv") else f"{path}/{pattern}")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at):
            raise ValueError(f"nothing to read at {path}")


def vectorize(events: DataFrame, method: str = "tfidf", vocabulary: int = 500, supplied: DataFrame | None = None) -> DataFrame:
    """id, v of events (id, text): TF-IDF over the commonest terms, or the vectors ``supplied`` (id, v).

    ``tfidf`` gives an element per term of the vocabulary, which is bounded; an event without one of them is all zeros.
    """
    if method == "supplied":
        if supplied is None:
            raise ValueError("supplied vectors are missing")
        return events.select("id").join(supplied.select("id", "v"), "id")
    if method != "tfidf":
        raise ValueError(f"unknown method {method}; known are tfidf, supplied")
    terms = [r["term"] for r in term_weights(events, vocabulary).select("term").orderBy("term").collect()]
    held = tf_idf(events, vocabulary).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("m"))
    empty = F.create_map().cast("map<string,double>")
    element = F.transform(F.array(*[F.lit(t) for t in terms]), lambda t: F.coalesce(F.element_at("m", t), F.lit(0.0)))
    return events.select("id").join(held, "id", "left").withColumn("m", F.coalesce("m", empty)).select("id", element.alias("v"))


def states_of(events: DataFrame, config: Config) -> DataFrame:
    """id, label: each event's cluster, by its text."""
    text = redact(F.col("text")) if config.redact else F.col("text")
    v = vectorize(events.select("id", normalize(text).alias("text")), vocabulary=config.vocabulary)
    k = config.k or k_scores(v, range(config.k_min, config.k_max + 1), config.seed).agg(F.max_by("k", F.struct("silhouette", -F.col("k")))).first()[0]
    return ensembles.clustered(v, k, config.method, config.seed).select("id", F.col("cluster").alias("label"))


def analyse(seq: DataFrame, attributes: DataFrame | None, config: Config = Config()) -> dict[str, DataFrame]:
    """Tables by name. ``seq`` (entity, pos, state[, age]) is read several times and so persisted."""
    seq = seq.persist()
    matrix = markov.transition_matrix(seq)
    out = {
        "sequences": sequences.assembled(seq),
        "transitions": matrix,
        "stationary": markov.stationary(matrix),
        "higher_order": markov.higher_order(seq, config.order),
        "change_points": patterns.kl_change_points(seq),
        "diversity": sequences.diversity(seq),
    }
    if attributes is not None:
        conditions = conditional.condition_map(attributes)
        out["conditional"] = conditional.conditional_matrices(seq, conditions, config.min_group)
        out["insights"] = conditional.insights(seq, conditions, config.threshold)
    if "age" in seq.columns:
        out["trajectories"] = trajectory.features(seq)
        out["risk"] = trajectory.risk(seq)
    if config.output:
        write_results(out, output_paths(config.output)["analysis"])
    return out


def analyse_files(spark: SparkSession, events: str, attributes: str | None, config: Config = Config()) -> dict[str, DataFrame]:
    """From event files to result tables: texts to vectors, vectors to clusters, clusters as states, and ``analyse``."""
    validated(spark, events, attributes, config)
    if config.match_only:
        rows, known = read_matched(spark, events, attributes)
    else:
        rows = read_events(spark, events).withColumn("entity", F.col("entity_id"))
        known = read_attributes(spark, attributes) if attributes else None
    rows = sequences.numbered(rows.withColumn("id", F.xxhash64("entity", "source_row")), "entity", "age", "source_row").persist()
    labels = states_of(rows.select("id", "text"), config)
    seq = rows.join(labels, "id").select("entity", "pos", F.col("label").cast("string").alias("state"), "age")
    return analyse(seq, known, config)


def report(tables: dict[str, DataFrame]) -> str:
    """The head of every table as markdown."""
    return markdown(tables)


def temporal_report(seq: DataFrame, phases: int = 5) -> dict[str, DataFrame]:
    """Change points by all three methods, life phases, frequent subsequences and their rules."""
    frequent = patterns.frequent_subsequences(seq, shortest=1)
    return {
        "change_points_kl": patterns.kl_change_points(seq),
        "change_points_chi2": patterns.chi2_change_points(seq),
        "change_points_binary": patterns.binary_segmentation(seq),
        "life_phases": patterns.life_phases(seq, phases),
        "patterns": frequent.where(F.size("pattern") > 1),
        "rules": patterns.association_rules(frequent, seq.select("entity").distinct().count()),
    }


if __name__ == "__main__":
    session = SparkSession.builder.getOrCreate()
    where, other, settings = arguments()
    print(report(analyse_files(session, where, other, settings)))
