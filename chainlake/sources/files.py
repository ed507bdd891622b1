"""Event and attribute files in, result tables out. Every reader assigns the order of rows at the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlake.functions.clean import clean_attributes, parse_age
from chainlake.operators.matching import entity_key, season_free

COLUMNS = 8


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """Fields c0 to c7 of each line, its file and its place in the file; headers are lines, since they differ by file."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(COLUMNS)])
    lines = spark.read.schema(schema).option("multiLine", True).option("escape", '"').csv(path)
    named = lines.select("*", F.col("_metadata.file_name").alias("file"))
    # A file is read by one task when lines may span rows, so ids ascend with the place in the file.
    return named.withColumn("source_row", F.monotonically_increasing_id())


def read_events(spark: SparkSession, path: str, keep_blank: bool = False) -> DataFrame:
    """entity_id, source_row, date, age_raw, age, text of all ``Type1_<id>.csv`` files below ``path``.

    A name that a header repeats means its last column. ``Life Event`` falls back to the name with a blank at its end.
    Rows without a text are dropped unless ``keep_blank``. Unparseable ages are 9999 and so come last.
    """
    raw = _raw(spark, f"{path}/Type1_*.csv")
    first = raw.groupBy("file").agg(F.min("source_row").alias("head"))
    fields = F.array(*[F.col(f"c{i}") for i in range(COLUMNS)])
    heads = raw.join(first, "file").where("source_row = head").select("file", "head", fields.alias("names"))
    body = raw.withColumn("fields", fields).select("file", "source_row", "fields").join(heads, "file").where("source_row > head")

    def named(*names: str):
        at = lambda n: F.lit(COLUMNS) - F.array_position(F.reverse("names"), F.lit(n)).cast("int")
        return F.coalesce(*[F.when(F.array_contains("names", n), F.get("fields", at(n))) for n in names], F.lit(""))

    rows = body.select(F.regexp_extract("file", r"Type1_(.+)\.csv", 1).alias("entity_id"), (F.col("source_row") - F.col("head")).alias("source_row"), named("Date").alias("date"), named("Age").alias("age_raw"), F.trim(named("Life Event", "Life Event ")).alias("text"))
    rows = rows.withColumn("age", parse_age(F.col("age_raw")))
    return rows if keep_blank else rows.where(F.length("text") > 0)


def read_attributes(spark: SparkSession, path: str, clean: bool = True) -> DataFrame:
    """entity, heading, heading_key, value, source_row of ``Type2_<id>.csv`` files, or of one file with ``CriminalID``."""
    options = spark.read.option("header", True).option("multiLine", True).option("ignoreLeadingWhiteSpace", True)
    if path.endswith(".csv"):
        raw = options.csv(path).withColumnRenamed("CriminalID", "entity")
    else:
        raw = options.csv(f"{path}/Type2_*.csv").withColumn("entity", F.regexp_extract("_metadata.file_name", r"Type2_(.+)\.csv", 1))
    long = raw.select("entity", F.col("Heading").alias("heading"), F.col("Value").alias("value")).withColumn("source_row", F.monotonically_increasing_id()).withColumn("heading_key", F.lower(F.trim("heading")))
    return clean_attributes(long) if clean else long


def write_results(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet table per artefact."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_results(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def manifest(spark: SparkSession) -> DataFrame:
    """One row: versions and the settings that change results."""
    return spark.createDataFrame([(spark.version, spark.conf.get("spark.sql.session.timeZone"), spark.conf.get("spark.sql.shuffle.partitions"))], "spark string, time_zone string, shuffle_partitions string")


def read_matched(spark: SparkSession, events_path: str, attributes_path: str, clean: bool = True) -> tuple[DataFrame, DataFrame]:
    """Events and attributes of the entities that both folders have, with ``entity`` the key that both sides share."""
    key = lambda c: season_free(entity_key(c))
    events = read_events(spark, events_path).withColumn("entity", key(F.col("entity_id")))
    attributes = read_attributes(spark, attributes_path, clean).withColumn("entity", key(F.col("entity")))
    return events.join(attributes.select("entity").distinct(), "entity", "left_semi"), attributes.join(events.select("entity").distinct(), "entity", "left_semi")


#: The folders below a run's root.
LAYOUT = ("clustering", "markov", "visualization", "analysis", "data")


def output_paths(root: str) -> dict[str, str]:
    return {name: f"{root.rstrip('/')}/{name}" for name in LAYOUT}


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """One folder per value of ``by``, as for the matrices of conditions."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def markdown(tables: dict[str, DataFrame], rows: int = 20) -> str:
    """A report of the first ``rows`` rows of each result table; only those reach the driver."""
    out = []
    for name, df in tables.items():
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(str(v).replace("|", "\\|") for v in r) + " |" for r in df.limit(rows).collect()] + [""]
    return "\n".join(out)


def demo_events(spark: SparkSession, entities: int = 10, least: int = 5) -> DataFrame:
    """entity, pos, state, age of made-up sequences, the same in every run."""
    states = F.array(*[F.lit(x) for x in ("school", "work", "theft", "arrest", "prison")])
    rows = spark.range(entities).select(F.col("id").alias("entity"), F.explode(F.sequence(F.lit(1), F.lit(least) + F.pmod(F.col("id"), F.lit(10)).cast("int"))).alias("pos"))
    at = F.pmod(F.xxhash64("entity", "pos"), F.lit(5)).cast("int")
    return rows.select("entity", F.col("pos").cast("long").alias("pos"), F.get(states, at).alias("state"), (F.lit(10.0) + 2 * F.col("pos")).alias("age"))
