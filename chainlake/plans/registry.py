"""Queries by name, with the SQL that gives the same rows, and the tables they stand on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.operators.sequences import numbered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its SQL if SQL can express it."""

    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, pos, state, age (days since the first event of all) of the events of users."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    first = e.agg(F.min("us").alias("first"))
    rows = e.join(F.broadcast(first)).withColumn("age", (F.col("us") - F.col("first")) / 86400000000.0)
    return numbered(rows.withColumnRenamed("user_id", "entity"), "entity", "us", "event_id").select("entity", "pos", F.col("event_type").alias("state"), "age")


def order_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, pos, state: the order priorities of customers in time."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), "o_orderdate", "o_orderkey", F.col("o_orderpriority").alias("state"))
    return numbered(o, "entity", "o_orderdate", "o_orderkey").select("entity", "pos", "state")


def customer_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, heading, heading_key, value, source_row: segment, nation and region of customers, long."""
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    wide = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    pairs = F.array(*[F.struct(F.lit(h).alias("heading"), F.col(k).alias("value"), F.lit(i).alias("source_row")) for i, (h, k) in enumerate((("Segment", "c_mktsegment"), ("Nation", "n_name"), ("Region", "r_name")))])
    long = wide.select(F.col("c_custkey").alias("entity"), F.explode(pairs).alias("a"))
    return long.select("entity", "a.heading", F.lower("a.heading").alias("heading_key"), "a.value", "a.source_row")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


SEQ = """seq AS (
  SELECT user_id AS entity, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type AS state,
         (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events))::DOUBLE / 86400000000.0::DOUBLE AS age FROM events)"""
ORDERS = """seq AS (
  SELECT o_custkey AS entity, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos, o_orderpriority AS state FROM orders)"""
ATTRIBUTES = """attr AS (
  SELECT c_custkey AS entity, 'segment' AS heading_key, c_mktsegment AS value FROM customer
  UNION ALL SELECT c_custkey, 'nation', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT c_custkey, 'region', r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
PAIRS = "pairs AS (SELECT * FROM (SELECT entity, pos, state AS from_state, lead(state) OVER (PARTITION BY entity ORDER BY pos) AS to_state FROM seq) WHERE to_state IS NOT NULL)"
STATES = "states AS (SELECT DISTINCT state FROM seq)"


def matrix_sql(empty: str = "1.0::DOUBLE / (SELECT count(*) FROM states)") -> str:
    return f"""{STATES}, {PAIRS}, counts AS (SELECT from_state, to_state, count(*) AS cnt FROM pairs GROUP BY ALL),
  full_grid AS (SELECT a.state AS from_state, b.state AS to_state, coalesce(cnt, 0)::BIGINT AS cnt FROM states a CROSS JOIN states b
    LEFT JOIN counts c ON c.from_state = a.state AND c.to_state = b.state),
  matrix AS (SELECT from_state, to_state, cnt, CASE WHEN sum(cnt) OVER w > 0 THEN cnt::DOUBLE / sum(cnt) OVER w ELSE {empty} END AS prob
    FROM full_grid WINDOW w AS (PARTITION BY from_state))"""
