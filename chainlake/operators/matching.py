"""Matching of two catalogues of ids, lookups in long attribute tables, and counts of what matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entity_key(name: Column) -> Column:
    """Lower case, without the file prefix and any ``_clean`` at the end."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"^Type[12]_", ""), r"(?i)(_clean)+$", ""))


def season_free(key: Column) -> Column:
    return F.regexp_replace(key, r"_+(spring|summer|fall|winter)?_*\(?\d{4}\)?_*$", "")


def first_names(key: Column) -> Column:
    return F.array_join(F.slice(F.split(key, "_"), 1, 2), "_")


def matched(left: DataFrame, right: DataFrame) -> DataFrame:
    """key, left_name, right_name of the names with equal keys."""
    a = left.select(entity_key(F.col("name")).alias("key"), F.col("name").alias("left_name"))
    b = right.select(entity_key(F.col("name")).alias("key"), F.col("name").alias("right_name"))
    return a.join(b, "key")


def fuzzy(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_name, right_name: by equal keys, else without year and season, else by the first two name parts.

    Each step is an equality join; several matches of a step give the smallest name.
    """
    a = left.select(F.col("name").alias("left_name"), entity_key(F.col("name")).alias("k1"))
    a = a.withColumn("k2", season_free(F.col("k1"))).withColumn("k3", first_names(F.col("k1")))
    b = right.select(F.col("name"), entity_key(F.col("name")).alias("key"))
    side = lambda key, out: b.groupBy(key).agg(F.min("name").alias(out))
    found = a.join(side(F.col("key").alias("k1"), "m1"), "k1", "left").join(side(season_free(F.col("key")).alias("k2"), "m2"), "k2", "left").join(side(first_names(F.col("key")).alias("k3"), "m3"), "k3", "left")
    return found.select("left_name", F.coalesce("m1", "m2", "m3").alias("right_name"))


def match_statistics(left: DataFrame, right: DataFrame) -> DataFrame:
    a = left.select(entity_key(F.col("name")).alias("key")).distinct().withColumn("l", F.lit(1))
    b = right.select(entity_key(F.col("name")).alias("key")).distinct().withColumn("r", F.lit(1))
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    return a.join(b, "key", "full").agg(
        F.count_if(both).alias("n_matched"),
        F.count_if(F.col("r").isNull()).alias("left_only"),
        F.count_if(F.col("l").isNull()).alias("right_only"),
        (F.count_if(both) / F.greatest(F.count("l"), F.lit(1))).alias("left_rate"),
        (F.count_if(both) / F.greatest(F.count("r"), F.lit(1))).alias("right_rate"),
    )


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """side, key of ids that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").select(F.lit("left").alias("side"), key).unionByName(b.join(a, key, "left_anti").select(F.lit("right").alias("side"), key))


def quality_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """heading, values_before, values_after where the numbers of distinct values differ."""
    a = before.groupBy("heading").agg(F.countDistinct("value").alias("values_before"))
    b = after.groupBy("heading").agg(F.countDistinct("value").alias("values_after"))
    return a.join(b, "heading", "full").where(~F.col("values_before").eqNullSafe(F.col("values_after")))
