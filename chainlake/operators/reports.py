"""Reports over result tables: insights (heading, value, n, l1, p), audits, verdicts and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Families of headings.
FAMILIES = {
    "Demographics": ["Sex", "Race", "Age", "Birth_order", "Number_of_siblings"],
    "Family Background": ["Parent_s_marital_status", "Living_with", "Mother_s_occupation", "Father_s_occupation", "Did_serial_killer_spend_time_in_an_orphanage_", "Did_serial_killer_spend_time_in_a_foster_home_"],
    "Education": ["Highest_grade_in_school", "Highest_degree", "Grades_in_school", "Problems_in_school_", "Teased_while_in_school_"],
    "Criminal Behavior": ["Method_of_killing", "Type_of_killer", "Type_of_serial_killer", "Number_of_victims", "Gender_of_victims", "Victim_abducted_or_killed_at_contact_"],
    "Psychology": ["Bed_wetting", "Been_to_a_psychologist_prior_to_killing_", "Psychologically_abused_", "Sexually_abused", "Physical_defect_"],
    "Substance Use": ["Abused_drugs", "Abused_alcohol"],
    "Legal Outcomes": ["Sentence", "Confessed", "Plead_NGRI", "Executed", "Committed_suicide"],
}


def effect_category(l1: Column, scale: str = "l1") -> Column:
    """By 0.1, 0.3 and 0.5 (``l1``; a bound belongs above) or by 0.2, 0.5 and 0.8 (``cohen``; a bound belongs below)."""
    if scale == "l1":
        return F.when(l1 < 0.1, "negligible").when(l1 < 0.3, "small").when(l1 < 0.5, "medium").otherwise("large")
    return F.when(l1 > 0.8, "Large").when(l1 > 0.5, "Medium").when(l1 > 0.2, "Small").otherwise("Negligible")


def clustering_verdict(silhouette: Column) -> Column:
    return F.when(silhouette > 0.5, "Good").when(silhouette > 0.25, "Moderate").otherwise("Poor but realistic for behavioral data")


def validity_verdict(small_samples: Column, tests: Column, significant: Column, silhouette: Column) -> Column:
    """High without a concern, moderate with one, limited with more."""
    concerns = F.filter(
        F.array(F.when(small_samples > tests * 0.2, "Many small sample sizes"), F.when(significant == 0, "No significant effects"), F.when(silhouette < 0.1, "Poor clustering quality")), lambda c: c.isNotNull()
    )
    listed = F.array_join(concerns, ", ")
    return (
        F.when(F.size(concerns) == 0, "High validity - results are trustworthy")
        .when(F.size(concerns) == 1, F.concat(F.lit("Moderate validity - concern: "), listed))
        .otherwise(F.concat(F.lit("Limited validity - concerns: "), listed))
    )


def families(insights: DataFrame, known: dict[str, list[str]] | None = None) -> DataFrame:
    """family, n, n_significant, mean_l1 of insights whose heading belongs to a family; the map is a small literal."""
    entries = [F.lit(x) for family, names in (known or FAMILIES).items() for n in names for x in (n, family)]
    named = insights.withColumn("family", F.element_at(F.create_map(*entries), F.col("heading"))).where("family IS NOT NULL")
    return named.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") < 0.05).alias("n_significant"), F.avg("l1").alias("mean_l1"))


def validation(insights: DataFrame, alpha: float = 0.05, small: int = 10) -> DataFrame:
    """One row: tests, group sizes, effect buckets, p values and how many pass Bonferroni."""
    p, l1 = F.col("p"), F.col("l1")
    tests = F.count(F.lit(1))
    whole = insights.select("*", F.count(F.lit(1)).over(_all()).alias("m"))
    return whole.agg(
        tests.alias("n_tests"),
        F.avg("n").alias("mean_n"),
        F.min("n").alias("min_n"),
        F.count_if(F.col("n") < small).alias("small_samples"),
        F.count_if(l1 > 0.8).alias("n_large"),
        F.count_if((l1 >= 0.5) & (l1 <= 0.8)).alias("n_medium"),
        F.countDistinct("p").alias("n_distinct_p"),
        F.count_if(p < alpha).alias("n_significant"),
        F.count_if(p < alpha / F.col("m")).alias("n_bonferroni"),
        F.count_if((p < alpha) & (F.col("n") < small)).alias("n_small_significant"),
        F.min("p").alias("min_p"),
        F.max("p").alias("max_p"),
        F.avg("p").alias("mean_p"),
    )


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()


def run_summary(seq: DataFrame, insights: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """One row on entities, events and mean length, and the ``top`` insights by L1 (ties by heading and value)."""
    per = seq.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    row = per.agg(F.count(F.lit(1)).alias("n_entities"), F.sum("n").alias("n_events"), F.avg("n").alias("average_length"), F.min("n").alias("shortest"), F.max("n").alias("longest"))
    return row, insights.orderBy(F.desc("l1"), "heading", "value").limit(top)


def dominant_states(stationary: DataFrame, *keys: str) -> DataFrame:
    """The likeliest state of each group (ties by state), its probability and whether it is over one half."""
    best = stationary.groupBy(*keys).agg(F.min_by("state", F.struct(-F.col("pi"), F.col("state"))).alias("state"), F.max("pi").alias("pi"))
    return best.withColumn("dominant", F.col("pi") > 0.5)


def placeholder_counts(df: DataFrame, column: str) -> DataFrame:
    """placeholder, n: how often each ``[NAME]`` stands in a text column."""
    found = df.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(r"\[[A-Z_]+\]"), F.lit(0))).alias("placeholder"))
    return found.groupBy("placeholder").agg(F.count(F.lit(1)).alias("n"))
