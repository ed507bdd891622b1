"""Cleaners of attribute values and headings: projections only, so they stay inside whole-stage codegen.

NULL input is treated as missing by the cleaners that have a missing rule, and passes through the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "Unknown"
NO_AGE = 9999.0

# The results depend on them.
MISSING = ("missing", "none", "nan", "n/a", "na", "unknown", "not found", "not available", "not reported")
LOCATIONS = {"USA": "United States", "US": "United States", "U.S.": "United States", "U.S.A.": "United States", "UK": "United Kingdom", "U.K.": "United Kingdom"}
SEXES = {"male": "Male", "m": "Male", "female": "Female", "f": "Female", "female/ male": "Both", "male/female": "Both"}
RACES = {"white": "White", "caucasian": "White", "black": "Black", "african american": "Black", "african-american": "Black", "hispanic": "Hispanic", "latino": "Hispanic", "asian": "Asian", "native american": "Native American", "mixed": "Mixed", "other": "Other"}
EMPLOYMENTS = {"employed": "Employed", "unemployed": "Unemployed", "part-time": "Part-time", "part time": "Part-time", "self-employed": "Self-employed", "self employed": "Self-employed"}
YES_NO_HEADINGS = (
    "Physically abused?", "Sexually abused?", "Emotionally abused?", "Animal torture", "Fire setting", "Bed wetting", "Abused alcohol?", "Abused drugs?",
    "Been to a psychologist?", "Ate part of the body?", "Drank victim's blood?", "Bound the victims?", "Tortured the victims?", "Killed prior to series?",
    "Applied for job as a cop?", "Attempted suicide?", "Fired from jobs?", "Killed enemy during service?", "Head injury?", "Dumped body in lake, river, etc?",
    "Burned body", "Cut up and disposed of", "Did killer have a partner?", "Did killer plead NGRI?", "Did serial killer confess?", "Killer committed suicide?",
    "Killer executed?", "Killer killed in prison?", "Lives with his children", "Lives with her children", "Committed previous crimes?",
)
NUMERIC_HEADINGS = (
    "Number of victims", "IQ", "Birth order", "Killer age at start of series", "Killer age at end of series", "Age of first kill",
    "Age when first had intercourse", "Age of first sexual experience", "Highest grade in school",
)
LOCATION_HEADINGS = ("Country where killing occurred", "States where killing occurred", "Cities where killing occurred", "Counties where killing occurred")
HEADINGS = {
    "Physically abused?": "Physically abused", "Sexually abused?": "Sexually abused", "Emotionally abused?": "Emotionally abused", "Abused alcohol?": "Abused alcohol",
    "Abused drugs?": "Abused drugs", "Been to a psychologist?": "Been to psychologist", "Been to a psychologist prior to killing?": "Been to psychologist",
    "Applied for job as a cop?": "Applied for cop job", "Attempted suicide?": "Attempted suicide", "Fired from jobs?": "Fired from jobs",
    "Killed enemy during service?": "Killed in service", "Head injury?": "Head injury", "Did killer have a partner?": "Had partner",
    "Did killer plead NGRI?": "Plead NGRI", "Did serial killer confess?": "Confessed", "Killer committed suicide?": "Committed suicide",
    "Killer executed?": "Executed", "Killer killed in prison?": "Killed in prison",
}


def parse_age(age: Column) -> Column:
    """The number before the first ``-``, 9999 if there is none."""
    return F.coalesce(F.split(age, "-", 2)[0].try_cast("double"), F.lit(NO_AGE))


def standardize_missing(value: Column) -> Column:
    words = "|".join(w.replace("/", "\\/") for w in MISSING)
    return F.when(value.isNull() | F.trim(value).rlike(rf"(?i)^({words}|\?+|-+|_+)?$"), F.lit(UNKNOWN)).otherwise(F.trim(value))


def normalize_value(value: Column) -> Column:
    return F.when(value.isNull() | F.lower(F.trim(value)).isin("none", "nan", "", "null"), F.lit(UNKNOWN)).otherwise(value)


def standardize_yes_no(value: Column) -> Column:
    """Prefixes before words: ``Northern`` is a No."""
    low = F.lower(F.trim(value))
    yes, no = low.contains("yes"), low.contains("no")
    return (
        F.when(low.rlike("^(yes|true)") | low.isin("y", "1", "1.0"), "Yes")
        .when(low.rlike("^(no|false)") | low.isin("n", "0", "0.0"), "No")
        .when(no & ~yes, "No")
        .when(yes & ~no, "Yes")
        .otherwise(value)
    )


def standardize_numeric(value: Column) -> Column:
    """The first number, as text; unchanged without one."""
    found = F.regexp_extract(value, r"(\d+(?:\.\d+)?)", 1)
    return F.when(F.length(found) > 0, found).otherwise(value)


def numeric_value(value: Column, default: float = 0.0) -> Column:
    """The first whole number as a double."""
    return F.coalesce(F.regexp_extract(value, r"(\d+)", 1).try_cast("double"), F.lit(default))


def title_case(value: Column) -> Column:
    """A capital after anything that is not a letter, unlike ``initcap``, which looks at white space only."""
    runs = F.regexp_extract_all(value, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))), "")


def lookup(value: Column, known: dict[str, str], key: Column) -> Column:
    entries = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.element_at(entries, key)


def standardize_location(value: Column) -> Column:
    one = F.regexp_replace(F.trim(value), r"\s+", " ")
    return F.coalesce(lookup(value, LOCATIONS, F.upper(one)), title_case(one))


def standardize_category(value: Column, known: dict[str, str]) -> Column:
    return F.coalesce(lookup(value, known, F.lower(F.trim(value))), value)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def clean_attributes(df: DataFrame) -> DataFrame:
    """Routes each (heading, value) to its cleaner: the first of the rules whose words the heading contains."""
    v = standardize_missing(F.col("value"))
    h = F.trim("heading")
    cleaned = (
        F.when(v == UNKNOWN, v)
        .when(contains_any(h, YES_NO_HEADINGS), standardize_yes_no(v))
        .when(contains_any(h, NUMERIC_HEADINGS), standardize_numeric(v))
        .when(contains_any(h, LOCATION_HEADINGS), standardize_location(v))
        .when(h == "Sex", standardize_category(v, SEXES))
        .when(h == "Race", standardize_category(v, RACES))
        .when(h.contains("Employment"), standardize_category(v, EMPLOYMENTS))
        .otherwise(F.regexp_replace(v, r"\s+", " "))
    )
    renamed = F.coalesce(lookup(F.col("heading"), HEADINGS, F.col("heading")), F.col("heading"))
    return df.withColumns({"value": cleaned, "heading": renamed}).withColumn("heading_key", F.lower(F.trim("heading")))


def merge_similar(df: DataFrame, heading: str, groups: list[list[str]]) -> DataFrame:
    """Each group of two or more values becomes its first; groups apply one after the other."""
    value = F.col("value")
    for g in groups:
        if len(g) > 1:
            value = F.when((F.col("heading") == heading) & value.isin(g), F.lit(g[0])).otherwise(value)
    return df.withColumn("value", value)


def safe_filename(text: Column, most: int = 100) -> Column:
    safe = F.regexp_replace(text, r"[^\p{L}\p{N}_]+", "_")
    return F.when(F.length(safe) > most, F.concat(F.substring(safe, 1, most - 4), F.lit("..."))).otherwise(safe)


def feature_vectors(attributes: DataFrame) -> DataFrame:
    """entity, abused, male, victims, education and employed from long attributes; absent headings give 0."""
    wide = attributes.groupBy("entity").agg(
        *[F.max(F.when(F.col("heading_key").isin(k), F.col("value"))).alias(n) for n, k in (("abused", ["physically abused", "physically abused?"]), ("sex", ["sex"]), ("victims", ["number of victims"]), ("education", ["education level"]), ("employment", ["employment status"]))]
    )
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    edu = low("education")
    return wide.select(
        "entity",
        low("abused").startswith("yes").cast("int").alias("abused"),
        (low("sex") == "male").cast("int").alias("male"),
        numeric_value(F.coalesce("victims", F.lit(""))).alias("victims"),
        F.when(edu.contains("graduate"), 3).when(edu.contains("college"), 2).when(edu.contains("high school"), 1).otherwise(0).alias("education"),
        (low("employment") == "employed").cast("int").alias("employed"),
    )
