"""Names and places to placeholders, and variants of a text by synonyms; lists of names are parameters."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A short default; callers bring the lists of their language.
PEOPLE = ("John", "James", "Robert", "Michael", "William", "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Smith", "Johnson", "Williams", "Brown", "Jones")
# The states, then their abbreviations.
STATES = (
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware", "Florida", "Georgia", "Hawaii", "Idaho", "Illinois", "Indiana", "Iowa", "Kansas", "Kentucky",
    "Louisiana", "Maine", "Maryland", "Massachusetts", "Michigan", "Minnesota", "Mississippi", "Missouri", "Montana", "Nebraska", "Nevada", "New Hampshire", "New Jersey", "New Mexico", "New York",
    "North Carolina", "North Dakota", "Ohio", "Oklahoma", "Oregon", "Pennsylvania", "Rhode Island", "South Carolina", "South Dakota", "Tennessee", "Texas", "Utah", "Vermont", "Virginia",
    "Washington", "West Virginia", "Wisconsin", "Wyoming",
)
ABBREVIATIONS = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO",
    "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
)
#: A word's synonyms; callers bring their own.
SYNONYMS = {"stole": ("took", "robbed"), "killed": ("murdered", "slew"), "arrested": ("detained", "apprehended"), "attacked": ("assaulted", "struck"), "house": ("home", "residence")}


def _any_of(words: tuple[str, ...]) -> str:
    return r"(?i)\b(?:" + "|".join(map(re.escape, words)) + r")\b"


def lists(people: tuple[str, ...] = PEOPLE) -> list[tuple[str, str]]:
    return [(_any_of(people), "[PERSON]"), (_any_of(STATES), "[LOCATION]"), (_any_of(ABBREVIATIONS), "[LOCATION]")]


def standardise_names(text: Column, people: tuple[str, ...] = PEOPLE) -> Column:
    """Names to [PERSON], then states and their abbreviations (in any case, so the word "in" too) to [LOCATION].

    Two neighbouring [PERSON] become one, once; runs of blanks become one; NULL stays NULL.
    """
    done = reduce(lambda t, x: F.regexp_replace(t, x[0], x[1].replace("[", "\\[").replace("]", "\\]")), lists(people), text)
    return F.trim(F.regexp_replace(F.regexp_replace(done, r"\[PERSON\]\s+\[PERSON\]", r"\[PERSON\]"), r"\s+", " "))


def replaced_names(text: Column, people: tuple[str, ...] = PEOPLE) -> Column:
    """What ``standardise_names`` replaces: names, states, abbreviations, each in the order of the text."""
    found, at = [], text
    for pattern, placeholder in lists(people):
        found.append(F.regexp_extract_all(at, F.lit(pattern), F.lit(0)))
        at = F.regexp_replace(at, pattern, placeholder.replace("[", "\\[").replace("]", "\\]"))
    return F.concat(*found)


#: Rows of a task: the patterns cost far more than the rows weigh, so rows are dealt however few files they lie in.
TASK_ROWS = 50_000


def variants(df: DataFrame, n: int = 3, synonyms: dict[str, tuple[str, ...]] = SYNONYMS, people: tuple[str, ...] = PEOPLE) -> DataFrame:
    """id, variant (0 to n-1), text: each word with synonyms is replaced on a coin by a hash of id, place and variant.

    A variant that is the text itself is replaced by "The event: ..." or "... occurred", by another coin. The patterns run
    once for each text, before it is repeated, and coins are thrown for words that have synonyms alone.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    known = F.create_map(*[x for w, s in synonyms.items() for x in (F.lit(w), F.array(*map(F.lit, s)))])
    once = df.select("id", "text").repartition(tasks).select("id", F.split(F.lower(standardise_names(F.col("text"), people)), " ").alias("words"))
    rows = once.select("id", "words", F.array_join("words", " ").alias("plain")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("variant"))
    coin = lambda i, salt: F.xxhash64(F.col("id"), i, F.col("variant"), F.lit(salt))

    def word(w: Column, i: Column) -> Column:
        choice = F.element_at(known, w)
        other = F.get(choice, F.pmod(coin(i, 2), F.size(choice)).cast("int"))
        return F.when(w.isin(*synonyms) & (F.pmod(coin(i, 1), F.lit(2)) == 1), other).otherwise(w)

    plain, changed = F.col("plain"), F.col("changed")
    padded = F.when(F.pmod(coin(F.lit(-1), 3), F.lit(2)) == 1, F.concat(F.lit("The event: "), plain)).otherwise(F.concat(plain, F.lit(" occurred")))
    both = rows.withColumn("changed", F.array_join(F.transform("words", word), " "))
    return both.select("id", "variant", F.when(changed != plain, changed).otherwise(padded).alias("text"))
