"""License scan: each file's rarest licence words, template postings by relative position, mandatory key phrases.

Everything runs on DataFrame functions. A first pass counts in how many documents each word of the key phrases stands. Of
each template's key phrase the two words of highest IDF are indexed, so common words have no postings. A file's postings
are the positions of its indexed words; a template is looked up by its rarest word, its two words' positions are
intersected at their relative places, and at each place that is left the whole key phrase is verified in the file's words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.llm.common import table

#: What separates words, once A-Z are lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a template that are indexed.
INDEXED = 2


@dataclass(frozen=True)
class Template:
    """A label, its text, the key phrase in it that must stand in a file, and whether that is one of the base phrases."""

    label: str
    key: str
    text: str = ""
    base: bool = False

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def words(self) -> list[str]:
        return (self.text or self.key).split()

    @property
    def offset(self) -> int:
        """Where in the text the key phrase starts."""
        key = self.key_words
        return next(i for i in range(len(self.words)) if self.words[i : i + len(key)] == key)


TEMPLATES = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
    Template("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template("mit", "mit license", "released under the mit license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    ),
    Template("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("lgpl", "lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("agpl", "affero general public license", "under the terms of the gnu affero general public license as published by the free software foundation"),
    Template("gpl", "gnu general public license as published by the free software foundation", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc0", "cc0 1 0", "cc0 1 0 universal"),
    Template("unlicense", "free and unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    Template("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("zlib", "in no event will the authors be held liable for any damages", "in no event will the authors be held liable for any damages arising from the use of this software"),
    Template("bsl-1.0", "boost software license", "distributed under the boost software license version 1 0"),
    Template("epl", "eclipse public license"),
)


def lower_ascii(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(docs: DataFrame) -> DataFrame:
    """doc_id and the words of every row; a NULL text has none."""
    return docs.select("doc_id", F.array_remove(F.split(lower_ascii(F.col("text")), GAP), "").alias("words"))


def literals(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def document_counts(words: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """In how many documents each word of a key phrase stands; at most as many rows as these have words."""
    known = sorted({w for t in templates for w in t.key_words})
    found = words.select(F.explode(F.array_intersect("words", literals(known))).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in found.collect()}


def indexed_words(template: Template, counts: dict[str, int], n: int = INDEXED) -> list[tuple[int, str]]:
    """(offset, word) of the ``n`` words of highest IDF in the key phrase, the rarest first; equals by offset."""
    first = {w: i for i, w in reversed(list(enumerate(template.key_words)))}
    return sorted(((i, w) for w, i in first.items()), key=lambda x: (counts.get(x[1], 0), x[0]))[:n]


def rare_postings(words: Column, index: list[str]) -> Column:
    """(position, word) of the indexed words, in order; a file without any is passed over at once."""
    kept = F.transform(words, lambda w, i: F.when(w.isin(index), F.struct(i.cast("long").alias("at"), w.alias("word"))))
    return F.when(F.arrays_overlap(words, literals(index)), F.array_compact(kept))


def places(postings: Column, words: Column, template: Template, rare: list[tuple[int, str]]) -> Column:
    """Starts, counted in words from 0, of the template's key phrase.

    The positions of its rarest word come first, are intersected with those of the next at their relative places, and
    what is left is verified word by word. No posting of the rarest word: no further look.
    """
    here = lambda k, w: F.transform(F.filter(postings, lambda p: p["word"] == w), lambda p: p["at"] - k)
    starts = here(*rare[0])
    for other in rare[1:]:
        starts = F.array_intersect(starts, here(*other))
    key = literals(template.key_words)
    found = F.filter(starts, lambda s: (s >= 0) & (F.slice(words, F.greatest(s, F.lit(0)).cast("int") + 1, len(template.key_words)) == key))
    return F.when(F.exists(postings, lambda p: p["word"] == rare[0][1]), found)


def agreement(starts: Column, words: Column, template: Template) -> Column:
    """The most words of the template's whole text that stand at their places around one of its key phrase's starts."""
    text, offset = literals(template.words), template.offset
    at = lambda s: F.size(F.filter(F.sequence(F.lit(0), F.lit(len(template.words) - 1)), lambda j: F.get(words, (s + j - offset).cast("int")) == F.get(text, j)))
    return F.when(F.size(starts) > 0, F.array_max(F.transform(starts, at))).otherwise(0)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, all places of the base phrases, labels and a score.

    A label stands for a template whose key phrase stands in the text. ``score`` is 0 without a label, else 1 - 1/(1 + n)
    with the most words of a template's text that agree with the file by position, so longer evidence counts more. A NULL
    or empty text has no word and no label. Repeated rows and rows with NULL doc_id are scanned each. Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    cut = words_of(docs)
    counts = document_counts(cut, templates)
    rare = [indexed_words(t, counts) for t in templates]
    index = sorted({w for r in rare for _, w in r})
    none = F.array().cast("array<bigint>")
    rows = cut.select("doc_id", "words", rare_postings(F.col("words"), index).alias("postings"))
    some = F.col("postings").isNotNull()
    found = rows.select(
        "doc_id", "words", some.alias("some"),
        *[F.coalesce(F.when(some, places(F.col("postings"), F.col("words"), t, r)), none).alias(f"p{i}") for i, (t, r) in enumerate(zip(templates, rare, strict=True))],
    )
    base = F.concat(*[F.col(f"p{i}") for i, t in enumerate(templates) if t.base])
    label = lambda keep: F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(t.label)) for i, t in enumerate(templates) if keep(t)]))))
    most = F.when(F.col("some"), F.greatest(*[agreement(F.col(f"p{i}"), F.col("words"), t) for i, t in enumerate(templates)])).otherwise(0)
    found = found.select("doc_id", F.size("words").cast("long").alias("n_words"), base.alias("base"), label(lambda t: t.base).alias("base_labels"), label(lambda t: True).alias("labels"), most.alias("most"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base").alias("first_word"),
        F.array_max("base").alias("last_word"),
        "base_labels",
        "labels",
        F.when(F.col("most") > 0, F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + F.col("most"))).otherwise(0.0).alias("score"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def oracle() -> str:
    """The same over all documents in DuckDB, template by template on the joined words."""
    gap = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def starts(t: Template) -> str:
        test = " AND ".join(f"w[i+{k}] = '{x}'" for k, x in enumerate(t.key_words, 1))
        return f"list_filter(range(0, len(w) - {len(t.key_words) - 1}), lambda i: {test})"

    def agreeing(i: int, t: Template) -> str:
        text = "[" + ", ".join(f"'{x}'" for x in t.words) + "]"
        at = f"len(list_filter(range(0, {len(t.words)}), lambda j: s + j >= {t.offset} AND w[s + j - {t.offset} + 1] = {text}[j + 1]))"
        return f"coalesce(list_max(list_transform(p{i}, lambda s: {at})), 0)"

    has = " || ".join(f"CASE WHEN len(p{i}) > 0 THEN ['{t.label}'] ELSE [] END" for i, t in enumerate(TEMPLATES))
    has_base = " || ".join(f"CASE WHEN len(p{i}) > 0 THEN ['{t.label}'] ELSE [] END" for i, t in enumerate(TEMPLATES) if t.base)
    base = " || ".join(f"p{i}" for i, t in enumerate(TEMPLATES) if t.base)
    most = "greatest(" + ", ".join(agreeing(i, t) for i, t in enumerate(TEMPLATES)) + ")"
    return f"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{gap}') AS w FROM documents
), found AS (
  SELECT doc_id, w, {", ".join(f"{starts(t)} AS p{i}" for i, t in enumerate(TEMPLATES))} FROM cut
), one AS (
  SELECT doc_id, len(w) AS n_words, {base} AS base, list_sort(list_distinct({has_base})) AS base_labels, list_sort(list_distinct({has})) AS labels, {most} AS most FROM found
)
SELECT doc_id, n_words, len(base) AS n_base, list_min(base) AS first_word, list_max(base) AS last_word,
       array_to_string(base_labels, ',') AS base_labels, array_to_string(labels, ',') AS labels,
       CASE WHEN most > 0 THEN 1.0::DOUBLE - 1.0::DOUBLE / (1.0::DOUBLE + most) ELSE 0.0::DOUBLE END AS score
FROM one"""
