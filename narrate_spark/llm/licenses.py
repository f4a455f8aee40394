"""Licence scan by a positional index of rare words, in DataFrame functions only.

Each text's places of licence words (all words of the templates) are written as
its positional index.  Document frequencies of these words over all texts give
their weights.  Of each template's mandatory key phrase the rarest word is looked
up in the text; each of its places proposes an alignment, the template's start in
the text, and alignments at which the whole key phrase stands in its place are
scored by the weight of the template words that stand in theirs.  No alignment
without the key phrase counts, so none is left out, whatever else the text holds.
A text without the words of any key phrase has no such alignment and is not looked up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrate_spark.llm import common

# Phrases whose every place counts, with their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Notices, with their labels and mandatory key phrases.
TEMPLATES = (
    ("gpl-notice", "this work is licensed under the gnu general public license version", "general public license"),
    (
        "gpl-header",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "free software you can redistribute it",
    ),
    ("apache-notice", "licensed under the apache license version 2 0", "apache license version"),
    ("mit-notice", "released under the mit license", "mit license"),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "permission is hereby granted free of charge",
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    (
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistribution and use in source and binary forms",
    ),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
)
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
# Share of a template's weight from which its label is given.
MIN_SCORE = 0.6

_VOCABULARY = sorted({w for p, _ in PHRASES for w in p.split()} | {w for _, t, _ in TEMPLATES for w in t.split()})


def word_index(docs: DataFrame) -> DataFrame:
    """Number of words and the places of licence words of each whole text; a null text is empty."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), common.UPPER, common.LOWER)
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    places = F.filter(
        F.transform("words", lambda w, i: F.when(w.isin(_VOCABULARY), F.struct(i.alias("pos"), w.alias("word")))),
        lambda p: p.isNotNull(),
    )
    return words.select("doc_id", F.size("words").cast("long").alias("n_words"), places.alias("places"))


def word_weights(index: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each licence word over all texts; one row a word comes to the driver."""
    found = F.array_distinct(F.transform("places", lambda p: p["word"]))
    total = index.count()
    rows = index.select(F.explode(found).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    frequency = {r["word"]: r["n"] for r in rows}
    # rounded, so that sums do not depend on the platform's logarithm
    return {w: round(math.log(1 + (total + 1) / (frequency.get(w, 0) + 1)), 9) for w in _VOCABULARY}


def _strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _stands(places: Column, first: Column, at: Column, words: list[str]) -> Column:
    """Whether words stand from place ``at`` on, the first one as the ``first``-th licence word of the text.

    Words that follow one another are neighbours among the licence words too, so
    each is looked up by its number.
    """
    same = F.lit(True)
    for i, word in enumerate(words):
        place = F.get(places, first + i)
        same = same & F.coalesce((place["pos"] == at + i) & (place["word"] == word), F.lit(False))
    return same


def _numbered(places: Column, word: str) -> Column:
    """Places (number among the licence words, pos) of a word."""
    every = F.transform(places, lambda p, j: F.struct(j.alias("j"), p["pos"].alias("pos"), p["word"].alias("word")))
    return F.filter(every, lambda p: p["word"] == word)


def _starts(places: Column, phrase: str) -> Column:
    """Places where the phrase's words stand one after another."""
    words = phrase.split()
    whole = F.filter(_numbered(places, words[0]), lambda p: _stands(places, p["j"], p["pos"], words))
    return F.transform(whole, lambda p: p["pos"])


def _template_score(places: Column, template: tuple[str, str, str], weights: dict[str, float]) -> Column:
    """Best score of a template in a text: the key phrase's rarest word proposes starts, the whole phrase admits them.

    The score is the share of the template's weight that stands in its place.  Its
    words stand within as many licence words of the key phrase as it has words.
    """
    _, text, key = template
    words, key_words = text.split(), key.split()
    key_at = next(i for i in range(len(words)) if words[i : i + len(key_words)] == key_words)
    rare = min(key_words, key=lambda w: (-weights[w], w))
    total = sum(weights[w] for w in words)

    def score(p: Column, behind: int) -> Column:
        at = p["pos"] - behind - key_at
        low = F.greatest(p["j"] - len(words), F.lit(0))
        near = F.slice(places, low + 1, F.lit(2 * len(words) + 1))
        met = F.aggregate(
            near,
            F.lit(0.0),
            lambda s, q: s
            + F.when(
                (q["pos"] >= at) & (F.get(_strings(words), q["pos"] - at) == q["word"]),
                F.get(F.array(*(F.lit(weights[w]) for w in words)), q["pos"] - at),
            ).otherwise(0.0),
        )
        return met / F.lit(total)

    def best_at(behind: int) -> Column:
        admitted = F.filter(
            _numbered(places, rare), lambda p: _stands(places, p["j"] - behind, p["pos"] - behind, key_words)
        )
        return F.coalesce(F.array_max(F.transform(admitted, lambda p: score(p, behind))), F.lit(0.0))

    best = F.greatest(F.lit(0.0), *(best_at(i) for i, w in enumerate(key_words) if w == rare))
    has_key = F.size(F.array_except(_strings(sorted(set(key_words))), "found")) == 0
    return F.when(has_key, best).otherwise(0.0)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Licence labels of each row of ``docs`` (doc_id, text; other columns are not read).

    ``n_base`` counts the places of the base phrases, ``first_word`` and ``last_word``
    are their smallest and largest start.  ``labels`` adds those of templates with a
    score of ``MIN_SCORE`` or more; ``score`` is the best of all templates.  An empty or null
    text has no words and empty labels; repeated rows and null ids are kept; an
    empty table gives no row.
    """
    index = common.stored(word_index(docs))
    weights = word_weights(index)
    found = F.array_distinct(F.transform("places", lambda p: p["word"]))
    # no places unless some phrase's words are all there
    needed = [p for p, _ in PHRASES] + [k for _, _, k in TEMPLATES]
    hopeful = F.lit(False)
    for phrase in needed:
        hopeful = hopeful | (F.size(F.array_except(_strings(sorted(set(phrase.split()))), "found")) == 0)
    rows = index.withColumn("found", found).withColumn("hopeful", hopeful)
    scanned = (
        rows.withColumn("places", F.when(F.col("hopeful"), F.col("places")).otherwise(F.filter("places", lambda p: F.lit(False))))
        .select(
            "doc_id",
            "n_words",
            *(_starts(F.col("places"), p).alias(f"p{i}") for i, (p, _) in enumerate(PHRASES)),
            *(
                F.when(F.col("hopeful"), _template_score(F.col("places"), t, weights)).otherwise(0.0).alias(f"t{i}")
                for i, t in enumerate(TEMPLATES)
            ),
        )
    )
    starts = F.concat(*(F.col(f"p{i}") for i in range(len(PHRASES))))
    base = [F.when(F.size(f"p{i}") > 0, label) for i, (_, label) in enumerate(PHRASES)]
    more = [F.when(F.col(f"t{i}") >= MIN_SCORE, label) for i, (label, _, _) in enumerate(TEMPLATES)]
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(base + more).alias("labels"),
        F.round(F.greatest(*(F.col(f"t{i}") for i in range(len(TEMPLATES)))), 9).alias("score"),
    )


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    """Licence labels of all ``documents``."""
    return scan_licenses(common.table(spark, sf_dir, "documents"))
