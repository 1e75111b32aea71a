"""Licence scans by a positional index of rare words, in Spark expressions only.

A first pass splits each text and keeps, of its words, the places of those that
occur in a template: the positional index, a few bytes for each word kept. From
it come the numbers of documents with each word, hence its IDF. A template's
postings are its words of highest IDF and their places in it. A file's rare
words look postings up; each hit proposes a template at the file's place less the
template's place, and proposals that ``AGREEING`` of a template's ``RARE_WORDS``
rare words agree on are kept, so that a notice with some words changed is found.
The key phrase must stand in the file word by word; the score is the share of the
template's IDF that stands in its place. Proposals are sorted, and each looks at
the index entries beside it only, so the work grows with the text and not with
its square.
"""

from __future__ import annotations

import math
import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rare words of a template that look it up, how many of them must agree on its place, and the least score of a match.
RARE_WORDS, AGREEING, LEAST_SCORE = 4, 2, 0.75
# Phrases whose places are counted, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Template, label, key phrase. Usual notices of licences, as words.
TEMPLATES = [
    *[(phrase, label, phrase) for phrase, label in BASE.items()],
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", "permission is hereby granted free of charge"),
    ("licensed under the apache license version 2 0", "apache-2", "apache license version 2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3", "gnu general public license version 3"),
    ("under the terms of the gnu general public license as published by the free software foundation either version 2", "gpl-2", "gnu general public license"),
    ("under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl", "gnu lesser general public license"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", "redistribution and use in source and binary forms"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2", "mozilla public license v 2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", "for any purpose with or without fee"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "free and unencumbered software"),
    ("licensed under cc by sa 4 0", "cc-by-sa", "cc by sa"),
    ("licensed under cc by 4 0", "cc-by", "cc by 4 0"),
]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: An index entry is a place times this plus the word's number.
STEP = 256
_NONE = "array<bigint>"


def _words(text: str) -> list[str]:
    return re.findall(WORD, text)


VOCABULARY = {w: i for i, w in enumerate(sorted({w for t, _, _ in TEMPLATES for w in _words(t)}))}


def positional_index(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and places (place * STEP + word number, ascending) of each row.

    A-Z are lower-cased. A null or empty text has no words.
    """
    lowered = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)
    numbers = F.create_map(*[F.lit(x) for w, i in VOCABULARY.items() for x in (w, i)])
    split = docs.select(F.col("doc_id").cast("long"), F.regexp_extract_all(lowered, F.lit(f"({WORD})"), 1).alias("words"))
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(list(VOCABULARY)))
    places = F.transform(at, lambda i: i.cast("long") * STEP + F.element_at(numbers, F.get("words", i)))
    return split.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.size("words") > 0, places).otherwise(F.array().cast(_NONE)).alias("places"))


def word_idf(index: DataFrame) -> dict[int, float]:
    """IDF of each word of the templates over all documents; the driver gets a number for each word."""
    n = index.count()
    number = F.explode(F.array_distinct(F.transform("places", lambda p: (p % STEP).cast("int"))))
    counts = {r["w"]: r["count"] for r in index.select(number.alias("w")).groupBy("w").count().collect()}
    return {i: math.log((n + 1) / (counts.get(i, 0) + 1)) + 1e-3 for i in VOCABULARY.values()}


def _consecutive(places: Column, phrase: list[int]) -> Column:
    """Starts of the places where the phrase's words stand one after another."""
    # words of a phrase are words of the index, so they stand one after another there too
    here = lambda e: (F.get(places, e) % STEP == phrase[0]) & F.forall(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(k * STEP + w - phrase[0]).cast("long").alias("d")) for k, w in enumerate(phrase) if k]), lambda x: F.coalesce(F.get(places, e + x["k"]) == F.get(places, e) + x["d"], F.lit(False)))
    found = F.transform(F.filter(F.sequence(F.lit(0), F.size(places) - 1), here), lambda e: F.floor(F.get(places, e) / STEP).cast("long"))
    return F.when(F.size(places) >= len(phrase), found).otherwise(F.array().cast(_NONE))


def scan(index: DataFrame) -> DataFrame:
    """Matches in rows of ``positional_index``.

    Adds ``base`` (label and start of each place of a base phrase) and
    ``matches`` (label, template, start, score) of the templates found.
    """
    idf = word_idf(index)
    places = F.col("places")

    def labelled(phrase: str, label: str) -> Column:
        return F.transform(_consecutive(places, [VOCABULARY[w] for w in _words(phrase)]), lambda s: F.struct(F.lit(label).alias("label"), s.alias("start")))

    base = F.concat(*[labelled(p, label) for p, label in BASE.items()])
    postings: dict[int, list[tuple[int, int]]] = {}
    rows = []
    for t, (text, label, key) in enumerate(TEMPLATES):
        own = [VOCABULARY[w] for w in _words(text)]
        rare = sorted(range(len(own)), key=lambda j: (-idf[own[j]], j))[:RARE_WORDS]
        for j in rare:
            postings.setdefault(own[j], []).append((t, j))
        key_words = [VOCABULARY[w] for w in _words(key)]
        first = next(j for j in range(len(own)) if own[j : j + len(key_words)] == key_words)
        weight = sum(idf[w] for w in own)
        entries = F.array(*[F.struct(F.lit(j * STEP + w).cast("long").alias("at"), F.lit(idf[w] / weight).alias("share"), F.lit(first <= j < first + len(key_words)).alias("key")) for j, w in enumerate(own)])
        rows.append(F.struct(F.lit(label).alias("label"), entries.alias("entries")))
    templates = F.array(*rows)
    posting = F.create_map(*[x for w, hits in sorted(postings.items()) for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(j).alias("j")) for t, j in hits]))])
    # proposals: where the template would begin, which it is, and where in the index it was proposed, in that order
    listed = F.filter(F.transform("places", lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda e: (e["p"] % STEP).cast("int").isin(sorted(postings)))
    proposed = F.flatten(F.transform(listed, lambda e: F.transform(F.element_at(posting, (e["p"] % STEP).cast("int")), lambda x: F.struct((F.floor(e["p"] / STEP) - x["j"]).alias("start"), x["t"].alias("t"), e["i"].alias("i")))))
    looked_up = index.withColumn("base", base).withColumn("proposed", F.array_sort(proposed))
    same = lambda i, x: F.coalesce((F.get("proposed", i)["start"] == x["start"]) & (F.get("proposed", i)["t"] == x["t"]), F.lit(False))
    # equal proposals are neighbours: the first of a run that is long enough stands for it
    agreed = F.filter("proposed", lambda x, i: ~same(i - 1, x) & same(i + (AGREEING - 1), x))
    longest = max(len(_words(t)) for t, _, _ in TEMPLATES)

    def match(x: Column) -> Column:
        # the template's words stand among the index entries beside the one that proposed it, as places ascend
        near = F.slice("places", F.greatest(x["i"] - (longest - 1), F.lit(0)) + 1, F.lit(2 * longest - 1))
        return F.get(F.transform(F.array(F.struct(F.get(templates, x["t"]).alias("own"), near.alias("near"))), lambda c: scored(x, c["own"], c["near"])), 0)

    def scored(x: Column, own: Column, near: Column) -> Column:
        in_place = lambda e: F.array_contains(near, x["start"].cast("long") * STEP + e["at"])
        return F.struct(
            own["label"].alias("label"),
            x["t"].alias("template"),
            x["start"].cast("long").alias("start"),
            F.aggregate(F.filter(own["entries"], in_place), F.lit(0.0), lambda a, e: a + e["share"]).alias("score"),
            F.forall(F.filter(own["entries"], lambda e: e["key"]), in_place).alias("key"),
        )

    verified = F.filter(F.transform("agreed", match), lambda m: m["key"] & (m["score"] >= LEAST_SCORE))
    return looked_up.withColumn("agreed", agreed).withColumn("matches", verified).drop("proposed", "agreed", "places")


def digest(docs: DataFrame) -> DataFrame:
    """Counts, labels and score of each row; repeated rows give repeated results, a null doc_id stays null."""
    found = scan(materialize(positional_index(docs), "licence-index"))
    labels = lambda *columns: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(c, lambda m: m["label"]) for c in columns]))), ",")
    starts = F.transform("base", lambda m: m["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels("base").alias("base_labels"),
        labels("base", "matches").alias("labels"),
        F.round(F.least(F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)), F.lit(1.0)), 9).alias("score"),
    )
