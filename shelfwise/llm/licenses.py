"""License scan as an exact set-similarity join between text blocks and license templates, in DataFrame functions only.

Templates are dealt to reaches, the powers of two from 8 on: one of n words to the least reach r >= n. A block of reach r
is 2r consecutive words from a multiple of r on, wherever lines end, so any r consecutive words of a text lie in one block,
and words that stand further apart than 2r never make up a template. Both sides are sets of the templates' words, ordered
from the rarest word of the corpus to the most frequent. A block reaches a template's containment threshold only if it has
enough of its words (length), shares a word with the template's rarest ``size - needed + 1`` (prefix), and has enough
words left behind the first shared one on both sides (position). Pairs that pass are verified by the intersection.
Every pair at or over the threshold is found; the filters only spare work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.stage import stage

THRESHOLD = 0.9
SHORTEST_REACH = 8

# Phrases and labels of the base scan.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Sentences that the licenses' authors ask to be put on a work, and the labels they stand for.
TEMPLATES = [
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "released under the bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("rights-reserved", "copyright all rights reserved"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def reach(template: str) -> int:
    """The least power of two, from the shortest reach on, that is no less than the template's words."""
    size = SHORTEST_REACH
    while size < len(template.split()):
        size *= 2
    return size


def _spaced(text: Column) -> Column:
    """A-Z lowered, words parted by single blanks."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.trim(F.regexp_replace(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _words(spaced: Column) -> Column:
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _starts(words: Column, phrase: str) -> Column:
    """Places where the phrase's words stand one after the other."""
    parts = phrase.split(" ")

    def here(i: Column) -> Column:
        found = F.get(words, i) == parts[0]
        for n, p in enumerate(parts[1:], 1):
            found = found & F.coalesce(F.get(words, i + n) == p, F.lit(False))
        return found

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def base_scan(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Per row: doc_id, row (a key of id and text), n_words, starts of phrases, base labels, and its words of the vocabulary."""
    spaced = docs.select(
        "doc_id", F.xxhash64("doc_id", "text").alias("row"), _spaced(F.col("text")).alias("spaced")
    ).withColumn("words", _words(F.col("spaced")))
    words, padded = F.col("words"), F.concat(F.lit(" "), F.col("spaced"), F.lit(" "))
    none = F.array().cast("array<int>")
    starts = [F.when(padded.contains(f" {p} "), _starts(words, p)).otherwise(none) for p, _ in PHRASES]
    labels = [F.when(padded.contains(f" {p} "), F.lit(label)) for p, label in PHRASES]
    return spaced.select(
        "doc_id",
        "row",
        F.size(words).cast("long").alias("n_words"),
        F.concat(*starts).alias("starts"),
        F.array_compact(F.array(*labels)).alias("base"),
        F.array_intersect(words, _strings(vocabulary)).alias("held"),
    )


def _templates(order: dict[str, int], threshold: float) -> list[tuple]:
    made = []
    for number, (label, text) in enumerate(TEMPLATES):
        held = sorted(set(text.split()), key=lambda w: (order.get(w, 0), w))
        made.append((number, reach(text), label, held, len(held), needed(len(held), threshold)))
    return made


def _blocks(r: int, made: list[tuple], rank: dict[str, int]) -> Column:
    """The blocks of reach r that hold a prefix word of its templates: reach, first word, template words from the rarest on."""
    vocabulary = sorted({w for m in made for w in m[3]}, key=rank.__getitem__)
    prefixes = sorted({w for *_, held, size, need in made for w in held[: size - need + 1]})
    around = F.transform("words", lambda w, i: F.when(w.isin(prefixes), F.array((i / r).cast("int") - 1, (i / r).cast("int"))))
    starts = F.filter(F.array_distinct(F.flatten(F.array_compact(around))), lambda k: k >= 0)
    # a set in frequency order is the vocabulary in its order without what the block lacks
    return F.transform(
        starts,
        lambda k: F.struct(
            F.lit(r).alias("reach"),
            (k * r).alias("block"),
            F.array_intersect(_strings(vocabulary), F.slice("words", k * r + 1, 2 * r)).alias("b"),
        ),
    )


def matches(docs: DataFrame, scan: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """row, reach, block (its first word), label and containment of every block and template at or over the threshold."""
    spark = docs.sparkSession
    # how many documents hold each word of the templates: as many rows as those have words
    counts = {r.w: r.n for r in scan.select(F.explode("held").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    made = _templates(counts, threshold)
    ordered = sorted({w for *_, held, _, _ in made for w in held}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(ordered)}
    reaches = sorted({m[1] for m in made})
    least = F.lit(None)
    for r in reaches:
        least = F.when(F.col("reach") == r, min(m[5] for m in made if m[1] == r)).otherwise(least)
    templates = spark.createDataFrame(made, "template int, reach int, label string, t array<string>, t_size int, needed int").select(
        "*", F.posexplode(F.slice("t", F.lit(1), F.col("t_size") - F.col("needed") + 1)).alias("t_at", "w")
    )
    blocks = (
        docs.where("text is not null")
        .select(F.xxhash64("doc_id", "text").alias("row"), _words(_spaced(F.col("text"))).alias("words"))
        .select("row", F.inline(F.concat(*[_blocks(r, [m for m in made if m[1] == r], rank) for r in reaches])))
        .select("*", F.size("b").alias("b_size"), least.alias("least"))
        .where("b_size >= least")
        .select("*", F.posexplode(F.slice("b", F.lit(1), F.col("b_size") - F.col("least") + 1)).alias("b_at", "w"))
    )
    first = F.size(F.array_intersect(F.slice("t", F.lit(1), F.col("t_at")), F.slice("b", F.lit(1), F.col("b_at")))) == 0
    possible = F.least(F.col("t_size") - F.col("t_at"), F.col("b_size") - F.col("b_at")) >= F.col("needed")
    shared = F.size(F.array_intersect("t", "b"))
    return (
        blocks.join(F.broadcast(templates), ["reach", "w"])  # the templates above, nothing of the corpus
        .where((F.col("b_size") >= F.col("needed")) & possible & first)
        .withColumn("shared", shared)
        .where("shared >= needed")
        .select("row", "reach", "block", "label", (F.col("shared") / F.col("t_size")).alias("containment"))
    )


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: base counts and labels, and the labels and best containment of the templates.

    Null texts are empty: no words, no labels, score 0. Repeated rows and null ids get their own results. ``score`` is 1
    where a base phrase stands, else the best containment found.
    """
    vocabulary = sorted({w for _, text in TEMPLATES for w in text.split()})
    base = stage(base_scan(docs, vocabulary), "license-base")
    found = matches(docs, base, threshold).groupBy("row").agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("best")
    )
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", none)))
    return base.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op5(docs: DataFrame) -> DataFrame:
    return scan(docs)
