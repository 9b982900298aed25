"""License scan by diagonal voting. DataFrame functions only.

Every rolling word 3-gram of every text is joined, by its hash, to the positions of the templates
that hold it (a fixed table, so it is broadcast); the words are compared again on a hit. A hit
votes for its diagonal, the text position minus the template position. Votes of a diagonal
combine into a bit mask of template positions before the shuffle, so memory does not grow with a
text's length. Diagonals at most ``slip`` apart merge, and a merged span is verified by the share
of the template's grams it covers and by its length.

A phrase is found where its words stand consecutively: one diagonal with every gram. A notice is
found where a verified span covers ``share`` of its grams.

Null and empty texts have no words and no labels. Repeated rows each get a row, extra columns are
ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_of

K, SLIP, SHARE = 3, 2, 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# The phrases and their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# Well-known license notices, up to 65 words each.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
            "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
            "merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
                 "license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
            "conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
            "as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
MAX_WORDS = 62 + K


def template_rows(phrases: list[tuple[str, str]], notices: list[tuple[str, str]]) -> list[tuple]:
    """(template, label, exact, grams, position, three words) for every gram of every template."""
    rows = []
    for t, (label, text, exact) in enumerate([(a, b, True) for a, b in phrases] + [(a, b, False) for a, b in notices]):
        words = text.split(" ")
        if not K <= len(words) <= MAX_WORDS:
            raise ValueError(f"a template needs {K} to {MAX_WORDS} words: {text!r}")
        rows += [(t, label, exact, len(words) - K + 1, p, *words[p:p + K]) for p in range(len(words) - K + 1)]
    return rows


def words_of(text: Column) -> Column:
    """The words of a text, lower-cased. ``lower`` folds other letters too, of which only the Kelvin
    sign would turn into an ASCII letter; it is swapped for another letter before."""
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u0101"))), SEPARATORS), "")


def votes(docs: DataFrame, phrases: list[tuple[str, str]], notices: list[tuple[str, str]], id_col: str, text_col: str) -> DataFrame:
    """(uid, id, n_words, template or null, label, exact, grams, diagonal, mask): one row per diagonal
    with votes, and at least one per row of ``docs``."""
    spark: SparkSession = docs.sparkSession
    templates = spark.createDataFrame(template_rows(phrases, notices),
                                      "template int, label string, exact boolean, grams int, at int, t0 string, t1 string, t2 string")
    templates = templates.withColumn("g", F.xxhash64("t0", "t1", "t2"))
    w = F.col("w")
    later = lambda n: F.slice(w, n, F.greatest(F.size(w), F.lit(1)))
    words = docs.select(F.monotonically_increasing_id().alias("uid"), docs[id_col].alias("id"), words_of(text_of(docs[text_col])).alias("w"))
    # The word count is taken first, so that the exploded rows do not carry the array.
    zipped = words.select("uid", "id", F.size(w).cast("long").alias("n_words"), F.arrays_zip(w.alias("a"), later(2).alias("b"), later(3).alias("c")).alias("z"))
    rolled = zipped.select("uid", "id", "n_words", F.posexplode_outer("z").alias("pos", "three")).select("uid", "id", "n_words", "pos", "three.*")
    keyed = rolled.withColumn("h", F.when(F.col("c").isNotNull(), F.xxhash64("a", "b", "c")))
    met = keyed.join(F.broadcast(templates), F.col("h") == F.col("g"), "left").filter("template is not null or pos is null or pos = 0")
    same = (F.col("a") == F.col("t0")) & (F.col("b") == F.col("t1")) & (F.col("c") == F.col("t2"))
    if_same = lambda c: F.when(same, F.col(c))
    named = met.select("uid", "id", "n_words", *[if_same(c).alias(c) for c in ("template", "label", "exact", "grams", "at")],
                       if_same("pos").alias("pos"))
    return named.groupBy("uid", "id", "n_words", "template", "label", "exact", "grams", (F.col("pos") - F.col("at")).alias("diagonal")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"))


def merge(voted: DataFrame, slip: int = SLIP) -> DataFrame:
    """Votes with neighbouring diagonals of a template merged: (uid, template, id, n_words, label, exact, grams, n_base,
    first_word, last_word, met, first, last): places of whole phrases, grams met, and the span in words."""
    place = F.col("exact") & (F.bit_count("mask") == F.col("grams"))
    start = F.when(place, F.col("diagonal").cast("long"))
    by = Window.partitionBy("uid", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > slip, F.lit(True)).cast("int")
    cluster = F.sum("_cue_new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lowest, highest = F.expr("diagonal + bit_count(mask ^ (mask - 1)) - 1"), F.expr(f"diagonal + length(bin(mask)) + {K - 2}")
    return voted.withColumn("_cue_new", apart).withColumn("cluster", cluster).groupBy("uid", "id", "n_words", "template", "label", "exact", "grams", "cluster").agg(
        F.bit_count(F.bit_or("mask")).alias("met"),
        F.count(start).alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"),
        F.min(lowest).alias("first"), F.max(highest).alias("last"))


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES, slip: int = SLIP,
         share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row."""
    voted = votes(docs, phrases, notices, id_col, text_col)
    merged = merge(voted, slip)
    cover = F.col("met") / F.col("grams")
    short = F.col("last") - F.col("first") + 1 <= 1.25 * (F.col("grams") + K - 1)
    notice = ~F.col("exact") & (cover >= share) & short
    base = F.when(F.col("n_base") > 0, F.col("label"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return merged.groupBy("uid", "id", "n_words").agg(
        F.sum("n_base").alias("n_base"), F.min("first_word").alias("first_word"),
        F.max("last_word").alias("last_word"), listed(base).alias("base_labels"), listed(F.when(notice, F.col("label")).otherwise(base)).alias("labels"),
        F.round(F.coalesce(F.max(F.when(F.col("n_base") > 0, 1.0).otherwise(cover)), F.lit(0.0)), 6).alias("score")) \
        .select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
