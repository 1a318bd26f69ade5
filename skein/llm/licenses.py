"""License scans by diagonal voting.

All rolling word bigrams of every text are joined to the positions at which
they stand in the license templates (a small fixed table, broadcast).  A hit
votes for the diagonal ``text position - template position``; hits are
aggregated to one bit mask of matched template positions per (row, template,
diagonal), neighbouring diagonals are merged (inserted or missing words shift
the diagonal by a few), and a merged span is kept when enough of the template
voted and the span is not much longer than the template.  The join compares
the words themselves beside their hash, so a kept phrase is exact.

A template has at most 62 words, so that its matched positions fit one mask;
longer license texts are entered as several templates with one label.

Defined results: a null or empty text has no words and no labels; repeated
rows get equal results (the masks are idempotent); an empty table gives no
rows; extra columns are not read.  A null ``doc_id`` is matched null-safely
together with the text's hash and word count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

#: fixed word class: lower-case letters, digits and everything above ASCII
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False      # a phrase that must stand word for word
    slack: int = 3          # neighbouring diagonals merged up to this distance
    least: float = 0.6      # share of the template's bigrams that must vote
    seed: int = 2           # votes that a diagonal needs to take part in a merge


def phrase(label: str, text: str) -> Template:
    return Template(label, text, base=True, slack=0, least=1.0, seed=1)


TEMPLATES: tuple[Template, ...] = (
    phrase("mit", "mit license"),
    phrase("apache", "apache license"),
    phrase("gpl", "general public license"),
    # public license notices, a sentence or two each
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of "
             "this software and associated documentation files the software to deal in the "
             "software without restriction"),
    Template("apache", "you may not use this file except in compliance with the license you may "
             "obtain a copy of the license at"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under "
             "the terms of the gnu general public license as published by the free software "
             "foundation"),
    Template("lgpl", "gnu lesser general public license", slack=1, least=0.8),
    Template("bsd", "redistribution and use in source and binary forms with or without "
             "modification are permitted provided that the following conditions are met"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license"),
    Template("cc-by-nc", "licensed under cc by nc", slack=1, least=0.75),
    Template("cc-by-sa", "licensed under cc by sa", slack=1, least=0.9),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("proprietary", "all rights reserved unauthorized copying of this file via any medium "
             "is strictly prohibited"),
)


def template_grams(templates=TEMPLATES) -> list[tuple[int, int, str, str]]:
    """``(template, position, word, next word)`` of every template bigram."""
    out = []
    for t, template in enumerate(templates):
        words = template.text.split()
        if not 2 <= len(words) <= 62:
            raise ValueError(f"template {t} has {len(words)} words, not 2 to 62")
        out += [(t, i, a, b) for i, (a, b) in enumerate(zip(words, words[1:]))]
    return out


def words_of(text: Column) -> Column:
    # only A-Z matter to the templates; other letters keep their class
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("th"),
                       words_of(body).alias("words"))


def votes(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id",
          text: str = "text") -> DataFrame:
    """One row per (row, template, diagonal) with its mask of matched positions."""
    spark = docs.sparkSession
    table = (spark.createDataFrame(template_grams(templates),
                                   "t int, at int, a string, b string")
             .withColumn("gram", F.xxhash64("a", "b")).hint("broadcast"))
    pairs = F.arrays_zip(F.col("words").alias("x"),
                         F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(1))).alias("y"))
    grams = (_rows(docs, id_col, text)
             .select("id", "th", F.size("words").alias("n"), F.posexplode(pairs).alias("pos", "w"))
             .select("id", "th", "n", "pos", F.col("w.x").alias("x"), F.col("w.y").alias("y")))
    hits = grams.join(table, (F.xxhash64("x", "y") == table["gram"])
                      & (F.col("x") == table["a"]) & (F.col("y") == table["b"]))
    return (hits.groupBy("id", "th", "n", "t", (F.col("pos") - F.col("at")).alias("diag"))
            .agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask")))


def spans(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id",
          text: str = "text") -> DataFrame:
    """Verified spans: ``id, th, n, t, start, stop, share`` (words, stop
    exclusive; ``share`` of the template's bigrams that voted)."""
    def per(values) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("t") + 1)
    slack, least = per([t.slack for t in templates]), per([float(t.least) for t in templates])
    seed, size = per([t.seed for t in templates]), per([len(t.text.split()) for t in templates])
    first = F.expr("bit_count((mask & -mask) - 1)")   # lowest matched position
    top = F.length(F.bin("mask")) - 1                 # highest matched position
    line = Window.partitionBy("id", "th", "n", "t").orderBy("diag")
    strong = (votes(docs, templates, id_col, text)
              .where(F.bit_count("mask") >= seed)
              .withColumn("opens", F.when(
                  F.col("diag") - F.lag("diag").over(line) <= slack, 0).otherwise(1))
              .withColumn("island", F.sum("opens").over(line)))
    merged = (strong.groupBy("id", "th", "n", "t", "island")
              .agg(F.bit_or("mask").alias("mask"),
                   F.min(F.col("diag") + first).alias("start"),
                   F.max(F.col("diag") + top + 2).alias("stop")))
    return (merged.withColumn("share", F.bit_count("mask") / (size - 1))
            .where((F.col("share") >= least)
                   & (F.col("stop") - F.col("start") <= F.ceil(size * 1.5)))
            .drop("mask", "island"))


def scan(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id",
         text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id_col, n_words, n_base, first_word, last_word,
    base_labels, labels, score``."""
    label = F.element_at(F.array(*[F.lit(t.label) for t in templates]), F.col("t") + 1)
    base = F.element_at(F.array(*[F.lit(t.base) for t in templates]), F.col("t") + 1)

    def joined(names: Column) -> Column:
        return F.array_join(F.sort_array(names), ",")
    found = (spans(docs, templates, id_col, text)
             .withColumn("label", label).withColumn("base", base)
             .groupBy(F.col("id").alias("fid"), F.col("th").alias("fth"), F.col("n").alias("fn"))
             .agg(F.count_if("base").alias("n_base"),
                  F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
                  F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
                  joined(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
                  joined(F.collect_set("label")).alias("labels"),
                  F.max("share").alias("score")))
    rows = _rows(docs, id_col, text).select("id", "th", F.size("words").alias("n"))
    return (rows.join(found, F.col("id").eqNullSafe(F.col("fid")) & (F.col("th") == F.col("fth"))
                      & (F.col("n") == F.col("fn")), "left")
            .select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_words"),
                    F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
                    "first_word", "last_word",
                    F.coalesce("base_labels", F.lit("")).alias("base_labels"),
                    F.coalesce("labels", F.lit("")).alias("labels"),
                    F.coalesce("score", F.lit(0.0)).alias("score")))
