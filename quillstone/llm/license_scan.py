"""License scans by diagonal voting: word k-grams of texts meet template positions, hits vote for offsets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.base import cut, documents, let, load

SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
GRAM = 3


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False


#: Fixed phrases: each must stand word for word.
PHRASES = [
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
]
#: Fixed notices of public licenses: found also with some words changed, added or left out.
NOTICES = [
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template("gpl-3", "licensed under the gnu general public license version 3"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
]


def words(text: Column) -> Column:
    """Runs of digits, letters and everything above ASCII. Of the letters that lower() folds besides A-Z only the
    Kelvin sign becomes an ASCII letter (k), which no fixed phrase holds; word bounds are the same either way."""

    def inner(w: Column) -> Column:
        first, last = F.when(F.get(w, F.lit(0)) == "", 2).otherwise(1), F.when(F.get(w, F.size(w) - 1) == "", 1).otherwise(0)
        return F.slice(w, first, F.greatest(F.size(w) - (first - 1) - last, F.lit(0)))

    return let(F.split(F.lower(F.coalesce(text, F.lit(""))), f"[{SEPARATORS}]+", -1), inner)


def template_table(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """Positions of the templates' k-grams: a fixed list of at most 62 words each, so its size is bounded."""
    rows = []
    for number, t in enumerate(templates):
        w = t.text.split()
        if not GRAM <= len(w) <= 62:
            raise ValueError(f"a template has {GRAM} to 62 words: {t.text}")
        rows += [(w[i : i + GRAM], number, i, len(w) - GRAM + 1, t.label, t.exact) for i in range(len(w) - GRAM + 1)]
    held = spark.createDataFrame(rows, "t_gram array<string>, template int, t_pos int, n_grams int, label string, exact boolean")
    return held.withColumn("gram_hash", gram_hash(F.col("t_gram"), F.lit(0)))


def gram_hash(w: Column, at: Column) -> Column:
    return F.xxhash64(*[F.get(w, at + k) for k in range(GRAM)])


def rolled(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text_hash, n_words, grams: position, hash and words of the rolling k-grams whose hash a template has.

    Every text is split once. The templates' hashes are few and thin the k-grams out
    before these become rows of the join.
    """
    known = [r[0] for r in templates.select("gram_hash").distinct().collect()]

    def hits(w: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(w) - GRAM), lambda i: gram_hash(w, i).isin(known))
        found = F.transform(places, lambda i: F.struct(i.alias("pos"), gram_hash(w, i).alias("gram_hash"), F.slice(w, i + 1, GRAM).alias("gram")))
        return F.struct(F.size(w).cast("bigint").alias("n_words"), F.when(F.size(w) >= GRAM, found).alias("grams"))

    held = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), let(words(F.col("text")), hits).alias("h"))
    return held.select("doc_id", "text_hash", "h.n_words", "h.grams")


def scan(docs: DataFrame, templates: list[Template], min_cover: float = 0.6, max_shift: int = 2) -> DataFrame:
    """Places of templates in docs(doc_id, text): doc_id, text_hash, label, exact, start, end, cover, found; see places."""
    known = template_table(docs.sparkSession, templates)
    return places(cut(rolled(docs, known), "grams"), known, min_cover, max_shift)


def places(grams: DataFrame, templates: DataFrame, min_cover: float = 0.6, max_shift: int = 2) -> DataFrame:
    """Places of templates among rolled k-grams.

    The k-grams meet the template positions by hash (and must be equal word
    for word); hits add up per diagonal, text position minus template position. An
    exact phrase stands where its diagonal is full. Diagonals of a notice that lie
    within ``max_shift`` of one another are one place; it counts when it covers
    ``min_cover`` of the template's k-grams in a span of at most one and a half lengths.
    Only hits are shuffled, after they are summed per diagonal; null and short texts
    have none. Rows equal in id and text count once.
    """
    key = ["doc_id", "text_hash"]
    each = grams.select(*key, F.explode("grams").alias("g")).select(*key, "g.pos", "g.gram_hash", "g.gram")
    hits = each.join(F.broadcast(templates), "gram_hash").where("gram = t_gram")
    vote = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("t_pos"))
    diagonals = hits.groupBy(*key, "template", "label", "exact", "n_grams", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(F.bit_or(vote).alias("votes"), F.min("pos").alias("start"), (F.max("pos") + GRAM).alias("end"))
    order = Window.partitionBy(*key, "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("exact"), 0).otherwise(max_shift), F.lit(True))
    merged = diagonals.withColumn("apart", apart.cast("int")).withColumn("place", F.sum("apart").over(order))
    merged = merged.groupBy(*key, "template", "label", "exact", "n_grams", "place").agg(F.bit_or("votes").alias("votes"), F.min("start").alias("start"), F.max("end").alias("end"))
    cover = F.bit_count("votes") / F.col("n_grams")
    fits = F.when(F.col("exact"), F.bit_count("votes") == F.col("n_grams")).otherwise((cover >= min_cover) & ((F.col("end") - F.col("start")) <= 1.5 * (F.col("n_grams") + GRAM - 1)))
    return merged.select(*key, "label", "exact", "start", "end", cover.alias("cover"), fits.alias("found"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and labels of every document.

    Null texts count as empty: no words, no labels, score 0. Ties and repeats of a
    label count once in the lists, every place counts in n_base. Repeated rows give
    repeated rows, an empty table an empty result; further columns are ignored.
    """
    known = template_table(spark, PHRASES + NOTICES)
    grams = cut(rolled(documents(load(spark, sf_dir, "documents")), known), "grams")
    found = places(grams, known)
    base = F.col("exact") & F.col("found")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    by_doc = found.groupBy("doc_id", "text_hash").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("bigint").alias("last_word"),
        listed(F.when(base, F.col("label"))).alias("base_labels"),
        listed(F.when(F.col("found"), F.col("label"))).alias("labels"),
        F.max("cover").alias("score"),
    )
    rows = grams.select("doc_id", "text_hash", "n_words").alias("d")
    joined = rows.join(by_doc.alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.text_hash") == F.col("h.text_hash")), "left")
    return joined.select(
        "d.doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
