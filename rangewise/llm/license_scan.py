"""Licence scan by diagonal voting, in DataFrame operations only.

Every rolling word k-gram of every text is joined by hash with the k-grams of licence
templates (a broadcast table of fixed size; the join's condition compares the gram
itself). A hit at text position p and template position t votes for the diagonal p - t.
Votes are summed by diagonal, neighbouring diagonals (words put in or left out) are
merged, and a merged span is verified: enough of the template's distinct grams stand in
it on diagonals that are less than the template's length apart, so that occurrences that
follow each other and merge are told from scattered grams. A base phrase must have all
its grams on one diagonal.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangewise.llm.common import table

K = 2
#: Diagonals this far apart are neighbours; share of a template's grams that verifies it.
SLACK, COVERAGE = 3, 0.6
#: Fixed values: (label, phrase) that count as base places.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: Characteristic sentences of well-known licences and notices.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc", "this work is licensed under a creative commons attribution license"),
    ("reserved", "all rights reserved"),
)
#: A gram of two such words says nothing about a licence and doesn't vote.
COMMON = frozenset("a all and any are as be by for in is it of on or that the this to under with without you".split())
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words after lower-casing A-Z; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), _BREAK), "")


def template_rows(templates: tuple[tuple[str, str], ...], base: tuple[tuple[str, str], ...]) -> list[tuple]:
    """(template, label, is_base, gram, place, bit, grams, of_words): the grams that vote."""
    rows = []
    for number, (label, text) in enumerate([*base, *templates]):
        own = text.split()
        every = [own[i : i + K] for i in range(len(own) - K + 1)]
        voting = [(i, g) for i, g in enumerate(every) if number < len(base) or not set(g) <= COMMON]
        if len(voting) > 63 or not voting:
            raise ValueError(f"a template must have 1 to 63 voting {K}-grams: {text[:50]}")
        rows += [(number, label, number < len(base), " ".join(g), i, 1 << k, len(voting), len(own)) for k, (i, g) in enumerate(voting)]
    return rows


def template_grams(spark: SparkSession, templates: tuple[tuple[str, str], ...], base: tuple[tuple[str, str], ...]) -> DataFrame:
    schema = "template int, label string, is_base boolean, t_gram string, place int, bit long, grams int, of_words int"
    return spark.createDataFrame(template_rows(templates, base), schema)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, base=BASE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    spans) for every row; spans are the verified (label, first, last) words, score the
    largest share of a template's grams found in one.

    Null and empty texts have no words, no labels and score 0. Equal rows are found once
    and given out as often as they occur; null ids are kept apart by their texts. Other
    columns are not read."""
    spark = docs.sparkSession
    grams = F.broadcast(template_grams(spark, tuple(templates), tuple(base)).withColumn("t_hash", F.xxhash64("t_gram")))  # of fixed size
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"), words(F.col(f"`{text_col}`")).alias("words"))
    n = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("words", 1, n), F.slice("words", 2, n), lambda a, b: F.concat_ws(" ", a, b))
    # the first element, an empty gram, stands for the row itself
    rolled = own.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), pairs)).alias("at", "gram"))
    hits = rolled.withColumn("hash", F.xxhash64("gram")).join(grams, (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")), "left")
    hits = hits.filter((F.col("at") == 0) | F.col("template").isNotNull())
    key = ["doc_id", "text_hash", "n_words"]
    start = F.col("at") - 1
    diagonals = hits.groupBy(*key, "template", "label", "is_base", "grams", "of_words", (start - F.col("place")).alias("diagonal")).agg(
        F.count("*").alias("rows"),
        F.bit_or("bit").alias("voted"),
        F.min(start).alias("first"),
        F.max(start + K - 1).alias("last"),
    )
    whole = F.col("is_base") & (F.bit_count("voted") == F.col("grams"))
    order = Window.partitionBy(*key, "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > SLACK
    runs = diagonals.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("run", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # the grams on a diagonal and on those up to a template's length after it
    near = F.expr(f"bit_or(voted) OVER (PARTITION BY {', '.join(key)}, template, run ORDER BY diagonal / of_words RANGE BETWEEN CURRENT ROW AND 0.999999999D FOLLOWING)")
    runs = runs.withColumn("near", F.bit_count(near)).groupBy(*key, "template", "label", "is_base", "grams", "of_words", "run").agg(
        F.max("rows").alias("rows"),
        F.bit_or("voted").alias("voted"),
        F.max("near").alias("near"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.sum(F.when(whole, 1).otherwise(0)).alias("places"),
        F.min(F.when(whole, F.col("diagonal"))).alias("first_place"),
        F.max(F.when(whole, F.col("diagonal"))).alias("last_place"),
    )
    share = F.when(F.col("is_base"), F.bit_count("voted")).otherwise(F.col("near")) / F.col("grams")
    found = F.when(F.col("is_base"), F.col("places") > 0).otherwise(share >= COVERAGE)
    runs = runs.withColumn("found", F.coalesce(found, F.lit(False)))
    marked = F.when(F.col("template").isNull(), F.col("rows"))
    docs_found = runs.groupBy(*key).agg(
        F.max(marked).alias("rows"),
        F.coalesce(F.sum("places"), F.lit(0)).cast("long").alias("n_base"),
        F.min("first_place").cast("long").alias("first_word"),
        F.max("last_place").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("places") > 0, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("found"), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("found"), share)), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("found"), F.struct("label", "first", "last")))).alias("spans"),
    )
    repeated = docs_found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return repeated.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")
