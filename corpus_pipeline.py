"""The corpus pipeline: five stages, each an operator whose decisions take effect.

A stage gets the documents that the one before it kept, written as Parquet and read
again, and returns the columns of documents; the last one returns the mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangewise.llm import decontaminate, language_id, mixing, near_copies, secret_scan
from rangewise.llm.common import dropped, over_texts, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (no text, or none with a letter) go; a missing
    language is filled in. Where there is nothing to learn from, documents with a
    letter stay, and a missing language stays missing."""
    network = language_id.train(docs)
    if network is None:
        letters = over_texts(docs, lambda texts: {"some": [language_id.has_letter(t) for t in texts]}, "some boolean", more=COLUMNS[1:])
        return letters.filter("some").select(*COLUMNS)
    found = language_id.identify(docs, network, keep=COLUMNS[1:]).filter(F.col("lang_pred") != language_id.UND)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of exact and near copies (five words, 0.8) one row stays: one of the
    smallest id, or one without an id where no row has one. Rows are told apart by id
    and all columns, so that rows of one id with different texts are decided apart."""
    docs = docs.select(*COLUMNS).withColumn("own", F.xxhash64(*COLUMNS[1:]))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own")
    rows = near_copies.grouped(docs, more=("own",)).select("root", place.alias("place"))
    equal = rows.groupBy("root", "place").agg(F.count("*").alias("rows"))
    judged = equal.join(rows.groupBy("root").agg(F.min("place").alias("stays")), "root")
    stays = (F.col("place") == F.col("stays")).alias("stays")
    judged = written(judged.select(F.col("place.doc_id").alias("id"), F.col("place.own").alias("of"), stays, "rows"))
    dropped(rows)
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("of"))
    alone = docs.join(judged.filter("not stays or rows > 1"), same, "left_anti")
    # of equal rows that are to stay, all but one go
    repeated = docs.join(judged.filter("stays and rows > 1"), same, "left_semi").dropDuplicates(["doc_id", "own"])
    return alone.unionByName(repeated).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    found = decontaminate.search(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS[1:])
    return found.filter(F.size("hits") == 0).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced by their kind."""
    return secret_scan.redacted(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources to target weights, in shuffled shards; a document of which
    the mix takes its first words only is cut to them."""
    return mixing.shards(mixing.mix(docs, keep=("text", "lang", "source")), "text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secrets),
    ("mixing", mixture),
]

#: Trained models and similarity groups have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
