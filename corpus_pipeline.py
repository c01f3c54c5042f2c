"""A corpus from raw documents: reject toxic ones, strip repeated lines, drop near copies and leaks, tokenise."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake.llm import decontaminate, line_dedup, near_copies, queries, toxicity
from chunklake.llm.common import fresh, remove, scratch, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the bar."""
    return toxicity.without_toxic(docs, queries.model_for(docs, sf_dir))


def strip_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; a document goes only if nothing but blank lines is left of it."""
    removed = fresh(docs, "removed")
    out = line_dedup.dedup_passages(docs, count_col=removed)
    emptied = (F.col(removed) > 0) & (F.regexp_replace("text", r"[\x20\n]+", "") == "")
    out = out.where(~F.coalesce(emptied, F.lit(False)))
    return out.withColumn("n_chars", F.when(F.col(removed) > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group: tiled SimHash over five-word shingles, then exact similarity of 0.8."""
    return near_copies.keep_first(docs).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text that is left, decoded again for the digest."""
    return queries.tokenise(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", strip_repeated_lines),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("sentencepiece", tokenise),
]

#: SQL can express neither the fitted model nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written as Parquet and read again.

    Null texts are not toxic, hold no line and no item, and are copies of each other; a row with a null
    id passes all stages; of rows that share an id one stays; an empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, last = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
