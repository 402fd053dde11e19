"""Training-data pipeline over ``documents``: quality, toxicity, near duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows the stage before it kept; ``run`` writes each stage's rows as
Parquet in the shared folder and hands the reread table to the next.  All stages but the last return the columns of
``documents``; the last returns one row per packed piece.

Null texts count as empty and stay null where their row is kept.  A document without doc_id is held out from fitting and is
scored, kept and packed like any other.  Repeated rows are exact copies, of which the near-duplicate stage keeps one.  An empty
table passes through all stages as no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberflow.llm import packing, quality, simhash, surrogates, toxicity
from timberflow.llm.common import small_batches, table, text_of
from timberflow.session import scratch_path

#: Least quality score and least toxicity score at which a document stays and goes.
QUALITY, TOXIC = 0.7, 0.5
#: Key of the test tables' surrogates; a user keeps an own one secret.
KEY = "test tables"

#: SQL cannot express the classifiers, so the pipeline is tested against a brute-force version.
ORACLE_SQL: str | None = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.fit(table(small_batches(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"), parts=4, part=2)
    return docs.filter(quality.scorer(model)(text_of()) >= QUALITY)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject; it learns from the labelled rows of the whole table."""
    model = toxicity.fit(table(small_batches(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"), parts=5, part=0)
    return docs.filter(toxicity.scorer(model)(text_of()) < TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id, or, where no member has one, with the smallest row hash.

    Rows are told apart by id and row hash, so that rows without id count each for itself.
    """
    small_batches(spark)
    named = {"missing": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0)), "hash": F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))}
    key = F.struct(*(value.alias(name) for name, value in named.items()))
    groups = simhash.near_duplicates(docs.select(key.alias("doc_id"), "text"))
    first = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("key")).distinct()
    rows = docs.select(key.alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    one = Window.partitionBy("key").orderBy("row")
    kept = rows.join(first, "key", "left_semi").withColumn("copy", F.row_number().over(one)).filter("copy = 1")
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for their personal data and n_chars counted anew."""
    replaced = surrogates.replace(docs, KEY)
    if "n_chars" not in docs.columns:
        return replaced
    return replaced.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces placed in sequences."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
