"""Ingest of several sources: tagged records, first-wins dedup, quarantine and statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberflow import schemas
from timberflow.operators.dedup import dedup_first
from timberflow.session import prepare
from timberflow.settings import LogSource, select_sources
from timberflow.sources.lines import file_sizes
from timberflow.sources.normalize import normalize
from timberflow.sources.readers import line_count, read_records

STATS = ["files", "lines", "records", "rejected", "multiline_joined", "duplicates", "bytes", "first", "last"]


@dataclass
class Ingested:
    tagged: DataFrame
    events: DataFrame
    rejected: DataFrame
    stats: DataFrame


def tagged_source(
    spark: SparkSession, source: LogSource, now: datetime, ordinal: int = 0, precise_epochs: bool = False
) -> DataFrame:
    """All records of a source, good ones and rejected ones, with the place of the source in the order."""
    tagged = normalize(read_records(spark, source), source, now, precise_epochs)
    return tagged.withColumn("input_ord", F.lit(ordinal))


def good(tagged: DataFrame) -> DataFrame:
    return tagged.filter(F.col("reason").isNull())


def rejections(tagged: DataFrame) -> DataFrame:
    return tagged.filter(F.col("reason").isNotNull()).select(*schemas.REJECTED)


def source_stats(tagged: DataFrame, totals: DataFrame) -> DataFrame:
    """Counters per input; ``totals`` holds input, files, lines and bytes.

    The records are read once: per fingerprint and input they become one row, which is enough to see which input has a
    fingerprint's first record.  Rejected records have no fingerprint and are one row per input.
    """
    order = [name for name in ("input_ord", "file", "line") if name in tagged.columns]
    per = tagged.groupBy("input", "fingerprint").agg(
        F.count_if(F.col("reason").isNotNull()).alias("rejected"),
        F.count_if(F.col("reason").isNull()).alias("_good"),
        F.sum("joined").alias("multiline_joined"),
        F.min(F.struct(*order, "timestamp")).alias("_first"),
    )
    earliest = F.min("_first").over(Window.partitionBy("fingerprint"))
    kept = F.col("fingerprint").isNotNull() & (F.col("_first") == earliest)
    per = per.withColumn("_at", F.when(kept, F.col("_first.timestamp"))).withColumn("_kept", kept.cast("int"))
    seen = per.groupBy("input").agg(
        *[F.sum(name).alias(name) for name in ("rejected", "_good", "multiline_joined")],
        F.sum("_kept").alias("records"),
        F.min("_at").alias("first"),
        F.max("_at").alias("last"),
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)
    duplicates = F.coalesce(F.col("_good"), F.lit(0)) - F.coalesce(F.col("records"), F.lit(0))
    return totals.join(seen, "input", "left").select(
        "input",
        zero("files"),
        zero("lines"),
        zero("records"),
        zero("rejected"),
        zero("multiline_joined"),
        duplicates.alias("duplicates"),
        zero("bytes"),
        "first",
        "last",
    )


def merged_stats(stats: DataFrame) -> DataFrame:
    """One row over all inputs."""
    sums = [F.sum(name).cast("bigint").alias(name) for name in STATS[:-2]]
    return stats.agg(*sums, F.min("first").alias("first"), F.max("last").alias("last"))


def ingest(
    spark: SparkSession,
    sources: Sequence[LogSource],
    now: datetime,
    names: Sequence[str] = (),
    precise_epochs: bool = False,
) -> Ingested:
    """Read sources in their order; the first record of each fingerprint is kept."""
    prepare(spark)
    chosen = select_sources(sources, names)
    parts, totals = [], []
    for ordinal, source in enumerate(chosen):
        tagged = tagged_source(spark, source, now, ordinal, precise_epochs)
        sizes = file_sizes(spark, source.path).agg(
            F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")
        )
        name = F.lit(source.name).alias("input")
        lines = line_count(spark, source, tagged).select("lines", name)
        totals.append(sizes.select("*", name).join(lines, "input"))
        parts.append(tagged)
    tagged = reduce(DataFrame.unionByName, parts)
    kept = dedup_first(good(tagged))
    stats = source_stats(tagged, reduce(DataFrame.unionByName, totals))
    return Ingested(tagged, kept.select(*schemas.EVENTS), rejections(tagged), stats)
