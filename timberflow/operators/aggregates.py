"""Time-series metrics, counts, rates and frequent terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberflow.functions.fields import MISSING, field_value
from timberflow.functions.text import SPACE_CLASS
from timberflow.functions.times import floor_div, time_bucket
from timberflow.settings import duration_nanos

# Fixed value: punctuation cut from both ends of a word.
WORD_EDGES = "\"'.,:;!?()[]{}"


def bucket_of(text: str) -> int:
    """Nanoseconds of a bucket setting, which must be positive."""
    nanos = duration_nanos(text)
    if nanos <= 0:
        raise ValueError("bucket must be positive")
    return nanos


def metric_series(events: DataFrame, bucket_nanos: int = 0, approximate: bool = False) -> DataFrame:
    """Per (bucket, source, level): count, distinct fingerprints, first, last, message bytes; in key order.

    The exact distinct count shuffles once on (key, fingerprint), so a hot key is spread by its fingerprints.
    """
    distinct = F.approx_count_distinct("fingerprint") if approximate else F.count_distinct("fingerprint")
    return (
        events.groupBy(time_bucket(F.col("timestamp"), bucket_nanos).alias("bucket"), "source", "level")
        .agg(
            F.count("*").alias("count"),
            distinct.alias("unique_fingerprints"),
            F.min("timestamp").alias("first"),
            F.max("timestamp").alias("last"),
            F.sum(F.octet_length("message").cast("bigint")).alias("bytes"),
        )
        .orderBy("bucket", "source", "level")
    )


def series_total(series: DataFrame) -> DataFrame:
    return series.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))


def count_by(events: DataFrame, column: Column, name: str) -> DataFrame:
    return events.groupBy(column.alias(name)).agg(F.count("*").alias("count"))


def by_source(events: DataFrame) -> DataFrame:
    return count_by(events, F.col("source"), "source")


def by_level(events: DataFrame) -> DataFrame:
    return count_by(events, F.col("level"), "level")


def by_field(events: DataFrame, name: str) -> DataFrame:
    return count_by(events, F.coalesce(field_value(name), F.lit(MISSING)), "value")


def event_rate(events: DataFrame, window_nanos: int) -> DataFrame:
    """One row: events per second over the covered time, which counts as at least the window."""
    if window_nanos <= 0:
        return events.agg(F.lit(0.0).alias("rate"))
    at = F.struct(F.unix_micros("timestamp").alias("us"), F.coalesce(F.col("ts_nanos"), F.lit(0)).alias("nanos"))
    span = events.agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    covered = (F.col("last.us") - F.col("first.us")) * 1000 + (F.col("last.nanos") - F.col("first.nanos"))
    nanos = F.greatest(covered, F.lit(window_nanos).cast("bigint"))
    seconds = floor_div(nanos, 1_000_000_000).cast("double") + (nanos % 1_000_000_000).cast("double") / 1e9
    return span.select(F.when(F.col("n") == 0, 0.0).otherwise(F.col("n").cast("double") / seconds).alias("rate"))


def search_terms(events: DataFrame, minimum: int) -> DataFrame:
    """Words of three bytes or more in at least ``minimum`` messages, most frequent first."""
    words = F.split(F.lower("message"), SPACE_CLASS + "+")
    trimmed = F.transform(words, lambda word: F.btrim(word, F.lit(WORD_EDGES)))
    terms = events.select(F.explode(F.array_distinct(trimmed)).alias("term")).filter(F.octet_length("term") >= 3)
    counted = terms.groupBy("term").agg(F.count("*").alias("frequency")).filter(F.col("frequency") >= minimum)
    return counted.orderBy(F.desc("frequency"), "term")
