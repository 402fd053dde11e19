"""Streams of log files and events."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from timberflow import schemas
from timberflow.functions.times import ORIGIN_MICROS
from timberflow.operators.dedup import dedup_first
from timberflow.operators.keys import KeyTable
from timberflow.session import materialize, prepare
from timberflow.settings import LogSource
from timberflow.sources.csv_records import read_headers, records
from timberflow.sources.ingest import good, rejections
from timberflow.sources.lines import text_rows, with_seq
from timberflow.sources.normalize import normalize
from timberflow.sources.readers import jsonl_records

# Size of the sketches: a relative standard error of about 1.04 / sqrt(2 ** bits), 0.8 %.
SKETCH_BITS = 14


def event_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of stored events that arrive as Parquet files."""
    reader = prepare(spark).readStream.schema(schemas.ddl(schemas.EVENTS))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def start_ingest(
    spark: SparkSession, source: LogSource, store: str, now: datetime, files_per_trigger: int | None = None
) -> StreamingQuery:
    """Ingest new JSONL or CSV files into ``store``: tables events and rejected, one folder per micro-batch.

    Each batch holds whole files, so line numbers are exact.  A fingerprint stored before, or seen earlier in the
    batch, is dropped; of what is stored only the keys in buckets that a batch may repeat are read.  A batch that is
    run again overwrites its own folders and does not look at them.
    """
    reader = prepare(spark).readStream.option("lineSep", "\n")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    lines = text_rows(reader.text(source.path))
    headers = None
    if source.format == "csv":
        headers = source.csv_columns or read_headers(spark, source.path)
    elif source.format != "jsonl":
        raise ValueError("only jsonl and csv sources can be streamed")

    def store_batch(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        scanned = with_seq(batch)
        raw = records(scanned, headers, not source.csv_columns) if headers else jsonl_records(scanned, source)
        tagged = materialize(normalize(raw, source, now))
        keys = KeyTable(session, store, range(epoch))
        fresh = keys.new_rows(dedup_first(good(tagged))).select(*schemas.EVENTS)
        rejections(tagged).write.mode("overwrite").parquet(f"{store}/rejected/epoch={epoch}")
        fresh.write.mode("overwrite").parquet(f"{store}/events/epoch={epoch}")
        # Written before the batch counts as done; a batch that is run again does not look at its own keys.
        keys.add(session.read.schema(schemas.ddl(schemas.EVENTS)).parquet(f"{store}/events/epoch={epoch}"), epoch)

    return (
        lines.writeStream.foreachBatch(store_batch)
        .option("checkpointLocation", f"{store}/_progress/ingest")
        .trigger(availableNow=True)
        .start()
    )


def dedup_stream(events: DataFrame, horizon: str) -> DataFrame:
    """First arrival of each fingerprint; copies later than the horizon after it may come through again.

    State is bounded by the horizon, unlike that of the batch form.
    """
    return events.withWatermark("timestamp", horizon).dropDuplicatesWithinWatermark(["fingerprint"])


def metrics_stream(events: DataFrame, bucket_seconds: int, delay: str) -> DataFrame:
    """Tumbling metrics in the buckets of the batch form; rows later than the delay are dropped.

    Distinct fingerprints are kept as a sketch, so that buckets can be merged later (:func:`rolled_up`); the count in
    ``unique_fingerprints`` is the sketch's estimate.
    """
    shift = -(ORIGIN_MICROS // 1_000_000) % bucket_seconds
    bucket = F.window("timestamp", f"{bucket_seconds} seconds", f"{bucket_seconds} seconds", f"{shift} seconds")
    return (
        events.withWatermark("timestamp", delay)
        .groupBy(bucket.alias("_window"), "source", "level")
        .agg(
            F.count("*").alias("count"),
            F.hll_sketch_agg("fingerprint", SKETCH_BITS).alias("fingerprints"),
            F.min("timestamp").alias("first"),
            F.max("timestamp").alias("last"),
            F.sum(F.octet_length("message").cast("bigint")).alias("bytes"),
        )
        .select(
            F.col("_window.start").alias("bucket"),
            *["source", "level", "count"],
            F.hll_sketch_estimate("fingerprints").alias("unique_fingerprints"),
            *["first", "last", "bytes", "fingerprints"],
        )
    )


def rolled_up(metrics: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    """Metrics of several buckets, sources or levels put together by their sums, ends and sketches."""
    return metrics.groupBy(*keys).agg(
        F.sum("count").alias("count"),
        F.hll_sketch_estimate(F.hll_union_agg("fingerprints")).alias("unique_fingerprints"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.sum("bytes").alias("bytes"),
    )


def session_stream(matched: DataFrame, gap: str, delay: str) -> DataFrame:
    """Runs of matching events (columns rule_id, grp, timestamp) with no pause as long as the gap."""
    return (
        matched.withWatermark("timestamp", delay)
        .groupBy(F.session_window("timestamp", gap).alias("_session"), "rule_id", "grp")
        .agg(F.count("*").alias("count"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
        .select("rule_id", "grp", "first", "last", "count")
    )


def start_to_table(stream: DataFrame, path: str) -> StreamingQuery:
    """Append the closed results of a stream to a Parquet table."""
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", f"{path}/_progress")
        .trigger(availableNow=True)
        .start(f"{path}/data")
    )
