"""The ``events`` test table as raw log records and as normalized events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberflow import schemas
from timberflow.functions import event_fingerprint, event_id, normalize_message, normalize_source, parse_level
from timberflow.functions.times import instant
from timberflow.session import prepare

NOW = datetime(2024, 1, 31)
TIMES = ("timestamp", "ts")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Test table with its zone-less times read as UTC."""
    prepare(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    zoneless = [column for column, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({column: F.col(column).cast("timestamp") for column in zoneless})


def raw_records(spark: SparkSession, folder: str) -> DataFrame:
    """Raw log records: time, level alias, source and message before any normalization."""
    kind, value, user = F.col("event_type"), F.col("value"), F.col("user_id")
    level = (
        F.when(kind == "view", "debug")
        .when(kind == "click", "Information")
        .when(kind == "signup", "NOTICE")
        .when(kind == "purchase", "warning")
        .when(value >= 40, "crit")
        .otherwise("err")
    )
    message = F.concat(
        kind, F.lit(" value ("), F.floor(value).cast("bigint").cast("string"), F.lit("), user "), user.cast("string")
    )
    return table(spark, folder, "events").select(
        F.col("ts").alias("timestamp"),
        level.alias("level"),
        F.concat(F.lit(" Svc "), (user % 12).cast("string"), F.lit(" ")).alias("source"),
        message.alias("message"),
        F.get_json_object("props", "$.k").alias("k"),
        "event_id",
        "value",
    )


def to_events(raw: DataFrame, timestamp: Column | str = "timestamp") -> DataFrame:
    """Normalized events of the raw records."""
    timestamp = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    fields = F.create_map(
        F.lit("k"), F.col("k"), F.lit("volatile.event_id"), F.col("event_id").cast("string")
    )
    shaped = raw.select(
        timestamp.alias("timestamp"),
        F.lit(0).alias("ts_nanos"),
        parse_level(F.col("level")).alias("level"),
        normalize_source(F.col("source")).alias("source"),
        normalize_message(F.col("message")).alias("message"),
        fields.alias("fields"),
        F.lit("events").alias("input"),
        (F.col("event_id") + 1).alias("line"),
    )
    print_ = event_fingerprint(F.col("source"), F.col("level"), F.col("message"), F.col("fields"))
    named = shaped.withColumn("fingerprint", print_).withColumn("ingested_at", instant(NOW))
    identity = event_id(F.col("timestamp"), F.col("ts_nanos"), F.col("source"), F.col("level"), F.col("fingerprint"))
    return named.withColumn("id", identity).select(*schemas.EVENTS)


def events(spark: SparkSession, folder: str) -> DataFrame:
    return to_events(raw_records(spark, folder))


def hourly_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with their time cut to the hour, so that groups hold many rows of the same instant."""
    return to_events(raw_records(spark, folder), F.date_trunc("hour", "timestamp"))


def zoneless(df: DataFrame) -> DataFrame:
    """UTC wall-clock times, the form the checks compare."""
    times = [column for column, kind in df.dtypes if kind == "timestamp"]
    return df.withColumns({column: F.col(column).cast("timestamp_ntz") for column in times}) if times else df
