"""Report tables: header, rankings, timeline and store metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberflow.functions.times import rfc3339, time_bucket

DEFAULT_TOP = 10


def report_summary(events: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row: time range, events, incidents, incidents not resolved."""
    left = events.agg(
        F.min("timestamp").alias("from"), F.max("timestamp").alias("to"), F.count("*").alias("events")
    ).withColumn("_one", F.lit(1))
    right = incidents.agg(
        F.count("*").alias("incidents"), F.count_if(F.col("status") != "resolved").alias("open_incidents")
    ).withColumn("_one", F.lit(1))
    return left.join(right, "_one").drop("_one")


def ranking(df: DataFrame, column: Column | str, top: int = DEFAULT_TOP) -> DataFrame:
    """Names by falling count, then name; ``top`` 0 keeps all, as a top-k the plan needs no full sort."""
    name = F.col(column) if isinstance(column, str) else column
    counted = df.groupBy(name.alias("name")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "name")
    return counted.limit(top) if top > 0 else counted


def level_ranking(events: DataFrame) -> DataFrame:
    return ranking(events, "level", 0)


def timeline(events: DataFrame, bucket_nanos: int = 0) -> DataFrame:
    """Events per bucket in time order; empty buckets have no row."""
    bucket = time_bucket(F.col("timestamp"), bucket_nanos).alias("time")
    return events.groupBy(bucket).agg(F.count("*").alias("count")).orderBy("time")


def store_metadata(events: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row that describes the stored tables."""
    left = events.agg(
        F.count("*").alias("events"), F.min("timestamp").alias("earliest"), F.max("timestamp").alias("latest")
    ).withColumn("_one", F.lit(1))
    right = incidents.agg(F.count("*").alias("incidents")).withColumn("_one", F.lit(1))
    return left.join(right, "_one").select("events", "incidents", "earliest", "latest")


def status_counts(incidents: DataFrame) -> DataFrame:
    """One row: open (not resolved) and resolved incidents."""
    resolved = F.col("status") == "resolved"
    return incidents.agg(F.count_if(~resolved).alias("open"), F.count_if(resolved).alias("resolved"))


def incident_listing(incidents: DataFrame) -> DataFrame:
    """Display columns in (first_seen, id) order."""
    return incidents.orderBy("first_seen", "id").select(
        "status",
        "severity",
        F.col("rule_id").alias("rule"),
        "group",
        "count",
        rfc3339(F.col("first_seen")).alias("first"),
        rfc3339(F.col("last_seen")).alias("last"),
        "id",
    )
