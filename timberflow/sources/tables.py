"""Stored events and incidents: load with row checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberflow import schemas
from timberflow.functions.levels import parse_stored_level
from timberflow.operators import quality
from timberflow.session import prepare


def load_events(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Stored events; a bad row stops the job with its reason.  JSON rows may hold the level as an ordinal."""
    rows = prepare(spark).read.schema(schemas.ddl(schemas.EVENTS)).format(format).load(path)
    if format == "json":
        rows = rows.withColumn("level", F.coalesce(parse_stored_level(F.col("level")), F.col("level")))
    return quality.checked(rows, quality.event_violation())


def load_incidents(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    rows = prepare(spark).read.schema(schemas.ddl(schemas.INCIDENTS)).format(format).load(path)
    return quality.checked(rows, quality.incident_violation())
