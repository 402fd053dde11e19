"""Named snapshots of a store: descriptors that keep the folders of a version."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberflow.functions.times import instant
from timberflow.operators.folders import folders
from timberflow.operators.reports import store_metadata
from timberflow.operators.versions import Versions

TABLES = ["events", "incidents"]


def check_name(name: str) -> str:
    if not name or name in (".", "..") or any(char in name for char in "\\/:"):
        raise ValueError(f"invalid snapshot name {name!r}")
    return name


def create_snapshot(spark: SparkSession, store: str, name: str, now: datetime, root_digest: str | None = None) -> DataFrame:
    """Keep the live version of a store as ``snapshots/<name>`` and return the descriptor; an existing name is an error.

    Folders never change, so nothing is copied.  The digest is the version's own unless one is given.
    """
    versions = Versions(spark, store)
    state = versions.current()
    target = f"{store}/snapshots/{check_name(name)}"
    described = store_metadata(versions.read_events(state), versions.read_incidents(state))
    descriptor = described.select(
        F.lit(name).alias("name"),
        instant(now).alias("created"),
        F.lit(state["generation"]).cast("bigint").alias("generation"),
        "events",
        "incidents",
        "earliest",
        "latest",
        F.lit(state["root_digest"] if root_digest is None else root_digest).alias("root_digest"),
        F.lit(",".join(TABLES)).alias("files"),
        F.lit(state["segments"]).cast("array<string>").alias("segments"),
        F.lit(state["incidents"]).cast("string").alias("incidents_path"),
    )
    descriptor.write.parquet(f"{target}/descriptor")
    return spark.read.parquet(f"{target}/descriptor").drop("segments", "incidents_path")


def _descriptors(spark: SparkSession, store: str, name: str = "*") -> list[dict]:
    rows = spark.read.parquet(f"{store}/snapshots/{name}/descriptor").collect() if folders(spark, f"{store}/snapshots") else []
    return [{"segments": row["segments"], "incidents": row["incidents_path"], "index": None} for row in rows]


def list_snapshots(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/snapshots/*/descriptor").drop("segments", "incidents_path").orderBy("name")


def restore_snapshot(spark: SparkSession, store: str, name: str) -> None:
    """Make the tables of a snapshot live again, both at once, with an index derived from them anew."""
    versions = Versions(spark, store)
    (kept,) = _descriptors(spark, store, check_name(name))
    state = versions.current()
    state |= kept | {"generation": state["generation"] + 1, "manifest": None, "root_digest": ""}
    versions.switch(versions.write_index(state))


def cleanup(spark: SparkSession, store: str) -> list[str]:
    """Remove what no live table and no snapshot needs; returns the removed folders."""
    return Versions(spark, store).cleanup(_descriptors(spark, store))


def save_store(events: DataFrame, incidents: DataFrame, store: str) -> None:
    """Write both tables and the index as the next version of a store."""
    versions = Versions(events.sparkSession, store)
    versions.switch(versions.write_index(versions.write(events, True, incidents)))
