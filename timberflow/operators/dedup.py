"""First-wins deduplication, append of new rows, reference checks and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberflow.operators.positions import with_position

EVENT_ORDER = ["timestamp", "ts_nanos", "id"]

# Incidents in one row of the inverted references.
POSTING_ROWS = 1000


def first_per_key(df: DataFrame, key: Column | str, order: Sequence[Column | str]) -> DataFrame:
    """First row of each key by ``order``.

    The filter on row number 1 lets Spark keep one row per key and map task before the shuffle, so a key with
    very many copies does not gather in one task.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def dedup_first(records: DataFrame, order: Sequence[str] = ("input_ord", "file", "line")) -> DataFrame:
    """First record of each fingerprint in input order."""
    present = [name for name in order if name in records.columns]
    return first_per_key(records, "fingerprint", present)


def append_new(existing: DataFrame, additions: DataFrame) -> DataFrame:
    """Additions whose id and fingerprint are both new, first by (time, id) of each fingerprint."""
    fresh = first_per_key(additions, "fingerprint", EVENT_ORDER)
    fresh = fresh.join(existing.select("fingerprint"), "fingerprint", "left_anti")
    return fresh.join(existing.select("id"), "id", "left_anti")


def append_counts(additions: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row: added, skipped."""
    total = additions.agg(F.count("*").alias("total")).withColumn("_one", F.lit(1))
    added = fresh.agg(F.count("*").alias("added")).withColumn("_one", F.lit(1))
    return total.join(added, "_one").select("added", (F.col("total") - F.col("added")).alias("skipped"))


def merge_duplicates(events: DataFrame) -> DataFrame:
    """First event by (time, id) of each fingerprint; events without one count by id."""
    key = F.coalesce(F.nullif(F.col("fingerprint"), F.lit("")), F.col("id"))
    return first_per_key(events, key, EVENT_ORDER)


def duplicate_ids(df: DataFrame) -> DataFrame:
    return df.groupBy("id").agg(F.count("*").alias("copies")).filter("copies > 1")


def event_references(incidents: DataFrame) -> DataFrame:
    """One row per incident and event id it lists."""
    return incidents.select(F.col("id").alias("incident_id"), F.posexplode("event_ids").alias("pos", "event_id"))


def reference_postings(incidents: DataFrame, chunk: int = POSTING_ROWS) -> DataFrame:
    """Inverted references as (``event_id``, ``chunk``, ``incident_ids``): sorted lists of at most ``chunk`` incidents each.

    Ranks come from a range partitioning, so an event that very many incidents list has many rows and no large one; the lists
    of an event follow each other in the order of their chunks.
    """
    placed = with_position(event_references(incidents).select("event_id", "incident_id"), ["incident_id"], ["event_id"])
    number = F.floor((F.col("pos") - 1) / chunk).cast("bigint").alias("chunk")
    return placed.groupBy("event_id", number).agg(F.sort_array(F.collect_list("incident_id")).alias("incident_ids"))


def incident_references(incidents: DataFrame) -> DataFrame:
    """Per event id the sorted ids of the incidents that list it, in one row: the export form of the postings."""
    postings = reference_postings(incidents).groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "incident_ids"))).alias("_lists"))
    return postings.select("event_id", F.flatten(F.transform("_lists", lambda item: item["incident_ids"])).alias("incident_ids"))


def dangling_references(events: DataFrame, incidents: DataFrame) -> DataFrame:
    """``incident:event`` for every listed event that does not exist, sorted."""
    pairs = event_references(incidents)
    missing = pairs.join(events.select(F.col("id").alias("event_id")), "event_id", "left_anti")
    return missing.select(F.concat_ws(":", "incident_id", "event_id").alias("reference")).orderBy("reference")


def partition_by_cutoff(df: DataFrame, column: str, cutoff: Column) -> DataFrame:
    """Tag rows ``expired`` when they are strictly before the cutoff."""
    return df.withColumn("expired", F.col(column) < cutoff)


def unique_sources(events: DataFrame) -> DataFrame:
    return events.select("source").distinct().orderBy("source")


def event_index(events: DataFrame) -> DataFrame:
    """Slim lookup table of the events in (time, id) order."""
    return events.select(F.col("timestamp").alias("time"), "id", "source", "level", "fingerprint").orderBy("time", "id")


def index_mismatches(events: DataFrame, index: DataFrame) -> DataFrame:
    """Positions where table and index differ in id or fingerprint, or where one of them has no row.

    The index is compared in its stored order, given by a column ``pos`` (1-based).
    """
    placed = with_position(events.select(*EVENT_ORDER, "fingerprint"), EVENT_ORDER)
    left = placed.select("pos", F.col("id").alias("event_id"), F.col("fingerprint").alias("event_fingerprint"))
    right = index.select("pos", F.col("id").alias("index_id"), F.col("fingerprint").alias("index_fingerprint"))
    same = F.col("event_id").eqNullSafe(F.col("index_id")) & F.col("event_fingerprint").eqNullSafe(
        F.col("index_fingerprint")
    )
    return left.join(right, "pos", "full_outer").filter(~same)


def positioned_index(index: DataFrame) -> DataFrame:
    """Index rows with their place in (time, id) order, as :func:`index_mismatches` wants them."""
    return with_position(index, ["time", "id"])
