"""Retention: expiry, deduplication, reference pruning and closing of incidents."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberflow.functions.times import instant
from timberflow.operators.dedup import EVENT_ORDER, event_references, first_per_key
from timberflow.operators.incidents import apply_transition
from timberflow.settings import Retention

# Fixed value: reason shown in the history.
EXPIRED = "supporting events expired by retention"


@dataclass
class Compaction:
    events: DataFrame
    incidents: DataFrame
    stats: DataFrame


def live_events(events: DataFrame, policy: Retention, now: datetime) -> DataFrame:
    """Events not older than the policy allows; the test on the plain column prunes a date-partitioned table."""
    if policy.event_days == 0:
        return events
    return events.filter(F.col("timestamp") >= instant(now - timedelta(days=policy.event_days)))


def surviving_events(events: DataFrame, policy: Retention, now: datetime) -> DataFrame:
    """Live events, first by (time, id) of each fingerprint if the policy says so, else of each id.

    An id covers the fingerprint (see ``event_id``), so equal ids imply equal fingerprints.
    """
    key = "fingerprint" if policy.deduplicate else "id"
    return first_per_key(live_events(events, policy, now), key, EVENT_ORDER)


def live_incidents(incidents: DataFrame, policy: Retention, now: datetime) -> DataFrame:
    if policy.incident_days == 0:
        return incidents
    return incidents.filter(F.col("last_seen") >= instant(now - timedelta(days=policy.incident_days)))


def prune_references(incidents: DataFrame, events: DataFrame) -> DataFrame:
    """Keep in ``event_ids`` only the events that still exist, in the same order; the list may become empty."""
    present = event_references(incidents).join(events.select(F.col("id").alias("event_id")), "event_id", "left_semi")
    lists = present.groupBy("incident_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "event_id"))), lambda item: item["event_id"]).alias(
            "_ids"
        )
    )
    joined = incidents.join(lists, incidents["id"] == lists["incident_id"], "left")
    empty = F.array().cast("array<string>")
    return joined.withColumn("event_ids", F.coalesce("_ids", empty)).select(*incidents.columns)


def close_unsupported(incidents: DataFrame, policy: Retention, now: datetime) -> DataFrame:
    """Resolve incidents last seen before the event cutoff; ``closing`` marks them even when refused."""
    cutoff = instant(now - timedelta(days=policy.event_days))
    closing = (F.col("status") != "resolved") & (F.col("last_seen") < cutoff) & F.lit(policy.event_days > 0)
    marked = incidents.withColumn("closing", closing)
    return apply_transition(marked, F.col("closing"), F.lit("resolved"), instant(now), F.lit(EXPIRED))


def compact(events: DataFrame, incidents: DataFrame, policy: Retention, now: datetime) -> Compaction:
    kept = surviving_events(events, policy, now)
    closed = close_unsupported(prune_references(live_incidents(incidents, policy, now), kept), policy, now)
    return Compaction(kept, closed.drop("closing"), compaction_stats(events, incidents, policy, now))


def compaction_stats(events: DataFrame, incidents: DataFrame, policy: Retention, now: datetime) -> DataFrame:
    """One row of counters; as it writes nothing it is also the dry run."""
    event_cutoff = instant(now - timedelta(days=policy.event_days))
    incident_cutoff = instant(now - timedelta(days=policy.incident_days))
    expired = (F.col("timestamp") < event_cutoff) & F.lit(policy.event_days > 0)
    gone = (F.col("last_seen") < incident_cutoff) & F.lit(policy.incident_days > 0)
    closing = ~gone & (F.col("status") != "resolved") & (F.col("last_seen") < event_cutoff)
    one = lambda df: df.withColumn("_one", F.lit(1))
    left = events.agg(F.count("*").alias("before_events"), F.count_if(expired).alias("expired_events"))
    kept = surviving_events(events, policy, now).agg(F.count("*").alias("after_events"))
    right = incidents.agg(
        F.count("*").alias("before_incidents"),
        F.count_if(gone).alias("expired_incidents"),
        F.count_if(closing & F.lit(policy.event_days > 0)).alias("closed_incidents"),
    )
    joined = one(left).join(one(kept), "_one").join(one(right), "_one")
    return joined.select(
        "before_events",
        "after_events",
        "expired_events",
        (F.col("before_events") - F.col("expired_events") - F.col("after_events")).alias("duplicate_events"),
        "before_incidents",
        (F.col("before_incidents") - F.col("expired_incidents")).alias("after_incidents"),
        "expired_incidents",
        "closed_incidents",
        event_cutoff.alias("cutoff"),
    )
