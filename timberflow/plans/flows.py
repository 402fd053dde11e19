"""Whole flows over a store: ingest, detect, compact, report and verify.

Events are kept in segments: an ingest adds one with only the new rows, a compaction replaces all of them by one.  The
pointer row of a generation is written last, so a run that fails half-way leaves the store as it was.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberflow import schemas
from timberflow.functions.times import instant
from timberflow.operators import aggregates, integrity, reports, retention
from timberflow.operators.detection import detect, evaluations
from timberflow.operators.incidents import news_of_run, reconcile
from timberflow.operators.snapshots import cleanup, create_snapshot
from timberflow.operators.versions import Versions
from timberflow.session import materialize, prepare
from timberflow.settings import LogSource, Retention, Rule
from timberflow.sources.ingest import Ingested, ingest

_CHAIN = "store"


class Store(Versions):
    """A store with a manifest of its files and an audit chain."""

    def __post_init__(self):
        prepare(self.spark)

    def audit(self) -> DataFrame:
        schema = f"{_CHAIN} string, " + schemas.ddl(schemas.AUDIT)
        if self.current()["generation"] == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/audit")

    def commit(
        self, action: str, summary: str, now: datetime, events: DataFrame | None = None, replace: bool = False,
        incidents: DataFrame | None = None,
    ) -> str:
        """Write a new generation and return its root digest.

        ``events`` become a further segment, or with ``replace`` the only one.
        """
        before = self.current()
        state = self.write(events, replace, incidents)
        generation = state["generation"]
        manifest = f"manifests/generation={generation}"
        self._manifest(before, state).write.mode("overwrite").parquet(f"{self.root}/{manifest}")
        digest = integrity.root_digest(self.spark.read.parquet(f"{self.root}/{manifest}")).first()[0]
        details = F.create_map(F.lit("summary"), F.lit(summary))
        record = self.spark.range(1).select(
            F.lit("store").alias(_CHAIN),
            instant(now).alias("time"),
            F.lit(action).alias("action"),
            F.lit(digest).alias("subject"),
            details.alias("details"),
        )
        last = integrity.last_records(self.audit(), _CHAIN)
        sealed = integrity.seal_chain(record, _CHAIN, ["time"], last)
        sealed.write.mode("overwrite").parquet(f"{self.root}/audit/generation={generation}")
        self.switch(state | {"manifest": manifest, "root_digest": digest})
        return digest

    def _manifest(self, before: dict, state: dict) -> DataFrame:
        """Files of the version's tables; only those of new folders are read, the others keep their entries."""
        prefix = f"generation={state['generation']}/"
        new = integrity.file_manifest(self.spark, f"{self.root}/data/{prefix[:-1]}").withColumn("path", F.concat(F.lit(prefix), "path"))
        if before["manifest"] is None:
            return new
        old = self.spark.read.parquet(f"{self.root}/{before['manifest']}")
        kept = [F.col("path").startswith(path.removeprefix("data/") + "/") for path in self._named([state]) if f"/{prefix}" not in path]
        return new.unionByName(old.filter(reduce(Column.__or__, kept, F.lit(False))))


def run_ingest(store: Store, sources: Sequence[LogSource], now: datetime, names: Sequence[str] = ()) -> Ingested:
    """Read sources and add the events the store does not have yet."""
    result = ingest(store.spark, sources, now, names)
    fresh = store.keys(store.current()).new_rows(result.events).select(*schemas.EVENTS)
    store.commit("ingest", "sources=" + ",".join(source.name for source in sources), now, events=fresh)
    return result


def run_detect(store: Store, rules: Sequence[Rule], now: datetime, idempotent: bool = False) -> DataFrame:
    """Detect over all stored events, merge with the stored incidents, and return the counters per rule."""
    run = detect(store.events(), rules)
    merged = reconcile(store.incidents(), news_of_run(run, now), rules, now, idempotent)
    store.commit("detect", f"rules={len(rules)}", now, incidents=merged)
    return evaluations(run)


def run_compact(store: Store, policy: Retention, now: datetime, snapshot: str = "") -> DataFrame:
    """Apply retention and remove what expired; a snapshot keeps the tables as they were.  Returns the counters."""
    events, incidents = store.events(), store.incidents()
    if policy.snapshot_before_compact:
        create_snapshot(store.spark, store.root, snapshot or now.strftime("%Y%m%dT%H%M%S.%fZ"), now)
    result = retention.compact(events, incidents, policy, now)
    stats = materialize(result.stats)
    store.commit("compact", f"event_days={policy.event_days}", now, result.events, True, result.incidents)
    cleanup(store.spark, store.root)
    return stats


def run_report(store: Store, bucket: str = "1h", top: int = reports.DEFAULT_TOP) -> dict[str, DataFrame]:
    events, incidents = store.events(), store.incidents()
    return {
        "summary": reports.report_summary(events, incidents),
        "levels": reports.level_ranking(events),
        "sources": reports.ranking(events, "source", top),
        "rules": reports.ranking(incidents, "rule_id", top),
        "timeline": reports.timeline(events, aggregates.bucket_of(bucket)),
        "fingerprints": reports.ranking(events, "fingerprint", top),
    }


def run_verify(store: Store) -> DataFrame:
    """Findings about the files of the newest generation and about the audit chain; none when all is well."""
    state = store.current()
    manifest = store.spark.read.parquet(f"{store.root}/{state['manifest']}")
    files = integrity.verify_files(store.spark, f"{store.root}/data", manifest, state["root_digest"])
    audit = store.audit().withColumn("position", F.col("sequence"))
    chain = integrity.verify_audit(audit, [_CHAIN]).select(F.concat(F.lit("audit: "), "finding").alias("finding"))
    return files.unionByName(chain)
