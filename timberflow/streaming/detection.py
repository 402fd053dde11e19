"""Threshold detection and incident state over a stream of events, by a stateful processor per (rule, group).

Rows wait until the watermark has passed them, so that they are taken in the order (time, id) in which the batch form takes
them.  State in RocksDB holds the waiting rows, the rows of the last window, the last firing and the incident; one event-time
timer per key wakes it at the earliest moment at which something can happen: a row settles, a window runs empty, an incident
has been quiet for long enough.  A key without rows or open incident keeps only its last firing and its incident's number.

The result is a log of changes, written once by Spark's file sink; detections and incidents are read off it.  What is in it
depends on event times alone, not on how the rows were cut into micro-batches.

A key's rows are ordered, so one task holds a key's window: state per key is bounded by what arrives in ``window + delay``.
Groups that are too hot for that should be told apart by a further ``group_by`` field; the batch form has no such bound.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from timberflow import schemas
from timberflow.operators.detection import KEYS, incident_columns
from timberflow.operators.incidents import QUIET, RESUMED
from timberflow.operators.predicates import match_rules
from timberflow.settings import Rule, duration_nanos, enabled_rules
from timberflow.streaming.streams import start_to_table

_ROW = "us bigint, nanos int, id string, fingerprint string"
CHANGES = (
    "rule_id string, grp string, version bigint, kind string, at_us bigint, first_us bigint, first_nanos int, last_us bigint, "
    "last_nanos int, count bigint, event_ids array<string>, fingerprints array<string>"
)
_NAMES = [part.split()[0] for part in CHANGES.split(", ")]
_PARTITIONS = "spark.sql.shuffle.partitions"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Kinds of change: a window fired (for a new, open or resolved incident), or an incident resolved.
OPENED, MERGED, RESUMES, RESOLVED = "opened", "merged", "resumed", "resolved"


def _nanos(row) -> int:
    return int(row[0]) * 1000 + int(row[1])


def _millis(nanos: int) -> int:
    """First millisecond at or after the instant."""
    return -(-nanos // 1_000_000)


class WindowProcessor(StatefulProcessor):
    """Windows, cooldown and incident of one key."""

    def __init__(self, rules: Sequence[Rule]):
        self.settings = {rule.id: (rule.threshold, rule.window_nanos, rule.cooldown_nanos, rule.resolve_nanos) for rule in rules}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROW)
        self.window = handle.getListState("window", _ROW)
        self.fired = handle.getValueState("fired", "nanos_high bigint, nanos_low bigint")
        self.incident = handle.getValueState("incident", "status string, last_us bigint, last_nanos int, version bigint")
        self.timer = handle.getValueState("timer", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        earliest = None
        for pdf in rows:
            arrived = [row for row in zip(pdf["us"].tolist(), pdf["nanos"].tolist(), pdf["id"].tolist(), pdf["fingerprint"].tolist()) if row[0] > reached]
            if arrived:
                self.waiting.appendList(arrived)
                first = _millis(min(map(_nanos, arrived)))
                earliest = first if earliest is None else min(first, earliest)
        if earliest is not None:
            self._arm(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.timer.exists() and self.timer.get()[0] == expiredTimerInfo.getExpiryTimeInMs():
            self.timer.clear()
        changes = self._advance(key, timerValues.getCurrentWatermarkInMs())
        if changes:
            yield pd.DataFrame(changes, columns=_NAMES)

    def close(self) -> None:
        pass

    def _arm(self, ms: int) -> None:
        """Have the only timer at the given moment or before."""
        if self.timer.exists():
            (now,) = self.timer.get()
            if now <= ms:
                return
            self.handle.deleteTimer(now)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def _advance(self, key, watermark: int) -> list[tuple]:
        """Take the rows that the watermark has passed, in order; then forget what no later row can need."""
        threshold, reach, cooldown, quiet = self.settings[key[0]]
        limit = watermark * 1_000_000
        waiting = [tuple(row) for row in self.waiting.get()]
        later = [row for row in waiting if _nanos(row) > limit]
        window = deque(tuple(row) for row in self.window.get())
        fired = self.fired.get() if self.fired.exists() else None
        fired = None if fired is None else fired[0] * 10**9 + fired[1]
        status, last, version = "", 0, 0
        if self.incident.exists():
            status, last_us, last_nanos, version = self.incident.get()
            last = last_us * 1000 + last_nanos
        changes: list[tuple] = []

        def resolve(until: int) -> None:
            nonlocal status, version
            if status == "open" and 0 < quiet <= until - last:
                status, version = "resolved", version + 1
                at = (last + quiet) // 1000
                changes.append((*key, version, RESOLVED, at, None, None, last // 1000, last % 1000, 0, [], []))

        before = fired
        for row in sorted((row for row in waiting if _nanos(row) <= limit), key=lambda row: (_nanos(row), row[2])):
            now = _nanos(row)
            while window and _nanos(window[0]) < now - reach:
                window.popleft()
            window.append(row)
            if len(window) < threshold or (fired is not None and now - fired < cooldown):
                continue
            resolve(now)
            kind = RESUMES if status == "resolved" else MERGED if status == "open" else OPENED
            status, last, version, fired = "open", max(last, now) if version else now, version + 1, now
            first = window[0]
            changes.append((*key, version, kind, row[0], first[0], first[1], row[0], row[1], len(window), sorted({old[2] for old in window}), [old[3] for old in window]))
        resolve(limit)

        while window and _nanos(window[0]) < limit - reach:
            window.popleft()
        if len(later) != len(waiting):
            self.waiting.put(later) if later else self.waiting.clear()
        self.window.put(list(window)) if window else self.window.clear()
        if fired != before:
            self.fired.update(divmod(fired, 10**9))
        if changes:
            self.incident.update((status, *divmod(last, 1000), version))
        moments = [_millis(min(map(_nanos, later)))] if later else []
        if window:
            moments.append(_millis(_nanos(window[-1]) + max(reach, 0)) + 1)
        if status == "open" and quiet > 0:
            moments.append(_millis(last + quiet))
        if moments:
            self._arm(max(min(moments), watermark + 1))
        return changes


class StreamingDetector:
    """Rules and the folder of their change log; ``delay`` is how long rows may be late."""

    def __init__(self, rules: Sequence[Rule], store: str, delay: str = "0s"):
        self.rules = list(rules)
        self.active = enabled_rules(rules)
        self.store = store
        self.delay = delay

    def changes_of(self, events: DataFrame) -> DataFrame:
        """The stream of changes over a stream of events."""
        matched = match_rules(events, self.active)
        rows = matched.select(
            *KEYS, "timestamp", F.unix_micros("timestamp").alias("us"), F.coalesce("ts_nanos", F.lit(0)).alias("nanos"), "id", "fingerprint"
        )
        delayed = rows.withWatermark("timestamp", f"{duration_nanos(self.delay) // 1000} microseconds")
        return delayed.groupBy(*KEYS).transformWithStateInPandas(
            statefulProcessor=WindowProcessor(self.active), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime"
        )

    def changes(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(CHANGES).parquet(f"{self.store}/data")

    def _incidents(self, windows: DataFrame) -> DataFrame:
        moment = lambda name: F.struct(F.col(f"{name}_us").alias("us"), F.col(f"{name}_nanos").alias("nanos"))
        return incident_columns(windows.withColumns({"first": moment("first"), "last": moment("last")}), self.active, F.timestamp_micros("at_us"))

    def detections(self, spark: SparkSession) -> DataFrame:
        """All windows fired so far, as incident rows."""
        fired = self.changes(spark).filter(F.col("kind") != RESOLVED).withColumn("fired_rn", F.col("version"))
        return self._incidents(fired).select(*schemas.INCIDENTS, "fired_rn")

    def incidents(self, spark: SparkSession) -> DataFrame:
        """Incident state: one incident per key, opened by its first window, merged with the later ones."""
        changes = self.changes(spark)
        first = self._incidents(changes.filter(F.col("kind") == OPENED).withColumn("fired_rn", F.col("version")))
        at = F.timestamp_micros("at_us")
        reason = F.when(F.col("kind") == RESUMES, RESUMED).otherwise(QUIET)
        moved = F.col("kind").isin(RESUMES, RESOLVED)
        from_, to = F.when(F.col("kind") == RESUMES, "resolved").otherwise("open"), F.when(F.col("kind") == RESUMES, "open").otherwise("resolved")
        entry = F.when(moved, F.struct("version", F.struct(at.alias("at"), from_.alias("from"), to.alias("to"), reason.alias("reason")).alias("entry")))
        newest = lambda value: F.max_by(value, "version")
        state = changes.groupBy(*KEYS).agg(
            F.when(newest(F.col("kind")) == RESOLVED, "resolved").otherwise("open").alias("status"),
            F.timestamp_micros(F.min("first_us")).alias("first_seen"),
            F.timestamp_micros(F.max("last_us")).alias("last_seen"),
            newest(at).alias("updated_at"),
            F.when(newest(F.col("kind")) == RESOLVED, newest(at)).alias("resolved_at"),
            F.sum("count").alias("count"),
            F.transform(F.sort_array(F.collect_list(entry)), lambda item: item["entry"]).alias("_moves"),
        )
        links = changes.select(*KEYS, F.explode("event_ids").alias("event_id")).distinct()
        lists = links.groupBy(*KEYS).agg(F.sort_array(F.collect_list("event_id")).alias("event_ids"))
        kept = first.drop("status", "first_seen", "last_seen", "updated_at", "resolved_at", "count", "event_ids").withColumnRenamed("group", "grp")
        rows = kept.join(state, KEYS).join(lists, KEYS).withColumn("history", F.concat("history", "_moves")).withColumnRenamed("grp", "group")
        return rows.select(*schemas.INCIDENTS)


def start_detection(events: DataFrame, detector: StreamingDetector, partitions: int | None = None) -> StreamingQuery:
    """Run over all events there are, and go on from there the next time; state is kept in RocksDB for this query only.

    Every partition of the state costs each micro-batch a Python worker and a store, keys or not, so there are no more than the
    cluster has cores unless ``partitions`` says otherwise; a store keeps the number of its first run.
    """
    spark = events.sparkSession
    most = partitions or min(int(spark.conf.get(_PARTITIONS)), spark.sparkContext.defaultParallelism)
    wanted = {_PROVIDER: _ROCKS, _PARTITIONS: str(most)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        return start_to_table(detector.changes_of(events), detector.store)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
