"""Streams over the test events, run until all input is read and compared with their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberflow.functions import time_bucket
from timberflow.operators.predicates import match_rules
from timberflow.plans import adapter
from timberflow.plans.catalog import query
from timberflow.plans.incident_queries import _DET, RULES
from timberflow.plans.oracle import EV, bucket
from timberflow.plans.source_queries import NOW, jsonl_source
from timberflow.session import scratch_path
from timberflow.streaming.detection import StreamingDetector, start_detection
from timberflow.streaming.streams import (
    SKETCH_BITS,
    dedup_stream,
    event_stream,
    metrics_stream,
    rolled_up,
    session_stream,
    start_ingest,
    start_to_table,
)

# Event times at which the waves of arriving files end; the last one takes all that is left.
WAVES = ("2024-01-11", "2024-01-21", None)


def _arrived(spark: SparkSession, folder: str) -> str:
    path = scratch_path(spark, "arrived")
    adapter.events(spark, folder).write.parquet(path)
    return path


def _run(stream: DataFrame, path: str) -> DataFrame:
    start_to_table(stream, path).awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/data")


@query("st_ingest", EV + "SELECT DISTINCT fingerprint, 'event' AS kind FROM ev WHERE value >= 3")
def st_ingest(spark, folder):
    """Log files taken in by several micro-batches; what is kept of a fingerprint depends on arrival."""
    store = scratch_path(spark, "stream-ingest")
    start_ingest(spark, jsonl_source(spark, folder), store, NOW, files_per_trigger=12).awaitTermination()
    rows = spark.read.parquet(f"{store}/events")
    return rows.select("fingerprint", F.lit("event").alias("kind"))


@query("st_ingest_rejected", "SELECT count(*) AS rejected FROM events WHERE value < 3")
def st_ingest_rejected(spark, folder):
    store = scratch_path(spark, "stream-ingest")
    start_ingest(spark, jsonl_source(spark, folder), store, NOW).awaitTermination()
    return spark.read.parquet(f"{store}/rejected").agg(F.count("*").alias("rejected"))


@query("st_dedup", EV + "SELECT DISTINCT fingerprint FROM ev")
def st_dedup(spark, folder):
    stream = dedup_stream(event_stream(spark, _arrived(spark, folder)), "60 days")
    return _run(stream, scratch_path(spark, "stream-dedup")).select("fingerprint")


_METRICS = f""", m AS (SELECT {bucket('ts', 604800)} AS bucket, source, level, count(*) AS count, count(DISTINCT fingerprint) AS distinct_,
      min(ts) AS first, max(ts) AS last, sum(strlen(message))::BIGINT AS bytes, list(DISTINCT fingerprint) AS prints FROM ev GROUP BY 1, 2, 3),
    closed AS (SELECT * FROM m WHERE bucket + INTERVAL 7 DAYS <= (SELECT max(ts) FROM ev) - INTERVAL 1 HOUR)"""

#: A sketch's estimate is taken as right within five times its standard error, and two.
_NEAR = 5 * 1.04 / 2 ** (SKETCH_BITS / 2)


def _checked(metrics: DataFrame, exact: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics with the exact distinct count where the estimate is within its bound, else with the estimate."""
    joined = metrics.drop("fingerprints").join(exact, keys)
    near = F.abs(F.col("unique_fingerprints") - F.col("_exact")) <= F.lit(2) + F.col("_exact") * _NEAR
    return joined.withColumn("unique_fingerprints", F.when(near, F.col("_exact")).otherwise(F.col("unique_fingerprints"))).drop("_exact")


def _weekly(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Closed weekly metrics of the stream, and the events they are of."""
    path = _arrived(spark, folder)
    stream = metrics_stream(event_stream(spark, path), 604_800, "1 hour")
    return _run(stream, scratch_path(spark, "stream-metrics")), spark.read.parquet(path)


@query(
    "st_metrics",
    EV + _METRICS + "SELECT bucket, source, level, count, distinct_ AS unique_fingerprints, first, last, bytes FROM closed",
)
def st_metrics(spark, folder):
    """Weekly buckets the watermark has closed."""
    metrics, events = _weekly(spark, folder)
    exact = events.groupBy(time_bucket(F.col("timestamp"), 604_800 * 10**9).alias("bucket"), "source", "level").agg(F.count_distinct("fingerprint").alias("_exact"))
    return _checked(metrics, exact, ["bucket", "source", "level"])


@query(
    "st_metrics_rolled",
    EV
    + _METRICS
    + """SELECT source, sum(count)::BIGINT AS count, len(list_distinct(flatten(list(prints)))) AS unique_fingerprints,
      min(first) AS first, max(last) AS last, sum(bytes)::BIGINT AS bytes FROM closed GROUP BY source""",
)
def st_metrics_rolled(spark, folder):
    """The same buckets put together per source from their sketches."""
    metrics, events = _weekly(spark, folder)
    closed = metrics.select(F.col("bucket"), "source", "level")
    placed = events.withColumn("bucket", time_bucket(F.col("timestamp"), 604_800 * 10**9)).join(closed, ["bucket", "source", "level"], "left_semi")
    return _checked(rolled_up(metrics, ["source"]), placed.groupBy("source").agg(F.count_distinct("fingerprint").alias("_exact")), ["source"])


def _detector(spark: SparkSession, folder: str) -> StreamingDetector:
    """Events that arrive in waves; the stream is stopped and started again between them."""
    source = scratch_path(spark, "arriving")
    detector = StreamingDetector(RULES, scratch_path(spark, "stream-detect"))
    events = adapter.hourly_events(spark, folder)
    since = None
    for until in WAVES:
        at = F.col("timestamp")
        wave = events.filter(at >= F.lit(since).cast("timestamp")) if since else events
        wave = wave.filter(at < F.lit(until).cast("timestamp")) if until else wave
        wave.write.mode("append").parquet(source)
        start_detection(event_stream(spark, source), detector).awaitTermination()
        since = until
    return detector


@query(
    "st_detect",
    _DET
    + """SELECT id, rule_id, grp AS "group", fingerprint, first_seen, last_seen, n AS count,
      array_to_string(ids, ',') AS event_ids FROM inc""",
)
def st_detect(spark, folder):
    rows = _detector(spark, folder).detections(spark)
    ids = F.array_join("event_ids", ",").alias("event_ids")
    return rows.select("id", "rule_id", "group", "fingerprint", "first_seen", "last_seen", "count", ids)


@query(
    "st_resolve",
    _DET
    + """, k AS (SELECT rule_id, grp, sum(n)::BIGINT AS count, max(last_seen) AS last_seen FROM inc GROUP BY rule_id, grp)
    SELECT rule_id, grp AS "group", count, last_seen, CASE WHEN date_diff('second', last_seen, (SELECT max(ts) FROM evh)) >=
      CASE rule_id WHEN 'signup-run' THEN 172800 ELSE 259200 END THEN 'resolved' ELSE 'open' END AS status FROM k""",
)
def st_resolve(spark, folder):
    """Incident state after the last wave: a timer resolves an incident once it has been quiet, by event time."""
    rows = _detector(spark, folder).incidents(spark)
    return rows.select("rule_id", "group", "count", "last_seen", "status")


@query(
    "st_session",
    EV
    + """, m AS (SELECT 'source=' || source AS grp, ts FROM ev WHERE level IN ('ERROR', 'FATAL')),
    g AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY grp ORDER BY ts) + INTERVAL 8 HOURS THEN 1 ELSE 0 END AS cut
      FROM m),
    n AS (SELECT *, sum(cut) OVER (PARTITION BY grp ORDER BY ts) AS run FROM g),
    s AS (SELECT 'error-burst' AS rule_id, grp, min(ts) AS first, max(ts) AS last, count(*) AS count FROM n GROUP BY grp, run)
    SELECT * FROM s WHERE last + INTERVAL 8 HOURS <= (SELECT max(ts) FROM m) - INTERVAL 1 HOUR""",
)
def st_session(spark, folder):
    """Runs of errors per source that ended before the watermark."""
    matched = match_rules(event_stream(spark, _arrived(spark, folder)), RULES[:1])
    stream = session_stream(matched.select("rule_id", "grp", "timestamp"), "8 hours", "1 hour")
    return _run(stream, scratch_path(spark, "stream-session"))
