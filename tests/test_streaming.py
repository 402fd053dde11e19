"""Lateness, restarts and state of streaming detection."""

import random

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from timberflow import schemas
from timberflow.operators.detection import detect, detected_incidents
from timberflow.settings import Predicate, Rule
from timberflow.streaming.detection import StreamingDetector, start_detection
from timberflow.streaming.streams import event_stream

T0 = datetime(2025, 3, 1, 10, tzinfo=timezone.utc)


def test_rows_wait_for_the_watermark(spark, tmp_path):
    rule = Rule("r", all=[Predicate("level", "gte", "ERROR")], threshold=2, window="30s", cooldown="5m", resolve_after="1m")
    detector = StreamingDetector([rule], str(tmp_path / "state"), delay="60s")

    def wave(*seconds):
        rows = [(f"e{at}", T0 + timedelta(seconds=at), 0, "ERROR", "s", "m", {}, f"f{at}", "in", 1, T0) for at in seconds]
        spark.createDataFrame(rows, schemas.ddl(schemas.EVENTS)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        start_detection(event_stream(spark, str(tmp_path / "in")), detector).awaitTermination()
        return [(row["event_ids"], row["count"]) for row in detector.detections(spark).collect()]

    # Nothing is older than the delay yet.
    assert wave(0, 10) == []
    # A row that comes late, but within the delay, takes its place in time.
    assert wave(5, 100) == [(["e0", "e5"], 2)]
    assert detector.incidents(spark).first()["status"] == "open"
    # A row older than the watermark is dropped; the quiet incident resolves by event time.
    assert wave(20, 200) == [(["e0", "e5"], 2)]
    (incident,) = detector.incidents(spark).collect()
    assert (incident["status"], incident["count"]) == ("resolved", 2)


def store_rows(spark, path, rows):
    data = [(i, T0 + timedelta(seconds=at), 0, "ERROR", source, "m", {}, f"f{i}", "in", 1, T0) for i, at, source in rows]
    spark.createDataFrame(data, schemas.ddl(schemas.EVENTS)).coalesce(1).write.mode("append").parquet(path)


def test_waves_and_restarts_equal_batch(spark, tmp_path):
    """Rows out of order within the delay, in waves with a restart between them: the windows of one batch run, without and
    with cooldown, and the same incidents however the rows are cut."""
    rng = random.Random(12)
    rules = [
        Rule("calm", all=[Predicate("level", "gte", "ERROR")], group_by=["source"], threshold=3, window="30s", cooldown="50s", resolve_after="2m"),
        Rule("flood", all=[Predicate("level", "gte", "ERROR")], threshold=2, window="5s", cooldown="0s"),
    ]
    rows = [(f"e{k:03d}", 10 * (k // 6) + rng.randint(0, 9), f"s{rng.randint(1, 2)}") for k in range(180)]
    rows += [("late1", 900, "s1"), ("late2", 901, "s1"), ("late3", 902, "s1"), ("end", 2000, "none")]
    results = []
    for waves in (1, 3):
        source, detector = str(tmp_path / f"in{waves}"), StreamingDetector(rules, str(tmp_path / f"state{waves}"), delay="60s")
        size = -(-len(rows) // waves)
        for k in range(waves):
            store_rows(spark, source, rows[k * size : (k + 1) * size])
            start_detection(event_stream(spark, source), detector).awaitTermination()
        shape = lambda df: sorted(str((r["id"], r["rule_id"], r["group"], r["fingerprint"], r["first_seen"], r["last_seen"], r["count"], r["event_ids"])) for r in df.collect())
        whole = spark.read.parquet(source).filter(F.col("id") != "end")
        assert shape(detector.detections(spark)) == shape(detected_incidents(detect(whole, rules), T0))
        results.append(sorted(str(row.asDict(recursive=True)) for row in detector.incidents(spark).collect()))
        kinds = {row["kind"] for row in detector.changes(spark).select("kind").distinct().collect()}
        assert kinds == {"opened", "merged", "resumed", "resolved"}
    assert results[0] == results[1]


def test_state_goes_when_windows_pass(spark, tmp_path):
    rule = Rule("r", all=[Predicate("level", "gte", "ERROR")], group_by=["source"], threshold=50, window="30s", cooldown="5m")
    detector = StreamingDetector([rule], str(tmp_path / "state"))
    source = str(tmp_path / "in")

    def wave(rows):
        store_rows(spark, source, rows)
        query = start_detection(event_stream(spark, source), detector)
        query.awaitTermination()
        return query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]

    full = wave([(f"a{k}", k % 20, f"s{k % 10}") for k in range(200)])
    assert wave([("b", 5000, "s0"), ("c", 9000, "s0")]) < full / 4


def test_state_has_no_more_partitions_than_the_cluster_has_cores(spark, tmp_path):
    rule = Rule("r", all=[Predicate("level", "gte", "ERROR")], group_by=["source"], threshold=1, window="30s")
    source, name = str(tmp_path / "in"), "spark.sql.shuffle.partitions"
    store_rows(spark, source, [("e1", 0, "a"), ("e2", 5, "b"), ("e3", 900, "c")])
    before, cores = spark.conf.get(name), spark.sparkContext.defaultParallelism
    spark.conf.set(name, str(cores + 3))
    try:
        for store, asked, wanted in (("all", None, cores), ("two", 2, 2)):
            detector = StreamingDetector([rule], str(tmp_path / store))
            start_detection(event_stream(spark, source), detector, asked).awaitTermination()
            kept = [item.name for item in (tmp_path / store / "_progress/state/0").iterdir() if item.name.isdigit()]
            assert len(kept) == wanted
            assert sorted(row["event_ids"] for row in detector.detections(spark).collect()) == [["e1"], ["e2"], ["e3"]]
            assert spark.conf.get(name) == str(cores + 3)
    finally:
        spark.conf.set(name, before)
