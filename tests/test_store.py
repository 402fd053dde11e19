"""Retention, references, integrity, snapshots and exports on small tables."""

import hashlib
import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from timberflow import schemas
from timberflow.operators import dedup, filters, integrity, quality, retention, sinks, snapshots
from timberflow.operators.versions import Versions
from timberflow.settings import Retention
from timberflow.sources.tables import load_events

T0 = datetime(2025, 3, 1, 10, tzinfo=timezone.utc)


def event(id_, days=0, level="INFO", source="api", print_=None, fields=None):
    return (id_, T0 + timedelta(days=days), 0, level, source, "message", fields or {}, print_ or "f" + id_, "in", 1, T0)


def events_of(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.ddl(schemas.EVENTS))


def incident_of(spark, *rows):
    at = lambda days: T0 + timedelta(days=days)
    data = [(i, "r", "t", status, "ERROR", "g" + i, "f", at(first), at(last), at(first), at(last), at(last) if status == "resolved" else None, 1, ids, {}, [(at(first), None, "open", "made")]) for i, status, first, last, ids in rows]
    return spark.createDataFrame(data, schemas.ddl(schemas.INCIDENTS))


def test_compaction(spark):
    events = events_of(spark, event("a", 0), event("b", 8), event("c", 9, print_="fb"), event("d", 10))
    incidents = incident_of(spark, ("1", "open", -60, -50, ["a"]), ("2", "open", 0, 1, ["b", "a", "d", "c"]), ("3", "resolved", 0, 1, ["a"]), ("4", "open", 0, 9, []))
    now = T0 + timedelta(days=12)
    result = retention.compact(events, incidents, Retention(event_days=5, incident_days=30), now)
    assert sorted(row["id"] for row in result.events.collect()) == ["b", "d"]
    kept = {row["id"]: row for row in result.incidents.collect()}
    assert {i: row["status"] for i, row in kept.items()} == {"2": "resolved", "3": "resolved", "4": "open"}
    assert kept["2"]["event_ids"] == ["b", "d"] and kept["3"]["event_ids"] == [] and kept["2"]["count"] == 1
    assert kept["2"]["history"][-1]["reason"] == "supporting events expired by retention"
    stats = result.stats.first().asDict()
    assert [stats[name] for name in ("before_events", "after_events", "expired_events", "duplicate_events")] == [4, 2, 1, 1]
    assert [stats[name] for name in ("before_incidents", "after_incidents", "expired_incidents", "closed_incidents")] == [4, 3, 1, 1]
    everything = retention.compact(events, incidents, Retention(0, 0, deduplicate=False), now)
    assert everything.events.count() == 4 and everything.incidents.filter("status = 'open'").count() == 3


def test_references(spark):
    incidents = incident_of(spark, ("1", "open", 0, 1, ["a", "x"]), ("2", "open", 0, 1, ["x"]))
    events = events_of(spark, event("a"))
    assert [row[0] for row in dedup.dangling_references(events, incidents).collect()] == ["1:x", "2:x"]
    refs = {row["event_id"]: row["incident_ids"] for row in dedup.incident_references(incidents).collect()}
    assert refs == {"a": ["1"], "x": ["1", "2"]}
    many = incident_of(spark, *[(f"{k:03d}", "open", 0, 1, ["x", "y"] if k % 7 == 0 else ["x"]) for k in range(100)])
    rows = dedup.reference_postings(many, chunk=9).orderBy("event_id", "chunk").collect()
    assert max(len(row["incident_ids"]) for row in rows) == 9 and [row["chunk"] for row in rows] == [*range(12), 0, 1]
    assert [i for row in rows if row["event_id"] == "x" for i in row["incident_ids"]] == [f"{k:03d}" for k in range(100)]


def test_row_checks(spark):
    bad = events_of(spark, event("a", level="LOUD"), event("", source=" "), event("b", source=" "))
    assert sorted(row["violation"] for row in quality.event_violations(bad).collect()) == [
        "event id is required", "event level is invalid", "event source is required",
    ]
    broken = incident_of(spark, ("1", "resolved", 0, 1, [])).withColumn("resolved_at", F.lit(None).cast("timestamp"))
    assert quality.incident_violations(broken).first()["violation"] == "resolved incident lacks resolved_at"


def test_save_refuses_bad_tables(spark, tmp_path):
    with pytest.raises(ValueError, match="duplicate id"):
        sinks.save_events(events_of(spark, event("a"), event("a")), str(tmp_path / "x"))
    with pytest.raises(Exception, match="event level is invalid"):
        sinks.save_events(events_of(spark, event("a", level="LOUD")), str(tmp_path / "y"))


def test_load_levels_from_json(spark, tmp_path):
    row = {"id": "a", "timestamp": "2025-03-01T10:00:00Z", "level": 4, "source": "s", "message": "m", "fingerprint": "f"}
    (tmp_path / "e.json").write_text(json.dumps(row) + "\n" + json.dumps({**row, "id": "b", "level": "warning"}))
    loaded = load_events(spark, str(tmp_path / "e.json"), "json").orderBy("id").collect()
    assert [r["level"] for r in loaded] == ["ERROR", "WARN"]


def test_query_and_index(spark):
    events = events_of(spark, event("a"), event("b", 1, "ERROR", "worker", fields={"job": "42"}))
    terms = filters.EventFilter(min_level="ERROR")
    assert [row["source"] for row in filters.query_events(events, terms).collect()] == ["worker"]
    assert filters.query_counters(events, terms).first().asDict() == {"scanned": 2, "matched": 1, "returned": 1, "truncated": False}
    index = dedup.positioned_index(dedup.event_index(events))
    assert dedup.index_mismatches(events, index).count() == 0
    assert dedup.index_mismatches(events.limit(1), index).count() == 1
    for wrong in ({"limit": -1}, {"offset": -1}, {"fields": {"": "x"}}, {"min_level": "loud"}, {"since": "2025-01-02", "until": "2025-01-01"}):
        with pytest.raises(ValueError):
            filters.EventFilter(**wrong)


def test_filters_reach_the_scan(spark, tmp_path):
    sinks.save_events(events_of(spark, event("a"), event("b", 1, "ERROR")), str(tmp_path / "e"))
    stored = spark.read.parquet(str(tmp_path / "e"))
    terms = filters.EventFilter(since="2025-03-01", min_level="ERROR", sources=["api"])
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = filters.matching(stored, terms).select("id")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("ReadSchema")[0]
    assert "GreaterThanOrEqual(timestamp" in pushed and "In(level" in pushed and "source" in pushed
    assert "message" not in plan[plan.index("ReadSchema") :]


def test_snapshot_restore_rebuilds_the_index(spark, tmp_path):
    store = str(tmp_path / "store")
    incidents = incident_of(spark, ("1", "open", 0, 1, ["a"]))
    snapshots.save_store(events_of(spark, event("a")), incidents, store)
    described = snapshots.create_snapshot(spark, store, "one", T0, "digest").first()
    assert (described["events"], described["incidents"], described["root_digest"]) == (1, 1, "digest")
    with pytest.raises(Exception):
        snapshots.create_snapshot(spark, store, "one", T0)
    for name in ("", "a/b", "..", "a:b"):
        with pytest.raises(ValueError):
            snapshots.check_name(name)
    versions = Versions(spark, store)
    snapshots.save_store(events_of(spark, event("a"), event("b", 1)), incidents, store)
    assert versions.events().count() == versions.index().count() == 2
    snapshots.restore_snapshot(spark, store, "one")
    events, index = versions.events(), versions.index()
    assert events.count() == 1 and dedup.index_mismatches(events, dedup.positioned_index(index)).count() == 0
    assert [(row["name"], row["generation"]) for row in snapshots.list_snapshots(spark, store).collect()] == [("one", 1)]


def test_a_run_that_fails_leaves_the_version_before(spark, tmp_path, monkeypatch):
    """The second table cannot be written: readers see both old tables, and the next run goes over what is left."""
    store = str(tmp_path / "store")
    versions = Versions(spark, store)
    snapshots.save_store(events_of(spark, event("a")), incident_of(spark, ("1", "open", 0, 1, ["a"])), store)
    with pytest.raises(ValueError, match="duplicate id"):
        snapshots.save_store(events_of(spark, event("b")), incident_of(spark, ("2", "open", 0, 1, []), ("2", "open", 0, 1, [])), store)
    assert [r["id"] for r in versions.events().collect()] == ["a"] and [r["id"] for r in versions.incidents().collect()] == ["1"]
    assert (tmp_path / "store" / "data" / "generation=2" / "events").exists()
    snapshots.save_store(events_of(spark, event("c")), incident_of(spark, ("3", "open", 0, 1, [])), store)
    assert [r["id"] for r in versions.events().collect()] == ["c"] and versions.current()["generation"] == 2


def test_cleanup_keeps_what_is_named(spark, tmp_path):
    store = str(tmp_path / "store")
    versions = Versions(spark, store)
    incidents = incident_of(spark, ("1", "open", 0, 1, ["a"]))
    for k, name in enumerate("abc"):
        snapshots.save_store(events_of(spark, event(name)), incidents, store)
        if k == 1:
            snapshots.create_snapshot(spark, store, "kept", T0)
    gone = snapshots.cleanup(spark, store)
    assert {path for path in gone if path.startswith("data/")} == {"data/generation=1/events", "data/generation=1/incidents", "data/generation=1/index", "data/generation=2/index"}
    assert {path for path in gone if path.startswith(("keys/", "filters/"))} == {"keys/segment=1", "filters/size=4096/segment=1"}
    assert [r["id"] for r in versions.events().collect()] == ["c"] and versions.index().count() == 1
    snapshots.restore_snapshot(spark, store, "kept")
    assert [r["id"] for r in versions.events().collect()] == ["b"]
    assert versions.keys(versions.current()).new_rows(events_of(spark, event("b"), event("d"))).count() == 1


def test_manifest_and_tampering(spark, tmp_path):
    root = tmp_path / "root"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("hello")
    (root / "sub" / "b.txt").write_text("x" * 1000)
    (root / "audit.jsonl").write_text("{}")
    manifest = integrity.file_manifest(spark, str(root), whole_bytes=100)
    rows = sorted(tuple(row) for row in manifest.collect())
    assert rows == [("a.txt", 5, hashlib.sha256(b"hello").hexdigest()), ("sub/b.txt", 1000, hashlib.sha256(b"x" * 1000).hexdigest())]
    body = "".join(f"{path}\0{size}\0{digest}\n" for path, size, digest in rows)
    expected = hashlib.sha256(body.encode()).hexdigest()
    assert integrity.root_digest(manifest).first()[0] == expected
    saved = spark.createDataFrame(rows, schemas.ddl(schemas.MANIFEST))
    assert integrity.verify_files(spark, str(root), saved, expected).count() == 0
    assert integrity.check_manifest(saved, expected).count() == 0
    (root / "a.txt").write_text("hullo")
    assert [row[0] for row in integrity.verify_files(spark, str(root), saved, expected).collect()] == ["a.txt: SHA-256 mismatch"]
    (only,) = integrity.file_manifest(spark, str(root), ["sub/b.txt"]).collect()
    assert only["path"] == "sub/b.txt"
    for bad in ("../x", "/x", "."):
        with pytest.raises(ValueError):
            integrity.safe_paths([bad])


def test_large_files_are_hashed_as_streams(spark, tmp_path):
    """Files of every ending and of any bytes, cut into tiny blocks: the digests of the plain files."""
    contents = {
        "a.bin": bytes(range(256)) * 40, "b.txt": b"\n" * 300, "c.txt": b"x" * 900, "d.txt": b"line\r\n" * 90 + b"\r",
        "e.txt": b"line\n" * 90, "sub/f.bin": b"\xff\n\xfe" * 200, "sub/g.txt": b"\n" + b"y" * 400, "i.txt.gz": b"not packed" * 40,
    }
    for name, data in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    want = sorted((name, len(data), hashlib.sha256(data).hexdigest()) for name, data in contents.items())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for limit in (100, 10**6):
            assert sorted(map(tuple, integrity.file_manifest(spark, str(tmp_path), whole_bytes=limit).collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_audit_chain(spark):
    actions = spark.createDataFrame(
        [("c", T0 + timedelta(minutes=i), "ingest", f"s{i}", {"b": "2", "a": str(i)}) for i in range(4)],
        "chain string, time timestamp, action string, subject string, details map<string,string>",
    )
    sealed = integrity.seal_chain(actions, "chain", ["time"]).withColumn("position", F.col("sequence"))
    rows = sealed.orderBy("sequence").collect()
    first = f"1\0002025-03-01T10:00:00Z\0ingest\0s0\0\0a\0000\0b\0002\0"
    assert rows[0]["previous"] == "" and rows[0]["digest"] == hashlib.sha256(first.encode()).hexdigest()
    assert rows[1]["previous"] == rows[0]["digest"]
    assert integrity.verify_audit(sealed).count() == 0
    touched = sealed.withColumn("subject", F.when(F.col("sequence") == 2, "other").otherwise(F.col("subject")))
    (finding,) = integrity.verify_audit(touched).collect()
    assert (finding["finding"], finding["first"]) == ("record 2 digest mismatch", True)
    gap = integrity.verify_audit(sealed.filter("sequence <> 2")).orderBy("position").collect()
    assert gap[0]["finding"] == "record 3 previous digest mismatch"


def test_csv_export_quotes_only_where_needed(spark, tmp_path):
    events = events_of(spark, event("a", fields={"b": 'x"y', "a": "1,2"}))
    sinks.export_csv(events, str(tmp_path / "c"))
    (part,) = (tmp_path / "c").glob("part*")
    head, line = part.read_text().splitlines()
    assert head == "timestamp,level,source,message,id,fingerprint,fields"
    assert line == '2025-03-01T10:00:00Z,INFO,api,message,a,fa,"a=1,2;b=x""y"'


def test_a_table_is_computed_once_when_saved(spark, tmp_path):
    """The row checks do not compute the lineage again."""
    calls = spark.sparkContext.accumulator(0)

    def say(text):
        calls.add(1)
        return text

    at = datetime(2025, 3, 1, tzinfo=timezone.utc)
    rows = [(f"e{k}", at + timedelta(seconds=k), 0, "INFO", "s", "m", {}, f"f{k}", "in", k, at) for k in range(50)]
    events = spark.createDataFrame(rows, schemas.ddl(schemas.EVENTS)).withColumn("message", F.udf(say, "string")("message"))
    sinks.save_events(events, str(tmp_path / "events"))
    assert calls.value == 50 and spark.read.parquet(str(tmp_path / "events")).count() == 50


def test_files_are_listed_by_one_job(spark, tmp_path):
    """Looking for large files takes no job for each split of the listing."""
    for k in range(24):
        (tmp_path / f"f{k}.txt").write_text(f"{k}\n" * (1 + k % 5))
    size, context = "spark.sql.files.maxPartitionBytes", spark.sparkContext
    before = spark.conf.get(size)
    spark.conf.set(size, "1b")
    context.setJobGroup("manifest", "manifest")
    try:
        found = integrity.file_manifest(spark, str(tmp_path), whole_bytes=8)
        jobs = len(context.statusTracker().getJobIdsForGroup("manifest"))
        rows = {row["path"]: row["sha256"] for row in found.collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set(size, before)
    assert jobs == 1
    assert rows == {path.name: hashlib.sha256(path.read_bytes()).hexdigest() for path in tmp_path.iterdir()}
