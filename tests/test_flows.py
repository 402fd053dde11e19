"""A store from first ingest to verification."""

import json
from datetime import datetime, timedelta, timezone

from timberflow.operators.folders import remove
from timberflow.operators.snapshots import cleanup
from timberflow.plans.flows import Store, run_compact, run_detect, run_ingest, run_report, run_verify
from timberflow.settings import LogSource, Predicate, Retention, Rule

NOW = datetime(2025, 3, 1, 12, tzinfo=timezone.utc)
LINES = [
    {"timestamp": "2025-03-01T06:15:30Z", "level": "warning", "source": "billing", "message": "invoice 7 late", "tenant": "blue"},
    {"timestamp": "2025-03-01T06:20:00Z", "level": "fatal", "source": "kiln", "message": "burner lost flame", "zone": "3"},
    {"timestamp": "2025-03-01T06:20:40Z", "level": "warn", "source": "kiln", "message": "draught below limit", "zone": "3"},
    {"timestamp": "2025-03-01T06:21:10Z", "level": "crit", "source": "kiln", "message": "lid open", "zone": "4"},
    {"timestamp": "2025-03-01T06:40:00Z", "level": "debug", "source": "ferry", "message": "ramp up", "berth": 12.50},
]
RULE = Rule("kiln-zone", all=[Predicate("level", "gte", "WARN")], any=[Predicate("zone", "exists")], group_by=["source", "zone"], threshold=2, window="90s", cooldown="1h")


def test_store(spark, tmp_path):
    (tmp_path / "early.jsonl").write_text("\n".join(map(json.dumps, LINES[:3])))
    (tmp_path / "all.jsonl").write_text("\n".join(map(json.dumps, LINES)))
    store = Store(spark, str(tmp_path / "store"))
    first = run_ingest(store, [LogSource("early", str(tmp_path / "early.jsonl"), "jsonl")], NOW)
    assert first.stats.first()["records"] == 3
    run_ingest(store, [LogSource("all", str(tmp_path / "all.jsonl"), "jsonl")], NOW)
    assert store.events().count() == 5 and len(store.current()["segments"]) == 2
    assert store.events().filter("source = 'ferry'").first()["fields"] == {"berth": "12.5"}
    assert run_detect(store, [RULE], NOW).first()["triggered"] == 1
    (incident,) = store.incidents().collect()
    assert (incident["group"], incident["count"]) == ("source=kiln|zone=3", 2)
    report = run_report(store)
    assert report["summary"].first()["open_incidents"] == 1
    assert sorted(tuple(row) for row in report["levels"].collect()) == [("DEBUG", 1), ("FATAL", 2), ("WARN", 2)]
    assert run_verify(store).count() == 0
    names = {row["path"].split("/")[0] for row in spark.read.parquet(f"{store.root}/{store.current()['manifest']}").collect()}
    assert names == {"generation=1", "generation=2", "generation=3"}
    policy = Retention(event_days=1, snapshot_before_compact=True)
    stats = run_compact(store, policy, NOW + timedelta(days=2), "kept").first()
    assert (stats["expired_events"], stats["closed_incidents"]) == (5, 1)
    assert store.events().count() == 0 and store.incidents().first()["status"] == "resolved"
    assert run_verify(store).count() == 0
    # What expired is gone once no snapshot names it.
    data = tmp_path / "store" / "data"
    assert (data / "generation=1" / "events").exists()
    remove(spark, f"{store.root}/snapshots/kept")
    cleanup(spark, store.root)
    assert [path.name for path in data.iterdir() if any(path.iterdir())] == ["generation=4"]
    assert [row["action"] for row in store.audit().orderBy("sequence").collect()] == ["ingest", "ingest", "detect", "compact"]
    part = next(data.rglob("incidents/part*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    part.with_name(f".{part.name}.crc").unlink(missing_ok=True)
    assert run_verify(store).count() == 2
