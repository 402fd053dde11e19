"""Appends against the key table, and which of its files they read."""

import random
from datetime import datetime, timedelta, timezone

from timberflow import schemas
from timberflow.operators.dedup import append_counts, append_new
from timberflow.operators.keys import KeyTable, _keys_of

T0 = datetime(2025, 6, 7, 8, tzinfo=timezone.utc)


def rows_of(spark, pairs):
    data = [(i, T0 + timedelta(seconds=k), 0, "INFO", "s", "m", {}, f, "in", 1, T0) for k, (i, f) in enumerate(pairs)]
    return spark.createDataFrame(data, schemas.ddl(schemas.EVENTS))


def test_appends_equal_whole_reads(spark, tmp_path):
    """Five appends with repeats inside and across them, by id and by fingerprint: the same rows as from the whole table."""
    rng = random.Random(3)
    stored, table = rows_of(spark, []), KeyTable(spark, str(tmp_path), [], buckets=8)
    for segment in range(1, 6):
        added = rows_of(spark, [(f"i{rng.randint(0, 300)}", f"f{rng.randint(0, 300)}") for _ in range(80)])
        fresh = table.new_rows(added)
        shape = lambda df: sorted((r["id"], r["fingerprint"], str(r["timestamp"])) for r in df.collect())
        assert shape(fresh) == shape(append_new(stored, added))
        assert append_counts(added, fresh).first()["added"] == fresh.count()
        table.add(fresh, segment)
        table.add(fresh, segment)  # a run that is repeated
        table.active = [*table.active, segment]
        stored = spark.createDataFrame(stored.unionByName(fresh.select(*stored.columns)).collect(), stored.schema)


def test_only_touched_buckets_are_read(spark, tmp_path):
    table = KeyTable(spark, str(tmp_path), [1, 2], buckets=16)
    table.add(rows_of(spark, [(f"i{k}", f"f{k}") for k in range(400)]), 1)
    table.add(rows_of(spark, [(f"i{k}", f"f{k}") for k in range(400, 800)]), 2)
    known = rows_of(spark, [("i7", "f7"), ("new", "newer")])
    possible = table.possible(_keys_of(known, 16))
    assert {(r["key"], r["segment"]) for r in possible.collect()} == {("ii7", 1), ("ff7", 1)}
    files = table.touched(possible).inputFiles()
    buckets = {r["bucket"] for r in possible.collect()}
    assert files and all("segment=1" in f and any(f"bucket={b}/" in f for b in buckets) for f in files)
    assert [r["id"] for r in table.new_rows(known).collect()] == ["new"]
    # Nothing that is stored may be repeated: no file of keys is read at all.
    fresh = rows_of(spark, [("other", "others")])
    assert table.touched(table.possible(_keys_of(fresh, 16))).inputFiles() == []
    assert table.new_rows(fresh).count() == 1
    # A segment that no longer counts is not looked at.
    table.active = [2]
    assert table.new_rows(known).count() == 2


def test_full_filters_cost_reads_and_no_results(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("timberflow.operators.keys.LEAST_BITS", 64)
    table = KeyTable(spark, str(tmp_path), [1], buckets=2, bits_per_key=0)
    table.add(rows_of(spark, [(f"i{k}", f"f{k}") for k in range(500)]), 1)
    added = rows_of(spark, [(f"i{k}", f"f{k}") for k in range(490, 510)])
    assert sorted(r["id"] for r in table.new_rows(added).collect()) == sorted(f"i{k}" for k in range(500, 510))


def test_filters_grow_with_their_segment(spark, tmp_path):
    """Segments of very different sizes have filters of different sizes, and additions are held against all of them."""
    table = KeyTable(spark, str(tmp_path), [1, 2], buckets=2)
    table.add(rows_of(spark, [("small", "one")]), 1)
    table.add(rows_of(spark, [(f"i{k}", f"f{k}") for k in range(5000)]), 2)
    assert sorted(path.name for path in (tmp_path / "filters").iterdir()) == ["size=4096", "size=65536"]
    added = rows_of(spark, [("small", "new"), ("x", "f77"), ("y", "one"), ("z", "fresh")])
    assert [r["id"] for r in table.new_rows(added).collect()] == ["z"]
    unknown = rows_of(spark, [(f"u{k}", f"v{k}") for k in range(300)])
    assert table.possible(_keys_of(unknown, 2)).count() < 30
