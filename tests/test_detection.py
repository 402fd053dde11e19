"""Detection and incident lifecycle against plain Python walks."""

import hashlib
import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from timberflow import schemas
from timberflow.operators import detection
from timberflow.operators.detection import covered_events, detect, detected_incidents, evaluations, fired_ranges, first_fired
from timberflow.operators.incidents import auto_resolve, merged_links, news_of_rows, news_of_run, reconcile, transition
from timberflow.operators.positions import merge_ranges, rank_and_before, with_position
from timberflow.operators.predicates import match_rules
from timberflow.session import shared_folder
from timberflow.settings import Predicate, Rule

T0 = datetime(2025, 3, 1, 10, tzinfo=timezone.utc)
NOW = T0 + timedelta(days=2)
COLUMNS = "id string, timestamp timestamp, ts_nanos int, level string, source string, message string, fields map<string,string>, fingerprint string, input string, line bigint"


def events_of(spark, rows):
    data = [(i, T0 + timedelta(seconds=at), 0, level, source, "m", {}, "f" + i, "in", 1) for i, at, level, source in rows]
    return spark.createDataFrame(data, COLUMNS)


def random_events(rng, count, span, sources=3):
    rows = []
    for i in range(count):
        rows.append((f"e{rng.randint(0, 10**6):06d}x{i}", rng.randint(0, span), rng.choice(["INFO", "ERROR", "FATAL"]), f"s{rng.randint(1, sources)}"))
    return rows


def walk(rows, rule, levels):
    """Fired windows (group, ids in the window, last id) and suppressed count by walking the events."""
    buffers, last, fired, suppressed = {}, {}, [], 0
    window, cooldown = rule.window_nanos / 1e9, rule.cooldown_nanos / 1e9
    for event in sorted(rows, key=lambda row: (row[1], row[0])):
        if event[2] not in levels:
            continue
        key = f"source={event[3]}" if rule.group_by else "all"
        buffer = [old for old in buffers.get(key, []) if old[1] >= event[1] - window] + [event]
        buffers[key] = buffer
        if len(buffer) < rule.threshold:
            continue
        if key in last and event[1] - last[key] < cooldown:
            suppressed += 1
            continue
        last[key] = event[1]
        fired.append((key, tuple(sorted(old[0] for old in buffer))))
    return sorted(fired), suppressed


@pytest.mark.parametrize(
    "group_by,threshold,window,cooldown,chain_rows",
    [
        (["source"], 3, "30s", "60s", 1_000_000),
        (["source"], 3, "30s", "60s", 5),
        ([], 4, "20s", "10s", 5),
        ([], 1, "0s", "25s", 5),
        (["source"], 2, "10s", "0s", 5),
        (["source"], 1, "-5s", "7s", 1_000_000),
    ],
)
def test_random_windows(spark, group_by, threshold, window, cooldown, chain_rows):
    rng = random.Random(threshold * 100 + chain_rows)
    rows = random_events(rng, 400, 900)
    rule = Rule("r", all=[Predicate("level", "gte", "ERROR")], group_by=group_by, threshold=threshold, window=window, cooldown=cooldown)
    run = detect(events_of(spark, rows), [rule, Rule("off", enabled=False)], chain_rows=chain_rows)
    want, suppressed = walk(rows, rule, ("ERROR", "FATAL"))
    found = detected_incidents(run, NOW).collect()
    assert sorted((row["group"], tuple(row["event_ids"])) for row in found) == want
    assert all(row["count"] == len(row["event_ids"]) for row in found)
    counts = {row["rule"]: row.asDict() for row in evaluations(run).collect()}
    matched = sum(row[2] != "INFO" for row in rows)
    assert counts["r"] == {"rule": "r", "examined": 400, "matched": matched, "triggered": len(want), "suppressed": suppressed}
    assert set(counts["off"].values()) == {"off", 0}


def test_sample_rule(spark):
    rows = [("a", 0, "INFO", "gateway"), ("b", 60, "ERROR", "gateway"), ("c", 120, "ERROR", "gateway"), ("d", 180, "WARN", "worker")]
    rule = Rule("repeated", all=[Predicate("level", "gte", "ERROR")], group_by=["source"], threshold=2, window="5m", cooldown="10m", labels={"team": "ops"})
    events = events_of(spark, rows)
    empty = spark.createDataFrame([], schemas.ddl(schemas.INCIDENTS))
    opened = reconcile(empty, detected_incidents(detect(events, [rule]), NOW), [rule], NOW)
    (row,) = opened.collect()
    assert (row["group"], row["count"], row["status"], row["labels"]) == ("source=gateway", 2, "open", {"team": "ops"})
    assert row["history"][0]["reason"] == "threshold 2 reached in 5m"
    assert (row["last_seen"] - row["first_seen"]) == timedelta(minutes=1)
    later = NOW + timedelta(hours=1)
    nothing = detected_incidents(detect(events.limit(0), [rule]), later)
    (row,) = reconcile(opened, nothing, [rule], later).collect()
    assert row["status"] == "resolved" and row["resolved_at"] is not None


def test_hot_group_spreads(spark):
    """One group with nearly all rows: positions come from many range partitions, not from one task."""
    rows = spark.range(20000).select(F.lit("g").alias("k"), (F.col("id") % 97).alias("us"), F.lit(0).alias("nanos"), F.col("id").cast("string").alias("id"), F.col("id").alias("row"))
    ranked = rank_and_before(rows, ["k"], F.lit(-10_000), "row").collect()
    order = sorted(((row["us"], row["id"]) for row in ranked))
    place = {key: i + 1 for i, key in enumerate(order)}
    per = {}
    for us, _ in order:
        per[us] = per.get(us, 0) + 1
    for row in ranked:
        assert row["rn"] == place[(row["us"], row["id"])]
        assert row["before"] == sum(n for us, n in per.items() if us < row["us"] - 10)
    placed = with_position(rows, ["us", "row"], ["k"])
    assert placed.agg(F.max("pos"), F.count_distinct("pos")).first()[:] == (20000, 20000)


def incident(key, first, last, status="open", updated=0, count=1, ids=("x",)):
    at = lambda hours: T0 + timedelta(hours=hours)
    return (
        f"{key}-{first}-{last}-{status}-{updated}", "r", "t", status, "ERROR", key, "f", at(first), at(last), at(first), at(updated),
        at(updated) if status == "resolved" else None, count, list(ids), {}, [(at(first), None, "open", "made")],
    )


def plain_reconcile(existing, detected, resolve_hours, now):
    """Merge and resolve one after another, rows as dicts."""
    rows = [dict(row) for row in sorted(existing, key=lambda row: (row["first_seen"], row["id"]))]
    where = {row["group"]: i for i, row in enumerate(rows)}
    active = set()
    for new in detected:
        active.add(new["group"])
        if new["group"] not in where:
            where[new["group"]] = len(rows)
            rows.append(dict(new))
            continue
        row = rows[where[new["group"]]]
        row["first_seen"] = min(row["first_seen"], new["first_seen"])
        row["last_seen"] = max(row["last_seen"], new["last_seen"])
        row["count"] += new["count"]
        row["event_ids"] = sorted(set(row["event_ids"]) | set(new["event_ids"]))
        if row["status"] == "resolved" and now >= row["updated_at"]:
            row.update(status="open", resolved_at=None)
        row["updated_at"] = now
    for row in rows:
        quiet = row["group"] not in active and row["status"] != "resolved"
        if quiet and resolve_hours and now - row["last_seen"] >= timedelta(hours=resolve_hours) and now >= row["updated_at"]:
            row.update(status="resolved", updated_at=now, resolved_at=now)
    return rows


def test_reconcile_random(spark):
    rng = random.Random(9)
    existing, detected = [], []
    for key in range(60):
        for _ in range(rng.choice([0, 1, 1, 2])):
            first = rng.randint(0, 20)
            existing.append(incident(f"k{key}", first, first + rng.randint(0, 5), rng.choice(["open", "acknowledged", "resolved"]), rng.randint(20, 60), rng.randint(1, 9), sorted(rng.sample("abcdef", 2))))
        for order in range(rng.choice([0, 0, 1, 2, 3])):
            first = rng.randint(0, 30)
            detected.append((*incident(f"k{key}", first, first + 1, "open", 48, rng.randint(1, 9), sorted(rng.sample("abcdefgh", 3))), order))
    existing = list({row[0]: row for row in existing}.values())
    now = T0 + timedelta(hours=48)
    rule = Rule("r", resolve_after="24h")
    old = spark.createDataFrame(existing, schemas.ddl(schemas.INCIDENTS))
    new = spark.createDataFrame(detected, schemas.ddl(schemas.INCIDENTS) + ", fired_rn bigint")
    names = list(schemas.INCIDENTS)
    want = plain_reconcile([dict(zip(names, row)) for row in existing], [dict(zip(names, row)) for row in detected], 24, now)
    view = ["id", "group", "status", "count", "event_ids", "first_seen", "last_seen", "updated_at", "resolved_at"]
    plain = lambda value: value.replace(tzinfo=None) if isinstance(value, datetime) else value
    shape = lambda row: str([plain(row[name]) for name in view])
    got = reconcile(old, new, [rule], now).collect()
    assert sorted(map(shape, got)) == sorted(map(shape, want))
    # A second run changes nothing when each key has one row, which is all that reconciling ever makes.
    old = spark.createDataFrame(list({row[5]: row for row in existing}.values()), schemas.ddl(schemas.INCIDENTS))
    again = reconcile(reconcile(old, new, [rule], now, idempotent=True), new, [rule], now, idempotent=True)
    once = {row["id"]: row["count"] for row in reconcile(old, new, [rule], now, idempotent=True).collect()}
    assert {row["id"]: row["count"] for row in again.collect()} == once


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_merge_ranges_equals_marking(spark, partitions):
    """Hot and thin keys: the union covers what the ranges cover, and its ranges do not touch."""
    rng = random.Random(int(partitions))
    rows = []
    for key, count in (("hot", 300), ("thin", 3), ("one", 1)):
        for _ in range(count):
            low = rng.randint(0, 900)
            rows.append((key, low, low + rng.choice([0, 0, 3, 40])))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = merge_ranges(spark.createDataFrame(rows, "k string, lo long, hi long"), ["k"], "lo", "hi").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(row["merged"] for row in got) == len(rows)
    for key in ("hot", "thin", "one"):
        marked = {at for k, low, high in rows if k == key for at in range(low, high + 1)}
        union = sorted((row["lo"], row["hi"]) for row in got if row["k"] == key)
        assert sorted(at for low, high in union for at in range(low, high + 1)) == sorted(marked)
        assert all(high < low for (_, high), (low, _) in zip(union, union[1:]))
    assert merge_ranges(spark.createDataFrame([], "k string, lo long, hi long"), ["k"], "lo", "hi").collect() == []


def test_every_covered_event_is_met_once(spark):
    """Without cooldown windows overlap heavily; their union still has each row once."""
    rng = random.Random(21)
    rows = random_events(rng, 500, 600, sources=2)
    rule = Rule("r", all=[Predicate("level", "gte", "ERROR")], group_by=["source"], threshold=3, window="40s", cooldown="0s")
    run = detect(events_of(spark, rows), [rule])
    want, _ = walk(rows, rule, ("ERROR", "FATAL"))
    got = covered_events(run).select("grp", "id").collect()
    assert len(got) == len(set(got)) < sum(len(ids) for _, ids in want)
    assert set(map(tuple, got)) == {(group, i) for group, ids in want for i in ids}
    assert fired_ranges(run).agg(F.sum("merged")).first()[0] == len(want)


def test_first_windows_bring_their_own_rows_only(spark):
    rng = random.Random(22)
    rows = random_events(rng, 500, 600, sources=2)
    rule = Rule("r", all=[Predicate("level", "gte", "ERROR")], group_by=["source"], threshold=3, window="40s", cooldown="0s")
    run = detect(events_of(spark, rows), [rule])
    first = first_fired(run)
    got = first.counted.groupBy("grp").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()
    earliest = {row["grp"]: row["at"] for row in run.fired.groupBy("grp").agg(F.min("rn").alias("at")).collect()}
    want = {row["group"]: row["event_ids"] for row in detected_incidents(run, NOW).collect() if row["fired_rn"] == earliest[row["group"]]}
    assert {row["grp"]: row["ids"] for row in got} == want and len(want) == 2
    assert first.counted.count() < run.counted.count()


def test_events_without_a_rule_are_not_shaped(spark):
    """What an event is given before the rules see it is computed for the events that a rule wants."""
    rule = Rule("r", all=[Predicate("level", "gte", "ERROR")])
    refuse = F.when(F.col("level") == "INFO", F.raise_error(F.lit("shaped")).cast("string")).otherwise("fine")
    rows = [("a", 0, "INFO", "s"), ("b", 1, "ERROR", "s"), ("c", 2, "INFO", "s")]
    shaped = events_of(spark, rows).withColumn("fingerprint", refuse)
    assert [(row["id"], row["fingerprint"]) for row in match_rules(shaped, [rule]).collect()] == [("b", "fine")]


@pytest.mark.parametrize("idempotent", [False, True])
def test_news_of_a_run_equal_its_rows(spark, idempotent):
    """Two runs over the same store: merged ranges give the incidents that listing every window gives."""
    rng = random.Random(33)
    rows = random_events(rng, 300, 900)
    rules = [
        Rule("flood", all=[Predicate("level", "gte", "ERROR")], group_by=["source"], threshold=2, window="30s", cooldown="0s"),
        Rule("calm", all=[Predicate("level", "gte", "ERROR")], threshold=4, window="30s", cooldown="90s", resolve_after="1h", labels={"a": "b"}),
    ]
    events = events_of(spark, rows)
    half = events.filter(F.col("timestamp") < F.lit(T0 + timedelta(seconds=450)))
    empty = spark.createDataFrame([], schemas.ddl(schemas.INCIDENTS))
    shape = lambda table: sorted(str(row.asDict(recursive=True)) for row in table.collect())
    first, second = detect(half, rules), detect(events, rules)
    old = reconcile(empty, detected_incidents(first, NOW), rules, NOW, idempotent)
    assert shape(reconcile(empty, news_of_run(first, NOW), rules, NOW, idempotent)) == shape(old)
    later = NOW + timedelta(hours=3)
    by_rows = reconcile(old, detected_incidents(second, later), rules, later, idempotent)
    assert shape(reconcile(old, news_of_run(second, later), rules, later, idempotent)) == shape(by_rows)
    links = merged_links(old, news_of_rows(detected_incidents(second, later)))
    assert sorted(map(tuple, links.collect())) == sorted((r["rule_id"], r["group"], i) for r in by_rows.collect() for i in r["event_ids"])


def test_long_chain_crosses_many_blocks(spark):
    """One group of 3,000 candidates in blocks of 16 ranks: the chain is that of a plain walk."""
    rng = random.Random(4)
    rows = [(f"e{k:05d}", at, "ERROR", "s") for k, at in enumerate(sorted(rng.randint(0, 9000) for _ in range(3000)))]
    rule = Rule("r", all=[Predicate("level", "gte", "ERROR")], threshold=1, window="0s", cooldown="25s")
    fired = [row["id"] for row in detect(events_of(spark, rows), [rule], chain_rows=16).fired.collect()]
    want, last = [], None
    for event, at, _, _ in rows:
        if last is None or at - last >= 25:
            want.append(event)
            last = at
    assert sorted(fired) == want


def test_lifecycle(spark):
    rows = spark.createDataFrame([incident("k", 0, 1)], schemas.ddl(schemas.INCIDENTS))
    (one,) = rows.collect()

    def step(df, target, hours):
        asked = [(one["id"], target, T0 + timedelta(hours=hours), "test")]
        return transition(df, spark.createDataFrame(asked, "id string, target string, at timestamp, reason string"))

    seen = step(rows, "acknowledged", 1).drop("refused")
    done = step(seen, "resolved", 2).drop("refused")
    (row,) = done.collect()
    assert row["status"] == "resolved" and row["resolved_at"] == (T0 + timedelta(hours=2)).replace(tzinfo=None)
    assert [(item["from"], item["to"]) for item in row["history"]][1:] == [("open", "acknowledged"), ("acknowledged", "resolved")]
    assert step(done, "acknowledged", 3).first()["refused"] == "cannot acknowledge a resolved incident"
    assert step(done, "open", 1).first()["refused"] == "transition time precedes current update"
    assert step(done, "closed", 3).first()["refused"] == 'invalid target status "closed"'
    same = step(done, "resolved", 5).first()
    assert same["refused"] is None and same["updated_at"] == (T0 + timedelta(hours=2)).replace(tzinfo=None)
    assert step(done, "open", 3).first()["resolved_at"] is None
    assert auto_resolve(rows, [], NOW).first()["status"] == "open"


@pytest.mark.parametrize("group_by", [["source"], []])
def test_wide_overlapping_windows_shuffle_rows_only(spark, group_by):
    rng = random.Random(11)
    rows = random_events(rng, 900, 120)
    wide = Rule("wide", all=[Predicate("level", "gte", "ERROR")], group_by=group_by, threshold=2, window="60s", cooldown="0s")
    slim = Rule("slim", all=[Predicate("level", "eq", "INFO")], group_by=group_by, threshold=2, window="2s", cooldown="9s")
    found = detected_incidents(detect(events_of(spark, rows), [wide, slim]), NOW)
    got = found.select("rule_id", "group", "event_ids", "count").collect()
    for rule, levels in ((wide, ("ERROR", "FATAL")), (slim, ("INFO",))):
        expected, _ = walk(rows, rule, levels)
        assert sorted((r["group"], tuple(r["event_ids"])) for r in got if r["rule_id"] == rule.id) == expected
    assert all(r["count"] == len(r["event_ids"]) for r in got)
    assert max(r["count"] for r in got) > 64
    # What windows hold is not gathered again after rows have met them: every aggregate lies below the join.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


@pytest.mark.parametrize("threshold,cooldown", [(7, "60s"), (2, "0s")])
def test_equal_instants_on_small_pages(spark, monkeypatch, threshold, cooldown):
    """Twenty instants with twenty rows each, windows over many pages, and thresholds reached in the midst of an instant."""
    monkeypatch.setattr(detection, "BLOCK_ROWS", 8)
    monkeypatch.setattr(detection, "UNFOLD_ROWS", 3)
    rng = random.Random(threshold)
    rows = [(i, at * 30, level, source) for i, at, level, source in random_events(rng, 400, 19)]
    rule = Rule("r", all=[Predicate("level", "gte", "ERROR")], group_by=["source"], threshold=threshold, window="60s", cooldown=cooldown)
    run = detect(events_of(spark, rows), [rule], chain_rows=2)
    want, suppressed = walk(rows, rule, ("ERROR", "FATAL"))
    found = detected_incidents(run, NOW).collect()
    assert sorted((row["group"], tuple(row["event_ids"])) for row in found) == want
    (counts,) = evaluations(run).collect()
    assert (counts["triggered"], counts["suppressed"]) == (len(want), suppressed)
    ends = sorted((row["grp"], row["rn"], row["cnt"]) for row in run.fired.select("grp", "id", "rn", "cnt").collect())
    assert ends == sorted((row["group"], row["fired_rn"], row["count"]) for row in found)


def test_detection_keeps_each_row_once(spark):
    """What a run leaves on the shared disk is little more than ids and fingerprints of the rows that a rule wants."""
    digest = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    data = [(digest(i)[:24], T0 + timedelta(minutes=i // 40), 0, "ERROR", f"s{i % 3}", "m", {}, digest(-i), "in", i) for i in range(12_000)]
    rule = Rule("r", all=[Predicate("level", "gte", "ERROR")], group_by=["source"], threshold=3, window="5m", cooldown="20m")
    folder = shared_folder(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(folder) for name in names)
    before = size()
    run = detect(spark.createDataFrame(data, COLUMNS), [rule])
    assert size() - before < len(data) * 150
    assert run.counted.count() == len(data) and run.windows.count() == 3 * 15
