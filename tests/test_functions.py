"""Scalar functions against plain Python."""

import hashlib
import random
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from timberflow.functions import (
    canonical_message,
    event_fingerprint,
    field_value,
    hash_strings,
    normalize_message,
    normalize_source,
    parse_level,
    percent,
    rfc3339,
    time_bucket,
    with_epoch,
    with_timestamp,
)
from timberflow.functions.levels import parse_stored_level
from timberflow.functions.times import parse_layout, translate_layout
from timberflow.operators.predicates import java_pattern
from timberflow.settings import DEFAULT_LAYOUTS, LogSource, Predicate, Rule, duration_nanos, select_sources


def values(df, column):
    return [row[0] for row in df.select(column).collect()]


def test_a_layout_is_matched_once(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:07.5Z",), ("x",), (None,)], "s string")
    parsed = df.select(parse_layout(F.col("s"), translate_layout(DEFAULT_LAYOUTS[0])).alias("p"))
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == plan.count("regexp_extract(") == 1
    assert [row["p"] and tuple(row["p"]) for row in parsed.collect()] == [(1_704_067_207_500_000, 0), None, None]


def test_normalization(spark):
    df = spark.createDataFrame(
        [("\tPump/Station 9 ", "\n valve 8 stuck\t\r\n  pressure 3 bar "), ("--a__b..C!!d--", "　x\t\r\ry  ")],
        "s string, m string",
    )
    assert values(df, normalize_source(F.col("s"))) == ["pump-station-9", "a__b..c-d"]
    assert values(df, normalize_message(F.col("m"))) == ["valve 8 stuck\n  pressure 3 bar", "x\n\ny"]


def test_same_content_has_one_fingerprint(spark):
    df = spark.createDataFrame(
        [
            ("valve 8 stuck\n pressure 3 bar", {"hall": "north", "Volatile.x": "1"}),
            ("Valve 21  stuck pressure 40\nbar", {"VOLATILE.y": "2", "hall": "north"}),
            ("valve 21 stuck\npressure 40 bar", {"hall": "south"}),
        ],
        "m string, f map<string,string>",
    )
    found = values(df, event_fingerprint(F.lit("pump"), F.lit("WARN"), F.col("m"), F.col("f")))
    assert found[0] == found[1] != found[2]
    parts = ["pump", "WARN", "valve # stuck pressure # bar", "hall=north"]
    framed = b"".join(str(len(p.encode())).encode() + b":" + p.encode() + b"\0" for p in parts)
    assert found[0] == hashlib.sha256(framed).hexdigest()


def test_hash_counts_bytes(spark):
    df = spark.createDataFrame([("é", "")], "a string, b string")
    expected = hashlib.sha256(b"2:\xc3\xa9\x000:\x00").hexdigest()
    assert values(df, hash_strings(F.col("a"), F.col("b"))) == [expected]


def plain_canonical(text):
    words = []
    for word in text.lower().split():
        core = word.strip("[](),;:")
        number = re.fullmatch(r"[+-]?[0-9]+", core) and -(2**63) <= int(core) < 2**63
        words.append("#" if number else word)
    return " ".join(words)


def test_canonical_message_random(spark):
    rng = random.Random(5)
    pieces = ["12", "-7", "+0", "(3)", "[4,", "x5", "5x", "1.5", "-", "+", "", "9223372036854775807", "9223372036854775808",
              "-9223372036854775808", "-9223372036854775809", "00000000000000000000012", "a,b", ";;8::", "Ünï"]
    spaces = [" ", "  ", "\t", "\n", " \n ", " ", " "]
    rows = []
    for _ in range(1500):
        rows.append(("".join(rng.choice(pieces) + rng.choice(spaces) for _ in range(rng.randint(0, 7))),))
    got = values(spark.createDataFrame(rows, "m string"), canonical_message(F.col("m")))
    assert got == [plain_canonical(row[0]) for row in rows]


def test_levels(spark):
    df = spark.createDataFrame([(" verbose",), ("Notice",), ("crit ",), ("",), ("3",), ("loud",)], "l string")
    assert values(df, parse_level(F.col("l"))) == ["TRACE", "INFO", "FATAL", None, None, None]
    assert values(df, parse_stored_level(F.col("l"))) == ["TRACE", "INFO", "FATAL", None, "WARN", None]
    with pytest.raises(ValueError):
        Rule("r", severity="loud")


@pytest.mark.parametrize(
    "kind,text,expected",
    [
        ("string", "2025-03-01T10:00:00.123456789Z", ("2025-03-01T10:00:00.123456", 789)),
        ("string", "2025-03-01 1:00:00", ("2025-03-01T01:00:00", 0)),
        ("string", "2025-03-01T10:00:00-05:00", ("2025-03-01T15:00:00", 0)),
        ("string", "2025-02-30 10:00:00", 'timestamp "2025-02-30 10:00:00" matches no configured layout'),
        ("string", "  ", "timestamp is empty"),
        ("string", "1700000000.25", ("2023-11-14T22:13:20.25", 0)),
        ("number", "1700000000999", ("2023-11-14T22:13:20", 0)),
        ("number", "1700000000999.5", ("2023-11-14T22:13:20.5", 0)),
        ("number", "1700000000999999", ("2023-11-14T22:13:20", 0)),
        ("number", "-1", "epoch timestamp out of range"),
        ("number", "1e300", "epoch timestamp out of range"),
        ("null", "", "timestamp has unsupported type <nil>"),
        ("array", "", "timestamp has unsupported type []interface {}"),
    ],
)
def test_timestamps(spark, kind, text, expected):
    df = spark.createDataFrame([(kind, text)], "kind string, text string")
    row = with_timestamp(df, F.col("kind"), F.col("text"), DEFAULT_LAYOUTS, "at").first()["at"]
    if isinstance(expected, str):
        assert row["reason"] == expected
    else:
        micros = (datetime.fromisoformat(expected[0]) - datetime(1970, 1, 1)) // timedelta(microseconds=1)
        assert (row["reason"], row["us"], row["nanos"]) == (None, micros, expected[1])


def test_precise_epoch_keeps_milliseconds(spark):
    df = spark.createDataFrame([("1700000000999",)], "t string")
    row = with_epoch(df, F.col("t"), "at", precise=True).first()["at"]
    assert abs(row["us"] - 1_700_000_000_999_000) <= 1


def test_custom_layouts(spark):
    df = spark.createDataFrame([("02/Jan/2024:13:04:05 +0200",)], "t string")
    layouts = ["02/Jan/2006:15:04:05 -0700"]
    row = with_timestamp(df, F.lit("string"), F.col("t"), layouts, "at").first()["at"]
    moment = datetime(2024, 1, 2, 13, 4, 5, tzinfo=timezone(timedelta(hours=2)))
    assert row["us"] == int(moment.timestamp()) * 1_000_000
    with pytest.raises(ValueError):
        translate_layout("Mon 02")


def test_rfc3339_and_buckets(spark):
    df = spark.sql("select timestamp'2025-03-05 10:00:00.120000' t, 7 n")
    assert values(df, rfc3339(F.col("t"))) == ["2025-03-05T10:00:00.12Z"]
    assert values(df, rfc3339(F.col("t"), F.col("n"))) == ["2025-03-05T10:00:00.120000007Z"]
    assert values(df, time_bucket(F.col("t"), duration_nanos("168h")))[0] == datetime(2025, 3, 3)
    assert values(df, time_bucket(F.col("t"), 0))[0] == datetime(2025, 3, 5, 10)


def test_percent_rounds_half_even(spark):
    rng = random.Random(1)
    rows = [(1, 8), (1, 16), (3, 16), (0, 0), (5, 2000), (15, 10000), (49, 400), (7, 7)]
    rows += [(rng.randint(0, 500), rng.randint(1, 500)) for _ in range(800)]
    got = values(spark.createDataFrame(rows, "a bigint, b bigint"), percent(F.col("a"), F.col("b")))
    assert got == [f"{a * 100 / b:.1f}%" if b else "0.0%" for a, b in rows]


def test_field_lookup_prefers_exact_then_smallest_key(spark):
    df = spark.createDataFrame([({"Host": "1", "HOST": "2", "host": "3"}, "", 0)], "fields map<string,string>, input string, line bigint")
    assert values(df, field_value("host")) == ["3"]
    assert values(df, field_value("hOST")) == ["2"]
    assert values(df, field_value("input")) == [None]
    assert values(df, field_value("line")) == [None]


def test_patterns():
    assert java_pattern("a$") == r"(?d)a\z"
    assert java_pattern("(?P<x>[[:alpha:]&&])") == r"(?d)(?<x>[\p{Alpha}\&\&])"
    for foreign in (r"(?=a)", r"(a)\1", "(?<!a)b", "a++"):
        with pytest.raises(ValueError):
            java_pattern(foreign)


def test_settings():
    assert duration_nanos("1h30m") == 5_400_000_000_000
    assert duration_nanos("-1.5s") == -1_500_000_000
    for bad in ("", "5", "1x", "1h 2m"):
        with pytest.raises(ValueError):
            duration_nanos(bad)
    with pytest.raises(ValueError):
        Predicate("a", "like")
    with pytest.raises(ValueError):
        Predicate("a", "in")
    sources = [LogSource("a", "p", "json"), LogSource("b", "p", "csv")]
    assert [source.name for source in select_sources(sources, ["b"])] == ["b"]
    with pytest.raises(ValueError, match="no source is called c"):
        select_sources(sources, ["c"])
