"""Sources on small files, with tiny blocks so that one file is read by many tasks."""

import csv
import io
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from timberflow.settings import LogSource, Multiline
from timberflow.sources import csv_records
from timberflow.sources.csv_records import check_headers, split_records
from timberflow.sources.ingest import ingest, merged_stats, tagged_source
from timberflow.sources.json_documents import read_documents
from timberflow.sources.lines import read_lines, scan_lines
from timberflow.sources.normalize import cut_raw
from timberflow.sources.readers import assemble_multiline

NOW = datetime(2025, 3, 1, 12)


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    return str(path)


def record(**more):
    base = {"timestamp": "2025-03-01T08:30:00Z", "level": "severe", "source": "Print Room", "message": "tray 4 jammed"}
    return json.dumps({**base, **more})


def rows(spark, tmp_path, text, format="jsonl", **more):
    source = LogSource("in", write(tmp_path, f"in.{format}", text), format, **more)
    return [row.asDict() for row in tagged_source(spark, source, NOW).orderBy("line").collect()]


def test_counters_of_one_file(spark, tmp_path):
    """Two spellings of one event, two broken lines and a blank one."""
    lines = [record(), '["a list"]', "", record(level="err", source="print  room", message="tray 17 jammed"), record(message="lamp out") + "}"]
    text = "\r\n".join(lines)
    result = ingest(spark, [LogSource("in", write(tmp_path, "a.jsonl", text), "jsonl")], NOW)
    assert [row.line for row in result.events.collect()] == [1]
    stats = merged_stats(result.stats).first()
    assert (stats["records"], stats["duplicates"], stats["rejected"], stats["lines"]) == (1, 1, 2, 5)
    assert stats["bytes"] == len(text)
    rejected = sorted((row.line, row.reason, row.raw) for row in result.rejected.collect())
    assert rejected == [(2, "invalid_json", '["a list"]'), (5, "invalid_json", lines[4])]


@pytest.mark.parametrize(
    "line,reason",
    [
        ('{"a":1} trailing', "invalid_json"),
        ('{"a":1}{"b":2}', "invalid_json"),
        ("{'a':1}", "invalid_json"),
        ('{"a":NaN}', "invalid_json"),
        ('{"a":01}', "invalid_json"),
        ('{"a":"\t"}', "invalid_json"),
        ("[1]", "invalid_json"),
        ("null", 'missing timestamp field "timestamp"'),
        ("{}", 'missing timestamp field "timestamp"'),
        (record(level=None), 'unknown level ""'),
        (record(level={"a": 1}), "level field: expected scalar, got map[string]interface {}"),
        (record(level="lo\"ud"), 'unknown level "lo\\"ud"'),
        (record(source=[1]), "source field: expected scalar, got []interface {}"),
        (record(source="!!"), "normalized source is empty"),
        (record(message=" \n "), "message is empty"),
        (record(message=[]), "message field: expected scalar, got []interface {}"),
        (record(b=[1], a={}), 'field "a": expected scalar, got map[string]interface {}'),
        (record(timestamp=True), "timestamp has unsupported type bool"),
        ('{"timestamp":"2025-03-01T10:00:00Z","level":"info"}', 'missing message field "message"'),
    ],
)
def test_rejections(spark, tmp_path, line, reason):
    assert [row["reason"] for row in rows(spark, tmp_path, line)] == [reason]


def test_values_keep_their_text(spark, tmp_path):
    line = '{"timestamp":1700000000,"level":"info","message":"m","source":"","n":1.50,"e":1e3,"t":true,"z":null,"u":"\\ud800\\u00e9","n2":-0}'
    plain = '{"timestamp":1700000000,"level":"info","message":"m","n":1.50,"e":1e3,"t":true,"z":null,"k":"é","k":"last"}'
    first, second = rows(spark, tmp_path, line + "\r\n\n" + plain)
    assert first["fields"] == {"n": "1.50", "e": "1e3", "t": "true", "z": "", "u": "�é", "n2": "-0"}
    assert second["fields"] == {"n": "1.50", "e": "1e3", "t": "true", "z": "", "k": "last"}
    assert (first["source"], first["line"], second["line"]) == ("in", 1, 3)


def test_static_fields_and_raw_cut(spark, tmp_path):
    long = "é" * 3000
    found = rows(spark, tmp_path, record(team="x") + "\n" + long, static_fields={"team": "ops"})
    assert found[0]["fields"] == {"team": "ops"}
    assert found[1]["raw"] == long
    cut = spark.range(1).select(cut_raw(F.lit("x" + long), 4096), cut_raw(F.lit(long), None)).first()
    assert cut[0] == "x" + "é" * 2047 + "�" and cut[1] == long


def test_long_flat_record_does_not_overflow(spark, tmp_path):
    many = {f"k{i}": "v" * 50 for i in range(20000)}
    (row,) = rows(spark, tmp_path, record(**many))
    assert row["reason"] is None and len(row["fields"]) == 20000


def test_json_documents(spark, tmp_path):
    items = [json.loads(record()), None, json.loads(record(message="other"))]
    found = rows(spark, tmp_path, "\n " + json.dumps(items) + "\n", "json")
    assert [(row["line"], row["reason"]) for row in found] == [
        (1, None),
        (2, 'missing timestamp field "timestamp"'),
        (3, None),
    ]
    # A document may be of any size, so a record's raw text is its own and not the document's.
    assert found[1]["raw"] == "null" and json.loads(found[2]["raw"]) == items[2]
    assert len(rows(spark, tmp_path, record(), "json")) == 1
    for bad in ("[1]", "{} {}", '"x"', "[{}"):
        with pytest.raises(Exception, match="JSON document"):
            rows(spark, tmp_path, bad, "json")


def test_sample_csv(spark, tmp_path):
    text = (
        'timestamp, level ,source,message,region\r\n2025-03-01T11:00:00Z,INFO,scheduler,"cycle, ""all""\ncomplete",east\r\n'
        "\n2025-03-01T11:01:00Z,ERROR,scheduler,job failed\n2025-03-01T11:01:00Z,ERR\"OR,s,m,e\n2025-03-01T11:02:00Z,ERROR,s,m,e,f\n"
        '2025-03-01T11:03:00Z,ERROR,s,m,"e\nx'
    )
    found = rows(spark, tmp_path, text, "csv")
    assert [(row["line"], row["reason"], row["raw"]) for row in found] == [
        (2, None, '2025-03-01T11:00:00Z,INFO,scheduler,cycle, "all"\ncomplete,east'),
        (3, "expected 5 columns, got 4", "2025-03-01T11:01:00Z,ERROR,scheduler,job failed"),
        (4, "malformed_csv", ""),
        (5, "expected 5 columns, got 6", "2025-03-01T11:02:00Z,ERROR,s,m,e,f"),
        (6, "malformed_csv", ""),
    ]
    assert found[0]["message"] == 'cycle, "all"\ncomplete' and found[0]["fields"] == {"region": "east"}


def test_csv_headers(spark, tmp_path):
    for bad in (["a", " "], ["a", "a "]):
        with pytest.raises(ValueError):
            check_headers(bad)
    found = rows(spark, tmp_path, "2025-03-01 11:00:00,info,m", "csv", csv_columns=["timestamp", "level", "message"])
    assert [(row["line"], row["reason"], row["source"]) for row in found] == [(1, None, "in")]
    write(tmp_path, "b1.csv", "timestamp,level,message\n1,info,m\n")
    write(tmp_path, "b2.csv", "timestamp,level,text\n1,info,m\n")
    with pytest.raises(Exception, match="header differs"):
        tagged_source(spark, LogSource("in", str(tmp_path / "b*.csv"), "csv"), NOW).collect()


def test_line_numbers_over_blocks(spark, tmp_path, small_blocks):
    rng = random.Random(3)
    lines = [f"{i}:" + "x" * rng.randint(0, 90) if rng.random() > 0.1 else "" for i in range(300)]
    path = write(tmp_path, "a.txt", "\n".join(lines) + "\n")
    assert scan_lines(spark, path).rdd.getNumPartitions() > 20
    got = read_lines(spark, path).orderBy("line").collect()
    assert [(row.line, row.text) for row in got] == [(i + 1, line) for i, line in enumerate(lines)]


def plain_multiline(lines, continue_space, max_lines):
    """Records (line, text, overflow) by walking the lines."""
    found, pending, at = [], [], 0
    for number, text in enumerate(lines, 1):
        if not text.strip():
            continue
        starts = text.strip().startswith("{") and not (continue_space and text[0] in " \t")
        if pending and not starts and len(pending) < max_lines:
            pending.append(text)
            continue
        if pending:
            found.append((at, "\n".join(pending), not starts))
        pending, at = [text], number
    if pending:
        found.append((at, "\n".join(pending), False))
    return found


@pytest.mark.parametrize("continue_space", [True, False])
def test_multiline_random(spark, tmp_path, small_blocks, continue_space):
    rng = random.Random(7)
    pool = ["{start", " {inner", "more", "\tmore", "", "   ", "x" * 70, "}"]
    lines = [rng.choice(pool) for _ in range(400)]
    path = write(tmp_path, "a.txt", "\n".join(lines))
    setting = Multiline(enabled=True, continue_space=continue_space, max_lines=3)
    got = assemble_multiline(scan_lines(spark, path), setting).orderBy("line").collect()
    assert [(row.line, row.text, row.overflow is not None) for row in got] == plain_multiline(lines, continue_space, 3)


def plain_csv(text):
    """Record texts (None when malformed) by walking the characters of each line."""
    found, lines, at = [], text.split("\n"), 0
    if lines[-1] == "":
        lines.pop()
    while at < len(lines):
        if lines[at] == "":
            at += 1
            continue
        record, line, ok, place = [lines[at]], lines[at], True, 0
        while True:
            if place < len(line) and line[place] == '"':
                place += 1
                while True:
                    close = line.find('"', place)
                    if close < 0:
                        at += 1
                        if at >= len(lines):
                            ok = False
                            break
                        line, place = lines[at], 0
                        record.append(line)
                        continue
                    if line[close + 1 : close + 2] == '"':
                        place = close + 2
                        continue
                    place = close + 1
                    break
                if not ok or (place < len(line) and line[place] != ","):
                    ok = False
                    break
            else:
                comma = line.find(",", place)
                end = len(line) if comma < 0 else comma
                if '"' in line[place:end]:
                    ok = False
                    break
                place = end
            if place >= len(line):
                break
            place += 1
        found.append("\n".join(record) if ok else None)
        at += 1
    return found


def test_csv_records_random(spark, tmp_path, small_blocks):
    from timberflow.sources.csv_records import fields_of

    rng = random.Random(11)
    for round_ in range(4):
        pieces = ["a", '"', '""', ",", "\n", "\n\n", '"b"', '","', "x" * 30]
        text = "".join(rng.choice(pieces) for _ in range(900))
        path = write(tmp_path, f"r{round_}.csv", text)
        got = split_records(scan_lines(spark, path)).withColumn("fields", fields_of(F.col("text"))).orderBy("rec").collect()
        want = plain_csv(text)
        assert [row.rec for row in got] == list(range(1, len(want) + 1))
        for row, expected in zip(got, want):
            if expected is None:
                assert row.fields is None
            else:
                assert row.text == expected
                assert row.fields == next(csv.reader(io.StringIO(expected), strict=True))


def test_csv_record_over_many_blocks(spark, tmp_path, small_blocks):
    """A quoted field over dozens of blocks, one that never closes, and a header with line breaks in quotes."""
    header = '"a\n' + "x\n" * 200 + '",b\n'
    text = header + "1,2\n" + '"' + "line\n" * 300 + '",3\n4,5\n6,"' + "lost\n" * 50
    path = write(tmp_path, "long.csv", text)
    got = split_records(scan_lines(spark, path)).orderBy("rec").collect()
    assert [row.text for row in got] == [header[:-1], "1,2", '"' + "line\n" * 300 + '",3', "4,5", None]
    assert csv_records.read_headers(spark, path) == ["a\n" + "x\n" * 199 + "x", "b"]
    with pytest.raises(ValueError, match="header"):
        csv_records.read_headers(spark, write(tmp_path, "open.csv", '"a\n' + "x\n" * 200))


def test_text_is_not_shuffled(spark, tmp_path):
    """Whole records come straight from the scan; exchanges of text stand only above the parts that stick out of a block."""
    csv_path = write(tmp_path, "a.csv", 'a,b\n1,"x\ny"\n')
    lines_path = write(tmp_path, "a.txt", "{a\n b\n{c\n")
    for df in (split_records(scan_lines(spark, csv_path)), assemble_multiline(scan_lines(spark, lines_path), Multiline(enabled=True))):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        whole = plan.split("\n")
        first = next(k for k, line in enumerate(whole) if "MapInArrow" in line)
        aggregates = [k for k, line in enumerate(whole) if "Aggregate" in line]
        assert aggregates and min(aggregates) > first  # the branch of whole records has no aggregate above it
        assert "Window" not in plan and "Sort [" not in plan


def test_multiline_without_starts_and_long_lines(spark, tmp_path, small_blocks):
    lines = [f"more {k}" for k in range(100)]
    path = write(tmp_path, "a.txt", "\n".join(lines))
    got = assemble_multiline(scan_lines(spark, path), Multiline(enabled=True, max_lines=7)).orderBy("line").collect()
    assert [(row.line, row.text, row.overflow is not None) for row in got] == plain_multiline(lines, False, 7)
    assert [row.joined for row in got] == [0] * 14 + [1]
    text = record() + "\n" + record(message="x" * 300) + "\n" + record()
    found = rows(spark, tmp_path, text, max_line_bytes=200)
    assert [row["reason"] for row in found] == [None, "line too long", None] and found[1]["raw"] == text.split("\n")[1]
    assert [row["reason"] for row in rows(spark, tmp_path, text, max_line_bytes=0)] == [None] * 3


def test_json_documents_in_tiny_blocks(spark, tmp_path, small_blocks):
    """Nested, escaped and empty records, nulls everywhere and brackets in strings: blocks of 64 bytes give what one parser gives."""
    spark.conf.set("spark.sql.files.openCostInBytes", "4")  # files of a few bytes need a split size above 0
    rng = random.Random(17)
    pool = [None, {}, {"a": "}{][,\"\\"}, {"a": [{"b": [1, {}]}, "]}"], "c": {"d": {}}}, {"k": "x" * 150, "n": 1.5}, {"\\": "é\n"}]
    for k, indent in enumerate([None, 1, None, 3]):
        document = [rng.choice(pool) for _ in range(60)]
        path = write(tmp_path, f"d{k}.json", rng.choice(["", " \n"]) + json.dumps(document, indent=indent, ensure_ascii=k % 2 == 0) + rng.choice(["", "\n\n"]))
        got = read_documents(spark, path).orderBy("line").collect()
        assert [(row.line, json.loads(row.raw)) for row in got] == [(i + 1, item) for i, item in enumerate(document)]
        assert [set(row.record) for row in got] == [set(item or {}) for item in document]
    for text, want in (("[]", []), (" null ", [None]), ("[ null ,null]", [None, None]), ('{"a":"' + "}" * 200 + '"}\n', [{"a": "}" * 200}])):
        got = read_documents(spark, write(tmp_path, "one.json", text)).orderBy("line").collect()
        assert [json.loads(row.raw) for row in got] == want
    good_ = json.dumps([pool[3]] * 9)
    for k, bad in enumerate([good_[:-1], good_ + "]", good_[1:], good_.replace("},", "}", 1), good_ + " x", good_.replace("[", "[,", 1), good_.replace("}}, {", "}}, 7, {", 1), '{"a":1} null', "[null,]", "  "]):
        with pytest.raises(Exception, match="JSON document"):
            read_documents(spark, write(tmp_path, f"bad{k}.json", bad)).collect()
