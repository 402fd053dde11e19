"""Queries over text sources: the test events written as log files, read back and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberflow.operators import sinks
from timberflow.plans import adapter
from timberflow.plans.catalog import query
from timberflow.plans.oracle import EV, LEVEL_CASE
from timberflow.session import scratch_path
from timberflow.settings import LogSource, Multiline
from timberflow.sources.ingest import good, ingest, rejections, tagged_source
from timberflow.sources.lines import read_lines
from timberflow.sources.normalize import normalize
from timberflow.sources.tables import load_events

NOW = adapter.NOW

# Rows per written file: bounds every write task and every per-file order.
FILE_ROWS = 1_000_000

_WRITTEN: dict[tuple[str, str, str], str] = {}


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return adapter.raw_records(spark, folder).withColumns(
        {
            "day": F.date_format("timestamp", "yyyy-MM-dd"),
            "part": F.floor(F.col("event_id") / FILE_ROWS).cast("bigint"),
            "at": F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        }
    )


def _object(raw: DataFrame, gap: str = "") -> Column:
    """JSON object of a record; small values give broken, nested and escaped ones."""
    value = F.col("value")
    k = F.when((value >= 2) & (value < 3), '{"nested": 1}').otherwise(F.concat(F.lit('"'), F.col("k"), F.lit('"')))
    message = F.when((value >= 3) & (value < 4), F.concat(F.lit("\\u0020"), F.col("message"), F.lit("\\t"))).otherwise(
        F.col("message")
    )
    parts = [
        '{"timestamp":"', F.col("at"), f'",{gap} "level":"', F.col("level"), '", "source":"', F.col("source"),
        f'",{gap} "message":"', message, '", "k": ', k, ', "volatile.event_id":', F.col("event_id").cast("string"),
    ]
    closing = F.when(value < 2, F.lit("")).otherwise(F.lit("}"))
    return F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts], closing)


def _write(rows: DataFrame, path: str) -> None:
    """One text file per (day, part), lines in event order."""
    arranged = rows.repartition("day", "part").sortWithinPartitions("day", "part", "ord")
    arranged.select("day", "part", "text").write.partitionBy("day", "part").text(path)


def _written(spark: SparkSession, folder: str, kind: str, build) -> str:
    """Log files of the test events, written once per application."""
    key = (spark.sparkContext.applicationId, folder, kind)
    if key not in _WRITTEN:
        path = scratch_path(spark, f"logs-{kind}")
        _write(build(_raw(spark, folder)).select("day", "part", "ord", "text"), path)
        _WRITTEN[key] = path
    return f"{_WRITTEN[key]}/*/*/"


def jsonl_source(spark: SparkSession, folder: str, name: str = "events") -> LogSource:
    rows = lambda raw: raw.withColumns({"ord": F.col("event_id"), "text": _object(raw)})
    return LogSource(name, _written(spark, folder, "jsonl", rows), "jsonl")


def multiline_source(spark: SparkSession, folder: str) -> LogSource:
    """Each record takes three lines, broken ones take six, which is more than allowed."""

    def rows(raw: DataFrame) -> DataFrame:
        text = _object(raw, "\n")
        text = F.when(F.col("value") < 2, F.concat(text, F.lit(",\n \n\n \"x\":1,\n \"y\":2,\n \"z\":3"))).otherwise(text)
        return raw.withColumns({"ord": F.col("event_id"), "text": text})

    setting = Multiline(enabled=True, continue_space=True, max_lines=4)
    return LogSource("events", _written(spark, folder, "multiline", rows), "jsonl", multiline=setting)


HEADER = 'timestamp, level ,source,"message",k,volatile.event_id'


def csv_source(spark: SparkSession, folder: str) -> LogSource:
    """Quoted messages, some over two lines; small values give stray quotes and extra columns."""

    def rows(raw: DataFrame) -> DataFrame:
        value = F.col("value")
        level = F.when(value < 2, F.concat(F.lit('x"'), F.col("level"))).otherwise(F.col("level"))
        message = F.when(
            (value >= 3) & (value < 4), F.concat(F.lit('"\n'), F.col("message"), F.lit(' \r\n\n"'))
        ).otherwise(F.concat(F.lit('"'), F.col("message"), F.lit('"')))
        extra = F.when((value >= 2) & (value < 3), F.lit(',"a ""quoted"" one"')).otherwise("")
        event = F.col("event_id").cast("string")
        text = F.concat(F.concat_ws(",", "at", level, "source", message, "k", event), extra)
        lines = raw.withColumns({"ord": F.col("event_id"), "text": text})
        heads = raw.select("day", "part").distinct().withColumns(
            {"ord": F.lit(-1).cast("bigint"), "text": F.lit(HEADER)}
        )
        return lines.select("day", "part", "ord", "text").unionByName(heads)

    return LogSource("events", _written(spark, folder, "csv", rows), "csv")


def _from_file(rows: DataFrame) -> DataFrame:
    return rows.withColumn("day", F.regexp_extract("file", r"day=(\d{4}-\d{2}-\d{2})", 1))


def _event_columns(tagged: DataFrame) -> DataFrame:
    return _from_file(good(tagged)).select("id", "fingerprint", "line", "day", "timestamp", "level", "source", "message")


_DAY = "strftime(ts, '%Y-%m-%d')"
_ORDER = f"OVER (PARTITION BY {_DAY}, event_id // {FILE_ROWS} ORDER BY event_id)"
_COLUMNS = f"id, fingerprint, {_DAY} AS day, ts AS timestamp, level, source, message"
_PLAIN_LINE = f", numbered AS (SELECT *, row_number() {_ORDER} AS place FROM ev)"


@query("src_jsonl", EV + _PLAIN_LINE + f"SELECT {_COLUMNS}, place AS line FROM numbered WHERE value >= 3")
def src_jsonl(spark, folder):
    return _event_columns(tagged_source(spark, jsonl_source(spark, folder), NOW))


@query(
    "ingest_rejected",
    EV
    + _PLAIN_LINE
    + f"""SELECT {_DAY} AS day, place AS line, 'events' AS input, CASE WHEN value < 2 THEN 'invalid_json'
      ELSE 'field "k": expected scalar, got map[string]interface {{}}' END AS reason FROM numbered WHERE value < 3""",
)
def ingest_rejected(spark, folder):
    tagged = tagged_source(spark, jsonl_source(spark, folder), NOW)
    bad = _from_file(tagged.filter(F.col("reason").isNotNull()))
    return bad.select("day", "line", "input", "reason")


@query(
    "src_line_numbers",
    f"SELECT {_DAY} AS day, row_number() {_ORDER} AS line, event_id::VARCHAR AS event_id FROM events",
)
def src_line_numbers(spark, folder):
    lines = _from_file(read_lines(spark, jsonl_source(spark, folder).path))
    event = F.regexp_extract("text", r'"volatile\.event_id":([0-9]+)', 1)
    return lines.select("day", "line", event.alias("event_id"))


@query(
    "src_multiline",
    EV
    + f""", sized AS (SELECT *, CASE WHEN value < 2 THEN 8 ELSE 3 END AS height FROM ev),
    placed AS (SELECT *, (sum(height) {_ORDER})::BIGINT - height + 1 AS place FROM sized)
    SELECT {_COLUMNS}, place AS line, NULL::VARCHAR AS reason FROM placed WHERE value >= 3
    UNION ALL SELECT NULL, NULL, {_DAY}, NULL, NULL, NULL, NULL, place,
      'field "k": expected scalar, got map[string]interface {{}}' FROM placed WHERE value >= 2 AND value < 3
    UNION ALL SELECT NULL, NULL, {_DAY}, NULL, NULL, NULL, NULL, place, 'multiline record exceeds max_lines'
      FROM placed WHERE value < 2
    UNION ALL SELECT NULL, NULL, {_DAY}, NULL, NULL, NULL, NULL, place + 6, 'invalid_json' FROM placed WHERE value < 2""",
)
def src_multiline(spark, folder):
    tagged = _from_file(tagged_source(spark, multiline_source(spark, folder), NOW))
    fine = F.col("reason").isNull()
    shown = ["timestamp", "level", "source", "message"]
    kept = {name: F.when(fine, F.col(name)) for name in shown}
    return tagged.withColumns(kept).select("id", "fingerprint", "day", *shown, "line", "reason")


@query(
    "src_csv",
    EV
    + f""", placed AS (SELECT *, row_number() {_ORDER} + 1 AS place FROM ev)
    SELECT {_COLUMNS}, place AS line FROM placed WHERE value >= 3""",
)
def src_csv(spark, folder):
    return _event_columns(tagged_source(spark, csv_source(spark, folder), NOW))


@query(
    "src_csv_rejected",
    EV
    + f""", placed AS (SELECT *, row_number() {_ORDER} + 1 AS place FROM ev)
    SELECT {_DAY} AS day, place AS line, CASE WHEN value < 2 THEN 'malformed_csv' ELSE 'expected 6 columns, got 7' END AS reason,
      CASE WHEN value < 2 THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || ',' || raw_level || ', Svc ' || (
        SELECT user_id % 12 FROM events e WHERE e.event_id = placed.event_id) || ' ,' || message || ',' || k || ','
        || event_id || ',a "quoted" one' END AS raw
    FROM (SELECT placed.*, r.raw_level FROM placed JOIN ev_raw r USING (event_id)) AS placed WHERE value < 3""",
)
def src_csv_rejected(spark, folder):
    tagged = tagged_source(spark, csv_source(spark, folder), NOW)
    bad = _from_file(tagged.filter(F.col("reason").isNotNull()))
    return bad.select("day", "line", "reason", "raw")


@query(
    "src_json",
    EV + "SELECT id, fingerprint, (event_id // 500)::VARCHAR AS file, event_id % 500 + 1 AS line FROM ev WHERE value >= 3",
)
def src_json(spark, folder):
    """Files that are arrays of up to 500 records, without one line break that could part them."""

    def rows(raw: DataFrame) -> DataFrame:
        # A broken record would spoil its whole document; here it only lacks its message.
        body = F.when(F.col("value") < 2, F.concat(F.lit('{"timestamp":"'), F.col("at"), F.lit('"}'))).otherwise(_object(raw))
        placed = raw.select(F.floor(F.col("event_id") / 500).cast("bigint").alias("part"), "event_id", body.alias("body"))
        items = F.sort_array(F.collect_list(F.struct("event_id", "body")))
        array = F.concat(F.lit(" ["), F.array_join(F.transform(items, lambda item: item["body"]), " , "), F.lit("]"))
        return placed.groupBy("part").agg(array.alias("text")).select(F.lit("all").alias("day"), "part", F.lit(0).cast("bigint").alias("ord"), "text")

    source = LogSource("events", _written(spark, folder, "json", rows), "json")
    tagged = tagged_source(spark, source, NOW).withColumn("file", F.regexp_extract("file", r"part=(\d+)", 1))
    return good(tagged).select("id", "fingerprint", "file", "line")


@query(
    "ingest_normalize",
    f"""WITH r AS (SELECT doc_id, text, lang, source FROM documents),
    c AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'missing timestamp field "timestamp"'
        WHEN lang = 'de' THEN 'timestamp "someday" matches no configured layout'
        WHEN source <> 'web' AND {LEVEL_CASE.format('source')} IS NULL THEN 'unknown level "' || source || '"'
        WHEN trim(regexp_replace(lower(source), '[^a-z0-9._]+', '-', 'g'), '-') = '' THEN 'normalized source is empty'
        WHEN regexp_full_match(text, '[\\s\\p{{Z}}]*') THEN 'message is empty' END AS reason FROM r)
    SELECT doc_id, reason FROM c""",
)
def ingest_normalize(spark, folder):
    """Documents as records without a usable time or level, to see which check speaks first."""
    docs = adapter.table(spark, folder, "documents")
    entry = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    pairs = F.array(
        F.when(
            F.col("lang") != "en",
            F.struct(
                F.lit("timestamp").alias("k"),
                entry("string", F.when(F.col("lang") == "de", "someday").otherwise("2024-01-01 00:00:00")).alias("v"),
            ),
        ),
        F.struct(
            F.lit("level").alias("k"),
            entry("string", F.when(F.col("source") == "web", "info").otherwise(F.col("source"))).alias("v"),
        ),
        F.struct(F.lit("source").alias("k"), entry("string", F.col("source")).alias("v")),
        F.struct(F.lit("message").alias("k"), entry("string", F.col("text")).alias("v")),
        F.struct(F.lit("doc_id").alias("k"), entry("number", F.col("doc_id").cast("string")).alias("v")),
    )
    records = docs.select(
        F.col("doc_id").alias("line"),
        F.col("text").alias("raw"),
        F.lit("documents").alias("file"),
        F.lit(0).alias("joined"),
        F.map_from_entries(F.array_compact(pairs)).alias("record"),
        F.lit(None).cast("string").alias("error"),
    )
    tagged = normalize(records, LogSource("documents", "documents", "jsonl"), NOW)
    return tagged.select(F.col("line").alias("doc_id"), "reason")



_BOTH = f"""a AS (SELECT *, 0 AS ord FROM ev WHERE value >= 3),
    kept AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY {_DAY}, event_id // {FILE_ROWS},
      event_id) = 1)"""


_AT = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"
_JSON_BYTES = f"""strlen('{{"timestamp":"' || {_AT} || '", "level":"' || raw_level || '", "source":"' || raw_source || '", "message":"' ||
      CASE WHEN value >= 3 AND value < 4 THEN '\\u0020' || raw_message || '\\t' ELSE raw_message END || '", "k": ' ||
      CASE WHEN value >= 2 AND value < 3 THEN '{{"nested": 1}}' ELSE '"' || k || '"' END || ', "volatile.event_id":' || event_id ||
      CASE WHEN value < 2 THEN '' ELSE '}}' END) + 1"""
_CSV_BYTES = f"""strlen({_AT} || ',' || CASE WHEN value < 2 THEN 'x"' ELSE '' END || raw_level || ',' || raw_source || ',"' || raw_message ||
      '",' || k || ',' || event_id || CASE WHEN value >= 2 AND value < 3 THEN ',"a ""quoted"" one"' ELSE '' END) +
      CASE WHEN value >= 3 AND value < 4 THEN 5 ELSE 0 END + 1"""


@query(
    "ingest_stats",
    EV
    + f""", {_BOTH}, files AS (SELECT count(DISTINCT {_DAY} || '/' || (event_id // {FILE_ROWS})) AS files FROM ev)
    SELECT 'events' AS input, (SELECT files FROM files) AS files,
      (SELECT count(*) FROM ev) AS lines, count(*) AS records, (SELECT count(*) FROM ev WHERE value < 3) AS rejected,
      0::BIGINT AS multiline_joined, (SELECT count(*) FROM a) - count(*) AS duplicates,
      (SELECT sum({_JSON_BYTES})::BIGINT FROM ev_raw) AS bytes, min(ts) AS first, max(ts) AS last
    FROM kept
    UNION ALL
    SELECT 'sheets', (SELECT files FROM files), (SELECT count(*) FROM ev) + (SELECT files FROM files), 0,
      (SELECT count(*) FROM ev WHERE value < 3), 0, (SELECT count(*) FROM a),
      (SELECT sum({_CSV_BYTES})::BIGINT FROM ev_raw) + (SELECT files FROM files) * {len(HEADER) + 1}, NULL, NULL""",
)
def ingest_stats(spark, folder):
    """Two sources with the same events: all of the second are duplicates."""
    return _ingest_both(spark, folder).stats


@query(
    "src_union",
    EV + f", {_BOTH} SELECT id, fingerprint, 'events' AS input, ts AS timestamp FROM kept",
)
def src_union(spark, folder):
    return _ingest_both(spark, folder).events.select("id", "fingerprint", "input", "timestamp")


def _ingest_both(spark: SparkSession, folder: str):
    first, second = jsonl_source(spark, folder), csv_source(spark, folder)
    sheets = LogSource("sheets", second.path, "csv")
    unused = LogSource("unused", "nowhere", "json")
    return ingest(spark, [first, unused, sheets], NOW, names=["sheets", "events"])


@query("ingest_quarantine", EV + "SELECT count(*) AS rejected, count(DISTINCT line) AS places FROM ev WHERE value < 3")
def ingest_quarantine(spark, folder):
    """Rejected table of a source whose lines carry their event number in the raw text."""
    bad = rejections(tagged_source(spark, jsonl_source(spark, folder), NOW))
    event = F.regexp_extract("raw", r'"volatile\.event_id":([0-9]+)', 1)
    return bad.agg(F.count("*").alias("rejected"), F.count_distinct(event).alias("places"))


@query("scan_events", EV + "SELECT id, ts AS timestamp, level, source, message, fingerprint, line FROM ev")
def scan_events(spark, folder):
    """Events saved as a table and loaded with row checks."""
    path = scratch_path(spark, "events")
    sinks.save_events(adapter.events(spark, folder), path)
    return load_events(spark, path).select("id", "timestamp", "level", "source", "message", "fingerprint", "line")
