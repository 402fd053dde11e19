"""Queries over single events: functions, predicates, filters, dedup, aggregates, reports."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from timberflow.functions import (
    canonical_message,
    field_value,
    fields_text,
    group_key,
    hash_strings,
    level_name,
    level_ordinal,
    normalize_message,
    normalize_source,
    parse_level,
    percent,
    rfc3339,
    stable_id,
    time_bucket,
    with_epoch,
    with_timestamp,
)
from timberflow.functions.compare import compare_text
from timberflow.operators import aggregates, dedup, filters, quality, reports
from timberflow.operators.keys import KeyTable
from timberflow.operators.predicates import match_rules, predicate_column, rule_column
from timberflow.plans import adapter
from timberflow.plans.catalog import query
from timberflow.plans.oracle import (
    EV,
    LEVEL_CASE,
    ORDINAL_CASE,
    bucket,
    canonical,
    events_cte,
    frame,
    frames,
    rfc3339 as rfc3339_sql,
    source_name,
)
from timberflow.session import scratch_path
from timberflow.settings import Predicate, Rule, duration_nanos

HOUR = duration_nanos("1h")


# --- scalar functions -------------------------------------------------------------------------------------


@query("fn_parse_level", EV + f"SELECT event_id, {LEVEL_CASE.format('raw_level')} AS level FROM ev_raw")
def fn_parse_level(spark, folder):
    raw = adapter.raw_records(spark, folder)
    return raw.select("event_id", parse_level(F.col("level")).alias("level"))


@query(
    "fn_level_ordinal",
    EV + f"SELECT event_id, {ORDINAL_CASE.format('level')} AS ordinal, level AS name FROM ev_norm",
)
def fn_level_ordinal(spark, folder):
    raw = adapter.raw_records(spark, folder)
    ordinal = level_ordinal(parse_level(F.col("level")))
    return raw.select("event_id", ordinal.alias("ordinal"), level_name(ordinal).alias("name"))


@query(
    "fn_normalize_source",
    f"SELECT doc_id, {source_name('source')} AS source, {source_name('lang || source')} AS mixed FROM documents",
)
def fn_normalize_source(spark, folder):
    docs = adapter.table(spark, folder, "documents")
    mixed = normalize_source(F.concat("lang", "source"))
    return docs.select("doc_id", normalize_source(F.col("source")).alias("source"), mixed.alias("mixed"))


_SPACE = r"[\s\x0B\x{85}\p{Z}]"
_LF_ONLY = r"regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g')"
_NORMAL = f"regexp_replace(regexp_replace({_LF_ONLY}, '{_SPACE}+$', ''), '^{_SPACE}+', '')"


@query("fn_normalize_message", f"SELECT doc_id, {_NORMAL} AS message FROM documents")
def fn_normalize_message(spark, folder):
    docs = adapter.table(spark, folder, "documents")
    return docs.select("doc_id", normalize_message(F.col("text")).alias("message"))


@query("fn_canonical_message", EV + f"SELECT event_id, {canonical('message')} AS canonical FROM ev_norm")
def fn_canonical_message(spark, folder):
    raw = adapter.raw_records(spark, folder)
    return raw.select("event_id", canonical_message(normalize_message(F.col("message"))).alias("canonical"))


@query(
    "fn_hash_strings",
    f"SELECT doc_id, sha256({frames('text', 'lang', 'source')}) AS hash FROM documents",
)
def fn_hash_strings(spark, folder):
    docs = adapter.table(spark, folder, "documents")
    return docs.select("doc_id", hash_strings(F.col("text"), F.col("lang"), F.col("source")).alias("hash"))


@query("fn_fingerprint", EV + "SELECT line, fingerprint FROM ev")
def fn_fingerprint(spark, folder):
    return adapter.events(spark, folder).select("line", "fingerprint")


@query(
    "fn_stable_id",
    f"SELECT doc_id, substr(sha256({frame(chr(39) + 'document' + chr(39))} || {frame('text')}), 1, 24) AS id FROM documents",
)
def fn_stable_id(spark, folder):
    docs = adapter.table(spark, folder, "documents")
    return docs.select("doc_id", stable_id("document", F.col("text")).alias("id"))


@query("fn_event_id", EV + "SELECT line, id FROM ev")
def fn_event_id(spark, folder):
    return adapter.events(spark, folder).select("line", "id")


@query(
    "fn_parse_timestamp",
    """SELECT event_id, epoch_us(ts) AS us, ts AS parsed, 'string' AS kind FROM events
    UNION ALL SELECT event_id, epoch_us(ts) // 1000000 * 1000000, date_trunc('second', ts), 'number' FROM events
    UNION ALL SELECT event_id, epoch_us(ts) // 1000000 * 1000000, date_trunc('second', ts), 'plain' FROM events""",
)
def fn_parse_timestamp(spark, folder):
    """Times written as RFC 3339 text with an offset, as epoch milliseconds and as plain date and time."""
    events = adapter.table(spark, folder, "events")
    shifted = F.date_format(F.col("ts") + F.expr("INTERVAL 5 HOURS 30 MINUTES"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    forms = F.array(
        F.struct(F.lit("string").alias("kind"), F.concat(shifted, F.lit("+05:30")).alias("text")),
        F.struct(
            F.lit("number").alias("kind"), F.floor(F.unix_micros("ts") / 1000).cast("bigint").cast("string").alias("text")
        ),
        F.struct(F.lit("plain").alias("kind"), F.date_format("ts", " yyyy-MM-dd HH:mm:ss ").alias("text")),
    )
    exploded = events.select("event_id", F.explode(forms).alias("form")).select("event_id", "form.*")
    kind = F.when(F.col("kind") == "plain", "string").otherwise(F.col("kind"))
    layouts = ("2006-01-02T15:04:05.999999999Z07:00", "2006-01-02 15:04:05")
    parsed = with_timestamp(exploded, kind, F.col("text"), layouts, "at")
    return parsed.select("event_id", F.col("at.us").alias("us"), F.timestamp_micros("at.us").alias("parsed"), "kind")


@query(
    "fn_parse_epoch",
    """SELECT event_id, unit, CASE unit WHEN 's' THEN epoch_us(ts) // 1000000 * 1000000
      ELSE epoch_us(ts) // 1000000 * 1000000 END AS us, epoch_us(ts) // 1000000 * 1000000
      + CASE unit WHEN 's' THEN 0 WHEN 'ms' THEN epoch_us(ts) % 1000000 // 1000 * 1000 ELSE epoch_us(ts) % 1000000 END
      AS precise_ms FROM events, (VALUES ('s'), ('ms'), ('us')) AS units(unit)""",
)
def fn_parse_epoch(spark, folder):
    """Epoch seconds, milliseconds and microseconds, with the part below a second dropped and kept."""
    events = adapter.table(spark, folder, "events").withColumn("micros", F.unix_micros("ts"))
    units = [("s", 1_000_000), ("ms", 1_000), ("us", 1)]
    forms = F.array(
        *[
            F.struct(F.lit(unit).alias("unit"), F.floor(F.col("micros") / size).cast("bigint").cast("string").alias("text"))
            for unit, size in units
        ]
    )
    exploded = events.select("event_id", F.explode(forms).alias("form")).select("event_id", "form.*")
    parsed = with_epoch(with_epoch(exploded, F.col("text"), "at"), F.col("text"), "exact", precise=True)
    # The kept part comes from a double, so it is exact to the microsecond after rounding.
    exact = F.col("exact.us") + F.when(F.col("exact.nanos") >= 500, 1).otherwise(0)
    return parsed.select("event_id", "unit", F.col("at.us").alias("us"), exact.alias("precise_ms"))


@query("fn_rfc3339", f"SELECT event_id, {rfc3339_sql('ts')} AS text FROM events")
def fn_rfc3339(spark, folder):
    return adapter.table(spark, folder, "events").select("event_id", rfc3339(F.col("ts")).alias("text"))


@query(
    "fn_time_bucket",
    f"SELECT event_id, {bucket('ts', 3600)} AS hour, {bucket('ts', 604800)} AS week, {bucket('ts', 420)} AS odd FROM events",
)
def fn_time_bucket(spark, folder):
    ts = F.col("ts")
    return adapter.table(spark, folder, "events").select(
        "event_id",
        time_bucket(ts, HOUR).alias("hour"),
        time_bucket(ts, 7 * 24 * HOUR).alias("week"),
        time_bucket(ts, duration_nanos("7m")).alias("odd"),
    )


@query(
    "fn_field",
    EV
    + f"SELECT line AS event_line, k AS exact, k AS folded, (line - 1)::VARCHAR AS volatile, NULL::VARCHAR AS absent, "
    f"{rfc3339_sql('ts')} AS at, line::VARCHAR AS line_text FROM ev",
)
def fn_field(spark, folder):
    return adapter.events(spark, folder).select(
        F.col("line").alias("event_line"),
        field_value("k").alias("exact"),
        field_value("K").alias("folded"),
        field_value("Volatile.Event_ID").alias("volatile"),
        field_value("nothing").alias("absent"),
        field_value("Time").alias("at"),
        field_value("LINE").alias("line_text"),
    )


@query(
    "fn_group_key",
    EV + "SELECT line, 'source=' || source || '|K=' || k || '|host=<missing>' AS grp, 'all' AS everything FROM ev",
)
def fn_group_key(spark, folder):
    keys = group_key(["source", "K", "host"])
    return adapter.events(spark, folder).select("line", keys.alias("grp"), group_key([]).alias("everything"))


@query(
    "fn_compare",
    EV
    + """SELECT line, CASE WHEN k::DOUBLE < 40 THEN -1 WHEN k::DOUBLE > 40 THEN 1 ELSE 0 END AS as_number,
    CASE WHEN ts < '2024-01-15' THEN -1 WHEN ts > '2024-01-15' THEN 1 ELSE 0 END AS as_time,
    CASE WHEN source < 'svc-3' THEN -1 WHEN source > 'svc-3' THEN 1 ELSE 0 END AS as_text FROM ev""",
)
def fn_compare(spark, folder):
    return adapter.events(spark, folder).select(
        "line",
        compare_text(field_value("k"), "4e1").alias("as_number"),
        compare_text(field_value("time"), "2024-01-15T02:00:00+02:00").alias("as_time"),
        compare_text(field_value("source"), "svc-3").alias("as_text"),
    )


@query(
    "fn_percent",
    """WITH c AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS part, count(*) AS total
      FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, part, total, printf('%.1f%%', part::DOUBLE * 100.0 / total::DOUBLE) AS share FROM c""",
)
def fn_percent(spark, folder):
    lines = adapter.table(spark, folder, "lineitem").groupBy("l_orderkey")
    counted = lines.agg(F.count_if(F.col("l_returnflag") == "R").alias("part"), F.count("*").alias("total"))
    return counted.withColumn("share", percent(F.col("part"), F.col("total")))


@query("fn_fields_text", EV + "SELECT line, 'k=' || k || ';volatile.event_id=' || (line - 1) AS text FROM ev")
def fn_fields_text(spark, folder):
    return adapter.events(spark, folder).select("line", fields_text(F.col("fields")).alias("text"))


@query("fields_static", EV + "SELECT line, 'env=test;k=fixed;volatile.event_id=' || (line - 1) AS text FROM ev")
def fields_static(spark, folder):
    from timberflow.sources.normalize import merge_static

    merged = merge_static(F.col("fields"), {"env": "test", "k": "fixed"})
    return adapter.events(spark, folder).select("line", fields_text(merged).alias("text"))


# --- predicates -------------------------------------------------------------------------------------------


def _predicate(name, test_sql, *predicates):
    """Query that keeps the events each predicate holds for; one column per predicate."""
    columns = ", ".join(f"({test}) AS p{i}" for i, test in enumerate(test_sql))

    @query(name, EV + f"SELECT line, {columns} FROM ev")
    def run(spark, folder):
        tests = [predicate_column(predicate).alias(f"p{i}") for i, predicate in enumerate(predicates)]
        return adapter.events(spark, folder).select("line", *tests)

    return run


_predicate(
    "pred_exists",
    ["true", "false", "true", "false"],
    Predicate("k", "exists"),
    Predicate("host", "exists", "true"),
    Predicate("host", "exists", "False"),
    Predicate("K", "exists", "false"),
)
_predicate(
    "pred_eq",
    ["source = 'svc-3'", "level = 'ERROR'", "k = '42'", "false"],
    Predicate("source", "eq", "SVC-3"),
    Predicate("level", "eq", "error"),
    Predicate("K", "eq", "42"),
    Predicate("host", "eq", "x"),
)
_predicate(
    "pred_ne",
    ["source <> 'svc-3'", "true"],
    Predicate("source", "ne", "SVC-3"),
    Predicate("host", "ne", "x"),
)
_predicate(
    "pred_contains",
    ["contains(lower(message), 'value (3')", "contains(k, '7')"],
    Predicate("message", "contains", "VALUE (3"),
    Predicate("k", "contains", "7"),
)
_predicate(
    "pred_prefix",
    ["starts_with(lower(message), 'click')", "starts_with(k, '1')"],
    Predicate("message", "prefix", "Click"),
    Predicate("k", "prefix", "1"),
)
_predicate(
    "pred_suffix",
    ["ends_with(lower(message), 'user 7')", "ends_with(k, '9')"],
    Predicate("message", "suffix", "USER 7"),
    Predicate("k", "suffix", "9"),
)
_predicate(
    "pred_regex",
    ["regexp_matches(message, '^(?:click|view) value \\([0-9]+\\)')", "regexp_matches(k, '^[[:digit:]]$')"],
    Predicate("message", "regex", r"^(?P<kind>click|view) value \([0-9]+\)"),
    Predicate("k", "regex", "^[[:digit:]]$"),
)
_predicate(
    "pred_in",
    ["source IN ('svc-1', 'svc-4')", "false"],
    Predicate("source", "in", values=["SVC-1", "svc-4"]),
    Predicate("host", "in", values=["", "a"]),
)
_predicate(
    "pred_compare",
    [
        "level IN ('WARN', 'ERROR', 'FATAL')",
        "k::DOUBLE > 50",
        "k::DOUBLE <= 7.5",
        "ts < '2024-01-10 12:00:00'",
        "source >= 'svc-5'",
        "false",
    ],
    Predicate("level", "gte", "warning"),
    Predicate("k", "gt", "50"),
    Predicate("k", "lte", "7.5"),
    Predicate("timestamp", "lt", "2024-01-10T12:00:00Z"),
    Predicate("source", "gte", "svc-5"),
    Predicate("host", "lt", "5"),
)
_predicate(
    "pred_negate",
    ["true", "k::DOUBLE <= 50", "source <> 'svc-3'"],
    Predicate("host", "gt", "5", negate=True),
    Predicate("k", "gt", "50", negate=True),
    Predicate("source", "eq", "svc-3", negate=True),
)

_RULE = Rule(
    "mixed",
    all=[Predicate("level", "gte", "INFO"), Predicate("k", "lt", "60")],
    any=[Predicate("message", "prefix", "click"), Predicate("source", "in", values=["svc-2"])],
)
_RULE_SQL = (
    "level IN ('INFO', 'WARN', 'ERROR', 'FATAL') AND k::DOUBLE < 60 "
    "AND (starts_with(message, 'click') OR source = 'svc-2')"
)


@query("rule_match", EV + f"SELECT id, line FROM ev WHERE {_RULE_SQL}")
def rule_match(spark, folder):
    return adapter.events(spark, folder).filter(rule_column(_RULE)).select("id", "line")


@query(
    "rules_multi",
    EV
    + f"""SELECT 'mixed' AS rule_id, 'all' AS grp, line FROM ev WHERE {_RULE_SQL}
    UNION ALL SELECT 'errors', 'source=' || source || '|k=' || k, line FROM ev WHERE level IN ('ERROR', 'FATAL')
    UNION ALL SELECT 'every', 'level=' || level, line FROM ev""",
)
def rules_multi(spark, folder):
    rules = [
        _RULE,
        Rule("errors", all=[Predicate("level", "gte", "ERROR")], group_by=["source", "k"]),
        Rule("every", group_by=["level"]),
        Rule("off", enabled=False),
    ]
    return match_rules(adapter.events(spark, folder), rules).select("rule_id", "grp", "line")


# --- filters ----------------------------------------------------------------------------------------------

_SLIM = ["id", "timestamp", "level", "source", "message"]
_SLIM_SQL = "id, ts AS timestamp, level, source, message"


def _filter(name, where, terms):
    @query(name, EV + f"SELECT {_SLIM_SQL} FROM ev WHERE {where}")
    def run(spark, folder):
        return filters.matching(adapter.events(spark, folder), terms).select(*_SLIM)

    return run


_filter(
    "q_time_range",
    "ts >= '2024-01-08' AND ts <= '2024-01-30'",
    filters.EventFilter(since="2024-01-08", until="-24h", now=datetime(2024, 1, 31, tzinfo=timezone.utc)),
)
_filter("q_min_level", "level IN ('WARN', 'ERROR', 'FATAL')", filters.EventFilter(min_level="warning"))
_filter("q_sources", "source IN ('svc-1', 'svc-10')", filters.EventFilter(sources=["Svc 1", " svc!10 ", ""]))
_filter(
    "q_contains",
    "contains(lower(message || ' ' || source), 'user 7 svc')",
    filters.EventFilter(contains="USER 7 Svc"),
)
_filter("q_field", "k = '42'", filters.EventFilter(fields={"K": "42"}))


@query(
    "q_order",
    EV + f"SELECT {_SLIM_SQL} FROM ev WHERE level IN ('ERROR', 'FATAL') ORDER BY ts DESC, id DESC",
)
def q_order(spark, folder):
    terms = filters.EventFilter(min_level="ERROR", descending=True)
    return filters.query_events(adapter.events(spark, folder), terms).select(*_SLIM)


@query("q_page", EV + f"SELECT {_SLIM_SQL} FROM ev WHERE level <> 'DEBUG' ORDER BY ts, id LIMIT 100 OFFSET 50")
def q_page(spark, folder):
    """A page of 100 rows; the limit is the feature."""
    terms = filters.EventFilter(min_level="INFO", offset=50, limit=100)
    return filters.query_events(adapter.events(spark, folder), terms).select(*_SLIM)


@query(
    "q_stats",
    EV
    + """, m AS (SELECT count(*) AS scanned, count(*) FILTER (WHERE level IN ('ERROR', 'FATAL') AND source = 'svc-1')
      AS matched FROM ev)
    SELECT scanned, matched, least(greatest(matched - 5, 0), 20)::BIGINT AS returned,
      matched > 5 + least(greatest(matched - 5, 0), 20) AS truncated FROM m""",
)
def q_stats(spark, folder):
    terms = filters.EventFilter(min_level="ERROR", sources=["svc-1"], offset=5, limit=20)
    return filters.query_counters(adapter.events(spark, folder), terms)


@query(
    "q_by_id",
    EV + f"SELECT {_SLIM_SQL} FROM ev WHERE id = (SELECT min(id) FROM ev)",
)
def q_by_id(spark, folder):
    events = adapter.events(spark, folder)
    wanted = events.agg(F.min("id")).first()[0]
    return filters.by_id(events, wanted).select(*_SLIM)


@query("q_index_projection", EV + "SELECT ts AS time, id, source, level, fingerprint FROM ev")
def q_index_projection(spark, folder):
    return dedup.event_index(adapter.events(spark, folder))


@query(
    "q_listing",
    EV + f"SELECT {rfc3339_sql('ts')} AS time, level, source, replace(message, chr(10), '\\n') AS message, id FROM ev",
)
def q_listing(spark, folder):
    return filters.event_listing(adapter.events(spark, folder))


# --- dedup and set operations -----------------------------------------------------------------------------

_FIRST_LINE = "row_number() OVER (PARTITION BY fingerprint ORDER BY line) = 1"
_FIRST_TIME = "row_number() OVER (PARTITION BY fingerprint ORDER BY ts, id) = 1"


@query("dedup_first", EV + f"SELECT line, id, fingerprint FROM ev QUALIFY {_FIRST_LINE}")
def dedup_first(spark, folder):
    return dedup.dedup_first(adapter.events(spark, folder)).select("line", "id", "fingerprint")


_HALF = "2024-01-16"


@query(
    "append_new",
    EV
    + f""", old AS (SELECT * FROM ev WHERE ts < '{_HALF}')
    SELECT line, id, fingerprint FROM ev WHERE ts >= '2024-01-10'
      AND fingerprint NOT IN (SELECT fingerprint FROM old) QUALIFY {_FIRST_TIME}""",
)
def append_new(spark, folder):
    """Stored events up to the middle of the month, additions that overlap them by days."""
    events = adapter.events(spark, folder)
    stored = events.filter(F.col("timestamp") < F.lit(_HALF).cast("timestamp"))
    added = events.filter(F.col("timestamp") >= F.lit("2024-01-10").cast("timestamp"))
    return dedup.append_new(stored, added).select("line", "id", "fingerprint")


@query(
    "append_keyed",
    EV
    + f""", old AS (SELECT * FROM ev WHERE ts < '{_HALF}' QUALIFY {_FIRST_TIME})
    SELECT line, id, fingerprint FROM ev WHERE ts >= '2024-01-10'
      AND fingerprint NOT IN (SELECT fingerprint FROM old) QUALIFY {_FIRST_TIME}""",
)
def append_keyed(spark, folder):
    """The same additions, appended in two steps against stored keys instead of the stored rows."""
    events = adapter.events(spark, folder)
    half, start = F.lit(_HALF).cast("timestamp"), F.lit("2024-01-10").cast("timestamp")
    table = KeyTable(spark, scratch_path(spark, "keyed"), [])
    table.add(table.new_rows(events.filter(F.col("timestamp") < half)), 1)
    table.active = [1]
    return table.new_rows(events.filter(F.col("timestamp") >= start)).select("line", "id", "fingerprint")


@query(
    "append_counts",
    EV
    + f""", old AS (SELECT * FROM ev WHERE ts < '{_HALF}'), fresh AS (SELECT * FROM ev WHERE ts >= '2024-01-10'
      AND fingerprint NOT IN (SELECT fingerprint FROM old) QUALIFY {_FIRST_TIME})
    SELECT (SELECT count(*) FROM fresh) AS added,
      (SELECT count(*) FROM ev WHERE ts >= '2024-01-10') - (SELECT count(*) FROM fresh) AS skipped""",
)
def append_counts(spark, folder):
    events = adapter.events(spark, folder)
    stored = events.filter(F.col("timestamp") < F.lit(_HALF).cast("timestamp"))
    added = events.filter(F.col("timestamp") >= F.lit("2024-01-10").cast("timestamp"))
    return dedup.append_counts(added, dedup.append_new(stored, added))


@query("dedup_merge", EV + f"SELECT line, id, fingerprint FROM ev QUALIFY {_FIRST_TIME}")
def dedup_merge(spark, folder):
    return dedup.merge_duplicates(adapter.events(spark, folder)).select("line", "id", "fingerprint")


@query(
    "dq_duplicate_ids",
    "WITH "
    + events_cte("evh", "date_trunc('hour', ts)")
    + "SELECT id, count(*) AS copies FROM evh GROUP BY id HAVING count(*) > 1",
)
def dq_duplicate_ids(spark, folder):
    return dedup.duplicate_ids(adapter.hourly_events(spark, folder))


@query(
    "index_mismatch",
    EV
    + """, a AS (SELECT *, row_number() OVER (ORDER BY ts, id) AS pos FROM ev),
    b AS (SELECT row_number() OVER (ORDER BY ts, id) AS pos, id, fingerprint FROM ev WHERE ts < '2024-01-29')
    SELECT pos, a.id AS event_id, a.fingerprint AS event_fingerprint, b.id AS index_id,
      b.fingerprint AS index_fingerprint FROM a FULL JOIN b USING (pos)
    WHERE a.id IS DISTINCT FROM b.id OR a.fingerprint IS DISTINCT FROM b.fingerprint""",
)
def index_mismatch(spark, folder):
    """Index that lacks the last days, so that its tail does not agree with the table."""
    events = adapter.events(spark, folder)
    stale = dedup.event_index(events.filter(F.col("timestamp") < F.lit("2024-01-29").cast("timestamp")))
    return dedup.index_mismatches(events, dedup.positioned_index(stale))


@query("partition_cutoff", EV + f"SELECT id, ts < '{_HALF}' AS expired FROM ev")
def partition_cutoff(spark, folder):
    events = adapter.events(spark, folder)
    return dedup.partition_by_cutoff(events, "timestamp", F.lit(_HALF).cast("timestamp")).select("id", "expired")


@query("unique_sources", EV + "SELECT DISTINCT source FROM ev")
def unique_sources(spark, folder):
    return dedup.unique_sources(adapter.events(spark, folder))


# --- aggregates -------------------------------------------------------------------------------------------

_SERIES = f"""SELECT {bucket('ts', 3600)} AS bucket, source, level, count(*) AS count,
      count(DISTINCT fingerprint) AS unique_fingerprints, min(ts) AS first, max(ts) AS last,
      sum(strlen(message))::BIGINT AS bytes FROM ev GROUP BY 1, 2, 3"""


@query("agg_series", EV + _SERIES)
def agg_series(spark, folder):
    return aggregates.metric_series(adapter.events(spark, folder), HOUR)


@query("agg_series_total", EV + "SELECT count(*) AS total FROM ev")
def agg_series_total(spark, folder):
    return aggregates.series_total(aggregates.metric_series(adapter.events(spark, folder)))


@query("agg_by_source", EV + "SELECT source, count(*) AS count FROM ev GROUP BY source")
def agg_by_source(spark, folder):
    return aggregates.by_source(adapter.events(spark, folder))


@query("agg_by_level", EV + "SELECT level, count(*) AS count FROM ev GROUP BY level")
def agg_by_level(spark, folder):
    return aggregates.by_level(adapter.events(spark, folder))


@query("agg_by_field", EV + "SELECT k AS value, count(*) AS count FROM ev GROUP BY k")
def agg_by_field(spark, folder):
    return aggregates.by_field(adapter.events(spark, folder), "K")


@query(
    "agg_rate",
    """WITH s AS (SELECT count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS span FROM events),
    t AS (SELECT n, greatest(span, 3600000000) AS us FROM s)
    SELECT n::DOUBLE / ((us // 1000000)::DOUBLE + ((us % 1000000) * 1000)::DOUBLE / 1e9) AS rate FROM t""",
)
def agg_rate(spark, folder):
    return aggregates.event_rate(adapter.events(spark, folder), HOUR)


_EDGES = aggregates.WORD_EDGES.replace("'", "''")


@query(
    "agg_search_terms",
    f"""WITH w AS (SELECT doc_id, trim(unnest(string_split_regex(lower(text), '{_SPACE}+')), '{_EDGES}') AS term
      FROM documents)
    SELECT term, count(DISTINCT doc_id) AS frequency FROM w WHERE strlen(term) >= 3 GROUP BY term
    HAVING count(DISTINCT doc_id) >= 5""",
)
def agg_search_terms(spark, folder):
    docs = adapter.table(spark, folder, "documents").select(F.col("text").alias("message"))
    return aggregates.search_terms(docs, 5)


# --- reports ----------------------------------------------------------------------------------------------


@query("report_levels", EV + "SELECT level AS name, count(*) AS count FROM ev GROUP BY level")
def report_levels(spark, folder):
    return reports.level_ranking(adapter.events(spark, folder))


@query(
    "report_sources",
    EV + "SELECT source AS name, count(*) AS count FROM ev GROUP BY source ORDER BY count(*) DESC, source LIMIT 10",
)
def report_sources(spark, folder):
    return reports.ranking(adapter.events(spark, folder), "source")


@query(
    "report_fingerprints",
    EV
    + "SELECT fingerprint AS name, count(*) AS count FROM ev GROUP BY fingerprint "
    "ORDER BY count(*) DESC, fingerprint LIMIT 10",
)
def report_fingerprints(spark, folder):
    return reports.ranking(adapter.events(spark, folder), "fingerprint")


@query("report_timeline", EV + f"SELECT {bucket('ts', 604800)} AS time, count(*) AS count FROM ev GROUP BY 1")
def report_timeline(spark, folder):
    return reports.timeline(adapter.events(spark, folder), aggregates.bucket_of("168h"))


# --- quality ----------------------------------------------------------------------------------------------


@query(
    "dq_events",
    EV
    + """, broken AS (SELECT line, CASE WHEN k = '0' THEN '' ELSE id END AS id,
      CASE WHEN k = '1' THEN ' ' ELSE source END AS source, CASE WHEN k IN ('0', '2') THEN '' ELSE message END AS message,
      CASE WHEN k = '3' THEN '' ELSE fingerprint END AS fingerprint, CASE WHEN k = '4' THEN 'LOUD' ELSE level END AS level
      FROM ev)
    SELECT line, CASE WHEN id = '' THEN 'event id is required' WHEN trim(source) = '' THEN 'event source is required'
      WHEN trim(message) = '' THEN 'event message is required' WHEN fingerprint = '' THEN 'event fingerprint is required'
      ELSE 'event level is invalid' END AS violation FROM broken
    WHERE id = '' OR trim(source) = '' OR trim(message) = '' OR fingerprint = '' OR level = 'LOUD'""",
)
def dq_events(spark, folder):
    """Events damaged by the value of a field, so that each check has rows to find."""
    events, k = adapter.events(spark, folder), F.col("fields")["k"]
    broken = events.withColumns(
        {
            "id": F.when(k == "0", "").otherwise(F.col("id")),
            "source": F.when(k == "1", " ").otherwise(F.col("source")),
            "message": F.when(k.isin("0", "2"), "").otherwise(F.col("message")),
            "fingerprint": F.when(k == "3", "").otherwise(F.col("fingerprint")),
            "level": F.when(k == "4", "LOUD").otherwise(F.col("level")),
        }
    )
    return quality.event_violations(broken).select("line", "violation")
