"""SQL building blocks: the adapter and the operators once more, written for a SQL engine."""

from __future__ import annotations

# Level names and aliases.
LEVEL_CASE = """CASE upper(trim({0}))
    WHEN 'TRACE' THEN 'TRACE' WHEN 'VERBOSE' THEN 'TRACE' WHEN 'DEBUG' THEN 'DEBUG'
    WHEN 'INFO' THEN 'INFO' WHEN 'INFORMATION' THEN 'INFO' WHEN 'NOTICE' THEN 'INFO'
    WHEN 'WARN' THEN 'WARN' WHEN 'WARNING' THEN 'WARN'
    WHEN 'ERROR' THEN 'ERROR' WHEN 'ERR' THEN 'ERROR' WHEN 'SEVERE' THEN 'ERROR'
    WHEN 'FATAL' THEN 'FATAL' WHEN 'CRITICAL' THEN 'FATAL' WHEN 'CRIT' THEN 'FATAL' WHEN 'PANIC' THEN 'FATAL' END"""

ORDINAL_CASE = """CASE {0} WHEN 'TRACE' THEN 0 WHEN 'DEBUG' THEN 1 WHEN 'INFO' THEN 2
    WHEN 'WARN' THEN 3 WHEN 'ERROR' THEN 4 WHEN 'FATAL' THEN 5 END"""

MESSAGE = "event_type || ' value (' || CAST(floor(value) AS BIGINT) || '), user ' || user_id"
RAW_LEVEL = """CASE event_type WHEN 'view' THEN 'debug' WHEN 'click' THEN 'Information' WHEN 'signup' THEN 'NOTICE'
    WHEN 'purchase' THEN 'warning' ELSE CASE WHEN value >= 40 THEN 'crit' ELSE 'err' END END"""


def frame(text: str) -> str:
    return f"strlen({text})::VARCHAR || ':' || ({text}) || chr(0)"


def frames(*texts: str) -> str:
    return " || ".join(frame(text) for text in texts)


def rfc3339(ts: str) -> str:
    micros = f"(epoch_us({ts}) % 1000000)"
    return (
        f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN {micros} = 0 THEN '' "
        f"ELSE '.' || rtrim(lpad({micros}::VARCHAR, 6, '0'), '0') END || 'Z')"
    )


def canonical(message: str) -> str:
    trimmed = "trim(t, '[](),;:')"
    return (
        f"array_to_string(list_transform(string_split_regex(trim(lower({message}), ' \t\n\r'), '\\s+'), "
        f"lambda t: CASE WHEN regexp_full_match({trimmed}, '[+-]?[0-9]+') AND try_cast({trimmed} AS BIGINT) IS NOT NULL "
        "THEN '#' ELSE t END), ' ')"
    )


def source_name(text: str) -> str:
    return f"trim(regexp_replace(lower(trim({text})), '[^a-z0-9._]+', '-', 'g'), '-')"


def bucket(ts: str, seconds: int) -> str:
    size = seconds * 1_000_000
    return f"make_timestamp(epoch_us({ts}) - (epoch_us({ts}) + 62135596800000000) % {size})"


def events_cte(name: str = "ev", ts: str = "ts") -> str:
    """CTEs ``<name>_raw`` .. ``<name>`` with the columns id, ts, level, source, message, k, fingerprint, line."""
    return f"""
{name}_raw AS (
  SELECT event_id, {ts} AS ts, value, {RAW_LEVEL} AS raw_level, ' Svc ' || (user_id % 12) || ' ' AS raw_source,
    {MESSAGE} AS raw_message, json_extract_string(props, '$.k') AS k
  FROM events),
{name}_norm AS (
  SELECT event_id, ts, value, k, {LEVEL_CASE.format('raw_level')} AS level,
    {source_name('raw_source')} AS source, trim(raw_message) AS message
  FROM {name}_raw),
{name}_print AS (
  SELECT *, sha256({frames('source', 'level', canonical('message'), "'k=' || k")}) AS fingerprint FROM {name}_norm),
{name} AS (
  SELECT *, event_id + 1 AS line,
    substr(sha256({frames("'event'", rfc3339('ts'), 'source', 'level', 'fingerprint')}), 1, 24) AS id
  FROM {name}_print)"""


EV = "WITH " + events_cte()
EVH = "WITH " + events_cte("evh", "date_trunc('hour', ts)")


def detection_ctes(rules: list[dict], events: str = "evh", prefix: str = "") -> str:
    """CTEs matched, ranked, cand, fired, links and inc for rules given as id, test, grp, threshold and seconds."""
    p = prefix
    rows = "\n  UNION ALL\n".join(
        f"  SELECT '{rule['id']}' AS rule_id, {rule['grp']} AS grp, ts, epoch_us(ts) AS us, id, fingerprint, "
        f"{rule['threshold']} AS threshold, {rule['window']}::BIGINT * 1000000 AS win, "
        f"{rule['cooldown']}::BIGINT * 1000000 AS cool FROM {events} WHERE {rule['test']}"
        for rule in rules
    )
    return f"""
{p}matched AS (
{rows}),
{p}ranked AS (
  SELECT *, row_number() OVER (PARTITION BY rule_id, grp ORDER BY ts, id) AS rn FROM {p}matched),
{p}counted AS (
  SELECT *, min(rn) OVER (PARTITION BY rule_id, grp ORDER BY us RANGE BETWEEN win PRECEDING AND CURRENT ROW) AS lo
  FROM {p}ranked),
{p}numbered AS (
  SELECT *, row_number() OVER (PARTITION BY rule_id, grp ORDER BY rn) AS crn
  FROM {p}counted WHERE rn - lo + 1 >= threshold),
{p}cand AS (
  SELECT *, greatest(crn, count(*) OVER (PARTITION BY rule_id, grp ORDER BY us
    RANGE BETWEEN UNBOUNDED PRECEDING AND greatest(cool - 1, 0) FOLLOWING)) + 1 AS next FROM {p}numbered),
{p}chain AS (
  SELECT * FROM {p}cand WHERE crn = 1 AND cool > 0
  UNION ALL
  SELECT c.* FROM {p}chain f JOIN {p}cand c ON c.rule_id = f.rule_id AND c.grp = f.grp AND c.crn = f.next),
{p}fired AS (SELECT * FROM {p}chain UNION ALL SELECT * FROM {p}cand WHERE cool <= 0),
{p}links AS (
  SELECT f.rule_id, f.grp, f.rn AS fired_rn, m.ts, m.id, m.fingerprint
  FROM {p}fired f JOIN {p}ranked m ON m.rule_id = f.rule_id AND m.grp = f.grp AND m.rn BETWEEN f.lo AND f.rn),
{p}inc AS (
  SELECT rule_id, grp, fired_rn, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n,
    list_sort(list(DISTINCT id)) AS ids,
    sha256(rule_id || chr(0) || grp || chr(0) || string_agg(fingerprint, chr(10) ORDER BY fingerprint) || chr(10))
      AS fingerprint,
    substr(sha256({frames("'incident'", 'rule_id', 'grp', rfc3339('min(ts)'))}), 1, 24) AS id
  FROM {p}links GROUP BY rule_id, grp, fired_rn)"""
