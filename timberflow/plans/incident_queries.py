"""Queries over detection, incident lifecycle, retention and reports that need incidents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberflow import schemas
from timberflow.operators import dedup, filters, incidents, quality, reports, retention
from timberflow.operators.detection import detect, detected_incidents, evaluations
from timberflow.plans import adapter
from timberflow.plans.catalog import query
from timberflow.plans.oracle import EV, EVH, detection_ctes, rfc3339
from timberflow.session import materialize, scratch_path
from timberflow.settings import Predicate, Retention, Rule

NOW = adapter.NOW
HALF = datetime(2024, 1, 16)

RULES = [
    Rule(
        "error-burst",
        all=[Predicate("level", "gte", "ERROR")],
        group_by=["source"],
        threshold=5,
        window="12h",
        cooldown="24h",
        resolve_after="72h",
        labels={"team": "operations"},
    ),
    Rule(
        "purchase-surge",
        title="Many purchases",
        severity="warning",
        all=[Predicate("message", "prefix", "purchase")],
        threshold=20,
        window="6h",
        cooldown="12h",
        resolve_after="72h",
    ),
    Rule(
        "signup-run",
        severity="INFO",
        all=[Predicate("message", "regex", "^signup ")],
        any=[Predicate("k", "lt", "50"), Predicate("source", "eq", "svc-3")],
        group_by=["source", "level"],
        threshold=4,
        window="6h",
        cooldown="7h",
        resolve_after="48h",
    ),
    Rule("switched-off", enabled=False),
]

# Without a cooldown every full window fires, so windows overlap and ids repeat.
FLOOD = Rule(
    "crit-flood", all=[Predicate("level", "eq", "fatal")], group_by=["source"], threshold=2, window="12h", cooldown="0s"
)

_SQL_RULES = [
    {"id": "error-burst", "test": "level IN ('ERROR', 'FATAL')", "grp": "'source=' || source", "threshold": 5,
     "window": 43200, "cooldown": 86400},
    {"id": "purchase-surge", "test": "starts_with(message, 'purchase')", "grp": "'all'", "threshold": 20,
     "window": 21600, "cooldown": 43200},
    {"id": "signup-run", "test": "starts_with(message, 'signup ') AND (k::DOUBLE < 50 OR source = 'svc-3')",
     "grp": "'source=' || source || '|level=' || level", "threshold": 4, "window": 21600, "cooldown": 25200},
]
_SQL_FLOOD = {"id": "crit-flood", "test": "level = 'FATAL'", "grp": "'source=' || source", "threshold": 2,
     "window": 43200, "cooldown": 0}

_DET = EVH.replace("WITH ", "WITH RECURSIVE ", 1) + "," + detection_ctes(_SQL_RULES)
_DET_ALL = EVH.replace("WITH ", "WITH RECURSIVE ", 1) + "," + detection_ctes([*_SQL_RULES, _SQL_FLOOD])

_STORED: dict[tuple[str, str], str] = {}


def run_detection(spark: SparkSession, folder: str, rules=(*RULES, FLOOD)):
    return detect(adapter.hourly_events(spark, folder), rules)


def stored_incidents(spark: SparkSession, folder: str) -> DataFrame:
    """Incidents table of the test events: detected once per application, then read as the stored table it is."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORED:
        path = scratch_path(spark, "incidents")
        detected_incidents(run_detection(spark, folder, RULES), NOW).write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


# --- detection --------------------------------------------------------------------------------------------


@query("det_sliding_count", _DET_ALL + "SELECT rule_id, grp, id, rn, rn - lo + 1 AS cnt FROM counted")
def det_sliding_count(spark, folder):
    return run_detection(spark, folder).counted.select("rule_id", "grp", "id", "rn", "cnt")


@query("det_candidates", _DET_ALL + "SELECT rule_id, grp, id, rn, rn - lo + 1 AS cnt FROM cand")
def det_candidates(spark, folder):
    return run_detection(spark, folder).candidates.select("rule_id", "grp", "id", "rn", "cnt")


@query("det_triggers", _DET_ALL + "SELECT rule_id, grp, id, rn, ts AS at FROM fired")
def det_triggers(spark, folder):
    fired = run_detection(spark, folder).fired
    return fired.select("rule_id", "grp", "id", "rn", F.timestamp_micros("us").alias("at"))


_INC = """SELECT id, rule_id, grp AS "group", fingerprint, first_seen, last_seen, n AS count,
      array_to_string(ids, ',') AS event_ids,
      CASE rule_id WHEN 'error-burst' THEN 'ERROR' WHEN 'crit-flood' THEN 'ERROR' WHEN 'purchase-surge' THEN 'WARN' ELSE 'INFO' END AS severity,
      CASE rule_id WHEN 'purchase-surge' THEN 'Many purchases' ELSE rule_id END AS title,
      CASE rule_id WHEN 'error-burst' THEN 'threshold 5 reached in 12h'
        WHEN 'purchase-surge' THEN 'threshold 20 reached in 6h'
        WHEN 'crit-flood' THEN 'threshold 2 reached in 12h' ELSE 'threshold 4 reached in 6h' END AS reason
      FROM inc"""


@query("det_incidents", _DET_ALL + _INC)
def det_incidents(spark, folder):
    rows = detected_incidents(run_detection(spark, folder), NOW)
    return rows.select(
        "id",
        "rule_id",
        "group",
        "fingerprint",
        "first_seen",
        "last_seen",
        "count",
        F.array_join("event_ids", ",").alias("event_ids"),
        "severity",
        "title",
        F.col("history")[0]["reason"].alias("reason"),
    )


@query(
    "det_evaluations",
    _DET_ALL
    + """SELECT r.rule, CASE WHEN r.rule = 'switched-off' THEN 0 ELSE (SELECT count(*) FROM evh) END AS examined,
      (SELECT count(*) FROM matched m WHERE m.rule_id = r.rule) AS matched,
      (SELECT count(*) FROM fired f WHERE f.rule_id = r.rule) AS triggered,
      (SELECT count(*) FROM cand c WHERE c.rule_id = r.rule) - (SELECT count(*) FROM fired f WHERE f.rule_id = r.rule)
        AS suppressed
    FROM (VALUES ('error-burst'), ('purchase-surge'), ('signup-run'), ('switched-off'), ('crit-flood')) AS r(rule)""",
)
def det_evaluations(spark, folder):
    return evaluations(run_detection(spark, folder))


# --- lifecycle --------------------------------------------------------------------------------------------

_HISTORY = "transform(history, h -> concat(coalesce(h.`from`, ''), '>', h.`to`, ':', h.reason))"


def _shown(rows: DataFrame) -> DataFrame:
    """Incident columns in forms a SQL result can be compared with."""
    return rows.select(
        "id",
        "rule_id",
        "group",
        "status",
        "count",
        "first_seen",
        "last_seen",
        "updated_at",
        "resolved_at",
        F.array_join("event_ids", ",").alias("event_ids"),
        F.array_join(F.expr(_HISTORY), ";").alias("history"),
    )


_OPENED = """CASE rule_id WHEN 'error-burst' THEN '>open:threshold 5 reached in 12h'
    WHEN 'purchase-surge' THEN '>open:threshold 20 reached in 6h'
    WHEN 'crit-flood' THEN '>open:threshold 2 reached in 12h' ELSE '>open:threshold 4 reached in 6h' END"""


def _asked(rows: DataFrame) -> DataFrame:
    """Status changes asked for, by group."""
    source = F.regexp_extract("group", "source=(svc-[0-9]+)", 1)
    target = F.when(source == "svc-1", "acknowledged").when(source.isin("svc-2", "svc-3"), "resolved")
    target = F.when(source == "svc-4", "closed").otherwise(target)
    at = (
        F.when(source == "svc-1", "2024-01-17")
        .when(source == "svc-2", "2024-01-20")
        .when(source == "svc-3", "2024-02-10")
        .otherwise("2024-02-01")
    )
    return rows.select(
        "id", target.alias("target"), at.cast("timestamp").alias("at"), F.lit("by hand").alias("reason")
    ).filter(F.col("target").isNotNull())


@query(
    "inc_transition",
    _DET
    + f""", s AS (SELECT *, regexp_extract(grp, 'source=(svc-[0-9]+)', 1) AS source FROM inc)
    SELECT id, grp AS "group", first_seen,
      CASE source WHEN 'svc-3' THEN 'resolved' ELSE 'open' END AS status,
      CASE source WHEN 'svc-3' THEN TIMESTAMP '2024-02-10' ELSE TIMESTAMP '2024-01-31' END AS updated_at,
      CASE source WHEN 'svc-3' THEN TIMESTAMP '2024-02-10' END AS resolved_at,
      {_OPENED} || CASE source WHEN 'svc-3' THEN ';open>resolved:by hand' ELSE '' END AS history,
      CASE source WHEN 'svc-1' THEN 'transition time precedes current update'
        WHEN 'svc-2' THEN 'transition time precedes current update'
        WHEN 'svc-4' THEN 'invalid target status "closed"' END AS refused
    FROM s""",
)
def inc_transition(spark, folder):
    rows = stored_incidents(spark, folder)
    changed = incidents.transition(rows, _asked(rows).dropDuplicates(["id"]))
    return changed.select(
        "id",
        "group",
        "first_seen",
        "status",
        "updated_at",
        "resolved_at",
        F.array_join(F.expr(_HISTORY), ";").alias("history"),
        "refused",
    )


@query(
    "inc_auto_resolve",
    _DET
    + f""", s AS (SELECT *, date_diff('second', last_seen, TIMESTAMP '2024-01-31') >=
        CASE rule_id WHEN 'signup-run' THEN 172800 ELSE 259200 END AS due FROM inc)
    SELECT id, rule_id, grp AS "group", CASE WHEN due THEN 'resolved' ELSE 'open' END AS status, n AS count,
      first_seen, last_seen, TIMESTAMP '2024-01-31' AS updated_at,
      CASE WHEN due THEN TIMESTAMP '2024-01-31' END AS resolved_at, array_to_string(ids, ',') AS event_ids,
      {_OPENED} || CASE WHEN due THEN ';open>resolved:no matching activity during resolve interval' ELSE '' END
        AS history FROM s""",
)
def inc_auto_resolve(spark, folder):
    return _shown(incidents.auto_resolve(stored_incidents(spark, folder), RULES, NOW))


_FIRST_RUN = [*RULES, FLOOD]
_SECOND_RUN = [rule for rule in _FIRST_RUN if rule.id != "purchase-surge"]


def _reconciled(spark: SparkSession, folder: str, idempotent: bool = False) -> DataFrame:
    """Incidents of the first half of the month, changed by hand, then merged with a run over the whole month."""
    events = adapter.hourly_events(spark, folder)
    early = detect(events.filter(F.col("timestamp") < F.lit("2024-01-16").cast("timestamp")), _FIRST_RUN)
    empty = spark.createDataFrame([], schemas.ddl(schemas.INCIDENTS))
    old = materialize(incidents.reconcile(empty, incidents.news_of_run(early, HALF), _FIRST_RUN, HALF))
    old = materialize(incidents.transition(old, _asked(old)).drop("refused"))
    again = incidents.news_of_run(detect(events, _SECOND_RUN), NOW)
    return incidents.reconcile(old, again, _FIRST_RUN, NOW, idempotent)


_PER_KEY = """SELECT rule_id, grp, count(*) AS dets, min_by(id, fired_rn) AS id, min(first_seen) AS first_seen,
      max(last_seen) AS last_seen, sum(n)::BIGINT AS n, list_sort(list_distinct(flatten(list(ids)))) AS ids FROM {0}
      GROUP BY rule_id, grp"""

_RECONCILE_CTES = (
    EVH.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", early AS (SELECT * FROM evh WHERE ts < '2024-01-16'),"
    + detection_ctes([*_SQL_RULES, _SQL_FLOOD], "early", "a_")
    + ","
    + detection_ctes([rule for rule in [*_SQL_RULES, _SQL_FLOOD] if rule["id"] != "purchase-surge"], "evh", "b_")
    + f""",
old AS (
  SELECT *, CASE source WHEN 'svc-1' THEN 'acknowledged' WHEN 'svc-2' THEN 'resolved' WHEN 'svc-3' THEN 'resolved'
      ELSE 'open' END AS status,
    CASE source WHEN 'svc-1' THEN TIMESTAMP '2024-01-17' WHEN 'svc-2' THEN TIMESTAMP '2024-01-20'
      WHEN 'svc-3' THEN TIMESTAMP '2024-02-10' ELSE TIMESTAMP '2024-01-16' END AS updated_at,
    {_OPENED} || CASE source WHEN 'svc-1' THEN ';open>acknowledged:by hand'
      WHEN 'svc-2' THEN ';open>resolved:by hand' WHEN 'svc-3' THEN ';open>resolved:by hand' ELSE '' END AS history
  FROM (SELECT *, regexp_extract(grp, 'source=(svc-[0-9]+)', 1) AS source FROM ({_PER_KEY.format('a_inc')}))),
fresh AS ({_PER_KEY.format('b_inc')}),
both_ AS (
  SELECT coalesce(o.rule_id, f.rule_id) AS rule_id, coalesce(o.grp, f.grp) AS grp, coalesce(o.id, f.id) AS id,
    o.id IS NULL AS created, f.id IS NOT NULL AS active, o.status, o.updated_at AS old_at, o.history,
    least(o.first_seen, f.first_seen) AS first_seen, greatest(o.last_seen, f.last_seen) AS last_seen,
    coalesce(o.n, 0) + coalesce(f.n, 0) AS n, f.dets,
    list_sort(list_distinct(list_concat(coalesce(o.ids, []), coalesce(f.ids, [])))) AS ids
  FROM old o FULL JOIN fresh f ON o.rule_id = f.rule_id AND o.grp = f.grp),
judged AS (
  SELECT *, status = 'resolved' AND active AND (TIMESTAMP '2024-01-31' >= old_at OR dets >= 2) AS reopens,
    NOT active AND status <> 'resolved' AND TIMESTAMP '2024-01-31' >= old_at
      AND date_diff('second', last_seen, TIMESTAMP '2024-01-31') >=
        CASE rule_id WHEN 'signup-run' THEN 172800 WHEN 'crit-flood' THEN 100000000000 ELSE 259200 END AS resolves
  FROM both_)
SELECT id, rule_id, grp AS "group",
  CASE WHEN created OR reopens THEN 'open' WHEN resolves THEN 'resolved' ELSE status END AS status,
  first_seen, last_seen,
  CASE WHEN active OR resolves THEN TIMESTAMP '2024-01-31' ELSE old_at END AS updated_at,
  CASE WHEN resolves THEN TIMESTAMP '2024-01-31' WHEN status = 'resolved' AND NOT reopens THEN old_at END AS resolved_at,
  array_to_string(ids, ',') AS event_ids,
  CASE WHEN created THEN {_OPENED} WHEN reopens THEN history || ';resolved>open:matching activity resumed'
    WHEN resolves THEN history || ';' || status || '>resolved:no matching activity during resolve interval'
    ELSE history END AS history, """
)


@query("reconcile", _RECONCILE_CTES + "n::BIGINT AS count FROM judged")
def reconcile(spark, folder):
    return _shown(_reconciled(spark, folder))


@query(
    "reconcile_idempotent",
    _RECONCILE_CTES + "CASE WHEN active THEN len(ids) ELSE n END::BIGINT AS count FROM judged",
)
def reconcile_idempotent(spark, folder):
    return _shown(_reconciled(spark, folder, idempotent=True))


@query(
    "inc_status_counts",
    _RECONCILE_CTES.replace("SELECT id, rule_id, grp AS \"group\",", ", final AS (SELECT id, rule_id, grp,", 1)
    + """n AS count FROM judged)
    SELECT count(*) FILTER (WHERE status <> 'resolved') AS open, count(*) FILTER (WHERE status = 'resolved') AS resolved
    FROM final""",
)
def inc_status_counts(spark, folder):
    return reports.status_counts(_reconciled(spark, folder))


@query(
    "inc_listing",
    _DET
    + f"""SELECT 'open' AS status, CASE rule_id WHEN 'error-burst' THEN 'ERROR' WHEN 'purchase-surge' THEN 'WARN'
      ELSE 'INFO' END AS severity, rule_id AS rule, grp AS "group", n AS count, {rfc3339('first_seen')} AS first,
      {rfc3339('last_seen')} AS last, id FROM inc""",
)
def inc_listing(spark, folder):
    return reports.incident_listing(stored_incidents(spark, folder))


# --- references -------------------------------------------------------------------------------------------


@query(
    "incident_refs",
    _DET
    + """, refs AS (SELECT id AS incident_id, unnest(ids) AS event_id FROM inc)
    SELECT event_id, string_agg(incident_id, ',' ORDER BY incident_id) AS incident_ids FROM refs GROUP BY event_id""",
)
def incident_refs(spark, folder):
    refs = dedup.incident_references(stored_incidents(spark, folder))
    return refs.select("event_id", F.array_join("incident_ids", ",").alias("incident_ids"))


@query(
    "incident_postings",
    _DET
    + """, refs AS (SELECT id AS incident_id, unnest(ids) AS event_id FROM inc),
    placed AS (SELECT *, (row_number() OVER (PARTITION BY event_id ORDER BY incident_id) - 1) // 2 AS chunk FROM refs)
    SELECT event_id, chunk, string_agg(incident_id, ',' ORDER BY incident_id) AS incident_ids FROM placed GROUP BY event_id, chunk""",
)
def incident_postings(spark, folder):
    """Inverted references in rows of two incidents each."""
    postings = dedup.reference_postings(stored_incidents(spark, folder), chunk=2)
    return postings.select("event_id", "chunk", F.array_join("incident_ids", ",").alias("incident_ids"))


@query(
    "dangling_refs",
    _DET
    + """, refs AS (SELECT id AS incident_id, unnest(ids) AS event_id FROM inc)
    SELECT incident_id || ':' || event_id AS reference FROM refs
    WHERE event_id NOT IN (SELECT id FROM evh WHERE ts >= '2024-01-12')""",
)
def dangling_refs(spark, folder):
    """References left behind when only the later events are kept."""
    events = adapter.hourly_events(spark, folder).filter(F.col("timestamp") >= F.lit("2024-01-12").cast("timestamp"))
    return dedup.dangling_references(events, stored_incidents(spark, folder))


@query(
    "q_incident",
    _DET
    + """, one AS (SELECT unnest(ids) AS id FROM inc WHERE id = (SELECT min(id) FROM inc))
    SELECT id, ts AS timestamp, level, source, message FROM evh WHERE id IN (SELECT id FROM one)""",
)
def q_incident(spark, folder):
    rows = stored_incidents(spark, folder)
    terms = filters.EventFilter(incident=rows.agg(F.min("id")).first()[0] or "none")
    found = filters.matching(adapter.hourly_events(spark, folder), terms, rows)
    return found.select("id", "timestamp", "level", "source", "message")


@query(
    "q_incident_by_id",
    _DET + 'SELECT id, rule_id, grp AS "group", n AS count FROM inc WHERE id = (SELECT max(id) FROM inc)',
)
def q_incident_by_id(spark, folder):
    rows = stored_incidents(spark, folder)
    wanted = rows.agg(F.max("id")).first()[0]
    return filters.by_id(rows, wanted).select("id", "rule_id", "group", "count")


# --- reports and metadata ---------------------------------------------------------------------------------


@query(
    "report_summary",
    _DET
    + """SELECT min(ts) AS "from", max(ts) AS "to", count(*) AS events, (SELECT count(*) FROM inc) AS incidents,
      (SELECT count(*) FROM inc WHERE date_diff('second', last_seen, TIMESTAMP '2024-01-31') <
        CASE rule_id WHEN 'signup-run' THEN 172800 ELSE 259200 END) AS open_incidents FROM evh""",
)
def report_summary(spark, folder):
    rows = incidents.auto_resolve(stored_incidents(spark, folder), RULES, NOW)
    return reports.report_summary(adapter.hourly_events(spark, folder), rows)


@query("report_rules", _DET + "SELECT rule_id AS name, count(*) AS count FROM inc GROUP BY rule_id")
def report_rules(spark, folder):
    return reports.ranking(stored_incidents(spark, folder), "rule_id")


@query(
    "store_metadata",
    _DET
    + """SELECT count(*) AS events, (SELECT count(*) FROM inc) AS incidents, min(ts) AS earliest, max(ts) AS latest
      FROM evh""",
)
def store_metadata(spark, folder):
    return reports.store_metadata(adapter.hourly_events(spark, folder), stored_incidents(spark, folder))


# --- retention --------------------------------------------------------------------------------------------

POLICY = Retention(event_days=20, incident_days=24)
_CUT, _INCIDENT_CUT = "TIMESTAMP '2024-01-11'", "TIMESTAMP '2024-01-07'"
_SURVIVE = f"ts >= {_CUT} QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY ts, id) = 1"


@query("ret_expire_events", EV + f"SELECT id, line FROM ev WHERE ts >= {_CUT}")
def ret_expire_events(spark, folder):
    return retention.live_events(adapter.events(spark, folder), POLICY, NOW).select("id", "line")


@query("ret_dedup", EV + f"SELECT id, line, fingerprint FROM ev WHERE {_SURVIVE}")
def ret_dedup(spark, folder):
    kept = retention.surviving_events(adapter.events(spark, folder), POLICY, NOW)
    return kept.select("id", "line", "fingerprint")


@query(
    "ret_expire_incidents", _DET + f"SELECT id, fingerprint, last_seen FROM inc WHERE last_seen >= {_INCIDENT_CUT}"
)
def ret_expire_incidents(spark, folder):
    rows = retention.live_incidents(stored_incidents(spark, folder), POLICY, NOW)
    return rows.select("id", "fingerprint", "last_seen")


_KEPT = f", kept AS (SELECT DISTINCT id FROM (SELECT id FROM evh WHERE {_SURVIVE}))"


@query(
    "ret_prune_refs",
    _DET
    + _KEPT
    + """, refs AS (SELECT fingerprint, unnest(ids) AS event_id FROM inc),
    present AS (SELECT fingerprint, string_agg(event_id, ',' ORDER BY event_id) AS event_ids FROM refs
      WHERE event_id IN (SELECT id FROM kept) GROUP BY fingerprint)
    SELECT id, fingerprint, n AS count, coalesce(event_ids, '') AS event_ids
    FROM inc LEFT JOIN present USING (fingerprint)""",
)
def ret_prune_refs(spark, folder):
    kept = retention.surviving_events(adapter.hourly_events(spark, folder), POLICY, NOW)
    pruned = retention.prune_references(stored_incidents(spark, folder), kept)
    return pruned.select("id", "fingerprint", "count", F.array_join("event_ids", ",").alias("event_ids"))


@query(
    "ret_close",
    _DET
    + f"""SELECT id, fingerprint, CASE WHEN last_seen < {_CUT} THEN 'resolved' ELSE 'open' END AS status,
      CASE WHEN last_seen < {_CUT} THEN TIMESTAMP '2024-01-31' END AS resolved_at,
      {_OPENED} || CASE WHEN last_seen < {_CUT} THEN ';open>resolved:supporting events expired by retention' ELSE '' END
        AS history, last_seen < {_CUT} AS closing FROM inc""",
)
def ret_close(spark, folder):
    closed = retention.close_unsupported(stored_incidents(spark, folder), POLICY, NOW)
    history = F.array_join(F.expr(_HISTORY), ";").alias("history")
    return closed.select("id", "fingerprint", "status", "resolved_at", history, "closing")


@query(
    "ret_stats",
    _DET
    + f""", s AS (SELECT (SELECT count(*) FROM evh) AS before_events,
      (SELECT count(*) FROM (SELECT id FROM evh WHERE {_SURVIVE})) AS after_events,
      (SELECT count(*) FROM evh WHERE ts < {_CUT}) AS expired_events,
      (SELECT count(*) FROM inc) AS before_incidents,
      (SELECT count(*) FROM inc WHERE last_seen < {_INCIDENT_CUT}) AS expired_incidents,
      (SELECT count(*) FROM inc WHERE last_seen >= {_INCIDENT_CUT} AND last_seen < {_CUT}) AS closed_incidents)
    SELECT before_events, after_events, expired_events, before_events - expired_events - after_events AS duplicate_events,
      before_incidents, before_incidents - expired_incidents AS after_incidents, expired_incidents, closed_incidents,
      {_CUT} AS cutoff FROM s""",
)
def ret_stats(spark, folder):
    events = adapter.hourly_events(spark, folder)
    return retention.compaction_stats(events, stored_incidents(spark, folder), POLICY, NOW)


@query(
    "ret_compact",
    _DET
    + _KEPT
    + f"""SELECT 'event' AS kind, fingerprint AS id, NULL::VARCHAR AS status FROM evh WHERE {_SURVIVE}
    UNION ALL SELECT 'incident', fingerprint, CASE WHEN last_seen < {_CUT} THEN 'resolved' ELSE 'open' END
      FROM inc WHERE last_seen >= {_INCIDENT_CUT}""",
)
def ret_compact(spark, folder):
    """Both tables after a whole compaction."""
    result = retention.compact(
        adapter.hourly_events(spark, folder), stored_incidents(spark, folder), POLICY, NOW
    )
    kept = result.events.select(
        F.lit("event").alias("kind"), F.col("fingerprint").alias("id"), F.lit(None).cast("string").alias("status")
    )
    rows = result.incidents.select(F.lit("incident").alias("kind"), F.col("fingerprint").alias("id"), "status")
    return kept.union(rows)


@query(
    "dq_incidents",
    _DET
    + """SELECT fingerprint, CASE rule_id WHEN 'error-burst' THEN 'resolved incident lacks resolved_at'
      ELSE 'incident last_seen precedes first_seen' END AS violation FROM inc
    WHERE rule_id = 'error-burst' OR (rule_id = 'signup-run' AND first_seen > TIMESTAMP '2024-01-10')""",
)
def dq_incidents(spark, folder):
    """Incidents damaged by rule, so that the checks have rows to find."""
    rows = stored_incidents(spark, folder)
    burst = F.col("rule_id") == "error-burst"
    late = (F.col("rule_id") == "signup-run") & (F.col("first_seen") > F.lit("2024-01-10").cast("timestamp"))
    broken = rows.withColumns(
        {
            "status": F.when(burst, "resolved").otherwise(F.col("status")),
            "last_seen": F.when(late, F.lit("2024-01-01").cast("timestamp")).otherwise(F.col("last_seen")),
        }
    )
    return quality.incident_violations(broken).select("fingerprint", "violation")
