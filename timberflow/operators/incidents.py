"""Incident lifecycle: transitions, reconciliation with new detections, automatic resolution."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberflow import schemas
from timberflow.functions.times import instant
from timberflow.operators.detection import Detection, covered_events, detected_incidents, first_fired, per_rule
from timberflow.session import materialize
from timberflow.settings import Rule

# States and the reasons history shows.
STATUSES = ("open", "acknowledged", "resolved")
RESUMED = "matching activity resumed"
QUIET = "no matching activity during resolve interval"

_COLUMNS = list(schemas.INCIDENTS)
_SLIM = [name for name in _COLUMNS if name != "event_ids"]
_KEY = ["rule_id", "group"]


def refusal(target: Column, at: Column) -> Column:
    """Reason a status change is refused, null when it is allowed."""
    return (
        F.when(~target.isin(*STATUSES), F.concat(F.lit('invalid target status "'), target, F.lit('"')))
        .when(at < F.col("updated_at"), "transition time precedes current update")
        .when(
            (F.col("status") == "resolved") & (target == "acknowledged"), "cannot acknowledge a resolved incident"
        )
    )


def apply_transition(incidents: DataFrame, when: Column, target: Column, at: Column, reason: Column) -> DataFrame:
    """Change the status of the rows in ``when``; refused changes and those to the same status do nothing."""
    changes = F.coalesce(when & refusal(target, at).isNull() & (F.col("status") != target), F.lit(False))
    entry = F.struct(
        at.alias("at"), F.col("status").alias("from"), target.alias("to"), reason.alias("reason")
    )
    resolved_at = F.when(target == "resolved", at).when(target == "open", None).otherwise(F.col("resolved_at"))
    return incidents.withColumns(
        {
            "history": F.when(changes, F.array_append("history", entry)).otherwise(F.col("history")),
            "resolved_at": F.when(changes, resolved_at).otherwise(F.col("resolved_at")),
            "updated_at": F.when(changes, at).otherwise(F.col("updated_at")),
            "status": F.when(changes, target).otherwise(F.col("status")),
        }
    )


def transition(incidents: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply at most one update (id, target, at, reason) per incident; ``refused`` tells why one was not made."""
    asked = updates.select(
        "id", F.col("target").alias("_target"), F.col("at").alias("_at"), F.col("reason").alias("_reason")
    )
    joined = incidents.join(asked, "id", "left")
    target, at = F.col("_target"), F.col("_at")
    joined = joined.withColumn("refused", F.when(target.isNotNull(), refusal(target, at)))
    changed = apply_transition(joined, target.isNotNull(), target, at, F.col("_reason"))
    return changed.select(*incidents.columns, "refused")


@dataclass
class News:
    """What a detection run found, per key (rule, group).

    ``keys`` has one row per key: ``n`` detections, the first of them as ``base`` (an incident without event ids), ``min_first``,
    ``max_last`` and ``total``, the sum of their counts.  ``links`` has the events of each key, every one once.
    """

    keys: DataFrame
    links: DataFrame


def news_of_rows(detected: DataFrame) -> News:
    """News in detected incident rows (columns of the incidents table and ``fired_rn``)."""
    base = F.min_by(F.struct(*_SLIM), "fired_rn")
    keys = detected.groupBy(*_KEY).agg(
        F.count("*").alias("n"),
        base.alias("base"),
        F.min("first_seen").alias("min_first"),
        F.max("last_seen").alias("max_last"),
        F.sum("count").alias("total"),
    )
    return News(keys, detected.select(*_KEY, F.explode("event_ids").alias("event_id")).distinct())


def news_of_run(run: Detection, now: datetime) -> News:
    """News straight from a run's fired windows.

    Only the first window of a key is made an incident row.  Overlapping windows are merged as ranges of ranks before any
    event is looked up, so every event of a key is met once, whatever the number of windows that hold it.
    """
    group = F.col("grp").alias("group")
    counts = run.windows.groupBy("rule_id", group).agg(F.count("*").alias("n"), F.sum("cnt").alias("total"), F.max("us").alias("last_us"))
    first = detected_incidents(first_fired(run), now).select(*_KEY, F.struct(*_SLIM).alias("base"))
    # Windows end at the row that fires and begin no earlier than the one before, so the first has the earliest moment.
    keys = counts.join(first, _KEY).select(
        *_KEY, "n", "base", F.col("base.first_seen").alias("min_first"), F.timestamp_micros("last_us").alias("max_last"), "total"
    )
    links = covered_events(run).select("rule_id", group, F.col("id").alias("event_id")).distinct()
    return News(materialize(keys), materialize(links))


def _targets(existing: DataFrame) -> DataFrame:
    """The last existing incident of each key in (first_seen, id) order."""
    return existing.groupBy(*_KEY).agg(F.max_by("id", F.struct("first_seen", "id")).alias("target_id"))


def merged_links(existing: DataFrame, news: News) -> DataFrame:
    """(``rule_id``, ``group``, ``event_id``): all events of the incident that a key's news go to, each once.

    The relation behind the lists in incident rows; it has no row that grows with a key.
    """
    touched = existing.join(news.keys.select(*_KEY), _KEY, "left_semi")
    old = touched.join(_targets(touched).select(F.col("target_id").alias("id")), "id", "left_semi")
    return old.select(*_KEY, F.explode("event_ids").alias("event_id")).unionByName(news.links).distinct()


def reconcile(
    existing: DataFrame,
    detected: DataFrame | News,
    rules: Sequence[Rule],
    now: datetime,
    idempotent: bool = False,
) -> DataFrame:
    """Incidents after a detection run.

    Detections of a key merge into the last existing incident of that key in (first_seen, id) order, or become
    one new incident.  Incidents of keys without activity resolve once they are quiet for long enough.  A
    resolved incident reopens on new activity.  With ``idempotent`` the count is the number of distinct events,
    so that a second run over the same events changes nothing; otherwise counts add up.

    ``detected`` is a table of detected incident rows, or the news of a run (:func:`news_of_run`), which do not
    list the events of every window first.  Event lists are gathered last, once for each incident that changes.
    """
    at = instant(now)
    news = detected if isinstance(detected, News) else news_of_rows(detected)
    lists = merged_links(existing, news).groupBy(*_KEY).agg(F.sort_array(F.collect_list("event_id")).alias("ids"))
    # One row per key on all sides: the wide tables meet only this table.
    keyed = _targets(existing).join(news.keys.join(lists, _KEY, "left"), _KEY, "full_outer")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    rows = existing.join(keyed, _KEY, "left")
    merges = F.coalesce((F.col("id") == F.col("target_id")) & F.col("n").isNotNull(), F.lit(False))

    reopens = merges & (F.col("status") == "resolved") & ((at >= F.col("updated_at")) | (F.col("n") >= 2))
    entry = F.struct(
        at.alias("at"), F.col("status").alias("from"), F.lit("open").alias("to"), F.lit(RESUMED).alias("reason")
    )
    total = F.size(ids).cast("bigint") if idempotent else F.col("count") + F.col("total")
    merged = {
        "first_seen": F.least("first_seen", "min_first"),
        "last_seen": F.greatest("last_seen", "max_last"),
        "count": total,
        "event_ids": ids,
        "updated_at": at,
    }
    changes = {name: F.when(merges, value).otherwise(F.col(name)) for name, value in merged.items()}
    changes["history"] = F.when(reopens, F.array_append("history", entry)).otherwise(F.col("history"))
    changes["resolved_at"] = F.when(~reopens, F.col("resolved_at"))
    changes["status"] = F.when(reopens, "open").otherwise(F.col("status"))
    kept = auto_resolve(rows.withColumns(changes), rules, now, F.col("n").isNull())

    fresh = keyed.filter(F.col("target_id").isNull())
    created = {
        "first_seen": F.col("min_first"),
        "last_seen": F.col("max_last"),
        "count": F.size(ids).cast("bigint") if idempotent else F.col("total"),
        "event_ids": ids,
    }
    value = lambda name: created[name] if name in created else F.col(f"base.{name}")
    fresh = fresh.select(*[value(name).alias(name) for name in _COLUMNS])
    return kept.select(*_COLUMNS).unionByName(fresh)


def auto_resolve(incidents: DataFrame, rules: Sequence[Rule], now: datetime, quiet: Column | None = None) -> DataFrame:
    """Resolve quiet incidents whose rule's interval has passed since their last activity."""
    if not rules:
        return incidents
    at = instant(now)
    interval = F.coalesce(per_rule(rules, lambda rule: rule.resolve_nanos, "bigint"), F.lit(0))
    age = (F.unix_micros(at) - F.unix_micros("last_seen")) * 1000
    due = (F.col("status") != "resolved") & (interval > 0) & (age >= interval)
    if quiet is not None:
        due = due & quiet
    return apply_transition(incidents, due, F.lit("resolved"), at, F.lit(QUIET))
