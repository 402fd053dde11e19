"""Saving and exporting events and incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberflow import schemas
from timberflow.functions.fields import fields_text
from timberflow.functions.times import rfc3339
from timberflow.operators import quality
from timberflow.operators.dedup import EVENT_ORDER, duplicate_ids
from timberflow.session import materialize


def _save(df: DataFrame, order: list[str], violation: Column, path: str, mode: str) -> None:
    """Checks, ranges and files all come from one materialized run of the table's lineage.

    Rows are checked once they are materialized: a check on the lineage would compute the columns it reads a second time.
    """
    rows = quality.checked(materialize(df), violation)
    twice = duplicate_ids(rows.select("id")).limit(1).collect()
    if twice:
        raise ValueError(f"duplicate id {twice[0]['id']!r}")
    ranged = rows.repartitionByRange(*[F.col(name) for name in order]).sortWithinPartitions(*order)
    ranged.write.mode(mode).parquet(path)


def save_events(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write checked events with unique ids in (time, id) order to a new folder.

    Files cover ranges of time, so a query by time reads only the files it needs.
    """
    _save(events.select(*schemas.EVENTS), EVENT_ORDER, quality.event_violation(), path, mode)


def save_incidents(incidents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    _save(incidents.select(*schemas.INCIDENTS), ["first_seen", "id"], quality.incident_violation(), path, mode)


def export_columns(events: DataFrame) -> DataFrame:
    """The seven text columns of the CSV export, in event order."""
    ordered = events.orderBy(*EVENT_ORDER)
    return ordered.select(
        rfc3339(F.col("timestamp"), F.col("ts_nanos")).alias("timestamp"),
        "level",
        "source",
        "message",
        "id",
        "fingerprint",
        fields_text(F.col("fields")).alias("fields"),
    )


def export_csv(events: DataFrame, path: str) -> None:
    """CSV with a header; quotes only where needed, doubled inside."""
    export_columns(events).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def _json_times(df: DataFrame) -> DataFrame:
    times = [name for name, kind in df.dtypes if kind == "timestamp"]
    return df.withColumns({name: rfc3339(F.col(name)) for name in times})


def export_events_json(events: DataFrame, path: str) -> None:
    """JSON lines in ascending order, whatever order the query had."""
    ordered = events.orderBy(*EVENT_ORDER)
    at = rfc3339(F.col("timestamp"), F.col("ts_nanos"))
    _json_times(ordered.withColumn("timestamp", at)).drop("ts_nanos").write.json(path)


def export_incidents_json(incidents: DataFrame, path: str) -> None:
    shown = F.transform(
        "history",
        lambda item: F.struct(
            rfc3339(item["at"]).alias("at"), item["from"].alias("from"), item["to"].alias("to"), item["reason"].alias("reason")
        ),
    )
    _json_times(incidents.orderBy("first_seen", "id").withColumn("history", shown)).write.json(path)
