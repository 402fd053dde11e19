"""Row checks of the stored tables: the first failing reason in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberflow.functions.levels import LEVELS
from timberflow.functions.text import trim_space
from timberflow.functions.times import ORIGIN_MICROS
from timberflow.operators.incidents import STATUSES


def _blank(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def _no_time(column: str) -> Column:
    return F.col(column).isNull() | (F.unix_micros(column) == -ORIGIN_MICROS)


def event_violation() -> Column:
    # Reasons, in the order the checks run.
    return (
        F.when(_blank("id"), "event id is required")
        .when(_no_time("timestamp"), "event timestamp is required")
        .when(F.coalesce(trim_space(F.col("source")), F.lit("")) == "", "event source is required")
        .when(F.coalesce(trim_space(F.col("message")), F.lit("")) == "", "event message is required")
        .when(_blank("fingerprint"), "event fingerprint is required")
        .when(~F.coalesce(F.col("level").isin(*LEVELS), F.lit(False)), "event level is invalid")
    )


def incident_violation() -> Column:
    # Reasons, in the order the checks run.
    return (
        F.when(_blank("id") | _blank("rule_id"), "incident id and rule id are required")
        .when(
            ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)),
            F.concat(F.lit('invalid incident status "'), F.coalesce("status", F.lit("")), F.lit('"')),
        )
        .when(_no_time("first_seen") | _no_time("last_seen"), "incident time range is required")
        .when(F.col("last_seen") < F.col("first_seen"), "incident last_seen precedes first_seen")
        .when(F.coalesce(F.col("count"), F.lit(0)) < 1, "incident count must be positive")
        .when((F.col("status") == "resolved") & F.col("resolved_at").isNull(), "resolved incident lacks resolved_at")
    )


def event_violations(events: DataFrame) -> DataFrame:
    """Bad event rows with the column ``violation``."""
    return events.withColumn("violation", event_violation()).filter(F.col("violation").isNotNull())


def incident_violations(incidents: DataFrame) -> DataFrame:
    return incidents.withColumn("violation", incident_violation()).filter(F.col("violation").isNotNull())


def checked(df: DataFrame, violation: Column) -> DataFrame:
    """The same rows; a bad one stops the job with its reason.  The check runs in the scan, without a pass of its own."""
    gate = F.when(violation.isNotNull(), F.raise_error(violation).cast("boolean")).otherwise(F.lit(True))
    return df.filter(gate)
