"""Access to built-in columns and custom fields of an event by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberflow.functions.times import rfc3339

MISSING = "<missing>"


def field_value(name: str) -> Column:
    """Text of a field, null when the event does not have it.

    The name is resolved when the expression is built, so a built-in one stays a plain column reference.
    A custom name matches exactly first, then the smallest key that differs only in case.
    """
    builtin = name.lower()
    if builtin in ("id", "level", "source", "message", "fingerprint"):
        return F.col(builtin)
    if builtin in ("timestamp", "time"):
        return rfc3339(F.col("timestamp"), F.col("ts_nanos"))
    if builtin == "input":
        return F.nullif(F.col("input"), F.lit(""))
    if builtin == "line":
        return F.when(F.col("line") != 0, F.col("line").cast("string"))
    fields = F.col("fields")
    similar = F.array_min(F.filter(F.map_keys(fields), lambda key: F.lower(key) == F.lower(F.lit(name))))
    return F.coalesce(F.try_element_at(fields, F.lit(name)), F.try_element_at(fields, similar))


def group_key(names: Sequence[str]) -> Column:
    """``name=value`` parts joined by ``|``; ``all`` when there are no names."""
    if not names:
        return F.lit("all")
    parts = [F.concat(F.lit(f"{name}="), F.coalesce(field_value(name), F.lit(MISSING))) for name in names]
    return F.concat_ws("|", *parts)


def fields_text(fields: Column) -> Column:
    """``key=value`` pairs in key order joined by ``;``."""
    pairs = F.transform(
        F.sort_array(F.map_entries(fields)), lambda entry: F.concat(entry["key"], F.lit("="), entry["value"])
    )
    return F.coalesce(F.array_join(pairs, ";"), F.lit(""))
