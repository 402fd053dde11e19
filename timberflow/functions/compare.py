"""Ordered comparison of a field with a constant."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberflow.functions.levels import LEVELS, level_ordinal_of
from timberflow.functions.times import DECIMAL, parse_layout, translate_layout

_RFC3339 = translate_layout("2006-01-02T15:04:05.999999999Z07:00")
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def instant_of(text: str) -> tuple[int, int] | None:
    """Micros and nanos of an RFC 3339 constant, None for any other text."""
    match = re.fullmatch(r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:[.,](\d+))?(Z|[+-]\d{2}:\d{2})", text)
    if not match:
        return None
    try:
        moment = datetime.fromisoformat(match[1] + match[3].replace("Z", "+00:00"))
    except ValueError:
        return None
    nanos = int((match[2] or "")[:9].ljust(9, "0"))
    delta = moment - _EPOCH
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + nanos // 1000, nanos % 1000


def _sign(left: Column, right: Column) -> Column:
    return F.when(left < right, -1).when(left > right, 1).otherwise(0)


def compare_text(actual: Column, constant: str) -> Column:
    """-1, 0 or 1: as numbers if both are, else as RFC 3339 times if both are, else as bytes.

    The constant's side is decided when the expression is built.
    """
    result = _sign(actual, F.lit(constant))
    if re.search(DECIMAL, constant):
        number = F.when(actual.rlike(DECIMAL), actual.try_cast("double"))
        result = F.when(number.isNotNull(), _sign(number, F.lit(float(constant)))).otherwise(result)
    moment = instant_of(constant)
    if moment is not None:
        parsed = parse_layout(actual, _RFC3339)
        expected = F.struct(F.lit(moment[0]).cast("bigint").alias("us"), F.lit(moment[1]).alias("nanos"))
        result = F.when(parsed.isNotNull(), _sign(parsed, expected)).otherwise(result)
    return result


def compare_level(level: Column, op: str, constant: str) -> Column:
    """Level comparison as a membership test on the name, which a Parquet scan can use."""
    bound = level_ordinal_of(constant)
    tests = {
        "gt": lambda i: i > bound,
        "gte": lambda i: i >= bound,
        "lt": lambda i: i < bound,
        "lte": lambda i: i <= bound,
    }
    names = [name for i, name in enumerate(LEVELS) if tests[op](i)]
    return level.isin(names) if names else F.lit(False)


def compare_time(op: str, moment: tuple[int, int]) -> Column:
    """Comparison of the event time with a constant on the plain column, so that it reaches the scan."""
    timestamp, nanos = F.col("timestamp"), F.coalesce(F.col("ts_nanos"), F.lit(0))
    at = F.timestamp_micros(F.lit(moment[0]))
    same = timestamp == at
    tests = {
        "gt": (timestamp > at) | (same & (nanos > moment[1])),
        "gte": (timestamp > at) | (same & (nanos >= moment[1])),
        "lt": (timestamp < at) | (same & (nanos < moment[1])),
        "lte": (timestamp < at) | (same & (nanos <= moment[1])),
    }
    # The first test is implied by the second; it is the part a scan can evaluate.
    outer = timestamp >= at if op in ("gt", "gte") else timestamp <= at
    return outer & tests[op]
