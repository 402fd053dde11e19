"""Timestamps: text form, buckets, layouts and epoch numbers.

An instant is carried as microseconds (what Spark stores) plus a remainder of 0..999 nanoseconds.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberflow.functions.text import trim_space

# Microseconds from 0001-01-01, the origin buckets are counted from, to 1970-01-01.
ORIGIN_MICROS = 62_135_596_800_000_000

# Elements of a time layout with the text they accept and the Spark pattern letters.
_ELEMENTS = {
    "2006": (r"\d{4}", "yyyy"),
    "January": (r"[A-Za-z]+", "MMMM"),
    "Jan": (r"[A-Za-z]{3}", "MMM"),
    "01": (r"\d{2}", "MM"),
    "02": (r"\d{2}", "dd"),
    "03": (r"\d{2}", "hh"),
    "04": (r"\d{2}", "mm"),
    "05": (r"\d{2}", "ss"),
    "15": (r"\d{1,2}", "H"),
    "PM": (r"[AP]M", "a"),
    "Z07:00": (r"(?:Z|[+-]\d{2}:\d{2})", "XXX"),
    "-07:00": (r"[+-]\d{2}:\d{2}", "xxx"),
    "Z0700": (r"(?:Z|[+-]\d{4})", "XX"),
    "-0700": (r"[+-]\d{4}", "xx"),
    "Z07": (r"(?:Z|[+-]\d{2})", "X"),
    "-07": (r"[+-]\d{2}", "x"),
    "1": (r"\d{1,2}", "M"),
    "2": (r"\d{1,2}", "d"),
    "3": (r"\d{1,2}", "h"),
    "4": (r"\d{1,2}", "m"),
    "5": (r"\d{1,2}", "s"),
}
_TOKEN = re.compile(
    r"(?P<frac>[.,](?:0+|9+)(?!\d))|(?P<name>"
    + "|".join(re.escape(name) for name in sorted(_ELEMENTS, key=len, reverse=True))
    + r")|(?P<text>.)",
    re.S,
)
_ISO = {f"yyyy-MM-dd{sep}H:mm:ss{zone}" for sep in ("'T'", " ", "' '") for zone in ("", "XXX", "xxx")}
_UNSUPPORTED = re.compile(r"Mon|MST|_2|002")


def floor_div(value: Column, divisor: Column | int) -> Column:
    """Whole-number division towards minus infinity, exact for every bigint."""
    divisor = F.lit(divisor).cast("bigint") if isinstance(divisor, int) else divisor
    return F.call_function("div", value - F.pmod(value, divisor), divisor)


def instant(moment: datetime) -> Column:
    """Literal of an instant; one without a zone is UTC."""
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    delta = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit((delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds))


def rfc3339(timestamp: Column, ts_nanos: Column | None = None) -> Column:
    """UTC text with as many fraction digits as needed, e.g. ``2024-01-01T00:00:07.5Z``."""
    nanos = F.pmod(F.unix_micros(timestamp), F.lit(1_000_000)) * 1000
    if ts_nanos is not None:
        nanos = nanos + F.coalesce(ts_nanos, F.lit(0))
    digits = F.rtrim(F.lpad(nanos.cast("string"), 9, "0"), F.lit("0"))
    fraction = F.when(nanos == 0, "").otherwise(F.concat(F.lit("."), digits))
    return F.concat(F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def time_bucket(timestamp: Column, bucket_nanos: int) -> Column:
    """Start of the bucket, counted from year 1; a bucket that is not positive means one hour."""
    if bucket_nanos <= 0:
        bucket_nanos = 3_600_000_000_000
    if bucket_nanos % 1000:
        raise ValueError("bucket must be whole microseconds")
    micros = F.unix_micros(timestamp)
    return F.timestamp_micros(micros - F.pmod(micros + F.lit(ORIGIN_MICROS), F.lit(bucket_nanos // 1000)))


def quote(text: Column) -> Column:
    """Double-quoted text with the usual escapes, for reasons."""
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), text, F.lit('"'))


def translate_layout(layout: str) -> tuple[str, str]:
    """A layout as (accepting pattern with the fraction in group 2, Spark pattern without fraction)."""
    if _UNSUPPORTED.search(layout):
        raise ValueError(f"unsupported time layout {layout!r}")
    accept, pattern, literal, fraction_seen = "(", "", "", False
    tokens = list(_TOKEN.finditer(layout))

    def flush(literal: str) -> str:
        return "'" + literal.replace("'", "''") + "'" if re.search(r"[A-Za-z']", literal) else literal

    for i, token in enumerate(tokens):
        if token["text"] is not None:
            accept += re.escape(token["text"])
            literal += token["text"]
            continue
        if token["frac"] is not None:
            if not fraction_seen:
                digits = token["frac"][1:]
                accept += rf")[.,](\d{{{len(digits)}}})(" if digits[0] == "0" else r")(?:[.,](\d+))?("
                fraction_seen = True
            continue
        text, letters = _ELEMENTS[token["name"]]
        accept += text
        pattern += flush(literal) + letters
        literal = ""
        follows_fraction = i + 1 < len(tokens) and tokens[i + 1]["frac"] is not None
        if letters in ("ss", "s") and not follows_fraction:
            accept += r")(?:[.,](\d+))?("
            fraction_seen = True
    if not fraction_seen:
        accept += r")(\d{0})("
    return rf"\A{accept})\z", pattern + flush(literal)


def parse_layout(text: Column, layout: tuple[str, str]) -> Column:
    """Struct of micros and nanos, null when the text does not have the layout."""
    accept, pattern = layout
    clean = F.regexp_replace(text, accept, "$1$3")
    parsed = clean.try_cast("timestamp") if pattern in _ISO else F.try_to_timestamp(clean, F.lit(pattern))
    nanos = F.rpad(F.substring(F.regexp_extract(text, accept, 2), 1, 9), 9, "0").try_cast("bigint")
    # Passed through an array, both parts are computed once; written out, each of their uses would match the text again.
    parts = F.array(F.struct(F.unix_micros(parsed).alias("us"), nanos.alias("nanos")))
    known = F.filter(parts, lambda part: part["us"].isNotNull() & part["nanos"].isNotNull())
    found = F.transform(
        known,
        lambda part: F.struct(
            (part["us"] + floor_div(part["nanos"], 1000)).alias("us"), (part["nanos"] % 1000).cast("int").alias("nanos")
        ),
    )
    return F.when(text.rlike(accept), F.get(found, F.lit(0)))


DECIMAL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def with_epoch(df: DataFrame, text: Column, name: str, precise: bool = False) -> DataFrame:
    """Add a struct (us, nanos, reason) of an epoch number in seconds, milliseconds or microseconds.

    The unit is told from the size.  Whole-number division drops the part below a second of the larger
    units, and the fraction is that of the number as written; ``precise`` keeps the dropped part instead.
    Built in steps, so that shared parts are computed once and generated code stays small.
    """
    value, whole, seconds, nanos = (F.col(f"_{part}_{name}") for part in ("value", "whole", "seconds", "nanos"))
    df = df.withColumn(f"_value_{name}", F.when(text.rlike(DECIMAL), text.try_cast("double")))
    df = df.withColumn(f"_whole_{name}", F.when(F.abs(value) < F.lit(9.2e18), value.cast("bigint")))
    divisor = F.when(whole > F.lit(10**15), 1_000_000).when(whole > F.lit(10**12), 1_000).otherwise(1).cast("bigint")
    fraction = value - whole.cast("double")
    if precise:
        fraction = ((whole % divisor).cast("double") + fraction) / divisor.cast("double")
    df = df.withColumns(
        {
            f"_seconds_{name}": F.call_function("div", whole, divisor),
            f"_nanos_{name}": (fraction * F.lit(1e9)).cast("bigint"),
        }
    )
    last = F.lit(253_402_300_799)
    inside = (seconds >= 0) & (seconds <= last) & ((seconds > 0) | (nanos >= 0))
    reason = F.when(value.isNull(), F.concat(F.lit("invalid epoch timestamp "), quote(text))).when(
        ~F.coalesce(inside, F.lit(False)), "epoch timestamp out of range"
    )
    parsed = F.struct(
        F.when(inside, seconds * 1_000_000 + floor_div(nanos, 1000)).alias("us"),
        F.when(inside, F.pmod(nanos, F.lit(1000)).cast("int")).alias("nanos"),
        reason.alias("reason"),
    )
    return df.withColumn(name, parsed).drop(*[f"_{part}_{name}" for part in ("value", "whole", "seconds", "nanos")])


def with_timestamp(
    df: DataFrame, kind: Column, text: Column, layouts: Sequence[str], name: str, precise: bool = False
) -> DataFrame:
    """Add a struct (us, nanos, reason) of a raw record value.

    Numbers are epochs; text is tried against the layouts in order and then as an epoch number.
    ``kind`` is one of the raw value kinds of :mod:`timberflow.sources.json_records`.
    """
    translated = list(dict.fromkeys(translate_layout(layout) for layout in layouts))
    trimmed, parsed, epoch = F.col(f"_text_{name}"), F.col(f"_parsed_{name}"), F.col(f"_epoch_{name}")
    df = df.withColumn(f"_text_{name}", F.when(kind == "string", trim_space(text)).otherwise(text))
    df = df.withColumn(
        f"_parsed_{name}",
        F.when(kind == "string", F.coalesce(*[parse_layout(trimmed, layout) for layout in translated])),
    )
    number = (kind == "number") | ((kind == "string") & parsed.isNull() & trimmed.rlike(DECIMAL))
    df = with_epoch(df, F.when(number, trimmed), f"_epoch_{name}", precise)
    reason = (
        F.when(~kind.isin("string", "number"), F.concat(F.lit("timestamp has unsupported type "), type_name(kind)))
        .when(number, epoch["reason"])
        .when(parsed.isNotNull(), None)
        .when(trimmed == "", "timestamp is empty")
        .otherwise(F.concat(F.lit("timestamp "), quote(trimmed), F.lit(" matches no configured layout")))
    )
    result = F.struct(
        F.coalesce(parsed["us"], epoch["us"]).alias("us"),
        F.coalesce(parsed["nanos"], epoch["nanos"]).alias("nanos"),
        reason.alias("reason"),
    )
    # Exploding the one result ends the reach of filter pushdown, which would otherwise copy all the steps above
    # into each filter on the outcome.
    df = df.select("*", F.explode(F.array(result)).alias(name))
    return df.drop(f"_text_{name}", f"_parsed_{name}", f"_epoch_{name}")


def type_name(kind: Column) -> Column:
    """Type text that reasons show for a raw value kind."""
    # Type names shown in reasons.
    return (
        F.when(kind == "null", "<nil>")
        .when(kind == "bool", "bool")
        .when(kind == "object", "map[string]interface {}")
        .when(kind == "array", "[]interface {}")
        .otherwise(kind)
    )
