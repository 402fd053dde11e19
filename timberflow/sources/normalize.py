"""Raw records to events, with the first reason a record is rejected for."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberflow import schemas
from timberflow.functions.hashing import event_fingerprint, event_id
from timberflow.functions.levels import parse_level
from timberflow.functions.text import normalize_message, normalize_source
from timberflow.functions.times import ORIGIN_MICROS, instant, quote, type_name, with_timestamp
from timberflow.settings import LogSource


def merge_static(fields: Column, static: Mapping[str, str]) -> Column:
    """Fields with the static ones added; a static field replaces one of the same name."""
    if not static:
        return fields
    pairs = F.create_map(*[F.lit(text) for item in static.items() for text in item])
    return F.map_concat(F.map_filter(fields, lambda key, _: ~key.isin(list(static))), pairs)


def cut_raw(text: Column, most: int | None) -> Column:
    """The text, or its first ``most`` bytes, where a character cut in two is replaced."""
    return text if most is None else F.make_valid_utf8(F.substring(text.cast("binary"), 1, most).cast("string"))


def _not_scalar(entry: Column) -> Column:
    return entry["kind"].isin("object", "array")


def _expected_scalar(prefix: str, entry: Column) -> Column:
    return F.concat(F.lit(f"{prefix}: expected scalar, got "), type_name(entry["kind"]))


def normalize(records: DataFrame, source: LogSource, now: datetime, precise_epochs: bool = False, raw_bytes: int | None = None) -> DataFrame:
    """Tagged table: event columns plus ``reason`` (null for a good record), ``raw`` and what the input adds.

    Needs columns line, raw, record and error.  Checks run in a fixed order and the first failure counts.
    """
    names = {
        "time": source.time_field,
        "level": source.level_field,
        "source": source.source_field,
        "message": source.message_field,
    }
    entry = {part: F.try_element_at("record", F.lit(name)) for part, name in names.items()}
    staged = records.withColumns({f"_{part}": value for part, value in entry.items()})
    time, level, origin, message = (F.col(f"_{part}") for part in names)
    staged = with_timestamp(staged, time["kind"], time["text"], source.timestamp_layouts, "_at", precise_epochs)
    level_text = F.coalesce(level["text"], F.lit(""))
    origin_text = F.coalesce(F.nullif(origin["text"], F.lit("")), F.lit(source.source))
    reserved = list(names.values())
    extra = F.map_filter("record", lambda key, _: ~key.isin(reserved))
    staged = staged.withColumns(
        {
            "_extra": F.coalesce(extra, F.create_map().cast("map<string,struct<kind:string,text:string>>")),
            "level": parse_level(level_text),
            "source": normalize_source(origin_text),
            "message": normalize_message(message["text"]),
        }
    )
    nested = F.array_min(F.map_keys(F.map_filter("_extra", lambda _, value: _not_scalar(value))))
    staged = staged.withColumn("_nested", nested)
    nested_entry = F.try_element_at("_extra", F.col("_nested"))
    # Reasons, in the order the checks run.
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(time.isNull(), F.concat(F.lit("missing timestamp field "), quote(F.lit(source.time_field))))
        .when(F.col("_at.reason").isNotNull(), F.col("_at.reason"))
        .when(F.coalesce(_not_scalar(level), F.lit(False)), _expected_scalar("level field", level))
        .when(F.col("level").isNull(), F.concat(F.lit("unknown level "), quote(level_text)))
        .when(F.coalesce(_not_scalar(origin), F.lit(False)), _expected_scalar("source field", origin))
        .when(F.col("source") == "", "normalized source is empty")
        .when(message.isNull(), F.concat(F.lit("missing message field "), quote(F.lit(source.message_field))))
        .when(_not_scalar(message), _expected_scalar("message field", message))
        .when(F.col("message") == "", "message is empty")
        .when(
            F.col("_nested").isNotNull(),
            F.concat(
                F.lit("field "), quote(F.col("_nested")), F.lit(": expected scalar, got "), type_name(nested_entry["kind"])
            ),
        )
        .when((F.col("_at.us") == -ORIGIN_MICROS) & (F.col("_at.nanos") == 0), "event timestamp is required")
    )
    texts = F.transform_values("_extra", lambda _, value: value["text"])
    # As with the time, exploding keeps filters on the reason from computing all checks a second time.
    staged = staged.select("*", F.explode(F.array(reason)).alias("reason"))
    staged = staged.withColumns(
        {
            "timestamp": F.timestamp_micros("_at.us"),
            "ts_nanos": F.col("_at.nanos"),
            "fields": merge_static(texts, source.static_fields),
            "input": F.lit(source.name),
            "ingested_at": instant(now),
        }
    )
    content = event_fingerprint(F.col("source"), F.col("level"), F.col("message"), F.col("fields"))
    staged = staged.withColumn("fingerprint", F.when(F.col("reason").isNull(), content))
    identity = event_id(F.col("timestamp"), F.col("ts_nanos"), F.col("source"), F.col("level"), F.col("fingerprint"))
    staged = staged.withColumn("id", F.when(F.col("reason").isNull(), identity))
    return staged.select(*schemas.EVENTS, "reason", cut_raw(F.col("raw"), raw_bytes).alias("raw"), "file", "joined")
