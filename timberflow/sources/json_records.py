"""Strict decoding of JSON objects into raw records.

A raw record is ``map<string, struct<kind, text>>``: the kind of the JSON value (string, number, bool, null,
object, array) and its text, numbers as written.  Flat objects without escapes, which is what most log lines
are, are checked and taken apart by regular expressions in the JVM.  Only the other lines go to Python.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INVALID = "invalid_json"

_WS = r"[ \t\r\n]*+"
_TEXT = r'"[^"\\\x00-\x1f]*+"'
_NUMBER = r"-?+(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+"
_VALUE = rf"(?:{_TEXT}|{_NUMBER}|true|false|null)"
_MEMBER = rf"{_WS}{_TEXT}{_WS}:{_WS}{_VALUE}{_WS}"
_FLAT = rf"\A{_WS}\{{(?:{_MEMBER}(?:,{_MEMBER})*+|{_WS})\}}{_WS}\z"
_PAIR = rf'"([^"]*+)"{_WS}:{_WS}("[^"]*+"|[^",\s}}]++)'

_PARTS = "keys:array<string>,kinds:array<string>,texts:array<string>"
_SURROGATE = re.compile("[\ud800-\udfff]")


class _Number(str):
    """Number literal as written."""


def _refuse(_):
    raise ValueError("not a JSON value")


def _decode(text: str):
    return json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_refuse)


def _whole(text: str) -> str:
    """Text in which half surrogate pairs are replaced, so that it can be encoded."""
    return _SURROGATE.sub("�", text)


def _scalar(value) -> tuple[str, str]:
    if isinstance(value, _Number):
        return "number", str(value)
    if isinstance(value, str):
        return "string", _whole(value)
    if isinstance(value, bool):
        return "bool", "true" if value else "false"
    if value is None:
        return "null", ""
    return ("object" if isinstance(value, dict) else "array"), ""


def _parts(record: dict) -> tuple[list, list, list]:
    pairs = [(_whole(key), *_scalar(value)) for key, value in record.items()]
    keys, kinds, texts = zip(*dict((pair[0], pair) for pair in pairs).values()) if pairs else ((), (), ())
    return list(keys), list(kinds), list(texts)


def _decode_lines(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        if text is None:
            rows.append((None, None, None, None))
            continue
        try:
            record = _decode(text)
            if record is not None and not isinstance(record, dict):
                raise ValueError("not an object")
            rows.append((None, *_parts(record or {})))
        except (ValueError, RecursionError):
            rows.append((INVALID, None, None, None))
    return pd.DataFrame(rows, columns=["error", "keys", "kinds", "texts"])


def _decode_documents(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        try:
            document = _decode(text)
            records = document if isinstance(document, list) else [document]
            if any(record is not None and not isinstance(record, dict) for record in records):
                raise ValueError("not an object")
            parts = [_parts(record or {}) for record in records]
            rows.append((None, [{"keys": k, "kinds": n, "texts": t} for k, n, t in parts]))
        except (ValueError, RecursionError):
            rows.append((INVALID, None))
    return pd.DataFrame(rows, columns=["error", "records"])


def _record(keys: Column, kinds: Column, texts: Column) -> Column:
    pair = lambda kind, text: F.struct(kind.alias("kind"), text.alias("text"))
    return F.map_from_arrays(keys, F.zip_with(kinds, texts, pair))


def with_record(lines: DataFrame, text: str = "text") -> DataFrame:
    """Add ``record`` and ``error`` (null or the reason) decoded from a text column."""
    valid = F.make_valid_utf8(F.col(text))
    flat = lines.withColumn(text, valid).withColumn("_flat", F.col(text).rlike(_FLAT))
    flat = flat.withColumns(
        {
            "_keys": F.when(F.col("_flat"), F.regexp_extract_all(text, F.lit(_PAIR), 1)),
            "_values": F.when(F.col("_flat"), F.regexp_extract_all(text, F.lit(_PAIR), 2)),
        }
    )
    # Of a repeated key the last value counts, which the Python decoder knows.
    distinct = F.size(F.array_distinct("_keys")) == F.size("_keys")
    flat = flat.withColumn("_fast", F.col("_flat") & F.coalesce(distinct, F.lit(False)))
    decode = F.pandas_udf(_decode_lines, f"struct<error:string,{_PARTS}>")
    slow = flat.withColumn("_slow", decode(F.when(~F.col("_fast"), F.col(text))))

    def typed(value: Column) -> Column:
        first = F.substring(value, 1, 1)
        kind = F.when(first == '"', "string").when(first == "n", "null").when(first.isin("t", "f"), "bool")
        body = F.when(first == '"', F.substr(value, F.lit(2), F.length(value) - 2)).when(first == "n", "")
        return F.struct(
            kind.otherwise("number").alias("kind"), body.otherwise(value).alias("text")
        )

    fast_record = F.map_from_arrays("_keys", F.transform("_values", typed))
    parts = F.col("_slow")
    slow_record = _record(parts["keys"], parts["kinds"], parts["texts"])
    record = F.when(F.col("_fast"), fast_record).when(parts["error"].isNull(), slow_record)
    return slow.withColumns({"record": record, "error": parts["error"]}).drop(
        "_flat", "_keys", "_values", "_fast", "_slow"
    )


def explode_documents(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row per record of whole JSON documents (an object or an array of objects) with ``line`` = position.

    A document that is anything else stops the job.
    """
    decode = F.pandas_udf(_decode_documents, f"struct<error:string,records:array<struct<{_PARTS}>>>")
    decoded = documents.withColumn(text, F.make_valid_utf8(F.col(text))).withColumn("_decoded", decode(F.col(text)))
    failed = F.raise_error(F.concat(F.lit("JSON document is not an object or an array of objects: "), F.col("file")))
    records = F.when(F.col("_decoded.error").isNotNull(), failed.cast(f"array<struct<{_PARTS}>>")).otherwise(
        F.col("_decoded.records")
    )
    rows = decoded.select(*documents.columns, F.posexplode(records).alias("_pos", "_item")).withColumn(
        "line", F.col("_pos").cast("bigint") + 1
    )
    item = F.col("_item")
    return rows.withColumns(
        {"record": _record(item["keys"], item["kinds"], item["texts"]), "error": F.lit(None).cast("string")}
    ).drop("_pos", "_item")

