"""Content hashes and the ids derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberflow.functions.text import canonical_message
from timberflow.functions.times import rfc3339

_NUL = "\0"


def frame(part: Column) -> Column:
    """Byte length, colon, text, NUL."""
    return F.concat(F.octet_length(part).cast("string"), F.lit(":"), part, F.lit(_NUL))


def hash_strings(*parts: Column) -> Column:
    return F.sha2(F.concat(*[frame(part) for part in parts]), 256)


def stable_id(namespace: str, *parts: Column) -> Column:
    return F.substring(hash_strings(F.lit(namespace), *parts), 1, 24)


def event_fingerprint(source: Column, level: Column, message: Column, fields: Column) -> Column:
    """Hash of the content of an event: time and ``volatile.`` fields do not count, nor do numbers in the message."""
    lasting = F.map_filter(fields, lambda key, _: ~F.lower(key).startswith("volatile."))
    framed = F.transform(
        F.sort_array(F.map_entries(lasting)), lambda entry: frame(F.concat(entry["key"], F.lit("="), entry["value"]))
    )
    head = F.concat(frame(source), frame(level), frame(canonical_message(message)))
    return F.sha2(F.concat(head, F.coalesce(F.array_join(framed, ""), F.lit(""))), 256)


def event_id(timestamp: Column, ts_nanos: Column, source: Column, level: Column, fingerprint: Column) -> Column:
    return stable_id("event", rfc3339(timestamp, ts_nanos), source, level, fingerprint)


def incident_fingerprint(rule: Column, group: Column, fingerprints: Column) -> Column:
    """Hash over the sorted event fingerprints of one detection, repeats kept."""
    body = F.array_join(F.sort_array(fingerprints), "\n")
    return F.sha2(F.concat(rule, F.lit(_NUL), group, F.lit(_NUL), body, F.lit("\n")), 256)


def audit_digest(
    sequence: Column, time: Column, action: Column, subject: Column, previous: Column, details: Column
) -> Column:
    head = [sequence.cast("string"), rfc3339(time), action, subject, previous]
    pairs = F.transform(
        F.sort_array(F.map_entries(details)),
        lambda entry: F.concat(entry["key"], F.lit(_NUL), entry["value"], F.lit(_NUL)),
    )
    framed = [part for text in head for part in (F.coalesce(text, F.lit("")), F.lit(_NUL))]
    return F.sha2(F.concat(*framed, F.coalesce(F.array_join(pairs, ""), F.lit(""))), 256)
