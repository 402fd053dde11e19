"""Scalar functions: every one builds a native Spark column expression."""

from timberflow.functions.compare import compare_level, compare_text
from timberflow.functions.fields import field_value, fields_text, group_key
from timberflow.functions.hashing import (
    audit_digest,
    event_fingerprint,
    event_id,
    hash_strings,
    incident_fingerprint,
    stable_id,
)
from timberflow.functions.levels import level_name, level_ordinal, parse_level, parse_stored_level
from timberflow.functions.text import (
    canonical_message,
    normalize_message,
    normalize_source,
    percent,
    trim_space,
)
from timberflow.functions.times import rfc3339, time_bucket, with_epoch, with_timestamp
