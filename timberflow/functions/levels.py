"""Severity levels: names, aliases and ordinals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberflow.functions.text import trim_space

# Level names in ordinal order, and the accepted aliases.
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
ALIASES = {
    "VERBOSE": "TRACE",
    "INFORMATION": "INFO",
    "NOTICE": "INFO",
    "WARNING": "WARN",
    "ERR": "ERROR",
    "SEVERE": "ERROR",
    "CRITICAL": "FATAL",
    "CRIT": "FATAL",
    "PANIC": "FATAL",
}
_NAMES = {name: name for name in LEVELS} | ALIASES


def level_ordinal_of(text: str) -> int:
    """Ordinal of a level constant; unknown names are an error when the plan is built."""
    name = _NAMES.get(text.strip().upper())
    if name is None:
        raise ValueError(f"unknown level {text!r}")
    return LEVELS.index(name)


def _lookup(table: dict) -> Column:
    return F.create_map(*[F.lit(part) for item in table.items() for part in item])


def parse_level(text: Column) -> Column:
    """Canonical level name, null when the text names no level."""
    return F.try_element_at(_lookup(_NAMES), F.upper(trim_space(text)))


def level_ordinal(level: Column) -> Column:
    """Ordinal 0..5 of a canonical level name."""
    return F.try_element_at(_lookup({name: i for i, name in enumerate(LEVELS)}), level)


def level_name(ordinal: Column) -> Column:
    """Name of an ordinal, UNKNOWN outside 0..5."""
    names = _lookup(dict(enumerate(LEVELS)))
    return F.coalesce(F.try_element_at(names, ordinal.cast("int")), F.lit("UNKNOWN"))


def parse_stored_level(text: Column) -> Column:
    """Level of a stored row, which may hold a name or an ordinal; null when it is neither."""
    ordinal = F.when(text.rlike(r"^[0-5]$"), text.try_cast("int"))
    return F.coalesce(parse_level(text), F.try_element_at(_lookup(dict(enumerate(LEVELS))), ordinal))
