"""Rule predicates compiled to boolean columns that are never null."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberflow.functions.compare import compare_level, compare_text, compare_time, instant_of
from timberflow.functions.fields import field_value, group_key
from timberflow.settings import Predicate, Rule, enabled_rules

_FOREIGN = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k|\\[GZXRH]|[*+?}]\+")


def java_pattern(pattern: str) -> str:
    """Pattern in the linear-time dialect rules are written in, as a Java pattern.

    Only what differs is touched: group names, the end anchor, brackets and ``&&`` inside classes, and the
    meaning of ``.`` (everything but LF).  Constructs the rule dialect lacks are refused.
    """
    if _FOREIGN.search(re.sub(r"\\[\\.*+?()\[\]{}|^$]", "", pattern)):
        raise ValueError(f"unsupported regular expression {pattern!r}")
    multiline = re.search(r"\(\?[a-zA-Z]*m", pattern) is not None
    out, in_class, i = [], False, 0
    while i < len(pattern):
        rest = pattern[i:]
        named = re.match(r"\[:(\^?)(\w+):\]", rest) if in_class else None
        if rest[0] == "\\" and len(rest) > 1:
            out.append(rest[:2])
            i += 2
            continue
        if named:
            name = {"word": "w"}.get(named[2], named[2].capitalize() if named[2] != "xdigit" else "XDigit")
            name = "ASCII" if name == "Ascii" else name
            out.append(("\\W" if named[1] else "\\w") if name == "w" else ("\\P{" if named[1] else "\\p{") + name + "}")
            i += len(named[0])
            continue
        if in_class:
            if rest[0] == "]" and i > opened:
                in_class = False
                out.append("]")
            else:
                out.append("\\" + rest[0] if rest[0] in "[&]" else rest[0])
            i += 1
            continue
        if rest[0] == "[":
            in_class = True
            negated = rest[1:2] == "^"
            out.append("[^" if negated else "[")
            i += 2 if negated else 1
            opened = i
            continue
        if rest.startswith("(?P<"):
            out.append("(?<")
            i += 4
            continue
        out.append("\\z" if rest[0] == "$" and not multiline else rest[0])
        i += 1
    return "(?d)" + "".join(out)


def predicate_column(predicate: Predicate) -> Column:
    """Two-valued test of one predicate; an absent field counts as the operation defines."""
    name, op, value = predicate.field, predicate.op, predicate.value
    actual = field_value(name)
    exists = actual.isNotNull()
    lowered = F.lower(actual)
    wanted = F.lower(F.lit(value))
    if op == "exists":
        matched = exists if value.lower() != "false" else ~exists
    elif op == "eq":
        matched = _equals(name, actual, value)
    elif op == "ne":
        matched = ~F.coalesce(_equals(name, actual, value), F.lit(False))
    elif op == "contains":
        matched = F.contains(lowered, wanted)
    elif op == "prefix":
        matched = F.startswith(lowered, wanted)
    elif op == "suffix":
        matched = F.endswith(lowered, wanted)
    elif op == "regex":
        matched = actual.rlike(java_pattern(value))
    elif op == "in":
        matched = reduce(lambda a, b: a | b, [_equals(name, actual, item) for item in predicate.values])
    elif name.lower() == "level":
        matched = compare_level(F.col("level"), op, value)
    elif name.lower() in ("timestamp", "time") and instant_of(value) is not None:
        matched = compare_time(op, instant_of(value))
    else:
        sign = compare_text(actual, value)
        matched = {"gt": sign > 0, "gte": sign >= 0, "lt": sign < 0, "lte": sign <= 0}[op] & exists
    matched = F.coalesce(matched, F.lit(False))
    return ~matched if predicate.negate else matched


def _equals(name: str, actual: Column, value: str) -> Column:
    # Level names hold upper case only, so the plain column can be tested by the scan.
    if name.lower() == "level":
        return F.col("level") == value.upper()
    return F.lower(actual) == F.lower(F.lit(value))


def rule_column(rule: Rule) -> Column:
    """All of ``all`` and, if there are any, one of ``any``."""
    tests = [predicate_column(predicate) for predicate in rule.all]
    if rule.any:
        tests.append(reduce(lambda a, b: a | b, [predicate_column(predicate) for predicate in rule.any]))
    return reduce(lambda a, b: a & b, tests, F.lit(True)) if tests else F.lit(True)


def match_rule(events: DataFrame, rule: Rule) -> DataFrame:
    return events.filter(rule_column(rule))


def match_rules(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Each event once per enabled rule it matches, with ``rule_id`` and ``grp``: one scan for all rules."""
    active = enabled_rules(rules)
    if not active:
        return events.select(F.lit("").alias("rule_id"), F.lit("").alias("grp"), "*").limit(0)
    # Tested before they are shaped as well: ids and fingerprints of events that no rule wants need not be computed.
    events = events.filter(reduce(lambda a, b: a | b, [rule_column(rule) for rule in active]))
    candidates = [
        F.when(
            rule_column(rule), F.struct(F.lit(rule.id).alias("rule_id"), group_key(rule.group_by).alias("grp"))
        )
        for rule in active
    ]
    hits = F.explode(F.array_compact(F.array(*candidates)))  # no rows where no rule matches
    return events.select(hits.alias("hit"), "*").select("hit.rule_id", "hit.grp", "*").drop("hit")
