"""Threshold detection over sliding windows with group keys and cooldown."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberflow import schemas
from timberflow.functions.hashing import incident_fingerprint, stable_id
from timberflow.functions.levels import LEVELS, level_ordinal_of
from timberflow.functions.times import floor_div, instant, rfc3339
from timberflow.operators.folders import remove
from timberflow.operators.positions import merge_ranges, rank_and_before, small, stored_position
from timberflow.operators.predicates import match_rules
from timberflow.session import materialize, scratch_path, store
from timberflow.settings import Rule, check_rules, enabled_rules

KEYS = ["rule_id", "grp"]

# Candidates of one group that one task follows through cooldown.
CHAIN_ROWS = 65_536

# Rows of one group per block when windows are matched with their rows, and least ranks of a page that windows are cut from.
BLOCK_ROWS = 4096

# Windows of one instant that are unfolded at a time.
UNFOLD_ROWS = 65_536


def per_rule(rules: Sequence[Rule], value, kind: str) -> Column:
    """Literal lookup of a rule setting by the row's rule id."""
    pairs = [part for rule in rules for part in (F.lit(rule.id), F.lit(value(rule)).cast(kind))]
    return F.try_element_at(F.create_map(*pairs), F.col("rule_id"))


@dataclass
class Detection:
    """Tables of one run.

    ``rows`` are the matched rows with their rank ``rn`` in their group, ``moments`` the instants of each group with what
    windows that end there begin after, ``windows`` the fired ones.  Only ``rows`` have ids and fingerprints, once each.
    """

    rules: Sequence[Rule]
    events: DataFrame
    rows: DataFrame
    moments: DataFrame
    windows: DataFrame

    @property
    def counted(self) -> DataFrame:
        """Per matched row: ``rn`` in its group, ``lo`` = first rank inside the window, ``cnt`` = rows in it.

        Rows of the same instant that come later by id are not counted.
        """
        at = self.moments.select(*[F.col(name).alias(f"_{name}") for name in [*KEYS, "us", "nanos"]], "before")
        same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in [*KEYS, "us", "nanos"]]
        return _begun(self.rows.join(at, same)).drop("before", *at.columns)

    @property
    def candidates(self) -> DataFrame:
        counted = self.counted
        return counted.filter(F.col("cnt") >= _thresholds(enabled_rules(self.rules)))

    @property
    def fired(self) -> DataFrame:
        """The rows at which windows fired, with the columns of ``counted``."""
        return self.rows.join(self.windows.select(*KEYS, "rn", "lo", "cnt"), [*KEYS, "rn"])


def _begun(ends: DataFrame) -> DataFrame:
    lo = F.least(F.col("before") + 1, F.col("rn"))
    return ends.withColumn("lo", lo).withColumn("cnt", F.col("rn") - F.col("lo") + 1)


def _thresholds(active: Sequence[Rule]) -> Column:
    return per_rule(active, lambda rule: rule.threshold, "bigint") if active else F.lit(1)


def matched_rows(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The few columns detection needs, once per matching rule, with a row number and the rank ``rn`` in the group."""
    slim = match_rules(events, rules).select(
        *KEYS,
        F.unix_micros("timestamp").alias("us"),
        F.coalesce(F.col("ts_nanos"), F.lit(0)).alias("nanos"),
        "id",
        "fingerprint",
    )
    spark = events.sparkSession
    path = scratch_path(spark, "matched")  # range partitioning reads its rows twice, which are shaped once
    slim = store(slim.withColumn("_row", F.monotonically_increasing_id()), path)
    rows = stored_position(slim, ["us", "nanos", "id", "_row"], KEYS, "rn")
    remove(spark, path)
    return rows


def sliding_moments(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Per group and instant: ``n`` rows, ``rn`` = rank of the last, ``before`` = rows earlier than a window that ends there,
    ``start`` = rank of the first that has its rule's threshold of rows in its window (beyond ``rn`` if none has).

    Windows that end at one instant begin at one instant, so rows of the same instant are told apart by their ranks alone.
    """
    moments = rows.groupBy(*KEYS, "us", "nanos").agg(F.count("*").alias("n"))
    if not rules:
        return moments.select("*", *[F.lit(None).cast("bigint").alias(name) for name in ("rn", "before", "start")]).limit(0)
    moments = materialize(moments.withColumn("_row", F.monotonically_increasing_id()))
    back = -per_rule(rules, lambda rule: rule.window_nanos, "bigint")
    ranked = rank_and_before(moments, KEYS, back, "_row", ties=None, weight="n")
    # A window holds its own row at least, wherever it begins.
    first, threshold = F.col("rn") - F.col("n") + 1, _thresholds(rules)
    start = F.when(threshold <= 1, first).otherwise(F.greatest(first, F.col("before") + threshold))
    return materialize(ranked.withColumn("start", start).drop("_row"))


def _follow(nodes: pd.DataFrame, entry: int) -> tuple[list[int], int]:
    """Places of the rows that fire in one block from the given rank on, and the rank at which the chain leaves it."""
    base, after = int(nodes["rn"].iloc[0]), nodes["next"].to_numpy()
    fired, at = [], entry - base
    while at < len(after):
        fired.append(at)
        at = int(after[at]) - base
    return fired, at + base


def _hops(nodes: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """For each rank at which a chain may enter the block: the rank at which it leaves it."""
    nodes = nodes.sort_values("rn", ignore_index=True)
    base, last = (int(nodes["rn"].iloc[0]), int(nodes["rn"].iloc[-1])) if len(nodes) else (1, 0)
    entries = entries[(entries["rn"] >= base) & (entries["rn"] <= last)]
    leaves = nodes["next"].to_numpy().copy()
    for k in range(len(leaves) - 1, -1, -1):
        if leaves[k] <= last:
            leaves[k] = leaves[leaves[k] - base]
    return entries[[*KEYS, "rn"]].assign(next=leaves[entries["rn"].to_numpy() - base])


def _walk(nodes: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """Rows of the block that fire; a chain enters a block at most once."""
    if not len(entries) or not len(nodes):
        return pd.DataFrame({"_row": pd.Series([], dtype="int64")})
    nodes = nodes.sort_values("rn", ignore_index=True)
    return nodes.iloc[_follow(nodes, int(entries["rn"].iloc[0]))[0]][["_row"]]


def _entries(nodes: DataFrame, starts: DataFrame, block) -> DataFrame:
    """Where each group's chain enters its blocks, beside the start.

    Only ranks that a row of an earlier block points to can be entered, and only they get a hop over their block; hops are
    followed with doubled reach, so the rounds are the logarithm of the number of blocks of the largest group.
    """
    crossing = nodes.filter(block("next") > block("rn")).select(*KEYS, F.col("next").alias("rn")).distinct()
    entries = materialize(crossing)
    if entries.isEmpty():
        return starts
    entries = entries.unionByName(starts).distinct()
    grouped = lambda df: df.withColumn("_block", block("rn")).groupBy(*KEYS, "_block")
    hop = "rule_id string, grp string, rn long, next long"
    hops = materialize(grouped(nodes).cogroup(grouped(entries)).applyInPandas(_hops, hop))
    reached, step, known = starts, hops, -1
    while True:
        moved = reached.join(step, [*KEYS, "rn"]).select(*KEYS, F.col("next").alias("rn"))
        # A pointer past the end of the group has no hop and drops out here.
        reached = materialize(reached.unionByName(moved).distinct().join(hops.select(*KEYS, "rn"), [*KEYS, "rn"], "left_semi"))
        total = reached.count()
        if total == known:
            return reached
        known = total
        targets = step.select(*KEYS, F.col("rn").alias("next"), F.col("next").alias("_after"))
        step = materialize(step.join(targets, [*KEYS, "next"]).select(*KEYS, "rn", F.col("_after").alias("next")))


def fired_windows(moments: DataFrame, rules: Sequence[Rule], chain_rows: int = CHAIN_ROWS) -> DataFrame:
    """Windows left after cooldown: none fired before in the group, or at least a cooldown ago.

    With a cooldown only the first candidate of an instant can fire.  Each such instant points to the first one a cooldown
    later.  The chain from a group's first candidate is followed in blocks of ``chain_rows`` instants, all at once: first the
    hop over each block from every place at which it can be entered, then the blocks that a chain enters, then its places in
    them.  Groups of all sizes take this way.
    """
    ends = moments.filter(F.col("start") <= F.col("rn"))
    if not rules:
        return _begun(ends).select(*KEYS, "us", "nanos", "rn", "lo", "cnt")
    cooldown = per_rule(rules, lambda rule: rule.cooldown_nanos, "bigint")
    always = ends.filter(cooldown <= 0).withColumn("_from", F.explode(F.sequence("start", "rn", F.lit(UNFOLD_ROWS))))
    upto = F.least(F.col("_from") + UNFOLD_ROWS - 1, F.col("rn"))
    always = always.withColumn("rn", F.explode(F.sequence("_from", upto)))
    waiting = materialize(
        ends.filter(cooldown > 0)
        .select(*KEYS, "us", "nanos", "before", F.col("start").alias("first"))
        .withColumn("_row", F.monotonically_increasing_id())
    )
    ranked = rank_and_before(waiting.select(*KEYS, "us", "nanos", "_row"), KEYS, cooldown, "_row", ties=None)
    later = F.greatest("rn", "before") + 1  # an instant that is not known ends its own cooldown
    nodes = materialize(ranked.select(*KEYS, "_row", "rn", later.alias("next")))
    block = lambda rank: floor_div(F.col(rank) - 1, chain_rows)
    starts = nodes.filter("rn = 1").select(*KEYS, "rn")
    grouped = lambda df: df.withColumn("_block", block("rn")).groupBy(*KEYS, "_block")
    entered = grouped(nodes).cogroup(grouped(_entries(nodes, starts, block))).applyInPandas(_walk, "_row bigint")
    chained = waiting.join(entered, "_row", "left_semi").withColumn("rn", F.col("first"))
    columns = [*KEYS, "us", "nanos", "rn", "before"]
    return _begun(always.select(*columns).unionByName(chained.select(*columns))).drop("before")


def detect(events: DataFrame, rules: Sequence[Rule], chain_rows: int = CHAIN_ROWS) -> Detection:
    active = enabled_rules(rules)
    rows = matched_rows(events, active)
    moments = sliding_moments(rows, active)
    windows = store(fired_windows(moments, active, chain_rows), scratch_path(events.sparkSession, "windows"))
    return Detection(check_rules(rules), events, rows, moments, windows)


def detection_events(run: Detection) -> DataFrame:
    """One row per fired window and event in it.

    Windows and rows meet on blocks of ranks, so a large group is spread and no key pairs more than a block.
    """
    block = lambda rank: floor_div(rank, BLOCK_ROWS)
    windows = run.fired.select(
        *KEYS,
        F.col("_row").alias("fired_row"),
        "lo",
        F.col("rn").alias("hi"),
        F.explode(F.sequence(block(F.col("lo")), block(F.col("rn")))).alias("_block"),
    )
    rows = run.rows.select(*KEYS, "rn", "us", "nanos", "id", "fingerprint", block(F.col("rn")).alias("_block"))
    return windows.join(rows, [*KEYS, "_block"]).filter(F.col("rn").between(F.col("lo"), F.col("hi"))).drop("_block")


def fired_ranges(run: Detection) -> DataFrame:
    """The ranks that fired windows cover: disjoint ranges ``lo`` .. ``rn`` per key, however much the windows overlap."""
    return merge_ranges(run.windows, KEYS, "lo", "rn")


def _held_rows(run: Detection, ranges: DataFrame) -> DataFrame:
    """The rows inside disjoint ranges ``lo`` .. ``rn``.

    Ranges and rows meet on blocks of ranks; as ranges do not overlap, a row meets one at most that holds it.
    """
    block = lambda rank: floor_div(rank, BLOCK_ROWS)
    ranges = ranges.select(
        *KEYS, "lo", F.col("rn").alias("hi"), F.explode(F.sequence(block(F.col("lo")), block(F.col("rn")))).alias("_block")
    )
    rows = run.rows.select(*KEYS, "rn", "us", "nanos", "id", "fingerprint", block(F.col("rn")).alias("_block"))
    return rows.join(ranges, [*KEYS, "_block"]).filter(F.col("rn").between(F.col("lo"), F.col("hi"))).drop("_block", "lo", "hi")


def covered_events(run: Detection) -> DataFrame:
    """The rows that some fired window holds, each once."""
    return _held_rows(run, fired_ranges(run))


def first_fired(run: Detection) -> Detection:
    """The same run with only the first fired window of each key, and the rows it holds."""
    first = run.windows.groupBy(*KEYS).agg(F.min("rn").alias("rn"))
    windows = materialize(run.windows.join(first, [*KEYS, "rn"], "left_semi"))
    return replace(run, rows=_held_rows(run, windows), windows=windows)


def _windows(run: Detection) -> DataFrame:
    """Per fired window: first and last moment, count, event ids and fingerprints.

    Rows are laid side by side on pages of ranks, and each window is cut out of the one page that its end is on.  A rule's
    pages are as long as its widest window, so a row lies on its own page and the next at most, and there only if a window of
    that page reaches to it: only rows are shuffled, never what the windows hold, and none that no window holds.
    """
    active = enabled_rules(run.rules)
    widths = run.windows.groupBy("rule_id").agg(F.max("cnt").alias("widest")).collect()  # one row per rule
    widest = {row["rule_id"]: row["widest"] for row in widths}
    step = per_rule(active, lambda rule: max(BLOCK_ROWS, widest.get(rule.id, 0)), "bigint")
    page = F.call_function("div", F.col("rn"), step)
    windows = run.windows.select(*KEYS, "lo", F.col("rn").alias("hi"), page.alias("_page"))
    reach = small(windows.groupBy(*KEYS, "_page").agg(F.min("lo").alias("_from"), F.max("hi").alias("_to")))
    reaches = F.col("rn") + per_rule(active, lambda rule: widest.get(rule.id, 1) - 1, "bigint")
    member = F.struct("rn", "us", "nanos", "id", "fingerprint")
    placed = run.rows.filter(F.col("rule_id").isin(list(widest))).select(
        *KEYS, member.alias("member"), F.explode(F.sequence(page, F.call_function("div", reaches, step))).alias("_page")
    )
    held = placed.join(reach, [*KEYS, "_page"]).filter(F.col("member.rn").between(F.col("_from"), F.col("_to")))
    pages = held.groupBy(*KEYS, "_page").agg(F.sort_array(F.collect_list("member")).alias("members"))
    # Ranks have no gaps, so a rank's place on its page is its distance from the first one there.
    begin = (F.col("lo") - F.col("members")[0]["rn"] + 1).cast("int")
    inside = F.slice("members", begin, (F.col("hi") - F.col("lo") + 1).cast("int"))
    at = lambda rank: F.element_at("members", (F.col(rank) - F.col("members")[0]["rn"] + 1).cast("int"))
    moment = lambda row: F.struct(row["us"].alias("us"), row["nanos"].alias("nanos"))
    return windows.join(pages, [*KEYS, "_page"]).select(
        *KEYS,
        moment(at("lo")).alias("first"),
        moment(at("hi")).alias("last"),
        (F.col("hi") - F.col("lo") + 1).alias("count"),
        F.sort_array(F.array_distinct(inside["id"])).alias("event_ids"),
        inside["fingerprint"].alias("fingerprints"),
        F.col("hi").alias("fired_rn"),
    )


def detected_incidents(run: Detection, now: datetime) -> DataFrame:
    """One new incident row per fired window (columns of the incidents table plus ``fired_row`` order)."""
    active = enabled_rules(run.rules)
    if not active:
        return run.events.sparkSession.createDataFrame([], schemas.ddl(schemas.INCIDENTS) + ", fired_rn bigint")
    return incident_columns(_windows(run), active, instant(now))


def incident_columns(windows: DataFrame, active: Sequence[Rule], at: Column) -> DataFrame:
    """Incident rows of windows given by ``first`` and ``last`` moment, count, event ids, fingerprints and ``fired_rn``."""
    first_seen = F.timestamp_micros("first.us")
    reason = lambda rule: f"threshold {rule.threshold} reached in {rule.window}"
    labels = F.create_map(
        *[
            part
            for rule in active
            for part in (
                F.lit(rule.id),
                F.create_map(*[F.lit(text) for item in sorted(rule.labels.items()) for text in item]).cast(
                    "map<string,string>"
                ),
            )
        ]
    )
    severity = lambda rule: LEVELS[level_ordinal_of(rule.severity)]
    return windows.select(
        stable_id("incident", F.col("rule_id"), F.col("grp"), rfc3339(first_seen, F.col("first.nanos"))).alias("id"),
        "rule_id",
        per_rule(active, lambda rule: rule.title, "string").alias("title"),
        F.lit("open").alias("status"),
        per_rule(active, severity, "string").alias("severity"),
        F.col("grp").alias("group"),
        incident_fingerprint(F.col("rule_id"), F.col("grp"), F.col("fingerprints")).alias("fingerprint"),
        first_seen.alias("first_seen"),
        F.timestamp_micros("last.us").alias("last_seen"),
        at.alias("opened_at"),
        at.alias("updated_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
        "count",
        "event_ids",
        F.try_element_at(labels, F.col("rule_id")).alias("labels"),
        F.array(
            F.struct(
                at.alias("at"),
                F.lit(None).cast("string").alias("from"),
                F.lit("open").alias("to"),
                per_rule(active, reason, "string").alias("reason"),
            )
        ).alias("history"),
        "fired_rn",
    )


def evaluations(run: Detection) -> DataFrame:
    """Per rule: events examined, matched, windows triggered and candidates suppressed; zeros when disabled."""
    spark = run.events.sparkSession
    rules = spark.createDataFrame([(rule.id, rule.enabled) for rule in run.rules], "rule_id string, enabled boolean")
    per = lambda df, name: df.groupBy("rule_id").agg(F.count("*").alias(name))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    within = F.greatest(F.col("rn") - F.col("start") + 1, F.lit(0))
    candidates = run.moments.groupBy("rule_id").agg(F.sum(within).alias("candidates"))
    examined = run.events.agg(F.count("*").alias("events")).withColumn("enabled", F.lit(True))
    joined = (
        rules.join(examined, "enabled", "left")
        .join(per(run.rows, "matched"), "rule_id", "left")
        .join(candidates, "rule_id", "left")
        .join(per(run.windows, "triggered"), "rule_id", "left")
    )
    return joined.select(
        F.col("rule_id").alias("rule"),
        zero("events").alias("examined"),
        zero("matched"),
        zero("triggered"),
        (F.coalesce(F.col("candidates"), F.lit(0)) - F.coalesce(F.col("triggered"), F.lit(0))).alias("suppressed"),
    ).orderBy("rule")
