"""Exact positions and running counts in a total order that one task never has to hold.

A window over a key puts all rows of that key into one task; with a key that has a third of all rows this
does not finish.  Here rows are range-partitioned by key *and* order, so a large key spreads over many
partitions, and the counts of earlier partitions (one row per partition and key) are added to local ones.
The range-partitioned rows are checkpointed because both steps must see the same split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberflow.functions.times import floor_div
from timberflow.session import materialize, scratch_path, store

_PARTITION_BITS = 33

# Counted rows of a small table up to which it is broadcast.
BROADCAST_ROWS = 200_000


def _ranged(df: DataFrame, order: Sequence[str], keep=materialize) -> DataFrame:
    ordered = df.repartitionByRange(*[F.col(name) for name in order]).sortWithinPartitions(*order)
    ordered = keep(ordered.withColumn("_seq", F.monotonically_increasing_id()))
    return ordered.withColumn("_part", F.shiftrightunsigned(F.col("_seq"), _PARTITION_BITS))


def small(df: DataFrame) -> DataFrame:
    """A materialized table for a join: its rows are counted, not guessed, to say whether it is broadcast."""
    df = materialize(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _placed(ranged: DataFrame, keys: Sequence[str], name: str, carried=lambda parts: parts) -> DataFrame:
    parts = ranged.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_carry", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    placed = ranged.join(carried(parts), ["_part", *keys])
    return placed.withColumn(name, F.col("_carry") + F.col("_seq") - F.col("_first") + 1).drop(
        "_part", "_seq", "_first", "_carry"
    )


def with_position(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """Add the 1-based position of every row by ``order`` (which must be unique) within ``keys``."""
    keys = list(keys)
    return _placed(_ranged(df, [*keys, *order]), keys, name)


def stored_position(df: DataFrame, order: Sequence[str], keys: Sequence[str], name: str) -> DataFrame:
    """As :func:`with_position`, for wide rows: they are shuffled once, to be stored, and not again for their positions."""
    keys = list(keys)
    return _placed(_ranged(df, [*keys, *order], lambda rows: store(rows, scratch_path(df.sparkSession, "positions"))), keys, name, small)


def rank_and_before(
    df: DataFrame, keys: Sequence[str], shift_nanos: Column, row: str, ties: str | None = "id", weight: str | None = None
) -> DataFrame:
    """Add ``rn`` and ``before`` to rows with columns ``us`` and ``nanos`` (an instant).

    ``rn`` is the 1-based rank by (instant, ``ties``) within ``keys``; ``before`` counts the rows of the key
    with an instant earlier than the row's own plus ``shift_nanos``.  Each row is joined by a probe at the
    shifted instant, both are put in one order, and the running count of real rows answers both questions.
    ``row`` names a unique number per row.  Where a row stands for ``weight`` rows of its instant, all of them count, and
    ``rn`` is the rank of the last; no ``ties`` are needed where instants are unique.
    """
    keys, ties = list(keys), [ties] if ties else []
    moved = F.col("nanos") + shift_nanos
    probes = df.select(
        *keys,
        (F.col("us") + floor_div(moved, 1000)).alias("us"),
        F.pmod(moved, F.lit(1000)).cast("int").alias("nanos"),
        F.lit(0).alias("_real"),
        *[F.lit("").alias(name) for name in ties],
        row,
    )
    rows = df.withColumn("_real", F.col(weight) if weight else F.lit(1)).withColumn("nanos", F.col("nanos").cast("int"))
    ranged = _ranged(rows.unionByName(probes, allowMissingColumns=True), [*keys, "us", "nanos", "_real", *ties, row])
    upto = Window.partitionBy("_part", *keys).orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_local", F.sum("_real").over(upto))
    parts = ranged.groupBy("_part", *keys).agg(F.sum("_real").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_carry", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    counted = local.join(parts, ["_part", *keys]).withColumn("_upto", F.col("_local") + F.col("_carry"))
    real = counted.filter("_real > 0").withColumn("rn", F.col("_upto"))
    before = counted.filter("_real = 0").select(row, F.col("_upto").alias("before"))
    return real.join(before, row).drop("_part", "_seq", "_real", "_local", "_carry", "_upto")


def merge_ranges(df: DataFrame, keys: Sequence[str], low: str, high: str) -> DataFrame:
    """Union of the closed integer ranges of each key: disjoint ranges ``low`` .. ``high`` and ``merged``, how many went into each.

    In the order of their lower ends a range begins a new one where it lies above the largest upper end so far.  That running
    maximum, and then the running number of beginnings, are local to a range partition plus what earlier partitions carry over.
    """
    keys = list(keys)
    ranged = _ranged(df.select(*keys, low, high), [*keys, low, high])
    local = Window.partitionBy("_part", *keys).orderBy("_seq")
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tops = ranged.groupBy("_part", *keys).agg(F.max(high).alias("_top")).withColumn("_carry", F.max("_top").over(earlier)).drop("_top")
    before = F.greatest(F.max(high).over(local.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carry"))
    begun = ranged.join(tops, ["_part", *keys]).withColumn("_begins", F.coalesce(F.col(low) > before, F.lit(True)).cast("int"))
    counts = begun.groupBy("_part", *keys).agg(F.sum("_begins").alias("_n"))
    counts = counts.withColumn("_earlier", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    running = F.sum("_begins").over(local.rowsBetween(Window.unboundedPreceding, 0))
    numbered = begun.join(counts, ["_part", *keys]).withColumn("_union", running + F.col("_earlier"))
    union = numbered.groupBy(*keys, "_union").agg(F.min(low).alias(low), F.max(high).alias(high), F.count("*").alias("merged"))
    return union.drop("_union")
