"""Numbered text lines, and running values along a file that one task never has to hold as a whole.

A file is read in blocks by many tasks.  Everything that depends on earlier lines (numbers, running sums,
last seen values) is computed inside each block and completed with one carried value per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from timberflow.session import materialize

BLOCK = ["file", "block"]

# Rows of the per-block table up to which it is sent to all tasks (about 200 bytes each); beyond, Spark picks the join.
BROADCAST_BLOCKS = 200_000


def text_rows(rows: DataFrame) -> DataFrame:
    """File, block and text of a text scan, batch or stream."""
    return rows.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.regexp_replace("value", r"\r\z", "").alias("text"),
    )


def with_seq(rows: DataFrame) -> DataFrame:
    """Add ``seq``, which grows along each block; to be taken right at the scan, before any filter."""
    return rows.withColumn("seq", F.monotonically_increasing_id())


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Columns file, block, text and seq, without line ends."""
    return with_seq(text_rows(spark.read.option("lineSep", "\n").text(path)))


def join_blocks(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines with the values carried into their block; ``blocks`` is a materialized table, so its rows are counted, not guessed."""
    return lines.join(F.broadcast(blocks) if blocks.count() <= BROADCAST_BLOCKS else blocks, BLOCK)


def block_key() -> Column:
    """Number that tells blocks apart where rows of several blocks follow each other in a task."""
    return F.xxhash64(*BLOCK)


def runs_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Slices of batches that belong to one block (by column ``key``), and whether the block begins there.

    A task reads its blocks one after the other, so rows of a block are neighbours, in the order of the file.
    """
    last = None
    for batch in batches:
        keys = batch.column("key").to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
        for begin, end in zip(cuts, cuts[1:]):
            yield keys[begin] != last, batch.slice(begin, end - begin)
            last = keys[begin]


def earlier_blocks() -> WindowSpec:
    return Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def number_lines(scanned: DataFrame) -> DataFrame:
    """Columns file, line (1-based in the file) and text of scanned lines.

    The counting pass reads no text into memory, and only block numbers meet the lines, which stay in place.
    """
    blocks = scanned.groupBy(*BLOCK).agg(F.count("*").alias("_lines"), F.min("seq").alias("_first"))
    before = F.coalesce(F.sum("_lines").over(earlier_blocks()), F.lit(0)).alias("_before")
    numbered = join_blocks(scanned, materialize(blocks.select(*BLOCK, "_first", before)))
    return numbered.select("file", (F.col("_before") + F.col("seq") - F.col("_first") + 1).alias("line"), "text")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return number_lines(scan_lines(spark, path))


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Path and length of every file; only the listing is read, not the content."""
    return spark.read.format("binaryFile").load(path).select("path", "length")
