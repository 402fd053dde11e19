"""A stated set of query vectors against all vectors, in blocks of both: every cell of blocks is one task's work."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Work = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def usable(vectors: DataFrame, keep_zero: bool = True) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that take part: no null, no null or non-finite component, not empty."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")) & ~F.isnan(v.cast("double")))
    rows = vectors.filter(x.isNotNull() & (F.size(x) > 0) & F.coalesce(finite, F.lit(False)))
    if not keep_zero:
        rows = rows.filter(F.exists(x, lambda v: v != 0))
    return rows.select("vec_id", x.cast("array<double>").alias("embedding"))


def matrix(table: pa.Table, column: str = "embedding") -> np.ndarray:
    values = table.column(column).combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(table), -1) if len(table) else flat.reshape(0, 0)


def nearest(
    rows: DataFrame, queries: DataFrame, work: Work, score: str, k: int, row_block: int, query_block: int
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the best ``k`` of ``rows`` for each of ``queries`` (both vec_id, embedding).

    Rows are dealt evenly to blocks, whatever their ids; each cell of a row block and a query block returns at most ``k`` rows
    a query, found by ``work(query ids, queries, row ids, rows)``; these are merged by score, ties to the smaller vec_id.  Only
    vectors of one length meet.
    """
    row_blocks, query_blocks = (max(1, -(-f.count() // size)) for f, size in ((rows, row_block), (queries, query_block)))

    def dealt(frame: DataFrame, own: str, blocks: int, other: str, copies: int) -> DataFrame:
        block = F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int")
        placed = frame.select("vec_id", "embedding", F.size("embedding").alias("width"), block.alias(own))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    kind = pa.int64() if score == "long" else pa.float64()

    def cell(right: pa.Table, left: pa.Table) -> pa.Table:
        columns = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(left) and len(right):
            ids = (left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy())
            columns = list(work(ids[0], matrix(left), ids[1], matrix(right)))
        return pa.table([pa.array(c.astype(t), k_) for c, t, k_ in zip(columns, ("int64", "int64", kind.to_pandas_dtype()), (pa.int64(), pa.int64(), kind), strict=True)], names=["query_id", "vec_id", "score"])

    key = ("row_cell", "query_cell", "width")
    right = dealt(rows, "row_cell", row_blocks, "query_cell", query_blocks).groupBy(*key)
    left = dealt(queries, "query_cell", query_blocks, "row_cell", row_blocks).groupBy(*key)
    found = right.cogroup(left).applyInArrow(cell, f"query_id long, vec_id long, score {score}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
