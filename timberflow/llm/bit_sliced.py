"""Exact top-k by a bit-sliced index.

In each block of rows every attribute is cut into bitmaps, one for each bit of its value.  A query's weighted sum of
attributes is added up on the bitmaps alone: each set bit of a weight adds the attribute's slices at its place, and columns of
bitmaps are reduced by carry-save adders until one bitmap is left for each bit of the sum.  The best rows are then selected from
the most significant slice downward, and rows that tie at the boundary are resolved by their scores and ids.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberflow.llm.blocks import nearest, usable

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def slices(rows: np.ndarray) -> np.ndarray:
    """Bitmaps (attribute, bit, word) of rows of integers of 0 or more."""
    n, bits = len(rows), max(1, int(rows.max()).bit_length())
    padded = np.zeros((-(-n // 64) * 64, rows.shape[1]), np.int64)
    padded[:n] = rows
    planes = (padded.T[:, None, :] >> np.arange(bits)[None, :, None]) & 1
    return np.packbits(planes.astype(np.uint8), axis=2, bitorder="little").view(np.uint64)


def weighted_sum(index: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Bitmaps of each bit of sum(|w| * x), where an attribute of negative weight counts by its complement."""
    signed = index ^ np.where(weights < 0, ONES, np.uint64(0))[:, None, None]
    size, bits = np.abs(weights), index.shape[1]
    columns: list[list[np.ndarray]] = []
    for place in range(int(size.max()).bit_length()):
        chosen = signed[(size >> place) & 1 == 1]
        for bit in range(bits):
            while len(columns) <= place + bit:
                columns.append([])
            if len(chosen):
                columns[place + bit].append(chosen[:, bit])
    total, at = [], 0
    while at < len(columns):
        stack = np.concatenate(columns[at]) if columns[at] else np.zeros((1, index.shape[2]), np.uint64)
        carries = []
        while len(stack) > 1:
            if len(stack) == 2:
                carries.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
                break
            third = len(stack) // 3
            a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (c & half))
            stack = np.concatenate([half ^ c, stack[3 * third :]])
        if carries:
            if at + 1 == len(columns):
                columns.append([])
            columns[at + 1] += carries
        total.append(stack[0])
        at += 1
    return total


def select_top(total: list[np.ndarray], open_rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sure, tied) bitmaps: the rows certainly among the best ``k``, and those equal at the boundary."""
    sure, tied = np.zeros_like(open_rows), open_rows
    for plane in reversed(total):
        ahead = sure | (tied & plane)
        count = int(np.bitwise_count(ahead).sum())
        if count > k:
            tied = tied & plane
        elif count < k:
            sure, tied = ahead, tied & ~plane
        else:
            return ahead, np.zeros_like(tied)
    return sure, tied


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_of_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
    """The best ``k`` rows of the block for every query by integer inner product, the query's own id left out."""
    order = np.argsort(ids, kind="stable")
    ids, rows, queries = ids[order], rows[order].astype(np.int64), queries.astype(np.int64)
    index = slices(rows - rows.min())
    every = np.packbits(np.arange(index.shape[2] * 64) < len(ids), bitorder="little").view(np.uint64)
    found = []
    for query_id, query in zip(query_ids, queries, strict=True):
        free = every.copy()
        for own in range(int(np.searchsorted(ids, query_id, "left")), int(np.searchsorted(ids, query_id, "right"))):
            free[own // 64] &= ~np.uint64(1 << (own % 64))
        sure, tied = select_top(weighted_sum(index, query), free, k) if query.any() else (np.zeros_like(free), free)
        kept = _rows(sure)
        kept = np.concatenate([kept, _rows(tied)[: k - len(kept)]])  # rows stand in the order of their ids
        scores = rows[kept] @ query
        best = np.lexsort((ids[kept], -scores))
        found.append((np.full(len(kept), query_id), ids[kept][best], scores[best]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def search(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, row_block: int = 8192, query_block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best rows of ``vectors`` (vec_id, embedding) for the rows whose id ``every`` divides.

    Components count as floor(scale * x).  Null vectors and those with null or non-finite components take no part, neither does
    a null id; equal scores go to the smaller vec_id; repeated rows are candidates each; fewer candidates give fewer rows.
    """
    rows = usable(vectors.select("vec_id", "embedding")).filter("vec_id is not null")
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("double")).alias("embedding"))

    def work(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, block: np.ndarray):
        return top_of_block(query_ids, queries, ids, block, k)

    return nearest(rows, rows.filter(F.col("vec_id") % every == 0), work, "long", k, row_block, query_block)
