"""Approximate nearest neighbours by a permutation index.

A bounded sample of vectors serves as pivots.  Every vector is represented by its nearest pivots in order, and posted with the
pivot's place in that order in each pivot's inverted file.  A query reads the files of its own nearest pivots, which add up the
footrule distance between its order and every row's; the rows of least distance are ranked again by their true scores.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberflow.llm.blocks import nearest, usable

#: Pivots; places of a row that are posted; places of a query that are read; share of a block that is ranked again.
PIVOTS, POSTED, READ, SHARE = 256, 128, 64, 0.12
#: Rows ranked again in a block at least.
LEAST = 512


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS) -> dict[int, np.ndarray]:
    """Unit pivots by vector length: distinct directions among the four-fold number of rows of least hash."""
    sample = rows.orderBy(F.xxhash64("vec_id", "embedding")).limit(4 * pivots).collect()
    found: dict[int, list[np.ndarray]] = {}
    for row in sample:
        x = np.array(row["embedding"], float)
        x = x / np.abs(x).max()
        x = x / np.linalg.norm(x)
        own = found.setdefault(len(x), [])
        if len(own) < pivots and not any(abs(1 - float(x @ y)) < 1e-9 for y in own):
            own.append(x)
    return {width: np.array(own) for width, own in found.items()}


def inverted_files(rows: np.ndarray, pivots: np.ndarray, posted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, row, place): the postings of pivot p stand from starts[p] to starts[p + 1]."""
    places = np.argsort(-(rows @ pivots.T), axis=1, kind="stable")[:, :posted]
    pivot, order = places.ravel(), np.argsort(places.ravel(), kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(pivot, minlength=len(pivots)))])
    return starts, order // places.shape[1], (order % places.shape[1]).astype(np.int32)


def _shortlist(distance: np.ndarray, bands: list[np.ndarray], share: float, least: int) -> np.ndarray:
    """Rows of least distance, the share taken of each band of norms, since a long vector may win from further away."""
    picked = []
    for band in bands:
        size = min(len(band), max(int(np.ceil(share * len(band))), least))
        picked.append(band[np.argsort(distance[band], kind="stable")[:size]])
    return np.concatenate(picked)


def near_in_block(query_ids, queries, ids, rows, pivots, k, posted=POSTED, read=READ, share=SHARE, least=LEAST):
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    posted, read = min(posted, len(pivots)), min(read, len(pivots))
    starts, row, place = inverted_files(rows, pivots, posted)
    norms = np.floor(4 * np.log2(np.linalg.norm(rows, axis=1)) + 0.5)
    bands = [np.flatnonzero(norms == b) for b in np.unique(norms)]
    nearest_pivots = np.argsort(-(queries @ pivots.T), axis=1, kind="stable")[:, :read]
    absent = int(np.abs(np.arange(read) - posted).sum())  # a pivot that a row has not posted counts as place ``posted``
    found = []
    for query_id, query, own in zip(query_ids, queries, nearest_pivots, strict=True):
        distance = np.full(len(ids), absent, np.int32)
        for at, pivot in enumerate(own):
            part = slice(starts[pivot], starts[pivot + 1])
            distance[row[part]] += np.abs(place[part] - at) - abs(at - posted)
        picked = _shortlist(distance, bands, share, least)
        picked = picked[ids[picked] != query_id]
        scores = (rows[picked] * query).sum(axis=1)
        best = np.lexsort((ids[picked], -scores))[:k]
        found.append((np.full(len(best), query_id), ids[picked][best], scores[best]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def search(vectors: DataFrame, every: int = 20, k: int = 20, pivots: int = PIVOTS, row_block: int = 16384, query_block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found in ``vectors`` (vec_id, embedding) for the rows whose id ``every`` divides.

    The score is the inner product of the vectors as they are, in double precision.  Every row is indexed; the index is fitted on
    the pivots alone.  Null and zero vectors and those with null or non-finite components take no part, neither does a null id.
    """
    rows = usable(vectors.select("vec_id", "embedding"), keep_zero=False).filter("vec_id is not null")
    chosen = choose_pivots(rows, pivots)

    def work(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, block: np.ndarray):
        own = chosen.get(block.shape[1], np.eye(block.shape[1]))  # a rare length that the sample missed: the axes
        return near_in_block(query_ids, queries, ids, block, own, k)

    return nearest(rows, rows.filter(F.col("vec_id") % every == 0), work, "double", k, row_block, query_block)
