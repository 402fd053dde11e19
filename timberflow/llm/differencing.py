"""Shards of nearly equal bytes for indivisible groups, by Karmarkar-Karp differencing.

Rows with equal texts form a group and stay together.  Differencing keeps partial partitions, each a list of as many subset
sums as there are shards; the two with the largest spread (largest minus least sum) are combined oppositely ordered, the
largest subset of one with the least of the other, until one partition is left.

It works on items, whose number does not grow with the data: a group of more than one part in ``shards * GRAIN`` of all bytes
is an item by itself (there are fewer than ``shards * GRAIN`` of them), and all other groups are gathered into ``BUNDLES``
items by their key.  With 40 shards that is at most 53,248 items of two numbers each, which the driver combines; the
assignment of the items, of the same bound, is broadcast.  An item is small against a shard and differencing leaves a spread
far below an item, so the balance is as good as if single groups were placed, unless a group alone exceeds a shard.  Where items
are few it can leave more than ``SPREAD`` of a shard; then items are moved or swapped from the largest shard to the smallest.

Law: ``bytes`` (sizes near equal).  Odd rows: a null text has no bytes and belongs to the group of the empty text; a size is the text's
UTF-8 bytes plus 16, so every row counts.  Rows without id, and repeated rows, are rows as any other.  A group with a third of
all rows has one shard to itself as far as the others' bytes allow; its slots are still dealt by many tasks.  Groups are told
apart by a 64-bit hash: two texts that share one merely share a shard.  Ties of spread go to the partition made first, and
items are taken by size and name, so equal input gives equal shards.  An empty table gives no rows.  Columns of the input
beside ``doc_id`` and ``text`` are not looked at by :func:`assign`.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberflow.operators.positions import with_position
from timberflow.session import materialize

#: A group of more than one part in shards * GRAIN of all bytes is placed by itself; the others are gathered into BUNDLES.
GRAIN, BUNDLES = 512, 1 << 15
#: Part of a mean shard that the largest and the smallest shard may differ by before items are exchanged.
SPREAD = 0.001
#: Bytes that a row counts beside its text.
OVERHEAD = 16


def _combined(a: list[tuple[int, int]], b: list[tuple[int, int]], shards: int, union) -> list[tuple[int, int]]:
    """Two partial partitions (subsets by falling sum, empty ones left out) joined oppositely ordered."""
    overlap = len(a) + len(b) - shards
    if overlap <= 0:
        return sorted(a + b, reverse=True)
    # The last `overlap` subsets of each meet, the least of one with the largest of those of the other.
    met = [(x + y, union(m, n)) for (x, m), (y, n) in zip(a[len(a) - overlap :], reversed(b[len(b) - overlap :]), strict=True)]
    return sorted(a[: len(a) - overlap] + b[: len(b) - overlap] + met, reverse=True)


def difference(sizes: list[int], shards: int) -> list[int]:
    """Shard of each item; the shard with the largest sum is 0."""
    if not sizes:
        return []
    left, right = list(range(len(sizes))), [-1] * len(sizes)  # a node is an item or the union of two nodes

    def union(m: int, n: int) -> int:
        left.append(m)
        right.append(n)
        return len(left) - 1

    spread = lambda part: part[0][0] - (part[-1][0] if len(part) == shards else 0)
    heap = [(-size, k, [(size, k)]) for k, size in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heap[0]
        part = _combined(a, b, shards, union)
        heapq.heapreplace(heap, (-spread(part), made, part))
        made += 1
    shard_of = [0] * len(sizes)
    for shard, (_, node) in enumerate(heap[0][2]):
        open_ = [node]
        while open_:
            at = open_.pop()
            if right[at] < 0:
                shard_of[at] = shard
            else:
                open_ += (left[at], right[at])
    return shard_of


def exchange(sizes: list[int], shard_of: list[int], shards: int) -> list[int]:
    """The shards of the items after moves and swaps from the largest shard to the smallest, as long as that narrows the spread.

    Each exchange brings the two nearer to each other, so the sum of the squares of all shards falls.  A largest shard of one item
    has none to offer: where a group alone exceeds a shard, differencing is left as it is.
    """
    weights, places = np.array(sizes, np.int64), np.array(shard_of, np.int64)
    sums = np.zeros(shards, np.int64)
    np.add.at(sums, places, weights)
    while True:
        high, low = int(sums.argmax()), int(sums.argmin())
        gap = sums[high] - sums[low]
        if gap * shards <= SPREAD * sums.sum():
            return places.tolist()
        mine, theirs = np.flatnonzero(places == high), np.flatnonzero(places == low)
        theirs = theirs[np.argsort(weights[theirs], kind="stable")]
        offers = np.concatenate([[0], weights[theirs]])  # nothing, which makes a move, or an item
        above = np.searchsorted(offers, weights[mine] - gap // 2)
        pairs = np.concatenate([np.minimum(above, len(offers) - 1), np.maximum(above - 1, 0)])
        change = np.concatenate([weights[mine], weights[mine]]) - offers[pairs]
        left = np.where((change > 0) & (change < gap), np.abs(2 * change - gap), gap)
        best = int(left.argmin())
        if left[best] == gap:
            return places.tolist()
        places[mine[best % len(mine)]] = low
        if pairs[best]:
            places[theirs[pairs[best] - 1]] = high
        sums[high] -= change[best]
        sums[low] += change[best]


def items_of(groups: DataFrame, total: int, shards: int) -> DataFrame:
    """(``alone``, ``item``, ``size``): the large groups by their key, the others by the bundle of their key."""
    alone = F.col("size") * shards * GRAIN > total
    item = F.when(alone, F.col("key")).otherwise(F.pmod("key", F.lit(BUNDLES)))
    return groups.groupBy(alone.alias("alone"), item.alias("item")).agg(F.sum("size").alias("size"))


def assign(documents: DataFrame, shards: int) -> DataFrame:
    """(``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot``) of each row; slots count from 0 without gaps in each shard."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )
    rows = materialize(rows)
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("size")))
    total = groups.agg(F.sum("size")).first()[0] or 0
    items = items_of(groups, total, shards).orderBy(F.desc("size"), "alone", "item").toPandas()
    sizes = [int(s) for s in items["size"]]
    items["shard"] = exchange(sizes, difference(sizes, shards), shards)
    kind = "item long, shard int"
    table = lambda alone: F.broadcast(spark.createDataFrame([(int(i), int(s)) for i, s in items.loc[items["alone"] == alone, ["item", "shard"]].itertuples(index=False)], kind))
    named = rows.join(table(True).select(F.col("item").alias("key"), F.col("shard").alias("own")), "key", "left")
    named = named.withColumn("item", F.pmod("key", F.lit(BUNDLES))).join(table(False), "item", "left")
    placed = named.select("doc_id", "size", "text_crc32", F.coalesce("own", "shard").alias("shard"), F.rand(13).alias("_salt"))
    slots = with_position(placed, ["doc_id", "_salt"], ["shard"], "slot")
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") - 1).alias("slot"))


def summary(assigned: DataFrame) -> pd.DataFrame:
    """Rows and bytes of each shard, one row per shard."""
    return assigned.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).orderBy("shard").toPandas()


def write(documents: DataFrame, shards: int, path: str) -> None:
    """Whole documents as Parquet, one folder per shard, in the order of their slots.

    Needs distinct ids that are not null.  Rows are dealt by ranges of (shard, slot), so a large shard is written by many tasks.
    """
    places = assign(documents, shards).select("doc_id", "shard", "slot")
    ranged = documents.join(places, "doc_id").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ranged.write.partitionBy("shard").parquet(path)
