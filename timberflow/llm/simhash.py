"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into ``distance`` segments, fewer than the usual ``distance + 1``: of two fingerprints that
differ in at most ``distance`` bits, one segment then differs in at most one.  Each fingerprint is indexed under every
segment as it stands and under every variant of it with one bit deleted, an equality join brings together what shares a
variant, and the whole fingerprints are compared.  A deleted bit only joins sides that differ in it, so a pair of equal
segments meets once.

Equal fingerprints are one node.  Where a variant holds more than ``crowd`` fingerprints its members get the variants of
their remaining bits in addition, by the same rule, so that a crowd is never compared pairwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberflow.llm.common import materialize

BITS = 64
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles hashed at a time, so that a very long text needs no more memory than this many.
CHUNK = 1 << 16


def simhash(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Signed 64-bit fingerprint: a bit is set where it is set in over half the shingle hashes; no words give 0."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()  # bytes: space and 9 to 13 only
    if not tokens:
        return 0
    size = min(words, len(tokens))
    total, ones = len(tokens) - size + 1, np.zeros(BITS, np.int64)
    for start in range(0, total, CHUNK):
        part = tokens[start : min(start + CHUNK, total) + size - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(size)), strict=False))
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, words: int = 3, seed: int = 42) -> Column:
    @F.pandas_udf(T.LongType())
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(t, words, seed) for t in texts], dtype="int64")

    return compute(text)


def hex_text(value: Column) -> Column:
    """16 lowercase hexadecimal digits of a signed 64-bit value."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _variants(value: Column, width: int, parts: int) -> Column:
    """(part, side) of each segment of the lowest ``width`` bits cut into ``parts``: as it stands and with one bit deleted.

    ``part`` holds the kept bits and which was deleted; ``side`` is the deleted bit, or 2 where none was.  With no parts
    the bits stand whole: nothing may differ.
    """
    edges = [width * k // max(parts, 1) for k in range(max(parts, 1) + 1)]
    one = F.lit(1).cast("long")

    def segment(low: int, high: int) -> Column:
        bits = F.shiftrightunsigned(value, low)
        return bits.bitwiseAND(F.lit((1 << (high - low)) - 1)) if high - low < BITS else bits

    def deleted(low: int, bits: Column) -> Callable[[Column], Column]:
        def variant(bit: Column) -> Column:
            side = F.call_function("shiftrightunsigned", bits, bit).bitwiseAND(one).cast("int")
            kept = bits.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", one, bit)))
            return F.struct(F.xxhash64(F.lit(low), bit, kept).alias("part"), side.alias("side"))

        return variant

    found = []
    for low, high in zip(edges, edges[1:], strict=False):
        bits = segment(low, high)
        found.append(F.array(F.struct(F.xxhash64(F.lit(low), F.lit(-1), bits).alias("part"), F.lit(2).alias("side"))))
        if parts:
            found.append(F.transform(F.sequence(F.lit(0), F.lit(high - low - 1)), deleted(low, bits)))
    return F.concat(*found)


def _meet(index: DataFrame, distance: int) -> DataFrame:
    """Pairs of fingerprints under one key that are close enough: unlike sides of a deleted bit, or whole segments.

    Two variants whose hashes agree by chance meet in vain, as the whole fingerprints are compared.
    """
    left = index.filter("side in (0, 2)").select("key", F.col("side").alias("a_side"), F.col("fp").alias("a"))
    right = index.filter("side in (1, 2)").select("key", F.col("side").alias("b_side"), F.col("fp").alias("b"))
    sides = (F.col("a_side") + F.col("b_side") == 1) | ((F.col("a_side") == 2) & (F.col("b_side") == 2) & (F.col("a") < F.col("b")))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return left.join(right, (left["key"] == right["key"]) & sides & close).select("a", "b")


def _turned(distance: int) -> list[tuple[Column, int]]:
    """(fingerprint turned until the segment is lowest and the rest above it, the segment's width) of each segment."""
    edges = [BITS * k // distance for k in range(distance + 1)]
    fp = F.col("fp")
    return [
        (F.shiftrightunsigned(fp, low).bitwiseOR(F.shiftleft(fp, BITS - low)) if low else fp, high - low)
        for low, high in zip(edges, edges[1:], strict=False)
    ]


def _index(nodes: DataFrame, distance: int) -> DataFrame:
    """(fp, segment, key, side): every fingerprint under all variants of its segments."""

    def entry(k: int) -> Callable[[Column], Column]:
        return lambda v: F.struct(F.lit(k).alias("segment"), F.xxhash64(F.lit(k), v["part"]).alias("key"), v["side"].alias("side"))

    entries = [F.transform(_variants(value, width, 1), entry(k)) for k, (value, width) in enumerate(_turned(distance))]
    return nodes.select("fp", F.explode(F.concat(*entries)).alias("v")).select("fp", "v.segment", "v.key", "v.side")


def _finer(members: DataFrame, distance: int) -> DataFrame:
    """(fp, key, side): the entries of crowded keys, each parted by the variants of the bits outside its segment."""
    outer = F.col("side")

    def whole(v: Column) -> Column:
        return F.struct(F.xxhash64("key", v["part"], F.lit(-1)).alias("key"), v["side"].alias("side"))

    def deleted(v: Column) -> Column:
        turn = F.when(v["side"] == 2, -1).otherwise(outer.bitwiseXOR(v["side"]))
        return F.struct(F.xxhash64("key", v["part"], turn).alias("key"), outer.alias("side"))

    parted = F
    for k, (value, width) in enumerate(_turned(distance)):
        rest = F.shiftrightunsigned(value, width) if width < BITS else F.lit(0).cast("long")
        here = F.col("segment") == k  # a whole segment leaves ``distance`` bits that may still differ, a deleted bit one less
        parted = parted.when(here & (outer == 2), F.transform(_variants(rest, BITS - width, distance), whole))
        parted = parted.when(here & (outer != 2), F.transform(_variants(rest, BITS - width, distance - 1), deleted))
    return members.select("fp", F.explode(parted).alias("v")).select("fp", "v.key", "v.side")


def links(fingerprints: DataFrame, distance: int = 2, crowd: int = 256) -> DataFrame:
    """Every pair (a < b) of the distinct fingerprints ``fp`` (none repeated) that differ in at most ``distance`` bits (1 or more)."""
    nodes = fingerprints.select(F.col("fp").cast("long")).filter("fp is not null")
    index = _index(nodes, distance)
    crowded = materialize(index.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("key"))
    members = materialize(index.join(crowded, "key", "left_semi").select("fp", "segment", "key", "side"))
    plain = index.join(crowded, "key", "left_anti").select("fp", "key", "side")
    both = _meet(plain, distance).unionByName(_meet(_finer(members, distance), distance))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b): the smallest node of each connected component.

    Alternates the large-star and small-star steps of Kiveris and others until nothing changes; every round ends in a
    reliable checkpoint.  A centre with very many neighbours is a join that Spark splits, never one group.
    """
    edges = materialize(edges.filter("a != b").select("a", "b"))
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        floor = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(floor, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(floor.select("a", F.col("m").alias("b")))
            .filter("a != b")
            .distinct()
        )
        edges = materialize(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def near_duplicates(
    documents: DataFrame, words: int = 3, distance: int = 2, seed: int = 42, crowd: int = 256
) -> DataFrame:
    """Fingerprint and group of every row of ``documents`` (doc_id, text): doc_id, fp (signed), component_id.

    Where a variant holds more than ``crowd`` fingerprints they are parted further before they are compared.

    ``component_id`` is the smallest doc_id that links reach, the row's own included.  Null and empty texts have the
    fingerprint 0 and are linked like any other; repeated rows come out repeated; a null doc_id never is a component_id,
    unless nothing else is in the group; an empty table gives no rows.  Other columns are left out.
    """
    prints = materialize(documents.select("doc_id", fingerprint(F.col("text"), words, seed).alias("fp")))
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(nodes, distance, crowd)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
