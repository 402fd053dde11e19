"""Keys of a table that grows by segments, so that an append reads only what it may repeat.

Every row has two keys, its fingerprint and its id.  A segment keeps its keys in buckets by hash, one folder per bucket, and a
Bloom filter per bucket made of bitmap aggregates.  Additions are held against the filters first; only buckets in which some
addition may be known are read, and of them only the keys, never the rows.

A filter's bits are a power of two that gives each key at least ten; filters of one size are kept together, as a key's places
depend on it.  Keys are written once per segment: running an append again writes the same segment again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberflow.operators.dedup import EVENT_ORDER, first_per_key
from timberflow.operators.folders import folders
from timberflow.session import materialize

_KEYS = "key string, hash bigint, segment bigint, bucket int"
_FILTERS = "bucket int, number bigint, bits binary, segment bigint"

#: Buckets of a segment, bits of a bucket's filter for each key and at least, and bits that each key sets.
BUCKETS, BITS_PER_KEY, LEAST_BITS, PROBES = 64, 10, 1 << 12, 4


def _keys_of(rows: DataFrame, buckets: int) -> DataFrame:
    """(``key``, ``hash``, ``bucket``) of both keys of each row."""
    both = F.array(F.concat(F.lit("f"), "fingerprint"), F.concat(F.lit("i"), "id"))
    keys = rows.select(F.explode(both).alias("key")).withColumn("hash", F.xxhash64("key"))
    return keys.withColumn("bucket", F.pmod("hash", F.lit(buckets)).cast("int"))


@dataclass
class KeyTable:
    """Key segments below ``root``; ``active`` names the segments that count."""

    spark: SparkSession
    root: str
    active: Sequence[int]
    buckets: int = BUCKETS
    bits_per_key: int = BITS_PER_KEY

    def _places(self, keys: DataFrame, bits: int) -> DataFrame:
        """Keys with the filter rows and bits they set, one row per probe."""
        probe = lambda k: F.pmod(F.xxhash64("hash", F.lit(k)), F.lit(bits)) + 1
        spots = keys.withColumn("_at", F.explode(F.array(*[probe(k) for k in range(PROBES)])))
        return spots.withColumns({"number": F.bitmap_bucket_number("_at"), "_bit": F.bitmap_bit_position("_at")}).drop("_at")

    def add(self, rows: DataFrame, segment: int) -> None:
        """Write the keys (columns id and fingerprint) of a new segment and their filters.

        Keys are dealt by ranges of bucket and hash, so a bucket of a very large segment is written by many tasks.
        """
        path = f"{self.root}/keys/segment={segment}"
        keys = _keys_of(rows.select("id", "fingerprint"), self.buckets).repartitionByRange("bucket", "hash").sortWithinPartitions("bucket", "hash")
        keys.write.mode("overwrite").partitionBy("bucket").parquet(path)
        stored = self.spark.read.schema("key string, hash bigint, bucket int").parquet(path)
        wanted = max(LEAST_BITS, -(-stored.count() * self.bits_per_key // self.buckets))
        bits = 1 << (wanted - 1).bit_length()
        filters = self._places(stored, bits).groupBy("bucket", "number").agg(F.bitmap_construct_agg("_bit").alias("bits"))
        filters.write.mode("overwrite").parquet(f"{self.root}/filters/size={bits}/segment={segment}")

    def possible(self, keys: DataFrame) -> DataFrame:
        """(``key``, ``segment``, ``bucket``): keys that every probe of a segment's filter finds."""
        byte = F.conv(F.hex(F.expr("substring(bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
        hit = F.expr("pmod(_bit, 8)").cast("int")
        found = None
        for name in folders(self.spark, f"{self.root}/filters"):  # one per power of two that some segment needed
            filters = self.spark.read.schema(_FILTERS).parquet(f"{self.root}/filters/{name}")
            active = filters.filter(F.col("segment").isin([int(n) for n in self.active]))
            probed = self._places(keys.distinct(), int(name.split("=")[1])).join(active, ["bucket", "number"])
            probed = probed.withColumn("_set", (F.floor(byte / F.pow(F.lit(2), hit)) % 2) == 1)
            all_set = probed.groupBy("key", "segment", "bucket").agg(F.count_if("_set").alias("_hits")).filter(F.col("_hits") == PROBES).drop("_hits")
            found = all_set if found is None else found.unionByName(all_set)
        return keys.select("key", F.lit(0).cast("bigint").alias("segment"), "bucket").limit(0) if found is None else found

    def touched(self, possible: DataFrame) -> DataFrame:
        """Stored keys of the buckets that hold a possible key; no other bucket's folder is so much as listed."""
        pairs = possible.select("segment", "bucket").distinct().collect()  # at most segments x buckets rows
        if not pairs:
            return self.spark.createDataFrame([], _KEYS)
        paths = [f"{self.root}/keys/segment={row['segment']}/bucket={row['bucket']}" for row in sorted(pairs)]
        return self.spark.read.schema(_KEYS).option("basePath", f"{self.root}/keys").parquet(*paths)

    def new_rows(self, additions: DataFrame) -> DataFrame:
        """Additions whose id and fingerprint are both new, first by (time, id) of each fingerprint."""
        fresh = first_per_key(additions, "fingerprint", EVENT_ORDER)
        if not self.active:
            return fresh
        fresh = materialize(fresh)
        possible = materialize(self.possible(_keys_of(fresh, self.buckets)))
        known = self.touched(possible).join(possible.select("key").distinct(), "key", "left_semi").select("key").distinct()
        known = materialize(known)
        names = lambda kind, name: known.filter(F.col("key").startswith(kind)).select(F.expr("substring(key, 2)").alias(name))
        return fresh.join(names("f", "fingerprint"), "fingerprint", "left_anti").join(names("i", "id"), "id", "left_anti")
