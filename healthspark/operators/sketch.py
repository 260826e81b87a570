"""Counting in two passes: a count sketch drops keys that cannot be frequent before their texts are shuffled.

First pass: rows are counted by a hash of their key into 2**bits buckets; partial counts leave each task as
pairs of numbers and merge by addition. A key occurs at most as often as its bucket, so a bucket below the wanted
count rules all its keys out. Buckets that are left are a bitmap of 2**bits / 8 bytes (half a megabyte), whatever
the corpus: small enough to go to every task. Second pass: only rows in such buckets are counted exactly.

The result is exact; the sketch only spares the shuffle of keys that are rare, most names and literals of a large
repository.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 22


def _bit_is_set(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.bit_get(byte, (position % 8).cast("int")) == 1


def frequent_buckets(rows: DataFrame, keys: Sequence[str], least: int, bits: int = BITS) -> DataFrame:
    """(part, bitmap): the buckets with at least ``least`` rows, 32 768 of them to a row."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(1 << bits)).alias("bucket")
    counted = rows.select(bucket).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counted.groupBy(F.bitmap_bucket_number("bucket").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bucket")).alias("bitmap"))


def maybe_frequent(rows: DataFrame, keys: Sequence[str], least: int, bits: int = BITS) -> DataFrame:
    """The rows whose ``keys`` may occur ``least`` times or more: all that do, and few others."""
    bitmaps = F.broadcast(frequent_buckets(rows, keys, least, bits))
    marked = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(1 << bits)))
    met = marked.join(bitmaps, F.bitmap_bucket_number("_bucket") == F.col("part"))
    return met.where(_bit_is_set(F.col("bitmap"), F.bitmap_bit_position("_bucket"))).select(*rows.columns)
