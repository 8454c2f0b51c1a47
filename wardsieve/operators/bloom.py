"""Bloom filters as tables of set bits, and as compact bitmaps.

Positions are SHA-256 numbers of the key and the hash's index, modulo the number of bits, so any
engine can compute them. Where a semi-join is affordable it is the exact replacement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardsieve.functions.hashes import sha_number


def positions(c: Column | str, bits: int, hashes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: sha_number(c, i) % F.lit(bits))


def build(keys: DataFrame, key: str, *, bits: int, hashes: int) -> DataFrame:
    """(position): bits set for all non-null keys."""
    return keys.where(F.col(key).isNotNull()).select(F.explode(positions(key, bits, hashes)).alias("position")).distinct()


def bitmap(filter_: DataFrame) -> DataFrame:
    """(bucket, bits): the set bits as binary bitmaps of 32,768 positions each."""
    return filter_.groupBy(F.bitmap_bucket_number("position").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("position")).alias("bits"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def drop(filter_: DataFrame) -> DataFrame:
    """The filter after it was deleted or has expired: no bit is set."""
    return filter_.where(F.lit(False))


def unexpired(filters: DataFrame, now: Column) -> DataFrame:
    """(position) of filters (position, expires_at) that live at ``now``; a null never expires."""
    return filters.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select("position").distinct()


def probe(rows: DataFrame, key: str, filter_: DataFrame, *, bits: int, hashes: int) -> DataFrame:
    """(key, maybe): whether all bits of a distinct key are set. An empty filter says no."""
    asked = rows.select(key).where(F.col(key).isNotNull()).distinct().select(key, F.explode(F.array_distinct(positions(key, bits, hashes))).alias("position"))
    hit = asked.join(filter_.withColumn("__set", F.lit(1)), "position", "left")
    return hit.groupBy(key).agg((F.count("__set") == F.count("*")).alias("maybe"))
