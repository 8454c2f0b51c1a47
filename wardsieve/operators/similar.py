"""Similarity of 64-bit image hashes without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardsieve.functions.hashes import hamming


def segments(distance: int) -> list[tuple[int, int]]:
    """(shift, bits) of as few segments as make hashes within ``distance`` agree within 2 bits
    in one: 3 differing bits in each would be more than ``distance``."""
    n = -(-(distance + 1) // 3)
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _code(c: Column, shift: int, bits: int) -> Column:
    c = F.shiftrightunsigned(c, shift)
    return c if bits == 64 else c.bitwiseAND(F.lit((1 << bits) - 1))


def _balls(c: Column, parts: list[tuple[int, int]]) -> Column:
    """array of (seg, band): each segment's code and all codes one bit away."""

    def ball(k: int, shift: int, bits: int) -> Column:
        flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(bits)])
        return F.transform(flips, lambda f: F.struct(F.lit(k).alias("seg"), _code(c, shift, bits).bitwiseXOR(f).alias("band")))

    return F.concat(*[ball(k, *s) for k, s in enumerate(parts)])


def near(left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    """(a, b, distance): values ``phash`` of left and right within ``distance`` bits, each pair
    once. Nulls match nothing. Values are taken distinct first, so repeated hashes meet once."""
    parts = segments(distance)
    keyed = lambda df, name: df.where("phash IS NOT NULL").select(F.col("phash").alias(name)).distinct().select(name, F.explode(_balls(F.col(name), parts)).alias("k")).select(name, "k.seg", "k.band")
    # neither side is broadcast: plans reckon an exploded side at its size before it is exploded
    met = keyed(left, "a").hint("merge").join(keyed(right, "b").hint("merge"), ["seg", "band"]).where(hamming("a", "b") <= distance)
    # a pair meets in several bands: keep it in the first close segment, at its own code or the
    # smaller of the two codes in the middle
    diff = F.col("a").bitwiseXOR(F.col("b"))
    here, earlier = F.lit(False), F.lit(False)
    for k, s in enumerate(parts):
        gap = F.bit_count(_code(diff, *s))
        own = F.when(gap <= 1, F.col("band") == _code(F.col("a"), *s)).otherwise(F.col("band") < _code(diff, *s).bitwiseXOR(F.col("band")))
        here = here | ((F.col("seg") == k) & ~earlier & own)
        earlier = earlier | (gap <= 2)
    return met.where(here).select("a", "b", hamming("a", "b").alias("distance"))


def find_similar(queries: DataFrame, table: DataFrame, *, distance: int = 10, top: int = 5) -> DataFrame:
    """For each query (query_id, phash) the ``top`` nearest rows of ``table`` that are not safe:
    query_id, file_hash, distance, rank. Ties by file_hash.

    Null and 0 hashes stand for images that could not be decoded: they match nothing. Of a hash
    that many rows have, only the ``top`` smallest keys meet the queries.
    """
    queries = queries.where("phash <> 0")
    bad = table.where((F.col("category") != "safe") & (F.col("phash") != 0)).select("phash", "file_hash")
    pairs = near(queries, bad, distance)
    first = Window.partitionBy("phash").orderBy("file_hash")
    bad = bad.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= top)
    order = Window.partitionBy("a").orderBy("distance", "file_hash")
    best = pairs.join(bad.select(F.col("phash").alias("b"), "file_hash").hint("merge"), "b").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return queries.select("query_id", F.col("phash").alias("a")).join(best, "a").select("query_id", "file_hash", "distance", "rank")


def by_exact_hash(queries: DataFrame, table: DataFrame) -> DataFrame:
    """All rows of ``table`` whose phash equals a query's: query_id and the table's columns."""
    return queries.select("query_id", "phash").join(table, "phash").select("query_id", *table.columns)
