"""Seeded selection of an exact number of rows from each group, without sorting a group whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hash ranges that each group is cut into; only one range a group is ever sorted.
RANGES = 4096


def take_by_hash(rows: DataFrame, quotas: DataFrame, group: list[str], key: str, *, seed: int = 1) -> DataFrame:
    """The ``take`` rows of smallest seeded hash of each group.

    ``rows``: ``group`` columns, a unique ``key`` and any others. ``quotas``: ``group`` columns
    and ``take`` (long). Groups without quota give nothing; a quota above the group's size
    takes all of it. Ties of the hash go by ``key``. Counts by hash range find the one range in
    which a group's quota ends; lower ranges are taken whole, so at most about a 4096th of a
    group is sorted in one task.
    """
    hashed = rows.join(quotas.where("take > 0"), group, "inner").withColumn("__h", F.xxhash64(F.lit(seed), key)).withColumn("__range", F.shiftrightunsigned("__h", 52).cast("int"))
    ends = Window.partitionBy(*group).orderBy("__range")
    counts = hashed.groupBy(*group, "__range").agg(F.count("*").alias("__n"), F.first("take").alias("__take")).withColumn("__upto", F.sum("__n").over(ends))
    cut = counts.where("__upto >= __take AND __upto - __n < __take").select(*group, F.col("__range").alias("__cut"), (F.col("__take") - F.col("__upto") + F.col("__n")).alias("__rest"))
    marked = hashed.join(cut, group, "left")
    whole = marked.where("__cut IS NULL OR __range < __cut").select(*rows.columns)
    edge = marked.where("__range = __cut").withColumn("__rank", F.row_number().over(Window.partitionBy(*group, "__range").orderBy("__h", key)))
    return whole.unionByName(edge.where("__rank <= __rest").select(*rows.columns))
