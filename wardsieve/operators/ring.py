"""Consistent hashing: a ring of node replicas and the successor lookup of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardsieve.functions.hashes import sha_number

REPLICAS = 100
#: Fixed value: prefix of a value for the second hash among colliding nodes.
INNER = "16777619"


def ring(nodes: DataFrame, *, replicas: int = REPLICAS) -> DataFrame:
    """(ring_key, node) of nodes (node, and optionally replicas or weight in per cent).

    A node has as many replicas as it asks for, ``replicas`` at most; with a weight, that share
    of ``replicas``. A node listed twice counts once, with its largest request.
    """
    n = F.col("replicas") if "replicas" in nodes.columns else F.floor(F.col("weight") * replicas / 100) if "weight" in nodes.columns else F.lit(replicas)
    asked = nodes.where("node IS NOT NULL").groupBy("node").agg(F.max(F.least(n, F.lit(replicas))).cast("int").alias("n")).where("n > 0")
    each = asked.select("node", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return each.select(sha_number("node", F.col("i")).alias("ring_key"), "node")


def remove(ring_: DataFrame, nodes: DataFrame) -> DataFrame:
    return ring_.join(nodes.select("node"), "node", "left_anti").select("ring_key", "node")


def lookup(values: DataFrame, ring_: DataFrame, value: str) -> DataFrame:
    """(value, node): the node of the first ring key at or after the value's hash, wrapping.

    Ring keys and values are merged in hash ranges: each value takes the next key of its range,
    or the first key after it, so neither side is broadcast nor sorted whole. If several nodes
    share the key, a second hash picks one, in order of node.
    """
    keys = ring_.groupBy("ring_key").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    cell = lambda c: F.shiftright(c, 48).cast("int")  # noqa: E731  60-bit hashes: 4096 ranges
    marks = keys.select(cell(F.col("ring_key")).alias("cell"), F.col("ring_key").alias("h"), F.col("nodes"), F.lit(0).alias("side"), F.lit(None).cast(values.schema[value].dataType).alias(value))
    asked = values.select(value).where(F.col(value).isNotNull()).distinct().withColumn("h", sha_number(value))
    both = marks.unionByName(asked.select(cell(F.col("h")).alias("cell"), "h", F.lit(None).cast("array<string>").alias("nodes"), F.lit(1).alias("side"), value))
    # at equal hashes the key must come after the value, looking backwards from the end
    order = Window.partitionBy("cell").orderBy(F.desc("h"), "side")
    found = both.withColumn("nodes", F.last("nodes", ignorenulls=True).over(order)).where("side = 1")
    # the first key of the next occupied range, for values beyond the last key of theirs
    firsts = marks.groupBy("cell").agg(F.min_by("nodes", "h").alias("first"))
    after = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    every = values.sparkSession.range(4096).select(F.col("id").cast("int").alias("cell")).join(firsts, "cell", "left").withColumn("next", F.last("first", ignorenulls=True).over(after))
    lowest = keys.agg(F.min_by("nodes", "ring_key")).first()[0]
    wrap = F.lit(None).cast("array<string>") if lowest is None else F.array(*map(F.lit, lowest))
    met = found.join(F.broadcast(every.select("cell", "next")), "cell")
    nodes = F.coalesce("nodes", "next", wrap)
    pick = F.when(F.size(nodes) == 1, nodes[0]).otherwise(F.get(nodes, (sha_number(F.concat(F.lit(f"{INNER}:"), F.col(value).cast("string"))) % F.size(nodes)).cast("int")))
    return met.select(value, pick.alias("node"))
