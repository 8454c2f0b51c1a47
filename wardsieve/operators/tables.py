"""Keyed tables as DataFrames: upsert, lookup, delete, expiry, counts, pages, dataset sync."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardsieve.runtime import persist_table
from wardsieve.schemas import DEFAULTS

#: Columns that a conflicting insert replaces; all others keep the first value.
REPLACED = ("detect_result", "category", "nsfw_score", "model_version", "updated_at")


def upsert(table: DataFrame, rows: DataFrame, key: str, order: list[str], *, replaced: tuple[str, ...] = REPLACED) -> DataFrame:
    """``table`` after inserting ``rows`` one by one by ``order``.

    A row of a new key is inserted; one of a known key replaces only the ``replaced`` columns.
    Rows of null key are left out. Missing columns and nulls of columns with a default take it.
    Both sides are folded to one row a key by partial aggregation before they meet, so a key
    that occurs in a third of the rows is no hot spot.
    """
    keep = [c for c in table.columns if c not in replaced and c != key]
    moved = [c for c in table.columns if c in replaced]
    for c in table.columns:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(table.schema[c].dataType))
    fill = {c: v for c, v in DEFAULTS.items() if c in table.columns}
    rows = rows.where(F.col(key).isNotNull()).withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fill.items()})
    seq = F.struct(*order)
    folded = rows.groupBy(key).agg(F.min_by(F.struct(*keep), seq).alias("first"), F.max_by(F.struct(*moved), seq).alias("last")) if keep else None
    old = table.select(F.col(key), F.struct(*keep).alias("old_keep"), F.struct(*moved).alias("old_moved"))
    met = old.join(folded, key, "full")
    value = {c: F.when(F.col("old_keep").isNotNull(), F.col(f"old_keep.{c}")).otherwise(F.col(f"first.{c}")) for c in keep} | {c: F.when(F.col("last").isNotNull(), F.col(f"last.{c}")).otherwise(F.col(f"old_moved.{c}")) for c in moved}
    return met.select(*[F.col(key) if c == key else value[c].alias(c) for c in table.columns])


def get(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``keys`` with the table's columns; null where there is none."""
    return keys.select(key).distinct().join(table, key, "left")


def get_by_id(table: DataFrame, id_: int) -> DataFrame:
    """The row of an id; the filter reaches the scan."""
    return table.where(F.col("id") == id_)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def is_expired(now: datetime | Column) -> Column:
    """Expired before ``now``; rows without expiry never are."""
    now = now if isinstance(now, Column) else F.lit(now)
    return F.col("expires_at").isNotNull() & (F.col("expires_at") < now)


def delete_expired(table: DataFrame, now: datetime | Column) -> DataFrame:
    return table.where(~is_expired(now))


def count(table: DataFrame, category: str | None = None) -> DataFrame:
    """One row ``n``; of one category where given and not empty."""
    rows = table.where(F.col("category") == category) if category else table
    return rows.agg(F.count("*").alias("n"))


def listing(table: DataFrame, key: str, *, category: str | None = None, limit: int = 10, offset: int = 0) -> DataFrame:
    """A page, newest first, ties by key; all categories if none or an empty one is given."""
    rows = table.where(F.col("category") == category) if category else table
    return rows.orderBy(F.desc("created_at"), key).offset(offset).limit(limit)


def update_by_id(table: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """Set ``columns`` of rows whose id is in ``changes`` (one row an id); nulls are set too."""
    new = changes.select("id", F.struct(*columns).alias("__new"))
    met = table.join(new, "id", "left")
    return met.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def sync_dataset(cache: DataFrame, dataset: DataFrame, key: str) -> DataFrame:
    """``dataset`` with the cache's rows that are not safe and not in it yet; first write wins.

    Expiry is not copied. Ids go on from the largest, in order of key. Where the dataset holds
    unique texts, a text that is there under another key is left out too, and of new rows with
    one text the smallest key stays.
    """
    new = cache.where(F.col("category") != "safe").join(dataset.select(key), key, "left_anti")
    if "normalized_content" in dataset.columns:
        new = new.join(dataset.select("normalized_content").distinct(), "normalized_content", "left_anti")
        smallest = new.where("normalized_content IS NOT NULL").groupBy("normalized_content").agg(F.min(key).alias(key))
        new = new.join(smallest.select(key), key, "left_semi").unionByName(new.where("normalized_content IS NULL"))
    top = dataset.agg(F.max("id")).first()[0] or 0
    numbered = numbered_by(new, key).withColumn("id", (F.col("__n") + F.lit(top)).cast("long")).withColumn("expires_at", F.lit(None).cast("timestamp"))
    return dataset.unionByName(numbered.select(*dataset.columns))


def numbered_by(rows: DataFrame, key: str, *, parts: int | None = None) -> DataFrame:
    """``rows`` with ``__n``: 1, 2, 3 ... in order of the unique ``key``.

    Numbers come from counts of key ranges and a rank within each, so no task sorts all rows.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, key).withColumn("__part", F.spark_partition_id())
    # the bounds of a range partitioning depend on sampling; a table fixes them
    ranged = persist_table(ranged, "ranged")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__size")).withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(key))
    return ranged.join(F.broadcast(sizes), "__part").withColumn("__n", rank + F.col("__before")).drop("__part", "__size", "__before")
