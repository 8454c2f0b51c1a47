"""Request sources and result sinks: JSON or Parquet files, batch or stream, and databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = ("json", "parquet", "orc", "csv")


def read_requests(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    """A batch of requests; the schema is given, so no pass infers it. Malformed JSON lines come
    as rows of nulls."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    return spark.read.schema(schema).format(fmt).load(path)


def stream_requests(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", *, files_per_batch: int | None = None) -> DataFrame:
    """The same as an unbounded table of files that arrive in a folder."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_database(spark: SparkSession, url: str, table: str, *, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 32, **options: str) -> DataFrame:
    """A database table, read in ``parts`` ranges of a numeric ``key`` if bounds are given.

    Needs the database's driver on the classpath.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def write_database(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def write_results(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    df.write.format(fmt).mode(mode).save(path)
