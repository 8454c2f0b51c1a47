"""Models and lexicons that several queries share, made once an application."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

_MADE: dict[tuple, object] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files: another state is another table."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(root)))


def once(spark: SparkSession, name: str, sf_dir: str, tables: tuple[str, ...], make: Callable[[], object]) -> object:
    """What ``make`` gives from ``tables`` of ``sf_dir``; it runs again when a file of them has
    changed. What it gives must be of bounded size, as it stays with the driver."""
    key = (spark.sparkContext.applicationId, name, sf_dir)
    state = tuple(_state(spark, f"{sf_dir}/{t}.parquet") for t in tables)
    if key not in _MADE or _MADE[key][0] != state:
        _MADE[key] = (state, make())
    return _MADE[key][1]
