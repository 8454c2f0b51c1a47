"""Session helpers: the shared folder, cut lineage, table loading."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of shared files that workers read as long as the application runs.
KEPT = ("code-", "lexicon-")
_FALLBACK: dict[str, str] = {}
_ROOTS: set[str] = set()
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    Read from ``spark.checkpoint.dir``. Only in local mode, where the session names none (unit
    tests), a temporary folder is made, once per application; on a cluster that is an error,
    since no other machine would see it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        path = _FALLBACK.setdefault(app, "") or tempfile.mkdtemp(prefix="wardsieve-")
        _FALLBACK[app] = path
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the application's own folder, which is removed when the driver ends."""
    root = f"{shared_dir(spark)}/wardsieve/{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _ROOTS.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Remove all intermediate tables of the application, for sessions that run many queries.

    Results that were not written elsewhere are lost. What is shipped to workers stays.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/wardsieve/{spark.sparkContext.applicationId}")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.listStatus(root) if fs.exists(root) else []:
        if not s.getPath().getName().startswith(KEPT):
            fs.delete(s.getPath(), True)


def write_file(spark: SparkSession, uri: str, content: bytes) -> None:
    """One file, on whatever file system the path names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(content)
    out.close()


def ship(spark: SparkSession) -> None:
    """Give the package's code to all workers, once an application.

    Workers then need neither the repository nor a path to it.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here, packed = Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    uri = f"{shared_path(spark, 'code')}/wardsieve.zip"
    write_file(spark, uri, packed.getvalue())
    sc.addPyFile(uri)
    _SHIPPED.add(sc.applicationId)


def persist_table(df: DataFrame, name: str, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it; lineage ends there.

    The schema is passed to the reader, so an empty result keeps its columns.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folded(col: str | F.Column) -> F.Column:
    """The comparison form of keys and categories: lower case, outer blanks removed."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.trim(c))


def spread(df: DataFrame, floor: int | None = None) -> DataFrame:
    """Give a scan at least as many partitions as there are task slots.

    A no-op where the scanned files are large enough to be split that finely by Spark itself; a
    round-robin exchange otherwise, before expensive Python stages over small tables.
    """
    spark = df.sparkSession
    slots = floor or spark.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    # as the scan counts: every file costs its bytes and those of opening it
    cost = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.openCostInBytes"))
    size = 0
    for i in range(leaves.size()):
        relation = leaves.apply(i)
        size += int(str(relation.stats().sizeInBytes()))
        if relation.getClass().getSimpleName() == "LogicalRelation":
            size += cost * len(relation.relation().location().inputFiles())
    return df if size >= slots * cost else df.repartition(slots)
