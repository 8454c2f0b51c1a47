"""The text cascade over a stream of requests, batch by batch.

The cache is a folder of deltas, one per batch id. A batch reads the base cache and the deltas
of earlier batches, decides its requests, and writes its results and its delta under its id,
so a batch that is run again after a failure overwrites its own output and nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardsieve.config import TextSettings
from wardsieve.operators.moderate import moderate_text, text_cache_delta
from wardsieve.schemas import TEXT_CACHE

_BATCH = re.compile(r"(batch|compacted)=(\d+)$")


class TextStream:
    """State and sink folders of one stream under ``path``."""

    def __init__(self, spark: SparkSession, path: str, cache: DataFrame, words: DataFrame, scores: DataFrame | None = None, settings: TextSettings = TextSettings()):
        self.spark, self.path = spark, path.rstrip("/")
        self.cache, self.words, self.scores, self.settings = cache, words, scores, settings

    def _written(self, kind: str, before: int | None = None) -> list[str]:
        """Folders of batches, the last compacted one in place of those it holds."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().toString() for s in fs.listStatus(root)] if fs.exists(root) else []
        found = [(int(m[2]), m[1], n) for n in names if (m := _BATCH.search(n)) and (before is None or int(m[2]) < before)]
        folded = max((x for x in found if x[1] == "compacted"), default=None)
        return ([folded[2]] if folded else []) + [n for i, kind_, n in found if kind_ == "batch" and (folded is None or i > folded[0])]

    def compact(self) -> None:
        """Fold the cache rows of all batches but the last, which may be run again, into one
        folder, so that later batches read few files. Safe to break off at any point."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/cache")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        ids = sorted(int(m[2]) for s in (fs.listStatus(root) if fs.exists(root) else []) if (m := _BATCH.search(s.getPath().toString())) and m[1] == "batch")
        if len(ids) < 2:
            return
        upto = ids[-2]
        self.deltas(upto + 1).write.mode("overwrite").parquet(f"{self.path}/cache/_folding")
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/cache/compacted={upto}")
        fs.delete(done, True)
        fs.rename(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/cache/_folding"), done)
        for s in fs.listStatus(root):
            m = _BATCH.search(s.getPath().toString())
            if m and (int(m[2]) < upto or (m[1] == "batch" and int(m[2]) == upto)):
                fs.delete(s.getPath(), True)

    def deltas(self, before: int | None = None) -> DataFrame:
        """Cache rows written by batches, or by those before ``before``."""
        paths = self._written("cache", before)
        return self.spark.read.schema(TEXT_CACHE).parquet(*paths) if paths else self.spark.createDataFrame([], TEXT_CACHE)

    def answered(self, before: int) -> DataFrame:
        """Ids that earlier batches answered: a request delivered again is left out."""
        paths, schema = self._written("results", before), "request_id string"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def results(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/results/*")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        cache = self.cache.select(*TEXT_CACHE.names).unionByName(self.deltas(batch_id))
        order = [c for c in ("received_at", "owner_id") if c in batch.columns]
        first = batch.groupBy("request_id").agg(F.min(F.struct(*order, "text")).alias("r")).select("request_id", "r.*")
        fresh = first.join(self.answered(batch_id), "request_id", "left_anti")
        out = moderate_text(fresh, cache, self.words, self.scores, self.settings, order=[*order[:1], "request_id"])
        folder = f"{self.path}/results/batch={batch_id}"
        out.write.mode("overwrite").parquet(folder)
        written = self.spark.read.parquet(folder)  # the delta follows what was written, not a second run
        text_cache_delta(written, F.current_timestamp()).write.mode("overwrite").parquet(f"{self.path}/cache/batch={batch_id}")

    def start(self, requests: DataFrame, *, available_now: bool = True, after: Callable[[int], None] | None = None):
        """Run over a streaming DataFrame (request_id, text); ``after`` is called with each
        finished batch id."""

        def each(batch: DataFrame, batch_id: int) -> None:
            self.process(batch, batch_id)
            if after:
                after(batch_id)

        writer = requests.writeStream.foreachBatch(each).option("checkpointLocation", f"{self.path}/checkpoint")
        return writer.trigger(availableNow=True).start() if available_now else writer.trigger(processingTime="10 seconds").start()


def request_rates(requests: DataFrame, *, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Requests by hour of sending over a stream, with a watermark for late arrivals."""
    return requests.withWatermark("sent_at", late).groupBy(F.window("sent_at", window)).agg(F.count("*").alias("n_requests")).select(F.col("window.start").alias("hour"), "n_requests")
