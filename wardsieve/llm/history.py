"""Checking new batches against everything accepted before.

What was accepted is kept in a store, two tables in a folder: keys (of texts, of files, of whole
image hashes), and inverted-file cells with the full 64-bit image hashes. Both are bucketed by
their lookup key, so a batch is exchanged to meet them and they are not. A batch is put to the
store as it stands and then appended; no row of the history or of an earlier batch is read from
its source again.

The 64 bits are cut into three segments; in each the centroids are the words of the binary Golay
code, whose balls of radius 3 fill the space, so a row lies in exactly one cell of each segment,
at a residual of 0 to 3. Two hashes within distance d agree within d/3 bits in some segment, and
the triangle inequality then names the cells that can hold the other: those whose centroid is
within 3 + d/3 of the query. A query first looks into its own cells and leaves if a match there
suffices; otherwise it goes on to all cells that may hold one. A full cell is split: newer rows
go to sub-cells, one for each value of the segment, which are asked for by the values within d/3
bits of the query's.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardsieve.runtime import folded, load, persist_table, shared_path

MAX_BITS = 8
#: (shift, bits) of the segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Batches that are put to the store together.
AT_ONCE = 3
#: Rows that a cell takes; newer ones go to its sub-cells.
CELL_ROWS = 1_000
#: Fixed value: generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b1010_1110_0011
LENGTH, CHECKS, RADIUS = 23, 11, 3


@cache
def _columns() -> list[int]:
    """Remainder of x^i by the generator, for each bit i."""
    out, r = [], 1
    for _ in range(LENGTH):
        out.append(r)
        r <<= 1
        if r >> CHECKS:
            r ^= GENERATOR
    return out


@cache
def offsets(reach: int) -> pd.DataFrame:
    """(syndrome, e, k): for a word of this syndrome, word^e is a centroid at distance k <= reach.

    With reach 3 there is one row for each of the 2048 syndromes; with 5 there are 44,552 rows.
    """
    syndrome, pattern, weight = [], [], []
    for k in range(reach + 1):
        for bits in combinations(range(LENGTH), k):
            s = p = 0
            for b in bits:
                s ^= _columns()[b]
                p |= 1 << b
            syndrome.append(s)
            pattern.append(p)
            weight.append(k)
    return pd.DataFrame({"syndrome": np.array(syndrome, np.int32), "e": np.array(pattern, np.int32), "k": np.array(weight, np.int32)})


@cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the low 12 bits and of the bits above; that of a word is their exclusive or."""
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << (LENGTH - 12), np.int64)
    for i, c in enumerate(_columns()):
        part, bit = (low, 1 << i) if i < 12 else (high, 1 << (i - 12))
        part[(np.arange(len(part)) & bit) > 0] ^= c
    return low, high


@cache
def _by_syndrome(reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``offsets`` sorted by syndrome: where each starts, e, k."""
    t = offsets(reach).sort_values(["syndrome", "k", "e"])
    return np.searchsorted(t["syndrome"], np.arange((1 << CHECKS) + 1)), t["e"].to_numpy(np.int64), t["k"].to_numpy(np.int64)


@cache
def _flips() -> np.ndarray:
    """All differences of up to CLOSE bits within a segment."""
    width = max(n for _, n in SEGMENTS)
    return np.array([sum(1 << b for b in bits) for k in range(CLOSE + 1) for bits in combinations(range(width), k)], np.int64)


def _cells_within(phash: np.ndarray, reach: int) -> tuple[np.ndarray, ...]:
    """(row, seg, word, cell, k): the cells within ``reach`` of each segment of each hash."""
    start, e, k = _by_syndrome(reach)
    low, high = _syndromes()
    h = phash.view(np.uint64)
    out = []
    for seg, (shift, bits) in enumerate(SEGMENTS):
        word = ((h >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        s = low[word & 4095] ^ high[word >> 12]
        n = start[s + 1] - start[s]
        row = np.repeat(np.arange(len(word)), n)
        at = np.repeat(start[s] - (np.cumsum(n) - n), n) + np.arange(len(row))
        out.append((row, np.full(len(row), seg), word[row], (seg << 24) + (word[row] ^ e[at]), k[at]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sub_cell(seg: np.ndarray, word: np.ndarray) -> np.ndarray:
    return ((seg + len(SEGMENTS)) << 24) + word


#: Bits in which a pair within MAX_BITS differs at most in some segment.
CLOSE = MAX_BITS // len(SEGMENTS)
KEY_SCHEMA = "key string, tag string, step int, batch_no int, row_id long"
CELL_SCHEMA = "cell long, phash long, batch_no int, row_id long, residual int, head boolean"
_ROW = ["phash", "batch_no", "row_id"]
#: Number of the history among batches.
HISTORY = -1


def _merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of which no side is broadcast. Plans reckon probes at the size of the rows they are
    made of, of which each gives a hundred and more; keys and rows grow with the batches."""
    return left.hint("merge").join(right.hint("merge"), on, how)


class BatchStore:
    """Keys and cells in one folder. Appending adds files and touches none of the old ones.

    ``buckets`` is fixed when a folder is first used (default: the session's task slots); choose
    it so that a bucket fits a task. Opening the same folder again goes on where it was left.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *, buckets: int | None = None):
        self.spark, self.path = spark, path or shared_path(spark, "batches")
        self.buckets = buckets or spark.sparkContext.defaultParallelism
        mark = uuid.uuid4().hex
        self._keys, self._cells = f"keys_{mark}", f"cells_{mark}"
        for name, schema, key in ((self._keys, KEY_SCHEMA, "key"), (self._cells, CELL_SCHEMA, "cell")):
            spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name.split('_')[0]}'")
        # rows of each cell: 12,288 numbers at most
        self.sizes: dict[int, int] = dict(map(tuple, self.cells().where(F.col("cell") < _LIMIT).groupBy("cell").count().collect()))
        self.steps: int = self.keys().agg(F.coalesce(F.max("step") + 1, F.lit(0))).first()[0]

    def close(self) -> None:
        """Forget the tables' names; the folder stays."""
        for name in (self._keys, self._cells):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def keys(self) -> DataFrame:
        return self.spark.table(self._keys)

    def cells(self) -> DataFrame:
        return self.spark.table(self._cells)

    def _append(self, rows: DataFrame, name: str, key: str) -> None:
        rows.repartition(self.buckets, key).write.insertInto(name)

    def _full(self) -> np.ndarray:
        return np.array(sorted(c for c, n in self.sizes.items() if n > CELL_ROWS), np.int64)

    def admit(self, keyed: DataFrame) -> DataFrame:
        """Append the keys of (tag, key, batch_no, row_id) that the store does not hold, each with
        its first row, and return them. Copies are folded to one row a key before they meet the
        store. Null keys are left out."""
        step, self.steps = self.steps, self.steps + 1
        firsts = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("batch_no", "row_id", "tag")).alias("f"))
        new = _merged(firsts, self.keys().select("key"), "key", "left_anti")
        self._append(new.select("key", "f.tag", F.lit(step).alias("step"), "f.batch_no", "f.row_id"), self._keys, "key")
        return self.keys().where(F.col("step") == step)

    def append(self, rows: DataFrame) -> None:
        """Add rows (phash, batch_no, row_id) of hashes that the cells do not hold. Null and 0
        hashes are left out."""
        rows = rows.where("phash <> 0").select(*_ROW)

        def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(_cells_within(b.column(0).to_numpy(), RADIUS)[3])], ["cell"])

        for cell, n in rows.mapInArrow(homes, "cell long").groupBy("cell").count().collect():  # 12,288 rows at most
            self.sizes[cell] = self.sizes.get(cell, 0) + n
        full = self._full()

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                row, seg, word, cell, k = _cells_within(b.column(0).to_numpy(), RADIUS)
                crowded = np.isin(cell, full)
                cells = pa.array(np.where(crowded, _sub_cell(seg, word), cell))
                yield pa.RecordBatch.from_arrays([cells, *b.take(pa.array(row)).columns, pa.array(k.astype(np.int32)), pa.array(~crowded)], ["cell", *_ROW, "residual", "head"])

        placed = rows.mapInArrow(place, CELL_SCHEMA)
        if len(full):
            # the first row of a sub-cell is its head
            led = self.cells().where((F.col("cell") >= _LIMIT) & F.col("head")).select("cell", F.lit(True).alias("led"))
            placed = persist_table(placed, "placed")
            fine = placed.where("NOT head")
            first = _merged(fine.groupBy("cell").agg(F.min_by("phash", F.struct("batch_no", "row_id", "phash")).alias("first")), led, "cell", "left_anti")
            fine = _merged(fine, first, "cell", "left").withColumn("head", F.coalesce(F.col("phash") == F.col("first"), F.lit(False)))
            placed = placed.where("head").unionByName(fine.select(*placed.columns))
        self._append(placed, self._cells, "cell")

    def _met(self, probes: DataFrame, heads: bool) -> DataFrame:
        """(row_id, distance) of probes (phash, batch_no, row_id, cell, k) and earlier rows within
        8 bits; k is null where any row of the cell may match."""
        rows = self.cells().where("head") if heads else self.cells()
        rows = rows.select("cell", "residual", *[F.col(c).alias(f"x_{c}") for c in _ROW])
        gap = F.bit_count(F.col("phash").bitwiseXOR(F.col("x_phash")))
        earlier = (F.col("x_batch_no") < F.col("batch_no")) | ((F.col("x_batch_no") == F.col("batch_no")) & (F.col("x_row_id") < F.col("row_id")))
        near = F.col("k").isNull() | (F.abs(F.col("k") - F.col("residual")) <= CLOSE)
        return _merged(probes, rows, "cell").where(near & earlier & (gap <= MAX_BITS)).groupBy("row_id").agg(F.min(gap).alias("distance"))

    def probe(self, queries: DataFrame, *, nearest: bool = False) -> DataFrame:
        """(row_id, distance): queries (phash, batch_no, row_id) with an earlier row within 8 bits.

        Earlier is by (batch_no, row_id); rows of the queries' own batch must be appended before.
        With ``nearest`` the distance is the least. Without, a query leaves as soon as it has any
        match, and its own sub-cells are asked for their heads (first rows) only, so a crowd of
        altered copies is not compared with itself.
        """
        asked = queries.where("phash <> 0").select(*_ROW)
        schema, full = "phash long, batch_no int, row_id long, cell long, k int", self._full()

        def rows_of(b: pa.RecordBatch, row: np.ndarray, cell: np.ndarray, k: np.ndarray | None) -> pa.RecordBatch:
            ks = pa.nulls(len(row), pa.int32()) if k is None else pa.array(k.astype(np.int32))
            return pa.RecordBatch.from_arrays([*b.take(pa.array(row)).columns, pa.array(cell), ks], [*_ROW, "cell", "k"])

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                row, seg, word, cell, _ = _cells_within(b.column(0).to_numpy(), RADIUS)
                yield rows_of(b, row, cell, None)
                held = np.isin(cell, full)
                yield rows_of(b, row[held], _sub_cell(seg, word)[held], None)

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                row, seg, word, cell, k = _cells_within(b.column(0).to_numpy(), RADIUS + CLOSE)
                yield rows_of(b, row, cell, k)
                held = np.isin(cell, full)
                if held.any():
                    split = np.unique(np.stack([row[held], seg[held], word[held]], 1), axis=0)
                    flips = _flips()  # values beyond a segment's bits name no sub-cell
                    near = (split[:, 2][:, None] ^ flips).ravel()
                    yield rows_of(b, np.repeat(split[:, 0], len(flips)), _sub_cell(np.repeat(split[:, 1], len(flips)), near), None)

        met = self._met(asked.mapInArrow(own, schema), heads=not nearest)
        # rows not met so far differ in every segment, by 3 bits or more in all
        settled = met.where(F.col("distance") <= len(SEGMENTS)) if nearest else met
        left = _merged(asked, settled.select("row_id"), "row_id", "left_anti").select(*_ROW)
        more = self._met(left.mapInArrow(others, schema), heads=False)
        return met.unionByName(more).groupBy("row_id").agg(F.min("distance").alias("distance"))

    def check(self, keyed: DataFrame) -> DataFrame:
        """(tag, row_id) of the known rows of (tag, key, batch_no, row_id), which are taken in.

        Keys are unique over tags; rows of tag 'p' have image hashes for keys. A row is known if
        its key is in the store or an earlier one of these rows, or its hash is near such a one.
        Null keys match nothing. The result is kept in the store's folder.
        """
        keyed = keyed.where("key IS NOT NULL")
        new = self.admit(keyed)
        hashes = hashes_of(new)
        self.append(hashes)
        near = self.probe(hashes).select(F.lit("p").alias("tag"), "row_id")
        again = _merged(keyed.select("tag", "row_id"), new.select("tag", "row_id"), ["tag", "row_id"], "left_anti")
        folder = f"{self.path}/known/step={self.steps - 1}"
        again.unionByName(near).write.mode("overwrite").parquet(folder)
        return self.spark.read.schema("tag string, row_id long").parquet(folder)

    def known(self, since: int = 0) -> DataFrame:
        """(tag, row_id): what ``check`` found from this step on; a row may come twice."""
        folders = [f"{self.path}/known/step={i}" for i in range(since, self.steps)]
        schema = "tag string, row_id long"
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)


def hashes_of(keys: DataFrame) -> DataFrame:
    """(phash, batch_no, row_id) of the image hashes among keys."""
    return keys.where("tag = 'p'").select(F.substring("key", 3, 20).cast("long").alias("phash"), "batch_no", "row_id")


#: Cells have smaller numbers, sub-cells greater ones.
_LIMIT = len(SEGMENTS) << 24


def tagged(tag: str, key: Column) -> Column:
    """Keys of several kinds in one column; empty ones become null."""
    return F.when(key != "", F.concat(F.lit(f"{tag}:"), key))


def keyed_texts(rows: DataFrame, *more: str) -> DataFrame:
    """(tag, key, *more) of rows with content_hash; keys ignore case and outer blanks."""
    return rows.select(F.lit("t").alias("tag"), tagged("t", folded("content_hash")).alias("key"), *more)


def keyed_images(rows: DataFrame, *more: str) -> DataFrame:
    """(tag, key, *more) of rows with file_hash and phash: one row for each of both. Null and 0
    hashes have no key."""
    files = rows.select(F.lit("f").alias("tag"), tagged("f", folded("file_hash")).alias("key"), *more)
    hashes = rows.select(F.lit("p").alias("tag"), F.when(F.col("phash") != 0, F.concat(F.lit("p:"), F.col("phash").cast("string"))).alias("key"), *more)
    return files.unionByName(hashes)


def run(store: BatchStore, keyed: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(tag, row_id) of all known rows of (tag, key, batch_no, row_id), ``at_once`` batches a step.

    Rows without a batch number come before all others, as batch 0. Order within a step is kept
    row by row, so the number of batches in it changes nothing but the time.
    """
    rows = keyed.where("key IS NOT NULL").withColumn("batch_no", F.coalesce("batch_no", F.lit(0)))
    rows = persist_table(rows.select("tag", "key", "row_id", "batch_no"), "incoming", partition_by=["batch_no"])
    since = store.steps
    numbers = sorted(r.batch_no for r in rows.select("batch_no").distinct().collect())
    for i in range(0, len(numbers), at_once):
        store.check(rows.where(F.col("batch_no").isin(numbers[i : i + at_once])))
    return store.known(since).distinct()


def _known(spark, sf_dir: str, path: str | None) -> DataFrame:
    """(kind, row_id) of known rows. A new store takes in the caches first."""
    store = BatchStore(spark, path)
    if not store.steps:
        past = keyed_texts(load(spark, sf_dir, "text_cache")).unionByName(keyed_images(load(spark, sf_dir, "image_cache")))
        store.append(hashes_of(store.admit(past.withColumns({"batch_no": F.lit(HISTORY), "row_id": F.lit(-1).cast("long")}))))
    texts = keyed_texts(load(spark, sf_dir, "text_batch"), "row_id", "batch_no")
    known = run(store, texts.unionByName(keyed_images(load(spark, sf_dir, "image_batch"), "row_id", "batch_no")))
    store.close()
    return known.select(F.when(F.col("tag") == "t", "text").otherwise("image").alias("kind"), "row_id").distinct()


def p4_found(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """(kind, row_id) of known rows. ``path``: folder of the store, by default a new one."""
    return _known(spark, sf_dir, path)


def p4_batches(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Rows and known rows of each batch."""
    one = lambda kind: load(spark, sf_dir, f"{kind}_batch").select(F.lit(kind).alias("kind"), "batch_no", "row_id")
    known = _known(spark, sf_dir, path).withColumn("known", F.lit(1))
    rows = one("text").unionByName(one("image")).join(known, ["kind", "row_id"], "left")
    return rows.groupBy("kind", "batch_no").agg(F.count("*").alias("n_rows"), F.count("known").alias("n_known"))


_KNOWN = """
WITH t AS (SELECT row_id, batch_no, nullif(lower(trim(content_hash)), '') AS k FROM text_batch),
tc AS (SELECT DISTINCT lower(trim(content_hash)) AS k FROM text_cache),
i AS (SELECT row_id, batch_no, nullif(lower(trim(file_hash)), '') AS k, nullif(phash, 0) AS p FROM image_batch),
ic AS (SELECT lower(trim(file_hash)) AS k, nullif(phash, 0) AS p FROM image_cache),
known AS (
SELECT 'text' AS kind, row_id FROM t WHERE k IN (SELECT k FROM tc WHERE k IS NOT NULL) OR EXISTS (SELECT 1 FROM t e WHERE e.k = t.k AND (e.batch_no, e.row_id) < (t.batch_no, t.row_id))
UNION
SELECT 'image' AS kind, row_id FROM i WHERE k IN (SELECT k FROM ic WHERE k IS NOT NULL) OR EXISTS (SELECT 1 FROM i e WHERE e.k = i.k AND (e.batch_no, e.row_id) < (i.batch_no, i.row_id))
UNION
SELECT 'image' AS kind, i.row_id FROM i JOIN ic ON bit_count(xor(i.p, ic.p)) <= 8
UNION
SELECT 'image' AS kind, i.row_id FROM i JOIN i e ON bit_count(xor(i.p, e.p)) <= 8 AND (e.batch_no < i.batch_no OR (e.batch_no = i.batch_no AND e.row_id < i.row_id)))
"""
QUERIES = {"p4_found": p4_found, "p4_batches": p4_batches}
ORACLES = {
    "p4_found": _KNOWN + "SELECT kind, row_id FROM known",
    "p4_batches": _KNOWN
    + """SELECT r.kind, r.batch_no, count(*) AS n_rows, count(known.row_id) AS n_known
FROM (SELECT 'text' AS kind, batch_no, row_id FROM t UNION ALL SELECT 'image', batch_no, row_id FROM i) r LEFT JOIN known ON known.kind = r.kind AND known.row_id = r.row_id GROUP BY r.kind, r.batch_no""",
}
