"""Membership of keys in an ever-growing history with partitioned cuckoo tables.

A key is reduced to 64 hash bits. The table keeps 32 of them (the fingerprint) in one of two
candidate buckets of four slots, so the memory of a shard is about 5 bytes a key however long
the keys are, and a new key is taken for a known one about twice in a billion questions. Shards
are rows of a persisted table (shard, generation, slots), hence a lost executor only repeats its
shards, and a saturated shard grows by another, larger generation instead of being rebuilt from
keys that are no longer at hand.

Rows are put to tables twice. Every task of the first stage has a table of its own, which
answers repeats within its partition; what it has not seen goes on to the shards, so a key that
holds a third of all rows reaches its shard once a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from wardsieve.runtime import folded, load, persist_table

SLOTS = 4
MAX_KICKS = 400
#: Share of slots that a fresh generation is planned to fill.
PLANNED_LOAD = 0.8
#: Share of slots from which a generation is saturated.
FULL_LOAD = 0.92
#: Ranges of row_id that are decided and absorbed one after another.
BATCHES = 4
#: Rows whose id is divisible by this are audited against all keys.
AUDITED = 50
#: Rows that expire before this are forgotten by p7_forgotten.
FORGET_BEFORE = "2026-03-01"
STORE_SCHEMA = "shard int, gen int, items long, slots binary"
#: Output of one step: the shards' new tables, and the answers.
STEP_SCHEMA = f"{STORE_SCHEMA}, kind string, row_id long, seen boolean"


class CuckooTable:
    """One generation of one shard: ``slots`` is (buckets, 4) of uint32, 0 for a free slot.

    Occupied slots of a bucket are its first ones.
    """

    def __init__(self, slots: np.ndarray):
        self.slots = slots
        self.mask = np.uint64(len(slots) - 1)

    @classmethod
    def for_items(cls, n: int) -> CuckooTable:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(n, 1) / (SLOTS * PLANNED_LOAD)))))
        return cls(np.zeros((buckets, SLOTS), np.uint32))

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooTable:
        return cls(np.frombuffer(raw, np.uint32).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    def room(self) -> int:
        """Keys that may be inserted before the table counts as saturated."""
        return max(0, int(FULL_LOAD * self.slots.size) - int(np.count_nonzero(self.slots)))

    @staticmethod
    def fingerprint(h: np.ndarray) -> np.ndarray:
        fp = (h >> np.uint64(32)).astype(np.uint32)
        return np.where(fp == 0, np.uint32(1), fp)

    def _other(self, bucket, fp):
        return (np.uint64(bucket) if np.isscalar(bucket) else bucket) ^ ((np.asarray(fp).astype(np.uint64) * np.uint64(0x5BD1E995)) & self.mask)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fp = self.fingerprint(h)
        first = h & self.mask
        return fp, first, self._other(first, fp)

    def identity(self, h: np.ndarray) -> np.ndarray:
        """Keys of equal identity cannot be told apart by this table."""
        fp, a, b = self.places(h)
        return (np.minimum(a, b) << np.uint64(32)) | fp.astype(np.uint64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        fp, a, b = self.places(h)
        f = fp[:, None]
        return (self.slots[a.astype(np.int64)] == f).any(1) | (self.slots[b.astype(np.int64)] == f).any(1)

    def insert(self, h: np.ndarray) -> np.ndarray:
        """Insert all of ``h``; the positions that found no room are returned."""
        fp, a, b = self.places(h)
        fill = (self.slots != 0).sum(1)
        todo = np.arange(len(h))
        for bucket in (a, b):
            at = bucket[todo].astype(np.int64)
            order = np.argsort(at, kind="stable")
            at = at[order]
            slot = fill[at] + np.arange(len(at)) - np.searchsorted(at, at, "left")
            fits = slot < SLOTS
            self.slots[at[fits], slot[fits]] = fp[todo[order[fits]]]
            np.add.at(fill, at[fits], 1)
            todo = todo[order[~fits]]
        homeless = [i for i in todo.tolist() if not self._kick(int(a[i]), int(b[i]), int(fp[i]), fill)]
        return np.array(homeless, np.int64)

    def _kick(self, a: int, b: int, fp: int, fill: np.ndarray) -> bool:
        """Random walk of evictions, undone when it finds no free slot."""
        path = []
        at, walk = (a, b)[fp & 1], fp * 2654435761 & 0xFFFFFFFF
        mask = int(self.mask)
        for _ in range(MAX_KICKS):
            if fill[at] < SLOTS:
                self.slots[at, fill[at]] = fp
                fill[at] += 1
                return True
            walk = (walk * 1664525 + 1013904223) & 0xFFFFFFFF
            s = walk >> 30
            out = int(self.slots[at, s])
            path.append((at, s, out))
            self.slots[at, s] = fp
            fp = out
            at ^= (fp * 0x5BD1E995) & mask
        for at, s, out in reversed(path):
            self.slots[at, s] = out
        return False

    def delete(self, h: np.ndarray) -> np.ndarray:
        """Remove one copy of each; False where there was none."""
        fp, a, b = self.places(h)
        done = np.zeros(len(h), bool)
        for i in range(len(h)):
            for at in (int(a[i]), int(b[i])):
                hit = np.flatnonzero(self.slots[at] == fp[i])
                if len(hit):
                    last = int((self.slots[at] != 0).sum()) - 1
                    self.slots[at, hit[0]] = self.slots[at, last]
                    self.slots[at, last] = 0
                    done[i] = True
                    break
        return done


class Shard:
    """All generations of one shard."""

    def __init__(self, tables: list[CuckooTable], items: int = 0):
        self.tables, self.items = tables, items

    @classmethod
    def from_rows(cls, rows: pa.Table) -> Shard:
        rows = rows.sort_by("gen")
        return cls([CuckooTable.from_bytes(b) for b in rows["slots"].to_pylist()], max(rows["items"].to_pylist(), default=0))

    def to_rows(self, shard: int) -> pa.Table:
        n = len(self.tables)
        return pa.table({"shard": pa.array([shard] * n, pa.int32()), "gen": pa.array(range(n), pa.int32()), "items": pa.array([self.items] * n, pa.int64()), "slots": pa.array([t.to_bytes() for t in self.tables], pa.binary())})

    def contains(self, h: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(h), bool)
        for t in self.tables:
            hit |= t.contains(h)
        return hit

    def decide(self, h: np.ndarray) -> np.ndarray:
        """The answers of inserting ``h`` one by one, in order, without changing the tables.

        A later key of the same call counts as seen if it cannot be told from an earlier one
        that was new.
        """
        seen = self.contains(h)
        fresh = np.flatnonzero(~seen)
        if len(fresh):
            last = self.tables[-1] if self.tables else CuckooTable.for_items(len(fresh))
            _, first = np.unique(last.identity(h[fresh]), return_index=True)
            again = np.ones(len(fresh), bool)
            again[first] = False
            seen[fresh[again]] = True
        return seen

    def take(self, h: np.ndarray) -> np.ndarray:
        """The answers of ``decide``, after which the tables hold the new keys too."""
        seen = self.decide(h)
        if not seen.all():
            self.insert(h[~seen])
        return seen

    def insert(self, h: np.ndarray) -> None:
        self.items += len(h)
        while len(h):
            room = self.tables[-1].room() if self.tables else 0
            if room:
                h = np.concatenate([h[:room][self.tables[-1].insert(h[:room])], h[room:]])
            if len(h):  # saturated: go on in a generation at least twice as large
                fresh = CuckooTable.for_items(len(h))
                if self.tables and len(fresh.slots) < 2 * len(self.tables[-1].slots):
                    fresh = CuckooTable(np.zeros((2 * len(self.tables[-1].slots), SLOTS), np.uint32))
                self.tables.append(fresh)

    def delete(self, h: np.ndarray) -> None:
        for t in reversed(self.tables):
            if len(h):
                gone = t.delete(h)
                self.items -= int(gone.sum())
                h = h[~gone]


def _hashes(rows: pa.Table) -> np.ndarray:
    return rows["h"].to_numpy().view(np.uint64)


def _step_rows(tables: pa.Table, answers: pa.Table) -> pa.Table:
    """Tables and answers under one schema; what the other has is null."""
    names = {"shard": pa.int32(), "gen": pa.int32(), "items": pa.int64(), "slots": pa.binary(), "kind": pa.string(), "row_id": pa.int64(), "seen": pa.bool_()}
    full = lambda t: pa.table({c: t[c].cast(k) if c in t.column_names else pa.nulls(len(t), k) for c, k in names.items()})
    return pa.concat_tables([full(tables), full(answers)])


@dataclass
class CuckooStore:
    """Persisted shards. ``keys`` arguments are DataFrames with a column ``key``.

    Null keys are never inserted and never seen. An empty history gives an empty table, for
    which every key is new. Every change writes the shards anew and leaves the former store.
    """

    table: DataFrame
    shards: int

    @staticmethod
    def shards_for(n_keys: int, per_shard: int = 200_000) -> int:
        return max(12, -(-n_keys // per_shard))

    def _placed(self, keys: DataFrame) -> DataFrame:
        h = F.xxhash64("key")
        return keys.where("key IS NOT NULL").withColumns({"h": h, "shard": F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(self.shards)).cast("int")})

    def _hashed(self, keys: DataFrame) -> DataFrame:
        """(shard, h), repeats within an Arrow batch folded before anything is exchanged."""

        def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, first = np.unique(b.column(1).to_numpy(), return_index=True)
                yield b.take(pa.array(first))

        return self._placed(keys).select("shard", "h").mapInArrow(once, "shard int, h long")

    @classmethod
    def build(cls, keys: DataFrame, shards: int) -> CuckooStore:
        """Tables of a history of keys, in one pass over them."""
        store = cls(keys, shards)

        def fill(key: tuple, rows: pa.Table) -> pa.Table:
            shard = Shard([])
            shard.insert(np.unique(_hashes(rows)))
            return shard.to_rows(key[0].as_py())

        store.table = persist_table(store._hashed(keys).groupBy("shard").applyInArrow(fill, STORE_SCHEMA), "cuckoo")
        return store

    def _change(self, keys: DataFrame, name: str) -> CuckooStore:
        def change(key: tuple, old: pa.Table, rows: pa.Table) -> pa.Table:
            shard = Shard.from_rows(old)
            if len(rows):
                getattr(shard, name)(np.unique(_hashes(rows)))
            return shard.to_rows(key[0].as_py())

        tables = self.table.groupBy("shard").cogroup(self._hashed(keys).groupBy("shard")).applyInArrow(change, STORE_SCHEMA)
        return CuckooStore(persist_table(tables, "cuckoo"), self.shards)

    def absorb(self, keys: DataFrame) -> CuckooStore:
        """Insert keys that the tables do not hold."""
        return self._change(keys, "insert")

    def delete(self, keys: DataFrame) -> CuckooStore:
        """Forget keys that were absorbed before (only those: a stranger's fingerprint may be another key's)."""
        return self._change(keys, "delete")

    def asked(self, rows: DataFrame, *columns: str) -> DataFrame:
        """(kind, row_id, *columns, shard, h, seen) of rows (kind, row_id, key, ...) of non-null key.

        ``seen`` is the answer of a table that each task fills in order of row_id: a repeat
        within the partition. Memory is about 5 bytes a distinct key of a partition.
        """
        order = ["kind", "row_id", *columns, "shard", "h"]
        placed = self._placed(rows).select(*order).sortWithinPartitions("row_id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Shard([])
            for b in batches:
                seen = own.take(b.column(len(order) - 1).to_numpy().view(np.uint64)) if b.num_rows else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seen)], [*order, "seen"])

        return placed.mapInArrow(run, StructType([*placed.schema.fields, StructField("seen", BooleanType())]))

    def take(self, asked: DataFrame) -> tuple[DataFrame, CuckooStore]:
        """Answers (kind, row_id, seen) to rows (kind, row_id, shard, h), as if they came one by
        one by row_id and each new key was absorbed at once; and the store after them."""

        def step(key: tuple, old: pa.Table, rows: pa.Table) -> pa.Table:
            shard = Shard.from_rows(old)
            rows = rows.sort_by("row_id")
            seen = shard.take(_hashes(rows)) if len(rows) else np.zeros(0, bool)
            return _step_rows(shard.to_rows(key[0].as_py()), rows.select(["kind", "row_id"]).append_column("seen", pa.array(seen, pa.bool_())))

        out = self.table.groupBy("shard").cogroup(asked.select("shard", "h", "kind", "row_id").groupBy("shard")).applyInArrow(step, STEP_SCHEMA)
        out = persist_table(out, "cuckoo")
        return out.where("seen IS NOT NULL").select("kind", "row_id", "seen"), CuckooStore(out.where("slots IS NOT NULL").select("shard", "gen", "items", "slots"), self.shards)

    def contains(self, keys: DataFrame) -> DataFrame:
        """(key, seen) of the distinct non-null keys; the tables stay as they are."""

        def look(_: tuple, old: pa.Table, rows: pa.Table) -> pa.Table:
            seen = Shard.from_rows(old).contains(_hashes(rows)) if len(rows) else np.zeros(0, bool)
            return rows.select(["key"]).append_column("seen", pa.array(seen, pa.bool_()))

        placed = self._placed(keys.select("key").distinct()).select("key", "h", "shard")
        return self.table.groupBy("shard").cogroup(placed.groupBy("shard")).applyInArrow(look, "key string, seen boolean")


def stepped(history: DataFrame, rows: DataFrame, *, per_shard: int = 200_000) -> tuple[DataFrame, list[CuckooStore]]:
    """Answers (kind, row_id, seen) to all rows, and the store before and after each range.

    ``history``: column key. ``rows``: columns kind, row_id (unique within kind), key; rows are
    in order of row_id within a kind and kinds never share keys. A null key is never seen. Each
    kind's rows are taken in BATCHES equal ranges of row_id; the tables answer a range and take
    its new keys in before the next. No answer comes from anything but the tables, so one may be
    wrong, about two in a billion; ``audit`` measures how many are.
    """
    keyed = rows.where("key IS NOT NULL")
    ends = keyed.groupBy("kind").agg(F.min("row_id").alias("low"), F.max("row_id").alias("high"))
    share = (F.col("row_id") - F.col("low")) / (F.col("high") - F.col("low") + 1)
    # as many rows as kinds
    placed = keyed.join(F.broadcast(ends), "kind").withColumn("batch", F.least(F.floor(share * BATCHES), F.lit(BATCHES - 1)).cast("int"))
    stores = [CuckooStore.build(history, CuckooStore.shards_for(history.count(), per_shard))]
    asked = persist_table(stores[0].asked(placed, "batch"), "asked", partition_by=["batch"])
    out = asked.where("seen").select("kind", "row_id", "seen").unionByName(rows.where("key IS NULL").select("kind", "row_id", F.lit(False).alias("seen")))
    for batch in range(BATCHES):
        answers, store = stores[-1].take(asked.where((F.col("batch") == batch) & ~F.col("seen")))
        out = out.unionByName(answers)
        stores.append(store)
    return out, stores


def seen_before(history: DataFrame, rows: DataFrame, **options: int) -> DataFrame:
    """(kind, row_id, seen): the tables' answer to every row; see ``stepped``."""
    return stepped(history, rows, **options)[0]


def audit(history: DataFrame, rows: DataFrame, answers: DataFrame, every: int = AUDITED) -> DataFrame:
    """(kind, n_rows, n_seen, n_audited, n_wrong, wrong_rate): the answers, of which those to rows
    whose id is divisible by ``every`` are compared with all keys."""
    sample = rows.where((F.col("row_id") % every == 0) & F.col("key").isNotNull())
    keys = persist_table(sample.select("key").distinct(), "audited")
    firsts = rows.join(keys, "key", "left_semi").groupBy("key").agg(F.min("row_id").alias("first_id"))
    held = history.join(keys, "key", "left_semi").select("key").distinct().withColumn("held", F.lit(True))
    true = sample.join(firsts, "key").join(held, "key", "left").select("kind", "row_id", (F.col("held").isNotNull() | (F.col("first_id") < F.col("row_id"))).alias("exact"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    wrong = n(F.col("exact") != F.col("seen"))
    met = answers.join(true, ["kind", "row_id"], "left")
    return met.groupBy("kind").agg(F.count("*").alias("n_rows"), n(F.col("seen")).alias("n_seen"), F.count("exact").alias("n_audited"), wrong.alias("n_wrong"), F.when(F.count("exact") > 0, wrong / F.count("exact")).alias("wrong_rate"))


def _tagged(kind: str, c: F.Column) -> F.Column:
    return F.when(c != "", F.concat(F.lit(f"{kind}:"), c))


def _inputs(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    history = load(spark, sf_dir, "text_cache").select(_tagged("text", folded("content_hash")).alias("key"))
    texts = load(spark, sf_dir, "text_batch").select(F.lit("text").alias("kind"), "row_id", _tagged("text", folded("content_hash")).alias("key"))
    words = load(spark, sf_dir, "bad_word").select(F.lit("word").alias("kind"), F.col("req_id").alias("row_id"), _tagged("word", folded("word")).alias("key"))
    return history, texts.unionByName(words)


def p7_found(spark, sf_dir: str) -> DataFrame:
    """(kind, row_id) of the rows that the tables have seen."""
    return seen_before(*_inputs(spark, sf_dir)).where("seen").select("kind", "row_id")


def p7_audit(spark, sf_dir: str) -> DataFrame:
    """Answers by kind, and how many of the audited ones were wrong."""
    history, rows = _inputs(spark, sf_dir)
    return audit(history, rows, seen_before(history, rows))


def p7_audit_all(spark, sf_dir: str) -> DataFrame:
    """The same with every answer to a row of non-null key compared: no sample."""
    history, rows = _inputs(spark, sf_dir)
    return audit(history, rows, seen_before(history, rows), every=1)


def p7_growth(spark, sf_dir: str) -> DataFrame:
    """(batch, n_keys): keys that the tables hold after the history (-1) and after each range."""
    _, stores = stepped(*_inputs(spark, sf_dir))
    held = lambda i, s: s.table.where("gen = 0").agg(F.coalesce(F.sum("items"), F.lit(0)).alias("n_keys")).select(F.lit(i - 1).alias("batch"), "n_keys")
    out = held(0, stores[0])
    for i, s in enumerate(stores[1:], 1):
        out = out.unionByName(held(i, s))
    return out.where("n_keys > 0")


def p7_forgotten(spark, sf_dir: str) -> DataFrame:
    """(key, seen): every cached key, asked again after the keys of expired rows were deleted."""
    rows = load(spark, sf_dir, "text_cache").select(_tagged("text", folded("content_hash")).alias("key"), F.coalesce(F.col("expires_at") < F.lit(FORGET_BEFORE).cast("timestamp"), F.lit(False)).alias("gone"))
    store = CuckooStore.build(rows.select("key"), CuckooStore.shards_for(rows.count()))
    gone = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("gone").alias("gone")).where("gone").select("key")
    return store.delete(gone).contains(rows.select("key"))


QUERIES = {"p7_found": p7_found, "p7_audit": p7_audit, "p7_audit_all": p7_audit_all, "p7_growth": p7_growth, "p7_forgotten": p7_forgotten}

_KEYS = """
WITH cache AS (SELECT DISTINCT lower(trim(content_hash)) AS k FROM text_cache WHERE trim(content_hash) <> ''),
b AS (SELECT row_id, lower(trim(content_hash)) AS k FROM text_batch),
w AS (SELECT req_id AS row_id, lower(trim(word)) AS k FROM bad_word),
r AS (SELECT 'text' AS kind, row_id, nullif(k, '') AS k FROM b UNION ALL SELECT 'word', row_id, nullif(k, '') FROM w),
f AS (SELECT kind, k, min(row_id) AS first_id FROM r WHERE k IS NOT NULL GROUP BY kind, k),
s AS (SELECT r.kind, r.row_id, r.k, coalesce(r.row_id > f.first_id OR (r.kind = 'text' AND cache.k IS NOT NULL), false) AS seen
  FROM r LEFT JOIN f ON f.kind = r.kind AND f.k = r.k LEFT JOIN cache ON cache.k = r.k)
"""
ORACLES = {
    "p7_found": _KEYS + "SELECT kind, row_id FROM s WHERE seen",
    # of the few thousand answers that are audited here, none is wrong
    "p7_audit": _KEYS
    + f"""SELECT kind, count(*) AS n_rows, CAST(sum(seen::INT) AS BIGINT) AS n_seen, count(*) FILTER (WHERE k IS NOT NULL AND row_id % {AUDITED} = 0) AS n_audited, CAST(0 AS BIGINT) AS n_wrong,
CASE WHEN count(*) FILTER (WHERE k IS NOT NULL AND row_id % {AUDITED} = 0) > 0 THEN 0.0::DOUBLE END AS wrong_rate FROM s GROUP BY kind""",
    "p7_audit_all": _KEYS
    + """SELECT kind, count(*) AS n_rows, CAST(sum(seen::INT) AS BIGINT) AS n_seen, count(k) AS n_audited, CAST(0 AS BIGINT) AS n_wrong, CASE WHEN count(k) > 0 THEN 0.0::DOUBLE END AS wrong_rate FROM s GROUP BY kind""",
    "p7_growth": _KEYS
    + f""", e AS (SELECT kind, min(row_id) AS low, max(row_id) AS high FROM r WHERE k IS NOT NULL GROUP BY kind),
new AS (SELECT least(CAST(floor((s.row_id - low) / (high - low + 1)::DOUBLE * {BATCHES}) AS INT), {BATCHES - 1}) AS batch FROM s JOIN e USING (kind) WHERE k IS NOT NULL AND NOT seen)
SELECT i AS batch, (SELECT count(*) FROM cache) + (SELECT count(*) FROM new WHERE new.batch <= i) AS n_keys FROM (SELECT CAST(unnest(range(-1, {BATCHES})) AS INT) AS i) WHERE n_keys > 0""",
    "p7_forgotten": f"""SELECT 'text:' || lower(trim(content_hash)) AS key, NOT bool_and(coalesce(expires_at < TIMESTAMP '{FORGET_BEFORE}', false)) AS seen
FROM text_cache WHERE trim(content_hash) <> '' GROUP BY 1""",
}
