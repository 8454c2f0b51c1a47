"""Queries of the keyed tables, paging and the key-value cache, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardsieve.operators import paging, tables
from wardsieve.runtime import load
from wardsieve.schemas import KEYS
from wardsieve.sources import kv

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

NOW = datetime(2026, 5, 16)
_NOW = "TIMESTAMPTZ '2026-05-16 00:00:00+00'"
#: Rows that are upserted into, looked up in or deleted from each table.
CHANGES = {"text_cache": "text_batch", "image_cache": "image_batch", "text_dataset": "text_cache", "image_dataset": "image_cache"}


def add(name: str, f, sql: str = "") -> None:
    QUERIES[name] = f
    if sql:
        ORACLES[name] = sql


def _upsert(table: str, order: list[str], replaced: tuple[str, ...]):
    key, changes = KEYS[table], CHANGES[table]
    kept = [c for c in ("id", "normalized_content", "phash", "source_url", "added_by", "expires_at", "created_at") if (c != "id" or table.endswith("dataset")) and (c not in ("phash", "source_url") or table.startswith("image")) and (c != "normalized_content" or table.startswith("text"))]
    kept = [c for c in kept if c not in replaced]
    default = {"category": "'safe'", "nsfw_score": "0.0", "added_by": "'manual'", "source_url": "''", "detect_result": "'{}'"}
    src = lambda c: f"coalesce({c}, {default[c]})" if c in default else "NULL" if c == "id" else c
    seq = ", ".join(order)
    fold = ", ".join([*(f"arg_min(struct_pack(v := {src(c)}), ({seq})).v AS {c}" for c in kept), *(f"arg_max(struct_pack(v := {src(c)}), ({seq})).v AS {c}" for c in replaced)])
    value = ", ".join([*(f"CASE WHEN t.{key} IS NOT NULL THEN t.{c} ELSE f.{c} END AS {c}" for c in kept), *(f"CASE WHEN f.{key} IS NOT NULL THEN f.{c} ELSE t.{c} END AS {c}" for c in replaced)])
    sql = f"WITH f AS (SELECT {key}, {fold} FROM {changes} WHERE {key} IS NOT NULL GROUP BY {key}) SELECT coalesce(t.{key}, f.{key}) AS {key}, {value} FROM {table} t FULL JOIN f ON f.{key} = t.{key}"

    def run(spark, d: str) -> DataFrame:
        rows = load(spark, d, changes)
        if "id" in load(spark, d, table).columns and "id" not in rows.columns:
            rows = rows.withColumn("id", F.lit(None).cast("long"))
        return tables.upsert(load(spark, d, table), rows, key, order, replaced=replaced)

    add(f"{table}_upsert", run, sql)


_upsert("text_cache", ["batch_no", "row_id"], tables.REPLACED)
_upsert("image_cache", ["batch_no", "row_id"], tables.REPLACED)
_upsert("text_dataset", ["created_at", "content_hash"], tables.REPLACED)
_upsert("image_dataset", ["created_at", "file_hash"], (*tables.REPLACED, "source_url"))

for _t, _k in KEYS.items():
    _c = CHANGES[_t]
    _more = "normalized_content" if _t.startswith("text") else "phash"

    def _bind(t: str = _t, k: str = _k, c: str = _c, more: str = _more) -> None:
        t_ = lambda spark, d: load(spark, d, t)
        c_ = lambda spark, d: load(spark, d, c)
        gone = t.replace("dataset", "batch").replace("cache", "batch")
        add(f"{t}_get", lambda s, d: tables.get(t_(s, d), c_(s, d).where(f"{k} IS NOT NULL"), k).select(k, more, "category", "nsfw_score"), f"SELECT c.{k}, t.{more}, t.category, t.nsfw_score FROM (SELECT DISTINCT {k} FROM {c} WHERE {k} IS NOT NULL) c LEFT JOIN {t} t ON t.{k} = c.{k}")
        add(f"{t}_delete", lambda s, d: tables.delete(t_(s, d), load(s, d, gone), k).select(k, "category"), f"SELECT {k}, category FROM {t} WHERE {k} NOT IN (SELECT {k} FROM {gone} WHERE {k} IS NOT NULL)")
        add(f"{t}_count", lambda s, d: tables.count(t_(s, d)), f"SELECT count(*) AS n FROM {t}")
        add(f"{t}_count_by_category", lambda s, d: tables.count(t_(s, d), "unsafe"), f"SELECT count(*) AS n FROM {t} WHERE category = 'unsafe'")
        add(f"{t}_list", lambda s, d: tables.listing(t_(s, d), k, limit=20, offset=10).select(k, "category", "created_at"), f"SELECT {k}, category, created_at FROM {t} ORDER BY created_at DESC, {k} LIMIT 20 OFFSET 10")
        add(f"{t}_list_by_category", lambda s, d: tables.listing(t_(s, d), k, category="unsafe", limit=20).select(k, "category", "created_at"), f"SELECT {k}, category, created_at FROM {t} WHERE category = 'unsafe' ORDER BY created_at DESC, {k} LIMIT 20")
        add(f"{t}_all", t_, f"SELECT * FROM {t}")
        if t.endswith("cache"):
            add(f"{t}_delete_expired", lambda s, d: tables.delete_expired(t_(s, d), F.lit("2026-05-16 00:00:00").cast("timestamp")).select(k, "expires_at"), f"SELECT {k}, expires_at FROM {t} WHERE expires_at IS NULL OR expires_at >= {_NOW}")
            add(f"{t}_expired", lambda s, d: t_(s, d).where(tables.is_expired(F.lit("2026-05-16 00:00:00").cast("timestamp"))).agg(F.count("*").alias("n")), f"SELECT count(*) AS n FROM {t} WHERE expires_at < {_NOW}")
        else:
            add(f"{t}_get_by_id", lambda s, d: tables.get_by_id(t_(s, d), 7).select("id", k, "category"), f"SELECT id, {k}, category FROM {t} WHERE id = 7")

    _bind()


def _update(table: str, columns: list[str], sources: dict[str, str], joined: str) -> None:
    def run(spark, d: str) -> DataFrame:
        t = load(spark, d, table)
        changes = (load(spark, d, "text_review") if table == "text_dataset" else t.where("nsfw_score IS NULL")).selectExpr("id", *[f"{v} AS {c}" for c, v in sources.items()])
        return tables.update_by_id(t, changes, columns).select("id", *columns)

    value = ", ".join(f"CASE WHEN r.id IS NOT NULL THEN {v} ELSE t.{c} END AS {c}" for c, v in sources.items())
    add(f"{table}_update", run, f"SELECT t.id, {value} FROM {table} t LEFT JOIN {joined} r ON r.id = t.id")


_update(
    "text_dataset", ["category", "nsfw_score", "added_by", "updated_at"],
    {"category": "CASE WHEN abusive = 1 THEN 'unsafe' ELSE 'safe' END", "nsfw_score": "CAST(abusive AS DOUBLE)", "added_by": "reviewer", "updated_at": "TIMESTAMP '2026-05-16 00:00:00'"}, "text_review",
)
_update(
    "image_dataset", ["category", "nsfw_score", "source_url", "added_by", "updated_at"],
    {"category": "'unsafe'", "nsfw_score": "CAST(0.5 AS DOUBLE)", "source_url": "''", "added_by": "'repair'", "updated_at": "TIMESTAMP '2026-05-16 00:00:00'"}, "(SELECT id FROM image_dataset WHERE nsfw_score IS NULL)",
)


def _sync(kind: str, key: str) -> None:
    text = kind == "text"
    skip = "AND (normalized_content IS NULL OR normalized_content NOT IN (SELECT normalized_content FROM text_dataset WHERE normalized_content IS NOT NULL))" if text else ""
    once = f"QUALIFY normalized_content IS NULL OR row_number() OVER (PARTITION BY normalized_content ORDER BY {key}) = 1" if text else ""
    sql = f"""WITH new AS (SELECT * FROM {kind}_cache WHERE category <> 'safe' AND {key} NOT IN (SELECT {key} FROM {kind}_dataset) {skip} {once})
SELECT id, {key}, category, nsfw_score FROM {kind}_dataset UNION ALL
SELECT (SELECT coalesce(max(id), 0) FROM {kind}_dataset) + row_number() OVER (ORDER BY {key}) AS id, {key}, category, nsfw_score FROM new"""
    add(f"{kind}_dataset_sync", lambda s, d: tables.sync_dataset(load(s, d, f"{kind}_cache"), load(s, d, f"{kind}_dataset"), key).select("id", key, "category", "nsfw_score"), sql)


_sync("text", "content_hash")
_sync("image", "file_hash")

# --- pages ----------------------------------------------------------------------------------

add(
    "keyset_page",
    lambda s, d: paging.keyset_rows(load(s, d, "text_cache"), "created_at", "content_hash", after=(datetime(2026, 1, 1), "8"), limit=50).select("content_hash", "created_at"),
    "SELECT content_hash, created_at FROM text_cache WHERE (created_at, content_hash) < (TIMESTAMPTZ '2026-01-01 00:00:00+00', '8') ORDER BY created_at DESC, content_hash DESC LIMIT 51",
)
add(
    "keyset_page_ascending",
    lambda s, d: paging.keyset_rows(load(s, d, "orders"), "o_orderdate", "o_orderkey", order=paging.ASC, limit=25).select("o_orderkey", "o_orderdate"),
    "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 26",
)
add(
    "offset_page",
    lambda s, d: paging.offset_page(load(s, d, "customer"), [F.col("c_acctbal").desc(), F.col("c_custkey")], page=3, size=20).select("c_custkey", "c_acctbal"),
    "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40",
)
add(
    "cursor_column",
    lambda s, d: load(s, d, "text_cache").select("content_hash", paging.cursor_column(id=F.col("content_hash")).alias("cursor")),
    """SELECT content_hash, translate(to_base64(encode('{"id":"' || content_hash || '"}')), '+/', '-_') AS cursor FROM text_cache""",
)


def _kv(spark, d: str) -> DataFrame:
    writes = load(spark, d, "events").select(F.concat(F.lit("user:"), F.col("user_id")).alias("key"), F.col("value").cast("string").alias("value"), F.col("ts").cast("timestamp").alias("written_at"), F.when(F.col("event_type") == "error", 3600).otherwise(30 * 86400).cast("long").alias("ttl_seconds"))
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return kv.get(writes, writes, now).select("key", F.expr("try_cast(value AS double)").alias("value"))


add(
    "kv_get",
    _kv,
    """WITH w AS (SELECT concat('user:', user_id) AS key, value, ts, CASE WHEN event_type = 'error' THEN 3600 ELSE 30 * 86400 END AS ttl FROM events),
l AS (SELECT key, max(ts) AS ts FROM w GROUP BY key), v AS (SELECT w.* FROM w JOIN l USING (key, ts))
SELECT DISTINCT key, CASE WHEN floor(epoch(ts)) + ttl > epoch(TIMESTAMP '2024-01-20 00:00:00') THEN value END AS value FROM v""",
)
