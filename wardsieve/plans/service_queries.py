"""Queries of the service's calls, guard prompts and scorers, key-value verbs and image bytes, with
their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardsieve.functions import hashes as H
from wardsieve.functions import imagehash
from wardsieve.functions import text as X
from wardsieve.plans import image_queries as I
from wardsieve.plans import text_queries as T
from wardsieve.runtime import load, persist_table
from wardsieve.service import Service
from wardsieve.sources import chat, kv, scorers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- calls ------------------------------------------------------------------------------------


def service(spark, d: str) -> Service:
    return Service(T.cache_with_words(spark, d), load(spark, d, "image_cache"), T.model_scores(spark, d))


def _response(df: DataFrame) -> DataFrame:
    return df.select("request_id", "action", "verdict", "reason", T.joined("categories").alias("categories"), F.element_at("scores", "text_nsfw").alias("text_nsfw"))


@query(f"{T.cascade_sql(T._FIRST, 'request_id')} SELECT request_id, {T.VERDICT_SQL}, categories, CASE WHEN max_nsfw_score > 0 THEN max_nsfw_score END AS text_nsfw FROM verdicts")
def call_text(spark, d: str) -> DataFrame:
    return _response(service(spark, d).moderate_text(T.first_requests(spark, d).select("request_id", "text")))


@query(
    f"""WITH {I.images_sql(True)}
SELECT request_id, CASE WHEN rej THEN 'AUTO_REJECT' ELSE 'AUTO_APPROVE' END AS action, CASE WHEN rej THEN 'REJECT' ELSE 'CLEAN' END AS verdict, shown AS nsfw, CASE WHEN broken THEN 'image could not be decoded' END AS error FROM ires"""
)
def call_image(spark, d: str) -> DataFrame:
    out = service(spark, d).moderate_image(I.image_requests(spark, d).drop("row_id"))
    return out.select("request_id", "action", "verdict", F.element_at("scores", "nsfw").alias("nsfw"), "error")


_UNSCORED = "SELECT request_id, 'AUTO_APPROVE' AS action, 'CLEAN' AS verdict, '' AS reason, 0 AS n_scores FROM text_request"


@query(_UNSCORED)
def call_video(spark, d: str) -> DataFrame:
    return service(spark, d).moderate_video(load(spark, d, "text_request")).select("request_id", "action", "verdict", "reason", F.size("scores").alias("n_scores"))


@query(_UNSCORED)
def call_audio(spark, d: str) -> DataFrame:
    return service(spark, d).moderate_audio(load(spark, d, "text_request")).select("request_id", "action", "verdict", "reason", F.size("scores").alias("n_scores"))


def _mixed(spark, d: str) -> tuple[DataFrame, DataFrame]:
    rows = load(spark, d, "text_batch").select(F.col("row_id").alias("n"), F.concat(F.lit("mix-"), F.col("row_id")).alias("request_id"), F.col("normalized_content").alias("text"))
    urls = rows.select("request_id", F.posexplode(F.array("n", F.col("n") + 1)).alias("pos", "row_id"))
    return rows.select("request_id", "text"), urls.join(I.image_requests(spark, d).drop("request_id").hint("merge"), "row_id").drop("row_id")


_MIXED = f"{I.mix_sql('request_id')} SELECT request_id, {T.VERDICT_SQL}, categories, text_nsfw, nsfw FROM mixed"


def _mixed_response(df: DataFrame) -> DataFrame:
    return df.select("request_id", "action", "verdict", "reason", T.joined("categories").alias("categories"), F.element_at("scores", "text_nsfw").alias("text_nsfw"), F.element_at("scores", "nsfw").alias("nsfw"))


@query(_MIXED)
def call_mixed(spark, d: str) -> DataFrame:
    return _mixed_response(service(spark, d).moderate(*_mixed(spark, d)))


@query(_MIXED)
def call_batch(spark, d: str) -> DataFrame:
    return _mixed_response(service(spark, d).batch_moderate(*_mixed(spark, d)))


def _plain_service(spark, d: str) -> Service:
    return Service(load(spark, d, "text_cache"), load(spark, d, "image_cache"))


@query(f"WITH {T.CACHE2} SELECT content_hash, normalized_content, category, nsfw_score, model_version, added_by, created_at, updated_at FROM cache2")
def call_add_words(spark, d: str) -> DataFrame:
    return _plain_service(spark, d).add_bad_words(load(spark, d, "bad_word")).text_cache.drop("detect_result", "expires_at")


@query(f"WITH {T.CACHE2} SELECT content_hash, category FROM cache2 WHERE content_hash NOT IN (SELECT sha256(word) FROM bad_word WHERE word IS NOT NULL AND added_by IS NULL)")
def call_remove_words(spark, d: str) -> DataFrame:
    gone = load(spark, d, "bad_word").where("added_by IS NULL")
    return service(spark, d).remove_bad_words(gone).text_cache.select("content_hash", "category")


@query(f"WITH {T.CACHE2} SELECT content_hash, category, (SELECT count(*) FROM cache2) AS total FROM cache2 ORDER BY created_at DESC, content_hash LIMIT 10")
def call_list_words(spark, d: str) -> DataFrame:
    return service(spark, d).list_bad_words().select("content_hash", "category", "total")


@query(f"WITH {T.WORDS} SELECT category, count(*) AS n, (SELECT count(*) FROM words) AS total FROM words GROUP BY category")
def call_rebuild(spark, d: str) -> DataFrame:
    words, total = service(spark, d).rebuild_filters()
    return words.groupBy("category").agg(F.count("*").alias("n")).withColumn("total", F.lit(total).cast("long"))


# --- guards and scorers -------------------------------------------------------------------------


def _filled(template: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    before, after = template.split("{user}")
    middle, *end = after.split("{assistant}")
    return f"concat({quoted(before)}, u, {quoted(middle)}" + (f", a, {quoted(end[0])})" if end else ")")


_TALKS = "SELECT row_id, normalized_content AS u, CASE WHEN row_id % 2 = 0 THEN coalesce(category, '') ELSE '' END AS a, CASE WHEN row_id % 3 = 0 THEN 'Llama-Guard3:1b' WHEN row_id % 3 = 1 THEN 'llamaguard' ELSE 'any-guard' END AS m FROM text_batch WHERE normalized_content IS NOT NULL"


def _talks(spark, d: str) -> DataFrame:
    rows = load(spark, d, "text_batch").where("normalized_content IS NOT NULL")
    model = F.when(F.col("row_id") % 3 == 0, "Llama-Guard3:1b").when(F.col("row_id") % 3 == 1, "llamaguard").otherwise("any-guard")
    return rows.select("row_id", F.col("normalized_content").alias("u"), F.when(F.col("row_id") % 2 == 0, F.coalesce("category", F.lit(""))).otherwise("").alias("a"), model.alias("m"))


@query(
    f"""SELECT row_id, CASE WHEN m <> 'any-guard' AND a = '' THEN {_filled(X.LLAMA_USER)} WHEN m <> 'any-guard' THEN {_filled(X.LLAMA_PAIR)}
WHEN a = '' THEN {_filled(X.GENERIC_USER)} ELSE {_filled(X.GENERIC_PAIR)} END AS prompt FROM ({_TALKS})"""
)
def guard_prompts(spark, d: str) -> DataFrame:
    """All four prompts, whole."""
    return _talks(spark, d).select("row_id", X.guard_prompt("u", "a", "m").alias("prompt"))


def _answers(requests: list[str]) -> list[str]:
    """Stands in for a guard's transport: judges by the conversation's first letter."""
    import json

    out = []
    for r in requests:
        said = json.loads(r)["messages"][0].get("content") or ""
        if not said:
            raise ValueError("empty message")
        out.append("Safety: Unsafe\nCategories: PII" if said[0] in "aeiou" else "Safety: Safe\nCategories: None")
    return out


@query(
    f"""SELECT row_id, CASE WHEN u <> '' THEN NOT contains('aeiou', substring(u, 1, 1)) END AS is_safe, CASE WHEN u <> '' THEN CASE WHEN contains('aeiou', substring(u, 1, 1)) THEN 2 ELSE 0 END END AS severity,
CASE WHEN u <> '' THEN CASE WHEN contains('aeiou', substring(u, 1, 1)) THEN 'PII' ELSE '' END END AS categories, CASE WHEN u = '' THEN 'empty message' END AS error FROM ({_TALKS})"""
)
def guard_verdicts(spark, d: str) -> DataFrame:
    """Requests of a label-style guard, sent in batches, and its parsed answers; an item that
    fails has its error and costs the others nothing."""
    out = chat.moderate(_talks(spark, d), "row_id", "u", "a", "guard", _answers)
    return out.select("row_id", "verdict.is_safe", "verdict.severity", F.when(F.col("verdict").isNotNull(), T.joined("verdict.categories")).alias("categories"), "error")


def _scored(texts: list[str]) -> list[str]:
    if "" in texts:
        raise ValueError("nothing to score")
    return [f"Safety: {'Controversial' if len(t) % 2 else 'Safe'}\nCategories: {'Violent' if len(t) % 2 else 'None'}" for t in texts]


@query(
    """SELECT row_id, CASE WHEN normalized_content <> '' THEN false END AS is_nsfw, CASE WHEN normalized_content <> '' THEN CASE WHEN len(normalized_content) % 2 = 1 THEN 'Controversial' ELSE 'Safe' END END AS safety_label,
CASE WHEN normalized_content = '' THEN 'nothing to score' END AS error FROM text_batch WHERE normalized_content IS NOT NULL"""
)
def scored_texts(spark, d: str) -> DataFrame:
    """A scorer over all rows in batches, with errors by item."""
    rows = load(spark, d, "text_batch").select("row_id", "normalized_content")
    out = scorers.apply_scorer(rows, "row_id", "normalized_content", _scored)
    parsed = X.parse_scorer_output("result")
    return out.select("row_id", F.when(F.col("error").isNull(), parsed).alias("s"), "error").select("row_id", "s.is_nsfw", "s.safety_label", "error")


@query(
    """WITH t AS (SELECT owner_id, epoch_us(received_at) AS turn, coalesce(text, '') AS text, count(*) OVER (PARTITION BY owner_id, received_at) AS same FROM text_request WHERE owner_id IS NOT NULL),
n AS (SELECT owner_id, turn, text, CASE WHEN len(text) % 2 = 0 THEN 'user' ELSE 'assistant' END AS role FROM t WHERE same = 1),
f AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM n WINDOW w AS (PARTITION BY owner_id ORDER BY turn))
SELECT owner_id, turn, text AS user_text, CASE WHEN next_role = 'assistant' THEN next_text END AS assistant_text FROM f WHERE role = 'user'"""
)
def conversation_pairs(spark, d: str) -> DataFrame:
    """Each owner's messages as turns, of even length by the user and of odd length by the other
    side; messages at one instant have no order and are left out."""
    rows = load(spark, d, "text_request").where("owner_id IS NOT NULL").select("owner_id", F.unix_micros("received_at").alias("turn"), F.coalesce("text", F.lit("")).alias("text"))
    alone = rows.groupBy("owner_id", "turn").agg(F.min("text").alias("text"), F.count("*").alias("n")).where("n = 1")
    turns = alone.select(F.col("owner_id").alias("conv_id"), "turn", F.when(F.length("text") % 2 == 0, "user").otherwise("assistant").alias("role"), "text")
    out = chat.conversation_pairs(turns, span=6 * 3600 * 1_000_000)
    return out.select(F.col("conv_id").alias("owner_id"), "turn", F.col("user").alias("user_text"), F.col("assistant").alias("assistant_text"))


# --- key-value verbs ----------------------------------------------------------------------------

_KV = """WITH w AS (SELECT concat('user:', user_id) AS key, CAST(event_id AS VARCHAR) AS value, ts, CASE WHEN event_type = 'error' THEN 3600 ELSE 30 * 86400 END AS ttl FROM events),
l AS (SELECT key, arg_max(struct_pack(value, ttl, ts), (ts, value)) AS m FROM w GROUP BY key),
g AS (SELECT key, m.value AS value, floor(epoch(m.ts)) + m.ttl > epoch(TIMESTAMP '2024-01-20 00:00:00') AS live FROM l)
"""


def _writes(spark, d: str) -> DataFrame:
    return load(spark, d, "events").select(F.concat(F.lit("user:"), F.col("user_id")).alias("key"), F.col("event_id").cast("string").alias("value"), F.col("ts").cast("timestamp").alias("written_at"), F.when(F.col("event_type") == "error", 3600).otherwise(30 * 86400).cast("long").alias("ttl_seconds"))


def _now() -> Column:
    return F.lit("2024-01-20 00:00:00").cast("timestamp")


def _some(writes: DataFrame) -> DataFrame:
    return writes.select("key").distinct().where("key LIKE '%1'")


@query(_KV + "SELECT key, live AS present FROM g")
def kv_exists(spark, d: str) -> DataFrame:
    w = _writes(spark, d)
    return kv.exists(w, w, _now())


@query(_KV + "SELECT key, CASE WHEN key LIKE '%1' THEN 'new' WHEN live THEN value END AS value FROM g")
def kv_put(spark, d: str) -> DataFrame:
    w = _writes(spark, d)
    late = F.lit("2024-03-01 00:00:00").cast("timestamp")
    put = kv.put(w.where(F.col("written_at") < late), _some(w).withColumn("value", F.lit("new")), late, 60)
    return kv.get(put, w, late).where("key LIKE '%1'").unionByName(kv.get(w, w, _now()).where("key NOT LIKE '%1'"))


@query(_KV + "SELECT key, key NOT LIKE '%1' AND live AS present FROM g")
def kv_delete(spark, d: str) -> DataFrame:
    w = _writes(spark, d)
    return kv.exists(kv.delete(w, _some(w)), w, _now())


@query(_KV + "SELECT key, key LIKE '%1' OR live AS present FROM g")
def kv_expire(spark, d: str) -> DataFrame:
    """Some keys get a new lifetime of a minute, and are there again however old they were."""
    w = _writes(spark, d)
    return kv.exists(kv.expire(w, _some(w), _now(), 60), w, _now())


# --- hashes -------------------------------------------------------------------------------------

#: Published MurmurHash3 x64 128 results for seed 0, first 64 bits.
MURMUR = {
    "": "0000000000000000",
    "hello": "cbd8a7b341bd9b02",
    "hello, world": "342fac623a5ebc8e",
    "19 Jan 2038 at 3:14:07 AM": "b89e5988b737affc",
    "The quick brown fox jumps over the lazy dog.": "cd99481f9ee902c9",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{h}')" for t, h in MURMUR.items()) + ") v(text, hash)")
def murmur_published(spark, d: str) -> DataFrame:
    rows = spark.createDataFrame([(t,) for t in MURMUR], "text string")
    return rows.select("text", H.hash_hex(H.murmur3("text")).alias("hash"))


def _drawn(bits: Column, width: int, pixel) -> Column:
    """The image struct of a grey picture of 8 lines of ``width`` pixels, drawn from 64 bits."""
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(8 * width - 1)), lambda i: F.lpad(F.hex(pixel(bits, i).cast("long")), 2, "0")), ""))
    return F.struct(F.lit(8).alias("height"), F.lit(width).alias("width"), F.lit(1).alias("nChannels"), data.alias("data"))


def _bit(bits: Column, i: Column) -> Column:
    return F.expr("1L").bitwiseAND(F.call_function("shiftrightunsigned", bits, (63 - i).cast("int")))


@query("SELECT id, phash AS average, phash AS difference FROM image_dataset WHERE phash IS NOT NULL AND bit_count(phash) BETWEEN 1 AND 63")
def drawn_hashes(spark, d: str) -> DataFrame:
    """Average and difference hash of pictures drawn so that their hash is known: light pixels
    for set bits, and lines that rise or fall by the bits."""
    rows = load(spark, d, "image_dataset").where("phash IS NOT NULL AND bit_count(phash) BETWEEN 1 AND 63")
    p = F.col("phash")
    light = _drawn(p, 8, lambda b, i: _bit(b, i) * 255)

    def slope(b: Column, i: Column) -> Column:
        line, at = F.floor(i / 9), i % 9
        steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.when(j < at, F.when(_bit(b, line * 8 + j) == 1, 10).otherwise(-10)).otherwise(0))
        return 120 + F.aggregate(steps, F.lit(0), lambda x, y: x + y)

    drawn = persist_table(rows.select("id", light.alias("light"), _drawn(p, 9, slope).alias("slope")), "drawn")
    return drawn.select("id", imagehash.image_hash_udf(imagehash.AHASH)("light").alias("average"), imagehash.image_hash_udf(imagehash.DHASH)("slope").alias("difference"))
