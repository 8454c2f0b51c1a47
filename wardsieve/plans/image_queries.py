"""Queries of image hashes, rings, the image cascade and mixed requests, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardsieve.config import ImageSettings
from wardsieve.functions import hashes as H
from wardsieve.operators import admin, moderate, ring, similar
from wardsieve.plans.text_queries import VERDICT_SQL, cache_with_words, cascade_sql, joined, model_scores
from wardsieve.runtime import load

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- hashes ---------------------------------------------------------------------------------


@query("SELECT id, lower(right('0000000000000000' || to_hex(phash), 16)) AS rendered, phash AS back FROM image_dataset WHERE phash IS NOT NULL")
def hash_rendering(spark, d: str) -> DataFrame:
    rows = load(spark, d, "image_dataset").where("phash IS NOT NULL")
    return rows.select("id", H.hash_hex("phash").alias("rendered")).withColumn("back", H.from_hex("rendered"))


@query(
    """SELECT a.row_id, bit_count(xor(a.phash, c.phash)) AS distance, (1 - bit_count(xor(a.phash, c.phash)) / 64.0::DOUBLE) * 100.0::DOUBLE AS score, bit_count(xor(a.phash, c.phash)) <= 10 AS similar
FROM image_batch a JOIN image_cache c ON lower(trim(a.file_hash)) = lower(trim(c.file_hash)) WHERE a.phash IS NOT NULL AND c.phash IS NOT NULL"""
)
def similarity_scores(spark, d: str) -> DataFrame:
    from wardsieve.runtime import folded

    a = load(spark, d, "image_batch").select("row_id", F.col("phash").alias("a"), folded("file_hash").alias("k"))
    c = load(spark, d, "image_cache").select(F.col("phash").alias("b"), folded("file_hash").alias("k"))
    met = a.join(c, "k").where("a IS NOT NULL AND b IS NOT NULL")
    return met.select("row_id", H.hamming("a", "b").alias("distance"), H.similarity_score("a", "b").alias("score"), H.is_similar("a", "b", 10).alias("similar"))


@query(
    """SELECT row_id AS query_id, file_hash, distance, rank FROM (
SELECT b.row_id, c.file_hash, bit_count(xor(b.phash, c.phash)) AS distance, row_number() OVER (PARTITION BY b.row_id ORDER BY bit_count(xor(b.phash, c.phash)), c.file_hash) AS rank
FROM image_batch b JOIN image_cache c ON bit_count(xor(b.phash, c.phash)) <= 10 WHERE c.category <> 'safe' AND b.phash <> 0 AND c.phash <> 0) WHERE rank <= 5"""
)
def find_similar(spark, d: str) -> DataFrame:
    queries = load(spark, d, "image_batch").select(F.col("row_id").alias("query_id"), "phash")
    return similar.find_similar(queries, load(spark, d, "image_cache"))


@query("SELECT b.row_id AS query_id, d.id, d.file_hash, d.category FROM image_batch b JOIN image_dataset d ON d.phash = b.phash")
def find_exact(spark, d: str) -> DataFrame:
    queries = load(spark, d, "image_batch").select(F.col("row_id").alias("query_id"), "phash")
    return similar.by_exact_hash(queries, load(spark, d, "image_dataset")).select("query_id", "id", "file_hash", "category")


@query("SELECT row_id, coalesce(nullif(file_hash, ''), sha256(coalesce(source_url, ''))) AS resolved FROM image_batch")
def resolve_file_hash(spark, d: str) -> DataFrame:
    return load(spark, d, "image_batch").select("row_id", H.resolve_file_hash("file_hash", F.coalesce("source_url", F.lit(""))).alias("resolved"))


@query(
    """WITH l AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings), e AS (SELECT vec_id, exp(a - greatest(a, b)) AS a, exp(b - greatest(a, b)) AS b FROM l)
SELECT vec_id, CASE WHEN a >= b THEN 'normal' ELSE 'nsfw' END AS label, a < b AS is_nsfw, round(b / (a + b), 9) AS nsfw_score, round(a / (a + b), 9) AS normal_score, round(greatest(a, b) / (a + b), 9) AS confidence FROM e"""
)
def softmax_label(spark, d: str) -> DataFrame:
    rows = load(spark, d, "embeddings").select("vec_id", H.image_label(F.slice("embedding", 1, 2), ["normal", "nsfw"]).alias("s"))
    r = lambda c: F.round(f"s.{c}", 9).alias(c)
    return rows.select("vec_id", "s.label", "s.is_nsfw", r("nsfw_score"), r("normal_score"), r("confidence"))


@query()
def murmur_keys(spark, d: str) -> DataFrame:
    return load(spark, d, "customer").select("c_custkey", H.murmur3(F.col("c_custkey").cast("string")).alias("hash"))


# --- rings ----------------------------------------------------------------------------------

_H = "('0x' || substring(sha256({c}), 1, 15))::UBIGINT::BIGINT"
_RING = f"ring AS (SELECT {_H.format(c='concat(n_name, CAST(i AS VARCHAR))')} AS ring_key, n_name AS node FROM nation, range(0, 100) r(i))"


def _ring(spark, d: str) -> DataFrame:
    return ring.ring(load(spark, d, "nation").select(F.col("n_name").alias("node")))


@query(f"WITH {_RING} SELECT ring_key, node FROM ring")
def ring_build(spark, d: str) -> DataFrame:
    return _ring(spark, d)


@query(f"SELECT {_H.format(c='concat(n_name, CAST(i AS VARCHAR))')} AS ring_key, n_name AS node FROM nation, range(0, 100) r(i) WHERE i < floor((n_nationkey * 7) * 100 / 100)")
def ring_weighted(spark, d: str) -> DataFrame:
    return ring.ring(load(spark, d, "nation").select(F.col("n_name").alias("node"), (F.col("n_nationkey") * 7).alias("weight")))


_INNER = _H.format(c="concat('16777619:', CAST(c_custkey AS VARCHAR))")
_PICK = f"CASE WHEN len(nodes) = 1 THEN nodes[1] ELSE nodes[1 + {_INNER} % len(nodes)] END AS node"


def _lookup_sql(ring_: str) -> str:
    return f"""k AS (SELECT ring_key, list_sort(list(DISTINCT node)) AS nodes FROM {ring_} GROUP BY ring_key),
f AS (SELECT v.c_custkey, coalesce(k.nodes, (SELECT arg_min(nodes, ring_key) FROM k)) AS nodes FROM v ASOF LEFT JOIN k ON v.h <= k.ring_key) SELECT c_custkey, {_PICK} FROM f"""


_LOOKUP = f"v AS (SELECT c_custkey, {_H.format(c='CAST(c_custkey AS VARCHAR)')} AS h FROM customer)"


@query(f"WITH {_RING}, {_LOOKUP}, {_lookup_sql('ring')}")
def ring_lookup(spark, d: str) -> DataFrame:
    return ring.lookup(load(spark, d, "customer"), _ring(spark, d), "c_custkey")


@query(f"WITH {_RING}, {_LOOKUP}, less AS (SELECT * FROM ring WHERE node NOT IN ('NATION_7', 'NATION_3')), {_lookup_sql('less')}")
def ring_remove(spark, d: str) -> DataFrame:
    gone = spark.createDataFrame([("NATION_7",), ("NATION_3",)], "node string")
    return ring.lookup(load(spark, d, "customer"), ring.remove(_ring(spark, d), gone), "c_custkey")


# --- images ---------------------------------------------------------------------------------


def image_requests(spark, d: str) -> DataFrame:
    """Batch rows as requests; their score stands for the model's answer."""
    return load(spark, d, "image_batch").select(F.concat(F.lit("img-"), F.col("row_id")).alias("request_id"), "row_id", "file_hash", "phash", F.lit(None).cast("boolean").alias("is_nsfw"), "nsfw_score", "source_url")


def images_sql(gate: bool) -> str:
    return f"""
bad AS (SELECT file_hash, phash, category, coalesce(nsfw_score, 0.0) AS score FROM image_cache WHERE category <> 'safe' AND phash <> 0),
ireq AS (SELECT concat('img-', row_id) AS request_id, row_id, nullif(file_hash, '') AS file_hash, phash, nsfw_score, source_url FROM image_batch),
ic AS (SELECT r.*, c.file_hash IS NOT NULL AS cached, c.category AS ccat, coalesce(c.nsfw_score, 0.0) AS cscore FROM ireq r LEFT JOIN image_cache c ON c.file_hash = r.file_hash),
op AS (SELECT DISTINCT phash FROM ic WHERE NOT cached AND phash <> 0 {"AND phash IN (SELECT phash FROM image_cache WHERE file_hash LIKE 'phash:%' AND category <> 'safe')" if gate else ""}),
near AS (SELECT op.phash, arg_min(bad.score, (bit_count(xor(op.phash, bad.phash)), bad.file_hash)) AS bscore, arg_min(bad.category, (bit_count(xor(op.phash, bad.phash)), bad.file_hash)) AS bcat FROM op JOIN bad ON bit_count(xor(op.phash, bad.phash)) <= 10 GROUP BY op.phash),
ij AS (SELECT ic.*, near.phash IS NOT NULL AND NOT cached AS sim, bscore, bcat, NOT cached AND coalesce(ic.phash = 0, true) AS broken FROM ic LEFT JOIN near ON near.phash = ic.phash),
ires AS (SELECT *, CASE WHEN broken THEN NULL WHEN cached THEN coalesce(ccat <> 'safe', true) WHEN sim THEN true ELSE nsfw_score IS NOT NULL AND nsfw_score >= 0.7 END AS rej, CASE WHEN cached THEN cscore WHEN sim THEN bscore WHEN NOT broken THEN nsfw_score END AS shown FROM ij)"""


_IMAGE_SHOWN = "request_id, cached OR sim AS cache_hit, NOT rej AS is_clean, rej AS should_reject, CASE WHEN cached THEN cscore WHEN sim OR broken THEN 0.0 ELSE coalesce(nsfw_score, 0.0) END AS nsfw_score, shown AS nsfw, CASE WHEN broken THEN 'image could not be decoded' END AS error"


def _images(spark, d: str, gate: bool = True) -> DataFrame:
    return moderate.moderate_images(image_requests(spark, d), load(spark, d, "image_cache"), ImageSettings(gate=gate))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("request_id", "cache_hit", "is_clean", "should_reject", "nsfw_score", F.element_at("image_scores", "nsfw").alias("nsfw"), "error")


@query(f"WITH {images_sql(True)} SELECT {_IMAGE_SHOWN} FROM ires")
def moderate_images(spark, d: str) -> DataFrame:
    return _shown(_images(spark, d))


@query(f"WITH {images_sql(False)} SELECT {_IMAGE_SHOWN} FROM ires")
def moderate_images_similar(spark, d: str) -> DataFrame:
    """The same with the similarity search open to every hash."""
    return _shown(_images(spark, d, gate=False))


@query(
    f"""WITH {images_sql(True)}
SELECT request_id, file_hash, CASE WHEN sim THEN bcat WHEN rej THEN 'unsafe' ELSE 'safe' END AS category, shown AS nsfw_score FROM ires WHERE NOT broken AND NOT cached AND (sim OR nsfw_score IS NOT NULL) AND file_hash IS NOT NULL
UNION ALL SELECT request_id, concat('phash:', phash), 'nsfw', shown FROM ires WHERE NOT broken AND NOT cached AND NOT sim AND rej"""
)
def image_cache_delta(spark, d: str) -> DataFrame:
    return moderate.image_cache_delta(_images(spark, d), F.lit("2026-06-01").cast("timestamp")).select("request_id", "file_hash", "category", "nsfw_score")


@query("SELECT request_id, true AS is_clean, 'AUTO_APPROVE' AS action, 'CLEAN' AS verdict, '' AS reason FROM text_request")
def moderate_video(spark, d: str) -> DataFrame:
    return moderate.moderate_unscored(load(spark, d, "text_request")).select("request_id", "is_clean", "action", "verdict", "reason")


@query("SELECT request_id, true AS is_clean, 'AUTO_APPROVE' AS action, 'CLEAN' AS verdict, '' AS reason FROM text_request")
def moderate_audio(spark, d: str) -> DataFrame:
    return moderate.moderate_unscored(load(spark, d, "text_request")).select("request_id", "is_clean", "action", "verdict", "reason")


# --- mixed requests ---------------------------------------------------------------------------


def _mixed(spark, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A request for each text_batch row: its text, and the images of its and the next row id."""
    rows = load(spark, d, "text_batch").select(F.col("row_id").alias("n"), F.concat(F.lit("mix-"), F.col("row_id")).alias("request_id"), F.col("normalized_content").alias("text"))
    texts = moderate.moderate_text(rows, load(spark, d, "text_cache"), admin.rebuild_filters(cache_with_words(spark, d)), model_scores(spark, d), order=["n"])
    urls = rows.select("request_id", F.posexplode(F.array("n", F.col("n") + 1)).alias("pos", "row_id"))
    results = _images(spark, d).withColumn("row_id", F.substring("request_id", 5, 20).cast("long")).drop("request_id")
    return rows, texts, urls.join(results, "row_id")


def mix_sql(order: str) -> str:
    """CTEs of the mixed cascade, ending in ``mixed``; ``order`` chooses among texts of one form."""
    return f"""{cascade_sql("SELECT row_id AS n, concat('mix-', row_id) AS request_id, normalized_content AS text FROM text_batch", order)},{images_sql(True)},
mi AS (SELECT b.n, p AS pos, i.rej, i.shown FROM req b, range(0, 2) r(p) JOIN ires i ON i.row_id = b.n + p WHERE NOT i.broken),
fi AS (SELECT n, bool_or(rej) AS irej, CASE WHEN bool_or(rej) THEN arg_min(struct_pack(v := shown), pos) FILTER (WHERE rej) ELSE arg_max(struct_pack(v := shown), pos) END.v AS shown FROM mi GROUP BY n),
mixed AS (SELECT v.request_id, v.is_clean AND NOT coalesce(fi.irej, false) AS is_clean, v.should_reject OR coalesce(fi.irej, false) AS should_reject, v.should_review, CASE WHEN v.is_clean THEN '' ELSE v.categories END AS categories, CASE WHEN v.max_nsfw_score > 0 THEN v.max_nsfw_score END AS text_nsfw, fi.shown AS nsfw
FROM verdicts v JOIN req ON req.request_id = v.request_id LEFT JOIN fi ON fi.n = req.n)"""


_MIX = mix_sql("n")


@query(f"{_MIX} SELECT request_id, is_clean, categories, {VERDICT_SQL}, text_nsfw, nsfw FROM mixed")
def moderate_mixed(spark, d: str) -> DataFrame:
    out = moderate.moderate_mixed(*_mixed(spark, d))
    return out.select("request_id", "is_clean", joined("categories").alias("categories"), "action", "verdict", "reason", F.element_at("scores", "text_nsfw").alias("text_nsfw"), F.element_at("scores", "nsfw").alias("nsfw"))


@query(
    """SELECT request_id, action, concat('VERDICT_', verdict) AS verdict, reason, categories
FROM ("""
    + f"{_MIX} SELECT request_id, categories, {VERDICT_SQL} FROM mixed)"
)
def moderate_batch(spark, d: str) -> DataFrame:
    """Responses of a batch of mixed requests."""
    from wardsieve.operators import verdict

    out = verdict.response(moderate.moderate_mixed(*_mixed(spark, d)))
    return out.select("request_id", verdict.wire_name(F.col("action"), "action").alias("action"), verdict.wire_name(F.col("verdict"), "verdict").alias("verdict"), "reason", joined("categories").alias("categories"))
