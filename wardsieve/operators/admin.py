"""Administration of the blocklist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardsieve.functions.text import sha_key
from wardsieve.operators import tables

#: Author and model of a word added without them.
ADDED_BY, MODEL_VERSION = "manual", "Qwen/Qwen3Guard-Gen-0.6B"


def word_rows(requests: DataFrame) -> DataFrame:
    """Cache rows of requests (req_id, word, category, nsfw_score, added_by, model_version,
    requested_at): keyed by the word as given, without expiry; a score outside 0..1, or none,
    becomes 1. Null words are left out."""
    score = F.when(F.col("nsfw_score").between(0, 1), F.col("nsfw_score")).otherwise(1.0)
    return requests.where("word IS NOT NULL").select(
        "req_id", sha_key("word").alias("content_hash"), F.col("word").alias("normalized_content"), F.lit("{}").alias("detect_result"), "category", score.alias("nsfw_score"), F.coalesce("model_version", F.lit(MODEL_VERSION)).alias("model_version"),
        F.coalesce("added_by", F.lit(ADDED_BY)).alias("added_by"), F.lit(None).cast("timestamp").alias("expires_at"), F.col("requested_at").alias("created_at"), F.col("requested_at").alias("updated_at"),
    )


def add_bad_words(cache: DataFrame, requests: DataFrame) -> DataFrame:
    """The cache after all requests, by req_id."""
    return tables.upsert(cache, word_rows(requests), "content_hash", ["req_id"])


def remove_bad_words(cache: DataFrame, words: DataFrame) -> DataFrame:
    """The cache without rows keyed by these words as given."""
    return tables.delete(cache, words.where("word IS NOT NULL").select(sha_key("word").alias("content_hash")), "content_hash")


def list_bad_words(cache: DataFrame, category: str = "", limit: int = 10, offset: int = 0) -> DataFrame:
    """A page with ``total``; safe rows too if no category is given; limit 0 gives none."""
    total = tables.count(cache, category).first().n
    return tables.listing(cache, "content_hash", category=category, limit=limit, offset=offset).withColumn("total", F.lit(total).cast("long"))


def rebuild_filters(cache: DataFrame) -> DataFrame:
    """The blocklist: every cached text that is not safe, as word, category, nsfw_score."""
    return cache.where(F.col("category") != "safe").select(F.col("normalized_content").alias("word"), "category", F.coalesce("nsfw_score", F.lit(0.0)).alias("nsfw_score"))
