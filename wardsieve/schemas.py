"""Schemas of the tables, requests and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _of(*columns: tuple[str, T.DataType] | str) -> T.StructType:
    return T.StructType([T.StructField(*(c if isinstance(c, tuple) else (c, _S))) for c in columns])


_HEAD = ("detect_result", "category", ("nsfw_score", _D), "model_version")
_TAIL = ("added_by", ("expires_at", _TS), ("created_at", _TS), ("updated_at", _TS))

TEXT_CACHE = _of("content_hash", "normalized_content", *_HEAD, *_TAIL)
IMAGE_CACHE = _of("file_hash", ("phash", _L), *_HEAD, "source_url", *_TAIL)
TEXT_DATASET = T.StructType([T.StructField("id", _L), *TEXT_CACHE])
IMAGE_DATASET = T.StructType([T.StructField("id", _L), *IMAGE_CACHE])
TEXT_REQUEST = _of("request_id", "owner_id", "text")
IMAGE_REQUEST = _of("request_id", "owner_id", "image_url", "file_hash")
_URLS = T.ArrayType(_S)
MIXED_REQUEST = _of("request_id", "owner_id", "text", ("image_urls", _URLS), ("audio_urls", _URLS), ("video_urls", _URLS))
VERDICT = _of("request_id", "action", "verdict", "reason", ("categories", T.ArrayType(_S)), ("scores", T.MapType(_S, _D)))
BAD_WORD = _of("word", "category", ("nsfw_score", _D), "added_by", "model_version")
TEXT_SCORE = _of(("is_nsfw", T.BooleanType()), "safety_label", ("categories", T.ArrayType(_S)))
IMAGE_SCORE = _of(("is_nsfw", T.BooleanType()), ("nsfw_score", _D), ("normal_score", _D), "label", ("confidence", _D))

TABLES = {"text_cache": TEXT_CACHE, "image_cache": IMAGE_CACHE, "text_dataset": TEXT_DATASET, "image_dataset": IMAGE_DATASET}
#: Key column of each table.
KEYS = {"text_cache": "content_hash", "image_cache": "file_hash", "text_dataset": "content_hash", "image_dataset": "file_hash"}
#: Values of columns that an insert leaves out.
DEFAULTS = {"category": "safe", "nsfw_score": 0.0, "added_by": "manual", "source_url": "", "detect_result": "{}"}


def create_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """All tables, empty."""
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}
