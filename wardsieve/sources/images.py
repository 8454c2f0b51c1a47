"""Images from files: bytes, content hashes, decoding, perceptual hashes."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.error import HTTPError
from urllib.request import urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardsieve.functions.imagehash import PHASH, image_hash_udf

#: Image kinds that are decoded, by file ending and by content type.
ENDINGS = ("gif", "jpg", "jpeg", "png")


def fetch(spark: SparkSession, path: str) -> DataFrame:
    """(url, content, length, file_hash) of files under ``path``; the hash is SHA-256 of the bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("url"), "content", "length", F.sha2("content", 256).alias("file_hash"))


def download(rows: DataFrame, key: str, url: str, *, seconds: float = 30.0, images_only: bool = False) -> DataFrame:
    """(key, content, file_hash, error) of what each URL gives, in Arrow batches on the workers.

    An answer other than 200, a time-out, an unreadable URL, or with ``images_only`` a content
    type that is none of an image, gives an error and null content, and costs other rows nothing.
    Null URLs are errors.
    """
    kind = rows.schema[key].dataType.simpleString()

    def get(address: str | None) -> tuple[bytes | None, str | None]:
        try:
            with urlopen(address or "", timeout=seconds) as answer:
                if answer.status != 200:
                    return None, f"status {answer.status}"
                if images_only and not (answer.headers.get_content_type() or "").startswith("image/"):
                    return None, f"not an image: {answer.headers.get_content_type()}"
                return answer.read(), None
        except HTTPError as e:
            return None, f"status {e.code}"
        except (OSError, ValueError) as e:
            return None, str(e) or type(e).__name__

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [get(u) for u in pdf[url]]
            yield pd.DataFrame({key: pdf[key], "content": [c for c, _ in got], "error": [e for _, e in got]})

    out = rows.select(key, url).mapInPandas(run, f"`{key}` {kind}, content binary, error string")
    return out.select(key, "content", F.sha2("content", 256).alias("file_hash"), "error")


def is_image(url: str = "url", content_type: str | None = None) -> F.Column:
    """Whether a fetched item may be an image: by content type if known, else by ending."""
    if content_type:
        return F.coalesce(F.col(content_type).startswith("image/"), F.lit(False))
    return F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]+)$", 1)).isin(*ENDINGS)


def decode(spark: SparkSession, path: str) -> DataFrame:
    """(url, image) of decodable files; others are dropped by the source."""
    return spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", "true").load(path).select(F.col("image.origin").alias("url"), "image")


def hashed(spark: SparkSession, path: str, kind: int = PHASH) -> DataFrame:
    """(url, file_hash, phash): one scan for the bytes' hash, one for the pixels'; files that do
    not decode keep a null phash."""
    pixels = decode(spark, path).select(F.regexp_replace("url", r"^file:/+", "/").alias("u"), image_hash_udf(kind)("image").alias("phash"))
    files = fetch(spark, path).select("url", "file_hash", F.regexp_replace("url", r"^file:/+", "/").alias("u"))
    return files.join(pixels, "u", "left").select("url", "file_hash", "phash")
