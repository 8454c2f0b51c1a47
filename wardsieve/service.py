"""The service's calls over DataFrames: one method a call, a batch of requests at a time."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardsieve.config import Settings
from wardsieve.operators import admin, moderate, verdict
from wardsieve.schemas import create_tables


@dataclass
class Service:
    """Tables and settings that the calls work on.

    Calls never change a table in place: those that write return the new state, and
    ``moderate_*`` leave the rows to be written to ``text_delta`` and ``image_delta``.
    """

    text_cache: DataFrame
    image_cache: DataFrame
    text_scores: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)

    @classmethod
    def empty(cls, spark) -> Service:
        t = create_tables(spark)
        return cls(t["text_cache"], t["image_cache"])

    def blocklist(self) -> DataFrame:
        return admin.rebuild_filters(self.text_cache)

    def text_results(self, requests: DataFrame, order: list[str] | None = None) -> DataFrame:
        return moderate.moderate_text(requests, self.text_cache, self.blocklist(), self.text_scores, self.settings.text, order=order)

    def image_results(self, requests: DataFrame) -> DataFrame:
        return moderate.moderate_images(requests, self.image_cache, self.settings.image)

    def moderate_text(self, requests: DataFrame) -> DataFrame:
        """Responses to (request_id, text)."""
        return verdict.response(self.text_results(requests))

    def moderate_image(self, requests: DataFrame) -> DataFrame:
        """Responses to (request_id, file_hash, phash, is_nsfw, nsfw_score, source_url), with ``error``."""
        results = self.image_results(requests)
        shown = moderate.with_verdict(results.withColumns({"categories": F.array().cast("array<string>"), "max_nsfw_score": F.lit(0.0)}))
        return verdict.response(shown, ["error"])

    def moderate_video(self, requests: DataFrame) -> DataFrame:
        return verdict.response(moderate.moderate_unscored(requests))

    moderate_audio = moderate_video

    def moderate(self, requests: DataFrame, images: DataFrame) -> DataFrame:
        """Responses to mixed requests (request_id, text) with their images (request_id, pos and
        the columns of an image request)."""
        keyed = images.withColumns({"request_id": F.to_json(F.struct("request_id", "pos"))})
        results = self.image_results(keyed)
        back = F.from_json("request_id", "request_id string, pos int")
        results = results.withColumn("k", back).withColumns({"request_id": F.col("k.request_id"), "pos": F.col("k.pos")})
        return verdict.response(moderate.moderate_mixed(requests, self.text_results(requests), results))

    #: A batch of mixed requests is a DataFrame already; a failing item carries its error.
    batch_moderate = moderate

    def text_delta(self, requests: DataFrame, now) -> DataFrame:
        return moderate.text_cache_delta(self.text_results(requests), now)

    def image_delta(self, requests: DataFrame, now) -> DataFrame:
        return moderate.image_cache_delta(self.image_results(requests), now)

    def add_bad_words(self, requests: DataFrame) -> Service:
        return Service(admin.add_bad_words(self.text_cache, requests), self.image_cache, self.text_scores, self.settings)

    def remove_bad_words(self, words: DataFrame) -> Service:
        return Service(admin.remove_bad_words(self.text_cache, words), self.image_cache, self.text_scores, self.settings)

    def list_bad_words(self, category: str = "", limit: int = 10, offset: int = 0) -> DataFrame:
        return admin.list_bad_words(self.text_cache, category, limit, offset)

    def rebuild_filters(self) -> tuple[DataFrame, int]:
        """The blocklist and how many words it has."""
        words = self.blocklist()
        return words, words.count()
