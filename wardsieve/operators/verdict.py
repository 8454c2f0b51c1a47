"""Verdicts: flags of results turned into action, verdict, reason, category and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reasons of the verdicts.
REJECT_REASON, REVIEW_REASON = "Content rejected due to policy violation", "Content flagged for manual review"


def _choose(reject: Column, review: Column, a: str, b: str, c: str) -> Column:
    return F.when(reject, a).when(review, b).otherwise(c)


def action(reject: Column, review: Column) -> Column:
    return _choose(reject, review, "AUTO_REJECT", "PENDING_REVIEW", "AUTO_APPROVE")


def verdict(reject: Column, review: Column) -> Column:
    return _choose(reject, review, "REJECT", "REVIEW", "CLEAN")


def reason(reject: Column, review: Column) -> Column:
    return _choose(reject, review, REJECT_REASON, REVIEW_REASON, "")


def category(reject: Column, review: Column) -> Column:
    """The category a result is cached under."""
    return _choose(reject, review, "unsafe", "controversial", "safe")


def flags_of(category_: Column) -> dict[str, Column]:
    """Flags that a cached text row stands for."""
    return {"is_clean": category_ == "safe", "should_reject": category_ == "unsafe", "should_review": category_ == "controversial"}


def wire_name(c: Column, kind: str) -> Column:
    """Names of actions and verdicts in responses; unknown ones are unspecified.
    Actions have no prefix."""
    known = {"action": ("AUTO_APPROVE", "AUTO_REJECT", "PENDING_REVIEW"), "verdict": ("CLEAN", "REJECT", "REVIEW")}[kind]
    prefix = {"action": "", "verdict": "VERDICT_"}[kind]
    return F.when(c.isin(*known), F.concat(F.lit(prefix), c)).otherwise(F.lit(f"{prefix}UNSPECIFIED"))


def scores(text_score: Column, image: Column | None = None, video_nsfw: Column | None = None, video_violence: Column | None = None) -> Column:
    """map of scores: text and video ones only if positive, image ones (a map) always."""
    parts = []
    for name, c in (("text_nsfw", text_score), ("video_nsfw", video_nsfw), ("video_violence", video_violence)):
        if c is not None:
            parts.append(F.when(c > 0, F.create_map(F.lit(name), c.cast("double"))).otherwise(F.create_map().cast("map<string,double>")))
    if image is not None:
        parts.insert(1, F.coalesce(image, F.create_map().cast("map<string,double>")))
    return F.map_concat(*parts)


def response(df, extra: list[str] | None = None):
    """Projection of results to the columns of a response."""
    return df.select(*(extra or []), "request_id", "action", "verdict", "reason", "categories", "scores")
