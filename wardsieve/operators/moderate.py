"""The decision cascades: texts, images, mixed requests, and what they write back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardsieve.config import ImageSettings, TextSettings
from wardsieve.functions.text import fast_key, merge_categories, normalize
from wardsieve.operators import blocklist as B
from wardsieve.operators import similar, verdict
from wardsieve.runtime import persist_table



#: Models that results are attributed to.
TEXT_MODEL, IMAGE_MODEL = "Qwen/Qwen3Guard-Gen-0.6B", "Falconsai/nsfw_image_detection"


def _none() -> Column:
    return F.array().cast("array<string>")


# --- texts ----------------------------------------------------------------------------------


def text_id(norm: Column | str) -> Column:
    """128 bits that stand for a normal form in joins, so that texts are not exchanged as keys."""
    return F.md5(norm)


def decide_texts(distinct: DataFrame, cache: DataFrame, words: DataFrame, scores: DataFrame | None = None, settings: TextSettings = TextSettings()) -> DataFrame:
    """Results by ``tid`` of distinct texts (tid, norm, text); tid is ``text_id`` of norm.

    ``cache`` holds rows by 16-digit key whose ``normalized_content`` is the normal form, so the
    lookup joins on it; of several rows the one of the smallest key counts. ``words``: word,
    category, nsfw_score. ``scores``: norm, is_nsfw, safety_label, categories; a text without a
    row is one the model could not score.
    """
    known = cache.where("length(content_hash) = 16").groupBy(text_id("normalized_content").alias("tid")).agg(F.min_by(F.struct(F.col("category").alias("cached"), F.coalesce("nsfw_score", F.lit(0.0)).alias("cached_score")), "content_hash").alias("c"))
    known = known.select("tid", "c.*", F.lit(True).alias("cache_hit"))
    # read by five branches below, the blocklist by three jobs: each is computed once
    looked = persist_table(distinct.join(known, "tid", "left").withColumn("cache_hit", F.coalesce("cache_hit", F.lit(False))), "looked")
    flags = verdict.flags_of(F.col("cached"))
    flags = {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}
    hits = looked.where("cache_hit").select("tid", "cache_hit", *[v.alias(k) for k, v in flags.items()], F.col("cached_score").alias("max_nsfw_score"), _none().alias("categories"), F.lit(False).alias("nsfw_checked"), F.lit(False).alias("detected_by_nsfw"))

    listed = persist_table(B.prepared(words), "blocklist")
    misses = looked.where("NOT cache_hit").select("tid", "norm", "text")
    open_ = misses
    if settings.gate:
        open_ = misses.join(B.gate(misses.select("tid", "text"), B.gate_keys(listed), "tid"), "tid", "left_semi")
    found = B.summary(B.search(open_.select("tid", "norm"), listed, "tid"), "tid")
    matched = misses.select("tid").join(found, "tid", "left")
    score = F.coalesce("max_nsfw_score", F.lit(0.0))
    need_model = score < settings.reject_threshold
    if scores is None:
        scored = matched.withColumns({"is_nsfw": F.lit(None).cast("boolean"), "safety_label": F.lit(None).cast("string"), "more": _none()})
    else:
        # only texts that patterns do not reject already ask the model
        answers = scores.select(text_id("norm").alias("tid"), "is_nsfw", "safety_label", F.col("categories").alias("more"))
        asked = matched.where(need_model).select("tid").join(answers, "tid")
        scored = matched.join(asked, "tid", "left")
    label, nsfw = F.lower("safety_label"), F.coalesce("is_nsfw", F.lit(False))
    reject, review = B.threshold(score, settings.reject_threshold, settings.review_threshold)
    by_model = lambda name: nsfw & F.coalesce(label == name, F.lit(False))
    fresh = scored.select(
        "tid",
        F.lit(False).alias("cache_hit"),
        (F.col("n_matches").isNull() & ~nsfw).alias("is_clean"),
        (reject | by_model("unsafe")).alias("should_reject"),
        (review | by_model("controversial")).alias("should_review"),
        score.alias("max_nsfw_score"),
        merge_categories("categories", F.when(nsfw, F.col("more"))).alias("categories"),
        F.col("is_nsfw").isNotNull().alias("nsfw_checked"),
        nsfw.alias("detected_by_nsfw"),
    )
    return hits.unionByName(fresh)


def moderate_text(requests: DataFrame, cache: DataFrame, words: DataFrame, scores: DataFrame | None = None, settings: TextSettings = TextSettings(), *, order: list[str] | None = None) -> DataFrame:
    """One result a request (request_id, text): flags, score, categories, verdict columns.

    Null and empty texts are clean. Requests of one normal form are decided once, by the text of
    the first by ``order`` (default request_id), as all later ones would hit its cache entry.
    """
    rows = requests.withColumn("norm", F.when(F.col("text") != "", normalize("text"))).withColumn("tid", text_id("norm"))
    first = F.min_by(F.struct("norm", "text"), F.struct(*(order or ["request_id"]), "text"))
    distinct = rows.where("norm IS NOT NULL").groupBy("tid").agg(first.alias("f")).select("tid", "f.norm", "f.text")
    results = decide_texts(distinct, cache, words, scores, settings)
    out = rows.select("request_id", "norm", "tid").join(results, "tid", "left")
    empty = {"cache_hit": F.lit(False), "is_clean": F.lit(True), "should_reject": F.lit(False), "should_review": F.lit(False), "max_nsfw_score": F.lit(0.0), "categories": _none(), "nsfw_checked": F.lit(False), "detected_by_nsfw": F.lit(False)}
    return with_verdict(out.select("request_id", "norm", *[F.coalesce(F.col(k), v).alias(k) for k, v in empty.items()]))


def with_verdict(results: DataFrame) -> DataFrame:
    reject, review = F.col("should_reject"), F.col("should_review")
    score = F.col("max_nsfw_score") if "max_nsfw_score" in results.columns else F.lit(0.0)
    return results.withColumns(
        {"category": verdict.category(reject, review), "action": verdict.action(reject, review), "verdict": verdict.verdict(reject, review), "reason": verdict.reason(reject, review), "scores": verdict.scores(score, F.col("image_scores") if "image_scores" in results.columns else None)}
    )


def text_cache_delta(results: DataFrame, now: Column, *, model_version: str = TEXT_MODEL) -> DataFrame:
    """Cache rows of fresh results (those of ``moderate_text``), one a normal form."""
    fresh = results.where("NOT cache_hit AND norm IS NOT NULL").dropDuplicates(["norm"])
    detect = F.to_json(F.struct("category", F.col("max_nsfw_score").alias("nsfw_score"), "is_clean", "should_reject", "should_review", "categories"))
    return fresh.select(
        fast_key("norm").alias("content_hash"), F.col("norm").alias("normalized_content"), detect.alias("detect_result"), "category", F.col("max_nsfw_score").alias("nsfw_score"), F.lit(model_version).alias("model_version"), F.lit("auto").alias("added_by"),
        F.lit(None).cast("timestamp").alias("expires_at"), now.alias("created_at"), now.alias("updated_at"),
    )


def feedback(results: DataFrame) -> DataFrame:
    """(norm, categories) of texts the model flagged: what a learning hook would receive."""
    return results.where("detected_by_nsfw").select("norm", "categories").dropDuplicates(["norm"])


# --- images ---------------------------------------------------------------------------------


def moderate_images(requests: DataFrame, cache: DataFrame, settings: ImageSettings = ImageSettings()) -> DataFrame:
    """One result a request (request_id, file_hash, phash, is_nsfw, nsfw_score, source_url).

    The model's answer comes with the request; a null score is a model error: clean and not
    stored. An image that is not in the cache and has no hash (null or 0: undecodable) gets
    ``error`` and null flags. With the gate, only an exact hash of a known bad image opens the
    similarity search.
    """
    row = F.struct(F.col("category").alias("cached"), F.coalesce("nsfw_score", F.lit(0.0)).alias("cached_score"))
    # the cache is not broadcast: its columns are several times what plans reckon from its files
    files = cache.where("file_hash IS NOT NULL").groupBy("file_hash").agg(F.min(row).alias("c")).select("file_hash", "c.*", F.lit(True).alias("in_cache"))
    rows = requests.withColumn("file_hash", F.nullif("file_hash", F.lit(""))).join(files.hint("merge"), "file_hash", "left").withColumn("in_cache", F.coalesce("in_cache", F.lit(False)))

    open_ = rows.where("NOT in_cache AND phash <> 0").select("phash").distinct()
    if settings.gate:
        known = cache.where("file_hash LIKE 'phash:%' AND category <> 'safe'").select("phash").distinct()
        open_ = open_.join(known, "phash", "left_semi")
    bad = similar.find_similar(open_.select(F.col("phash").alias("query_id"), "phash"), cache, distance=settings.max_distance, top=1)
    bad = bad.join(cache.select("file_hash", F.coalesce("nsfw_score", F.lit(0.0)).alias("bad_score"), F.col("category").alias("bad_category")).hint("merge"), "file_hash").select(F.col("query_id").alias("phash"), "bad_score", "bad_category", F.lit(True).alias("is_bad"))
    rows = rows.join(bad, "phash", "left")

    cached, similar_ = F.col("in_cache"), F.coalesce("is_bad", F.lit(False)) & ~F.col("in_cache")
    broken = ~cached & F.coalesce(F.col("phash") == 0, F.lit(True))
    score = F.col("nsfw_score")
    by_model = F.coalesce(F.col("is_nsfw"), F.lit(False)) | F.coalesce(score >= settings.nsfw_threshold, F.lit(False))
    reject = F.when(broken, F.lit(None)).when(cached, F.coalesce(F.col("cached") != "safe", F.lit(True))).when(similar_, True).otherwise(score.isNotNull() & by_model)
    shown = F.when(cached, F.col("cached_score")).when(similar_, F.col("bad_score")).when(~broken, score)
    return rows.select(
        "request_id", "file_hash", "phash", "source_url", cached.alias("cached"), (cached | similar_).alias("cache_hit"), (~reject).alias("is_clean"), reject.alias("should_reject"), F.when(~broken, F.lit(False)).alias("should_review"),
        F.when(cached, F.col("cached_score")).when(similar_ | broken, F.lit(0.0)).otherwise(F.coalesce(score, F.lit(0.0))).alias("nsfw_score"),
        F.when(shown.isNotNull(), F.create_map(F.lit("nsfw"), shown)).otherwise(F.create_map().cast("map<string,double>")).alias("image_scores"),
        F.when(similar_, F.col("bad_category")).when(reject, "unsafe").otherwise("safe").alias("stored_category"), (~broken & ~cached & (similar_ | score.isNotNull())).alias("stored"), (~broken & ~cached & ~similar_ & reject).alias("new_bad"),
        F.when(broken, "image could not be decoded").alias("error"),
    )


def image_cache_delta(results: DataFrame, now: Column, *, model_version: str = IMAGE_MODEL) -> DataFrame:
    """Cache rows of image results: one by file hash, and one by image hash for new bad images."""
    tail = [F.lit("{}").alias("detect_result"), F.lit(model_version).alias("model_version"), F.coalesce("source_url", F.lit("")).alias("source_url"), F.lit("auto").alias("added_by"), F.lit(None).cast("timestamp").alias("expires_at"), now.alias("created_at"), now.alias("updated_at")]
    score = F.coalesce(F.get(F.map_values("image_scores"), F.lit(0)), F.lit(0.0)).alias("nsfw_score")
    files = results.where("stored AND file_hash IS NOT NULL").select("request_id", "file_hash", "phash", F.col("stored_category").alias("category"), score, *tail)
    hashes = results.where("new_bad").select("request_id", F.concat(F.lit("phash:"), F.col("phash").cast("string")).alias("file_hash"), "phash", F.lit("nsfw").alias("category"), score, *tail)
    return files.unionByName(hashes)


# --- other kinds and mixed requests -----------------------------------------------------------


def moderate_unscored(requests: DataFrame) -> DataFrame:
    """Video and audio: always clean; no model looks at them."""
    clean = requests.select("request_id", F.lit(True).alias("is_clean"), F.lit(False).alias("should_reject"), F.lit(False).alias("should_review"), _none().alias("categories"))
    return with_verdict(clean)


def fold_images(images: DataFrame) -> DataFrame:
    """(request_id, image): images (request_id, pos, flags ...) seen in order up to the first
    reject; the struct holds the last one seen that had no error. A request without a usable
    image has no row."""
    usable = images.where("error IS NULL")
    seen = F.struct("is_clean", "should_reject", "should_review", "image_scores")
    stop = usable.groupBy("request_id").agg(
        F.min_by(seen, F.when(F.col("should_reject"), F.col("pos"))).alias("rejecting"), F.max_by(seen, "pos").alias("last"), F.min(F.when(F.col("should_reject"), F.col("pos"))).alias("stop"), F.min(F.struct("is_clean", "pos")).alias("worst")
    )
    image = F.when(F.col("stop").isNotNull(), F.col("rejecting")).otherwise(F.col("last"))
    # an unclean image is a rejected one, so cleanliness follows the rejecting one
    return stop.select("request_id", image.alias("image"))


def moderate_mixed(requests: DataFrame, texts: DataFrame, images: DataFrame) -> DataFrame:
    """Verdicts of mixed requests from text results (by request_id) and image results
    (request_id, pos). Either may be missing; videos and audio add nothing."""
    text = texts.select("request_id", *[F.col(c).alias(f"t_{c}") for c in ("is_clean", "should_reject", "should_review", "max_nsfw_score", "categories")])
    met = requests.select("request_id").join(text, "request_id", "left").join(fold_images(images), "request_id", "left")
    either = lambda c: F.coalesce(F.col(f"t_{c}"), F.lit(False)) | F.coalesce(F.col(f"image.{c}"), F.lit(False))
    out = met.select(
        "request_id", (F.coalesce("t_is_clean", F.lit(True)) & F.coalesce("image.is_clean", F.lit(True))).alias("is_clean"), either("should_reject").alias("should_reject"), either("should_review").alias("should_review"),
        F.when(~F.col("t_is_clean"), F.col("t_categories")).otherwise(_none()).alias("categories"), F.coalesce("t_max_nsfw_score", F.lit(0.0)).alias("max_nsfw_score"), F.col("image.image_scores").alias("image_scores"),
    )
    return with_verdict(out)
