import datetime as dt

from pyspark.sql import functions as F

from wardsieve.schemas import IMAGE_CACHE
from wardsieve.service import Service

T0 = dt.datetime(2025, 1, 1)


def test_calls_of_the_service(spark):
    words = spark.createDataFrame([(1, "idiot", "insult", 0.9, None, None, T0), (2, "meh", "mild", 0.6, None, None, T0)], "req_id long, word string, category string, nsfw_score double, added_by string, model_version string, requested_at timestamp")
    s = Service.empty(spark).add_bad_words(words)
    s.image_cache = spark.createDataFrame([("bad", 5, "{}", "nsfw", 0.8, "m", "", "auto", None, T0, T0)], IMAGE_CACHE)
    assert s.rebuild_filters()[1] == 2 and s.list_bad_words("insult").first().total == 1
    texts = spark.createDataFrame([("a", "an idiot"), ("b", "meh"), ("c", "fine"), ("d", None)], "request_id string, text string")
    got = {r.request_id: r.verdict for r in s.moderate_text(texts).collect()}
    assert got == {"a": "REJECT", "b": "REVIEW", "c": "CLEAN", "d": "CLEAN"}
    cols = "request_id string, pos int, file_hash string, phash long, is_nsfw boolean, nsfw_score double, source_url string"
    images = spark.createDataFrame([("c", 0, "x", 9, False, 0.1, "u"), ("c", 1, "bad", 5, False, 0.0, "u"), ("d", 0, "y", None, None, None, "u")], cols)
    one = {r.request_id: (r.verdict, r.error) for r in s.moderate_image(images.withColumn("request_id", F.concat("request_id", "pos"))).collect()}
    assert one == {"c0": ("CLEAN", None), "c1": ("REJECT", None), "d0": ("CLEAN", "image could not be decoded")}
    mixed = {r.request_id: (r.verdict, r.scores.get("nsfw")) for r in s.moderate(texts, images).collect()}
    assert mixed == {"a": ("REJECT", None), "b": ("REVIEW", None), "c": ("REJECT", 0.8), "d": ("CLEAN", None)}
    assert {r.verdict for r in s.moderate_video(texts).collect()} == {"CLEAN"} == {r.verdict for r in s.moderate_audio(texts).collect()}
    assert s.remove_bad_words(words.where("word = 'meh'")).rebuild_filters()[1] == 1
    assert s.text_delta(texts, F.current_timestamp()).count() == 3 and s.image_delta(images, F.current_timestamp()).count() == 1
