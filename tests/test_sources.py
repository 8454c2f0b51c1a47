import datetime as dt
import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardsieve.functions import imagehash as I
from wardsieve.schemas import MIXED_REQUEST, TEXT_CACHE, TEXT_REQUEST
from wardsieve.sources import chat, images, kv, requests, scorers
from wardsieve.streaming.micro_batch import TextStream, request_rates


def png(pixels: np.ndarray) -> bytes:
    """A grey PNG, written by hand: no image library is needed."""
    h, w = pixels.shape
    raw = b"".join(b"\0" + pixels[i].astype(np.uint8).tobytes() for i in range(h))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def gradient(w=100, h=100):
    y, x = np.mgrid[:h, :w]
    return (x + y) * 255 // (w + h)


def test_image_hashes_are_stable_and_tell_images_apart():
    g = gradient()
    for kind in (I.PHASH, I.AHASH, I.DHASH):
        assert I.image_hash(g, kind) == I.image_hash(g.copy(), kind)
    assert I.image_hash(g) != 0
    assert I.image_hash(np.full((64, 64), 255)) != I.image_hash(np.zeros((64, 64)))
    rng = np.random.default_rng(1)
    noisy = np.clip(g + rng.normal(0, 2, g.shape), 0, 255)
    gap = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    assert gap(I.image_hash(g, I.DHASH), I.image_hash(noisy, I.DHASH)) <= 16
    with pytest.raises(ValueError, match="unknown"):
        I.image_hash(g, 9)


def test_image_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(gradient()))
    (tmp_path / "b.png").write_bytes(png(gradient(50, 80)))
    (tmp_path / "c.txt").write_bytes(b"no image")
    got = {r.url.rsplit("/", 1)[1]: r for r in images.hashed(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.png", "b.png", "c.txt"} and got["c.txt"].phash is None and got["a.png"].phash is not None
    assert len(got["a.png"].file_hash) == 64
    shown = images.fetch(spark, str(tmp_path)).where(images.is_image()).count()
    assert shown == 2
    kinds = spark.createDataFrame([("image/png",), ("text/html",), (None,)], "t string").select(images.is_image(content_type="t"))
    assert [r[0] for r in kinds.collect()] == [True, False, False]


def test_request_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"request_id":"a","owner_id":"o","text":"hi","image_urls":["u1","u2"]}\nnot json\n')
    rows = requests.read_requests(spark, str(tmp_path), MIXED_REQUEST).collect()
    assert [r.request_id for r in rows] == ["a", None] and rows[0].image_urls == ["u1", "u2"]
    requests.write_results(spark.createDataFrame([("x",)], "a string"), str(tmp_path / "out"))
    assert requests.read_table(spark, str(tmp_path / "out")).first().a == "x"
    with pytest.raises(ValueError, match="format"):
        requests.read_requests(spark, "x", TEXT_REQUEST, "avro?")


def test_key_value_cache(spark):
    t = lambda h: dt.datetime(2025, 1, 1, h)
    writes = spark.createDataFrame([("a", "1", t(0), 3600), ("a", "2", t(2), 3600), ("b", "x", t(0), None), ("c", "9", t(0), 60), (None, "n", t(0), None)], kv.SCHEMA)
    now = F.lit(t(2)).cast("timestamp")
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key string")
    got = {r.key: r.value for r in kv.get(writes, keys, now).collect()}
    assert got == {"a": "2", "b": "x", "c": None, "d": None}
    assert {r.key: r.value for r in kv.get(writes, keys, now, "int").collect()} == {"a": 2, "b": None, "c": None, "d": None}
    assert {r.key: r.present for r in kv.exists(writes, keys, now).collect()} == {"a": True, "b": True, "c": False, "d": False}
    assert kv.get(kv.delete(writes, keys.where("key = 'a'")), keys, now).where("key = 'a'").first().value is None
    renewed = kv.expire(writes, keys.where("key = 'c'"), now, 100)
    assert kv.get(renewed, keys, now).where("key = 'c'").first().value == "9"
    put = kv.put(writes, spark.createDataFrame([("d", 5)], "key string, value int"), now, 10)
    assert kv.get(put, keys, now, "int64").where("key = 'd'").first().value == 5


def test_scorer_keeps_errors_to_their_items(spark):
    def scorer(batch):
        if "boom" in batch:
            raise RuntimeError("cannot score boom")
        return [f"Safety: {'Unsafe' if 'bad' in t else 'Safe'}" for t in batch]

    rows = spark.createDataFrame([(1, "bad one"), (2, "boom"), (3, "fine"), (4, None)], "id long, text string")
    got = {r.id: r for r in scorers.apply_scorer(rows, "id", "text", scorer).collect()}
    assert set(got) == {1, 2, 3} and got[2].result is None and "boom" in got[2].error and got[1].error is None
    parsed = {r.id: r.is_nsfw for r in scorers.from_answers(scorers.apply_scorer(rows, "id", "text", scorer), "id", "result").collect()}
    assert parsed == {1: True, 2: False, 3: False}
    assert scorers.healthy(lambda b: b) and not scorers.healthy(lambda b: 1 / 0)


def test_chat_guard(spark):
    turns = spark.createDataFrame([(1, 1, "user", "hi"), (1, 2, "assistant", "yo"), (1, 3, "user", "bye"), (2, 1, "system", "s"), (2, 2, "user", "q")], "conv_id long, turn long, role string, text string")
    pairs = {(r.conv_id, r.turn): (r.user, r.assistant) for r in chat.conversation_pairs(turns).collect()}
    assert pairs == {(1, 1): ("hi", "yo"), (1, 3): ("bye", None), (2, 2): ("q", None)}
    rows = spark.createDataFrame([(1, "hi", "yo"), (2, "bad", None)], "id long, u string, a string")

    def send(bodies):
        out = []
        for b in map(json.loads, bodies):
            assert b["model"] == "guard" and b["messages"][0]["role"] == "user"
            out.append("Safety: Unsafe\nCategories: PII" if len(b["messages"]) == 1 else "Safety: Safe")
        return out

    got = {r.id: r.verdict for r in chat.moderate(rows, "id", "u", "a", "guard", send).collect()}
    assert got[1].is_safe and not got[2].is_safe and got[2].categories == ["PII"]
    codes = {r.id: r.verdict for r in chat.moderate(rows, "id", "u", "a", "guard", lambda bs: ["unsafe\nS1" if "bad" in b else "safe" for b in bs], style="codes").collect()}
    assert codes[1].is_safe and codes[2].categories == ["S1"]
    assert chat.model_names('{"data":[{"id":"a"},{"id":"b"}]}', "data", "id") == ["a", "b"] and chat.model_names('{"models":[{"name":"x"},{"name":"y"}]}', "models", "name") == ["x", "y"]


def test_stream_uses_earlier_batches_and_repeats_safely(spark, tmp_path):
    none = spark.createDataFrame([], TEXT_CACHE)
    listed = spark.createDataFrame([("idiot", "insult", 0.9)], "word string, category string, nsfw_score double")
    s = TextStream(spark, str(tmp_path / "state"), none, listed)
    one = spark.createDataFrame([("a", "an idiot"), ("b", "hello"), ("b", "hello")], "request_id string, text string")
    two = spark.createDataFrame([("c", "AN IDIOT"), ("d", "new")], "request_id string, text string")
    s.process(one, 0)
    s.process(two, 1)
    s.process(two, 1)
    got = {r.request_id: (r.verdict, r.cache_hit) for r in s.results().collect()}
    assert got == {"a": ("REJECT", False), "b": ("CLEAN", False), "c": ("REJECT", True), "d": ("CLEAN", False)}
    assert s.deltas().count() == 3 and s.deltas(1).count() == 2
    s.process(spark.createDataFrame([("a", "an idiot"), ("e", "last")], "request_id string, text string"), 2)
    assert "a" not in {r.request_id for r in spark.read.parquet(f"{s.path}/results/batch=2").collect()}  # answered before
    s.compact()
    assert sorted(p.name for p in (tmp_path / "state" / "cache").iterdir()) == ["batch=2", "compacted=1"]
    assert s.deltas().count() == 4 and s.deltas(2).count() == 3
    s.process(spark.createDataFrame([("f", "An Idiot")], "request_id string, text string"), 3)
    s.compact()
    assert s.deltas(3).count() == 4 and {r.request_id: r.cache_hit for r in s.results().collect()}["f"]


def test_stream_from_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"request_id":"a","text":"an idiot"}\n')
    (src / "2.json").write_text('{"request_id":"b","text":"an IDIOT"}\n')
    listed = spark.createDataFrame([("idiot", "insult", 0.9)], "word string, category string, nsfw_score double")
    s = TextStream(spark, str(tmp_path / "state"), spark.createDataFrame([], TEXT_CACHE), listed)
    done = []
    run = s.start(requests.stream_requests(spark, str(src), TEXT_REQUEST, files_per_batch=1), after=done.append)
    run.awaitTermination()
    assert done == [0, 1] and sorted(r.cache_hit for r in s.results().collect()) == [False, True]


def test_rates_drop_late_rows(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("request_id", T.StringType()), T.StructField("sent_at", T.TimestampType())])
    at = lambda h: dt.datetime(2025, 1, 1, h, 5)
    for i, rows in enumerate([[("a", at(1)), ("b", at(1))], [("c", at(6))], [("x", at(7))], [("late", at(1)), ("d", at(9))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
        for f in (tmp_path / "in" / f"b={i}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = request_rates(stream).writeStream.outputMode("append").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.hour.hour: r.n_requests for r in spark.table("rates").collect()}
    assert got.get(1) == 2


def test_download_over_http(spark):
    import threading
    import time
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/slow":
                time.sleep(5)
            self.send_response(404 if self.path == "/gone" else 200)
            self.send_header("Content-Type", "text/html" if self.path == "/page" else "image/png")
            self.end_headers()
            self.wfile.write(b"pixels")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    rows = spark.createDataFrame([(1, f"{at}/a"), (2, f"{at}/gone"), (3, f"{at}/page"), (4, "no url"), (5, None), (6, f"{at}/slow")], "id long, url string").coalesce(1)
    got = {r.id: r for r in images.download(rows, "id", "url", seconds=1, images_only=True).collect()}
    server.shutdown()
    assert bytes(got[1].content) == b"pixels" and len(got[1].file_hash) == 64 and got[1].error is None
    assert got[2].error == "status 404" and got[3].error == "not an image: text/html" and all(got[i].error and got[i].file_hash is None for i in (4, 5, 6))


def test_scorer_time_and_health(spark):
    import time

    def slow(part):
        if "slow" in part:
            time.sleep(3)
        return ["Safety: Safe"] * len(part)

    rows = spark.createDataFrame([(1, "a"), (2, "slow"), (3, "b")], "id long, text string").coalesce(1)
    got = {r.id: (r.result, r.error) for r in scorers.apply_scorer(rows, "id", "text", slow, seconds=0.5).collect()}
    assert got[1] == got[3] == ("Safety: Safe", None) and got[2] == (None, "no answer within 0.5 s")
    assert scorers.health(slow) == {"status": "healthy", "error": ""} and scorers.health(lambda x: [])["error"] == "0 answers to one item"
    assert scorers.health(lambda x: 1 / 0)["status"] == "unhealthy" and not scorers.healthy(lambda x: 1 / 0)
