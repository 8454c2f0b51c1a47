import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wardsieve.config import ImageSettings
from wardsieve.operators import admin, bloom, moderate, paging, ring, similar, tables, verdict
from wardsieve.operators import blocklist as B
from wardsieve.schemas import IMAGE_CACHE, TEXT_CACHE, TEXT_DATASET, create_tables

T0 = dt.datetime(2025, 1, 1)


def cache_row(key, text, category="safe", score=0.0, expires=None, made=T0):
    return (key, text, "{}", category, score, "m", "auto", expires, made, made)


def words(spark, *rows):
    return B.prepared(spark.createDataFrame([(w, "insult", s) for w, s in rows], "word string, category string, nsfw_score double"))


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "id long, text string").withColumn("norm", F.lower("text"))


# --- blocklist ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("listed", "text", "opens"),
    [("badword", "b4dword", True), ("badword", "b@dword", False), ("badword", "xbadwordx", False), ("bad!", "bad!", False), ("two words", "only words", True), ("badword", None, False), ("badword", "", False)],
)
def test_gate(spark, listed, text, opens):
    keys = B.gate_keys(words(spark, (listed, 0.9)))
    got = B.gate(spark.createDataFrame([(1, text)], "id long, text string"), keys, "id").count()
    assert (got == 1) == opens


def test_overlapping_matches(spark):
    got = B.search(texts(spark, "she he hers"), words(spark, ("he", 0.1), ("she", 0.2), ("hers", 0.3)), "id").collect()
    assert sorted((r.word, r.position, r.end) for r in got) == [("he", 1, 2), ("he", 4, 5), ("he", 7, 8), ("hers", 7, 10), ("she", 0, 2)]


def test_position_uses_the_listed_length(spark):
    listed = words(spark, ("béta", 0.5))  # five characters, four when normalized
    (r,) = B.search(texts(spark, "xx beta"), listed, "id").collect()
    assert (r.position, r.end) == (2, 6)


def test_search_equals_naive_however_full_the_bitmap(spark, monkeypatch):
    rng = random.Random(5)
    pats = list({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(30)})
    docs = ["".join(rng.choice("abc ") for _ in range(60)) for _ in range(20)]
    listed = words(spark, *[(p, 0.5) for p in pats])
    want = sorted((i, p, k) for i, d in enumerate(docs) for p in pats for k in range(len(d) - len(p) + 1) if d.startswith(p, k))
    got = sorted((r.id, r.word, r.position) for r in B.search(texts(spark, *docs), listed, "id").collect())
    assert got == want
    monkeypatch.setattr(B, "BITMAP_POWER", 16)
    monkeypatch.setattr(B, "CHOICES", 1)
    assert sorted((r.id, r.word, r.position) for r in B.search(texts(spark, *docs), listed, "id").collect()) == want
    assert {r.id for r in B.contains_any(texts(spark, *docs), listed, "id").collect()} == {i for i, _, _ in want}


def test_long_and_strange_patterns(spark):
    long = "so long a pattern that it has an anchor of thirty-two characters, 🙂 or so"
    docs = [f"x {long}{long}", long[1:], "🙂", "aaaaaaa", None, ""]
    got = {(r.id, r.word, r.position) for r in B.search(texts(spark, *docs), words(spark, (long, 0.9), ("🙂", 0.1), ("aaaa", 0.2)), "id").collect()}
    smile = long.index("🙂")
    n = len(B.prepared(spark.createDataFrame([(long, "", 0.1)], "word string, category string, nsfw_score double")).first().norm_word)
    assert {(0, long, 2), (0, long, 2 + n)} == {(i, w, p) for i, w, p in got if w == long}
    assert {(i, p) for i, w, p in got if w == "🙂"} == {(0, 2 + smile), (0, 2 + n + smile), (1, smile - 1), (2, 0)}
    assert {(i, p) for i, w, p in got if w == "aaaa"} == {(3, p) for p in range(4)}


def test_empty_blocklist_and_empty_words(spark):
    none = words(spark, ("", 0.5), (None, 0.5), ("́", 0.5))
    assert none.count() == 0
    assert B.search(texts(spark, "abc"), none, "id").count() == 0
    assert B.gate_keys(none).count() == 0


# --- tables ---------------------------------------------------------------------------------


def test_upsert_keeps_and_replaces(spark):
    table = spark.createDataFrame([cache_row("a", "A", "safe", 0.1, T0), cache_row("z", "Z")], TEXT_CACHE)
    late = dt.datetime(2026, 1, 1)
    new = spark.createDataFrame([(1, *cache_row("a", "changed", "unsafe", 0.9, late, late)), (2, *cache_row("n", "first", "safe", 0.2)), (3, *cache_row("n", "second", None, None, late, late)), (4, *cache_row(None, "nokey"))], "n int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TEXT_CACHE))
    got = {r.content_hash: r for r in tables.upsert(table, new, "content_hash", ["n"]).collect()}
    assert set(got) == {"a", "z", "n"}
    assert (got["a"].normalized_content, got["a"].category, got["a"].nsfw_score, got["a"].expires_at, got["a"].updated_at) == ("A", "unsafe", 0.9, T0, late)
    assert (got["n"].normalized_content, got["n"].created_at, got["n"].category, got["n"].nsfw_score) == ("first", T0, "safe", 0.0)


def test_expiry_keeps_rows_without_one(spark):
    table = spark.createDataFrame([cache_row("a", "A", expires=T0), cache_row("b", "B"), cache_row("c", "C", expires=dt.datetime(2026, 1, 1))], TEXT_CACHE)
    left = {r.content_hash for r in tables.delete_expired(table, dt.datetime(2025, 6, 1)).collect()}
    assert left == {"b", "c"}
    assert {r.content_hash for r in tables.delete_expired(table, T0).collect()} == {"a", "b", "c"}


def test_sync_takes_unsafe_once_and_numbers_on(spark):
    cache = spark.createDataFrame([cache_row("a", "same", "unsafe"), cache_row("b", "same", "unsafe"), cache_row("c", "C", "safe"), cache_row("d", "D", "spam", expires=T0), cache_row("e", "known", "spam"), cache_row("f", "F", None)], TEXT_CACHE)
    data = spark.createDataFrame([(7, *cache_row("x", "known", "unsafe"))], TEXT_DATASET)
    got = {r.content_hash: (r.id, r.expires_at) for r in tables.sync_dataset(cache, data, "content_hash").collect()}
    assert got == {"x": (7, None), "a": (8, None), "d": (9, None)}


def test_everything_on_empty_tables(spark):
    t = create_tables(spark)
    assert tables.upsert(t["text_cache"], t["text_cache"].withColumn("n", F.lit(1)), "content_hash", ["n"]).count() == 0
    assert tables.sync_dataset(t["image_cache"], t["image_dataset"], "file_hash").count() == 0
    assert tables.count(t["text_cache"], "unsafe").first().n == 0
    assert admin.rebuild_filters(t["text_cache"]).count() == 0
    q = spark.createDataFrame([], "query_id long, phash long")
    assert similar.find_similar(q, t["image_cache"]).count() == 0


def test_admin_scores_and_removal(spark):
    req = spark.createDataFrame([(1, "w", "insult", -1.0, None, None, T0), (2, "v", "hate", 2.0, "me", "m", T0), (3, "u", "hate", 0.3, "me", "m", T0), (4, None, "hate", 0.3, "me", "m", T0)], "req_id long, word string, category string, nsfw_score double, added_by string, model_version string, requested_at timestamp")
    cache = admin.add_bad_words(create_tables(spark)["text_cache"], req)
    got = {r.normalized_content: r for r in cache.collect()}
    assert [got[w].nsfw_score for w in "wvu"] == [1.0, 1.0, 0.3] and got["w"].added_by == "manual" and got["w"].expires_at is None
    assert {r.normalized_content for r in admin.remove_bad_words(cache, req.where("word = 'w'")).collect()} == {"v", "u"}
    assert admin.list_bad_words(cache, "hate", 1, 0).first().total == 2
    assert admin.list_bad_words(cache, "", 0, 0).count() == 0


# --- similarity, Bloom, ring ------------------------------------------------------------------


@pytest.mark.parametrize("distance", [0, 3, 8, 10])
def test_bands_find_all_pairs(spark, distance):
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(40)]
    vals = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 12))) for b in base for _ in range(3)]
    vals = [v - (1 << 64) if v >> 63 else v for v in vals]
    df = spark.createDataFrame([(v,) for v in [*vals, None]], "phash long")
    got = {(r.a, r.b): r.distance for r in similar.near(df, df, distance).collect()}
    want = {(a, b): (a ^ b & ((1 << 64) - 1)).bit_count() if a >= 0 else ((a ^ b) & ((1 << 64) - 1)).bit_count() for a in vals for b in vals}
    want = {(a, b): ((a ^ b) & ((1 << 64) - 1)).bit_count() for a, b in want}
    assert got == {k: v for k, v in want.items() if v <= distance}
    assert similar.near(df, df, distance).count() == len(got)


def test_similarity_top_and_safe_rows(spark):
    far = 1 << 40
    rows = [(f"f{i}", far ^ i, "{}", "safe" if i == 0 else "unsafe", 0.5, "m", "", "auto", None, T0, T0) for i in range(9)]
    table = spark.createDataFrame(rows, IMAGE_CACHE)
    got = similar.find_similar(spark.createDataFrame([(1, far), (2, 0), (3, None)], "query_id long, phash long"), table.unionByName(table.withColumns({"phash": F.lit(0).cast("long"), "file_hash": F.lit("zero")})), distance=10, top=5).orderBy("rank").collect()
    assert [r.file_hash for r in got] == ["f1", "f2", "f4", "f8", "f3"] and [r.distance for r in got] == [1, 1, 1, 1, 2]


def test_exploded_bands_are_not_broadcast(spark):
    one, two = spark.range(1, 50).selectExpr("id AS phash"), spark.range(20, 90).selectExpr("id AS phash")
    plan = similar.near(one, two, 10)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [seg" in plan and "BroadcastHashJoin [seg" not in plan


def test_image_cache_is_not_broadcast(spark):
    cache = spark.range(9).selectExpr("concat('f', id) AS file_hash", "id AS phash", "'unsafe' AS category", "0.5D AS nsfw_score")
    asked = spark.range(9).selectExpr("concat('r', id) AS request_id", "concat('f', id) AS file_hash", "id AS phash", "CAST(NULL AS boolean) AS is_nsfw", "0.1D AS nsfw_score", "'' AS source_url")
    for gate in (True, False):
        plan = moderate.moderate_images(asked, cache, ImageSettings(gate=gate))._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [file_hash" not in plan and "BroadcastHashJoin [seg" not in plan


def test_bloom_has_no_false_negatives(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(200)] + [(None,)], "k string")
    made = bloom.build(keys, "k", bits=1 << 12, hashes=4)
    asked = spark.createDataFrame([(f"k{i}",) for i in range(400)], "k string")
    got = {r.k: r.maybe for r in bloom.probe(asked, "k", made, bits=1 << 12, hashes=4).collect()}
    assert all(got[f"k{i}"] for i in range(200)) and sum(got[f"k{i}"] for i in range(200, 400)) < 20
    assert bloom.bitmap(made).agg(F.sum(F.bitmap_count("bits"))).first()[0] == made.count()
    none = bloom.build(keys.where("false"), "k", bits=64, hashes=2)
    assert not any(r.maybe for r in bloom.probe(asked, "k", none, bits=64, hashes=2).collect())


def test_ring_weights_and_removal(spark):
    nodes = spark.createDataFrame([("a", 100), ("b", 50), ("c", 0)], "node string, weight int")
    r = ring.ring(nodes)
    assert {x.node: x["count"] for x in r.groupBy("node").count().collect()} == {"a": 100, "b": 50}
    values = spark.createDataFrame([(str(i),) for i in range(300)] + [(None,)], "v string")
    before = {x.v: x.node for x in ring.lookup(values, r, "v").collect()}
    after = {x.v: x.node for x in ring.lookup(values, ring.remove(r, spark.createDataFrame([("b",)], "node string")), "v").collect()}
    assert len(before) == 300 and set(after.values()) == {"a"} and set(before.values()) == {"a", "b"}
    assert {x.node for x in ring.lookup(values, r.where("false"), "v").collect()} <= {None}


# --- cascade ----------------------------------------------------------------------------------


@pytest.mark.parametrize(("score", "expected", "clean"), [(0.85, "REJECT", False), (0.5, "REVIEW", False), (0.49, "CLEAN", False)])
def test_thresholds(spark, score, expected, clean):
    req = spark.createDataFrame([("r", "an idiot")], "request_id string, text string")
    listed = spark.createDataFrame([("idiot", "insult", score)], "word string, category string, nsfw_score double")
    (r,) = moderate.moderate_text(req, create_tables(spark)["text_cache"], listed).collect()
    assert (r.verdict, r.is_clean, r.categories, r.scores) == (expected, clean, ["insult"], {"text_nsfw": score})


def test_model_folds_in_and_is_skipped_on_reject(spark):
    req = spark.createDataFrame([("a", "an idiot"), ("b", "fine"), ("c", "odd"), ("d", ""), ("e", None), ("f", "Fine")], "request_id string, text string")
    listed = spark.createDataFrame([("idiot", "insult", 0.9)], "word string, category string, nsfw_score double")
    scores = spark.createDataFrame([("an idiot", True, "Unsafe", ["Violent"]), ("fine", True, "Controversial", ["PII"]), ("odd", False, "Safe", ["PII"])], "norm string, is_nsfw boolean, safety_label string, categories array<string>")
    got = {r.request_id: r for r in moderate.moderate_text(req, create_tables(spark)["text_cache"], listed, scores).collect()}
    assert got["a"].verdict == "REJECT" and got["a"].categories == ["insult"] and not got["a"].nsfw_checked
    assert got["b"].verdict == "REVIEW" and got["b"].categories == ["PII"] and got["b"].detected_by_nsfw
    assert got["c"].verdict == "CLEAN" and got["c"].is_clean and got["c"].nsfw_checked
    assert got["d"].is_clean and got["e"].is_clean and got["f"].verdict == "REVIEW"
    delta = moderate.text_cache_delta(moderate.moderate_text(req, create_tables(spark)["text_cache"], listed, scores), F.current_timestamp())
    assert {r.normalized_content: r.category for r in delta.collect()} == {"an idiot": "unsafe", "fine": "controversial", "odd": "safe"}


def test_cache_hit_rederives_flags(spark):
    cache = spark.createDataFrame([cache_row("0" * 16, "hello", "controversial", 0.6), cache_row("1" * 64, "bye", "unsafe", 0.9)], TEXT_CACHE)
    req = spark.createDataFrame([("a", "HELLO"), ("b", "bye")], "request_id string, text string")
    none = spark.createDataFrame([], "word string, category string, nsfw_score double")
    got = {r.request_id: r for r in moderate.moderate_text(req, cache, none).collect()}
    assert got["a"].cache_hit and got["a"].verdict == "REVIEW" and got["a"].categories == []
    assert not got["b"].cache_hit and got["b"].verdict == "CLEAN"


def test_images_fold_to_the_first_reject(spark):
    cols = "request_id string, pos int, is_clean boolean, should_reject boolean, should_review boolean, image_scores map<string,double>, error string"
    rows = [("a", 0, True, False, False, {"nsfw": 0.1}, None), ("a", 1, False, True, False, {"nsfw": 0.8}, None), ("a", 2, True, False, False, {"nsfw": 0.2}, None), ("b", 0, True, False, False, {"nsfw": 0.0}, None), ("b", 1, None, None, None, None, "broken"), ("c", 0, None, None, None, None, "broken")]
    got = {r.request_id: r.image for r in moderate.fold_images(spark.createDataFrame(rows, cols)).collect()}
    assert got["a"].should_reject and got["a"].image_scores == {"nsfw": 0.8} and got["b"].image_scores == {"nsfw": 0.0} and "c" not in got


def test_wire_names(spark):
    df = spark.createDataFrame([("AUTO_REJECT",), ("?",), (None,)], "a string")
    assert [r[0] for r in df.select(verdict.wire_name(F.col("a"), "action")).collect()] == ["AUTO_REJECT", "UNSPECIFIED", "UNSPECIFIED"]


# --- pages ------------------------------------------------------------------------------------


def test_cursor_round_trip():
    c = paging.Cursor("test-id-123", dt.datetime(2024, 1, 15, 10, 30, tzinfo=dt.UTC), sort_value=5)
    assert paging.Cursor.decode(c.encode()) == c
    assert paging.encode_cursor(None) == "" and paging.Cursor.decode("") is None
    for bad in ("!!!invalid!!!", "aW52YWxpZA=="):
        with pytest.raises(paging.InvalidCursor):
            paging.Cursor.decode(bad)


@pytest.mark.parametrize(("given", "used"), [(0, 10), (-1, 10), (200, 10), (50, 50), (100, 100)])
def test_limits(given, used):
    assert paging.limit_of(given) == used


@pytest.mark.parametrize(("page", "size", "expected"), [(0, 0, (1, 10, 0)), (-1, -1, (1, 10, 0)), (1, 200, (1, 10, 0)), (5, 25, (5, 25, 100)), (2, 10, (2, 10, 10)), (5, 20, (5, 20, 80))])
def test_offsets(page, size, expected):
    assert paging.offset_of(page, size) == expected


@pytest.mark.parametrize(("page", "size", "total", "pages", "nxt", "prev"), [(1, 10, 25, 3, True, False), (2, 10, 25, 3, True, True), (3, 10, 25, 3, False, True), (1, 10, 5, 1, False, False), (1, 10, 0, 0, False, False)])
def test_page_info(page, size, total, pages, nxt, prev):
    i = paging.page_info(total, page, size)
    assert (i["total_pages"], i["has_next"], i["has_prev"]) == (pages, nxt, prev)


@pytest.mark.parametrize(("n", "has_more", "size"), [(6, True, 5), (3, False, 3), (0, False, 0)])
def test_keyset_page(spark, n, has_more, size):
    df = spark.createDataFrame([(i, f"k{i}") for i in range(n)], "s int, id string")
    p = paging.keyset_page(df, "s", "id", limit=5)
    assert (p.rows.count(), p.has_more, bool(p.next_cursor)) == (size, has_more, has_more)
    if has_more:
        c = paging.Cursor.decode(p.next_cursor)
        rest = paging.keyset_rows(df, "s", "id", after=(c.sort_value, c.id), limit=5).collect()
        assert [r.s for r in rest] == [0]
    with pytest.raises(ValueError, match="column"):
        paging.keyset_rows(df, "s; drop", "id")


def test_sql_and_search_helpers():
    assert paging.keyset_condition("created_at") == "(created_at, id) < ($1, $2)" and ">" in paging.keyset_condition("created_at", paging.ASC)
    assert paging.keyset_order("created_at") == "created_at DESC, id DESC"
    assert paging.search_after(None) is None
    assert paging.search_after(paging.Cursor("x", dt.datetime(2024, 1, 1, tzinfo=dt.UTC))) == [1704067200000, "x"] and paging.search_after(paging.Cursor("x")) == ["x"]
    assert paging.from_size(3, 20) == (40, 20)
    assert paging.sort_fields("created_at") == [{"created_at": {"order": "desc"}}, {"_id": {"order": "desc"}}]
