"""Every training-data query on hostile tables: empty ones, nulls in any column, very long and
empty texts, ties, repeated rows, extra columns whose names clash with internal ones."""

import pytest
from pyspark.sql import functions as F

from wardsieve.llm import catalog

REVIEW = "detect_result string, category string, nsfw_score double, model_version string, added_by string, expires_at timestamp, created_at timestamp, updated_at timestamp"
SCHEMAS = {
    "text_cache": f"content_hash string, normalized_content string, {REVIEW}",
    "text_batch": f"row_id long, batch_no int, arrived_at timestamp, content_hash string, normalized_content string, {REVIEW}",
    "text_dataset": f"id long, content_hash string, normalized_content string, {REVIEW}",
    "image_cache": f"file_hash string, phash long, source_url string, {REVIEW}",
    "image_batch": f"row_id long, batch_no int, arrived_at timestamp, file_hash string, phash long, source_url string, {REVIEW}",
    "image_dataset": f"id long, file_hash string, phash long, source_url string, {REVIEW}",
    "bad_word": "req_id long, word string, category string, nsfw_score double, added_by string, model_version string, requested_at timestamp",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, owner_id string, posted_at timestamp",
    "text_review": "id long, abusive int, reviewer string",
    "doc_level": "doc_id long, reading_level string",
    "category_target": "kind string, category string, target_share double, min_rows int",
    "source_weight": "source string, target_share double, max_repeat int",
}
CLASHING = ["key", "h", "shard", "a", "b", "n", "text", "words", "kind", "take", "__h", "__w", "seg", "cell", "canonical", "form", "score", "pi", "available", "copies", "rep"]
LONG = "very long text without end " * 20_000
ODD = "x" * 50_000


def _write(spark, folder, rows_of):
    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame(rows_of(name, schema), schema)
        for c in CLASHING:
            if c not in df.columns:
                df = df.withColumn(c, F.lit("clash"))
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _hostile(name, schema):
    cols = [c.strip().rsplit(" ", 1) for c in schema.split(",")]
    texts = [None, "", "   ", LONG, ODD, "same words here again and again one two three four five six seven", "same words here again and again one two three four five six seven", "call me on 630-555-0126, jane@mail.example", "​­", "ｗｉｄｅ word", "wide word", "wide word", "日本語のテキスト。短い文。", "caf\u00e9", "cafe\u0301"]
    out = []
    for i in range(30):
        row = []
        for c, t in cols:
            if c in ("id", "row_id", "req_id", "doc_id"):
                row.append(i + 1)
            elif c == "batch_no":
                row.append(i % 12 + 1)
            elif c in ("normalized_content", "text", "word"):
                row.append(texts[i % len(texts)])
            elif c == "category":
                row.append([None, "", " Unsafe ", "unsafe", "insult"][i % 5])
            elif c in ("content_hash", "file_hash"):
                row.append([None, "", "  ", "AB12", "ab12 ", f"k{i}"][i % 6])
            elif c == "phash":
                row.append([None, 0, -1, -2, 7, 7][i % 6])
            elif c == "abusive":
                row.append([None, 0, 1][i % 3])
            elif c == "reading_level":
                row.append([None, "basic", "advanced", "other"][i % 4])
            elif c == "lang":
                row.append(["en", None, "xx"][i % 3])
            elif c == "kind":
                row.append(["text", "image"][i % 2])
            elif t == "double":
                row.append(None if i % 7 == 0 else 0.1)
            elif t in ("int", "long"):
                row.append(None if i % 5 == 0 else i % 3)
            elif t == "timestamp":
                row.append(None)
            else:
                row.append(None if i % 4 == 0 else f"s{i % 3}")
        out.append(tuple(row))
    if name in ("category_target", "source_weight"):
        out = out[:6]
    return out


@pytest.fixture(scope="module")
def hostile(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("hostile"), _hostile)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("empty"), lambda *_: [])


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_empty_tables(spark, empty, name):
    assert catalog.queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_hostile_tables(spark, hostile, name):
    rows = catalog.queries()[name](spark, hostile).collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
    if name == "p8_ids":
        by = {r.doc_id: r.ids for r in rows}
        assert by[1] == [] and by[2] == [] and len(by) == 30 and len(by[4]) > 50_000
    if name == "p7_found":
        assert (("text", 5) in {tuple(r) for r in rows}) and (("text", 1) not in {tuple(r) for r in rows})
    if name == "p4_found":
        assert ("image", 6) in {tuple(r) for r in rows} and ("image", 2) not in {tuple(r) for r in rows if r.row_id == 2}
    if name == "p3_found":
        pairs = {(r.key_a, r.key_b) for r in rows if r.kind == "bad_word"}
        assert ("10", "11") in pairs and ("10", "12") in pairs and ("14", "15") in pairs
