import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardsieve.config import Settings
from wardsieve.functions import hashes as H
from wardsieve.functions import text as X
from wardsieve.functions.text import _plain


def one(spark, expr, *values, schema="a string"):
    return [r[0] for r in spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema).select(expr).collect()]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("B4DW0RD", "badword"), ("Ünïcödé $3@", "unicode sea"), ("ΟΔΟΣ", "οδοσ"), ("", ""), (None, None), ("é", "e"), ("İ", "i")],
)
def test_normalize(spark, text, expected):
    assert one(spark, X.normalize("a"), text) == [expected]
    assert one(spark, X.normalize_exact("a"), text) == [expected]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=40), min_size=1, max_size=20))
def test_normalize_native_equals_exact(spark, texts):
    odd = lambda t: any(len(_plain(c)) > 1 or "ᄀ" <= c <= "ᇿ" or unicodedata.category(c) in ("Cn", "Cs", "Co") for c in t)
    texts = [t for t in texts if not odd(t) and unicodedata.normalize("NFC", t) == t] or ["a"]
    assert one(spark, X.normalize("a"), *texts) == [_plain(t) for t in texts]


def test_normalize_is_idempotent(spark):
    texts = ["Ünïcödé $3@ 1234567890", "Straße ﬁ ΟΔΟΣ", "日本語 が"]
    once = one(spark, X.normalize("a"), *texts)
    assert one(spark, X.normalize("a"), *once) == once


def test_tokens(spark):
    assert one(spark, X.tokens("a"), "bad_Word é1, x-y", "", "@$")[:3] == [["bad_Word", "é1", "x", "y"], [], []]


def test_keys(spark):
    assert one(spark, X.sha_key("a"), "abc") == ["ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"]
    assert one(spark, X.fast_key("a"), "", None) == ["99e9d85137db46ef", None]


def test_merge_categories(spark):
    df = spark.createDataFrame([(["b", "a"], ["a", "c"]), (None, ["x"]), (None, None)], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(X.merge_categories("a", "b")).collect()] == [["a", "b", "c"], ["x"], []]


@pytest.mark.parametrize(
    ("answer", "safe", "severity", "categories"),
    [
        ("Safety: Safe\nCategories: None", True, 0, []),
        ("Safety: Unsafe\nCategories: Violent", False, 2, ["Violent"]),
        ("Safety: Controversial\nCategories: Politically Sensitive Topics", False, 1, ["Politically Sensitive Topics"]),
        ("no answer, Violent", True, 0, []),
        (None, True, 0, []),
    ],
)
def test_guard_labels(spark, answer, safe, severity, categories):
    (r,) = one(spark, X.parse_guard_labels("a"), answer)
    assert (r.is_safe, r.severity, r.categories) == (safe, severity, categories)


@pytest.mark.parametrize(("answer", "safe", "categories"), [("safe", True, []), ("unsafe\nS1, S9", False, ["S1", "S9"]), (" UNSAFE\ns3,x4", False, ["S3"]), ("unsafe", False, []), (None, True, [])])
def test_guard_codes(spark, answer, safe, categories):
    (r,) = one(spark, X.parse_guard_codes("a"), answer)
    assert (r.is_safe, r.categories) == (safe, categories)


def test_scorer_output(spark):
    a, b = one(spark, X.parse_scorer_output("a"), "safety: UNSAFE\nCategories: Violent, violent, None", "?")
    assert (a.is_nsfw, a.safety_label, a.categories) == (True, "UNSAFE", ["Violent"])
    assert (b.is_nsfw, b.safety_label, b.categories) == (False, "Unknown", [])


def test_prompts(spark):
    df = spark.createDataFrame([("hi {x}", None, "Llama-Guard-3"), ("hi", "yo", "llamaguard"), ("hi", "", "other"), ("hi", "yo", "other")], "u string, a string, m string")
    p = [r[0] for r in df.select(X.guard_prompt("u", "a", "m")).collect()]
    assert "User: hi {x}\n<END" in p[0] and "'User' message" in p[0] and p[0].endswith("<|end_header_id|>")
    assert "User: hi\nAssistant: yo\n<END" in p[1] and "in the conversation." in p[1]
    assert 'User message: "hi"' in p[2] and "- S2: Non-Violent Crimes  \n- S3" in p[2]
    assert 'User: "hi"\nAssistant: "yo"' in p[3] and "- S2: Non-Violent Crimes\n" in p[3]


def test_category_names(spark):
    assert one(spark, X.category_description("a"), "Violent", "unknown") == ["Violent", "unknown"]
    assert len(X.GUARD_CATEGORIES) == 9


def signed(h):
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize(("a", "b", "d"), [(5, 5, 0), (0xFE, 0xFF, 1), (0, (1 << 64) - 1, 64), (0x00000000FFFFFFFF, 0xFFFFFFFF00000000, 64)])
def test_hamming(spark, a, b, d):
    df = spark.createDataFrame([(signed(a), signed(b))], "a long, b long")
    r = df.select(H.hamming("a", "b"), H.similarity_score("a", "b"), H.is_similar("a", "b", 5), H.is_similar("a", "b", 0)).first()
    assert tuple(r) == (d, (1 - d / 64) * 100, d <= 5, d == 0)


def test_hash_rendering(spark):
    df = spark.createDataFrame([(signed(0xDEADBEEF12345678),), (0,), (-1,)], "a long")
    r = df.select(H.hash_hex("a").alias("x"), H.hash_bytes("a"), H.from_hex(H.hash_hex("a"))).collect()
    assert [x[0] for x in r] == ["deadbeef12345678", "0" * 16, "f" * 16]
    assert bytes(r[0][1]).hex() == "deadbeef12345678" and [x[2] for x in r] == [signed(0xDEADBEEF12345678), 0, -1]
    assert one(spark, H.hash_type_name("a"), 0, 1, 2, 9, schema="a int") == ["pHash", "aHash", "dHash", "unknown"]


def test_resolve_file_hash(spark):
    df = spark.createDataFrame([("given", b"x"), ("", b"abc"), (None, b"abc")], "h string, c binary")
    got = [r[0] for r in df.select(H.resolve_file_hash("h", "c")).collect()]
    assert got[0] == "given" and got[1] == got[2] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


@pytest.mark.parametrize(("text", "h"), [("", 0), ("hello", 0xCBD8A7B341BD9B02), ("hello, world", 0x342FAC623A5EBC8E), ("The quick brown fox jumps over the lazy dog", 0xE34BBC7BBC071B6C)])
def test_murmur(spark, text, h):
    assert H.murmur3_64(text.encode()) == h
    assert one(spark, H.murmur3("a"), text) == [signed(h)]


def test_softmax_and_label(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([1.0, 3.0],)], "a array<double>")
    r = df.select(H.image_label("a", ["normal", "nsfw"]).alias("s")).select("s.*").collect()
    assert r[0].label == "normal" and not r[0].is_nsfw and r[0].confidence == 0.5
    assert r[1].is_nsfw and abs(r[1].nsfw_score + r[1].normal_score - 1) < 1e-12


def test_settings(tmp_path):
    s = Settings.of({"text": {"reject_threshold": 0.9}, "image": {"max_distance": 5}})
    assert (s.text.reject_threshold, s.text.review_threshold, s.image.max_distance) == (0.9, 0.5, 5)
    with pytest.raises(ValueError, match="unknown"):
        Settings.of({"text": {"nonsense": 1}})
    (tmp_path / "c.json").write_text('{"image": {"nsfw_threshold": 0.6}}')
    assert Settings.read(str(tmp_path / "c.json")).image.nsfw_threshold == 0.6


def test_tokens_match_a_plain_reading(spark):
    texts = ["a_b c9-d", "Привет, мир!", "x y", "emoji 🙂 ok"]
    assert one(spark, X.tokens("a"), *texts) == [re.findall(r"[A-Za-z0-9_\u0080-\U0010ffff]+", t) for t in texts]
    assert one(spark, F.size(X.tokens("a")), None) in ([None], [-1])
