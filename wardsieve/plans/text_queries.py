"""Queries of text functions, the blocklist and the text cascade, with their SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardsieve.config import ImageSettings, TextSettings
from wardsieve.functions import text as X
from wardsieve.operators import admin, bloom, moderate
from wardsieve.operators import blocklist as B
from wardsieve.runtime import load, persist_table
from wardsieve.sources import chat

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


NORM = "translate(lower(strip_accents({c})), '0134578@$', 'oieastbas')"
TOKENS = r"regexp_extract_all({c}, '[A-Za-z0-9_\x{{80}}-\x{{10FFFF}}]+')"


def norm(c: str) -> str:
    return NORM.format(c=c)


def toks(c: str) -> str:
    return TOKENS.format(c=c)


def joined(c: str) -> F.Column:
    return F.concat_ws("|", c)


# --- functions ------------------------------------------------------------------------------


@query(f"SELECT doc_id, {norm('text')} AS norm FROM documents")
def normalize_text(spark, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", X.normalize("text").alias("norm"))


@query(f"SELECT doc_id, {norm('text')} AS norm FROM documents")
def normalize_text_exact(spark, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", X.normalize_exact("text").alias("norm"))


#: A phrase in conjoining letters, and in syllables.
_APART, _WHOLE = unicodedata.normalize("NFD", "한국어 값 각"), "한국어 값 각"


@query(f"SELECT doc_id, concat('{_WHOLE} ', {norm('text')}) AS norm FROM documents WHERE text IS NOT NULL")
def normalize_composed(spark, d: str) -> DataFrame:
    """Texts that begin with conjoining letters have the form of those that begin with syllables."""
    return load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.normalize(F.concat(F.lit(f"{_APART} "), "text")).alias("norm"))


@query(f"SELECT doc_id, len({toks('text')}) AS n_tokens, len(list_distinct({toks('text')})) AS n_distinct FROM documents")
def tokenize_counts(spark, d: str) -> DataFrame:
    t = X.tokens("text")
    n = lambda c: F.when(F.col("text").isNotNull(), F.size(c)).cast("long")
    return load(spark, d, "documents").select("doc_id", n(t).alias("n_tokens"), n(F.array_distinct(t)).alias("n_distinct"))


@query("SELECT content_hash, sha256(normalized_content) AS computed, sha256(normalized_content) = content_hash AS same FROM text_cache WHERE added_by <> 'auto'")
def submitted_keys(spark, d: str) -> DataFrame:
    return load(spark, d, "text_cache").where("added_by <> 'auto'").select("content_hash", X.sha_key("normalized_content").alias("computed")).withColumn("same", F.col("computed") == F.col("content_hash"))


@query("SELECT content_hash, content_hash AS computed FROM text_cache WHERE added_by = 'auto'")
def service_keys(spark, d: str) -> DataFrame:
    """Bit-exact 16-digit keys of the service's own rows, recomputed from their texts."""
    return load(spark, d, "text_cache").where("added_by = 'auto'").select("content_hash", X.fast_key("normalized_content").alias("computed"))


@query(f"SELECT norm, count(*) AS n FROM (SELECT {norm('text')} AS norm FROM text_request WHERE text <> '') GROUP BY norm HAVING count(*) > 1")
def repeated_texts(spark, d: str) -> DataFrame:
    rows = load(spark, d, "text_request").where("text <> ''").select(X.normalize("text").alias("norm"))
    return rows.groupBy("norm").agg(F.count("*").alias("n")).where("n > 1")


#: Answers of guard models in their forms, built from the rows' own categories.
_ANSWERS = {
    "label": "concat('Safety: ', CASE lower(trim(category)) WHEN 'safe' THEN 'Safe' WHEN 'unsafe' THEN 'Unsafe' WHEN 'controversial' THEN 'Controversial' ELSE 'none' END, chr(10), 'Categories: ', CASE WHEN nsfw_score > 0.5 THEN 'Violent, PII' WHEN nsfw_score > 0.2 THEN 'jailbreak' ELSE 'None' END)",
    "code": "concat(CASE WHEN lower(trim(category)) = 'unsafe' THEN ' Unsafe' ELSE 'safe' END, chr(10), CASE WHEN nsfw_score > 0.5 THEN 's1, S9' ELSE 'x2,s3 ' END)",
}


@query(
    f"""
WITH a AS (SELECT id, coalesce({_ANSWERS['label']}, '') AS answer FROM text_dataset),
p AS (SELECT id, answer, regexp_extract(answer, '(?i)Safety:\\s*(Safe|Unsafe|Controversial)', 1) AS label FROM a)
SELECT id, lower(label) = 'unsafe' AS is_nsfw, CASE WHEN label = '' THEN 'Unknown' ELSE label END AS safety_label,
array_to_string(list_filter(regexp_extract_all(answer, '(Violent|Non-violent Illegal Acts|Sexual Content or Sexual Acts|PII|Suicide & Self-Harm|Unethical Acts|Politically Sensitive Topics|Copyright Violation|Jailbreak|None)'), lambda x: x <> 'None'), '|') AS categories
FROM p"""
)
def parse_scorer_output(spark, d: str) -> DataFrame:
    rows = load(spark, d, "text_dataset").select("id", F.expr(_ANSWERS["label"]).alias("answer"))
    return rows.select("id", X.parse_scorer_output("answer").alias("s")).select("id", "s.is_nsfw", "s.safety_label", joined("s.categories").alias("categories"))


@query(
    f"""
WITH a AS (SELECT id, coalesce({_ANSWERS['label']}, '') AS answer FROM text_dataset),
p AS (SELECT id, answer, lower(regexp_extract(answer, '(?i)Safety:\\s*(Safe|Unsafe|Controversial)', 1)) AS label FROM a)
SELECT id, label NOT IN ('unsafe', 'controversial') AS is_safe, CASE label WHEN 'unsafe' THEN 2 WHEN 'controversial' THEN 1 ELSE 0 END AS severity,
CASE WHEN label = '' THEN '' ELSE array_to_string(list_filter(regexp_extract_all(answer, '(?i)(Violent|Non-violent Illegal Acts|Sexual Content or Sexual Acts|PII|Suicide & Self-Harm|Unethical Acts|Politically Sensitive Topics|Copyright Violation|Jailbreak|None)'), lambda x: lower(x) <> 'none'), '|') END AS categories
FROM p"""
)
def parse_guard_labels(spark, d: str) -> DataFrame:
    rows = load(spark, d, "text_dataset").select("id", F.expr(_ANSWERS["label"]).alias("answer"))
    return rows.select("id", X.parse_guard_labels("answer").alias("s")).select("id", "s.is_safe", "s.severity", joined("s.categories").alias("categories"))


@query(
    f"""
WITH a AS (SELECT id, lower(trim(coalesce({_ANSWERS['code']}, ''))) AS answer FROM text_dataset)
SELECT id, NOT starts_with(answer, 'unsafe') AS is_safe,
CASE WHEN starts_with(answer, 'unsafe') THEN array_to_string(list_filter(list_transform(string_split(coalesce(string_split(answer, chr(10))[2], ''), ','), lambda x: upper(trim(x))), lambda x: starts_with(x, 'S')), '|') ELSE '' END AS categories
FROM a"""
)
def parse_guard_codes(spark, d: str) -> DataFrame:
    rows = load(spark, d, "text_dataset").select("id", F.expr(_ANSWERS["code"]).alias("answer"))
    return rows.select("id", X.parse_guard_codes("answer").alias("s")).select("id", "s.is_safe", joined("s.categories").alias("categories"))


@query(
    """
WITH t AS (SELECT owner_id, request_id, received_at, text, lead(text) OVER (PARTITION BY owner_id ORDER BY received_at, request_id, text) AS reply FROM text_request WHERE owner_id IS NOT NULL)
SELECT owner_id, request_id, received_at, text AS user_text, reply FROM t"""
)
def message_pairs(spark, d: str) -> DataFrame:
    """Each owner's messages with the next one: pairs for a two-sided guard."""
    rows = load(spark, d, "text_request").where("owner_id IS NOT NULL").select("owner_id", "request_id", "received_at", "text")
    out = chat.following(rows, "owner_id", ["received_at", "request_id", "text"], F.date_trunc("hour", "received_at"), ["text"])
    return out.select("owner_id", "request_id", "received_at", F.col("text").alias("user_text"), F.col("next.text").alias("reply"))


# --- blocklist ------------------------------------------------------------------------------

#: The cache after all word requests, as admin.add_bad_words leaves it.
CACHE2 = """
bw AS (SELECT req_id, sha256(word) AS k, word, category, CASE WHEN nsfw_score BETWEEN 0 AND 1 THEN nsfw_score ELSE 1.0 END AS score, coalesce(model_version, 'Qwen/Qwen3Guard-Gen-0.6B') AS model, coalesce(added_by, 'manual') AS author, requested_at FROM bad_word WHERE word IS NOT NULL),
bf AS (SELECT k, arg_min(word, req_id) AS word, arg_max(coalesce(category, 'safe'), req_id) AS category, arg_max(score, req_id) AS score, arg_max(model, req_id) AS model, arg_min(author, req_id) AS author, min_by(requested_at, req_id) AS made, max_by(requested_at, req_id) AS changed FROM bw GROUP BY k),
cache2 AS (SELECT coalesce(c.content_hash, b.k) AS content_hash, CASE WHEN c.content_hash IS NULL THEN b.word ELSE c.normalized_content END AS normalized_content,
 CASE WHEN b.k IS NULL THEN c.category ELSE b.category END AS category, CASE WHEN b.k IS NULL THEN c.nsfw_score ELSE b.score END AS nsfw_score,
 CASE WHEN b.k IS NULL THEN c.model_version ELSE b.model END AS model_version, CASE WHEN c.content_hash IS NULL THEN b.author ELSE c.added_by END AS added_by,
 c.expires_at, CASE WHEN c.content_hash IS NULL THEN b.made ELSE c.created_at END AS created_at, CASE WHEN b.k IS NULL THEN c.updated_at ELSE b.changed END AS updated_at
 FROM text_cache c FULL JOIN bf b ON b.k = c.content_hash)"""
WORDS = (
    CACHE2
    + f""",
words AS (SELECT normalized_content AS word, category, coalesce(nsfw_score, 0.0) AS nsfw_score, {norm('normalized_content')} AS nw FROM cache2 WHERE category <> 'safe'),
pats AS (SELECT * FROM words WHERE nw <> ''),
keys AS (SELECT DISTINCT token FROM (SELECT nw AS token FROM pats UNION ALL SELECT {norm('u.tok')} FROM (SELECT unnest({toks('word')}) AS tok FROM pats WHERE len({toks('word')}) > 1) u))"""
)


def cache_with_words(spark, d: str) -> DataFrame:
    return admin.add_bad_words(load(spark, d, "text_cache"), load(spark, d, "bad_word"))


def words_of(spark, d: str) -> DataFrame:
    # read several times by each search
    return persist_table(B.prepared(admin.rebuild_filters(cache_with_words(spark, d))), "blocklist")


@query(f"WITH {CACHE2} SELECT content_hash, normalized_content, category, nsfw_score, model_version, added_by, expires_at, created_at, updated_at FROM cache2")
def add_bad_words(spark, d: str) -> DataFrame:
    return cache_with_words(spark, d).drop("detect_result")


@query(f"WITH {CACHE2} SELECT content_hash FROM cache2 WHERE content_hash NOT IN (SELECT sha256(word) FROM bad_word WHERE word IS NOT NULL AND lower(trim(category)) = 'spam')")
def remove_bad_words(spark, d: str) -> DataFrame:
    gone = load(spark, d, "bad_word").where("lower(trim(category)) = 'spam'")
    return admin.remove_bad_words(cache_with_words(spark, d), gone).select("content_hash")


@query(f"WITH {CACHE2} SELECT content_hash, category, (SELECT count(*) FROM cache2 WHERE category = 'insult') AS total FROM cache2 WHERE category = 'insult' ORDER BY created_at DESC, content_hash LIMIT 20 OFFSET 10")
def list_bad_words(spark, d: str) -> DataFrame:
    return admin.list_bad_words(cache_with_words(spark, d), "insult", 20, 10).select("content_hash", "category", "total")


@query(f"WITH {WORDS} SELECT word, category, nsfw_score FROM words")
def rebuild_filters(spark, d: str) -> DataFrame:
    return admin.rebuild_filters(cache_with_words(spark, d))


@query(f"WITH {WORDS} SELECT token FROM keys")
def gate_keys(spark, d: str) -> DataFrame:
    return B.gate_keys(words_of(spark, d))


@query(f"WITH {WORDS}, t AS (SELECT DISTINCT request_id, unnest({toks('text')}) AS tok FROM text_request) SELECT DISTINCT request_id FROM t WHERE {norm('tok')} IN (SELECT token FROM keys)")
def token_gate(spark, d: str) -> DataFrame:
    return B.gate(load(spark, d, "text_request").select("request_id", "text"), B.gate_keys(words_of(spark, d)), "request_id")


_TEXTS = f"texts AS (SELECT row_id, {norm('normalized_content')} AS norm FROM text_batch WHERE normalized_content IS NOT NULL)"
_MATCHES = f"""WITH {WORDS}, {_TEXTS},
m AS (SELECT t.row_id, p.word, p.category, p.nsfw_score, p.nw, t.norm FROM texts t JOIN pats p ON contains(t.norm, p.nw)),
hits AS (SELECT row_id, word, category, nsfw_score, CAST(i + len(nw) - 1 - len(word) + 1 AS INT) AS position, CAST(i + len(nw) - 1 AS INT) AS "end"
 FROM (SELECT *, unnest(range(0, len(norm) - len(nw) + 1)) AS i FROM m) WHERE substring(norm, CAST(i AS INT) + 1, CAST(len(nw) AS INT)) = nw)"""


def _texts(spark, d: str) -> DataFrame:
    return load(spark, d, "text_batch").where("normalized_content IS NOT NULL").select("row_id", X.normalize("normalized_content").alias("norm"))


@query(_MATCHES + " SELECT * FROM hits")
def blocklist_matches(spark, d: str) -> DataFrame:
    return B.search(_texts(spark, d), words_of(spark, d), "row_id")


@query(_MATCHES + " SELECT row_id, max(nsfw_score) AS max_nsfw_score, array_to_string(list_sort(list(DISTINCT category)), '|') AS categories, count(*) AS n_matches FROM hits GROUP BY row_id")
def match_summary(spark, d: str) -> DataFrame:
    return B.summary(B.search(_texts(spark, d), words_of(spark, d), "row_id"), "row_id").withColumn("categories", joined("categories"))


@query(_MATCHES + " SELECT DISTINCT row_id FROM hits")
def has_match(spark, d: str) -> DataFrame:
    return B.contains_any(_texts(spark, d), words_of(spark, d), "row_id")


_BITS = "(('0x' || substring(sha256(concat({c}, CAST(i AS VARCHAR))), 1, 15))::UBIGINT % {m}::UBIGINT)::BIGINT"
_TEXT, _IMAGE = TextSettings(), ImageSettings()


def _positions(c: str, s: TextSettings | ImageSettings) -> str:
    return f"SELECT DISTINCT {c}, {_BITS.format(c=c, m=s.bloom_bits)} AS position FROM {{t}}, range(0, {s.bloom_hashes}) r(i) WHERE {c} IS NOT NULL"


def _built(c: str, t: str, s: TextSettings | ImageSettings) -> str:
    return f"SELECT DISTINCT position FROM ({_positions(c, s).format(t=t)})"


def _probed(c: str, held: str, asked: str, s: TextSettings | ImageSettings) -> str:
    return f"WITH f AS ({_built(c, held, s)}), p AS ({_positions(c, s).format(t=asked)}) SELECT {c}, count(f.position) = count(*) AS maybe FROM p LEFT JOIN f USING (position) GROUP BY {c}"


@query(_built("content_hash", "text_cache", _TEXT))
def bloom_build(spark, d: str) -> DataFrame:
    return bloom.build(load(spark, d, "text_cache"), "content_hash", bits=_TEXT.bloom_bits, hashes=_TEXT.bloom_hashes)


@query(_probed("content_hash", "text_cache", "text_batch", _TEXT))
def bloom_probe(spark, d: str) -> DataFrame:
    made = bloom.build(load(spark, d, "text_cache"), "content_hash", bits=_TEXT.bloom_bits, hashes=_TEXT.bloom_hashes)
    return bloom.probe(load(spark, d, "text_batch"), "content_hash", made, bits=_TEXT.bloom_bits, hashes=_TEXT.bloom_hashes)


@query(_probed("file_hash", "image_cache", "image_batch", _IMAGE))
def bloom_probe_images(spark, d: str) -> DataFrame:
    made = bloom.build(load(spark, d, "image_cache"), "file_hash", bits=_IMAGE.bloom_bits, hashes=_IMAGE.bloom_hashes)
    return bloom.probe(load(spark, d, "image_batch"), "file_hash", made, bits=_IMAGE.bloom_bits, hashes=_IMAGE.bloom_hashes)


@query(_built("content_hash", "(SELECT content_hash FROM text_cache WHERE expires_at IS NULL OR expires_at > TIMESTAMPTZ '2026-05-16 00:00:00+00')", _TEXT))
def bloom_expired(spark, d: str) -> DataFrame:
    """Bits that are left when those of expired rows have run out."""
    rows = load(spark, d, "text_cache").where("content_hash IS NOT NULL")
    bits = rows.select(F.explode(bloom.positions("content_hash", _TEXT.bloom_bits, _TEXT.bloom_hashes)).alias("position"), "expires_at")
    return bloom.unexpired(bits, F.lit("2026-05-16 00:00:00").cast("timestamp"))


@query("SELECT DISTINCT content_hash, false AS maybe FROM text_batch WHERE content_hash IS NOT NULL")
def bloom_dropped(spark, d: str) -> DataFrame:
    """After its filter is dropped, nothing may be in it."""
    made = bloom.build(load(spark, d, "text_cache"), "content_hash", bits=_TEXT.bloom_bits, hashes=_TEXT.bloom_hashes)
    return bloom.probe(load(spark, d, "text_batch"), "content_hash", bloom.drop(made), bits=_TEXT.bloom_bits, hashes=_TEXT.bloom_hashes)


# --- the cascade ----------------------------------------------------------------------------


def first_requests(spark, d: str) -> DataFrame:
    """Each request once: its first delivery."""
    rows = load(spark, d, "text_request").where("request_id IS NOT NULL")
    first = rows.groupBy("request_id").agg(F.min(F.struct("received_at", "owner_id", "text")).alias("r"))
    return first.select("request_id", "r.owner_id", "r.text", "r.received_at")


def model_scores(spark, d: str) -> DataFrame:
    """Answers of the text model by normal form: detections that arrived with batch rows."""
    rows = load(spark, d, "text_batch").where("added_by = 'auto' AND normalized_content IS NOT NULL")
    label = F.lower(F.trim("category"))
    level = F.max(F.when(label == "unsafe", 2).when(label == "controversial", 1).otherwise(0))
    asked = rows.groupBy(F.col("normalized_content").alias("norm")).agg(level.alias("a"))
    return asked.select("norm", (F.col("a") > 0).alias("is_nsfw"), F.element_at(F.array(F.lit("Safe"), F.lit("Controversial"), F.lit("Unsafe")), F.col("a") + 1).alias("safety_label"), F.when(F.col("a") > 0, F.array(F.lit("Violent"))).otherwise(F.array().cast("array<string>")).alias("categories"))


def cascade_sql(requests: str, order: str) -> str:
    """CTEs of the text cascade over ``requests`` (request_id, text, ...), ending in ``verdicts``."""
    return f"""WITH {WORDS},
req AS ({requests}),
rn AS (SELECT *, CASE WHEN text <> '' THEN {norm('text')} END AS norm FROM req),
dist AS (SELECT norm, first(text ORDER BY {order}, text) AS text FROM rn WHERE norm IS NOT NULL GROUP BY norm),
known AS (SELECT normalized_content AS norm, category AS cached, coalesce(nsfw_score, 0.0) AS cached_score FROM text_cache WHERE len(content_hash) = 16),
miss AS (SELECT * FROM dist WHERE norm NOT IN (SELECT norm FROM known WHERE norm IS NOT NULL)),
gated AS (SELECT DISTINCT norm FROM (SELECT norm, unnest({toks('text')}) AS tok FROM miss) WHERE {norm('tok')} IN (SELECT token FROM keys)),
m AS (SELECT g.norm, max(p.nsfw_score) AS score, list(DISTINCT p.category) AS cats FROM gated g JOIN pats p ON contains(g.norm, p.nw) GROUP BY g.norm),
model AS (SELECT normalized_content AS norm, max(CASE lower(trim(category)) WHEN 'unsafe' THEN 2 WHEN 'controversial' THEN 1 ELSE 0 END) AS level FROM text_batch WHERE added_by = 'auto' AND normalized_content IS NOT NULL GROUP BY 1),
fresh AS (SELECT miss.norm, coalesce(m.score, 0.0) AS score, m.norm IS NOT NULL AS hit, coalesce(m.cats, []) AS cats, CASE WHEN coalesce(m.score, 0.0) < 0.85 THEN model.level END AS level FROM miss LEFT JOIN m USING (norm) LEFT JOIN model USING (norm)),
results AS (
SELECT norm, true AS cache_hit, coalesce(cached = 'safe', false) AS is_clean, coalesce(cached = 'unsafe', false) AS should_reject, coalesce(cached = 'controversial', false) AS should_review, cached_score AS max_nsfw_score, '' AS categories, false AS nsfw_checked FROM known WHERE norm IN (SELECT norm FROM dist)
UNION ALL
SELECT norm, false, NOT hit AND coalesce(level, 0) = 0, score >= 0.85 OR coalesce(level, 0) = 2, (score < 0.85 AND score >= 0.5) OR coalesce(level, 0) = 1, score,
 array_to_string(list_sort(list_distinct(list_concat(cats, CASE WHEN level > 0 THEN ['Violent'] ELSE [] END))), '|'), level IS NOT NULL FROM fresh),
verdicts AS (SELECT rn.request_id, coalesce(cache_hit, false) AS cache_hit, coalesce(is_clean, true) AS is_clean, coalesce(should_reject, false) AS should_reject, coalesce(should_review, false) AS should_review, coalesce(max_nsfw_score, 0.0) AS max_nsfw_score, coalesce(categories, '') AS categories, coalesce(nsfw_checked, false) AS nsfw_checked, rn.norm FROM rn LEFT JOIN results USING (norm))"""


VERDICT_SQL = """CASE WHEN should_reject THEN 'AUTO_REJECT' WHEN should_review THEN 'PENDING_REVIEW' ELSE 'AUTO_APPROVE' END AS action,
CASE WHEN should_reject THEN 'REJECT' WHEN should_review THEN 'REVIEW' ELSE 'CLEAN' END AS verdict,
CASE WHEN should_reject THEN 'Content rejected due to policy violation' WHEN should_review THEN 'Content flagged for manual review' ELSE '' END AS reason"""
_FIRST = "SELECT request_id, r.owner_id, r.text, r.received_at FROM (SELECT request_id, arg_min(struct_pack(received_at, owner_id, text), (received_at, coalesce(owner_id, ''), coalesce(text, ''))) AS r FROM text_request WHERE request_id IS NOT NULL GROUP BY request_id)"
_CASCADE = cascade_sql(_FIRST, "received_at, request_id")
_SHOWN = "request_id, cache_hit, is_clean, should_reject, should_review, max_nsfw_score, categories, nsfw_checked"


def text_results(spark, d: str, settings: TextSettings = TextSettings()) -> DataFrame:
    return moderate.moderate_text(first_requests(spark, d), load(spark, d, "text_cache"), admin.rebuild_filters(cache_with_words(spark, d)), model_scores(spark, d), settings, order=["received_at", "request_id"])


def _shown(df: DataFrame) -> DataFrame:
    return df.select("request_id", "cache_hit", "is_clean", "should_reject", "should_review", "max_nsfw_score", joined("categories").alias("categories"), "nsfw_checked", "action", "verdict", "reason", F.element_at("scores", "text_nsfw").alias("text_nsfw"))


@query(f"{_CASCADE} SELECT {_SHOWN}, {VERDICT_SQL}, CASE WHEN max_nsfw_score > 0 THEN max_nsfw_score END AS text_nsfw FROM verdicts")
def moderate_text(spark, d: str) -> DataFrame:
    return _shown(text_results(spark, d))


@query(f"{_CASCADE} SELECT verdict, action, count(*) AS n, count(DISTINCT norm) AS n_texts FROM (SELECT norm, {VERDICT_SQL} FROM verdicts) GROUP BY verdict, action")
def verdict_counts(spark, d: str) -> DataFrame:
    return text_results(spark, d).groupBy("verdict", "action").agg(F.count("*").alias("n"), F.countDistinct("norm").alias("n_texts"))


@query(f"{_CASCADE} SELECT DISTINCT norm AS normalized_content, CASE WHEN should_reject THEN 'unsafe' WHEN should_review THEN 'controversial' ELSE 'safe' END AS category, max_nsfw_score AS nsfw_score, 'auto' AS added_by FROM verdicts WHERE NOT cache_hit AND norm IS NOT NULL")
def text_cache_delta(spark, d: str) -> DataFrame:
    return moderate.text_cache_delta(text_results(spark, d), F.lit("2026-06-01").cast("timestamp")).select("normalized_content", "category", "nsfw_score", "added_by")


@query(f"{_CASCADE} SELECT DISTINCT norm FROM verdicts WHERE nsfw_checked AND contains(categories, 'Violent') AND NOT cache_hit")
def model_feedback(spark, d: str) -> DataFrame:
    return moderate.feedback(text_results(spark, d)).select("norm")


@query(f"{_CASCADE} SELECT {_SHOWN}, {VERDICT_SQL} FROM verdicts")
def stream_moderate(spark, d: str) -> DataFrame:
    """The cascade as a stream over the request table, run to its end; results of all batches."""
    from wardsieve.runtime import shared_path
    from wardsieve.streaming.micro_batch import TextStream

    source = f"{d}/text_request.parquet"
    schema = load(spark, d, "text_request").schema
    stream = TextStream(spark, shared_path(spark, "stream"), load(spark, d, "text_cache"), admin.rebuild_filters(cache_with_words(spark, d)), model_scores(spark, d))
    glob = source if not source.endswith(".parquet") else f"{d}/text_request.parquet*"
    run = stream.start(spark.readStream.schema(schema).parquet(glob).where("request_id IS NOT NULL"))
    run.awaitTermination()
    return _shown(stream.results()).drop("text_nsfw")
