"""Near-copies among training rows by multi-index hashing.

Images: the 64 bits are cut into three segments. Hashes within 8 bits agree within 2 bits in
some segment (3+3+3 > 8), so every hash enumerates the ball of radius 1 in each segment, both
sides of a pair meet in the middle, and complete distances are verified.

Texts: the fingerprint is the set of distinct words. Sets with overlap (common words / words of
either) of at least 0.7 differ in few words, so when words are ordered from rare to frequent
the first common word lies within the first 30 % of both. The segments are these rare ends, and
the enumerated neighbourhood is their words (for frequent words: ordered runs of the first
common words), which reaches every such pair; complete overlaps are verified. A key that too
many rows share is not expanded into pairs: each of its rows is re-keyed by one more word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardsieve.runtime import load, persist_table

#: Overlap of word sets as a fraction of integers, and the fewest distinct words.
OVERLAP = (7, 10)
MIN_WORDS = 10
MAX_BITS = 8
#: (shift, bits) of the segments of a 64-bit hash, and the radius within which one must agree.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Most frequent words, whose counts are exact and which are written by their place.
FREQUENT_WORDS = 20_000
#: Counters of all other words, as a power of two; words that share one share their sum.
COUNTERS_POWER = 18
#: Rows that a word may occur in to be a key by itself.
RARE_ROWS = 250
#: Rows that may share a key before it is refined by a further word, and the most words of a key.
KEY_ROWS = 1_000
KEY_WORDS = 6


# --- 64-bit hashes --------------------------------------------------------------------------


def hash_pairs(hashes: DataFrame, col: str = "phash") -> DataFrame:
    """(a, b), a < b as signed longs: distinct values of ``col`` that differ in 1 to 8 bits.

    ``hashes`` must hold each value once. A pair meets under several keys; it is kept at one of
    them: in its first segment of at most 2 differing bits, at its own code (0 or 1 bit) or the
    smaller of the two codes between (2 bits).
    """
    code = lambda c, s: F.shiftrightunsigned(c, s[0]).bitwiseAND(F.lit((1 << s[1]) - 1))

    def ball(k: int, s: tuple[int, int]) -> F.Column:
        flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(s[1])])
        return F.transform(flips, lambda flip: F.struct(F.lit(k).alias("seg"), code(F.col(col), s).bitwiseXOR(flip).alias("key")))

    balls = [ball(k, s) for k, s in enumerate(SEGMENTS)]
    # the segment is part of the key: codes have 22 bits at most
    keyed = hashes.select(F.col(col).alias("h"), F.explode(F.concat(*balls)).alias("k")).select("h", (F.shiftleft(F.col("k.seg").cast("long"), 22) + F.col("k.key")).alias("band")).repartition("band")
    a, b = keyed.select(F.col("h").alias("a"), "band"), keyed.select(F.col("h").alias("b"), "band")
    met = a.join(b, "band").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    apart = [F.bit_count(code(diff, s)) for s in SEGMENTS]
    here, seg, key = F.lit(False), F.shiftright("band", 22), F.col("band").bitwiseAND(F.lit((1 << 22) - 1))
    for k, s in enumerate(SEGMENTS):
        mine = F.when(apart[k] <= 1, key == code(F.col("a"), s)).otherwise(key < code(diff, s).bitwiseXOR(key))
        earlier = F.lit(False)
        for x in apart[:k]:
            earlier = earlier | (x <= 2)
        here = here | ((seg == k) & ~earlier & mine)
    return met.where(here).select("a", "b")


def image_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b), near pairs of first rows of each hash; (rep, id), the rows of repeated hashes.

    Null and 0 hashes are in neither.
    """
    rows = rows.where("phash IS NOT NULL AND phash <> 0").select("id", "phash")
    firsts = persist_table(rows.groupBy("phash").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "hashes")
    pairs = hash_pairs(firsts.select("phash"))
    for side in ("a", "b"):
        at = firsts.select(F.col("phash").alias(side), F.col("rep").alias(f"id_{side}"))
        pairs = pairs.join(at, side)
    copies = rows.join(firsts.where("copies > 1"), "phash").select("rep", "id")
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")), copies


def expanded(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """(id_a, id_b): all pairs of rows from pairs (a, b) of classes' first rows and the rows
    (rep, id) of classes with several."""
    pairs, copies = persist_table(pairs, "classpairs"), persist_table(copies, "copies")
    others = copies.where("id <> rep")
    near = pairs.unionByName(pairs.join(others, F.col("a") == F.col("rep")).select(F.col("id").alias("a"), "b"))
    near = near.unionByName(near.join(others, F.col("b") == F.col("rep")).select("a", F.col("id").alias("b")))
    near = near.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
    equal = copies.alias("l").join(copies.alias("r"), F.expr("l.rep = r.rep AND l.id < r.id")).select(F.col("l.id").alias("id_a"), F.col("r.id").alias("id_b"))
    return near.unionByName(equal)


def image_pairs(rows: DataFrame) -> DataFrame:
    """(id_a, id_b): rows (id, phash) within 8 bits. Null and 0 hashes are in no pair."""
    return expanded(*image_classes(rows))


# --- word sets ------------------------------------------------------------------------------


def word_sets(rows: DataFrame) -> DataFrame:
    """(id, words) of rows (id, text) with at least 10 distinct words.

    ``words`` are 64-bit hashes of lower-cased runs of letters and numbers, distinct. Null texts
    have no words.
    """
    words = F.transform(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(F.lower(w)))
    return rows.select("id", F.array_distinct(words).alias("words")).where(F.size("words") >= MIN_WORDS)


ORDERED = "id long, words array<long>, n int, rare int, busy int"


def ordered_sets(sets: DataFrame) -> DataFrame:
    """ORDERED: words from rare to frequent, and how many at the front are rare.

    The order is one for all rows: by document count, then by hash. Counts cover all rows. They
    are exact for the most frequent words, which are written as their place, in less room than a
    hash; for others they are at most too high, by the words that share a counter. ``rare`` words
    are keys by themselves; from ``busy`` on words occur in more than KEY_ROWS rows. Whatever the
    vocabulary, 20,000 words and 2^18 counters travel to the driver and back.
    """
    spark = sets.sparkSession
    counts = persist_table(sets.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")), "wordcounts")
    top = counts.where("n > 1").orderBy(F.desc("n"), "w").limit(FREQUENT_WORDS).toArrow()
    mask = (1 << COUNTERS_POWER) - 1
    sums = counts.groupBy(F.col("w").bitwiseAND(F.lit(mask)).alias("c")).agg(F.sum("n").alias("n")).toArrow()
    counters = np.zeros(mask + 1, np.int32)
    counters[sums["c"].to_numpy()] = np.minimum(sums["n"].to_numpy(), 2**31 - 1)
    by_hash = np.argsort(top["w"].to_numpy())
    known, n = top["w"].to_numpy()[by_hash], top["n"].to_numpy()
    place = (len(top) - np.arange(len(top), dtype=np.int64))[by_hash]
    shared = spark.sparkContext.broadcast((known, place, n[by_hash], counters))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place, n, counters = shared.value
        for b in batches:
            lists = b.column(1)
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            row = np.repeat(np.arange(len(lists)), np.diff(offsets))
            often, code = counters[flat & (len(counters) - 1)].astype(np.int64), flat
            if len(known) and len(flat):
                i = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                hit = known[i] == flat
                often, code = np.where(hit, n[i], often), np.where(hit, place[i], flat)
            by = np.lexsort((code, often, row))
            many = lambda flag: pa.array(np.bincount(row[flag], minlength=len(lists)).astype(np.int32))
            words = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(code[by]))
            yield pa.RecordBatch.from_arrays([b.column(0), words, pa.array(np.diff(offsets).astype(np.int32)), many(often <= RARE_ROWS), many(often <= KEY_ROWS)], ["id", "words", "n", "rare", "busy"])

    return sets.select("id", "words").mapInArrow(order, ORDERED)


def _fewest_common(n: F.Column) -> F.Column:
    return F.ceil(n * OVERLAP[0] / OVERLAP[1] - 1e-9).cast("int")


#: A key row is (key, id, m): m holds the set's size, the place of the key's last word, and how
#: many words the key has, in 31, 29 and 3 bits.
def _packed(n: F.Column, last: F.Column, k: F.Column) -> F.Column:
    return (F.shiftleft(n.cast("long"), 32) + F.shiftleft(last.cast("long"), 3) + k).alias("m")


def _size(m: F.Column) -> F.Column:
    return F.shiftright(m, 32)


def _last(m: F.Column) -> F.Column:
    return F.shiftright(m, 3).bitwiseAND(F.lit((1 << 29) - 1))


def _words_of(m: F.Column) -> F.Column:
    return m.bitwiseAND(F.lit(7))


def _first_keys(sets: DataFrame) -> DataFrame:
    """(key, id, m, calm) of a row's possible first common word, if rare, else first two words.

    ``calm`` keys are in at most KEY_ROWS rows, since their first word is.
    """
    prefix = F.col("n") - _fewest_common(F.col("n")) + 1
    word = lambda i: F.get("words", i)
    single = sets.select("id", "n", "busy", F.posexplode(F.slice("words", F.lit(1), F.least("rare", prefix))).alias("at", "key"))
    single = single.select("key", "id", _packed(F.col("n"), F.col("at"), F.lit(1)), (F.col("at") < F.col("busy")).alias("calm"))
    frequent = sets.where(F.col("rare") < prefix).select("id", "n", "words", "busy", prefix.alias("p"), F.explode(F.sequence("rare", prefix - 1)).alias("i"))
    frequent = frequent.where("i < p").select("id", "n", "words", "busy", "i", F.explode(F.sequence(F.col("i") + 1, F.least(F.col("p"), F.col("n") - 1))).alias("at"))
    double = frequent.select(F.xxhash64(word(F.col("i")), word(F.col("at"))).alias("key"), "id", _packed(F.col("n"), F.col("at"), F.lit(2)), (F.col("i") < F.col("busy")).alias("calm"))
    return single.unionByName(double)


def _meet(keys: DataFrame) -> DataFrame:
    """Candidate (a, b) under shared keys that can still reach the overlap."""
    a = keys.select("key", F.col("id").alias("a"), F.col("m").alias("ma"))
    b = keys.select("key", F.col("id").alias("b"), F.col("m").alias("mb"))
    left = lambda m: _size(m) - _last(m)
    most = _words_of(F.col("ma")) + F.least(left(F.col("ma")), left(F.col("mb"))) - 1
    return a.join(b, "key").where((F.col("a") < F.col("b")) & (most * sum(OVERLAP) >= (_size(F.col("ma")) + _size(F.col("mb"))) * OVERLAP[0])).select("a", "b")


def set_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): pairs of different sets of ``ordered_sets`` that overlap enough."""
    keys = _first_keys(sets)
    found = [_meet(keys.where("calm").select("key", "id", "m").repartition("key"))]  # one exchange for both sides
    level = keys.where("NOT calm").select("key", "id", "m")
    for k in range(2, KEY_WORDS + 1):
        level = persist_table(level, "keys").repartition("key")
        if level.isEmpty():
            break
        if k == KEY_WORDS:
            found.append(_meet(level))
            break
        crowded = persist_table(level.groupBy("key").agg(F.count("*").alias("rows")).where(f"rows > {KEY_ROWS}").select("key"), "crowded")
        found.append(_meet(level.join(crowded, "key", "left_anti")))
        hot = level.join(crowded, "key", "left_semi").join(sets.select("id", "words"), "id")
        n, last, words = _size(F.col("m")).cast("int"), _last(F.col("m")).cast("int"), _words_of(F.col("m")).cast("int")
        until = F.least(n - _fewest_common(n) + words, n - 1)
        longer = hot.where(last < until).select("id", "key", "words", n.alias("n"), words.alias("k"), F.explode(F.sequence(last + 1, until)).alias("next"))
        level = longer.select(F.xxhash64("key", F.get("words", F.col("next"))).alias("key"), "id", _packed(F.col("n"), F.col("next"), F.col("k") + 1))
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.unionByName(f)
    pairs = pairs.distinct().join(sets.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a").join(sets.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    return pairs.where(common * sum(OVERLAP) >= (F.size("wa") + F.size("wb")) * OVERLAP[0]).select("a", "b")


def text_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b), near pairs of first rows of each word set; (rep, id), the rows of repeated sets.

    Of rows with one and the same set only the first is searched with.
    """
    sets = persist_table(ordered_sets(word_sets(rows)).withColumns({"s1": F.xxhash64("words"), "s2": F.xxhash64(F.lit(1), "words")}), "sets")
    same = sets.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    copies = persist_table(sets.select("id", "s1", "s2").join(same, ["s1", "s2"]).select("rep", "id"), "copies")
    firsts = sets.join(copies.where("id <> rep"), "id", "left_anti").select("id", "words", "n", "rare", "busy")
    return set_pairs(firsts), copies


def text_pairs(rows: DataFrame) -> DataFrame:
    """(id_a, id_b) of rows (id, text) whose word sets overlap by 0.7. Every such pair, once."""
    return expanded(*text_classes(rows))


# --- groups ---------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, group): connected components of edges (a, b); the group is its smallest node.

    Rounds of large-star and small-star over tables in the shared folder, until nothing moves;
    a hub's neighbours are never gathered, only their minimum.
    """

    def star(e: DataFrame, larger: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a")) if larger else e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = both.join(least, "u")
        if larger:
            return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(joined.select("u", "m")).where("a <> b").distinct()

    state = persist_table(edges.select("a", "b").where("a <> b").distinct(), "edges")
    mark = None
    while True:
        state = persist_table(star(star(state, True), False), "edges")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    labels = state.groupBy("a").agg(F.min("b").alias("group")).withColumnRenamed("a", "node")
    return labels.unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("group")).distinct())


def _rows(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, sf_dir, "text_dataset").select("id", F.col("normalized_content").alias("text")), load(spark, sf_dir, "image_dataset").select("id", "phash")


def p2_found(spark, sf_dir: str) -> DataFrame:
    texts, images = _rows(spark, sf_dir)
    tag = lambda kind, df: df.select(F.lit(kind).alias("kind"), "id_a", "id_b")
    return tag("text", text_pairs(texts)).unionByName(tag("image", image_pairs(images)))


def groups(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """(id, group_id, links): each row that has a near-copy, the smallest id of its group, and how
    many near-copies it has. Classes of equal rows are never expanded into pairs."""
    pairs, copies = persist_table(pairs, "classpairs"), persist_table(copies, "copies")
    sizes = copies.groupBy("rep").agg(F.count("*").alias("size"))
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    near = both.join(sizes.withColumnRenamed("rep", "other"), "other", "left").groupBy("rep").agg(F.sum(F.coalesce("size", F.lit(1))).alias("near"))
    named = components(pairs).withColumnRenamed("node", "rep")
    classes = near.join(named, "rep").join(sizes, "rep", "full")
    classes = classes.select("rep", F.coalesce("group", "rep").alias("group_id"), (F.coalesce("near", F.lit(0)) + F.coalesce("size", F.lit(1)) - 1).alias("links"))
    rows = copies.unionByName(near.join(sizes, "rep", "left_anti").select("rep", F.col("rep").alias("id")))
    return rows.join(classes, "rep").select("id", "group_id", "links")


def p2_groups(spark, sf_dir: str) -> DataFrame:
    """(kind, id, group_id, links): every row that has a near-copy, its group and its links."""
    texts, images = _rows(spark, sf_dir)
    tag = lambda kind, df: df.select(F.lit(kind).alias("kind"), "id", "group_id", "links")
    return tag("text", groups(*text_classes(texts))).unionByName(tag("image", groups(*image_classes(images))))


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
_PAIRS = r"""
WITH RECURSIVE w AS (SELECT id, list_sort(list_distinct(list_transform(regexp_extract_all(normalized_content, '[\p{L}\p{N}]+'), lambda x: lower(x)))) AS ws FROM text_dataset WHERE normalized_content IS NOT NULL),
s AS (SELECT id, ws, len(ws) AS n FROM w WHERE len(ws) >= 10),
i AS (SELECT id, phash FROM image_dataset WHERE phash <> 0),
found AS (SELECT 'text' AS kind, a.id AS id_a, b.id AS id_b FROM s a JOIN s b ON a.id < b.id AND 10 * least(a.n, b.n) >= 7 * greatest(a.n, b.n)
WHERE 17 * len(list_intersect(a.ws, b.ws)) >= 7 * (a.n + b.n)
UNION ALL
SELECT 'image' AS kind, a.id AS id_a, b.id AS id_b FROM i a JOIN i b ON a.id < b.id AND bit_count(xor(a.phash, b.phash)) <= 8)
"""
ORACLES = {
    "p2_found": _PAIRS + "SELECT * FROM found",
    "p2_groups": _PAIRS
    + """, e AS (SELECT kind, id_a AS a, id_b AS b FROM found UNION ALL SELECT kind, id_b, id_a FROM found),
r(kind, id, x) AS (SELECT DISTINCT kind, a, a FROM e UNION SELECT r.kind, r.id, e.b FROM r JOIN e ON e.kind = r.kind AND e.a = r.x)
SELECT kind, id, min(x) AS group_id, (SELECT count(*) FROM e WHERE e.kind = r.kind AND e.a = r.id) AS links FROM r GROUP BY kind, id""",
}
