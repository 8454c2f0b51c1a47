"""The blocklist: gate keys, the token gate, and matching of many patterns at once.

A blocklist has columns word, category, nsfw_score; ``prepared`` adds ``norm_word`` and drops
words whose normal form is empty, which would match everywhere.

Patterns are found by anchors. An anchor is a piece of 1, 2, 4, ... 32 characters of a pattern, the
one that fewest other patterns hold. A bitmap of all anchors, of fixed size, goes to the workers;
one pass over the texts, in Arrow batches, gives the places whose piece is in the bitmap, and
these meet the patterns in an equi-join and are verified. Neither the driver nor any task ever
holds the list, and texts are scanned once however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardsieve.functions.text import normalize, tokens
from wardsieve.runtime import persist_table

#: Lengths of anchors; a pattern has one of the longest that fits.
PIECES = (1, 2, 4, 8, 16, 32)
#: Places of a pattern among which its anchor is chosen.
CHOICES = 8
#: Bits of the bitmap of anchors, as a power of two.
BITMAP_POWER = 25
_BASE = 0x9E3779B97F4A7C15


def prepared(words: DataFrame) -> DataFrame:
    return words.select("word", "category", F.coalesce("nsfw_score", F.lit(0.0)).alias("nsfw_score"), normalize("word").alias("norm_word")).where("norm_word <> ''")


def gate_keys(blocklist: DataFrame) -> DataFrame:
    """(token): each word's normal form, and those of its tokens if it has several."""
    parts = tokens("word")
    return blocklist.select(F.explode(F.array_union(F.array("norm_word"), F.when(F.size(parts) > 1, F.transform(parts, normalize)).otherwise(F.array().cast("array<string>")))).alias("token")).distinct()


def gate(texts: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``key`` values of texts (key, text) of which some token's normal form is a gate key."""
    words = texts.select(key, F.explode(F.array_distinct(tokens("text"))).alias("token")).select(key, normalize("token").alias("token"))
    return words.join(keys, "token", "left_semi").select(key).distinct()


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, text, position, hash) of every piece of each length of PIECES of some texts."""
    texts = [t or "" for t in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    h, power = points + np.uint64(1), _BASE
    for n in PIECES:
        if n > 1:  # two pieces of half the length make one
            half = n // 2
            h = h[: max(0, len(h) - half)] * np.uint64(power) + h[half:]
            power = power * power & 0xFFFFFFFFFFFFFFFF
        inside = (place + n <= sizes[owner])[: len(h)] if len(h) else np.zeros(0, bool)
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)
        mixed ^= mixed >> np.uint64(32)
        yield n, owner[: len(h)][inside], place[: len(h)][inside], mixed[inside]


def anchors(blocklist: DataFrame) -> DataFrame:
    """(norm_word, piece, at): the anchor of each distinct pattern and where it begins; the piece
    that fewest patterns hold of CHOICES evenly spaced ones, ties by place."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            best = np.array([max(n for n in PIECES if n <= len(w)) for w in words], np.int64)
            step = np.array([max(1, -(-(len(w) - n + 1) // CHOICES)) for w, n in zip(words, best, strict=True)], np.int64)
            for n, owner, place, piece in _pieces(words):
                keep = (best[owner] == n) & (place % step[owner] == 0)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner[keep])), pa.array(piece[keep].view(np.int64)), pa.array(place[keep].astype(np.int32))], ["norm_word", "piece", "at"])

    cuts = blocklist.select("norm_word").distinct().mapInArrow(cut, "norm_word string, piece long, at int")
    shared = cuts.groupBy("piece").agg(F.count("*").alias("n"))
    return cuts.join(shared, "piece").groupBy("norm_word").agg(F.min(F.struct("n", "at", "piece")).alias("a")).select("norm_word", "a.piece", "a.at")


def _bitmap(found: DataFrame) -> np.ndarray:
    """The bits of all anchors, packed: 2^BITMAP_POWER / 8 bytes whatever the list holds."""
    bit = F.shiftrightunsigned("piece", 64 - BITMAP_POWER) + 1  # the bitmap functions count from 1
    parts = found.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros((1 << BITMAP_POWER) // 8, np.uint8)
    for r in parts:
        bits = np.frombuffer(bytes(r.bits), np.uint8)
        at = (r.b - 1) * len(bits)
        out[at : at + len(bits)] = bits[: len(out) - at]
    return out


def search(texts: DataFrame, blocklist: DataFrame, key: str) -> DataFrame:
    """Every overlapping occurrence of every pattern in texts (key, norm): key, word, category,
    nsfw_score, position, end.

    ``end`` is the index of the last matched character, from 0; ``position`` is end minus the
    length of the word as listed plus 1. Equal patterns are all reported. Keys are unique. Both
    tables are read more than once: give scans, not long plans.
    """
    found = persist_table(anchors(blocklist), "anchors")
    bits = texts.sparkSession.sparkContext.broadcast(_bitmap(found))
    texts = texts.select(key, "norm")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = bits.value
        for b in batches:
            for _, owner, place, piece in _pieces(b.column(1).to_pylist()):
                bit = piece >> np.uint64(64 - BITMAP_POWER)
                hit = (have[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
                if hit.any():
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner[hit])), pa.array(piece[hit].view(np.int64)), pa.array(place[hit].astype(np.int32))], [key, "piece", "place"])

    met = texts.mapInArrow(places, f"`{key}` {texts.schema[key].dataType.simpleString()}, piece long, place int").join(found, "piece")
    begun = met.select(key, "norm_word", (F.col("place") - F.col("at")).alias("begin")).where("begin >= 0")
    true = begun.join(texts, key).where(F.substring(F.col("norm"), F.col("begin") + 1, F.length("norm_word")) == F.col("norm_word")).select(key, "norm_word", "begin")
    end = F.col("begin") + F.length("norm_word") - 1
    return true.join(blocklist.select("word", "category", "nsfw_score", "norm_word"), "norm_word").select(key, "word", "category", "nsfw_score", (end - F.length("word") + 1).alias("position"), end.alias("end"))


def contains_any(texts: DataFrame, blocklist: DataFrame, key: str) -> DataFrame:
    """``key`` values of texts (key, norm) that hold any pattern."""
    return search(texts, blocklist.select("norm_word").distinct().select(F.lit("").alias("word"), F.lit("").alias("category"), F.lit(0.0).alias("nsfw_score"), "norm_word"), key).select(key).distinct()


def summary(matches: DataFrame, key: str) -> DataFrame:
    """(key, max_nsfw_score, categories, n_matches): highest score and sorted distinct categories."""
    return matches.groupBy(key).agg(F.max("nsfw_score").alias("max_nsfw_score"), F.array_sort(F.collect_set("category")).alias("categories"), F.count("*").alias("n_matches"))


def threshold(score: Column, reject: float, review: float) -> tuple[Column, Column]:
    """(should_reject, should_review) of a pattern score."""
    return score >= reject, (score < reject) & (score >= review)
