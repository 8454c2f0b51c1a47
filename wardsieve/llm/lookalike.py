"""One consistent form for strings that look the same.

A character table, built by rule from the Unicode database plus a short list of letters drawn
alike, folds width, mathematical styles, blanks, invisible characters and look-alike letters. Canonically equal
compositions and ignorable characters are left to the grouping itself: classes are formed in
SQL under the accent- and case-sensitive ``UNICODE`` collation. Each class gets one of its
members as canonical form, joined back to every row.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardsieve.runtime import load, persist_table

#: Letters of other scripts and the Latin letters they are drawn like.
ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
    "ο": "o", "ν": "v", "ρ": "p", "α": "a", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    "օ": "o", "ս": "u", "հ": "h", "ց": "g", "ո": "n", "ɡ": "g", "ɑ": "a", "ı": "i", "ꞌ": "'", "Ӏ": "l",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L",
    "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ⲟ": "o", "Ⲟ": "O", "ⲣ": "p", "Ⲣ": "P", "ⲥ": "c", "Ⲥ": "C", "Ⲕ": "K", "Ⲛ": "N", "Ⲙ": "M", "Ⲏ": "H", "Ⲧ": "T", "Ⲭ": "X",
}
#: Hyphens drawn alike.
HYPHENS = "‐‑‒–−˗﹘﹣－⁃"
#: Characters that show nothing beyond the format characters.
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ⠀"
#: Presentation ligatures, which a table of single characters cannot hold.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


@cache
def table() -> tuple[str, str]:
    """Arguments of ``translate``: characters with a counterpart first, then those dropped."""
    keep: dict[str, str] = {h: "-" for h in HYPHENS}
    drop: list[str] = list(INVISIBLE)
    for cp in range(0x20, sys.maxunicode + 1):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind in ("Cs", "Cn", "Co") or c in keep or c in drop:
            continue
        if kind in ("Zs", "Zl", "Zp"):
            if c != " ":
                keep[c] = " "
        elif kind in ("Cf", "Cc") or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
            drop.append(c)
        else:
            d = unicodedata.decomposition(c)
            styled = d.startswith("<font>") and unicodedata.category(c)[0] in "LN"
            to = unicodedata.normalize("NFKC", c) if styled or d.startswith(("<wide>", "<narrow>")) else c
            base = unicodedata.normalize("NFD", to)
            to = unicodedata.normalize("NFC", ALIKE.get(base[0], base[0]) + base[1:])
            if len(to) == 1 and to != unicodedata.normalize("NFC", c):
                keep[c] = to
    for c in "\t\n\r\x0b\x0c\x85":
        keep[c] = " "
    drop = [c for c in drop if c not in keep]
    return "".join(keep) + "".join(drop), "".join(keep.values())


@cache
def _several() -> dict[str, str]:
    """Characters whose folded form has several: ligatures, and letters with marks whose base is
    drawn like a Latin letter that has no such composition."""
    out = dict(LIGATURES)
    for cp in range(0x80, 0x1_0000):
        base = unicodedata.normalize("NFD", chr(cp))
        if len(base) > 1 and base[0] in ALIKE:
            to = unicodedata.normalize("NFC", ALIKE[base[0]] + base[1:])
            if len(to) > 1:
                out[chr(cp)] = to
    return out


def look(col: F.Column | str) -> F.Column:
    """The folded form, before collation. Null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    folded = F.translate(c, *table())
    several = F.create_map(*[F.lit(x) for pair in _several().items() for x in pair])
    spread_ = F.array_join(F.transform(F.split(folded, ""), lambda x: F.coalesce(F.try_element_at(several, x), x)), "")
    return F.when(F.rlike(c, F.lit("[" + "".join(_several()) + "]")), spread_).otherwise(folded)


@cache
def _bases() -> tuple[str, str]:
    """Arguments of ``translate``: letters and numbers with marks, and what they are without."""
    out = []
    for cp in range(0x80, sys.maxunicode + 1):
        c = chr(cp)
        base = unicodedata.normalize("NFD", c)
        if base[0] != c and unicodedata.category(c)[0] in "LN" and not 0xAC00 <= cp < 0xD7A4:
            out.append((c, base[0]))
    return "".join(c for c, _ in out), "".join(b for _, b in out)


#: Letters of Hangul, which compose without marks.
_HANGUL = "\u1100-\u11ff\ua960-\ua97f\uac00-\ud7fb"


def _with_skeleton(rows: DataFrame, form: str) -> DataFrame:
    """``rows`` with sk, a hash that strings equal under the collation share: their ASCII letters and digits, or,
    where they have none, their letters and numbers of other scripts without marks.

    Canonical equivalents differ in marks and precomposed letters only, ignorable characters are
    none of these, so unequal hashes mean unequal classes. The converse is left to the collation.
    """
    rows = rows.withColumn("__bare", F.translate(form, *_bases())).withColumn("__ascii", F.regexp_replace("__bare", "[^A-Za-z0-9]+", ""))
    other = F.regexp_replace("__bare", rf"[^\p{{L}}\p{{N}}]+|[{_HANGUL}]+", "")
    return rows.withColumn("sk", F.xxhash64(F.when(F.col("__ascii") != "", F.col("__ascii")).otherwise(other))).drop("__bare", "__ascii")


def _variants(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct strings (kind, text, form, sk), and the (kind, sk) that several of them share."""
    variants = _with_skeleton(rows.where("text IS NOT NULL").groupBy("kind", "text").agg(F.count("*").alias("n")).withColumn("form", look("text")), "form")
    return variants, variants.groupBy("kind", "sk").agg(F.count("*").alias("m")).where("m > 1").select("kind", "sk")


def _classes(variants: DataFrame) -> DataFrame:
    return variants.sparkSession.sql(
        """
        WITH v AS (SELECT kind, text, collate(form, 'UNICODE') AS form FROM {variants}),
        c AS (SELECT kind, form, min(struct(octet_length(text) AS size, text)).text AS canonical, count(*) AS members FROM v GROUP BY kind, form)
        SELECT v.kind, v.text, c.canonical, c.members FROM v JOIN c ON v.kind = c.kind AND v.form = c.form
        """,
        variants=variants,
    )


def classes(rows: DataFrame) -> DataFrame:
    """(kind, text, canonical, members): every distinct string and its class.

    ``rows``: kind, text. Null strings are left out. The canonical member is the one of fewest
    bytes, ties by code point, so it is a plain spelling where the class has one. Only strings
    that share their skeleton with another are grouped under the collation; all others are
    classes of their own.
    """
    variants, shared = _variants(rows)
    alone = variants.join(shared, ["kind", "sk"], "left_anti").select("kind", "text", F.col("text").alias("canonical"), F.lit(1).cast("long").alias("members"))
    return _classes(variants.join(shared, ["kind", "sk"], "left_semi")).unionByName(alone)


def pairs(rows: DataFrame) -> DataFrame:
    """(kind, key_a, key_b) of rows (kind, key, text) that look the same in different strings.

    Strings are paired first, within classes of several members, and rows joined to the pairs,
    so rows of equal strings never meet. Rows of null or equal key form no pair; repeated rows
    give a pair once.
    """
    variants, shared = _variants(rows)
    grouped = persist_table(_classes(variants.join(shared, ["kind", "sk"], "left_semi")), "lookalikes")
    many = grouped.where("members > 1").select("kind", "text", "canonical")
    a, b = many.withColumnRenamed("text", "ta"), many.withColumnRenamed("text", "tb")
    met = a.join(b, ["kind", "canonical"]).where("ta < tb").select("kind", "ta", "tb")
    left = rows.select("kind", F.col("text").alias("ta"), F.col("key").alias("x"))
    right = rows.select("kind", F.col("text").alias("tb"), F.col("key").alias("y"))
    out = met.join(left, ["kind", "ta"]).join(right, ["kind", "tb"])
    return out.where("x <> y").select("kind", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def _rows(spark, sf_dir: str) -> DataFrame:
    cache_ = load(spark, sf_dir, "text_cache").select(F.lit("text_cache").alias("kind"), F.col("content_hash").alias("key"), F.col("normalized_content").alias("text"))
    words = load(spark, sf_dir, "bad_word").select(F.lit("bad_word").alias("kind"), F.col("req_id").cast("string").alias("key"), F.trim("word").alias("text"))
    return cache_.unionByName(words)


def p3_found(spark, sf_dir: str) -> DataFrame:
    return pairs(_rows(spark, sf_dir))


def p3_forms(spark, sf_dir: str) -> DataFrame:
    """(kind, key, canonical): every row's consistent form; null strings keep a null form."""
    rows = _rows(spark, sf_dir)
    return rows.join(classes(rows).select("kind", "text", "canonical"), ["kind", "text"], "left").select("kind", "key", "canonical")


QUERIES = {"p3_found": p3_found, "p3_forms": p3_forms}
ORACLES: dict[str, str] = {}
