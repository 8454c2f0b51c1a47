"""Hash, bit and similarity functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

M64 = (1 << 64) - 1


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def is_similar(a: Column | str, b: Column | str, threshold: int) -> Column:
    return hamming(a, b) <= threshold


def similarity_score(a: Column | str, b: Column | str) -> Column:
    """100 for equal hashes, 0 for opposite ones."""
    return (1 - hamming(a, b) / 64.0) * 100.0


def hash_hex(h: Column | str) -> Column:
    """16 hex digits of the bit pattern, negative longs included."""
    return F.lower(F.lpad(F.hex(_col(h)), 16, "0"))


def hash_bytes(h: Column | str) -> Column:
    """8 bytes, big-endian."""
    return F.unhex(F.lpad(F.hex(_col(h)), 16, "0"))


def from_hex(c: Column | str) -> Column:
    """The signed long of up to 16 hex digits."""
    c = F.lpad(_col(c), 16, "0")
    high, low = F.conv(F.substring(c, 1, 8), 16, 10).cast("long"), F.conv(F.substring(c, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def hash_type_name(c: Column | str) -> Column:
    """Names of the image hash types by number."""
    c = _col(c)
    return F.when(c == 0, "pHash").when(c == 1, "aHash").when(c == 2, "dHash").otherwise("unknown")


def resolve_file_hash(given: Column | str, content: Column | str) -> Column:
    """The caller's hash if there is one, else SHA-256 of the bytes."""
    return F.coalesce(F.nullif(_col(given), F.lit("")), F.sha2(_col(content), 256))


def sha_number(c: Column | str, salt: Column | None = None) -> Column:
    """60 bits of SHA-256 as a non-negative long: the shared hash of Bloom filters and rings."""
    c = _col(c).cast("string")
    return F.conv(F.substring(F.sha2(c if salt is None else F.concat(c, salt.cast("string")), 256), 1, 15), 16, 10).cast("long")


def _rotate(x: int, r: int) -> int:
    return (x << r | x >> (64 - r)) & M64


def _mix(k: int) -> int:
    k = (k ^ k >> 33) * 0xFF51AFD7ED558CCD & M64
    k = (k ^ k >> 33) * 0xC4CEB9FE1A85EC53 & M64
    return k ^ k >> 33


def murmur3_64(data: bytes, seed: int = 0) -> int:
    """First 64 bits of MurmurHash3 x64 128, after its published description."""
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    h1 = h2 = seed
    stir1 = lambda k: _rotate(k * c1 & M64, 31) * c2 & M64
    stir2 = lambda k: _rotate(k * c2 & M64, 33) * c1 & M64
    whole = len(data) & ~15
    for i in range(0, whole, 16):
        k1, k2 = int.from_bytes(data[i : i + 8], "little"), int.from_bytes(data[i + 8 : i + 16], "little")
        h1 = (_rotate(h1 ^ stir1(k1), 27) + h2) * 5 + 0x52DCE729 & M64
        h2 = (_rotate(h2 ^ stir2(k2), 31) + h1) * 5 + 0x38495AB5 & M64
    tail = data[whole:]
    h2 ^= stir2(int.from_bytes(tail[8:], "little"))
    h1 ^= stir1(int.from_bytes(tail[:8], "little"))
    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = h1 + h2 & M64
    h2 = h2 + h1 & M64
    h1, h2 = _mix(h1), _mix(h2)
    return h1 + h2 & M64


def murmur3_many(rows: np.ndarray) -> np.ndarray:
    """``murmur3_64`` with seed 0 of every line of a matrix of bytes."""
    u = np.uint64
    n, size = rows.shape
    whole, multiply = size & ~15, lambda a, b: a * u(b)
    turn = lambda x, r: (x << u(r)) | (x >> u(64 - r))
    stir1 = lambda k: multiply(turn(multiply(k, 0x87C37B91114253D5), 31), 0x4CF5AD432745937F)
    stir2 = lambda k: multiply(turn(multiply(k, 0x4CF5AD432745937F), 33), 0x87C37B91114253D5)
    padded = np.zeros((n, whole + 16), np.uint8)
    padded[:, :size] = rows
    words = padded.view("<u8")
    h1, h2 = np.zeros(n, u), np.zeros(n, u)
    for i in range(0, whole // 8, 2):
        h1 = (turn(h1 ^ stir1(words[:, i]), 27) + h2) * u(5) + u(0x52DCE729)
        h2 = (turn(h2 ^ stir2(words[:, i + 1]), 31) + h1) * u(5) + u(0x38495AB5)
    h2 ^= stir2(words[:, whole // 8 + 1])
    h1 ^= stir1(words[:, whole // 8])
    h1, h2 = h1 ^ u(size), h2 ^ u(size)
    h1 = h1 + h2
    h2 = h2 + h1
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h1, h2 = (multiply(h ^ (h >> u(33)), c) for h in (h1, h2))
    return (h1 ^ (h1 >> u(33))) + (h2 ^ (h2 >> u(33)))


@F.pandas_udf(T.LongType())
def murmur3(s: pd.Series) -> pd.Series:
    """Bit-exact 64-bit MurmurHash3 of UTF-8 strings, as a signed long; strings of one length
    are hashed together."""
    raw = [None if t is None else t.encode() for t in s.astype(object).where(s.notna(), None)]
    out = pd.Series(pd.NA, index=range(len(raw)), dtype="Int64")
    by: dict[int, list[int]] = {}
    for i, b in enumerate(raw):
        if b is not None:
            by.setdefault(len(b), []).append(i)
    for size, at in by.items():
        rows = np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), size)
        out.iloc[at] = murmur3_many(rows).view(np.int64)
    return out


def softmax(logits: Column | str) -> Column:
    """Probabilities of an array of logits."""
    logits = F.transform(_col(logits), lambda v: v.cast("double"))
    top = F.array_max(logits)
    e = F.transform(logits, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x))


def image_label(logits: Column | str, labels: list[str]) -> Column:
    """IMAGE_SCORE struct of a classifier's logits.

    ``is_nsfw`` is whether the largest belongs to 'nsfw'; the scores are those of the first
    label with and the first without that word.
    """
    p = softmax(logits)
    best = F.array_position(p, F.array_max(p)).cast("int")
    label = F.element_at(F.array(*map(F.lit, labels)), best)
    bad = next((i for i, x in enumerate(labels) if "nsfw" in x.lower()), None)
    good = next((i for i, x in enumerate(labels) if "nsfw" not in x.lower()), None)
    at = lambda i: F.lit(0.0) if i is None else F.get(p, F.lit(i))
    return F.struct((label == "nsfw").alias("is_nsfw"), at(bad).alias("nsfw_score"), at(good).alias("normal_score"), label.alias("label"), F.array_max(p).alias("confidence"))
