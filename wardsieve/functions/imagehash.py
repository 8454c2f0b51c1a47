"""64-bit perceptual hashes of images: DCT, average and difference hash.

The published algorithms: a DCT hash keeps the signs of the 8x8 lowest frequencies of a 64x64
grey image against their median, an average hash those of an 8x8 image against its mean, a
difference hash those of neighbours in a 9x8 image. Bits run from the top left, first highest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

PHASH, AHASH, DHASH = 0, 1, 2


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma of (h, w), (h, w, 3) or (h, w, 4) pixels in BGR(A) order, as Spark's source decodes."""
    p = pixels.astype(float)
    if p.ndim == 2 or p.shape[2] == 1:
        return p.reshape(p.shape[:2])
    return p[..., 0] * 0.114 + p[..., 1] * 0.587 + p[..., 2] * 0.299


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear resampling at pixel centres."""

    def at(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        low = np.floor(x).astype(int)
        return low, np.minimum(low + 1, m - 1), x - low

    r0, r1, fr = at(height, image.shape[0])
    c0, c1, fc = at(width, image.shape[1])
    rows = image[r0] * (1 - fr)[:, None] + image[r1] * fr[:, None]
    return rows[:, c0] * (1 - fc) + rows[:, c1] * fc


def _dct(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi / n * np.outer(k, k + 0.5))


def _bits(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags.reshape(-1)).tobytes(), "big", signed=True)


def image_hash(pixels: np.ndarray, kind: int = PHASH) -> int:
    """Signed 64-bit hash of decoded pixels."""
    g = grey(pixels)
    if kind == PHASH:
        d = _dct(64)
        low = (d @ resize(g, 64, 64) @ d.T)[:8, :8]
        return _bits(low > np.median(low))
    if kind == AHASH:
        s = resize(g, 8, 8)
        return _bits(s > s.mean())
    if kind == DHASH:
        s = resize(g, 9, 8)
        return _bits(s[:, :-1] < s[:, 1:])
    raise ValueError(f"unknown hash type {kind}")


def image_hash_udf(kind: int = PHASH):
    """Arrow UDF over the struct column of Spark's image source; undecodable images give null."""

    @F.pandas_udf("long")
    def run(images: pd.DataFrame) -> pd.Series:
        def one(h, w, n, data):
            if not data or h <= 0 or w <= 0:
                return None
            return image_hash(np.frombuffer(data, np.uint8).reshape(h, w, n), kind)

        return pd.Series([one(*x) for x in zip(images["height"], images["width"], images["nChannels"], images["data"], strict=True)], dtype="Int64")

    return run
