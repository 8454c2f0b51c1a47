"""Sentences, folded tokens and small linear models over them.

Everything here is plain Python and numpy, used inside Arrow batches and for training.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np

from wardsieve.llm.lookalike import table

#: Digits and signs that stand for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
_END = re.compile(r"(?<=[.!?;,。，！？])\s+|(?<=[。，！？])|\s+\.\.\.\s*|\n+")
_MARKS = re.compile(r"[\W_]+")
_RUN = re.compile(r"(.)\1{2,}")
_FROM, _TO = table()
_LOOK = {ord(c): (_TO[i] if i < len(_TO) else None) for i, c in enumerate(_FROM)}
_LEET = str.maketrans(SIGNS)


def split(text: str) -> list[str]:
    """Sentences and comma clauses; a text without marks is one."""
    return [s for s in _END.split(text) if s and not s.isspace()]


def fold(text: str) -> str:
    """Look-alikes, accents, case and stand-in digits folded, as in the service's own form."""
    if not text.isascii():
        text = text.translate(_LOOK)
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn")
    return text.lower().translate(_LEET)


def _raw(sentence: str) -> list[str]:
    return [x if x.isalnum() else y for x in fold(sentence).split() if x.isalnum() or (y := _MARKS.sub("", x))]


def tokens(sentence: str, known: Callable[[str], bool]) -> list[str]:
    """Folded words of a sentence, with disguises undone where that gives a known word.

    Marks inside a word are dropped, letters spelled apart are joined, and letters repeated
    three times or more are squeezed.
    """
    raw = _raw(sentence)
    out: list[str] = []
    i = 0
    while i < len(raw):
        j = i
        while j < len(raw) and len(raw[j]) == 1:
            j += 1
        if j - i >= 3:
            joined = "".join(raw[i:j])
            tail = raw[j] if j < len(raw) and len(raw[j]) <= 3 else ""
            if tail and known(joined + tail):
                out.append(joined + tail)
                j += 1
            elif not known(joined) and known(joined[1:]):
                out += [joined[0], joined[1:]]
            elif tail and not known(joined) and known(joined[1:] + tail):
                out += [joined[0], joined[1:] + tail]
                j += 1
            else:
                out.append(joined)
            i = j
            continue
        w = raw[i]
        if not known(w) and _RUN.search(w):
            for to in (r"\1", r"\1\1"):
                if known(_RUN.sub(to, w)):
                    w = _RUN.sub(to, w)
                    break
        out.append(w)
        i += 1
    return out


def askable(sentence: str) -> set[str]:
    """Every word that ``tokens`` may ask about or give, whatever words are known."""
    raw = _raw(sentence)
    out = set(raw)
    for w in raw:
        if _RUN.search(w):
            out |= {_RUN.sub(r"\1", w), _RUN.sub(r"\1\1", w)}
    i = 0
    while i < len(raw):
        j = i
        while j < len(raw) and len(raw[j]) == 1:
            j += 1
        if j - i >= 3:
            joined = "".join(raw[i:j])
            tail = raw[j] if j < len(raw) and len(raw[j]) <= 3 else ""
            out |= {joined, joined[1:], joined + tail, joined[1:] + tail}
        i = max(j, i + 1)
    return out


class Rows:
    """Sparse 0/1 or weighted rows; documents are runs of rows."""

    def __init__(self, lists: list[np.ndarray], n_features: int, weights: list[np.ndarray] | None = None):
        self.size = np.array([len(x) for x in lists], np.int64)
        self.col = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(lists)), self.size)
        self.val = np.concatenate(weights) if weights else np.ones(len(self.col))
        self.n, self.m = len(lists), n_features

    def dot(self, w: np.ndarray) -> np.ndarray:
        if w.ndim == 1:
            return np.bincount(self.row, w[self.col] * self.val, self.n)
        return np.stack([self.dot(w[:, k]) for k in range(w.shape[1])], 1)

    def tdot(self, g: np.ndarray) -> np.ndarray:
        if g.ndim == 1:
            return np.bincount(self.col, g[self.row] * self.val, self.m)
        return np.stack([self.tdot(g[:, k]) for k in range(g.shape[1])], 1)


def adam(loss_grad: Callable[[np.ndarray], np.ndarray], w: np.ndarray, *, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = loss_grad(w)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def vocabulary(lists: Iterable[Iterable[str]], least: int) -> dict[str, int]:
    """Features of at least ``least`` documents by falling document count; ties by name."""
    counts = Counter(f for x in lists for f in set(x))
    kept = sorted((f for f, n in counts.items() if n >= least), key=lambda f: (-counts[f], f))
    return {f: i for i, f in enumerate(kept)}
