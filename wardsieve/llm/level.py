"""Reading level of documents from the levels of their sentences.

Every sentence is classified by a regularised softmax model over its words and the character
trigrams of its words, trained on sentences that carry their document's grade. A document is
described by the distribution of its sentence levels, and a second small softmax model turns
that into calibrated probabilities of the whole text; it is fitted on sentence scores from
models that did not see the document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardsieve.llm import sentences as S
from wardsieve.llm.fitted import once
from wardsieve.runtime import load, spread

LEVELS = ("basic", "intermediate", "advanced")
#: Graded documents that the models are fitted on at most (smallest seeded hashes), with all
#: their sentences.
GRADED = 6_000
#: Sentences that a feature must occur in.
LEAST = 3
MIN_WORDS = 40
#: Words after which a sentence without any mark is cut.
LONG = 30
#: Documents whose sentences are scored together.
DOCUMENTS_AT_ONCE = 200
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_CLAUSE = re.compile(r"(?<=[.!?])\s+|\n+")


def pieces(text: str) -> list[list[str]]:
    """Words of each sentence; texts without marks are cut into runs of equal size."""
    out = []
    for s in _CLAUSE.split(text):
        ws = [w.lower() for w in _WORD.findall(s)]
        if not ws:
            continue
        n = -(-len(ws) // LONG)
        size = -(-len(ws) // n)
        out += [ws[i : i + size] for i in range(0, len(ws), size)]
    return out


def _grams(w: str) -> list[str]:
    w = f"^{w}$"
    return [f"#{w[i : i + 3]}" for i in range(len(w) - 2)]


@dataclass
class Model:
    features: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, len(LEVELS))))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(len(LEVELS)))
    top: np.ndarray = field(default_factory=lambda: np.zeros((1, len(LEVELS))))

    def __post_init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self._places: dict[str, int] = {}
        self._vectors = np.zeros((1024, len(LEVELS)))

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("features", "weights", "bias", "top")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def _place(self, w: str) -> int:
        """Row of a word's summed weights: its own and the mean of its trigrams'. Computed once
        a word; the table starts anew when it has grown large."""
        at = self._places.get(w)
        if at is None:
            at = self._places[w] = len(self._places)
            if at >= len(self._vectors):
                self._vectors = np.vstack([self._vectors, np.zeros_like(self._vectors)])
            for i, x in _word_features(w, self.features):
                self._vectors[at] += x * self.weights[i]
        return at

    def sentence_levels(self, sentences: list[list[str]]) -> np.ndarray:
        if len(self._places) > 300_000:
            self._forget()
        rows = [self._place(w) for ws in sentences for w in ws]
        n = np.array([len(ws) for ws in sentences])
        z = np.add.reduceat(self._vectors[rows], np.cumsum(n) - n) / np.sqrt(n)[:, None] + self.bias
        return _softmax(z)

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities of the levels, one row a text; NaN for texts without a word."""
        out = np.full((len(texts), len(LEVELS)), np.nan)
        for low in range(0, len(texts), DOCUMENTS_AT_ONCE):
            docs = [pieces(t) if t else [] for t in texts[low : low + DOCUMENTS_AT_ONCE]]
            some = [i for i, d in enumerate(docs) if d]
            if some:
                sentences = [s for i in some for s in docs[i]]
                x = _profiles(self.sentence_levels(sentences), [len(s) for s in sentences], [len(docs[i]) for i in some])
                out[low + np.array(some)] = _softmax(x @ self.top)
        return out


def _word_features(w: str, features: dict[str, int]) -> list[tuple[int, float]]:
    out = [(i, 1.0)] if (i := features.get(w)) is not None else []
    grams = _grams(w)
    return out + [(i, 1.0 / len(grams)) for g in grams if (i := features.get(g)) is not None]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _profiles(p: np.ndarray, words: list[int], sentences: list[int]) -> np.ndarray:
    """Descriptions of documents, given as runs of sentences: mean levels by sentence and by
    word, and shares of each level by both."""
    n = np.array(words, float)[:, None]
    hard = np.eye(len(LEVELS))[p.argmax(1)]
    count = np.array(sentences, float)[:, None]
    starts = np.cumsum(sentences) - sentences
    sums = np.add.reduceat(np.hstack([p, p * n, hard, hard * n, n]), starts)
    k, total = len(LEVELS), sums[:, -1:]
    return np.hstack([sums[:, :k] / count, sums[:, k : 2 * k] / total, sums[:, 2 * k : 3 * k] / count, sums[:, 3 * k : 4 * k] / total, np.ones_like(count)])


def _fit_sentences(docs: list[list[list[str]]], y: np.ndarray, steps: int = 150) -> Model:
    """Softmax over words and trigrams. A wrong grade or a stray sentence is one of many, so the
    penalty keeps single sentences from being learnt by heart."""
    rows = [(s, c) for d, c in zip(docs, y, strict=True) for s in d]
    model = Model()
    number: dict[str, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in s], np.int64) for s, _ in rows]
    grams = [_grams(w) for w in number]
    counts: Counter[str] = Counter()
    for w, n in zip(number, np.bincount(np.concatenate([np.unique(i) for i in ids]), minlength=len(number)).tolist(), strict=True):
        counts[w] += n
        for g in set(grams[number[w]]):
            counts[g] += n
    model.features = {f: i for i, f in enumerate(sorted((f for f, n in counts.items() if n >= LEAST), key=lambda f: (-counts[f], f)))}
    # sentences over words, and words over features: the same product with far fewer entries
    parts = [_word_features(w, model.features) for w in number]
    words = S.Rows([np.array([i for i, _ in p], np.int64) for p in parts], len(model.features), [np.array([x for _, x in p], float) for p in parts])
    data = S.Rows(ids, len(number), [np.full(len(i), len(i) ** -0.5) for i in ids])
    target = np.eye(len(LEVELS))[[c for _, c in rows]]

    def gradient(w: np.ndarray) -> np.ndarray:
        g = (_softmax(data.dot(words.dot(w[:-1])) + w[-1]) - target) / data.n
        return np.vstack([words.tdot(data.tdot(g)) + 2.0 / data.n * w[:-1], g.sum(0)])

    w = S.adam(gradient, np.zeros((words.m + 1, len(LEVELS))), steps=steps, rate=0.05)
    model.weights, model.bias = w[:-1], w[-1]
    return model


def train(texts: list[str], grades: np.ndarray) -> Model:
    """``grades``: indexes into LEVELS. With no graded text every document is intermediate."""
    docs = [pieces(t) for t in texts]
    some = [i for i, d in enumerate(docs) if d]
    docs, y = [docs[i] for i in some], grades[some]
    if not docs:
        model = Model(top=np.zeros((4 * len(LEVELS) + 1, len(LEVELS))))
        model.top[-1, 1] = 5.0
        return model
    fold = np.arange(len(docs)) % 2
    profiles = np.zeros((len(docs), 4 * len(LEVELS) + 1))
    for f in (0, 1):
        inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        part = _fit_sentences([docs[i] for i in inside], y[inside]) if len(inside) else Model()
        if len(outside):
            held = [s for i in outside for s in docs[i]]
            profiles[outside] = _profiles(part.sentence_levels(held), [len(s) for s in held], [len(docs[i]) for i in outside])
    target = np.eye(len(LEVELS))[y]

    def gradient(w: np.ndarray) -> np.ndarray:
        return profiles.T @ (_softmax(profiles @ w) - target) / len(docs) + 0.3 / len(docs) * w

    model = _fit_sentences(docs, y)
    model.top = S.adam(gradient, np.zeros((profiles.shape[1], len(LEVELS))), steps=600, rate=0.1)
    return model


def fit(docs: DataFrame, grades: DataFrame) -> Model:
    """From docs (doc_id, text) and grades (doc_id, reading_level); other grades and null texts
    are left out."""
    known = grades.where(F.col("reading_level").isin(*LEVELS)).select("doc_id", "reading_level")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "reading_level").limit(GRADED)
    rows = docs.where("text IS NOT NULL").join(F.broadcast(sample), "doc_id").orderBy("doc_id", "reading_level").toPandas()
    return train(rows["text"].tolist(), np.array([LEVELS.index(x) for x in rows["reading_level"]], np.int64))


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with p_basic, p_intermediate, p_advanced and reading_level instead of ``text``.

    Texts without a word have nulls in all four.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"p_{x} double" for x in LEVELS), "reading_level string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            p = model.documents(b.column(len(keep)).to_pylist())
            names = [LEVELS[int(x.argmax())] if x[0] == x[0] else None for x in p]
            columns = [*b.columns[: len(keep)], *(pa.array(p[:, k], mask=np.isnan(p[:, k])) for k in range(len(LEVELS))), pa.array(names, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *(f"p_{x}" for x in LEVELS), "reading_level"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def n_words() -> F.Column:
    """Words of a text for the size rule: runs of anything but space, tab, CR and LF."""
    return F.size(F.filter(F.split("text", "[ \t\r\n]+"), lambda w: w != ""))


def _model(spark, sf_dir: str) -> Model:
    make = lambda: fit(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "doc_level"))
    return once(spark, "level", sf_dir, ("documents", "doc_level"), make)


def _graded(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = _model(spark, sf_dir)
    rows = docs.select("doc_id", "source", "lang", n_words().alias("n_words"), "text")
    return grade(spread(rows), model)


def p10_found(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = _model(spark, sf_dir)
    rows = spread(docs.select("doc_id", "lang", "text")).where("lang = 'en'").where(n_words() >= MIN_WORDS).select("doc_id", "text")
    return grade(rows, model).where("reading_level <> 'intermediate'").select("doc_id", "reading_level")


def p10_levels(spark, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir)


def p10_profile(spark, sf_dir: str) -> DataFrame:
    """Documents, words and mean probabilities of all documents by source, language and level."""
    return _graded(spark, sf_dir).groupBy("source", "lang", "reading_level").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"), *[F.avg(f"p_{x}").alias(f"mean_{x}") for x in LEVELS])


QUERIES = {"p10_found": p10_found, "p10_levels": p10_levels, "p10_profile": p10_profile}
ORACLES: dict[str, str] = {}
