"""Abusive, hateful or sexual content by multiple-instance learning.

A document is a bag of sentences; only the bag has a label. Each sentence has a logistic score,
and the bag's is their noisy-or: 1 - product of (1 - score). The gradient of the bags' likelihood
trains the sentence model, with a share of wrong labels allowed for, so the offending sentences
are found though nobody marked them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardsieve.llm import sentences as S
from wardsieve.llm.fitted import once
from wardsieve.runtime import folded, load, persist_table, spread

#: Labelled documents that the model is fitted on at most (smallest seeded hashes).
LABELLED = 12_000
#: Terms that are broadcast at most; of longer lists each text gets the terms it may hold.
BROADCAST_TERMS = 50_000
#: Labelled documents that a feature must occur in.
LEAST = 3
LISTED = ("insult", "hate", "sexual", "threat")
#: Share of labels taken to be wrong.
WRONG = 0.02
#: Distance of label and first fit beyond which a label is taken to be wrong.
DOUBT = 0.9
#: Score from which a document counts as abusive.
CUT = 0.4
#: Weight of a listed term before any label is seen.
LISTED_WEIGHT = 4.0


@dataclass
class Model:
    terms: dict[str, str]
    features: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -6.0
    words: frozenset = frozenset()

    def __post_init__(self) -> None:
        self._phrases: dict[str, list[tuple[list[str], str]]] = {}
        for t, k in self.terms.items():
            ts = t.split()
            if len(ts) > 1:
                self._phrases.setdefault(ts[0], []).append((ts, f"<{k}>"))
        self._compiled: tuple | None = None

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("terms", "features", "weights", "bias", "words")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def among(self, terms: dict[str, str]) -> Model:
        """The same model with other terms."""
        out = Model(terms, self.features, self.weights, self.bias, self.words)
        out._compiled = self._tables()
        return out

    def known(self, w: str) -> bool:
        return w in self.terms or w in self.words

    def _kind(self, t: str) -> str:
        k = self.terms.get(t) or (self.terms.get(t[:-1]) if t.endswith("s") else None)
        return f"<{k}>" if k else ""

    def _parts(self, sentence: str) -> tuple[set[str], set[tuple[str, str]], set[tuple[str, str]]]:
        """Words and kinds of listed terms; neighbours; words with one between. In pairs a listed
        term stands as its kind, and the sentence has an edge on either side."""
        ts = S.tokens(sentence, self.known)
        marks = [self._kind(t) or t for t in ts]
        single = {*ts, *(m for m, t in zip(marks, ts, strict=True) if m is not t)}
        for i, t in enumerate(ts):
            for phrase, kind in self._phrases.get(t, ()):
                if ts[i : i + len(phrase)] == phrase:
                    single.add(kind)
        return single, {*zip(["<", *marks], [*marks, ">"], strict=True)}, {*zip(marks, marks[2:], strict=False)}

    def names(self, sentence: str) -> list[str]:
        """Features of one sentence by name."""
        single, near, apart = self._parts(sentence)
        return [*single, *(f"{a} {b}" for a, b in near), *(f"{a} * {b}" for a, b in apart)]

    def _tables(self) -> tuple[dict, dict, dict]:
        """Weights by word, and by first and second word of pairs."""
        if self._compiled is None:
            single: dict[str, float] = {}
            near: dict[str, dict[str, float]] = {}
            apart: dict[str, dict[str, float]] = {}
            for f, i in self.features.items():
                w = float(self.weights[i])
                if " * " in f:
                    x, y = f.split(" * ")
                    apart.setdefault(x, {})[y] = w
                elif " " in f:
                    x, y = f.split(" ")
                    near.setdefault(x, {})[y] = w
                else:
                    single[f] = w
            self._compiled = single, near, apart
        return self._compiled

    def sentence_scores(self, text: str) -> list[tuple[str, float]]:
        single, near, apart = self._tables()
        none: dict[str, float] = {}
        out = []
        for s in S.split(text):
            words, pairs, gaps = self._parts(s)
            z = self.bias
            for w in words:
                z += single.get(w, 0.0)
            for x, y in pairs:
                z += near.get(x, none).get(y, 0.0)
            for x, y in gaps:
                z += apart.get(x, none).get(y, 0.0)
            out.append((s, 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))))
        return out

    def score(self, text: str | None) -> tuple[float, str | None, float]:
        """(document score, most offending sentence, its score); 0 without any sentence."""
        scored = self.sentence_scores(text) if text else []
        if not scored:
            return 0.0, None, 0.0
        rest = 1.0
        for _, p in scored:
            rest *= 1 - p
        worst = max(scored, key=lambda x: x[1])
        return 1 - rest, worst[0], worst[1]


def train(texts: list[str], labels: np.ndarray, terms: dict[str, str], *, steps: int = 250, decay: float = 1.0) -> Model:
    """Fit by full-batch Adam on the noisy-or likelihood, then again without the documents whose
    label the first fit contradicts beyond doubt. Without labels of both kinds only listed terms
    count: a sentence that holds one scores 0.5."""
    model = Model(terms)
    words = S.vocabulary((S.tokens(t, model.known) for t in texts), 2)
    model.words = frozenset(words)
    if len(set(labels.tolist())) < 2:
        model.features = {f"<{k}>": i for i, k in enumerate(LISTED)}
        model.weights = np.full(len(LISTED), 6.0)
        return model
    bags = [[model.names(s) for s in S.split(t)] for t in texts]
    model.features = S.vocabulary(([f for s in b for f in s] for b in bags), LEAST)
    kinds = {f"<{k}>" for k in LISTED}
    get = model.features.get
    lists = [np.array([i for f in s if (i := get(f)) is not None], np.int64) for b in bags for s in b]
    bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    rows, y, m = S.Rows(lists, len(model.features)), labels.astype(float), len(bags)
    share = min(max(y.mean(), 1e-3), 0.9)
    per = max(1.0, len(lists) / max(m, 1))
    # without evidence a listed term speaks for abuse; the penalty pulls towards that
    prior = np.array([LISTED_WEIGHT if f in kinds else 0.0 for f in model.features])
    start = np.append(prior, 0.0)
    start[-1] = math.log(share / per / (1 - share / per))

    keep = np.ones(m)

    def outcome(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip(rows.dot(w[:-1]) + w[-1], -30, 30)
        p = 1 / (1 + np.exp(-z))
        return p, np.exp(np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-12)), m))

    def gradient(w: np.ndarray) -> np.ndarray:
        p, none = outcome(w)
        q = WRONG + (1 - 2 * WRONG) * (1 - none)
        slope = (q - y) / (q * (1 - q)) * (1 - 2 * WRONG) * none * keep  # d loss / d log(1/none)
        g = slope[bag] * p / m
        return np.append(rows.tdot(g) + decay / m * (w[:-1] - prior), g.sum())

    w = S.adam(gradient, start, steps=steps, rate=0.08)
    keep = (np.abs(1 - outcome(w)[1] - y) < DOUBT).astype(float)
    w = S.adam(gradient, start, steps=steps, rate=0.08)
    model.weights, model.bias = w[:-1], float(w[-1])
    return model


def listed_terms(words: DataFrame) -> DataFrame:
    """(term, kind) from rows (req_id, word, category): every folded term, with the kind of its
    earliest request."""
    rows = words.select("req_id", "word", folded("category").alias("kind")).where(F.col("kind").isin(*LISTED) & (F.trim("word") != ""))
    first = lambda df, key: df.groupBy(key).agg(F.min(F.struct("req_id", "kind")).alias("first")).select(key, "first.*")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [" ".join(S.fold(w).split()) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), b.column(1), b.column(2)], ["term", "req_id", "kind"])

    return first(first(rows, "word").mapInArrow(fold, "term string, req_id long, kind string").where("term <> ''"), "term").select("term", "kind")


def few_terms(terms: DataFrame) -> dict[str, str] | None:
    """All terms (term, kind) if they are no more than may be broadcast."""
    rows = terms.limit(BROADCAST_TERMS + 1).collect()
    return dict(map(tuple, rows)) if len(rows) <= BROADCAST_TERMS else None


def held_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, term, kind): of each text (key, text) at least the terms it may hold, disguised or not.

    A phrase is met by its longest word.
    """
    key, _ = texts.columns

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                asked = {w for s in S.split(text or "") for w in S.askable(s)}
                asked |= {w[:-1] for w in asked if w.endswith("s")}
                at += [i] * len(asked)
                found += asked
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(found, pa.string())], [key, "word"])

    asked = texts.mapInArrow(ask, f"`{key}` {texts.schema[key].dataType.simpleString()}, word string")
    longest = F.expr("array_max(transform(split(term, ' '), w -> struct(length(w) AS n, w AS w))).w")
    return asked.join(terms.withColumn("word", longest), "word").select(key, "term", "kind")


def fit(texts: DataFrame, reviews: DataFrame, terms: DataFrame) -> Model:
    """Model of texts (id, text), reviews (id, abusive) and terms (term, kind); null labels and
    texts are left out. Of a list too long to be broadcast it has the terms of its own texts."""
    sample = reviews.where("abusive IS NOT NULL").select("id", "abusive").orderBy(F.xxhash64("id"), "id").limit(LABELLED)
    labelled = texts.where("text IS NOT NULL").join(F.broadcast(sample), "id")
    rows = labelled.orderBy("id", "abusive").toPandas()
    known = few_terms(terms)
    if known is None:
        known = dict(map(tuple, held_terms(labelled.select("id", "text"), terms).select("term", "kind").distinct().collect()))
    return train(rows["text"].tolist(), rows["abusive"].to_numpy(), known)


def score(rows: DataFrame, model: Model, terms: DataFrame | None = None) -> DataFrame:
    """``rows`` (key, text; keys unique) with score, worst sentence and its score in place of the
    text. ``terms`` (term, kind) are the list, if the model does not have all of it."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    key, text = rows.columns
    apart = terms is not None
    if apart:
        held = held_terms(rows, terms).groupBy(key).agg(F.collect_set(F.struct("term", "kind")).alias("terms"))
        rows = rows.join(held, key, "left").select(key, text, "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            if apart:
                scored = [model.among({x["term"]: x["kind"] for x in held or ()}).score(t) for t, held in zip(texts, b.column(2).to_pylist(), strict=True)]
            else:
                scored = [model.score(t) for t in texts]
            s, worst, top = zip(*scored, strict=True) if scored else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(worst, pa.string()), pa.array(top, pa.float64())], [key, "score", "sentence", "sentence_score"])

    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, score double, sentence string, sentence_score double")


def _scored(spark, sf_dir: str) -> DataFrame:
    texts = load(spark, sf_dir, "text_dataset").select("id", F.col("normalized_content").alias("text"))
    terms = persist_table(listed_terms(load(spark, sf_dir, "bad_word")), "terms")
    model = once(spark, "abuse", sf_dir, ("text_dataset", "text_review", "bad_word"), lambda: fit(texts, load(spark, sf_dir, "text_review"), terms))
    return score(spread(texts), model, terms if few_terms(terms) is None else None)


def p5_found(spark, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where(F.col("score") >= CUT).select("id")


def p5_scores(spark, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


def p5_rates(spark, sf_dir: str) -> DataFrame:
    """Rows, flagged rows and rate of each source (added_by)."""
    rows = load(spark, sf_dir, "text_dataset").select("id", "added_by").join(_scored(spark, sf_dir), "id")
    flagged = F.sum((F.col("score") >= CUT).cast("long"))
    return rows.groupBy("added_by").agg(F.count("*").alias("n_rows"), flagged.alias("n_flagged"), (flagged / F.count("*")).alias("rate"), F.avg("score").alias("mean_score"))


QUERIES = {"p5_found": p5_found, "p5_scores": p5_scores, "p5_rates": p5_rates}
ORACLES: dict[str, str] = {}
