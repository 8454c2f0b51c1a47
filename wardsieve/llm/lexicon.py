"""Corpus encoding by a public byte-level BPE tokenizer.

Frequent words are compiled into a minimal acyclic transducer: an automaton over bytes whose
equal suffixes are shared and whose arcs carry numbers that sum to the word's index, which
leads to its ids. It is one file of flat arrays in the shared folder, memory-mapped by every
worker. Words that are not in it are merged exactly by the tokenizer's ranks, so the lexicon
decides only the speed.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardsieve.llm.fitted import once
from wardsieve.runtime import load, shared_path, spread, write_file

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The published split of texts into words of this tokenizer.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most frequent words that are compiled, and the longest such word in bytes.
LEXICON_WORDS = 50_000
LONGEST = 24


# --- building -------------------------------------------------------------------------------


def minimal_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """Arrays of the minimal acyclic automaton of sorted distinct words.

    An arc is the key state*256+byte with a target and a number; the numbers along a word sum
    to its position in ``words``. State 0 is the start.
    """
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []  # (state, byte) of the last word, not yet shared

    def share(down_to: int) -> None:
        while len(path) > down_to:
            state, byte = path.pop()
            child = arcs[state][byte]
            known = register.setdefault((final[child], tuple(sorted(arcs[child].items()))), child)
            arcs[state][byte] = known

    last = b""
    for word in words:
        k = 0
        while k < min(len(word), len(last)) and word[k] == last[k]:
            k += 1
        share(k)
        state = arcs[path[-1][0]][path[-1][1]] if path else 0
        for byte in word[k:]:
            arcs.append({})
            final.append(False)
            arcs[state][byte] = len(arcs) - 1
            path.append((state, byte))
            state = len(arcs) - 1
        final[state] = True
        last = word
    share(0)

    order = [0]  # reachable states, parents before children
    number = {0: 0}
    for s in order:
        for t in arcs[s].values():
            if t not in number:
                number[t] = len(order)
                order.append(t)
    below: dict[int, int] = {}
    stack = [0]
    while stack:
        s = stack[-1]
        open_ = [t for t in arcs[s].values() if t not in below]
        if open_:
            stack.extend(open_)
        else:
            below[s] = final[s] + sum(below[t] for t in arcs[s].values())
            stack.pop()
    keys, targets, outs = [], [], []
    for s in order:
        before = int(final[s])
        for byte in sorted(arcs[s]):
            t = arcs[s][byte]
            keys.append(number[s] * 256 + byte)
            targets.append(number[t])
            outs.append(before)
            before += below[t]
    at = np.argsort(np.array(keys, np.int64), kind="stable")
    return {
        "keys": np.array(keys, np.int64)[at],
        "targets": np.array(targets, np.int32)[at],
        "outs": np.array(outs, np.int32)[at],
        "final": np.array([final[s] for s in order], np.uint8),
    }


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """One file: a line of JSON (padded to 64 bytes), then the arrays, 64-byte aligned."""
    at, spec = 0, {}
    for k, a in arrays.items():
        spec[k] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(spec).encode()
    head += b" " * (-(len(head) + 1) % 64) + b"\n"
    return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 64) for a in arrays.values())


def unpack(path: str) -> dict[str, np.ndarray]:
    with open(path, "rb") as f:
        head = f.readline()
    return {k: np.memmap(path, dtype, "r", len(head) + at, (n,)) if n else np.zeros(0, dtype) for k, (dtype, n, at) in json.loads(head).items()}


# --- exact merging --------------------------------------------------------------------------


class Merger:
    """Byte-pair merging by rank."""

    def __init__(self, folder: str = TOKENIZERS):
        with open(os.path.join(folder, VOCABULARY), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    def __call__(self, word: bytes) -> list[int]:
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        return self._short(word) if len(word) <= 64 else self._long(word)

    def _short(self, word: bytes) -> list[int]:
        get, parts = self.ranks.get, [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = min((get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _long(self, word: bytes) -> list[int]:
        """The same by a heap of candidate pairs: n log n, for words of any length."""
        n = len(word)
        part = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                pair = part[i] + part[after[i]]
                if (r := self.ranks.get(pair)) is not None:
                    heapq.heappush(heap, (r, i, len(pair)))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, size = heapq.heappop(heap)
            j = after[i] if part[i] else n
            if j >= n or len(part[i]) + len(part[j]) != size or self.ranks.get(part[i] + part[j]) != r:
                continue
            part[i], part[j] = part[i] + part[j], b""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return [self.ranks[p] for p in part if p]


# --- encoding -------------------------------------------------------------------------------


class Encoder:
    def __init__(self, path: str, folder: str = TOKENIZERS):
        a = unpack(path)
        self.keys, self.targets, self.outs, self.final = a["keys"], a["targets"], a["outs"], a["final"]
        self.starts, self.ids = a["starts"], a["ids"]
        self.merge = Merger(folder)
        self.words = regex.compile(WORD).findall

    def indexes(self, words: list[bytes]) -> np.ndarray:
        """Each word's index in the lexicon, or -1: one pass over all words, byte by byte."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        state, index = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        alive = (size <= LONGEST) & (len(self.keys) > 0)
        starts = np.cumsum(size) - size
        text = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        live = np.flatnonzero(alive)
        for k in range(LONGEST):
            live = live[size[live] > k]
            if not len(live):
                break
            want = state[live] * 256 + text[starts[live] + k]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[at] == want
            alive[live[~hit]] = False
            live, at = live[hit], at[hit]
            state[live] = self.targets[at]
            index[live] += self.outs[at]
        alive[alive] = self.final[state[alive]] == 1 if alive.any() else False
        return np.where(alive, index, -1)

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts; null and empty texts have no ids."""
        found = [self.words(t) if t else [] for t in texts]
        ends = np.cumsum([0, *map(len, found)])
        number: dict[str, int] = {}
        flat = np.fromiter((number.setdefault(w, len(number)) for ws in found for w in ws), np.int64, int(ends[-1]))
        if not number:
            return np.zeros(len(ends), np.int32), np.zeros(0, np.int32)
        raw = [w.encode() for w in number]
        index = self.indexes(raw)
        rest = np.flatnonzero(index < 0)
        merged = [self.merge(raw[i]) for i in rest.tolist()]
        sizes = np.zeros(len(raw), np.int64)
        begin = np.zeros(len(raw), np.int64)
        known = index >= 0
        begin[known] = self.starts[index[known]]
        sizes[known] = self.starts[index[known] + 1] - begin[known]
        sizes[rest] = [len(m) for m in merged]
        begin[rest] = len(self.ids) + np.cumsum(sizes[rest]) - sizes[rest]
        pool = np.concatenate([self.ids, np.array([i for m in merged for i in m], np.int32)])
        per_word = sizes[flat]
        upto = np.cumsum(per_word)
        total = int(upto[-1]) if len(upto) else 0
        take = np.arange(total) - np.repeat(upto - per_word, per_word) + np.repeat(begin[flat], per_word)
        offsets = np.concatenate([[0], upto])[ends].astype(np.int32)
        return offsets, pool[take].astype(np.int32)


class Published:
    """A file in the shared folder that workers map.

    Under a ``file:`` folder (mounted on every machine) it is mapped where it lies; from any
    other file system Spark's file distribution brings a copy to each executor.
    """

    def __init__(self, spark: SparkSession, name: str, content: bytes):
        jvm, uri = spark._jvm, shared_path(spark, name)
        path = jvm.org.apache.hadoop.fs.Path(uri)
        write_file(spark, uri, content)
        local = path.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file"
        self.local = path.toUri().getPath() if local else ""
        self.name = path.getName()
        if not self.local:
            spark.sparkContext.addFile(uri)

    def path(self) -> str:
        return self.local or SparkFiles.get(self.name)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(file: Published, folder: str) -> Encoder:
    """One encoder a worker process, kept across batches and tasks."""
    path = file.path()
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path, folder)
    return _ENCODERS[path]


def compile_lexicon(texts: DataFrame, *, words: int = LEXICON_WORDS, folder: str = TOKENIZERS) -> Published:
    """Count the words of all texts (one column, ``text``), compile the most frequent ones.

    The count runs in the JVM with partial aggregation; only the ``words`` largest counts come
    to the driver. An empty corpus gives an empty lexicon.
    """
    pieces = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"), F.lit(0))).alias("word"))
    counts = pieces.groupBy("word").agg(F.count("*").alias("n")).where(f"n > 1 AND octet_length(word) <= {LONGEST}")
    top = counts.orderBy(F.desc("n"), "word").limit(words).toPandas()
    merge = Merger(folder)
    listed = sorted(w.encode() for w in top["word"])
    ids = [merge(w) for w in listed]
    arrays = minimal_automaton(listed)
    arrays["starts"] = np.cumsum([0, *map(len, ids)]).astype(np.int64)
    arrays["ids"] = np.array([i for x in ids for i in x], np.int32)
    return Published(texts.sparkSession, "lexicon", pack(arrays))


def encode(docs: DataFrame, key: str, text: str, lexicon: Published, *, folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids): the ids of each text. Null and empty texts give an empty list."""
    schema = T.StructType([docs.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(lexicon, folder)
        for b in batches:
            offsets, ids = encoder.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, schema)


def token_counts(docs: DataFrame, key: str, text: str, lexicon: Published, *, folder: str = TOKENIZERS) -> DataFrame:
    """``key``, further columns of ``docs`` but the text, and ``n_tokens`` (long)."""
    keep = [c for c in docs.columns if c != text]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("n_tokens", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(lexicon, folder)
        for b in batches:
            offsets, _ = encoder.encode(b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(np.diff(offsets).astype(np.int64))], [*keep, "n_tokens"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def documents_lexicon(spark, sf_dir: str) -> Published:
    """The lexicon of documents, which p8 and p9 share."""
    return once(spark, "lexicon", sf_dir, ("documents",), lambda: compile_lexicon(load(spark, sf_dir, "documents").select("text")))


def p8_ids(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(spread(docs), "doc_id", "text", documents_lexicon(spark, sf_dir))


QUERIES = {"p8_ids": p8_ids}
ORACLES: dict[str, str] = {}
