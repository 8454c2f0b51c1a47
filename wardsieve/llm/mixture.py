"""Mixing sources to target shares of tokens by fitting budgets to exact document lengths.

Documents are counted by exact token length. A source gives whole copies of itself while its
budget allows; what remains is a subset-sum problem over its lengths with their counts: a
proportional part is taken from every length, and a bounded-knapsack program closes the rest,
over as wide a part of the budget as it takes to come as near as any selection can.
Documents are then drawn by seed to the counts of each length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardsieve.llm.lexicon import documents_lexicon, token_counts
from wardsieve.llm.quota import take_by_hash
from wardsieve.runtime import load, persist_table, spread

#: Tokens that the exact program closes at first; it takes more wherever these don't suffice.
WINDOW = 8_192


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length give the largest sum that ``budget`` allows.

    Reachable sums are bits of an integer; counts are split into powers of two.
    """
    items: list[tuple[int, int]] = []
    for i, (size, n) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        n, k = min(n, budget // size) if size else 0, 1
        while n > 0:
            items.append((i, min(k, n)))
            n -= k
            k *= 2
    full, reach = (1 << (budget + 1)) - 1, [1]
    for i, k in items:
        reach.append(reach[-1] | (reach[-1] << (int(lengths[i]) * k)) & full)
    took = np.zeros(len(lengths), np.int64)
    left = reach[-1].bit_length() - 1
    for (i, k), before in zip(reversed(items), reversed(reach[:-1]), strict=True):
        if not before >> left & 1:
            took[i] += k
            left -= int(lengths[i]) * k
    return took


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Counts of each length whose sum comes as near to ``budget`` from below as is possible.

    No sum of lengths is nearer than the largest multiple of their common factor. A proportional
    part is taken first and the exact program closes a window of WINDOW tokens; if it does not
    reach that bound, the window grows fourfold, in the end to the whole budget, where what the
    program finds is the best there is.
    """
    size = int((lengths * counts).sum())
    if budget >= size:
        return counts.copy()
    open_ = (lengths > 0) & (counts > 0)
    factor = int(np.gcd.reduce(lengths[open_])) if open_.any() else 1
    lengths, budget, size = lengths // factor, budget // factor, size // factor
    window = WINDOW
    while True:
        took = np.floor(counts * (max(0, budget - window) / size)).astype(np.int64)
        left = budget - int((lengths * took).sum())
        while True:  # long runs of short documents may still be open
            room = np.where((lengths > 0) & (lengths <= left - window), counts - took, 0)
            i = int(np.argmax(room * lengths))
            if room[i] <= 0:
                break
            more = min(int(room[i]), (left - window) // int(lengths[i]))
            took[i] += more
            left -= more * int(lengths[i])
        took = took + knapsack(lengths, counts - took, left)
        if window >= budget or int((lengths * took).sum()) == budget:
            return took
        window = min(budget, 4 * window)


_PLAN = "source string, target_share double, max_repeat int, source_tokens long, all_tokens long, full_copies int, n_tokens long, take long"


def plan(sizes: DataFrame, weights: DataFrame) -> DataFrame:
    """One row for each source and token length: how often all, and how many more.

    ``sizes``: source, n_tokens. ``weights``: source, target_share, max_repeat. Sources are
    compared exactly; a null source belongs to no weight but counts in the total. A weight
    without documents gives one row of null length. Only distinct lengths are gathered, one
    source a task.
    """
    hist = persist_table(sizes.groupBy("source", "n_tokens").agg(F.count("*").alias("n")), "lengths")
    total = hist.agg(F.sum(F.col("n") * F.col("n_tokens"))).first()[0] or 0
    asked = weights.select("source", F.coalesce("target_share", F.lit(0.0)).cast("double").alias("target_share"), F.coalesce("max_repeat", F.lit(0)).cast("int").alias("max_repeat"))
    rows = asked.join(hist, "source", "left").withColumn("all_tokens", F.lit(total).cast("long"))

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_tokens").reset_index(drop=True)
        share, repeat, everything = float(pdf["target_share"].iloc[0]), int(pdf["max_repeat"].iloc[0]), int(pdf["all_tokens"].iloc[0])
        lengths, counts = pdf["n_tokens"].fillna(0).to_numpy(np.int64), pdf["n"].fillna(0).to_numpy(np.int64)
        size, budget = int((lengths * counts).sum()), int(share * everything)
        copies = min(repeat, budget // size) if size else 0
        take = fit(lengths, counts, budget - copies * size) if copies < repeat and size else np.zeros(len(pdf), np.int64)
        return pd.DataFrame({"source": pdf["source"], "target_share": share, "max_repeat": repeat, "source_tokens": size, "all_tokens": everything, "full_copies": copies, "n_tokens": pdf["n_tokens"].astype("Int64"), "take": take})

    return rows.groupBy("source").applyInPandas(of, _PLAN)


def shares(planned: DataFrame) -> DataFrame:
    """Reached tokens and shares by source, and what is missing of the target.

    ``short`` marks sources whose fitted mix stays below the target though every document is
    taken max_repeat times.
    """
    by = planned.groupBy("source").agg(
        *[F.first(c).alias(c) for c in ("target_share", "max_repeat", "source_tokens", "all_tokens", "full_copies")], F.coalesce(F.sum(F.col("take") * F.col("n_tokens")), F.lit(0)).alias("extra_tokens")
    )
    by = by.withColumn("mix_tokens", F.col("full_copies") * F.col("source_tokens") + F.col("extra_tokens"))
    total = F.sum("mix_tokens").over(Window.partitionBy())  # one row a source
    target = F.col("target_share") * F.col("all_tokens")
    return by.withColumn("mix_total", total).select(
        "source", "target_share", target.alias("target_tokens"), "source_tokens", "max_repeat", "mix_tokens", F.when(F.col("mix_total") > 0, F.col("mix_tokens") / F.col("mix_total")).alias("mix_share"), (target - F.col("mix_tokens")).alias("missing_tokens"), (((F.col("full_copies") == F.col("max_repeat")) | (F.col("source_tokens") == 0)) & (F.col("mix_tokens") < target)).alias("short")
    )


def mix(sizes: DataFrame, planned: DataFrame, key: str, *, seed: int = 1) -> DataFrame:
    """(key, source, n_tokens, copies): every document of the mix and how often it occurs."""
    whole = planned.where("full_copies > 0").groupBy("source").agg(F.first("full_copies").alias("copies"))
    copies = sizes.join(F.broadcast(whole), "source").select(key, "source", "n_tokens", "copies")
    more = take_by_hash(sizes, planned.select("source", "n_tokens", "take"), ["source", "n_tokens"], key, seed=seed).select(key, "source", "n_tokens", F.lit(1).alias("copies"))
    return copies.unionByName(more).groupBy(key).agg(F.first("source").alias("source"), F.first("n_tokens").alias("n_tokens"), F.sum("copies").alias("copies"))


def _sizes(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return persist_table(token_counts(spread(docs), "doc_id", "text", documents_lexicon(spark, sf_dir)), "sizes")


def p9_found(spark, sf_dir: str) -> DataFrame:
    return shares(plan(_sizes(spark, sf_dir), load(spark, sf_dir, "source_weight"))).where("short").select("source")


def p9_shares(spark, sf_dir: str) -> DataFrame:
    return shares(plan(_sizes(spark, sf_dir), load(spark, sf_dir, "source_weight")))


def p9_mix(spark, sf_dir: str) -> DataFrame:
    sizes = _sizes(spark, sf_dir)
    return mix(sizes, persist_table(plan(sizes, load(spark, sf_dir, "source_weight")), "mixplan"), "doc_id")


QUERIES = {"p9_found": p9_found, "p9_shares": p9_shares, "p9_mix": p9_mix}
ORACLES: dict[str, str] = {}
