"""Samples whose categories have given shares: calibrated probabilities, pivotal drawing.

Units of a kind fall into cells by category and by who added them (the service itself, or
people). A unit of cell (c, s) starts with d = n/N and gets d*exp(lambda_c + mu_s). The dual of
this exponential tilting is solved by Newton's method with its full Hessian, whose blocks couple
categories and sources: expected counts meet the categories' targets, and sources keep their
share as far as the categories leave it open (a ridge on mu). Cells whose probability would pass
1 are fixed there and the others are solved again. The dual needs only the counts by cell, which
one distributed aggregation gives.

The pivotal method then draws: units meet in pairs, and each meeting settles one of them while
keeping the sum of probabilities, so realized counts of categories equal expected ones.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardsieve.runtime import folded, load, persist_table

SAMPLE_SHARE = 0.2
#: Units that one task of the drawing holds.
CHUNK = 20_000
EPS = 1e-7


def tilt(cells: np.ndarray, wanted: np.ndarray, base: float, *, ridge: float = 1e-3, steps: int = 100) -> np.ndarray:
    """Probability of a unit of each cell.

    ``cells``: units by category (rows) and source; ``wanted``: expected sample by category;
    ``base``: the probability before calibration. Categories without units, or wanted beyond
    their units, end at probability 1; those wanted not at all at 0.
    """
    k, m = cells.shape
    have = cells.sum(1)
    pi = np.where(wanted[:, None] > 0, 1.0, 0.0) * np.ones((k, m))
    free = ((have > 0) & (wanted > 0) & (wanted < have))[:, None] & (cells > 0)
    total = np.minimum(wanted, have)[wanted > 0].sum()
    share = cells.sum(0) / max(cells.sum(), 1.0)
    while free.any():
        rows, fixed = free.any(1), np.where(free, 0.0, cells * pi)
        goal = np.concatenate([np.maximum(wanted - fixed.sum(1), 0.0)[rows], share * total - np.where(wanted[:, None] > 0, fixed, 0.0).sum(0)])
        units, z = np.where(free, cells, 0.0)[rows], np.zeros(rows.sum() + m)
        n = len(z) - m
        soft = np.concatenate([np.zeros(n), np.full(m, ridge * max(total, 1.0))])

        def expected(z: np.ndarray) -> np.ndarray:
            return units * base * np.exp(np.clip(z[:n, None] + z[None, n:], -50, 50))  # noqa: B023

        for _ in range(steps):
            e = expected(z)
            gradient = np.concatenate([e.sum(1), e.sum(0)]) - goal + soft * z
            hessian = np.block([[np.diag(e.sum(1)), e], [e.T, np.diag(e.sum(0))]]) + np.diag(soft + 1e-12)
            move = np.linalg.solve(hessian, gradient)
            z -= move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-300))
            if np.abs(move).max() < 1e-13:
                break
        now = np.zeros((k, m))
        now[rows] = base * np.exp(np.clip(z[:n, None] + z[None, n:], -50, 50))
        over = free & (now > 1)
        pi[free] = now[free]
        if not over.any():
            break
        pi[over] = 1.0
        free &= ~over
    # what rounding and the cap leave open within a category goes to its cells below 1
    for i in np.flatnonzero((have > 0) & (wanted > 0) & (wanted < have)):
        for _ in range(m + 1):
            below = (pi[i] < 1) & (cells[i] > 0)
            rest = wanted[i] - cells[i][~below].sum()
            pi[i][below] = np.minimum(1.0, pi[i][below] * rest / (cells[i] * pi[i])[below].sum()) if below.any() else pi[i][below]
            if abs((cells[i] * pi[i]).sum() - wanted[i]) < 1e-9 * max(wanted[i], 1.0):
                break
    return pi


def pivotal(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Sequential pivotal method: at most one value remains strictly between 0 and 1."""
    p = p.astype(float).copy()
    u = rng.random(len(p))
    j = -1
    for k in range(len(p)):
        if not EPS < p[k] < 1 - EPS:
            p[k] = round(p[k])
            continue
        if j < 0:
            j = k
            continue
        a, b = p[j], p[k]
        s = a + b
        if s < 1:
            win, lose = (j, k) if u[k] * s < a else (k, j)
            p[lose], p[win] = 0.0, s
            j = win
        else:
            win, lose = (j, k) if u[k] * (2 - s) < 1 - b else (k, j)
            p[win], p[lose] = 1.0, s - 1
            j = lose
        if not EPS < p[j] < 1 - EPS:
            p[j] = round(p[j])
            j = -1
    return p


def needs(units: DataFrame, targets: DataFrame, share: float = SAMPLE_SHARE) -> DataFrame:
    """Each target row with the units it has and needs, and their probability by source.

    ``units``: kind, id, category (folded; null or '' is no category), own (added by the
    service). ``targets``: kind, category, target_share, min_rows as given; compared ignoring
    case and outer blanks. The sample size of a kind is floor(share * units with a category). A
    null share or minimum counts as 0.
    """
    spark = units.sparkSession
    named = units.where("category <> ''")
    own = F.col("own").cast("long")
    asked = targets.select("kind", F.col("category").alias("label"), folded("category").alias("category"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("min_rows", F.lit(0)).cast("long").alias("min_rows"))
    moments = named.groupBy("kind", "category").agg(F.count("*").alias("available"), F.sum(own).alias("n_own"))
    totals = moments.groupBy("kind").agg(F.sum("available").alias("total"))
    joined = asked.join(totals, "kind", "left").join(moments, ["kind", "category"], "left").na.fill(0, ["total", "available", "n_own"])
    rows = joined.toPandas()  # as many rows as the target table
    n = np.floor(rows["total"] * share + EPS)
    rows["size"] = n.astype("int64")
    rows["needed"] = np.maximum(np.ceil(rows["target_share"] * n - EPS), rows["min_rows"]).astype("int64")
    rows["pi"] = rows["pi_own"] = 0.0
    for _, part in rows.groupby("kind"):
        if part["total"].max() > 0:
            mine = part["n_own"].to_numpy(float)
            pi = tilt(np.stack([part["available"].to_numpy(float) - mine, mine], 1), part["needed"].to_numpy(float), share)
            rows.loc[part.index, ["pi", "pi_own"]] = pi
    schema = "kind string, category string, label string, target_share double, min_rows long, available long, size long, needed long, pi double, pi_own double"
    return spark.createDataFrame(rows[[x.split()[0] for x in schema.split(", ")]], schema)


def draw(units: DataFrame, plan: DataFrame, *, seed: int = 1) -> DataFrame:
    """The sample: kind, id, category. Rows whose category no target names are never drawn.

    Every round draws within chunks of a category; a chunk leaves at most one unit undecided,
    and those meet in the next round, so no task ever holds a category whole.
    """
    chances = plan.where("pi > 0 OR pi_own > 0").select("kind", "category", F.col("pi").alias("pi_other"), "pi_own", "available")
    work = units.join(F.broadcast(chances), ["kind", "category"]).withColumn("pi", F.when(F.col("own"), F.col("pi_own")).otherwise(F.col("pi_other"))).select("kind", "category", "id", "pi", "available")
    certain = work.where("pi = 1").select("kind", "category", "id")
    work = work.where("pi < 1")
    largest = plan.agg(F.max("available")).first()[0] or 0
    drawn = [certain]

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "id"], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng(abs(int(pdf["h"].iloc[0])) + seed)
        p = pivotal(pdf["pi"].to_numpy(), rng)
        return pdf.assign(pi=p)[p > 0]

    while True:
        chunks = F.ceil(F.col("available") / CHUNK) if largest > CHUNK else F.lit(1)
        hashed = work.withColumn("h", F.xxhash64(F.lit(seed), "id")).withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed + 1), "id"), chunks).cast("long"))
        met = hashed.groupBy("kind", "category", "chunk").applyInPandas(meet, hashed.schema)
        met = persist_table(met.select("kind", "category", "id", "pi", "available"), "pivotal")
        drawn.append(met.where("pi = 1").select("kind", "category", "id"))
        if largest <= CHUNK:
            break
        largest = -(-largest // CHUNK)
        work = met.where("pi < 1").withColumn("available", F.ceil(F.col("available") / CHUNK).cast("long"))
        seed += 2
    out = drawn[0]
    for d in drawn[1:]:
        out = out.unionByName(d)
    return out


def report(sample: DataFrame, plan: DataFrame) -> DataFrame:
    """What each target row got: counts, share of the intended size and of the drawn sample, how
    far both are from the target, and the rows missing."""
    got = sample.groupBy("kind", "category").agg(F.count("*").alias("sampled"))
    out = plan.join(got, ["kind", "category"], "left").na.fill(0, ["sampled"])
    drawn = out.groupBy("kind").agg(F.sum("sampled").alias("drawn"))
    of = lambda n: F.when(F.col(n) > 0, F.col("sampled") / F.col(n))
    return out.join(F.broadcast(drawn), "kind").select(
        "kind", F.col("label").alias("category"), "target_share", of("size").alias("share_of_size"), of("drawn").alias("sampled_share"), (of("size") - F.col("target_share")).alias("off_size"), (of("drawn") - F.col("target_share")).alias("off_sample"),
        "min_rows", "needed", "available", "sampled", (F.col("needed") - F.col("sampled")).alias("gap"),
    )


def _units(spark, sf_dir: str) -> DataFrame:
    own = F.coalesce(F.col("added_by") == "auto", F.lit(False)).alias("own")
    one = lambda kind: load(spark, sf_dir, f"{kind}_dataset").select(F.lit(kind).alias("kind"), "id", folded("category").alias("category"), own)
    return one("text").unionByName(one("image"))


def _sampled(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    units = _units(spark, sf_dir)
    plan = needs(units, load(spark, sf_dir, "category_target"))
    return draw(units, plan), plan


def p6_found(spark, sf_dir: str) -> DataFrame:
    """Targets that the drawn sample could not meet."""
    return report(*_sampled(spark, sf_dir)).where("gap > 0").select("kind", "category")


def p6_sample(spark, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir)[0]


def p6_report(spark, sf_dir: str) -> DataFrame:
    return report(*_sampled(spark, sf_dir))


_NEEDS = """
WITH units AS (SELECT 'text' AS kind, lower(trim(category)) AS c FROM text_dataset WHERE trim(category) <> ''
  UNION ALL SELECT 'image', lower(trim(category)) FROM image_dataset WHERE trim(category) <> ''),
totals AS (SELECT kind, count(*) AS total FROM units GROUP BY kind),
have AS (SELECT kind, c, count(*) AS available FROM units GROUP BY kind, c),
asked AS (SELECT t.*, coalesce(h.available, 0) AS available, CAST(floor(coalesce(total, 0) * 0.2::DOUBLE + 1e-7) AS BIGINT) AS size,
  greatest(CAST(ceil(target_share * floor(coalesce(total, 0) * 0.2::DOUBLE + 1e-7) - 1e-7) AS BIGINT), CAST(min_rows AS BIGINT)) AS needed
  FROM category_target t LEFT JOIN totals USING (kind) LEFT JOIN have h ON h.kind = t.kind AND h.c = lower(trim(t.category)))
"""

def p6_sources(spark, sf_dir: str) -> DataFrame:
    """(kind, own, n_units, unit_share, n_sampled, sampled_share): the service's own rows and
    others, among all with a category and in the sample."""
    units = _units(spark, sf_dir).where("category <> ''")
    sample = draw(units, needs(units, load(spark, sf_dir, "category_target"))).select("kind", "id", F.lit(1).alias("drawn"))
    n = units.join(sample, ["kind", "id"], "left").groupBy("kind", "own").agg(F.count("*").alias("n_units"), F.count("drawn").alias("n_sampled"))
    sums = n.groupBy("kind").agg(F.sum("n_units").alias("all_units"), F.sum("n_sampled").alias("all_sampled"))
    return n.join(F.broadcast(sums), "kind").select("kind", "own", "n_units", (F.col("n_units") / F.col("all_units")).alias("unit_share"), "n_sampled", F.when(F.col("all_sampled") > 0, F.col("n_sampled") / F.col("all_sampled")).alias("sampled_share"))


QUERIES = {"p6_found": p6_found, "p6_sample": p6_sample, "p6_report": p6_report, "p6_sources": p6_sources}
ORACLES = {
    "p6_found": _NEEDS + "SELECT kind, category FROM asked WHERE available < needed",
    "p6_report": _NEEDS
    + """, got AS (SELECT *, least(available, needed) AS sampled FROM asked), of_ AS (SELECT *, CASE WHEN size > 0 THEN sampled / size END AS a, CASE WHEN sum(sampled) OVER w > 0 THEN sampled / sum(sampled) OVER w END AS b FROM got WINDOW w AS (PARTITION BY kind))
SELECT kind, category, target_share, a AS share_of_size, b AS sampled_share, a - target_share AS off_size, b - target_share AS off_sample, CAST(min_rows AS BIGINT) AS min_rows, needed, available, sampled, needed - sampled AS gap FROM of_""",
}
