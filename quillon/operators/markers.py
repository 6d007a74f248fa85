"""Pairwise tests between clusters and what follows from them."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..model import Dataset, clusters_of

#: The least p-value, and what stands for those close to 1.
TINY = 5.55e-17
NEAR_ONE = 1e-3
STAND_IN = 0.99
#: Residuals below this count as zero: sums of them are noise.
NOISE = 1e-9


def clamp(p: Column) -> Column:
    return F.when(p == 0, TINY).when(1 - p < NEAR_ONE, STAND_IN).otherwise(p)


def statistic(p: Column) -> Column:
    """A clamped p-value's Cauchy statistic."""
    return F.tan((F.lit(0.5) - clamp(p)) * F.lit(np.pi))


def combine(pvalues: DataFrame, by: list[str], p: str = "pvalue", weight: str | None = None) -> DataFrame:
    """``by, combined``: the Cauchy combination of each group's p-values; equal weights by default.

    A null p-value makes its group's result null.
    """
    value = F.sum(F.col(weight) * statistic(F.col(p))) if weight else F.avg(statistic(F.col(p)))
    out = F.lit(0.5) - F.atan(value) / F.lit(np.pi)
    whole = F.when(F.count(F.when(F.col(p).isNull(), 1)) > 0, None).otherwise(F.when(out <= 0, TINY).otherwise(out))
    return pvalues.groupBy(*by).agg(whole.alias("combined"))


def adjust(rows: DataFrame, p: str, by: list[str], tie: str, out: str) -> DataFrame:
    """Benjamini-Hochberg: the running least of p * (n / rank) from the largest p down, within ``by``."""
    own = Window.partitionBy(*by)
    ranked = rows.withColumn("_rank", F.row_number().over(own.orderBy(F.asc(p), F.asc(tie)))).withColumn("_n", F.count("*").over(own))
    down = own.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * (F.col("_n") / F.col("_rank"))).over(down))).drop("_rank", "_n")


def pair_fits(data: Dataset, maxit: int = 50, maxstep: float = 5.0, maxhs: int = 10, damp: bool = True, tolerance: float = 1e-5) -> DataFrame:
    """``cluster, other, gene, beta, pvalue``: each gene's Firth fit for each ordered pair of clusters.

    Every non-zero is shuffled once, by gene, and all pairs are fitted where it
    lands; equal values count as one row with a weight, as do all zeros of a
    cluster and sample.  Where a pair has several samples their means are taken
    out first.  Fits that don't converge are left out, as are genes that are zero
    throughout a pair.  The reverse of each pair is its mirror.  A task holds one
    gene's distinct values; cluster and sample sizes are in every task.
    """
    order = [r["cluster"] for r in clusters_of(data.cells).orderBy("ord").collect()]
    if len(order) < 2:
        raise ValueError("there are fewer than two clusters to compare")
    place = {c: i for i, c in enumerate(order)}
    sizes = [(place[r["cluster"]], r["sample"], r["count"]) for r in data.cells.groupBy("cluster", "sample").count().collect()]
    codes = {s: i for i, s in enumerate(sorted({s for _, s, _ in sizes}))}
    # A group of cells for each cluster and sample.
    groups = {(c, codes[s]): g for g, (c, s, _) in enumerate(sizes)}
    of_cluster, of_sample = (np.array([k[i] for k in groups], int) for i in (0, 1))
    n_cells = np.array([n for *_, n in sizes], float)
    pairs = list(itertools.combinations(range(len(order)), 2))
    batches = {(a, b): len({s for c, s in groups if c in (a, b)}) > 1 for a, b in pairs}
    counted = data.expr.join(data.cells.select("cell", "cluster", "sample"), "cell").groupBy("gene", "cluster", "sample", "value").agg(F.count("*").cast("double").alias("w"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        group = np.array([groups[place[c], codes[s]] for c, s in zip(rows["cluster"], rows["sample"], strict=True)], int)
        zeros = n_cells - np.bincount(group, rows["w"], len(n_cells))
        group = np.concatenate([group, np.arange(len(n_cells))])
        value, weight = np.concatenate([rows["value"], np.zeros(len(n_cells))]), np.concatenate([rows["w"], zeros])
        there = np.flatnonzero(weight > 0)
        there = there[np.lexsort((value[there], of_sample[group[there]], of_cluster[group[there]]))]
        group, value, weight = group[there], value[there], weight[there]
        cluster, sample = of_cluster[group], of_sample[group]
        found = []
        for a, b in pairs:
            own = (cluster == a) | (cluster == b)
            x, w, y, batch = value[own], weight[own], (cluster[own] == a).astype(float), batches[a, b]
            if not np.any(x):
                continue
            if batch:
                level = sample[own]
                total = np.bincount(level, w, len(codes))
                x = x - (np.bincount(level, w * x, len(codes)) / np.maximum(total, 1))[level]
            if np.abs(x).max(initial=0) <= (NOISE if batch else 0):
                continue
            beta, p, converged = kernels.firth(x, y, w, maxit, maxstep, maxhs, damp, tolerance)
            if converged:
                gene = rows["gene"].iloc[0]
                found += [(order[a], order[b], gene, beta, p), (order[b], order[a], gene, -beta, p)]
        return pd.DataFrame(found, columns=["cluster", "other", "gene", "beta", "pvalue"])

    return counted.groupBy("gene").applyInPandas(fit, "cluster string, other string, gene string, beta double, pvalue double")


def call(share: Column, adjusted: Column, threshold: float) -> Column:
    """Up where enough slopes are positive and the adjusted p-value is at most 0.05."""
    return F.when((share >= threshold) & (adjusted <= 0.05), "upregulated").otherwise("not upregulated")


def model(fits: DataFrame, threshold: float = 0.9, others: int | None = None) -> DataFrame:
    """``cluster, gene, avg_beta, combined_pv, p_adjust, up_share, change`` of the genes fitted against all others.

    ``others``: how many clusters each is compared with; else as many as the fits
    have, which misses a cluster none of whose fits converged.  With two clusters
    in all the p-value stays as it is, unclamped.
    """
    clusters = fits.select("cluster").distinct().agg((F.count("*") - 1 if others is None else F.lit(others).cast("bigint")).alias("others"))
    combined = F.lit(0.5) - F.atan(F.avg(statistic(F.col("pvalue")))) / F.lit(np.pi)
    rows = (
        fits.groupBy("cluster", "gene")
        .agg(
            F.count("*").alias("n"),
            F.avg("beta").alias("avg_beta"),
            F.avg((F.col("beta") > 0).cast("double")).alias("up_share"),
            F.max("pvalue").alias("single"),
            F.when(combined <= 0, TINY).otherwise(combined).alias("many"),
        )
        .join(F.broadcast(clusters), F.col("n") == F.col("others"))
    )
    rows = rows.select("cluster", "gene", "avg_beta", "up_share", F.when(F.col("others") == 1, F.col("single")).otherwise(F.col("many")).alias("combined_pv"))
    return adjust(rows, "combined_pv", ["cluster"], "gene", "p_adjust").withColumn("change", call(F.col("up_share"), F.col("p_adjust"), threshold))


def wide(fits: DataFrame, rows: DataFrame, cluster: str) -> DataFrame:
    """One cluster's fits side by side: beta and p-value by other cluster, and the summary."""
    own = fits.where(F.col("cluster") == cluster).groupBy("gene").pivot("other").agg(F.first("beta").alias("beta"), F.first("pvalue").alias("pv"))
    return rows.where(F.col("cluster") == cluster).drop("cluster").join(own, "gene")


def all_genes(rows: DataFrame) -> DataFrame:
    return rows.select("gene").distinct()


def retime(rows: DataFrame, threshold: float) -> DataFrame:
    """The calls at another threshold in (0, 1]."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be in (0, 1]")
    return rows.withColumn("change", call(F.col("up_share"), F.col("p_adjust"), threshold))
