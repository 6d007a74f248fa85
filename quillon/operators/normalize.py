"""Normalisation, scaling, expressed shares, and residuals of covariates."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..model import Dataset


#: Cells whose covariates may be in every task.
MOST_CELLS = 5_000_000


def is_normalised(expr: DataFrame) -> DataFrame:
    """One row: whether any value isn't integral."""
    return expr.agg(F.coalesce(F.max((F.col("value") % 1 != 0).cast("int")), F.lit(0)).cast("boolean").alias("normalised"))


def log_normalise(data: Dataset, scale: float = 1e4) -> Dataset:
    """log1p of each value's share of its cell's total, times ``scale``."""
    totals = data.expr.groupBy("cell").agg(F.sum("value").alias("total"))
    return data.with_expr(data.expr.join(totals, "cell").select("gene", "cell", F.log1p(F.col("value") / F.col("total") * scale).alias("value")))


def ensure_normalised(data: Dataset) -> Dataset:
    return data if is_normalised(data.expr).first()[0] else log_normalise(data)


def gene_scales(data: Dataset) -> DataFrame:
    """``gene, mean, sd`` over all cells, zeros included (n - 1 below)."""
    n = data.n_cells()
    sums = data.expr.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    variance = (F.col("q") - F.col("s") * F.col("s") / n) / max(1, n - 1)
    return sums.select("gene", (F.col("s") / n).alias("mean"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("sd"))


def scale(data: Dataset, most: float = 10.0) -> DataFrame:
    """``gene, cell, value``: every entry centred and in units of its gene's sd, at most ``most``.

    Dense: a row for each gene and cell, zeros included; so select genes first.
    A constant gene scales to 0.
    """
    scales = gene_scales(data)
    grid = scales.crossJoin(data.cells.select("cell"))
    z = (F.coalesce("value", F.lit(0.0)) - F.col("mean")) / F.col("sd")
    return grid.join(data.expr, ["gene", "cell"], "left").select("gene", "cell", F.when(F.col("sd") > 0, F.least(z, F.lit(most))).otherwise(0.0).alias("value"))


def pct(data: Dataset, by_cluster: bool = True, genes: DataFrame | None = None) -> DataFrame:
    """The share of cells that express each gene: ``cluster, gene, pct`` or ``gene, pct``.

    With a row for each gene in each cluster, also where none does.  ``genes``
    that aren't there raise.
    """
    expr = data.expr
    known = expr.select("gene").distinct()
    if genes is not None:
        if not genes.select("gene").join(known, "gene", "left_anti").isEmpty():
            raise ValueError("genes are asked for that the matrix doesn't have")
        known = genes.select("gene").distinct()
        expr = expr.join(known, "gene", "left_semi")
    hit = expr.where("value > 0")
    if not by_cluster:
        n = data.n_cells()
        counts = hit.groupBy("gene").agg(F.count("*").alias("k"))
        return known.join(counts, "gene", "left").select("gene", (F.coalesce("k", F.lit(0)) / F.lit(n)).alias("pct"))
    sizes = data.cells.groupBy("cluster").agg(F.count("*").alias("n"))
    counts = hit.join(data.cells.select("cell", "cluster"), "cell").groupBy("cluster", "gene").agg(F.count("*").alias("k"))
    return known.crossJoin(sizes).join(counts, ["cluster", "gene"], "left").select("cluster", "gene", (F.coalesce("k", F.lit(0)) / F.col("n")).alias("pct"))


def factor_residuals(data: Dataset, factor: str = "sample") -> DataFrame:
    """``gene, cell, value``: residuals of a linear model with one factor, non-zero cells only.

    The fit is the mean of (gene, level) over all its cells; a zero cell's
    residual is minus that mean, the same for all of them, and isn't stored.
    """
    sizes = data.cells.groupBy(factor).agg(F.count("*").alias("n"))
    level = data.expr.join(data.cells.select("cell", factor), "cell").join(sizes, factor)
    own = Window.partitionBy("gene", factor)
    return level.select("gene", "cell", (F.col("value") - F.sum("value").over(own) / F.col("n")).alias("value"))


def residuals(data: Dataset, covariates: Sequence[str], model: str = "linear", use_counts: bool = False, features: DataFrame | None = None) -> DataFrame:
    """``gene, cell, value`` dense: residuals of each gene on columns of ``cells``; of ``features(gene)`` only, if given.

    ``linear``: least squares with intercept; string columns are factors.
    ``poisson``: Pearson residuals, then log1p of the distance to the gene's
    least one (also for linear with ``use_counts``).  One gene at a time is in a
    task, with the covariates of all cells, which are broadcast: over MOST_CELLS
    cells it raises (``factor_residuals`` has no such limit).
    """
    if model not in ("linear", "poisson", "negbinom"):
        raise ValueError(f"{model} is no model; linear and poisson are")
    if model == "negbinom":
        raise NotImplementedError("negbinom has no fit")
    if data.n_cells() > MOST_CELLS:
        raise ValueError(f"there are over {MOST_CELLS} cells, whose covariates every task would hold")
    frame = data.cells.select("cell", "ord", *covariates).orderBy("ord").toPandas()
    sent = data.cells.sparkSession.sparkContext.broadcast((frame["cell"].to_numpy(), kernels.design(frame[list(covariates)])))
    expr = data.expr if features is None else data.expr.join(features.select("gene").distinct(), "gene", "left_semi")
    shift = use_counts or model == "poisson"

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        cells, design = sent.value
        order = {c: i for i, c in enumerate(cells)}
        y = kernels.dense(rows["cell"], rows["value"], order)
        out = kernels.linear_residuals(design, y) if model == "linear" else kernels.poisson_residuals(design, y)
        return pd.DataFrame({"gene": rows["gene"].iloc[0], "cell": cells, "value": kernels.shifted(out) if shift else out})

    return expr.groupBy("gene").applyInPandas(fit, f"gene string, cell {data.expr.schema['cell'].dataType.simpleString()}, value double")
