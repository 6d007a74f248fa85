"""Gene scores, marker-list predictions and what is done with them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import title_case
from ..model import Dataset, clusters_of
from . import markers as M
from .clusters import JOINER, expand_labels
from .normalize import pct as expressed

#: Texts that stand for empty results, and what stands for a share of 0.
NO_GENES = "* No useful DE gene *"
NO_MATCH = "* Loss of match *"
NO_SHARE = 1e-10


def gene_scores(rows: DataFrame, fits: DataFrame, shares: DataFrame) -> DataFrame:
    """``cluster, gene, score, rank``: the called genes' positive scores, best first.

    The mean over the others of statistic / m * share inside / share there, with
    m others: so the number of others divides twice.
    """
    called = rows.where((F.col("change") == "upregulated") & (F.col("p_adjust") < 0.05)).select("cluster", "gene")
    share = F.when(F.col("pct") == 0, NO_SHARE).otherwise(F.col("pct"))
    here = shares.select("cluster", "gene", share.alias("here"))
    there = shares.select(F.col("cluster").alias("other"), "gene", share.alias("there"))
    terms = fits.join(called, ["cluster", "gene"]).join(here, ["cluster", "gene"]).join(there, ["other", "gene"])
    scored = terms.groupBy("cluster", "gene").agg((F.avg(M.statistic(F.col("pvalue")) * F.col("here") / F.col("there")) / F.count("*")).alias("score")).where("score > 0")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "gene")))


def fold_case(markers: DataFrame, rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """Markers in upper case if the first gene of the first cluster in ``clusters(cluster, ord)`` is, else in title case; repeated ones once.

    The first cluster is that of least ``ord`` among those with genes.
    """
    first = rows.join(clusters, "cluster").agg(F.min_by("gene", F.struct("ord", "gene")).alias("first"))
    upper = first.select(F.coalesce(F.col("first") == F.upper("first"), F.lit(False)).alias("upper"))
    cased = markers.crossJoin(F.broadcast(upper)).withColumn("gene", F.when(F.col("upper"), F.upper("gene")).otherwise(title_case(F.col("gene"))))
    return cased.select("celltype", "ct_ord", "gene").distinct()


def enrichment(scores: DataFrame, markers: DataFrame, clusters: DataFrame) -> DataFrame:
    """``cluster, celltype, ct_ord, raw, score, rank``: each list's sum of gene scores, and scaled to 0..1 in its cluster.

    A list without genes (a null one) takes part with a sum of 0.  Where all sums
    are 0 they stay; where all are equal and not 0 they become 1.
    """
    types = markers.select("celltype", "ct_ord").distinct()
    sums = scores.join(markers, "gene").groupBy("cluster", "celltype").agg(F.sum("score").alias("raw"))
    grid = clusters.select("cluster").crossJoin(types).join(sums, ["cluster", "celltype"], "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    own = Window.partitionBy("cluster")
    low, high = F.min("raw").over(own), F.max("raw").over(own)
    scaled = F.when((low == 0) & (high == 0), 0.0).when(low == high, 1.0).otherwise((F.col("raw") - low) / F.nullif(high - low, F.lit(0.0)))
    return grid.withColumn("score", scaled).withColumn("rank", F.row_number().over(own.orderBy(F.desc("raw"), "ct_ord")))


def predict(enriched: DataFrame) -> DataFrame:
    """``cluster, prediction``: the best cell type, or NO_MATCH where all scores are 0."""
    return enriched.where("rank = 1").select("cluster", F.when(F.col("score") == 0, NO_MATCH).otherwise(F.col("celltype")).alias("prediction"))


def marker_table(enriched: DataFrame, scores: DataFrame, markers: DataFrame) -> DataFrame:
    """``cluster, celltype, ude, score``: the lists that score, with their called genes in rank order."""
    shared = scores.join(markers, "gene").groupBy("cluster", "celltype").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "gene"))), lambda r: r["gene"]), ",").alias("ude"))
    return enriched.where("score > 0").join(shared, ["cluster", "celltype"], "left").select("cluster", "celltype", F.coalesce("ude", F.lit("")).alias("ude"), "score")


def gene_lists(scores: DataFrame, clusters: DataFrame) -> DataFrame:
    """``cluster, rank, gene``: each cluster's genes, or NO_GENES."""
    return clusters.select("cluster").join(scores, "cluster", "left").select("cluster", F.coalesce("rank", F.lit(1)).alias("rank"), F.coalesce("gene", F.lit(NO_GENES)).alias("gene"))


def rank_all(rows: DataFrame, scores: DataFrame, shares: DataFrame) -> DataFrame:
    """Every fitted gene with its expressed share and score (-1 without one), by p-value, then score."""
    own = Window.partitionBy("cluster").orderBy("p_adjust", F.desc("genescore"), "gene")
    joined = rows.join(shares.withColumnRenamed("pct", "expr_pct"), ["cluster", "gene"]).join(scores.select("cluster", "gene", F.col("score").alias("genescore")), ["cluster", "gene"], "left")
    return joined.withColumn("genescore", F.coalesce("genescore", F.lit(-1.0))).withColumn("place", F.row_number().over(own))


def plot_data(enriched: DataFrame) -> DataFrame:
    """``cluster, celltype, score, ring``: the cell types over some cluster's mean; rings at 1 and from 0.9."""
    mean = F.avg("score").over(Window.partitionBy("cluster"))
    chosen = enriched.withColumn("mean", mean).where("score > mean").select("celltype").distinct()
    ring = F.when(F.col("score") == 1, "red").when(F.col("score") >= 0.9, "black")
    return enriched.join(chosen, "celltype", "left_semi").select("cluster", "celltype", "score", ring.alias("ring"))


def expand_prediction(prediction: DataFrame) -> DataFrame:
    return expand_labels(prediction)


def to_cells(cells: DataFrame, prediction: DataFrame, name: str = "prediction") -> DataFrame:
    """``cells`` with the prediction of their cluster, merged labels taken apart; null without one."""
    own = expand_prediction(prediction).select("cluster", F.col("prediction").alias(name))
    return cells.join(own, "cluster", "left")


def relabel(cells: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cells under the merged label that holds theirs, where there is one."""
    merged = clusters.select("cluster").distinct().where(F.col("cluster").contains(JOINER)).withColumn("member", F.explode(F.split("cluster", JOINER))).select(F.col("member").alias("cluster"), F.col("cluster").alias("merged"))
    names = [F.coalesce("merged", "cluster").alias("cluster") if c == "cluster" else F.col(c) for c in cells.columns]
    return cells.join(F.broadcast(merged), "cluster", "left").select(*names)


@dataclass(frozen=True)
class Result:
    """Fits, model, gene lists and, with markers, enrichment, predictions and marker table."""

    fits: DataFrame
    model: DataFrame
    ude: DataFrame
    enrichment: DataFrame | None = None
    prediction: DataFrame | None = None
    markers: DataFrame | None = None


def score_result(fits: DataFrame, rows: DataFrame, data: Dataset, markers: DataFrame | None, names: DataFrame | None = None) -> Result:
    """Scores and predictions of fitted models over the counts in ``data``.

    ``names(cluster)``: the clusters of the model, where the data have others too.
    """
    clusters = clusters_of(data.cells)
    if names is not None:
        clusters = names.select("cluster").distinct().join(clusters, "cluster", "left")
    shares = expressed(data, genes=M.all_genes(rows))
    scores = gene_scores(rows, fits, shares)
    lists = gene_lists(scores, clusters)
    if markers is None:
        return Result(fits, rows, lists)
    cased = fold_case(markers, rows, clusters)
    enriched = enrichment(scores, cased, clusters)
    return Result(fits, rows, lists, enriched, predict(enriched), marker_table(enriched, scores, cased))


def add_markers(result: Result, data: Dataset, markers: DataFrame) -> Result:
    """Predictions with other markers on the same fits; labels follow the fits' merged ones, genes those in ``data``.

    Only the model's clusters are predicted: cells of others are left out.
    """
    moved = Dataset(data.expr, relabel(data.cells, result.ude))
    genes = data.expr.select("gene").distinct()
    rows, fits = (d.join(genes, "gene", "left_semi") for d in (result.model, result.fits))
    new = score_result(fits, rows, moved, markers, result.ude)
    return replace(result, enrichment=new.enrichment, prediction=new.prediction, markers=new.markers)


def adjust_upregulation(result: Result, threshold: float, data: Dataset, markers: DataFrame | None = None) -> Result:
    """Calls at another threshold, predicted anew; without markers the predictions are emptied."""
    new = replace(result, model=M.retime(result.model, threshold))
    if markers is None:
        return replace(new, enrichment=None, prediction=None, markers=None)
    return add_markers(new, data, markers)
