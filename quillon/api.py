"""The pipeline from counts and labels to markers and predictions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.storage import written
from .model import Dataset
from .operators import clusters, markers, normalize, qc, scoring
from .operators.scoring import Result

#: Fewer genes than this aren't tested.
LEAST_GENES = 20


def marker_frame(spark: SparkSession, lists: dict[str, list[str]]) -> DataFrame:
    """``celltype, ct_ord, gene`` of marker lists, in their order; an empty list has a null gene."""
    rows = [(t, i, g) for i, (t, genes) in enumerate(lists.items()) for g in genes or [None]]
    return spark.createDataFrame(rows, "celltype string, ct_ord int, gene string")


def prepare(data: Dataset, similar_genes: int = 20, similar_share: float = 0.8, lfc: float = 0.1, min_cells: int = 10, sample_share: float | None = None, max_genes: float = 100, mode: str = "combine", seed: int = 0) -> tuple[Dataset, Dataset]:
    """Counts and normalised values of the cells and genes to test, under merged labels."""
    data = Dataset(written(data.expr), written(data.cells))
    data.validate()
    normal = normalize.ensure_normalised(data)
    if sample_share is not None:
        normal = qc.downsample(normal, sample_share, seed)
    normal = clusters.merge_similar(normal, similar_genes, similar_share, mode)
    normal = qc.drop_small_clusters(normal, min_cells)
    normal = Dataset(written(normal.expr), written(normal.cells))
    counts = data.with_cells(normal.cells)
    if max_genes != math.inf:
        genes = written(clusters.preselect(normal, lfc, int(max_genes)))
        if genes.isEmpty():
            raise ValueError("no gene qualifies")
        normal, counts = qc.feature_subset(normal, genes), qc.feature_subset(counts, genes)
    if normal.expr.select("gene").distinct().count() < LEAST_GENES:
        raise ValueError(f"fewer than {LEAST_GENES} genes are left to test")
    return counts, normal


def annotate(data: Dataset, marker_lists: DataFrame | None = None, threshold: float = 0.9, features: DataFrame | None = None, **settings: object) -> Result:
    """Unique markers of each cluster and, with marker lists, its prediction.

    Merging, filters and preselection as ``prepare`` says; then Firth fits of
    all pairs of clusters, their combination, calls, scores and predictions.
    """
    if features is not None:
        data = qc.feature_subset(data, features)
    counts, normal = prepare(data, **settings)
    fits = written(markers.pair_fits(normal))
    others = normal.cells.select("cluster").distinct().count() - 1
    return scoring.score_result(fits, written(markers.model(fits, threshold, others)), counts, marker_lists)


def from_columns(expr: DataFrame, meta: DataFrame, cluster: str, sample: str | None = None, cell: str = "cell", order: str | None = None) -> Dataset:
    """A dataset whose labels are columns of ``meta``; one sample for all without one.

    ``order``: the column by which cells are first and last; their names without
    it.  The labels' names in ``meta`` stay beside the dataset's own.
    """
    taken = {"cell", "ord", "cluster", "sample"}
    rest = [c for c in meta.columns if c not in taken]
    labels = [F.col(cell).alias("cell"), F.col(order or cell).alias("ord"), F.col(cluster).cast("string").alias("cluster"), (F.col(sample).cast("string") if sample else F.lit("sample")).alias("sample")]
    return Dataset(expr.select("gene", "cell", "value"), meta.select(*labels, *rest))


def annotate_columns(expr: DataFrame, meta: DataFrame, cluster: str, sample: str, features: DataFrame | None = None, marker_lists: DataFrame | None = None, min_cells: int = 20, **settings: object) -> Result:
    """``annotate`` with labels from columns of ``meta``; clusters of fewer than 20 cells go by default."""
    return annotate(from_columns(expr, meta, cluster, sample), marker_lists, features=features, min_cells=min_cells, **settings)


#: What a result must have to be attached to a dataset.
RESULT_PARTS = ("ude", "prediction", "fits", "enrichment", "markers")


def result_of(parts: dict[str, DataFrame | None], threshold: float = 0.9) -> Result:
    """A result from its parts by name, all of RESULT_PARTS (null where there were no marker lists); others raise.

    ``model`` may come with them; without it the fits are combined anew.
    """
    if missing := [p for p in RESULT_PARTS if p not in parts]:
        raise ValueError(f"the result lacks {', '.join(missing)}")
    if unknown := sorted(set(parts) - {*RESULT_PARTS, "model"}):
        raise ValueError(f"a result has no {', '.join(unknown)}")
    model = parts.get("model")
    if model is None:
        model = markers.model(parts["fits"], threshold)
    return Result(parts["fits"], model, parts["ude"], parts["enrichment"], parts["prediction"], parts["markers"])


def attach(cells: DataFrame, result: Result, name: str = "prediction") -> DataFrame:
    """Cells with their cluster's prediction."""
    if result.prediction is None:
        return cells.withColumn(name, F.lit(None).cast("string"))
    return scoring.to_cells(cells, result.prediction, name)
