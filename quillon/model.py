"""The data model: sparse (gene, cell, value) rows, cells with labels, marker lists."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dataset:
    """A features-by-observations matrix in long form.

    ``expr(gene, cell, value)`` holds the non-zeros only.  ``cells(cell, ord,
    cluster, sample)`` has a row for each column of the matrix; ``ord`` is its
    place.  Genes are in the order of their names.  Every method returns a new
    dataset.
    """

    expr: DataFrame
    cells: DataFrame

    def with_expr(self, expr: DataFrame) -> Dataset:
        return replace(self, expr=expr)

    def with_cells(self, cells: DataFrame) -> Dataset:
        """Only the cells given, and their values."""
        return Dataset(self.expr.join(cells.select("cell"), "cell", "left_semi"), cells)

    def n_cells(self) -> int:
        return self.cells.count()

    def summary(self) -> DataFrame:
        """One row: numbers of genes and cells, and the cells' columns."""
        names = ", ".join(c for c in self.cells.columns if c not in ("cell", "ord"))
        genes = self.expr.agg(F.countDistinct("gene").alias("n_genes"))
        return genes.crossJoin(self.cells.agg(F.count("*").alias("n_cells"))).withColumn("meta_columns", F.lit(names))

    def validate(self) -> Dataset:
        """Raise where labels are null, cells repeat, or values belong to no cell."""
        bad = self.cells.agg(
            F.count_if(F.col("cluster").isNull()).alias("cluster"),
            F.count_if(F.col("sample").isNull()).alias("sample"),
            (F.count("*") - F.countDistinct("cell")).alias("repeats"),
        ).first()
        if bad["cluster"]:
            raise ValueError("cluster labels must not be null")
        if bad["sample"]:
            raise ValueError("sample labels must not be null")
        if bad["repeats"]:
            raise ValueError("cells must be unique and not null")
        if not self.expr.join(self.cells, "cell", "left_anti").isEmpty():
            raise ValueError("values and cell labels don't match: a cell has no labels")
        if not self.expr.where("gene is null").isEmpty():
            raise ValueError("genes must have names")
        return self


def clusters_of(cells: DataFrame) -> DataFrame:
    """``cluster, ord, n``: clusters, the place of their first cell, their size."""
    return cells.groupBy("cluster").agg(F.min("ord").alias("ord"), F.count("*").alias("n"))
