"""Fold changes, top genes, and merging of similar clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Dataset, clusters_of

JOINER = " & "


def fold_changes(data: Dataset) -> DataFrame:
    """``cluster, gene, lfc``: log2 of mean expm1 plus 1 inside each cluster over that outside.

    One aggregate by (cluster, gene); outside is the gene's total without it.
    With a row for each pair, also where the gene isn't expressed inside.
    """
    sizes = data.cells.groupBy("cluster").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    sizes = sizes.withColumn("all", total)
    inside = data.expr.join(data.cells.select("cell", "cluster"), "cell").groupBy("cluster", "gene").agg(F.sum(F.expm1("value")).alias("s"))
    genes = inside.groupBy("gene").agg(F.sum("s").alias("t"))
    grid = genes.crossJoin(sizes).join(inside, ["cluster", "gene"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))

    def log_mean(sum_: object, n: object) -> object:
        return F.log2(F.when(n > 0, sum_ / n).otherwise(0.0) + 1)

    inner = log_mean(F.col("s"), F.col("n"))
    outer = log_mean(F.col("t") - F.col("s"), F.col("all") - F.col("n"))
    return grid.select("cluster", "gene", (inner - outer).alias("lfc"))


def top_genes(changes: DataFrame, above: float, most: int) -> DataFrame:
    """``cluster, gene, lfc, rank``: each cluster's largest fold changes over ``above``; ties by name."""
    own = Window.partitionBy("cluster").orderBy(F.desc("lfc"), "gene")
    return changes.where(F.col("lfc") > above).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= most)


def preselect(data: Dataset, above: float = 0.1, most: int = 100) -> DataFrame:
    """``gene``: the union of all clusters' top genes."""
    return top_genes(fold_changes(data), above, most).select("gene").distinct()


def overlaps(tops: DataFrame, cells: DataFrame) -> DataFrame:
    """``a, b, n``: how many top genes each two clusters share; a comes first in the data."""
    order = clusters_of(cells).select("cluster", "ord")
    left = order.select(F.col("cluster").alias("a"), F.col("ord").alias("oa"))
    right = order.select(F.col("cluster").alias("b"), F.col("ord").alias("ob"))
    pairs = left.join(right, F.col("oa") < F.col("ob")).select("a", "b")
    shared = tops.select("gene", F.col("cluster").alias("a")).join(tops.select("gene", F.col("cluster").alias("b")), "gene").groupBy("a", "b").agg(F.count("*").alias("n"))
    return pairs.join(shared, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def similar_edges(data: Dataset, genes: int = 20, share: float = 0.8) -> DataFrame:
    """``a, b``: clusters that share more than share * genes of their top genes."""
    tops = top_genes(fold_changes(data), 0.0, genes)
    return overlaps(tops, data.cells).where(F.col("n") > genes * share).select("a", "b")


def merge_labels(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """``cluster, merged``: each cluster's label after merging whatever edges connect.

    The members' labels in the order of the data, joined by `` & ``.  Works on a
    row for each cluster, gathered: their number is that of labels.
    """
    spark = cells.sparkSession
    order = [r["cluster"] for r in clusters_of(cells).orderBy("ord").collect()]
    up = {c: c for c in order}

    def root(c: object) -> object:
        while up[c] != c:
            c = up[c]
        return c

    for a, b in edges.select("a", "b").collect():
        up[root(b)] = root(a)
    groups: dict = {}
    for c in order:
        groups.setdefault(root(c), []).append(c)
    rows = [(c, JOINER.join(groups[root(c)])) for c in order]
    return spark.createDataFrame(rows, "cluster string, merged string")


def merge_similar(data: Dataset, genes: int = 20, share: float = 0.8, mode: str = "combine") -> Dataset:
    """Cells with merged labels; mode ``all`` leaves them."""
    if mode not in ("combine", "all"):
        raise ValueError("mode is combine or all")
    if mode == "all":
        return data
    labels = merge_labels(similar_edges(data, genes, share), data.cells)
    names = [F.col("merged").alias("cluster") if c == "cluster" else F.col(c) for c in data.cells.columns]
    return Dataset(data.expr, data.cells.join(F.broadcast(labels), "cluster").select(*names))


def expand_labels(rows: DataFrame, column: str = "cluster") -> DataFrame:
    """A row for each member of merged labels."""
    return rows.withColumn(column, F.explode(F.split(column, JOINER)))


def ordered_pairs(cells: DataFrame) -> DataFrame:
    """``a, b``: all ordered pairs of different clusters."""
    names = cells.select("cluster").distinct()
    return names.withColumnRenamed("cluster", "a").join(names.withColumnRenamed("cluster", "b"), F.col("a") != F.col("b"))


def unordered_pairs(cells: DataFrame) -> DataFrame:
    """``a, b``: all pairs of clusters, a first in the data."""
    order = clusters_of(cells)
    a = order.select(F.col("cluster").alias("a"), F.col("ord").alias("oa"))
    b = order.select(F.col("cluster").alias("b"), F.col("ord").alias("ob"))
    return a.join(b, F.col("oa") < F.col("ob")).select("a", "b")
