"""Driver tables as datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Dataset


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_part(spark: SparkSession, sf_dir: str) -> Dataset:
    """Quantities of part names by customer; segments as clusters, regions as samples."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    expr = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_name").alias("gene"), F.col("o_custkey").alias("cell"))
        .agg(F.sum("l_quantity").cast("double").alias("value"))
        .where("value <> 0")
    )
    nations = table(spark, sf_dir, "nation")
    cells = (
        table(spark, sf_dir, "customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("c_custkey").alias("cell"), F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("cluster"), F.col("n_regionkey").cast("string").alias("sample"))
        .join(orders.select(F.col("o_custkey").alias("cell")), "cell", "left_semi")
    )
    return Dataset(expr, cells)


def documents(spark: SparkSession, sf_dir: str) -> Dataset:
    """Word counts by document; languages as clusters, sources as samples."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select(F.col("doc_id").alias("cell"), F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("gene")).where("gene <> ''")
    expr = words.groupBy("gene", "cell").agg(F.count("*").cast("double").alias("value"))
    cells = docs.select(F.col("doc_id").alias("cell"), F.col("doc_id").alias("ord"), F.col("lang").alias("cluster"), F.col("source").alias("sample"))
    return Dataset(expr, cells)


def embeddings(spark: SparkSession, sf_dir: str) -> Dataset:
    """Vector components by vector: signed and not integral; labels as clusters, one sample."""
    rows = table(spark, sf_dir, "embeddings")
    expr = rows.select(F.col("vec_id").alias("cell"), F.posexplode("embedding").alias("pos", "x")).select(
        F.format_string("d%02d", "pos").alias("gene"), "cell", F.col("x").cast("double").alias("value")
    ).where("value <> 0")
    cells = rows.select(F.col("vec_id").alias("cell"), F.col("vec_id").alias("ord"), F.col("label").cast("string").alias("cluster"), F.lit("sample").alias("sample"))
    return Dataset(expr, cells)


def events(spark: SparkSession, sf_dir: str) -> Dataset:
    """Counts of event type and hour by user; the user's number modulo four as cluster."""
    rows = table(spark, sf_dir, "events")
    gene = F.concat_ws("-", "event_type", F.hour("ts").cast("string"))
    expr = rows.groupBy(gene.alias("gene"), F.col("user_id").alias("cell")).agg(F.count("*").cast("double").alias("value"))
    cells = rows.select(F.col("user_id").alias("cell")).distinct().select("cell", F.col("cell").alias("ord"), (F.col("cell") % 4).cast("string").alias("cluster"), F.lit("sample").alias("sample"))
    return Dataset(expr, cells)
