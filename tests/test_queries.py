"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillon.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["expr_customer_part", "qc_pipeline", "log_normalise", "cluster_lfc", "merged_clusters", "model_table", "gene_score", "prediction", "firth_fits", "firth_fits_batch", "fitted_model", "model_wide", "add_markers", "downsample_cells", "pca_scores", "knn_edges", "jaccard_edges", "wilcoxon_auc", "streamed_pct"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(frame):
    names = sorted(frame.columns)
    return sorted(tuple(None if v is None or v != v else f"{v + 0.0:.6f}" if isinstance(v, float) else str(v) for v in r) for r in frame[names].itertuples(index=False))


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_shares_cover_the_whole_grid(spark, duck):
    ours = QUERIES["pct_by_cluster_all_genes"](spark, DATA).toPandas()
    assert rows(ours) == rows(duck.execute(SQL["pct_by_cluster_all_genes"]).fetchdf())
    genes, clusters = set(QUERIES["expr_documents"](spark, DATA).select("gene").distinct().toPandas()["gene"]), set(ours["cluster"])
    assert len(ours) == len(genes) * len(clusters) and set(ours["gene"]) == genes


def test_entry(spark):
    assert entry.entry(spark).columns == ["cluster", "gene", "lfc", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
