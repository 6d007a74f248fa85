"""Queries over the driver tables, one for each operator, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..functions.scalars import title_case
from ..functions.storage import written
from ..model import Dataset
from ..operators import clusters as C
from ..operators import markers as M
from ..operators import normalize as N
from ..operators import qc as Q
from ..operators import scoring as S
from ..operators import subcluster as K
from ..sources import adapters as A
from ..streaming import rollup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c: Column | str) -> Column:
    """Six decimals, without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


# -- inputs ---------------------------------------------------------------------------------------

M1 = """expr AS (
  SELECT p_name AS gene, o_custkey AS cell, CAST(sum(l_quantity) AS DOUBLE) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING sum(l_quantity) <> 0
), cells AS (
  SELECT c_custkey AS cell, c_custkey AS ord, c_mktsegment AS cluster, CAST(n_regionkey AS VARCHAR) AS sample
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IN (SELECT o_custkey FROM orders)
)"""
M2 = r"""expr AS (
  SELECT gene, cell, CAST(count(*) AS DOUBLE) AS value
  FROM (SELECT doc_id AS cell, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS gene FROM documents) WHERE gene <> '' GROUP BY 1, 2
), cells AS (SELECT doc_id AS cell, doc_id AS ord, lang AS cluster, source AS sample FROM documents)"""
M3 = """expr AS (
  SELECT printf('d%02d', i - 1) AS gene, vec_id AS cell, CAST(embedding[i] AS DOUBLE) AS value
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) WHERE embedding[i] <> 0
), cells AS (SELECT vec_id AS cell, vec_id AS ord, CAST(label AS VARCHAR) AS cluster, 'sample' AS sample FROM embeddings)"""
M4 = """expr AS (
  SELECT event_type || '-' || CAST(hour(ts) AS VARCHAR) AS gene, user_id AS cell, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2
), cells AS (SELECT DISTINCT user_id AS cell, user_id AS ord, CAST(user_id % 4 AS VARCHAR) AS cluster, 'sample' AS sample FROM events)"""
NORM = """norm AS (SELECT gene, cell, ln(1 + value / sum(value) OVER (PARTITION BY cell) * 10000) AS value FROM expr)"""
LFC = """sizes AS (SELECT cluster, count(*) AS n, sum(count(*)) OVER () AS everything FROM cells GROUP BY cluster),
inside AS (SELECT cluster, gene, sum(exp(value) - 1) AS s FROM norm JOIN cells USING (cell) GROUP BY 1, 2),
genes AS (SELECT gene, sum(s) AS t FROM inside GROUP BY gene),
lfc AS (
  SELECT cluster, gene, log2(coalesce(s, 0) / n + 1) - log2((t - coalesce(s, 0)) / (everything - n) + 1) AS lfc
  FROM genes CROSS JOIN sizes LEFT JOIN inside USING (cluster, gene)
)"""
PCT = """pct AS (
  SELECT g.cluster, g.gene, coalesce(k, 0) / CAST(n AS DOUBLE) AS pct
  FROM (SELECT gene, cluster, n FROM (SELECT DISTINCT gene FROM expr) CROSS JOIN (SELECT cluster, count(*) AS n FROM cells GROUP BY cluster)) g
  LEFT JOIN (SELECT cluster, gene, count(*) AS k FROM expr JOIN cells USING (cell) WHERE value > 0 GROUP BY 1, 2) h ON g.cluster = h.cluster AND g.gene = h.gene
)"""


def m1(spark: SparkSession, d: str) -> Dataset:
    return A.customer_part(spark, d)


@query(f"WITH {M1} SELECT gene, cell, value FROM expr")
def expr_customer_part(spark: SparkSession, d: str) -> DataFrame:
    return m1(spark, d).expr.select("gene", "cell", "value")


@query(f"WITH {M2} SELECT gene, cell, value FROM expr")
def expr_documents(spark: SparkSession, d: str) -> DataFrame:
    return A.documents(spark, d).expr


@query(f"WITH {M3} SELECT gene, cell, round(value, 6) + 0.0 AS value FROM expr")
def expr_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return A.embeddings(spark, d).expr.select("gene", "cell", r6("value").alias("value"))


@query(f"WITH {M4} SELECT gene, cell, value FROM expr")
def expr_events(spark: SparkSession, d: str) -> DataFrame:
    return A.events(spark, d).expr


@query(f"WITH {M1} SELECT (SELECT count(DISTINCT gene) FROM expr) AS n_genes, (SELECT count(*) FROM cells) AS n_cells, 'cluster, sample' AS meta_columns")
def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    return m1(spark, d).summary()


@query(f"WITH {M3} SELECT max(value % 1 <> 0) AS normalised FROM expr")
def is_normalised(spark: SparkSession, d: str) -> DataFrame:
    return N.is_normalised(A.embeddings(spark, d).expr)


# -- quality control --------------------------------------------------------------------------------

M2_GENES = f"""{M2}, kept AS (
  SELECT gene FROM expr WHERE value > 0 GROUP BY gene HAVING count(*) >= floor(0.05 * (SELECT count(*) FROM cells))
)"""


@query(f"WITH {M2_GENES} SELECT gene, count(*) AS n FROM expr SEMI JOIN kept USING (gene) GROUP BY gene")
def qc_gene_pct(spark: SparkSession, d: str) -> DataFrame:
    return Q.genes_by_share(A.documents(spark, d), 0.05).expr.groupBy("gene").agg(F.count("*").alias("n"))


@query(f"WITH {M2} SELECT gene, count(*) AS n FROM expr WHERE value > 0 GROUP BY gene HAVING count(*) >= 30")
def qc_gene_min_cells(spark: SparkSession, d: str) -> DataFrame:
    return Q.genes_by_cells(A.documents(spark, d), 30).expr.groupBy("gene").agg(F.count("*").alias("n"))


@query(f"WITH {M4} SELECT cell, cluster FROM cells WHERE cell IN (SELECT cell FROM expr WHERE value > 0 GROUP BY cell HAVING count(*) >= 50)")
def qc_cell_min_features(spark: SparkSession, d: str) -> DataFrame:
    return Q.cells_by_features(A.events(spark, d), 50).cells.select("cell", "cluster")


@query(f"WITH {M1} SELECT cell, cluster FROM cells WHERE cell IN (SELECT cell FROM expr GROUP BY cell HAVING sum(value) > 900)")
def qc_cell_min_umi(spark: SparkSession, d: str) -> DataFrame:
    return Q.cells_by_total(m1(spark, d), 900).cells.select("cell", "cluster")


@query(f"""WITH {M2_GENES}, e1 AS (SELECT * FROM expr SEMI JOIN kept USING (gene)),
g2 AS (SELECT gene FROM e1 GROUP BY gene HAVING count(*) >= 60), e2 AS (SELECT * FROM e1 SEMI JOIN g2 USING (gene)),
c3 AS (SELECT cell FROM e2 GROUP BY cell HAVING count(*) >= 5), e3 AS (SELECT * FROM e2 SEMI JOIN c3 USING (cell)),
c4 AS (SELECT cell FROM e3 GROUP BY cell HAVING sum(value) > 10), e4 AS (SELECT * FROM e3 SEMI JOIN c4 USING (cell))
SELECT cell, count(*) AS n_genes, sum(value) AS total FROM e4 GROUP BY cell""")
def qc_pipeline(spark: SparkSession, d: str) -> DataFrame:
    data = Q.create(A.documents(spark, d), share=0.05, min_cells=60, min_features=5, min_total=10)
    return data.expr.groupBy("cell").agg(F.count("*").alias("n_genes"), F.sum("value").alias("total"))


@query(f"WITH {M1} SELECT gene, sum(value) AS total FROM expr WHERE gene LIKE '%a%' GROUP BY gene")
def feature_subset(spark: SparkSession, d: str) -> DataFrame:
    data = m1(spark, d)
    features = A.table(spark, d, "part").select(F.col("p_name").alias("gene")).where("gene LIKE '%a%'").distinct()
    return Q.feature_subset(data, features).expr.groupBy("gene").agg(F.sum("value").alias("total"))


@query(f"WITH {M2} SELECT cell, cluster FROM cells WHERE cluster IN (SELECT cluster FROM cells GROUP BY cluster HAVING count(*) >= 120)")
def drop_small_clusters(spark: SparkSession, d: str) -> DataFrame:
    return Q.drop_small_clusters(A.documents(spark, d), 120).cells.select("cell", "cluster")


@query(f"WITH {M2} SELECT gene, sum(value) AS total FROM expr GROUP BY gene HAVING sum(value) > 100")
def cl_gene_min_umi(spark: SparkSession, d: str) -> DataFrame:
    return Q.genes_by_total(A.documents(spark, d), 100).expr.groupBy("gene").agg(F.sum("value").alias("total"))


@query(f"WITH {M1} SELECT cell, cluster FROM cells ORDER BY md5('0:' || CAST(cell AS VARCHAR)), cell LIMIT (SELECT CAST(floor(count(*) * 0.3) AS BIGINT) FROM cells)")
def downsample_cells(spark: SparkSession, d: str) -> DataFrame:
    return Q.downsample(m1(spark, d), 0.3).cells.select("cell", "cluster")


# -- normalisation ----------------------------------------------------------------------------------


@query(f"WITH {M2}, {NORM} SELECT gene, cell, round(value, 6) + 0.0 AS value FROM norm")
def log_normalise(spark: SparkSession, d: str) -> DataFrame:
    return N.log_normalise(A.documents(spark, d)).expr.select("gene", "cell", r6("value").alias("value"))


@query(f"""WITH {M3}, s AS (
  SELECT gene, sum(value) / (SELECT count(*) FROM cells) AS mean, sqrt((sum(value * value) - sum(value) * sum(value) / (SELECT count(*) FROM cells)) / ((SELECT count(*) FROM cells) - 1)) AS sd FROM expr GROUP BY gene
) SELECT gene, cell, round(least((coalesce(value, 0) - mean) / sd, 10), 5) + 0.0 AS value FROM s CROSS JOIN (SELECT cell FROM cells) LEFT JOIN expr USING (gene, cell)""")
def scale_genes(spark: SparkSession, d: str) -> DataFrame:
    return N.scale(A.embeddings(spark, d)).select("gene", "cell", (F.round("value", 5) + F.lit(0.0)).alias("value"))


@query(f"WITH {M2}, {PCT}, k AS (SELECT gene FROM expr GROUP BY gene HAVING count(*) >= 20) SELECT cluster, gene, round(pct, 6) + 0.0 AS pct FROM pct SEMI JOIN k USING (gene)")
def pct_by_cluster(spark: SparkSession, d: str) -> DataFrame:
    return N.pct(Q.genes_by_cells(A.documents(spark, d), 20)).select("cluster", "gene", r6("pct").alias("pct"))


@query(f"WITH {M2}, {PCT} SELECT cluster, gene, round(pct, 6) + 0.0 AS pct FROM pct")
def pct_by_cluster_all_genes(spark: SparkSession, d: str) -> DataFrame:
    """The whole grid; ``pct_by_cluster`` shows its genes in 20 cells or more."""
    return N.pct(A.documents(spark, d)).select("cluster", "gene", r6("pct").alias("pct"))


@query(f"WITH {M2} SELECT gene, round(count(*) FILTER (value > 0) / CAST((SELECT count(*) FROM cells) AS DOUBLE), 6) + 0.0 AS pct FROM expr GROUP BY gene")
def pct_overall(spark: SparkSession, d: str) -> DataFrame:
    return N.pct(A.documents(spark, d), by_cluster=False).select("gene", r6("pct").alias("pct"))


@query(f"""WITH {M1}, n AS (SELECT sample, count(*) AS n FROM cells GROUP BY sample)
SELECT gene, cell, round(value - sum(value) OVER (PARTITION BY gene, sample) / n, 6) + 0.0 AS value FROM expr JOIN cells USING (cell) JOIN n USING (sample)""")
def linear_residual(spark: SparkSession, d: str) -> DataFrame:
    return N.factor_residuals(m1(spark, d)).select("gene", "cell", r6("value").alias("value"))


@query(f"""WITH {M4}, grid AS (SELECT g.gene, c.cell, c.cluster, coalesce(value, 0) AS value FROM (SELECT DISTINCT gene FROM expr) g CROSS JOIN cells c LEFT JOIN expr e ON e.gene = g.gene AND e.cell = c.cell),
f AS (SELECT *, avg(value) OVER (PARTITION BY gene, cluster) AS m FROM grid), r AS (SELECT gene, cell, CASE WHEN m = 0 THEN 0 ELSE (value - m) / sqrt(m) END AS x FROM f)
SELECT gene, cell, round(ln(1 + x - min(x) OVER (PARTITION BY gene)), 4) + 0.0 AS value FROM r""")
def poisson_residual(spark: SparkSession, d: str) -> DataFrame:
    return N.residuals(A.events(spark, d), ["cluster"], "poisson").select("gene", "cell", (F.round("value", 4) + F.lit(0.0)).alias("value"))


# -- clusters ---------------------------------------------------------------------------------------


@query(f"WITH {M2} SELECT cluster, count(*) AS n FROM cells GROUP BY cluster")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return A.documents(spark, d).cells.groupBy("cluster").agg(F.count("*").alias("n"))


@query(f"WITH {M2}, {NORM}, {LFC} SELECT cluster, gene, round(lfc, 6) + 0.0 AS lfc FROM lfc")
def cluster_lfc(spark: SparkSession, d: str) -> DataFrame:
    return C.fold_changes(N.log_normalise(A.documents(spark, d))).select("cluster", "gene", r6("lfc").alias("lfc"))


TOP = "tops AS (SELECT cluster, gene, lfc, row_number() OVER (PARTITION BY cluster ORDER BY lfc DESC, gene) AS rank FROM lfc WHERE lfc > {above} QUALIFY rank <= {most})"


@query(f"WITH {M2}, {NORM}, {LFC}, {TOP.format(above=0, most=20)} SELECT cluster, gene, round(lfc, 6) + 0.0 AS lfc, CAST(rank AS INT) AS rank FROM tops")
def top_similar_genes(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: the words that set each language apart."""
    changes = C.fold_changes(N.log_normalise(A.documents(spark, d)))
    return C.top_genes(changes, 0.0, 20).select("cluster", "gene", r6("lfc").alias("lfc"), "rank")


@query(f"WITH {M2}, {NORM}, {LFC}, {TOP.format(above=0.1, most=100)} SELECT DISTINCT gene FROM tops")
def preselected_genes(spark: SparkSession, d: str) -> DataFrame:
    return C.preselect(N.log_normalise(A.documents(spark, d)), 0.1, 100)


ORDERED = "first AS (SELECT cluster, min(ord) AS ord FROM cells GROUP BY cluster), pairs AS (SELECT a.cluster AS a, b.cluster AS b FROM first a JOIN first b ON a.ord < b.ord)"
OVERLAP = f"""{ORDERED}, shared AS (
  SELECT p.a, p.b, count(y.gene) AS n FROM pairs p JOIN tops x ON x.cluster = p.a LEFT JOIN tops y ON y.cluster = p.b AND y.gene = x.gene GROUP BY 1, 2
)"""


@query(f"WITH {M1}, {NORM}, {LFC}, {TOP.format(above=0, most=20)}, {OVERLAP} SELECT a, b, n FROM shared")
def toplist_overlap(spark: SparkSession, d: str) -> DataFrame:
    data = N.log_normalise(m1(spark, d))
    return C.overlaps(C.top_genes(C.fold_changes(data), 0.0, 20), data.cells)


EDGES = f"WITH RECURSIVE {M1}, {NORM}, {LFC}, {TOP.format(above=0, most=20)}, {OVERLAP}, edges AS (SELECT a, b FROM shared WHERE n > 20 * 0.35)"
REACH = """, reach AS (
  SELECT cluster AS x, cluster AS y FROM first
  UNION
  SELECT r.x, CASE WHEN e.a = r.y THEN e.b ELSE e.a END FROM reach r JOIN edges e ON e.a = r.y OR e.b = r.y
), merged AS (SELECT r.x AS cluster, string_agg(f.cluster, ' & ' ORDER BY f.ord) AS merged FROM reach r JOIN first f ON f.cluster = r.y GROUP BY 1)"""


@query(f"{EDGES} SELECT a, b FROM edges")
def similar_cluster_edges(spark: SparkSession, d: str) -> DataFrame:
    return C.similar_edges(N.log_normalise(m1(spark, d)), 20, 0.35)


@query(f"{EDGES}{REACH} SELECT cluster, merged FROM merged")
def cluster_components(spark: SparkSession, d: str) -> DataFrame:
    data = N.log_normalise(m1(spark, d))
    return C.merge_labels(C.similar_edges(data, 20, 0.35), data.cells)


@query(f"{EDGES}{REACH} SELECT cell, merged AS cluster FROM cells JOIN merged USING (cluster)")
def merged_clusters(spark: SparkSession, d: str) -> DataFrame:
    return C.merge_similar(N.log_normalise(m1(spark, d)), 20, 0.35).cells.select("cell", "cluster")


@query(f"WITH {M2} SELECT DISTINCT x.cluster AS a, y.cluster AS b FROM (SELECT DISTINCT cluster FROM cells) x JOIN (SELECT DISTINCT cluster FROM cells) y ON x.cluster <> y.cluster")
def ordered_pairs(spark: SparkSession, d: str) -> DataFrame:
    return C.ordered_pairs(A.documents(spark, d).cells)


@query(f"WITH {M2}, {ORDERED} SELECT a, b FROM pairs")
def cluster_pairs(spark: SparkSession, d: str) -> DataFrame:
    return C.unordered_pairs(A.documents(spark, d).cells)


# -- tests and their combination, over fits computed by arithmetic ---------------------------------

FITS = f"""{M1}, fits AS (
  SELECT x.cluster, y.cluster AS other, g.gene,
    CAST((length(g.gene) * 7 + ascii(x.cluster) * 3 - ascii(y.cluster) * 5 + ascii(g.gene)) % 11 - 3 AS DOUBLE) AS beta,
    CAST((length(g.gene) * 13 + ascii(x.cluster) * 17 + ascii(y.cluster) * 29 + ascii(right(g.gene, 1)) * 5) % 1000 AS DOUBLE) / 40000.0 AS pvalue
  FROM (SELECT DISTINCT gene FROM expr) g CROSS JOIN (SELECT DISTINCT cluster FROM cells) x JOIN (SELECT DISTINCT cluster FROM cells) y ON x.cluster <> y.cluster
)"""
CLAMP = "CASE WHEN pvalue = 0 THEN 5.55e-17 WHEN 1 - pvalue < 1e-3 THEN 0.99 ELSE pvalue END"
MODEL = f"""raw AS (
  SELECT cluster, gene, avg(beta) AS avg_beta, avg(CASE WHEN beta > 0 THEN 1.0 ELSE 0.0 END) AS up_share, 0.5 - atan(avg(tan((0.5 - {CLAMP}) * pi()))) / pi() AS c FROM fits GROUP BY 1, 2
), comb AS (SELECT * EXCLUDE c, CASE WHEN c <= 0 THEN 5.55e-17 ELSE c END AS combined_pv FROM raw),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY combined_pv, gene) AS k, count(*) OVER (PARTITION BY cluster) AS n FROM comb),
adj AS (SELECT cluster, gene, avg_beta, up_share, combined_pv, least(1.0, min(combined_pv * (CAST(n AS DOUBLE) / k)) OVER (PARTITION BY cluster ORDER BY k DESC)) AS p_adjust FROM ranked),
model AS (SELECT *, CASE WHEN up_share >= 0.5 AND p_adjust <= 0.05 THEN 'upregulated' ELSE 'not upregulated' END AS change FROM adj)"""
SCORES = f"""{PCT}, share AS (SELECT cluster, gene, CASE WHEN pct = 0 THEN 1e-10 ELSE pct END AS pct FROM pct), scored AS (
  SELECT f.cluster, f.gene, avg(tan((0.5 - {CLAMP}) * pi()) * h.pct / t.pct) / count(*) AS score
  FROM fits f JOIN model m ON m.cluster = f.cluster AND m.gene = f.gene AND m.change = 'upregulated' AND m.p_adjust < 0.05
  JOIN share h ON h.cluster = f.cluster AND h.gene = f.gene JOIN share t ON t.cluster = f.other AND t.gene = f.gene GROUP BY 1, 2
), scores AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, gene) AS rank FROM scored WHERE score > 0)"""
LISTS = """types AS (SELECT * FROM (VALUES ('early', 0), ('late', 1), ('none', 2)) v(celltype, ct_ord)), lists AS (
  SELECT DISTINCT celltype, ct_ord, gene FROM types JOIN (SELECT DISTINCT gene FROM expr) ON (celltype = 'early' AND gene < 'm') OR (celltype = 'late' AND ascii(right(gene, 1)) % 2 = 0)
)"""
ENRICHED = """sums AS (SELECT cluster, celltype, sum(score) AS raw FROM scores JOIN lists USING (gene) GROUP BY 1, 2), grid AS (
  SELECT c.cluster, t.celltype, t.ct_ord, coalesce(raw, 0) AS raw FROM (SELECT DISTINCT cluster FROM cells) c CROSS JOIN types t LEFT JOIN sums s ON s.cluster = c.cluster AND s.celltype = t.celltype
), edge AS (SELECT *, min(raw) OVER (PARTITION BY cluster) AS low, max(raw) OVER (PARTITION BY cluster) AS high FROM grid),
enriched AS (
  SELECT cluster, celltype, ct_ord, CASE WHEN low = 0 AND high = 0 THEN 0 WHEN low = high THEN 1 ELSE (raw - low) / (high - low) END AS score,
    row_number() OVER (PARTITION BY cluster ORDER BY raw DESC, ct_ord) AS rank FROM edge
)"""
ALL = f"{FITS}, {MODEL}, {SCORES}, {LISTS}, {ENRICHED}"


def fits_of(data: Dataset) -> DataFrame:
    """Fits made by arithmetic from names, so that SQL can make the same."""
    genes, pairs = data.expr.select("gene").distinct(), C.ordered_pairs(data.cells)
    grid = genes.crossJoin(pairs).withColumnsRenamed({"a": "cluster", "b": "other"})
    size, x, y = F.length("gene"), F.ascii("cluster"), F.ascii("other")
    beta = ((size * 7 + x * 3 - y * 5 + F.ascii("gene")) % 11 - 3).cast("double")
    p = ((size * 13 + x * 17 + y * 29 + F.ascii(F.right("gene", F.lit(1))) * 5) % 1000).cast("double") / 40000.0
    return grid.select("cluster", "other", "gene", beta.alias("beta"), p.alias("pvalue"))


def lists_of(data: Dataset, middle: str = "m") -> DataFrame:
    genes = data.expr.select("gene").distinct()
    early = genes.where(F.col("gene") < middle).select(F.lit("early").alias("celltype"), F.lit(0).alias("ct_ord"), "gene")
    late = genes.where("ascii(right(gene, 1)) % 2 = 0").select(F.lit("late").alias("celltype"), F.lit(1).alias("ct_ord"), "gene")
    none = genes.sparkSession.createDataFrame([("none", 2, None)], "celltype string, ct_ord int, gene string")
    return early.unionByName(late).unionByName(none)


def parts(spark: SparkSession, d: str) -> tuple[Dataset, DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    data = m1(spark, d)
    fits = fits_of(data)
    rows = M.model(fits, 0.5)
    scores = S.gene_scores(rows, fits, N.pct(data))
    lists = lists_of(data)
    return data, fits, rows, scores, lists, S.enrichment(scores, lists, data.cells.select("cluster").distinct())


@query(f"WITH {FITS}, {MODEL} SELECT cluster, gene, round(combined_pv, 9) + 0.0 AS combined FROM model")
def cauchy_combine(spark: SparkSession, d: str) -> DataFrame:
    return M.combine(fits_of(m1(spark, d)), ["cluster", "gene"]).select("cluster", "gene", (F.round("combined", 9) + F.lit(0.0)).alias("combined"))


@query(f"WITH {FITS}, {MODEL} SELECT cluster, gene, round(avg_beta, 6) + 0.0 AS avg_beta, round(combined_pv, 9) + 0.0 AS combined_pv, round(p_adjust, 9) + 0.0 AS p_adjust, change FROM model")
def model_table(spark: SparkSession, d: str) -> DataFrame:
    rows = M.model(fits_of(m1(spark, d)), 0.5)
    return rows.select("cluster", "gene", r6("avg_beta").alias("avg_beta"), (F.round("combined_pv", 9) + F.lit(0.0)).alias("combined_pv"), (F.round("p_adjust", 9) + F.lit(0.0)).alias("p_adjust"), "change")


@query(f"WITH {FITS}, {MODEL} SELECT cluster, gene, CASE WHEN up_share >= 0.75 AND p_adjust <= 0.05 THEN 'upregulated' ELSE 'not upregulated' END AS change FROM model")
def upregulation_call(spark: SparkSession, d: str) -> DataFrame:
    return M.retime(M.model(fits_of(m1(spark, d)), 0.5), 0.75).select("cluster", "gene", "change")


@query(f"WITH {FITS} SELECT DISTINCT gene FROM fits")
def all_genes(spark: SparkSession, d: str) -> DataFrame:
    return M.all_genes(M.model(fits_of(m1(spark, d)), 0.5))


@query(f"WITH {ALL} SELECT cluster, gene, round(score, 5) + 0.0 AS score, CAST(rank AS INT) AS rank FROM scores")
def gene_score(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d)[3].select("cluster", "gene", (F.round("score", 5) + F.lit(0.0)).alias("score"), "rank")


@query(f"WITH {ALL} SELECT cluster, celltype, round(score, 6) + 0.0 AS score, CAST(rank AS INT) AS rank FROM enriched")
def prediction_scores(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d)[5].select("cluster", "celltype", r6("score").alias("score"), "rank")


@query(f"WITH {ALL} SELECT cluster, CASE WHEN score = 0 THEN '* Loss of match *' ELSE celltype END AS prediction FROM enriched WHERE rank = 1")
def prediction(spark: SparkSession, d: str) -> DataFrame:
    return S.predict(parts(spark, d)[5])


@query(f"""WITH {ALL}, o AS (SELECT cluster, celltype, string_agg(gene, ',' ORDER BY rank) AS ude FROM scores JOIN lists USING (gene) GROUP BY 1, 2)
SELECT e.cluster, e.celltype, coalesce(ude, '') AS ude, round(score, 6) + 0.0 AS score FROM enriched e LEFT JOIN o ON o.cluster = e.cluster AND o.celltype = e.celltype WHERE score > 0""")
def model_markers(spark: SparkSession, d: str) -> DataFrame:
    _, _, _, scores, lists, enriched = parts(spark, d)
    return S.marker_table(enriched, scores, lists).select("cluster", "celltype", "ude", r6("score").alias("score"))


@query(f"WITH {ALL} SELECT c.cluster, CAST(coalesce(rank, 1) AS INT) AS rank, coalesce(gene, '* No useful DE gene *') AS gene FROM (SELECT DISTINCT cluster FROM cells) c LEFT JOIN scores s ON s.cluster = c.cluster")
def ude_list(spark: SparkSession, d: str) -> DataFrame:
    data, _, _, scores, _, _ = parts(spark, d)
    return S.gene_lists(scores, data.cells.select("cluster").distinct())


@query(f"""WITH {ALL} SELECT m.cluster, m.gene, round(p.pct, 6) + 0.0 AS expr_pct, round(coalesce(s.score, -1), 5) + 0.0 AS genescore, m.change
FROM model m JOIN pct p ON p.cluster = m.cluster AND p.gene = m.gene LEFT JOIN scores s ON s.cluster = m.cluster AND s.gene = m.gene""")
def rank_all_markers(spark: SparkSession, d: str) -> DataFrame:
    data, _, rows, scores, _, _ = parts(spark, d)
    return S.rank_all(rows, scores, N.pct(data)).select("cluster", "gene", r6("expr_pct").alias("expr_pct"), (F.round("genescore", 5) + F.lit(0.0)).alias("genescore"), "change")


@query(f"""WITH {ALL}, m AS (SELECT *, avg(score) OVER (PARTITION BY cluster) AS mean FROM enriched)
SELECT cluster, celltype, round(score, 6) + 0.0 AS score, CASE WHEN score = 1 THEN 'red' WHEN score >= 0.9 THEN 'black' END AS ring FROM m WHERE celltype IN (SELECT celltype FROM m WHERE score > mean)""")
def plot_scores(spark: SparkSession, d: str) -> DataFrame:
    return S.plot_data(parts(spark, d)[5]).select("cluster", "celltype", r6("score").alias("score"), "ring")


@query(f"WITH {ALL} SELECT cell, c.cluster, CASE WHEN score = 0 THEN '* Loss of match *' ELSE celltype END AS prediction FROM cells c LEFT JOIN enriched e ON e.cluster = c.cluster AND e.rank = 1")
def prediction_to_meta(spark: SparkSession, d: str) -> DataFrame:
    data, *_, enriched = parts(spark, d)
    return S.to_cells(data.cells, S.predict(enriched)).select("cell", "cluster", "prediction")


@query(f"{EDGES}{REACH}, labels AS (SELECT DISTINCT merged FROM merged) SELECT merged AS label, unnest(string_split(merged, ' & ')) AS cluster FROM labels")
def expand_prediction(spark: SparkSession, d: str) -> DataFrame:
    data = N.log_normalise(m1(spark, d))
    labels = C.merge_labels(C.similar_edges(data, 20, 0.35), data.cells).select(F.col("merged").alias("label")).distinct()
    return S.expand_prediction(labels.withColumn("cluster", F.col("label"))).select("label", "cluster")


UPPER = (
    ALL.replace("p_name AS gene", "upper(p_name) AS gene")
    .replace("gene < 'm'", "gene < 'M'")
    .replace("ON x.cluster <> y.cluster\n", "ON x.cluster <> y.cluster AND 'FURNITURE' NOT IN (x.cluster, y.cluster)\n")
    .replace("(SELECT DISTINCT cluster FROM cells) c CROSS JOIN types", "(SELECT DISTINCT cluster FROM fits) c CROSS JOIN types")
)
BEST = "SELECT cluster, CASE WHEN score = 0 THEN '* Loss of match *' ELSE celltype END AS prediction FROM enriched WHERE rank = 1"


def upper_parts(spark: SparkSession, d: str) -> tuple[Dataset, DataFrame, DataFrame, DataFrame]:
    """Data whose genes are in upper case, as marker lists become; fits and model without one of its clusters; lists."""
    data = m1(spark, d)
    data = data.with_expr(data.expr.withColumn("gene", F.upper("gene")))
    fits = fits_of(data).where("cluster <> 'FURNITURE' and other <> 'FURNITURE'")
    return data, fits, M.model(fits, 0.5), lists_of(data, "M")


@query(f"WITH {UPPER} {BEST}")
def add_markers(spark: SparkSession, d: str) -> DataFrame:
    data, fits, rows, lists = upper_parts(spark, d)
    return S.add_markers(S.Result(fits, rows, rows), data, lists).prediction


@query(f"WITH {UPPER.replace('up_share >= 0.5', 'up_share >= 0.75')} {BEST}")
def adjust_upregulation(spark: SparkSession, d: str) -> DataFrame:
    data, fits, rows, lists = upper_parts(spark, d)
    return S.adjust_upregulation(S.Result(fits, rows, rows), 0.75, data, lists).prediction


@query("""SELECT DISTINCT p_name AS name, upper(p_name) AS up, (SELECT string_agg(upper(w[1]) || lower(w[2:]), ' ' ORDER BY i) FROM (SELECT unnest(string_split(p_name, ' ')) AS w, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i)) AS title FROM part""")
def marker_casefold(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "part").select(F.col("p_name").alias("name")).distinct().select("name", F.upper("name").alias("up"), title_case(F.col("name")).alias("title"))


# -- Firth fits -------------------------------------------------------------------------------------

FIRTH = """dense AS (
  SELECT p.a, p.b, g.gene, c.cell, c.sample, coalesce(e.value, 0) AS x0, CASE WHEN c.cluster = p.a THEN 1.0 ELSE 0.0 END AS y
  FROM pairs p CROSS JOIN (SELECT DISTINCT gene FROM norm) g JOIN cells c ON c.cluster IN (p.a, p.b) LEFT JOIN norm e ON e.gene = g.gene AND e.cell = c.cell
), base AS (SELECT a, b, gene, cell, y, {x} AS x FROM dense), fit AS (
  SELECT a, b, gene, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1, 0 AS it FROM (SELECT DISTINCT a, b, gene FROM base)
  UNION ALL
  SELECT a, b, gene, b0 + greatest(-5, least(5, (sc * u0 - sb * u1) / det)), b1 + greatest(-5, least(5, (sa * u1 - sb * u0) / det)), it + 1 FROM (
    SELECT a, b, gene, b0, b1, it, any_value(sa) AS sa, any_value(sb) AS sb, any_value(sc) AS sc, any_value(det) AS det,
      sum(y - p + p * (1 - p) * (sc - 2 * sb * x + sa * x * x) / det * (0.5 - p)) AS u0, sum(x * (y - p + p * (1 - p) * (sc - 2 * sb * x + sa * x * x) / det * (0.5 - p))) AS u1
    FROM (
      SELECT *, sa * sc - sb * sb AS det FROM (
        SELECT *, sum(p * (1 - p)) OVER w AS sa, sum(p * (1 - p) * x) OVER w AS sb, sum(p * (1 - p) * x * x) OVER w AS sc FROM (
          SELECT f.*, d.x, d.y, 1 / (1 + exp(-(f.b0 + f.b1 * d.x))) AS p FROM fit f JOIN base d ON d.a = f.a AND d.b = f.b AND d.gene = f.gene WHERE f.it < 18
        ) WINDOW w AS (PARTITION BY a, b, gene)
      )
    ) GROUP BY a, b, gene, b0, b1, it
  )
), done AS (SELECT a, b, gene, b0, b1 FROM fit WHERE it = 18), likely AS (
  SELECT a, b, gene, any_value(b1) AS b1, sum(CASE WHEN y > 0 THEN ln(p) ELSE ln(1 - p) END) + ln(sum(p * (1 - p)) * sum(p * (1 - p) * x * x) - sum(p * (1 - p) * x) * sum(p * (1 - p) * x)) / 2 AS full_l,
    CAST(count(*) AS DOUBLE) AS n, sum(y) AS n1, ln(count(*) * sum(x * x) - sum(x) * sum(x)) / 2 AS spread
  FROM (SELECT f.*, d.x, d.y, 1 / (1 + exp(-(f.b0 + f.b1 * d.x))) AS p FROM done f JOIN base d USING (a, b, gene)) GROUP BY a, b, gene
), root AS (
  SELECT a, b, gene, b1, least(4.0, sqrt(greatest(0, full_l - (n1 * ln(q) + (n - n1) * ln(1 - q) + ln(q * (1 - q)) + spread)))) AS r FROM (SELECT *, (n1 + 1) / (n + 2) AS q FROM likely)
), one_way AS (
  SELECT a, b, gene, b1, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 80), lambda k: (CASE WHEN k % 2 = 0 THEN 1.0 ELSE -1.0 END) * power(r, 2 * k + 1) / (gamma(k + 1.0) * (2 * k + 1)))) AS p FROM root
), fits AS (SELECT a AS cluster, b AS other, gene, b1 AS beta, p AS pvalue FROM one_way UNION ALL SELECT b, a, gene, -b1, p FROM one_way)"""
FIRTH_ONE, FIRTH_BATCH = FIRTH.format(x="x0"), FIRTH.format(x="x0 - avg(x0) OVER (PARTITION BY a, b, gene, sample)")
FIT_ROWS = "SELECT cluster, other, gene, round(beta, 4) + 0.0 AS beta, round(pvalue, 5) + 0.0 AS pvalue FROM fits"


def fit_rows(fits: DataFrame) -> DataFrame:
    return fits.select("cluster", "other", "gene", (F.round("beta", 4) + F.lit(0.0)).alias("beta"), (F.round("pvalue", 5) + F.lit(0.0)).alias("pvalue"))


def one_sample(data: Dataset) -> Dataset:
    return Dataset(data.expr, data.cells.withColumn("sample", F.lit("sample")))


@query(f"WITH RECURSIVE {M1}, {NORM}, {ORDERED}, {FIRTH_ONE} {FIT_ROWS}")
def firth_fits(spark: SparkSession, d: str) -> DataFrame:
    return fit_rows(M.pair_fits(one_sample(N.log_normalise(m1(spark, d))), tolerance=1e-10))


@query(f"WITH RECURSIVE {M1}, {NORM}, {ORDERED}, {FIRTH_BATCH} {FIT_ROWS}")
def firth_fits_batch(spark: SparkSession, d: str) -> DataFrame:
    """Regions as samples, whose means are taken out pair by pair."""
    return fit_rows(M.pair_fits(N.log_normalise(m1(spark, d)), tolerance=1e-10))


@query(f"WITH RECURSIVE {M1}, {NORM}, {ORDERED}, {FIRTH_BATCH}, {MODEL} SELECT cluster, gene, round(avg_beta, 4) + 0.0 AS avg_beta, round(up_share, 6) + 0.0 AS up_share, round(combined_pv, 4) + 0.0 AS combined_pv, round(p_adjust, 4) + 0.0 AS p_adjust, change FROM model")
def fitted_model(spark: SparkSession, d: str) -> DataFrame:
    """Fits, their combination, adjustment and calls in one."""
    data = N.log_normalise(m1(spark, d))
    rows = M.model(written(M.pair_fits(data, tolerance=1e-10)), 0.5, data.cells.select("cluster").distinct().count() - 1)
    four = [(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("avg_beta", "combined_pv", "p_adjust")]
    return rows.select("cluster", "gene", *four, r6("up_share").alias("up_share"), "change")


@query(f"""WITH {FITS}, {MODEL}, own AS (SELECT * FROM fits WHERE cluster = 'BUILDING')
SELECT m.gene, round(m.avg_beta, 6) + 0.0 AS avg_beta, m.change, {", ".join(f"max(CASE WHEN other = '{o}' THEN beta END) AS {o.lower()}_beta, round(max(CASE WHEN other = '{o}' THEN pvalue END), 9) + 0.0 AS {o.lower()}_pv" for o in ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY"))}
FROM model m JOIN own USING (gene) WHERE m.cluster = 'BUILDING' GROUP BY m.gene, m.avg_beta, m.change""")
def model_wide(spark: SparkSession, d: str) -> DataFrame:
    """One cluster's model with its fits side by side."""
    fits = fits_of(m1(spark, d))
    rows = M.wide(fits, M.model(fits, 0.5), "BUILDING")
    sides = [c for o in ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY") for c in (F.col(f"{o}_beta").alias(f"{o.lower()}_beta"), (F.round(f"{o}_pv", 9) + F.lit(0.0)).alias(f"{o.lower()}_pv"))]
    return rows.select("gene", r6("avg_beta").alias("avg_beta"), "change", *sides)


@query()
def unique_markers(spark: SparkSession, d: str) -> DataFrame:
    """All steps on documents: languages as clusters, sources as samples."""
    return api.annotate(Q.create(A.documents(spark, d))).model


@query()
def annotated_documents(spark: SparkSession, d: str) -> DataFrame:
    lists = {"english": ["the", "and", "of"], "german": ["der", "die", "und"], "french": ["la", "les", "et"], "spanish": ["el", "los", "y"]}
    data = Q.create(A.documents(spark, d))
    return api.annotate(data, api.marker_frame(spark, {k: [w.upper() for w in v] for k, v in lists.items()})).prediction


# -- sub-clustering ---------------------------------------------------------------------------------


@query(f"""WITH {M4}, g AS (SELECT gene, sum(value) AS total, count(*) FILTER (value > 0) AS hits FROM expr GROUP BY gene HAVING sum(value) > 0.1),
s AS (SELECT *, total / sum(total) OVER () AS share FROM g), t AS (SELECT cell, sum(value) AS t FROM expr GROUP BY cell)
SELECT gene, round(sum(1 - exp(-share * t)) / any_value(total), 6) + 0.0 AS expected, round(any_value(hits) / CAST((SELECT count(*) FROM cells) AS DOUBLE), 6) + 0.0 AS observed
FROM s CROSS JOIN t GROUP BY gene HAVING sum(1 - exp(-share * t)) / any_value(total) - any_value(hits) / CAST((SELECT count(*) FROM cells) AS DOUBLE) > 0.05""")
def select_hvg(spark: SparkSession, d: str) -> DataFrame:
    return K.select_hvg(A.events(spark, d)).select("gene", r6("expected").alias("expected"), r6("observed").alias("observed"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "embeddings").select(F.col("label").cast("string").alias("cluster"), F.col("vec_id").alias("cell"), F.col("vec_id").alias("ord"), F.col("embedding").cast("array<double>").alias("x"))


COSINE = """v AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
sim AS (SELECT a.label AS cluster, a.vec_id AS a, b.vec_id AS b, list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x)) / sqrt(list_dot_product(b.x, b.x)) AS s FROM v a JOIN v b ON a.label = b.label)"""
NEAR = f"""{COSINE}, dist AS (
  SELECT x.cluster, x.a AS cell, y.a AS neighbour, round(sum((x.s - y.s) * (x.s - y.s)), 12) AS d FROM sim x JOIN sim y ON x.cluster = y.cluster AND x.b = y.b AND x.a <> y.a GROUP BY 1, 2, 3
), near AS (SELECT cluster, cell, neighbour, row_number() OVER (PARTITION BY cell ORDER BY d, neighbour) AS rank FROM dist QUALIFY rank <= 10)"""
GRAPH = f"{NEAR}, graph AS (SELECT DISTINCT cluster, least(cell, neighbour) AS a, greatest(cell, neighbour) AS b FROM near)"


@query(f"WITH {COSINE} SELECT cluster, a, b, round(s, 6) + 0.0 AS similarity FROM sim WHERE a < b")
def cosine_similarity(spark: SparkSession, d: str) -> DataFrame:
    return K.cosine_pairs(vectors(spark, d)).select("cluster", "a", "b", r6("similarity").alias("similarity"))


@query(f"WITH {NEAR} SELECT cluster, cell, neighbour, CAST(rank AS INT) AS rank FROM near")
def knn_edges(spark: SparkSession, d: str) -> DataFrame:
    return K.knn(vectors(spark, d), 10)


@query(f"WITH {GRAPH} SELECT cluster, a, b FROM graph")
def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    return K.knn_graph(K.knn(vectors(spark, d), 10))


@query(f"""WITH {GRAPH}, ways AS (SELECT a AS x, b AS y FROM graph UNION ALL SELECT b, a FROM graph), deg AS (SELECT x, count(*) AS d FROM ways GROUP BY x),
com AS (SELECT g.a, g.b, count(*) AS n FROM graph g JOIN ways p ON p.x = g.a JOIN ways q ON q.x = g.b AND q.y = p.y GROUP BY 1, 2)
SELECT g.cluster, g.a, g.b, round(coalesce(n, 0) / CAST(p.d + q.d - coalesce(n, 0) AS DOUBLE), 6) + 0.0 AS weight
FROM graph g LEFT JOIN com ON com.a = g.a AND com.b = g.b JOIN deg p ON p.x = g.a JOIN deg q ON q.x = g.b""")
def jaccard_edges(spark: SparkSession, d: str) -> DataFrame:
    return K.jaccard_weights(K.knn_graph(K.knn(vectors(spark, d), 10))).select("cluster", "a", "b", r6("weight").alias("weight"))


@query(f"""WITH {M4}, dense AS (SELECT g.gene, c.cell, c.cluster AS grp, coalesce(value, 0) AS value FROM (SELECT DISTINCT gene FROM expr) g CROSS JOIN cells c LEFT JOIN expr e ON e.gene = g.gene AND e.cell = c.cell),
r AS (SELECT *, count(*) OVER (PARTITION BY gene, value) AS t, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY gene) AS n, sum(value) OVER (PARTITION BY gene) AS everything FROM dense),
s AS (SELECT gene, grp, sum(r) AS rs, CAST(count(*) AS DOUBLE) AS n1, sum(value) AS s, CAST(any_value(n) AS DOUBLE) AS n, any_value(everything) AS everything FROM r GROUP BY 1, 2),
ti AS (SELECT gene, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM r GROUP BY gene),
u AS (SELECT *, rs - n1 * (n1 + 1) / 2 AS u, n - n1 AS n2 FROM s JOIN ti USING (gene)),
z AS (SELECT *, u - n1 * n2 / 2 AS dd, sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) AS sigma FROM u),
zz AS (SELECT *, CASE WHEN sigma > 0 THEN (dd - 0.5 * sign(dd)) / sigma END AS zz FROM z),
pp AS (SELECT *, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 80), lambda k: (CASE WHEN k % 2 = 0 THEN 1.0 ELSE -1.0 END) * power(least(4.0, abs(zz) / sqrt(2)), 2 * k + 1) / (gamma(k + 1.0) * (2 * k + 1)))) AS p FROM zz),
zp AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p NULLS LAST, gene) AS k, count(p) OVER (PARTITION BY grp) AS known FROM pp)
SELECT gene, grp, round(u / (n1 * n2), 6) + 0.0 AS auc, round(s / n1 - (everything - s) / n2, 6) + 0.0 AS logfc, round(zz, 6) + 0.0 AS z, round(p, 6) + 0.0 AS pvalue,
  round(CASE WHEN p IS NOT NULL THEN least(1.0, min(p * known / k) OVER (PARTITION BY grp ORDER BY k DESC)) END, 6) + 0.0 AS p_adjust FROM zp""")
def wilcoxon_auc(spark: SparkSession, d: str) -> DataFrame:
    data = A.events(spark, d)
    grid = data.expr.select("gene").distinct().crossJoin(data.cells.select("cell")).join(data.expr, ["gene", "cell"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    out = K.rank_sums(grid, data.cells.select("cell", F.col("cluster").alias("grp")))
    return out.select("gene", "grp", *[r6(c).alias(c) for c in ("auc", "logfc", "z", "pvalue", "p_adjust")])


@query("""WITH f AS (SELECT lang, min(doc_id) AS o FROM documents WHERE lang <> 'fr' GROUP BY lang), k AS (SELECT lang, CAST(row_number() OVER (ORDER BY o) AS VARCHAR) AS label FROM f)
SELECT doc_id AS cell, label FROM documents LEFT JOIN k USING (lang)""")
def relabel_first_seen(spark: SparkSession, d: str) -> DataFrame:
    rows = A.documents(spark, d).cells.select("cell", "ord", F.when(F.col("cluster") != "fr", F.col("cluster")).alias("fine"))
    return K.relabel_first_seen(rows).select("cell", F.col("fine").alias("label"))


@query("""SELECT doc_id AS cell, 'Round1--' || CAST(doc_id % 3 AS VARCHAR) AS "Round1",
CASE WHEN doc_id % 2 = 0 THEN 'Round2--' || CAST(doc_id % 5 AS VARCHAR) ELSE 'Round1--' || CAST(doc_id % 3 AS VARCHAR) END AS "Round2" FROM documents""")
def round_table(spark: SparkSession, d: str) -> DataFrame:
    cells = A.table(spark, d, "documents").select(F.col("doc_id").alias("cell"))
    one = cells.select("cell", F.lit(1).alias("round"), (F.col("cell") % 3).cast("string").alias("label"))
    two = cells.select("cell", F.lit(2).alias("round"), F.when(F.col("cell") % 2 == 0, (F.col("cell") % 5).cast("string")).alias("label"))
    return K.round_table(one.unionByName(two), 2)


@query("SELECT CAST(label AS VARCHAR) AS cluster, vec_id AS cell, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS length FROM embeddings")
def pca_scores(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of scores on all components, which are those of the vectors: the components are a turned frame."""
    import numpy as np
    import pandas as pd

    from ..functions import kernels

    def scores(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord", kind="stable")
        x = np.array(rows["x"].tolist(), float)
        found = kernels.principal_scores(x, x.shape[1])
        return pd.DataFrame({"cluster": rows["cluster"], "cell": rows["cell"], "length": np.round(np.linalg.norm(found, axis=1), 6)})

    return vectors(spark, d).groupBy("cluster").applyInPandas(scores, "cluster string, cell bigint, length double")


@query()
def louvain_round(spark: SparkSession, d: str) -> DataFrame:
    fine, _ = K.update_clustering(A.events(spark, d), k=20, num_hvg=5, num_de=2, min_umi=10)
    return fine.select("cell", "cluster", "fine")


@query()
def multi_round(spark: SparkSession, d: str) -> DataFrame:
    return K.multiple_clustering(A.events(spark, d), min_cells=20, k=20, num_hvg=5, num_de=2, min_umi=10)


# -- streaming, beyond the core ---------------------------------------------------------------------


@query(f"WITH {M4} SELECT gene, round(count(*) / CAST((SELECT count(*) FROM cells) AS DOUBLE), 6) + 0.0 AS pct FROM expr GROUP BY gene")
def streamed_pct(spark: SparkSession, d: str) -> DataFrame:
    return rollup.expressed_shares(spark, f"{d}/events.parquet").select("gene", r6("pct").alias("pct"))
