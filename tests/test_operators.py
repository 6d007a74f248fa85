import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import api
from quillon.functions import kernels
from quillon.functions.scalars import erfc, title_case
from quillon.model import Dataset
from quillon.operators import clusters, markers, normalize, qc, scoring, subcluster


def dataset(spark, columns, genes=None, clusters_=None, samples=None):
    """``columns``: one list of values for each cell."""
    genes = genes or [f"g{i}" for i in range(len(columns[0]))]
    rows = [(g, c, float(v)) for c, column in enumerate(columns) for g, v in zip(genes, column, strict=True) if v]
    cells = [(c, c, (clusters_ or ["a"] * len(columns))[c], (samples or ["s"] * len(columns))[c]) for c in range(len(columns))]
    return Dataset(spark.createDataFrame(rows, "gene string, cell bigint, value double"), spark.createDataFrame(cells, "cell bigint, ord bigint, cluster string, sample string"))


def genes_of(data):
    return sorted(r[0] for r in data.expr.select("gene").distinct().collect())


def cells_of(data):
    return sorted(r[0] for r in data.cells.select("cell").collect())


def test_filters_at_their_bounds(spark):
    data = dataset(spark, [[1, 0, 0, 4], [1, 1, 0, 4], [1, 1, 0, 4], [1, 0, 1, 0]])
    assert genes_of(qc.genes_by_cells(data, 2)) == ["g0", "g1", "g3"]
    assert genes_of(qc.genes_by_share(data, 0.6)) == ["g0", "g1", "g3"]  # floor(2.4)
    assert cells_of(qc.cells_by_features(data, 3)) == [1, 2]
    assert cells_of(qc.cells_by_total(data, 5)) == [1, 2]  # more than, not from
    assert cells_of(qc.genes_by_cells(data, 0)) == [0, 1, 2, 3]


def test_downsample_is_exact_and_repeatable(spark):
    data = dataset(spark, [[1]] * 11)
    first = cells_of(qc.downsample(data, 0.5))
    assert len(first) == 5 and first == cells_of(qc.downsample(data, 0.5))
    assert len(cells_of(qc.downsample(data, 7))) == 5
    with pytest.raises(TypeError):
        qc.downsample(data, "half")


def test_validation(spark):
    with pytest.raises(ValueError, match="cluster"):
        dataset(spark, [[1], [1]], clusters_=["a", None]).validate()
    with pytest.raises(ValueError, match="sample"):
        dataset(spark, [[1], [1]], samples=["a", None]).validate()
    data = dataset(spark, [[1], [1]])
    with pytest.raises(ValueError, match="match"):
        Dataset(data.expr, data.cells.where("cell = 0")).validate()


def test_merge_is_transitive_and_in_order(spark):
    cells = dataset(spark, [[1]] * 4, clusters_=["c", "a", "b", "d"]).cells
    edges = spark.createDataFrame([("c", "a"), ("a", "d")], "a string, b string")
    found = {r[0]: r[1] for r in clusters.merge_labels(edges, cells).collect()}
    assert found == {"c": "c & a & d", "a": "c & a & d", "d": "c & a & d", "b": "b"}


def test_top_genes_ties_by_name(spark):
    changes = spark.createDataFrame([("x", "b", 1.0), ("x", "a", 1.0), ("x", "c", 0.1)], "cluster string, gene string, lfc double")
    rows = clusters.top_genes(changes, 0.1, 1).collect()
    assert [r["gene"] for r in rows] == ["a"]


def test_combination_clamps_and_floors(spark):
    rows = [("zero", 0.0), ("zero", 0.5), ("one", 1.0), ("near", 0.9991), ("edge", 0.999), ("half", 0.5), ("null", None)]
    out = {r[0]: r[1] for r in markers.combine(spark.createDataFrame(rows, "gene string, pvalue double"), ["gene"]).collect()}
    assert out["one"] == pytest.approx(0.99) and out["near"] == pytest.approx(0.99) and out["half"] == pytest.approx(0.5)
    assert out["edge"] == pytest.approx(0.999) and out["null"] is None
    assert 0 < out["zero"] < 1e-15


def test_two_clusters_keep_raw_pvalues_and_call_bounds(spark):
    fits = [(c, o, f"g{i}", b if c == "a" else -b, p) for c, o in (("a", "b"), ("b", "a")) for i, (b, p) in enumerate([(1.0, 0.0), (2.0, 0.05), (0.0, 0.001)])]
    rows = {(r["cluster"], r["gene"]): r for r in markers.model(spark.createDataFrame(fits, "cluster string, other string, gene string, beta double, pvalue double")).collect()}
    assert rows["a", "g0"]["combined_pv"] == 0.0
    assert rows["a", "g1"]["p_adjust"] == pytest.approx(0.05) and rows["a", "g1"]["change"] == "upregulated"
    assert rows["a", "g2"]["change"] == "not upregulated"  # a slope of 0 isn't positive


def test_pair_fits_mirror_and_drop(spark):
    columns = [[3, 0, 1, 0], [4, 0, 1, 0], [0, 0, 1, 0], [0, 1, 1, 0], [1, 2, 1, 1], [0, 1, 1, 2]]
    data = dataset(spark, columns, clusters_=["x", "x", "x", "y", "y", "y"])
    rows = {(r["cluster"], r["gene"]): r for r in markers.pair_fits(data).collect()}
    assert rows["x", "g0"]["beta"] == pytest.approx(-rows["y", "g0"]["beta"])
    assert ("x", "g2") not in rows  # constant


def test_batches_change_fits(spark):
    columns = [[3], [4], [0], [1], [5], [2]]
    one = markers.pair_fits(dataset(spark, columns, clusters_=list("xxxyyy"))).first()["beta"]
    two = markers.pair_fits(dataset(spark, columns, clusters_=list("xxxyyy"), samples=list("aabbab"))).first()["beta"]
    assert one != pytest.approx(two)


def test_retime_checks_threshold(spark):
    with pytest.raises(ValueError):
        markers.retime(spark.range(1), 0)
    with pytest.raises(ValueError):
        markers.retime(spark.range(1), 1.01)


def test_title_case(spark):
    rows = spark.createDataFrame([("hla-dra",), ("CD4 cells",), ("ñu",)], "t string").select(title_case(F.col("t")).alias("t")).collect()
    assert [r[0] for r in rows] == ["Hla-Dra", "Cd4 Cells", "Ñu"]
    long = spark.range(1).select(title_case(F.repeat(F.lit("x"), 2_000_000)).alias("t")).first()[0]
    assert long == "X" + "x" * 1_999_999


def test_enrichment_of_one_list(spark):
    scores = spark.createDataFrame([("a", "G", 2.0, 1)], "cluster string, gene string, score double, rank int")
    lists = api.marker_frame(spark, {"only": ["G", "G"]}).distinct()
    names = spark.createDataFrame([("a",), ("b",)], "cluster string")
    enriched = scoring.enrichment(scores, lists, names)
    assert {r["cluster"]: r["score"] for r in enriched.collect()} == {"a": 1.0, "b": 0.0}
    assert {r["cluster"]: r["prediction"] for r in scoring.predict(enriched).collect()} == {"a": "only", "b": scoring.NO_MATCH}


def test_an_empty_list_scores_nothing(spark):
    scores = spark.createDataFrame([("x", "G1", 2.0, 1), ("x", "G2", 1.0, 2)], "cluster string, gene string, score double, rank int")
    lists = api.marker_frame(spark, {"A": ["G1"], "B": ["G2"], "none": []})
    enriched = scoring.enrichment(scores, lists, spark.createDataFrame([("x",)], "cluster string"))
    assert {r["celltype"]: r["score"] for r in enriched.collect()} == {"A": 1.0, "B": 0.5, "none": 0.0}


def test_case_follows_the_first_cluster(spark):
    rows = spark.createDataFrame([("b", "Cd4"), ("a", "ACTB")], "cluster string, gene string")
    lists = api.marker_frame(spark, {"t": ["cd4", "CD4"], "none": []})
    for first, expected in (("b", "Cd4"), ("a", "CD4")):
        order = spark.createDataFrame([(c, int(c != first)) for c in "ab"], "cluster string, ord int")
        assert {r["gene"] for r in scoring.fold_case(lists, rows, order).collect()} == {expected, None}


def test_only_the_models_clusters_are_predicted(spark):
    data = dataset(spark, [[3, 1], [2, 1], [1, 4], [1, 2], [5, 5]], genes=["G1", "G2"], clusters_=["a", "a", "b", "b", "tiny"])
    fits = spark.createDataFrame([(c, o, g, b, 1e-6) for c, o, s in (("a", "b", 1), ("b", "a", -1)) for g, b in (("G1", 1.0 * s), ("G2", -1.0 * s))], "cluster string, other string, gene string, beta double, pvalue double")
    rows = markers.model(fits)
    result = scoring.add_markers(scoring.Result(fits, rows, rows), data, api.marker_frame(spark, {"one": ["g1"], "two": ["g2"], "none": []}))
    assert {r["cluster"]: r["prediction"] for r in result.prediction.collect()} == {"a": "one", "b": "two"}


def test_a_cluster_without_fits_counts(spark):
    fits = spark.createDataFrame([("a", "b", "g", 1.0, 0.01), ("b", "a", "g", -1.0, 0.01)], "cluster string, other string, gene string, beta double, pvalue double")
    assert markers.model(fits).count() == 2 and markers.model(fits, others=2).isEmpty()


def test_one_cluster_has_nothing_to_compare(spark):
    with pytest.raises(ValueError, match="two clusters"):
        markers.pair_fits(dataset(spark, [[1], [2]]))


def test_erfc(spark):
    found = spark.range(61).select((F.col("id") / 5).alias("x")).select("x", erfc(F.col("x")).alias("y")).collect()
    assert all(r["y"] == pytest.approx(math.erfc(r["x"]), rel=1e-12) for r in found)
    assert spark.sql("SELECT CAST(NULL AS DOUBLE) AS x").select(erfc(F.col("x"))).first()[0] is None


def test_rank_sums_equal_the_kernel(spark):
    rng = np.random.default_rng(0)
    x, inside = rng.integers(0, 4, (12, 40)).astype(float), np.arange(40) % 3
    values = spark.createDataFrame([(f"g{g:02d}", c, float(x[g, c])) for g in range(12) for c in range(40)], "gene string, cell bigint, value double")
    groups = spark.createDataFrame([(c, str(inside[c])) for c in range(40)], "cell bigint, grp string")
    found = {(r["gene"], r["grp"]): r for r in subcluster.rank_sums(values, groups).collect()}
    for grp in range(3):
        tests = [kernels.rank_sum(row, inside == grp) for row in x]
        adjusted = kernels.adjust(np.array([t[1] for t in tests]))
        for g, ((auc, p, change), q) in enumerate(zip(tests, adjusted, strict=True)):
            r = found[f"g{g:02d}", str(grp)]
            assert (r["auc"], r["pvalue"], r["logfc"], r["p_adjust"]) == pytest.approx((auc, p, change, q))


@pytest.mark.parametrize("part", [1, 4, 100])
def test_cosines_in_parts_equal_whole_matrices(spark, monkeypatch, part):
    monkeypatch.setattr(subcluster, "MOST_CELLS", 10)
    monkeypatch.setattr(subcluster, "PART", part)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(27, 3))
    x[5] = 0
    cluster = ["a"] * 17 + ["b"] * 9 + ["alone"]
    rows = [(cluster[c], 100 - c, c, x[c].tolist()) for c in range(27)]
    vectors = spark.createDataFrame(rows, "cluster string, cell bigint, ord bigint, x array<double>")
    found = [((r["cluster"], r["a"], r["b"]), r["similarity"]) for r in subcluster.cosine_pairs(vectors).collect()]
    whole = kernels.cosine(x)
    expected = {(cluster[c], 100 - d, 100 - c): whole[c, d] for c in range(27) for d in range(c + 1, 27) if cluster[c] == cluster[d]}
    assert len(found) == len(expected) and dict(found) == pytest.approx(expected)


def test_a_round_hands_tasks_non_zeros_only(spark, monkeypatch):
    rng = np.random.default_rng(4)
    columns = rng.poisson(0.2, (60, 12)).astype(float)
    columns[:30, :6] += rng.poisson(8, (30, 6)) * rng.integers(0, 2, (30, 6))
    columns[30:, 6:] += rng.poisson(8, (30, 6)) * rng.integers(0, 2, (30, 6))
    columns[7] = 0  # a cell without values takes part
    data = dataset(spark, columns.tolist(), genes=[f"g{i:02d}" for i in range(12)])
    seen = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(subcluster, "_split", lambda near, x, *settings: seen.add(round(float(np.abs(x).sum()) * 1e6)) or (np.arange(len(x)) % 2 + 1))
    fine, genes = subcluster.update_clustering(data, num_hvg=1, min_umi=1)
    rows = {r["cell"]: r["fine"] for r in fine.collect()}
    assert rows == {c: f"a--{c % 2 + 1}" for c in range(60)}
    names = sorted(r["gene"] for r in genes.collect())
    assert names
    normal = normalize.log_normalise(data)
    scaled = normalize.scale(normal).where(F.col("gene").isin(names)).agg(F.sum(F.abs("value"))).first()[0]
    assert seen.value / 1e6 == pytest.approx(scaled, abs=1e-4)


def test_rounds_send_no_zeros(spark, monkeypatch):
    rng = np.random.default_rng(5)
    columns = rng.poisson(3, (40, 8)) * (rng.random((40, 8)) < 0.2)
    data = dataset(spark, columns.tolist())
    sent = spark.sparkContext.accumulator(0)
    flatten = subcluster.pc.list_flatten
    monkeypatch.setattr(subcluster, "pc", SimpleNamespace(list_flatten=lambda x: sent.add(len(flatten(x))) or flatten(x), list_value_length=subcluster.pc.list_value_length, struct_field=subcluster.pc.struct_field))
    monkeypatch.setattr(subcluster, "_split", lambda near, x, *settings: None)
    names = [r["gene"] for r in subcluster.select_hvg(data).collect()]
    assert names
    assert subcluster.multiple_clustering(data, min_cells=1, num_hvg=1, min_umi=0).isEmpty()
    assert sent.value == data.expr.where(F.col("gene").isin(names)).count()


def test_labels_from_columns_and_results_from_parts(spark):
    data = dataset(spark, [[1], [2]])
    meta = spark.createDataFrame([(0, "k", 7, "x"), (1, "l", 8, "y")], "cell bigint, kind string, batch int, note string")
    rows = api.from_columns(data.expr, meta, "kind", "batch").cells.orderBy("cell").collect()
    assert [(r["cluster"], r["sample"], r["note"]) for r in rows] == [("k", "7", "x"), ("l", "8", "y")]
    assert {r["sample"] for r in api.from_columns(data.expr, meta, "kind").cells.collect()} == {"sample"}
    fits = spark.createDataFrame([("a", "b", "g", 1.0, 0.01), ("b", "a", "g", -1.0, 0.01)], "cluster string, other string, gene string, beta double, pvalue double")
    parts = {"ude": fits, "prediction": None, "fits": fits, "enrichment": None, "markers": None}
    assert api.result_of(parts).model.count() == 2
    with pytest.raises(ValueError, match="lacks fits"):
        api.result_of({k: v for k, v in parts.items() if k != "fits"})


def test_predictions_reach_cells(spark):
    cells = dataset(spark, [[1]] * 3, clusters_=["A", "C", "D"]).cells
    prediction = spark.createDataFrame([("A & B", "x"), ("C", "y")], "cluster string, prediction string")
    found = {r["cluster"]: r["prediction"] for r in scoring.to_cells(cells, prediction).collect()}
    assert found == {"A": "x", "C": "y", "D": None}
    assert scoring.relabel(cells, prediction).where("cluster = 'A & B'").count() == 1


def test_round_table_fills_forward(spark):
    rows = spark.createDataFrame([(1, 1, "1"), (2, 1, None), (1, 2, None), (2, 2, "3")], "cell bigint, round int, label string")
    found = {r["cell"]: (r["Round1"], r["Round2"]) for r in subcluster.round_table(rows, 2).collect()}
    assert found == {1: ("Round1--1", "Round1--1"), 2: (None, "Round2--3")}
    one = subcluster.round_table(rows.where("round = 1"), 1)
    assert one.columns == ["cell", "Round1"]


def test_residual_models(spark):
    data = dataset(spark, [[1.0], [3.0], [0.0], [4.0]], samples=["p", "p", "q", "q"])
    dense = {r["cell"]: r["value"] for r in normalize.residuals(data, ["sample"]).collect()}
    assert dense == pytest.approx({0: -1, 1: 1, 2: -2, 3: 2})
    sparse = {r["cell"]: r["value"] for r in normalize.factor_residuals(data).collect()}
    assert sparse == pytest.approx({0: -1, 1: 1, 3: 2})
    shifted = {r["cell"]: r["value"] for r in normalize.residuals(data, ["sample"], "poisson").collect()}
    assert min(shifted.values()) == 0 and shifted[3] == pytest.approx(math.log1p(4 / math.sqrt(2)), abs=1e-5)
    two = Dataset(data.expr, data.cells.withColumn("depth", F.col("cell").cast("double")))
    both = {r["cell"]: r["value"] for r in normalize.residuals(two, ["sample", "depth"]).collect()}
    design = np.array([[1, 0, 0], [1, 0, 1], [1, 1, 2], [1, 1, 3]], float)
    y = np.array([1.0, 3.0, 0.0, 4.0])
    assert [both[i] for i in range(4)] == pytest.approx((y - design @ np.linalg.lstsq(design, y, rcond=None)[0]).tolist(), abs=1e-9)
    assert normalize.residuals(two, ["depth"], features=spark.createDataFrame([("none",)], "gene string")).isEmpty()
    with pytest.raises(NotImplementedError):
        normalize.residuals(data, ["sample"], "negbinom")
    with pytest.raises(ValueError):
        normalize.residuals(data, ["sample"], "cubic")


def test_pct_has_zero_rows_and_checks_genes(spark):
    data = dataset(spark, [[1, 0], [1, 1]], clusters_=["a", "b"])
    found = {(r["cluster"], r["gene"]): r["pct"] for r in normalize.pct(data).collect()}
    assert found == {("a", "g0"): 1.0, ("a", "g1"): 0.0, ("b", "g0"): 1.0, ("b", "g1"): 1.0}
    with pytest.raises(ValueError):
        normalize.pct(data, genes=spark.createDataFrame([("none",)], "gene string"))


def test_too_few_genes_are_not_tested(spark):
    data = dataset(spark, [[5, 1], [5, 2], [1, 7], [1, 9]], clusters_=list("aabb"))
    with pytest.raises(ValueError, match="genes"):
        api.prepare(data, min_cells=1)
