import random

import pytest
from pyspark.sql import functions as F

from quillon.llm import line_dedup, ngram_join
from quillon.llm.components import components


def brute_classes(docs, shingle, percent):
    """id to least id of its class, by all pairs."""
    sets = {i: set(ngram_join.shingles(t, shingle).tolist()) for i, t in docs}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(rng, words, share):
    return [rng.choice("pqrstuvw") * rng.randint(1, 9) if rng.random() < share else w for w in words]


def near_texts(seed, groups=6, each=12):
    rng = random.Random(seed)
    docs, common = [], [f"shared{i}" for i in range(25)]
    for _ in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 120))]
        if rng.random() < 0.5:
            base[3:3] = common
        for _ in range(rng.randint(1, each)):
            docs.append(" ".join(edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05]))))
    return list(enumerate(docs))


@pytest.mark.parametrize(("seed", "long"), [(0, 64), (1, 2), (2, 3)])
def test_classes_equal_brute_force(spark, monkeypatch, seed, long):
    """Short and long lists, in blocks of few sets."""
    monkeypatch.setattr(ngram_join, "LONG_LIST", long)
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    monkeypatch.setattr(ngram_join, "BUCKET_BYTES", 2_000 if seed else 64_000_000)
    docs = near_texts(seed)
    out = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), shingle=4, percent=85)
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == brute_classes(docs, 4, 85)


def test_near_duplicates_of_odd_rows(odd, empty):
    out = ngram_join.near_duplicates(odd)
    rows = {r["id"]: r["component_id"] for r in out.collect()}
    assert out.count() == odd.count()
    assert rows[1] == rows[2] == 1 and rows[3] == 3 and rows[4] == 4 and rows[5] == 5 and rows[None] is None
    assert ngram_join.near_duplicates(empty).count() == 0


def test_one_row_of_each_class_stays(spark, empty):
    text = " ".join(f"w{i}" for i in range(60))
    near, other = text.replace("w59", "x"), " ".join(f"v{i}" for i in range(30))
    rows = [(5, text, 1), (5, other, 2), (7, near, 3), (None, text, 4), (9, "some other words of a text", 5), (9, "some other words of a text", 5), (3, None, 6), (3, None, 6), (4, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _row int").repartition(3)
    out = ngram_join.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(r["_row"] for r in out.collect()) == [1, 2, 5, 6, 6, 7]
    assert ngram_join.drop_near_duplicates(empty).count() == 0
    named = spark.createDataFrame([("b", text), ("a", near), (None, "")], "doc_id string, text string")
    assert {r["id"]: r["component_id"] for r in ngram_join.near_duplicates(named).collect()} == {"b": "a", "a": "a", None: None}


@pytest.mark.parametrize("seed", range(200))
def test_prefixes_lose_no_pair(seed):
    """Whatever numbers of matches two similar sets choose, their prefixes share the smaller one."""
    import numpy as np

    rng = np.random.default_rng(seed)
    frequency = np.sort(rng.integers(2, 200, 60))
    base = np.sort(rng.choice(60, rng.integers(5, 50), replace=False))
    x = base[rng.random(len(base)) > 0.05]
    y = base[rng.random(len(base)) > 0.05]
    ux, uy = int(rng.integers(0, 4)), int(rng.integers(0, 4))
    common = len(np.intersect1d(x, y))
    if common < ngram_join.required(len(x) + ux, len(y) + uy, 85):
        return
    mx, nx = ngram_join.choose_matches(frequency[x], ux, len(x) + ux, 85)
    my, ny = ngram_join.choose_matches(frequency[y], uy, len(y) + uy, 85)
    assert len(np.intersect1d(x[:nx], y[:ny])) >= min(mx, my)


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "x bigint, y bigint")).collect()}
    assert len(found) == 41 + 30
    assert len({found[i] for i in range(41)}) == 1 and len({found[i] for i in range(100, 130)}) == 1
    assert found[0] != found[100]
    assert components(spark.createDataFrame([], "x bigint, y bigint")).count() == 0


def brute_lines(docs, least):
    """Lines to cut: in a stretch of ``least`` words or more that stands earlier."""
    lines = {i: [(p, tuple(x.split())) for p, x in enumerate((t or "").split("\n")) if x.split()] for i, t in docs}
    first, cut = {}, {i: set() for i in lines}
    for i in sorted(lines):
        for a in range(len(lines[i])):
            n = 0
            for b in range(a, len(lines[i])):
                n += len(lines[i][b][1])
                if n >= least:
                    key = tuple(x for _, x in lines[i][a : b + 1])
                    if key in first and first[key] != (i, a):
                        cut[i] |= set(range(lines[i][a][0], lines[i][b][0] + 1))
                    first.setdefault(key, (i, a))
    return {i: "\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in cut[i]) for i, t in docs}


@pytest.mark.parametrize("seed", range(3))
def test_cut_lines_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(6)] + [""]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(25)]
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), min_words=8)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == brute_lines(docs, 8)


def test_line_dedup_of_odd_rows(odd, empty):
    out = line_dedup.dedup_lines(odd, min_words=5)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == odd.count() and out.columns == [*odd.columns, "runs"]
    assert rows[None]["text"] == "no id here at all"  # a null id is the lowest
    assert rows[1]["text"].startswith("the quick") and rows[2]["text"] == ""
    assert rows[3]["text"] is None and rows[4]["text"] == "" and rows[8]["text"] == "x" * 200_000
    assert line_dedup.dedup_lines(empty).count() == 0
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(odd, runs_col="score")


def test_line_dedup_runs_no_python(spark, odd, monkeypatch):
    """Neither in what is written on the way nor in the result."""
    plans, write = [], line_dedup.written

    def writing(df, name):
        plans.append(df._jdf.queryExecution().toString())
        return write(df, name)

    monkeypatch.setattr(line_dedup, "written", writing)
    out = line_dedup.dedup_lines(odd, min_words=5)
    plans.append(out._jdf.queryExecution().toString())
    assert len(plans) == 7 and not any(word in plan for plan in plans for word in ("Python", "Arrow", "Pandas"))
    assert out.select(F.col("doc_id")).count() == 10


def test_frequent_lines_and_a_long_document(spark):
    """A line that stands everywhere, a passage that many share, and one document of many lines."""
    words = lambda n, k: " ".join(f"{n}w{k}x{j}" for j in range(12))
    passage = "\n".join(words("p", k) for k in range(5))
    docs = [(i, "\n".join(["all rights reserved", words(i, 0), passage, words(i, 1), "all rights reserved"])) for i in range(60)]
    docs.append((60, "\n".join(f"line {k} of a long document" for k in range(4_000))))
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert out[0] == docs[0][1] and out[60] == docs[60][1]
    assert all(out[i] == "\n".join(["all rights reserved", words(i, 0), words(i, 1), "all rights reserved"]) for i in range(1, 60))
