import random

import pytest

import corpus_pipeline as pipeline
from quillon.llm import ngram_join, tokens

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Prose, noise, copies, near copies, a shared passage, a leak, and odd rows."""
    rng = random.Random(1)

    def prose(n):
        return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(n)).capitalize() + "."

    docs = [(i, prose(60) + "\n" + prose(40), "en", "s1") for i in range(120)]
    docs += [(i, prose(70).upper().replace(" ", "!! %% ") + "||", "en", "s2") for i in range(120, 180)]
    docs += [(300, docs[0][1], "en", "s1")]  # a copy
    words = docs[1][1].split(" ")
    words[5] = "changed"
    docs += [(301, " ".join(words), "en", "s1")]  # a near copy
    passage = prose(55)
    docs += [(i, f"{prose(30)}\n{passage}\n{prose(30)}", "en", "s1") for i in (310, 311)]
    docs += [(320, prose(40) + " " + ITEM + " " + prose(40), "en", "s1"), (321, ITEM, "en", "s1")]
    docs += [(330, None, None, None), (331, "", "en", None), (None, prose(60), "en", "s1")]
    rows = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in docs]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 120), 0) for i in range(180) if i % 3]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_every_stage_takes_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.written(stage(spark, docs, folder), "stage")
        assert docs.columns == columns, name
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    good, lines, near, clean = kept
    assert {i for i in good if i is not None and 120 <= i < 180} == set() and all(i in good for i in range(120))
    assert 300 not in lines and 0 in lines
    assert lines[310].count("\n") == 2 and lines[311].count("\n") == 1
    sets = {i: set(ngram_join.shingles(t, 5).tolist()) for i, t in lines.items()}
    gone = {a for a in sets for b in sets if a is not None and b is not None and b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert set(lines) - set(near) == gone
    assert "lambda" not in clean[320] and 321 not in clean and clean[5] == good[5]
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in docs.collect())


def test_run_encodes_what_is_left(spark, folder):
    rows = {r["doc_id"]: r for r in pipeline.run(spark, folder).collect()}
    assert 5 in rows and 130 not in rows and 321 not in rows
    text = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id = 5").first()["text"]
    assert rows[5]["ids"] == tokens.reference_encoding().encode_ordinary(text) and rows[5]["n_tokens"] == len(rows[5]["ids"])


def test_stages_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_quality_stage_keeps_all_without_labels_of_both_classes(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, labels in (("none", []), ("bad", [(i, 0, 0) for i in range(120, 180)])):
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert pipeline.quality(spark, docs, f"{tmp_path}/{name}").exceptAll(docs).isEmpty() and pipeline.quality(spark, docs, f"{tmp_path}/{name}").count() == docs.count()
