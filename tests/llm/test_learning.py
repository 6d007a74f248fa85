import random
import zlib

import numpy as np

from quillon.llm import quality, toxicity

BAD = ["scumbag", "loserish", "moronic"]


def corpus(n, seed=0):
    """id, text, label: a third has words that no other text has."""
    rng = random.Random(seed)
    syllables = ["ta", "re", "mi", "no", "sel", "dor", "pin", "ka"]
    out = []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 60))]
        label = int(i % 3 == 0)
        if label:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        out.append((i, " ".join(words), label))
    return out


def test_toxicity_held_out():
    rows = corpus(600)
    model = toxicity.train([(t, y) for _, t, y in rows[:400]], 2.0)
    both = model.compressors()
    scores = np.array([model.score(model.features(t, both)) for _, t, _ in rows[400:]])
    y = np.array([v for *_, v in rows[400:]])
    assert ((scores >= 0.7) == y).mean() > 0.95
    assert 0 <= model.score(model.features(None, both)) < 0.7 and model.score(model.features("", both)) == model.score(model.features(None, both))


def test_the_toxic_dictionary_is_trained_on_toxic_text_and_loses_the_rest():
    rows = corpus(600)
    model = toxicity.train([(t, y) for _, t, y in rows], 2.0)
    assert all(w.encode() in model.toxic for w in BAD)
    assert not set(model.toxic.split()) - {w.encode() for w in BAD}


def test_a_trained_toxicity_model_takes_odd_rows(spark, odd):
    rows = [(1000 + i, t, y) for i, t, y in corpus(300)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1000, 0), (1001, None), (None, 1)], "doc_id bigint, toxic int")
    out = toxicity.score_toxicity(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    scores = {}
    for r in out:
        scores.setdefault(r["id"], set()).add(r["score"])
    assert scores[1] == scores[2] and scores[3] == scores[4] and all(len(s) == 1 for s in scores.values())
    assert all(min(scores[i]) < 0.7 for i in (1, 3, 5, 6, 7, 8, None))
    assert sum((min(scores[i]) >= 0.7) == bool(y) for i, _, y in rows) > 280


def test_op4_never_learns_from_held_out_labels(spark, tmp_path):
    rows = corpus(240, 3)
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    found = []
    for k, flip in enumerate((False, True)):
        path = f"{tmp_path}/{k}"
        spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
        labels = [(i, int(bool(y) != (flip and i in held))) for i, _, y in rows]
        spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")
        found.append({r["doc_id"]: (r["held_out"], r["score"], r["predicted"]) for r in toxicity.op4_toxicity(spark, path).collect()})
    assert found[0] == found[1] and {i for i, r in found[0].items() if r[0]} == held
    assert all(r[2] == int(r[1] >= 0.7) for r in found[0].values())
    truth = {i: y for i, _, y in rows}
    assert sum(found[0][i][2] == truth[i] for i in held) >= 0.9 * len(held)


def test_windows_cover_whole_texts():
    text = "Some words, and more; " * 400
    assert b"".join(w[:-1] for w in toxicity.windows_of(text, 64)) == b"".join(toxicity.words_of(text))


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (3, None, "x"), (None, 1, "x")], "doc_id bigint, toxic int, text string")
    out = toxicity.score_toxicity(odd, labels)
    assert out.count() == odd.count() and out.where("score is null or score < 0 or score > 1").isEmpty()
    assert toxicity.score_toxicity(empty, labels.limit(0)).count() == 0


def test_an_overlong_text_leaves_its_class_in(spark):
    rows = [(i, "x " * 5_000 if i < 2 else f"some words {i} " * (1 + i % 2), "en", "s", 9) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id bigint, toxic int, quality int")
    samples = [toxicity.labelled_sample(d, labels, "doc_id", "text", "toxic", 100, 8_000)[0] for d in (docs, docs.orderBy(-docs["doc_id"]))]
    assert samples[0] == samples[1] and len(samples[0]) == 58
    assert isinstance(quality.fit(docs, labels, sample_bytes=4_000), quality.Model)
    tight = [toxicity.labelled_sample(d, labels, "doc_id", "text", "toxic", 100, 400)[0] for d in (docs, docs.orderBy(-docs["doc_id"]))]
    assert tight[0] == tight[1] and 0 < len(tight[0]) < 58


def two_views(n, seed):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.7).astype(float)
    return (y[:, None] * 1.2 + rng.normal(size=(n, 3)), y[:, None] * 1.2 + rng.normal(size=(n, 3))), y


def exchanged(views, y, n, rounds):
    """Accuracy and loss of both views together on rows from 3,000 on, from ``n`` labels and the others before unlabelled."""
    part = lambda a, b: tuple(v[a:b] for v in views)
    model = quality.co_train(part(0, n), y[:n], quality.among(list(range(n, 3000)), part(n, 3000)), np.ones(n), rounds)
    p = np.clip(model.scores(part(3000, len(y)))[2], 1e-9, 1 - 1e-9)
    truth = y[3000:]
    return ((p >= 0.5) == truth).mean(), -(truth * np.log(p) + (1 - truth) * np.log(1 - p)).mean()


def test_co_training_beats_no_rounds_on_held_out_rows():
    none, five = (np.mean([exchanged(*two_views(5000, seed), 60, rounds) for seed in range(8)], axis=0) for rounds in (0, 5))
    assert five[0] > none[0] + 0.005 and five[1] < 0.9 * none[1]


def test_a_view_that_tells_nothing_does_no_harm():
    for seed in range(4):
        (content, other), y = two_views(5000, seed)
        noise = np.random.default_rng(seed + 100).normal(size=other.shape)
        none, five = (exchanged((content, noise), y, 120, rounds) for rounds in (0, 5))
        assert five[0] > none[0] - 0.01 and five[1] < none[1] + 0.02


def test_offers_of_a_table_equal_those_of_arrays(spark):
    (a, b), y = two_views(900, 0)
    a, b = a.astype(np.float32).astype(float), b.astype(np.float32).astype(float)
    model, _ = quality._fit((a[:200], b[:200]), y[:200], np.ones(200), ([], []))
    rows = [(i, a[i].tolist(), b[i].tolist()) for i in range(200, 900)]
    pool = spark.createDataFrame(rows, "id bigint, content array<float>, metadata array<float>").repartition(3)
    taken = ({205, 206}, set())
    ours, theirs = quality.over(pool)(model, taken, (5, 12)), quality.among(list(range(200, 900)), (a[200:], b[200:]))(model, taken, (5, 12))
    for mine, other in zip(ours, theirs, strict=True):
        assert sorted(g[:2] for g in mine) == sorted(g[:2] for g in other) and len(mine) > 5


def test_quality_rejects_noise_and_keeps_prose(spark):
    rng = random.Random(0)
    rows = []
    for i in range(240):
        words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(60)]
        good = i % 3 != 0
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!%%" for w in words)
        rows.append((i, text, "en", "s", len(text), int(good)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, label int")
    labels = docs.where("doc_id < 150").selectExpr("doc_id", "label AS quality")
    out = quality.score_quality(docs, labels).where("doc_id >= 150").collect()
    assert all((r["quality_scores"]["score"] >= quality.REJECT_BELOW) == bool(r["label"]) for r in out)


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id bigint, quality int")
    out = quality.score_quality(odd, labels)
    assert out.count() == odd.count() and out.columns == [*odd.columns, "quality_scores"]
    assert {r["quality_scores"]["score"] for r in out.collect()} == {1.0}  # the share of good labels; null ids are none
    many = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    assert quality.score_quality(empty, many).count() == 0


def test_quality_keeps_all_where_no_model_is_fitted(spark, odd):
    for good, bad in ((0, 0), (0, 40), (40, 0), (2, 40), (5, 5)):
        labels = spark.createDataFrame([(i, int(i < good)) for i in range(good + bad)], "doc_id bigint, quality int")
        out = quality.score_quality(odd, labels).select("quality_scores.*", quality.accepted().alias("accepted")).collect()
        assert len(out) == odd.count() and all(r["accepted"] and not r["fitted"] for r in out)
        assert {r["score"] for r in out} == {good / (good + bad) if good + bad else None}


def test_metadata_counts_nulls_as_missing():
    assert quality.metadata_features(None, None, None)[-1] == 1.0
    assert len(quality.content_features(None)) == len(quality.content_features("a b"))
