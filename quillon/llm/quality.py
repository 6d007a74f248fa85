"""Quality classifier by co-training a content view and a metadata view."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import column_function, kind_of, map_columns, read, remove, written
from .toxicity import logistic

#: Labelled rows of each class that may be gathered to fit, and UTF-8 bytes of their texts.
SAMPLE_ROWS = 3_000
SAMPLE_BYTES = 20_000_000
#: Rounds of co-training, and pseudo-labels that a view gives the other in a round.
ROUNDS = 5
GIVEN = 300
#: How sure a view must be of a pseudo-label, after calibration.
SURE = 0.95
#: Documents whose score is lower are rejected.
REJECT_BELOW = 0.3

_SYMBOLS = re.compile(r"[#$%&*<>\\^_`{|}~@+=/\[\]]")
_BUCKETS = 16


def content_features(text: str | None) -> list[float]:
    """What a text looks like: shares of characters, word and line shapes, repetition."""
    t = text or ""
    n = len(t)
    if not n:
        return [0.0] * 17 + [1.0]
    words = t.split()
    w = max(1, len(words))
    lines = [x for x in t.split("\n") if x.strip()]
    counts = Counter(words)
    upper = sum(map(str.isupper, words))
    symbols = len(_SYMBOLS.findall(t))
    ends = sum(1 for x in words if x[-1] in ".!?")
    trigrams = len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, w - 2)
    digits = sum(map(t.count, "0123456789"))
    return [
        upper / w,
        symbols / n,
        min(1.0, 5 * symbols / w),
        t.count("|") / w,
        t.count("!") / w,
        digits / n,
        len(counts) / w ** 0.9,
        counts.most_common(1)[0][1] / w if words else 0.0,
        min(1.0, trigrams),
        len(set(lines)) / max(1, len(lines)),
        ends / w,
        min(40.0, w / max(1, ends)) / 40,
        sum(map(len, words)) / w / 10,
        sum(1 for x in words if len(x) > 18) / w,
        math.log1p(w) / 10,
        math.log1p(n / max(1, len(lines))) / 10,
        sum(1 for x in words if not any(map(str.isalpha, x))) / w,
        0.0,
    ]


def metadata_features(lang: str | None, source: str | None, n_chars: float | None) -> list[float]:
    """What a page's metadata says: language and source by hash, stated length."""
    out = [0.0] * (2 * _BUCKETS + 2)
    out[zlib.crc32((lang or "").encode()) % _BUCKETS] = 1.0
    out[_BUCKETS + zlib.crc32((source or "").encode()) % _BUCKETS] = 1.0
    missing = n_chars is None or n_chars != n_chars
    out[-2] = 0.0 if missing else math.log1p(max(0.0, float(n_chars))) / 10
    out[-1] = float(missing)
    return out


@dataclass
class View:
    """A logistic classifier over one view, on standardised features and their squares."""

    means: np.ndarray
    scales: np.ndarray
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> View:
        means, scales = x.mean(axis=0), x.std(axis=0) + 1e-6
        view = View(means, scales, np.zeros(1))
        view.weights = logistic(view._expand(x), y, weight, ridge=2e-4)
        return view

    def _expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.means) / self.scales, -6, 6)
        return np.hstack([z, z * z])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[0] + self._expand(x) @ self.weights[1:], -30, 30)


def probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-logit))


@dataclass
class Model:
    """Both views, each one's calibration (slope, offset), and the weights that combine them."""

    views: tuple[View, View]
    calibration: tuple[np.ndarray, np.ndarray]
    combined: np.ndarray

    def scores(self, x: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row the two calibrated views' probabilities and the combined one."""
        own = [c[0] + c[1] * v.logit(f) for v, c, f in zip(self.views, self.calibration, x, strict=True)]
        return probability(own[0]), probability(own[1]), probability(self.combined[0] + self.combined[1] * own[0] + self.combined[2] * own[1])


#: A view's offer to the other: each row's key, label and features in the other view.
Gift = tuple[object, float, np.ndarray]


def _calibrated(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Offset and slope from logits of rows that weren't learnt from; a view that tells nothing gets a slope of 0.

    The targets lie inside 0 and 1 by the number of rows, so that few rows make no
    view sure.
    """
    good, bad = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    out = logistic(logit[:, None], target, weight, ridge=1e-4)
    if out[1] > 0:
        return out
    share = float(weight @ target / weight.sum())
    return np.array([math.log(share / (1 - share)), 0.0])


def _fit(labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, weight: np.ndarray, given: tuple[list[Gift], list[Gift]]) -> tuple[Model, float]:
    """Both views on the labelled rows and what they were given; calibrated and combined on logits across folds; their loss."""
    fold = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0)) % 3
    views, calibration, own = [], [], []
    for x, gifts in zip(labelled, given, strict=True):
        extra = np.array([g[2] for g in gifts]).reshape(len(gifts), x.shape[1])
        said, less = np.array([g[1] for g in gifts]), np.full(len(gifts), 0.5 * weight.mean())

        def learnt(rows: np.ndarray, x: np.ndarray = x, extra: np.ndarray = extra, said: np.ndarray = said, less: np.ndarray = less) -> View:
            return View.fit(np.vstack([x[rows], extra]), np.concatenate([y[rows], said]), np.concatenate([weight[rows], less]))

        logit = np.zeros(len(y))
        for k in range(3):
            logit[fold == k] = learnt(fold != k).logit(x[fold == k])
        views.append(learnt(np.ones(len(y), bool)))
        calibration.append(_calibrated(logit, y, weight))
        own.append(calibration[-1][0] + calibration[-1][1] * logit)
    both = np.column_stack(own)
    combined = logistic(both, y, weight, ridge=1e-3)
    p = np.clip(probability(combined[0] + both @ combined[1:]), 1e-9, 1 - 1e-9)
    loss = -float(weight @ (y * np.log(p) + (1 - y) * np.log(1 - p)) / weight.sum())
    return Model(tuple(views), tuple(calibration), combined), loss


def co_train(labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, seek: Callable[[Model, tuple[set, set], tuple[int, int]], tuple[list[Gift], list[Gift]]], weight: np.ndarray, rounds: int = ROUNDS, given: int = GIVEN) -> Model:
    """Fit both views, letting each teach the other.

    Each round each view picks, by ``seek``, the unlabelled rows that it is surest
    of, ``given`` at most in the classes' shares, and they join the other view's
    rows with those labels.  How sure a view is, is measured on labelled rows that
    it hasn't learnt from, so one that tells nothing gives nothing; and a round
    after which the combined views tell those rows worse is taken back and ends
    the exchange.
    """
    gifts: tuple[list[Gift], list[Gift]] = ([], [])
    model, loss = _fit(labelled, y, weight, gifts)
    good = float(weight @ y / weight.sum())
    wanted = (max(1, round(given * (1 - good))), max(1, round(given * good)))
    for _ in range(rounds):
        new = seek(model, tuple({g[0] for g in own} for own in gifts), wanted)
        if not any(new):
            break
        more = tuple(own + extra for own, extra in zip(gifts, new, strict=True))
        changed, now = _fit(labelled, y, weight, more)
        if now > loss:
            break
        model, loss, gifts = changed, now, more
    return model


def surest(model: Model, keys: list, x: tuple[np.ndarray, np.ndarray], taken: tuple[set, set], wanted: tuple[int, int], sure: float = SURE) -> list[tuple[int, int, float, int]]:
    """Of some rows the surest of each view and label: (who is given it, label, certainty, place), at most ``wanted`` by label; ties by key."""
    out = []
    for v in (0, 1):
        c = model.calibration[v]
        if c[1] <= 0:
            continue
        p, other = probability(c[0] + c[1] * model.views[v].logit(x[v])), 1 - v
        for label in (0, 1):
            certainty = p if label else 1 - p
            rows = [i for i in (certainty >= sure).nonzero()[0].tolist() if keys[i] not in taken[other]]
            rows.sort(key=lambda i: (-certainty[i], zlib.crc32(str(keys[i]).encode()), str(keys[i])))
            out += [(other, label, float(certainty[i]), i) for i in rows[: wanted[label]]]
    return out


def among(keys: list, x: tuple[np.ndarray, np.ndarray]) -> Callable[..., tuple[list[Gift], list[Gift]]]:
    """``seek`` over rows at hand."""

    def seek(model: Model, taken: tuple[set, set], wanted: tuple[int, int]) -> tuple[list[Gift], list[Gift]]:
        out: tuple[list[Gift], list[Gift]] = ([], [])
        for other, label, _, i in surest(model, keys, x, taken, wanted):
            out[other].append((keys[i], float(label), x[other][i]))
        return out

    return seek


def over(pool: DataFrame) -> Callable[..., tuple[list[Gift], list[Gift]]]:
    """``seek`` over all rows of ``pool(id, content, metadata)``.

    Each slice of rows keeps the surest of its own, at most as many as are wanted;
    only the surest of all come to the driver.
    """
    spark = pool.sparkSession
    schema = f"id {kind_of(pool, 'id')}, other int, label int, certainty double, features array<float>"

    def seek(model: Model, taken: tuple[set, set], wanted: tuple[int, int]) -> tuple[list[Gift], list[Gift]]:
        sent = spark.sparkContext.broadcast((model, taken))

        def best(own: tuple, rows: dict) -> dict:
            views = tuple(np.array(rows[c], np.float64).reshape(len(rows["id"]), -1) for c in ("content", "metadata"))
            found = surest(own[0], rows["id"], views, own[1], wanted)
            return {
                "id": [rows["id"][i] for *_, i in found],
                "other": [other for other, *_ in found],
                "label": [label for _, label, _, _ in found],
                "certainty": [c for _, _, c, _ in found],
                "features": [views[other][i].tolist() for other, _, _, i in found],
            }

        found = written(map_columns(pool.select("id", "content", "metadata"), best, schema, lambda: sent.value), "offers")
        out: tuple[list[Gift], list[Gift]] = ([], [])
        for other in (0, 1):
            for label in (0, 1):
                top = found.where((F.col("other") == other) & (F.col("label") == label)).dropDuplicates(["id"])
                for r in top.orderBy(F.desc("certainty"), F.crc32(F.col("id").cast("string").cast("binary")), "id").limit(wanted[label]).collect():
                    out[other].append((r["id"], float(label), np.array(r["features"])))
        remove(spark, found)
        return out

    return seek


def _constant(share: float) -> Model:
    view = View(np.zeros(1), np.ones(1), np.zeros(1))
    flat = np.array([0.0, 0.0])
    return Model((view, view), (flat, flat), np.array([math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0]))


def _features(text: list, lang: list, source: list, length: list) -> list[dict]:
    return [{"content": content_features(t), "metadata": metadata_features(*m)} for t, *m in zip(text, lang, source, length, strict=True)]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, str, str] = ("lang", "source", "n_chars"), label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, rounds: int = ROUNDS) -> Model | float | None:
    """A model from a bounded sample of labelled rows and from all unlabelled ones.

    Labelled: ``sample_rows`` of each class, of least hash of the id, and
    ``sample_bytes`` of text of each, of which a text that no longer fits is
    skipped.  Unlabelled: the features of all rows are written once, and each round
    seeks pseudo-labels among all of them.  Where a class has fewer than six rows,
    or ``docs`` has fewer of them, the share of good labels is returned instead,
    None without any label.
    """
    lang, source, length = meta_cols
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(length).cast("double").alias("length")).where("id is not null")
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col) > 0).cast("int").alias("y"))
    counts = dict(known.groupBy("y").count().collect())
    if min(counts.get(0, 0), counts.get(1, 0)) < 6:
        return counts.get(1, 0) / sum(counts.values()) if counts else None
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample_rows) for y in (0, 1)]
    # Ids alone decide which rows are gathered; their texts come after.
    found = rows.join(F.broadcast(chosen[0].unionByName(chosen[1])), "id").select("id", "y", "text", "lang", "source", "length")
    lots: dict[int, list] = {0: [], 1: []}
    left = {y: sample_bytes for y in lots}
    for doc, y, text, *meta in found.orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).toLocalIterator():
        size = len((text or "").encode())
        if size <= left[y]:
            left[y] -= size
            lots[y].append((zlib.crc32(str(doc).encode()), doc, content_features(text), metadata_features(*meta)))
    for lot in lots.values():
        lot.sort()
    if min(map(len, lots.values())) < 6:
        return counts[1] / sum(counts.values())
    both = [[np.array([r[2 + v] for r in lots[y]]) for v in (0, 1)] for y in (0, 1)]
    y = np.concatenate([np.zeros(len(lots[0])), np.ones(len(lots[1]))])
    # Classes were gathered up to equal numbers; weights bring back their shares.
    weight = np.where(y == 1, counts[1] / len(lots[1]), counts[0] / len(lots[0]))
    weight /= weight.mean()
    labelled = tuple(np.vstack([both[0][v], both[1][v]]) for v in (0, 1))
    features = rows.select("id", column_function(lambda _, *x: _features(*x), "struct<content:array<float>,metadata:array<float>>", lambda: None)("text", "lang", "source", "length").alias("f"))
    pool = written(features.select("id", "f.content", "f.metadata").join(known.select("id"), "id", "left_anti"), "features")
    model = co_train(labelled, y, over(pool), weight, rounds)
    remove(docs.sparkSession, pool)
    return model


def _score_rows(model: Model | float | None, text: list, lang: list, source: list, length: list) -> list[dict]:
    if not isinstance(model, Model):
        return [{"content": model, "metadata": model, "score": model, "fitted": False}] * len(text)
    content = np.array([content_features(t) for t in text])
    meta = np.array([metadata_features(*m) for m in zip(lang, source, length, strict=True)])
    return [dict(zip(("content", "metadata", "score"), map(float, row), strict=True), fitted=True) for row in zip(*model.scores((content, meta)), strict=True)]


def scorer(spark: SparkSession, model: Model | float | None) -> Callable[..., Column]:
    """A function of text, language, source and length columns: content, metadata and combined score, and whether a model gave them."""
    sent = spark.sparkContext.broadcast(model)
    return column_function(_score_rows, "struct<content:double,metadata:double,score:double,fitted:boolean>", lambda: sent.value)


def score_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", meta_cols: tuple[str, str, str] = ("lang", "source", "n_chars"), out_col: str = "quality_scores", **fitting: object) -> DataFrame:
    """``docs`` with ``out_col``: content, metadata and combined probability of good quality.

    Nulls count as empty text, unknown language or source, missing length; equal
    rows score equally; other columns are kept and never read.  Without six
    labels of each class no model is fitted: all scores are the share of good
    labels (null without any) and ``fitted`` is false.  An empty table gives an
    empty one.  Scoring is narrow.
    """
    model = fit(docs, labels, text_col=text_col, meta_cols=meta_cols, **fitting)
    lang, source, length = (F.col(c) for c in meta_cols)
    return docs.withColumn(out_col, scorer(docs.sparkSession, model)(F.col(text_col), lang, source, length.cast("double")))


def accepted(scores: str = "quality_scores", below: float = REJECT_BELOW) -> Column:
    """Not rejected: scored ``below`` or more, or any document where no model could be fitted, as nothing tells them apart."""
    return ~F.col(f"{scores}.fitted") | (F.col(f"{scores}.score") >= below)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, and whether each is accepted."""
    scored = score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.col("quality_scores.content").alias("content_score"), F.col("quality_scores.metadata").alias("metadata_score"), F.col("quality_scores.score").alias("score"), accepted().alias("accepted"))
