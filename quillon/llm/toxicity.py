"""Toxicity by compression distance: zstandard dictionaries of toxic and ordinary text."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import keyed, kind_of, map_columns, read

#: Labelled rows of each class that may be gathered for training, and UTF-8 bytes of them.
SAMPLE_ROWS = 4_000
SAMPLE_BYTES = 40_000_000
#: Scores from here on count as toxic.
THRESHOLD = 0.7

_WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


@dataclass
class Settings:
    #: Bytes of a window at least; windows end at a word's end.  Shorter ones often don't compress at all.
    window: int = 96
    #: Bytes of the two dictionaries, the toxic one's before it is pruned.
    ordinary_bytes: int = 32_768
    toxic_bytes: int = 32_768
    #: Windows, drawn at random, that a dictionary is trained on at most.
    training_windows: int = 40_000
    #: Length of the stretches by which the toxic dictionary is pruned.
    gram: int = 6
    #: Toxic texts that a stretch must be in, and how many times its share of ordinary texts.
    least_texts: int = 5
    least_ratio: float = 20.0
    level: int = 6
    min_match: int = 5
    seed: int = 0


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words, each with a space in front; ASCII other than letters separates."""
    return [b" " + w for w in _WORD.findall((text or "").lower().encode())]


def windows_of(text: str | None, size: int) -> list[bytes]:
    """The whole text as windows of whole words."""
    out, parts, n = [], [], 0
    for word in words_of(text):
        parts.append(word)
        n += len(word)
        if n >= size:
            out.append(b"".join(parts) + b" ")
            parts, n = [], 0
    if parts:
        out.append(b"".join(parts) + b" ")
    return out


@dataclass
class Model:
    """Two dictionaries and the calibration of their difference.

    Both compressors share the ordinary dictionary at the same distance; behind
    it one has the toxic dictionary and the other as many zero bytes.  So an
    ordinary window takes equal lengths under both, and what it gains under the
    toxic one is its closeness to toxic text.
    """

    ordinary: bytes
    toxic: bytes
    settings: Settings = field(default_factory=Settings)
    weights: list[float] = field(default_factory=list)
    means: list[float] = field(default_factory=list)
    scales: list[float] = field(default_factory=list)
    #: The least and greatest value of each feature in calibration: none counts beyond them.
    bounds: list[tuple[float, float]] = field(default_factory=list)
    #: The share of toxic rows: the most that a text without any gain scores.
    prior: float = 1.0

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        def one(content: bytes) -> zstandard.ZstdCompressor:
            s = self.settings
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            parameters = zstandard.ZstdCompressionParameters.from_level(
                s.level, dict_size=len(self.ordinary) + len(self.toxic), source_size=s.window + 16, min_match=s.min_match, write_content_size=0, write_checksum=0, write_dict_id=0
            )
            return zstandard.ZstdCompressor(compression_params=parameters, dict_data=dictionary)

        return one(self.ordinary + bytes(len(self.toxic))), one(self.ordinary + self.toxic)

    def features(self, text: str | None, compressors: tuple) -> list[float]:
        """Of the windows' gains in bytes: the three largest, and how many are large."""
        ordinary, toxic = (c.compress for c in compressors)
        gains = sorted((len(ordinary(w)) - len(toxic(w)) for w in windows_of(text, self.settings.window)), reverse=True)
        top = [max(0, g) for g in gains[:3]] + [0] * (3 - len(gains[:3]))
        strong = sum(1 for g in gains if g >= 4)
        return [top[0], top[1], top[2], math.log1p(strong), math.log1p(strong) / math.log(len(gains) + 2), math.log(len(gains) + 1)]

    def score(self, features: list[float]) -> float:
        z = self.weights[0]
        for weight, feature, mean, scale, (low, high) in zip(self.weights[1:], features, self.means, self.scales, self.bounds, strict=True):
            z += weight * (min(max(feature, low), high) - mean) / scale
        out = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        return out if features[0] > 0 else min(out, self.prior)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first weight is the intercept."""
    a = np.hstack([np.ones((len(x), 1)), x])
    weight = np.ones(len(x)) if weight is None else weight
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge * weight.sum())
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9), gradient)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(size: int, samples: list[bytes], k: int, d: int, level: int) -> bytes:
    """A trained dictionary; samples too few to train on are themselves the dictionary."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d, level=level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:] or b" "


def _grams(word: bytes, size: int) -> set[bytes]:
    return {word[i : i + size] for i in range(len(word) - size + 1)}


def _pruned(trained: bytes, toxic: list[str | None], ordinary: list[str | None], s: Settings) -> bytes:
    """A dictionary trained on toxic text without what ordinary text has as well.

    Such text has mostly ordinary words, whose chance matches would drown the gains
    of the others.  Of each word in the dictionary the stretch stays whose ends are
    in ``least_ratio`` times the share of toxic texts that ordinary ones have them in.
    """
    words = [b" " + w + b" " for w in dict.fromkeys(_WORD.findall(trained))]
    known: set[bytes] = set().union(*(_grams(w, s.gram) for w in words))

    def texts_with(texts: list[str | None]) -> Counter:
        return Counter(g for t in texts for g in set().union(*(_grams(w + b" ", s.gram) for w in set(words_of(t)))) & known)

    in_toxic, in_ordinary = texts_with(toxic), texts_with(ordinary)
    marked = {g for g, c in in_toxic.items() if c >= min(s.least_texts, len(toxic)) and c / len(toxic) >= s.least_ratio * (in_ordinary[g] + 0.5) / len(ordinary)}
    kept = []
    for word in words:
        places = [i for i in range(len(word) - s.gram + 1) if word[i : i + s.gram] in marked]
        if places:
            kept.append(word[places[0] : places[-1] + s.gram])
    whole = [k for k in dict.fromkeys(kept) if not any(k != other and k in other for other in kept)]
    return b"".join(whole) or b" "


def train(rows: list[tuple[str | None, int]], ratio: float = 1.0, settings: Settings | None = None) -> Model:
    """Dictionaries from two thirds of the labelled texts, calibration from the others.

    ``ratio``: how many ordinary rows there are to a toxic one where scores are used.

    The toxic dictionary is trained on windows of toxic texts, and loses what
    ordinary texts have too.  Without both classes every score is the share of
    toxic labels (0 without any).
    """
    s = settings or Settings()
    shuffled = list(rows)
    random.Random(s.seed).shuffle(shuffled)
    toxic = [t for t, y in shuffled if y]
    ordinary = [t for t, y in shuffled if not y]
    if min(len(toxic), len(ordinary)) < 4:
        share = len(toxic) / len(rows) if rows else 0.0
        return Model(b" ", b" ", s, [math.log(max(share, 1e-9) / max(1 - share, 1e-9))] + [0.0] * 6, [0.0] * 6, [1.0] * 6, [(0.0, 0.0)] * 6)
    cut = {True: 2 * len(toxic) // 3, False: 2 * len(ordinary) // 3}
    learn_toxic, learn_ordinary = toxic[: cut[True]], ordinary[: cut[False]]

    def drawn(texts: list[str | None]) -> list[bytes]:
        found = [w for t in texts for w in windows_of(t, s.window)]
        random.Random(s.seed).shuffle(found)
        return found[: s.training_windows]

    # The dictionaries, each trained on windows of its class.
    model = Model(_dictionary(s.ordinary_bytes, drawn(learn_ordinary), 64, 8, s.level), _dictionary(s.toxic_bytes, drawn(learn_toxic), 16, 6, s.level), s)
    model.toxic = _pruned(model.toxic, learn_toxic, learn_ordinary, s)
    compressors = model.compressors()
    held = [(t, 1) for t in toxic[cut[True] :]] + [(t, 0) for t in ordinary[cut[False] :]]
    x = np.array([model.features(t, compressors) for t, _ in held])
    y = np.array([v for _, v in held], float)
    means, scales = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.means, model.scales = means.tolist(), scales.tolist()
    model.bounds = list(zip(x.min(axis=0).tolist(), x.max(axis=0).tolist(), strict=True))
    model.prior = 1 / (1 + ratio)
    weight = np.where(y == 1, 1.0, ratio * y.sum() / (1 - y).sum())
    model.weights = logistic((x - means) / scales, y, weight, ridge=1e-4).tolist()
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, total_bytes: int) -> tuple[list[tuple[str | None, int]], float]:
    """At most ``rows`` labelled texts of each class and ``total_bytes`` in all; how many ordinary rows there are to a toxic one.

    The rows of least hash of the id; ids and labels choose them before any text
    is gathered.  An id with several labels counts once, as toxic if any says so.  Each class has half of the bytes; a text that no longer fits is
    skipped.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col) > 0).cast("int").alias("y"))
    counts = dict(known.groupBy("y").count().collect())
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows) for y in (0, 1)]
    texts = keyed(docs, id_col, text_col).join(F.broadcast(parts[0].unionByName(parts[1])), "id").select("id", "y", "text")
    out, left = [], {0: total_bytes // 2, 1: total_bytes // 2}
    for doc, y, text in texts.orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).toLocalIterator():
        size = len((text or "").encode())
        if size <= left[y]:
            left[y] -= size
            out.append((doc, text or "", y))
    return [(t, y) for _, t, y in sorted(out)], counts.get(0, 0) / max(1, counts.get(1, 0))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings | None = None, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``id, score``: how likely each row's whole text is toxic, from 0 to 1.

    Trained on the driver on a bounded sample of labelled rows (``sample_rows``
    of each class, ``sample_bytes`` in all); scoring is narrow and row by row.
    Only the text is input: null and empty texts score as texts without
    windows, equal texts equally.  Rows with null labels or ids are no labels;
    without labels every score is 0 or nearly so.  An empty table gives an empty
    one.
    """
    rows, ratio = labelled_sample(docs, labels, id_col, text_col, label_col, sample_rows, sample_bytes)
    model = train(rows, ratio, settings)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def state() -> tuple:
        return sent.value, sent.value.compressors()

    def run(own: tuple, x: dict) -> dict:
        model, compressors = own
        return {"id": x["id"], "score": [model.score(model.features(t, compressors)) for t in x["text"]]}

    rows = keyed(docs, id_col, text_col)
    return map_columns(rows, run, f"id {kind_of(rows, 'id')}, score double", state)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from labels whose ids are not held out."""
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    labels = read(spark, sf_dir, "labels").where(~held_out)
    scored = score_toxicity(read(spark, sf_dir, "documents"), labels).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
