"""Benchmark decontamination with a generalised suffix automaton over words."""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import column_function, fresh, read, written

WINDOW = 10
#: UTF-8 bytes of the test items in one automaton: the bound on what is gathered
#: and broadcast at once.  Larger test sets are applied block after block.  An
#: automaton takes some 30 bytes for each of them.
BLOCK_BYTES = 6_000_000

#: A-Z to lower case; other ASCII than letters and digits to a space; bytes from 128 stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

LEAKS = "struct<n_words:bigint,spans:array<struct<start:int,end:int>>,items:array<string>>"


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text as UTF-8; null has none."""
    return text.encode().translate(FOLD).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton of the items' words.

    A state stands for the substrings that share their end positions: ``length``
    is the longest of them, ``link`` the state of the longest shorter suffix.
    Most states have one transition, held in arrays (``only``, ``goal``); those
    with more have a dict in ``branch``.  An item's windows are its runs of
    ``window`` words, or the whole item where it is shorter (but not empty).
    ``owner`` has the item of a state's window of full length where that is all
    its windows; other states' windows are in ``more``, as length to items.
    ``nearest`` is the first state with windows on the way to the root.
    """

    NONE, MANY = -1, -2

    def __init__(self, items: Iterable[tuple[str | None, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.window = window
        self.only, self.goal = array("i", [self.NONE]), array("i", [0])
        self.branch: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.names: list[str | None] = []
        coded = []
        for item, text in items:
            if words := array("i", [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]):
                self.names.append(item)
                coded.append(words)
                last = 0
                for word in words:
                    last = self._extend(last, word)
        self.least = min((min(window, len(w)) for w in coded), default=window)
        self.owner = array("i", [self.NONE]) * len(self.link)
        self.more: dict[int, dict[int, set[int]]] = {}
        for item, words in enumerate(coded):
            size, s, n = min(window, len(words)), 0, 0
            for word in words:
                s, n = self.step(s, word), n + 1
                while self.length[self.link[s]] >= size:
                    s = self.link[s]
                    n = self.length[s]
                if n >= size:
                    self._own(s, size, item)
        self.nearest = array("i", [0]) * len(self.link)
        for s in np.argsort(np.frombuffer(self.length, np.int32), kind="stable").tolist()[1:]:
            self.nearest[s] = s if self.owner[s] != self.NONE else self.nearest[self.link[s]]

    def _own(self, s: int, size: int, item: int) -> None:
        known = self.owner[s]
        if known == self.NONE and size == self.window:
            self.owner[s] = item
        elif known != item or size != self.window:
            if known != self.MANY:
                self.more[s] = {self.window: {known}} if known != self.NONE else {}
                self.owner[s] = self.MANY
            self.more[s].setdefault(size, set()).add(item)

    def step(self, s: int, word: int) -> int | None:
        """Where ``word`` leads from a state, if anywhere."""
        if (only := self.only[s]) == word:
            return self.goal[s]
        return self.branch[s].get(word) if only == self.MANY else None

    def _lead(self, s: int, word: int, goal: int) -> None:
        only = self.only[s]
        if only == self.MANY:
            self.branch[s][word] = goal
        elif only in (self.NONE, word):
            self.only[s], self.goal[s] = word, goal
        else:
            self.branch[s] = {only: self.goal[s], word: goal}
            self.only[s] = self.MANY

    def _new(self, length: int, link: int, like: int | None = None) -> int:
        new = len(self.link)
        self.only.append(self.NONE if like is None else self.only[like])
        self.goal.append(0 if like is None else self.goal[like])
        if like in self.branch:
            self.branch[new] = dict(self.branch[like])
        self.link.append(link)
        self.length.append(length)
        return new

    def _clone(self, p: int, q: int, word: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], q)
        while p != -1 and self.step(p, word) == q:
            self._lead(p, word, clone)
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, word: int) -> int:
        if (q := self.step(last, word)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, word)
        new, p = self._new(self.length[last] + 1, 0), last
        while p != -1 and self.step(p, word) is None:
            self._lead(p, word, new)
            p = self.link[p]
        if p != -1:
            q = self.step(p, word)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word)
        return new

    def ending(self, s: int) -> Iterator[tuple[int, Iterable[int]]]:
        """Windows that are suffixes of what s stands for, longest first, with their items' places in ``names``."""
        while (s := self.nearest[s]) > 0:
            if self.owner[s] >= 0:
                yield self.window, (self.owner[s],)
            else:
                yield from sorted(self.more[s].items(), reverse=True)
            s = self.link[s]

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged word spans (end exclusive) of all windows in ``words``; their items.

        A word of no item sends the automaton to its root, so only runs of
        known words that are as long as the shortest window are streamed.
        """
        spans: list[tuple[int, int]] = []
        items: set = set()
        if len(words) < self.least or not self.vocabulary:
            return spans, items
        ids = np.fromiter(map(self.vocabulary.get, words, [-1] * len(words)), np.int32, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        step, link, length, nearest = self.step, self.link, self.length, self.nearest
        for begin, end in edges.reshape(-1, 2):
            if end - begin < self.least:
                continue
            s = n = 0
            for i, word in enumerate(ids[begin:end].tolist(), int(begin)):
                while (q := step(s, word)) is None and s:
                    s = link[s]
                    n = length[s]
                if q is None:
                    continue
                s, n = q, n + 1
                if not nearest[s]:
                    continue
                most = 0
                for size, owners in self.ending(s):
                    if size <= n:
                        most = most or size
                        items.update(owners)
                if most:
                    start = i + 1 - most
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
        return spans, {self.names[k] for k in items}


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words in ``spans`` and what stands between them."""
    raw = text.encode()
    places = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(FOLD))]
    keep, at = [], 0
    for start, end in spans:
        keep.append(raw[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*keep, raw[at:]]).decode()


def _leaks(spans: list[tuple[int, int]], found: Iterable[str | None], n_words: int) -> dict:
    return {"n_words": n_words, "spans": [{"start": s, "end": e} for s, e in spans], "items": sorted(f for f in found if f is not None)}


#: The automaton that a worker used last, kept for its next task; never more than one.
_BUILT: dict[str, SuffixAutomaton] = {}


def _automaton(key: str, sent: Broadcast, window: int) -> SuffixAutomaton:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = SuffixAutomaton(sent.value, window)
    return _BUILT[key]


def _matchers(items: DataFrame, item_id: str, item_text: str, window: int) -> list[Callable[[], SuffixAutomaton]]:
    """What gives an executor the automaton of each block of items."""
    tests = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))
    blocks = max(1, math.ceil((tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BLOCK_BYTES))
    out = []
    for b in range(blocks):
        own = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        sent = items.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in own.collect()])
        out.append(lambda sent=sent, key=uuid.uuid4().hex: _automaton(key, sent, window))
    return out


def _find(automaton: SuffixAutomaton, texts: list) -> list[dict]:
    out = []
    for words in map(words_of, texts):
        spans, found = automaton.match(words)
        out.append(_leaks(spans, found, len(words)))
    return out


def _found(docs: DataFrame, matchers: list[Callable], text_col: str, out_col: str) -> DataFrame:
    if len(matchers) == 1:
        return docs.withColumn(out_col, column_function(_find, LEAKS, matchers[0])(text_col))
    (row,) = fresh(docs, "_row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    each = [rows.select(F.col(row), column_function(_find, LEAKS, m)(text_col).alias("x")) for m in matchers]
    every = reduce(DataFrame.unionByName, each).groupBy(row).agg(F.max("x.n_words").alias("n"), F.flatten(F.collect_list("x.spans")).alias("spans"), F.flatten(F.collect_list("x.items")).alias("items"))

    def join(_: None, n: list, spans: list, found: list) -> list[dict]:
        return [_leaks(merged((s["start"], s["end"]) for s in a), set(b), c) for a, b, c in zip(spans, found, n, strict=True)]

    whole = every.select(F.col(row), column_function(join, LEAKS, lambda: None)("n", "spans", "items").alias(out_col))
    return rows.join(whole, row).drop(row)


def find_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, out_col: str = "leak") -> DataFrame:
    """``docs`` with ``out_col``: where texts repeat windows of test items, as LEAKS says.

    ``spans``: merged word spans, end exclusive; ``items``: ids as strings,
    sorted.  Null and empty texts have no words and match nothing; items without
    words match nothing; an item whose id is null matches but isn't listed.
    Repeated rows each get their own result.  An empty items table matches
    nothing.  Items up to BLOCK_BYTES: narrow, no shuffle.  Larger test sets go
    in blocks, each over all rows, whose results meet by row; a worker holds one
    block's automaton at a time.
    """
    _check(docs, out_col)
    return _found(docs, _matchers(items, item_id, item_text, window), text_col, out_col)


def _check(docs: DataFrame, name: str) -> None:
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {name}; give another name")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", max_coverage: float = 0.5, min_words: int = WINDOW, window: int = WINDOW, coverage_col: str = "coverage", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the spans that test items share, and ``coverage_col``, the share of words cut.

    Spans of at least ``min_words`` words, and whole items of less than a window,
    are cut out of the text; a document goes where they are more than
    ``max_coverage`` of its words.  Other rows come back as they were, with all
    columns.  Nulls, repeats and empty tables as in ``find_leaks``.
    """
    _check(docs, coverage_col)

    def cut(text: str | None, leak: dict) -> dict:
        pairs = [(s["start"], s["end"]) for s in leak["spans"] if s["end"] - s["start"] >= min_words or s["end"] - s["start"] < window]
        share = sum(e - s for s, e in pairs) / leak["n_words"] if pairs else 0.0
        return {"text": without(text, pairs) if pairs else text, "coverage": share}

    kind, name = "struct<text:string,coverage:double>", coverage_col
    matchers = _matchers(items, item_id, item_text, window)
    if len(matchers) == 1:  # matched and cut in one go, by one worker
        cleaned = column_function(lambda a, texts: list(map(cut, texts, _find(a, texts))), kind, matchers[0])(text_col)
        rows = docs.withColumn(name, cleaned)
    else:
        (leak,) = fresh(docs, "_leak")
        found = _found(docs, matchers, text_col, leak)
        rows = found.withColumn(name, column_function(lambda _, texts, leaks: list(map(cut, texts, leaks)), kind, lambda: None)(text_col, leak)).drop(leak)
    kept = rows.where(F.col(f"{name}.coverage") <= max_coverage)
    return kept.withColumns({text_col: F.col(f"{name}.text"), name: F.col(f"{name}.coverage")})


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that windows of test items hit."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, read(spark, sf_dir, "benchmark"))
    hit = F.aggregate("leak.spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.col("leak.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("leak.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("leak.items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
items AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM occ JOIN win USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""
