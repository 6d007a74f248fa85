"""Byte-level BPE by a hierarchical-bitmap rank queue, and its vocabulary."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import pairwise

import numpy as np
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import int_lists, keyed, kind_of, map_columns, read

#: The vocabulary file; a name of the public tokenizers or a path.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Strings whose ids a worker remembers in the newer and in the older half of its memory, some 250 bytes each.
REMEMBERED = 60_000
#: Longer strings are never remembered.
REMEMBERED_LENGTH = 40

#: Marks the first part of a text; other parts have no space.
FIRST = "^ "
_LOOSE_SPACE = re.compile(r" (?:\s|$)|\s |^ ")
#: Words of ASCII and Latin letters, as most parts are, with stops behind: one match of the pattern and one of the stops.
_WORD = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([.,;:!?]*)")


@lru_cache(maxsize=4)
def ranks(vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@lru_cache(maxsize=4)
def token_bytes(vocabulary: str = VOCABULARY) -> list[bytes]:
    """Rank to token bytes."""
    own = ranks(vocabulary)
    out = [b""] * (max(own.values()) + 1)
    for token, rank in own.items():
        out[rank] = token
    return out


@lru_cache(maxsize=4)
def reference_encoding(vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    """The tiktoken library's encoder of the same vocabulary, for offsets and ratios."""
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(vocabulary), special_tokens={})


class RankQueue:
    """Priority queue of merge ranks: a bucket of positions for each rank, found by three levels of bitmaps.

    A set bit of level 0 says that a rank's bucket has positions, of level 1 that
    a word of level 0 has bits, and so on; the least rank is three find-first-set
    steps away.  Buckets may hold stale positions, which the reader skips.
    """

    def __init__(self, size: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((size >> 6) + 1)
        self.mid = [0] * ((size >> 12) + 1)
        self.top = 0

    def open(self, rank: int, positions: list[int]) -> None:
        """Give a rank that has no bucket one."""
        self.buckets[rank] = positions
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, list[int]]:
        """The least rank and its positions; the queue must not be empty (``top``)."""
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = (b << 6) + (word & -word).bit_length() - 1
        bits = self.low[a]
        rank = (a << 6) + (bits & -bits).bit_length() - 1
        self.low[a] = bits = bits & (bits - 1)
        if not bits:
            self.mid[b] = word = word & (word - 1)
            if not word:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class Memory:
    """Ids (as bytes of int32) of strings that came before: a newer half that grows to REMEMBERED, and the half before it."""

    def __init__(self) -> None:
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.missing: list[str] = []

    def ready(self, lists: Iterable[list[str]]) -> Memory:
        """Have in ``newer`` all the strings that are known; the others are ``missing``."""
        self.missing = []
        for key in set().union(*lists).difference(self.newer):
            if (ids := self.older.get(key)) is not None:
                self.newer[key] = ids
            else:
                self.missing.append(key)
        return self

    def settle(self) -> None:
        """Forget long strings, and the older half once the newer one is full."""
        for key in self.missing:
            if len(key) > REMEMBERED_LENGTH:
                del self.newer[key]
        self.missing = []
        if len(self.newer) >= REMEMBERED:
            self.newer, self.older = {}, self.newer


class Encoder:
    """Encodes texts; each pre-token by merging its pair of least rank, leftmost first.

    The new pre-tokens of some texts lie end to end in one linked list, with no
    links across their borders, and share one rank queue: they are merged rank
    by rank together, which gives each the merges that it would get alone.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        own = self.ranks = ranks(vocabulary)
        self.queue = RankQueue(max(own.values()) + 1)
        self.single = np.array([own[bytes([b])] for b in range(256)])
        self.pairs = {
            (left << 32) | right: rank
            for token, rank in own.items()
            for cut in range(1, len(token))
            if (left := own.get(token[:cut])) is not None and (right := own.get(token[cut:])) is not None
        }
        self.first = np.array([self.pairs.get((int(a) << 32) | int(b), -1) for a in self.single for b in self.single])
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.parts, self.pieces = Memory(), Memory()

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of each pre-token as bytes of int32; none may be empty."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        ends = np.cumsum([len(p) for p in pieces])
        starts = ends - [len(p) for p in pieces]
        links = np.arange(1, n + 1)
        links[ends - 1] = n
        back = np.arange(-1, n - 1)
        back[starts] = -1
        waiting = np.full(n, -1)  # the rank under which a position is queued now
        if n > 1:
            waiting[:-1] = self.first[data[:-1].astype(np.int64) * 256 + data[1:]]
            waiting[ends - 1] = -1
        queued = np.flatnonzero(waiting >= 0)
        queued = queued[np.argsort(waiting[queued], kind="stable")]
        queue, get = self.queue, self.pairs.get
        borders = np.flatnonzero(np.diff(waiting[queued])) + 1
        for group in np.split(queued, borders) if len(queued) else ():
            queue.open(int(waiting[group[0]]), group.tolist())
        ids, after, before, waits = self.single[data].tolist(), links.tolist(), back.tolist(), waiting.tolist()
        buckets = queue.buckets
        while queue.top:
            rank, positions = queue.pop()
            if len(positions) > 1:
                positions.sort()
            high = rank << 32
            for i in positions:
                if waits[i] != rank:
                    continue  # stale: a neighbour was merged since
                j = after[i]
                after[i] = k = after[j]
                ids[i] = rank
                ids[j] = waits[i] = waits[j] = -1
                if k < n:
                    before[k] = i
                    if (r := get(high | ids[k])) is not None:
                        waits[i] = r
                        if (bucket := buckets.get(r)) is not None:
                            bucket.append(i)
                        else:
                            queue.open(r, [i])
                if (h := before[i]) >= 0:
                    if (r := get((ids[h] << 32) | rank)) is not None:
                        waits[h] = r
                        if (bucket := buckets.get(r)) is not None:
                            bucket.append(h)
                        else:
                            queue.open(r, [h])
                    else:
                        waits[h] = -1
        merged = np.array(ids, "<i4")
        stays = merged >= 0
        data = merged[stays].tobytes()
        cuts = [0, *(4 * np.cumsum(np.add.reduceat(stays, starts, dtype=np.int64))).tolist()]
        return [data[a:b] for a, b in pairwise(cuts)]

    def _parts(self, text: str) -> list[str]:
        """Keys of parts of a text, none of which a match of the pattern crosses.

        A match holds a space only in front or among white space; so a text can
        be cut before each space that has no white space beside it.  Such a part
        is known by what follows its space; the first by ``FIRST`` and itself.  A
        text with other spaces is one part.
        """
        if _LOOSE_SPACE.search(text):
            return [FIRST + text]
        parts = text.split(" ")
        parts[0] = FIRST + parts[0]
        return parts

    def _pieces(self, part: str) -> list[str]:
        """The matches of the pattern in a part."""
        if m := _WORD.fullmatch(part):
            return [" " + m[1], m[2]] if m[2] else [" " + part]
        return self.split(part[len(FIRST) :] if part.startswith(FIRST) else " " + part)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        cut = [self._parts(t) if t else [] for t in texts]
        parts = self.parts.ready(cut)
        pieces = {part: self._pieces(part) for part in parts.missing}
        known = self.pieces.ready(pieces.values())
        new = []
        for piece in known.missing:
            raw = piece.encode()
            if (whole := self.ranks.get(raw)) is not None:
                known.newer[piece] = whole.to_bytes(4, "little")
            else:
                new.append((piece, raw))
        if new:
            known.newer.update(zip([piece for piece, _ in new], self.merge([raw for _, raw in new]), strict=True))
        get = known.newer.__getitem__
        for part, own in pieces.items():
            parts.newer[part] = get(own[0]) if len(own) == 1 else b"".join(map(get, own))
        get = parts.newer.__getitem__
        out = [np.frombuffer(b"".join(map(get, own)), "<i4") for own in cut]
        self.pieces.settle()
        self.parts.settle()
        return out


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    return Encoder(vocabulary)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``id, ids``: the token ids of each row's whole text.

    Null and empty texts have no ids.  Each row gets its own result, repeated or
    not; an empty table gives an empty one.  No special tokens.  Narrow.
    """

    def run(own: Encoder, x: dict) -> dict:
        return {"id": x["id"], "ids": int_lists(own.encode([t or "" for t in x["text"]]))}

    rows = keyed(docs, id_col, text_col)
    return map_columns(rows, run, f"id {kind_of(rows, 'id')}, ids array<int>", lambda: encoder(vocabulary))


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``id, data``: the bytes of each row's token ids; null ids decode to nothing."""

    def run(table: list[bytes], x: dict) -> dict:
        return {"id": x["id"], "data": [b"".join([table[i] for i in ids or ()]) for ids in x["ids"]]}

    return map_columns(encoded.select("id", "ids"), run, f"id {kind_of(encoded, 'id')}, data binary", lambda: token_bytes(vocabulary))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the bytes decoded from them."""

    def tables() -> tuple[list[str], list[bytes]]:
        table = token_bytes()
        return [str(i) for i in range(len(table))], table

    def digest(own: tuple[list[str], list[bytes]], x: dict) -> dict:
        names, table = own
        out: dict = {"doc_id": x["id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for ids in x["ids"]:
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(b"".join([table[i] for i in ids])).hexdigest())
        return out

    return map_columns(encode(read(spark, sf_dir, "documents")), digest, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", tables)
