"""Secret scans: fixed patterns, and a token-efficiency test for random strings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import tiktoken
from pyspark.sql import DataFrame, SparkSession

from ._common import keyed, kind_of, map_columns, read
from .tokens import VOCABULARY, reference_encoding

#: Fixed patterns of the contract: kind, pattern, its group and that group's least length.
#: The order of kinds breaks ties of equal starts.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
KINDS = ("assign", "access", "hex", "random")

#: Unbroken strings long enough to be judged by their tokens.
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: What parts of a candidate are, from coarse to fine, where the whole isn't random.
PARTS = (re.compile(r"[^=]+"), re.compile(r"[^=/]+"), re.compile(r"[^=/_-]+"))
#: Below so many characters a token a candidate counts as random.
RATIO = 2.0
#: Lengths of hexadecimal digests: MD5 or UUID, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_IDENTIFIER = re.compile(r"[A-Za-z]*[0-9]*(?:[_/=+-]+[A-Za-z]*[0-9]*)*")
_NUMBER = re.compile(r"[0-9+/_=-]+")
#: Words in one case (a capital may lead) with separators between them and the rest.
_HEAD = re.compile(r"\A(?:[A-Z]?[a-z]{3,}|[A-Z]{3,})[=/_-]+")
_TAIL = re.compile(r"[=/_-]+(?:[A-Z]?[a-z]{3,}|[A-Z]{3,})\Z")

SPANS = "spans array<struct<kind:string,start:int,end:int>>"


def known(candidate: str) -> bool:
    """Whether a string is a digest, UUID, number or identifier.

    Digests are hexadecimal of a usual length in one case.  Identifiers are
    parts of letters, each with digits at its end at most, joined by ``_ - / + =``,
    of which at least two parts are words of three or more letters in one case
    (a capital may lead).
    """
    if _UUID.fullmatch(candidate) or _NUMBER.fullmatch(candidate):
        return True
    if len(candidate) in DIGEST_LENGTHS and _DIGEST.fullmatch(candidate):
        return True
    if not _IDENTIFIER.fullmatch(candidate):
        return False
    parts = [p.rstrip("0123456789") for p in re.split(r"[_/=+-]+", candidate) if p]
    words = [p for p in parts if len(p) >= 3 and (p.islower() or p.isupper() or p[1:].islower())]
    return len(words) >= 2 and sum(map(len, words)) >= 0.6 * len(candidate)


def random_like(candidate: str, encoding: tiktoken.Encoding, ratio: float = RATIO) -> bool:
    """Low characters a token: the vocabulary has no long token for any part.

    One-case letters without digits are words of some language rather than
    secrets and never count.
    """
    if candidate.isalpha() and (candidate.islower() or candidate.isupper() or candidate[1:].islower()):
        return False
    return len(candidate) < ratio * len(encoding.encode_ordinary(candidate)) and not known(candidate)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end, kind) of the fixed patterns, sorted."""
    out = []
    for place, (kind, pattern, group, least) in enumerate(BASE):
        if kind == "access" and "AKIA" not in text:
            continue
        out += [(m.start(), place, m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def without_words(text: str, start: int, end: int, encoding: tiktoken.Encoding, ratio: float = RATIO) -> tuple[int, int]:
    """A random stretch without the words at its ends, as long as what is left is random and long enough."""
    for edge in (_HEAD, _TAIL):
        while m := edge.search(text[start:end]):
            first, last = (start + m.end(), end) if edge is _HEAD else (start, start + m.start())
            if last - first < LEAST or not random_like(text[first:last], encoding, ratio):
                break
            start, end = first, last
    return start, end


def random_parts(text: str, start: int, end: int, encoding: tiktoken.Encoding, ratio: float = RATIO, parts: tuple[re.Pattern, ...] = PARTS) -> Iterator[tuple[int, int]]:
    """Random strings of a stretch: all of it, else its parts between ``=``, else those between ``/``, else ``-`` and ``_``.

    Words that are glued to a random string would else raise its characters a
    token.  Parts of fewer than ``LEAST`` characters are not judged by themselves.
    """
    if end - start < LEAST:
        return
    if random_like(text[start:end], encoding, ratio):
        yield without_words(text, start, end, encoding, ratio)
    elif parts:
        for m in parts[0].finditer(text, start, end):
            yield from random_parts(text, m.start(), m.end(), encoding, ratio, parts[1:])


def scan(text: str, encoding: tiktoken.Encoding, ratio: float = RATIO) -> list[tuple[int, int, int, str]]:
    """All spans of a text: the base ones, and the random strings, each found apart from the other."""
    more = [(s, len(BASE), e, "random") for m in CANDIDATE.finditer(text) for s, e in random_parts(text, m.start(), m.end(), encoding, ratio)]
    return sorted(base_spans(text) + more)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO, vocabulary: str = VOCABULARY) -> DataFrame:
    """``id, spans``, a row for each row: kind, start and end (exclusive) in code points.

    Null and empty texts have no spans.  Spans are sorted by start, then kind as
    in KINDS.  Spans of one kind are apart, those of different kinds may overlap:
    ``random`` also tells which base spans hold random strings.
    Repeated rows each get their own result; an empty table gives an empty one.
    """

    def run(encoding: tiktoken.Encoding, x: dict) -> dict:
        spans = [[{"kind": k, "start": s, "end": e} for s, _, e, k in scan(t, encoding, ratio)] if t else [] for t in x["text"]]
        return {"id": x["id"], "spans": spans}

    rows = keyed(docs, id_col, text_col)
    return map_columns(rows, run, f"id {kind_of(rows, 'id')}, {SPANS}", lambda: reference_encoding(vocabulary))


def redact(text: str, spans: list[dict]) -> str:
    """``text`` with each span replaced by its kind in brackets; of spans that meet, the first's kind."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind']}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""

    def digest(_: None, x: dict) -> dict:
        out: dict = {"doc_id": x["id"], "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": [], "n_random": []}
        for spans in x["spans"]:
            kinds = [s["kind"] for s in spans]
            for kind in KINDS:
                out[f"n_{kind}"].append(kinds.count(kind))
            said = [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans]
            out["base_sha256"].append(hashlib.sha256(",".join(t for t, k in zip(said, kinds, strict=True) if k != "random").encode()).hexdigest())
            out["spans"].append(",".join(said))
        return out

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint"
    return map_columns(find_secrets(read(spark, sf_dir, "documents")), digest, schema)
