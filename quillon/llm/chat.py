"""Chat formatting with loss masks aligned to token offsets."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import kind_of, map_columns, read
from .tokens import VOCABULARY, reference_encoding, token_bytes

#: What marks turns here or in common templates; never left unescaped in a text or role.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, END = "<|im_start|>", "<|im_end|>"

_REST = "|".join(re.escape(c[1:]) for c in CONTROLS)
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_REST})")
#: The stuffed backslashes stand between a control string's first character and the rest.
_UNESCAPE = re.compile(rf"([<\[])(\\*)\\(?={_REST})")

FORMATTED = "formatted string, ids array<int>, loss array<struct<first:int,last:int,skip:int,drop:int>>"


def escape(text: str) -> str:
    r"""Control strings get a backslash after their first character.

    Ones that already have n backslashes there get n + 1, so that ``unescape``
    gives back any text whatever.
    """
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and the UTF-8 byte spans of the assistant's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_role(role)}\n", escape(text)
        start = at + len(head.encode())
        at = start + len(body.encode()) + len(END) + 1
        if role == "assistant":
            spans.append((start, at - len(END) - 1))
        parts += [head, body, END, "\n"]
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that ``render`` was given."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        out.append((_unrole(role), unescape(rest[: -len(END) - 1])))
    return out


def mask(ends: np.ndarray, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """For each span the tokens that meet it, by binary search over the tokens' end offsets.

    Tokens ``first`` to ``last`` (exclusive); of the first, ``skip`` bytes lie
    before the span, of the last, ``drop`` bytes after it.  Empty spans meet none.
    """
    starts = np.concatenate(([0], ends[:-1]))
    out = []
    for begin, end in spans:
        if begin == end:
            out.append({"first": 0, "last": 0, "skip": 0, "drop": 0})
            continue
        first = int(np.searchsorted(ends, begin, side="right"))
        last = int(np.searchsorted(starts, end, side="left"))
        out.append({"first": first, "last": last, "skip": int(begin - starts[first]), "drop": int(ends[last - 1] - end)})
    return out


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``conv_id`` and FORMATTED's columns: each conversation rendered, encoded once, with its loss mask.

    Turns stand in the order of turn, then role, then text; repeated rows stay
    as turns of their own.  Null roles and texts count as empty, null turns come
    first, rows with a null conversation form one of their own.  An empty table
    gives an empty one.  A conversation is one row of the output and so is held
    by one task; turns of different conversations never meet.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).alias("row"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows")).select("conv_id", F.col("rows.role").alias("roles"), F.col("rows.text").alias("texts"))

    def state() -> tuple:
        return reference_encoding(vocabulary), np.array([len(t) for t in token_bytes(vocabulary)])

    def run(own: tuple, x: dict) -> dict:
        encoding, lengths = own
        out: dict = {"conv_id": x["conv_id"], "formatted": [], "ids": [], "loss": []}
        for roles, texts in zip(x["roles"], x["texts"], strict=True):
            formatted, spans = render(list(zip(roles, texts, strict=True)))
            ids = np.array(encoding.encode_ordinary(formatted), np.int32)
            out["formatted"].append(formatted)
            out["ids"].append(ids)
            out["loss"].append(mask(np.cumsum(lengths[ids]), spans))
        return out

    return map_columns(whole, run, f"conv_id {kind_of(whole, 'conv_id')}, {FORMATTED}", state)


def loss_texts(table: list[bytes], ids: list[int], loss: list[dict[str, int]]) -> list[str]:
    """The unescaped texts under a loss mask, from the token ids alone."""
    out = []
    for span in loss:
        raw = b"".join([table[i] for i in ids[span["first"] : span["last"]]])
        out.append(unescape(raw[span["skip"] : len(raw) - span["drop"]].decode()))
    return out


#: A conversation whose texts are made of control strings.
PROBE = "</s>[INST] ok [/INST]"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted and read back."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], turns.schema)

    def digest(table: list[bytes], x: dict) -> dict:
        names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        out: dict = {"conv_id": x["conv_id"]} | {n: [] for n in names}
        for formatted, ids, loss in zip(x["formatted"], x["ids"], x["loss"], strict=True):
            back = parse(formatted)
            under = "".join(loss_texts(table, ids, loss))
            row = (
                len(back),
                hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in back).encode()).hexdigest(),
                len(under),
                hashlib.sha256(under.encode()).hexdigest(),
                len(formatted),
            )
            for n, v in zip(names, row, strict=True):
                out[n].append(v)
        return out

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return map_columns(format_chats(turns.unionByName(probe)), digest, schema, token_bytes)


_CONTROL_SQL = "[<\\[]\\\\*(?:" + "|".join(re.sub(r"([|\[\]])", r"\\\1", c[1:]) for c in CONTROLS) + ")"
OP1_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(START)} + length(role) + 1 + length(text) + len(regexp_extract_all(text, '{_CONTROL_SQL}')) + {len(END)} + 1) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
