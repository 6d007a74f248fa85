"""Sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh, partitions, read, written

SHARDS = 16
ROUNDS = 6


def round_function(half: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit mix of one half and a round key (wrapping arithmetic)."""
    x = (half + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def round_keys(seed: int) -> list[int]:
    return [(seed * 0x2545F4914F6CDD1D + (r + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1) for r in range(ROUNDS)]


def permute(numbers: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Permutation of 0..n-1, keyed by ``seed``.

    A balanced Feistel network over the least even number of bits that holds
    n - 1; values outside 0..n-1 are walked along their cycle until they come
    back inside, which takes fewer than four steps on average.
    """
    if n <= 1:
        return np.zeros(len(numbers), np.int64)
    bits = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(bits)) - 1)
    keys = round_keys(seed)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> bits, x & mask
        for key in keys:
            left, right = right, left ^ (round_function(right, key) & mask)
        return (left << bits) | right

    out = once(np.asarray(numbers).astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def numbered(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """``df`` with gapless global row numbers from 0, in the order of ``order``.

    Range partitions are sorted and written; one count for each partition goes
    to the driver, whose sums are the partitions' offsets.  No task holds more
    than its range, and the numbers depend on the rows alone.
    """
    spark = df.sparkSession
    place, part, offset = fresh(df, "_place", "_part", "_offset")
    placed = written(
        df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()),
        "numbered",
    )
    placed = placed.withColumn(part, F.shiftright(place, 33))
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part).count().collect())
    offsets, total = [], 0
    for p, c in counts:
        offsets.append((p, total))
        total += c
    # A row for each partition: no more than there are shuffle partitions.
    table = spark.createDataFrame(offsets, f"{part} bigint, {offset} bigint")
    number = F.col(offset) + F.col(place).bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(table), part).withColumn(name, number).drop(place, part, offset)


def shard(df: DataFrame, order: list[str], shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """Add ``row_number``, ``shard`` and ``slot``: shuffled row p is slot p // shards of shard p % shards.

    Counts of the shards differ by one at most and slots have no gaps.  The same
    rows give the same places at every number of partitions.  Null keys sort
    first; rows equal in all of ``order`` take neighbouring numbers, and which
    of them takes which can't be told from outside unless they differ in a
    column outside ``order``.  An empty table gives an empty one.
    """
    if clash := {"row_number", "shard", "slot"} & {c.lower() for c in df.columns}:
        raise ValueError(f"rename the columns {sorted(clash)} first")
    rows = numbered(df, order)
    n = (rows.agg(F.max("row_number")).first()[0] or 0) + 1

    @F.pandas_udf("bigint")
    def shuffled(numbers: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in numbers:
            yield pd.Series(permute(x.to_numpy(), n, seed))

    (p,) = fresh(rows, "_p")
    return rows.withColumn(p, shuffled("row_number")).withColumns({"shard": (F.col(p) % shards).cast("int"), "slot": F.expr(f"`{p}` div {shards}")}).drop(p)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law ``rows``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shard(sized, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _sql() -> str:
    """The permutation again in SQL: one pass over the rounds for each step of the walk; CRC-32 byte by byte."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    crc = f"[{', '.join(map(str, table))}]"
    wrap = f"CAST({2**64} AS UHUGEINT)"
    source = "SELECT i, n, bits, k, v >> bits AS l, v & mask AS r, mask FROM walk WHERE k = 0 OR v >= n"
    for key in round_keys(0):
        x = f"CAST((CAST((CAST(r AS UHUGEINT) + {key}) % {wrap} AS UHUGEINT) * CAST({0x9E3779B97F4A7C15} AS UHUGEINT)) % {wrap} AS UBIGINT)"
        source = f"SELECT i, n, bits, k, mask, r AS l, {x} AS x, l AS old FROM ({source})"
        source = f"SELECT i, n, bits, k, mask, l, old, CAST((CAST(xor(x, x >> CAST(31 AS UBIGINT)) AS UHUGEINT) * CAST({0xD6E8FEB86659FD93} AS UHUGEINT)) % {wrap} AS UBIGINT) AS x FROM ({source})"
        source = f"SELECT i, n, bits, k, mask, l, xor(old, xor(x, x >> CAST(29 AS UBIGINT)) & mask) AS r FROM ({source})"
    return f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, (SELECT count(*) FROM documents) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents
), summed AS (
  SELECT doc_id, size, n, xor(list_reduce(list_transform(range(0, size), lambda k: CASE WHEN k = 0 THEN 4294967295 ELSE CAST('0x' || substr(h, 2 * k - 1, 2) AS BIGINT) END),
    lambda c, b: xor(c >> 8, ({crc})[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295) AS text_crc32 FROM sized
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS i, CAST(greatest(1, (length(bin(greatest(n - 1, 1))) + 1) // 2) AS UBIGINT) AS bits FROM summed
), walk AS (
  SELECT i, CAST(n AS UBIGINT) AS n, bits, 0 AS k, CAST(i AS UBIGINT) AS v, (CAST(1 AS UBIGINT) << bits) - CAST(1 AS UBIGINT) AS mask FROM numbered
  UNION ALL
  SELECT i, n, bits, k + 1, (l << bits) | r, mask FROM ({source})
), done AS (SELECT i, v FROM walk WHERE k > 0 AND v < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(v % {SHARDS} AS INT) AS shard, CAST(v // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM numbered JOIN done USING (i)
"""


OP7_SQL = _sql()
