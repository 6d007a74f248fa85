"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``documents``; ``n_chars`` follows the text where a stage changes
it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._common import column_function, int_lists, read, written
from quillon.llm.decontaminate import decontaminate
from quillon.llm.line_dedup import dedup_lines
from quillon.llm.ngram_join import drop_near_duplicates
from quillon.llm.quality import accepted, score_quality
from quillon.llm.tokens import encoder, token_bytes


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject: all where labels are too few to fit it."""
    scored = score_quality(docs, read(spark, sf_dir, "labels"), out_col="_quality")
    return scored.where(accepted("_quality")).drop("_quality")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines; documents of which nothing is left go."""
    cut = dedup_lines(docs, runs_col="_runs")
    blank = F.col("_runs").isNotNull() & (F.btrim("text", F.lit(" \t\r\n")) == "")
    length = F.when(F.col("_runs").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))
    return cut.where(~blank).withColumn("n_chars", length).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five words, 0.8) one row: that of least id."""
    return drop_near_duplicates(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of test items; documents that consist of them mostly go."""
    clean = decontaminate(docs, read(spark, sf_dir, "benchmark"), coverage_col="_coverage")
    length = F.when(F.col("_coverage") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their number, and the hash of the text decoded from them."""

    def state() -> tuple:
        return encoder(), token_bytes()

    def run(own: tuple, texts: list) -> pa.Array:
        coder, table = own
        ids = coder.encode([t or "" for t in texts])
        decoded = [hashlib.sha256(b"".join([table[i] for i in x.tolist()])).hexdigest() for x in ids]
        return pa.StructArray.from_arrays([int_lists(ids), pa.array(decoded, pa.string())], ["ids", "decoded"])

    coded = docs.select("doc_id", "lang", "source", column_function(run, "struct<ids:array<int>,decoded:string>", state)("text").alias("t"))
    return coded.select("doc_id", "lang", "source", F.size("t.ids").cast("bigint").alias("n_tokens"), F.col("t.ids").alias("ids"), F.col("t.decoded").alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", leaks),
    ("byte-level BPE", tokens),
]

#: SQL can't express the classifier's training or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
