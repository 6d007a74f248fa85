"""Line dedup by winnowing over line hashes; DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import fresh, read, remove, written

#: Shortest repeated run, in words, that is found: every one is, whatever its lines.
MIN_WORDS = 50

_FIRST_ID = -(2**63)


def _owner(id_col: str, text_col: str) -> tuple[Column, Column]:
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(_FIRST_ID)), F.xxhash64(F.col(text_col))


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, version, pos, line, words``: the non-blank lines; ``line`` is a 128-bit hash.

    A document is known by its id and its text's hash.
    """
    doc, version = _owner(id_col, text_col)
    lines = docs.select(doc.alias("doc"), version.alias("version"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "raw"))
    raw = F.btrim("raw", F.lit(" \t\r"))
    return lines.select(
        "doc", "version", "pos", F.struct(F.xxhash64(raw).alias("a"), F.xxhash64(F.lit(1), raw).alias("b")).alias("line"), F.regexp_count("raw", F.lit(r"\S+")).alias("words")
    ).where("words > 0")


def windows(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc, version, lo, hi, mark, at, left, right``: the least runs of ``min_words`` words or more.

    One window goes forward from each line and one back from each line, as far as
    the lines that it needs.  ``mark`` is the window's minimum, its fingerprint: the
    least line hash, which is at position ``at``.  ``left`` and ``right`` are hashes
    of the lines before it, and of it and those behind it.  A run that stands in
    two places has equal windows in both, and so equal minima at equal distances.
    """
    own = Window.partitionBy("doc", "version")
    # Rows of one text and id are one document, whose lines count once.
    rows = lines.repartition("doc", "version").dropDuplicates(["doc", "version", "pos"]).withColumn("upto", F.sum("words").over(own.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.col("upto") - F.col("words"))
    ahead = own.orderBy("before").rangeBetween(0, min_words - 1)
    back = own.orderBy("upto").rangeBetween(-(min_words - 1), 0)

    def window(frame: object) -> Column:
        return F.struct(
            F.min("pos").over(frame).alias("lo"),
            F.max("pos").over(frame).alias("hi"),
            F.sum("words").over(frame).alias("words"),
            F.collect_list("line").over(frame).alias("lines"),
            F.min(F.struct("line", "pos")).over(frame).alias("mark"),
        )

    both = rows.select("doc", "version", window(ahead).alias("f"), window(back).alias("b"))
    each = both.select("doc", "version", F.explode(F.array("f", "b")).alias("w")).where(F.col("w.words") >= min_words)
    place = F.array_position("w.lines", F.col("w.mark.line")).cast("int")
    return each.select(
        "doc",
        "version",
        "w.lo",
        "w.hi",
        F.col("w.mark.line").alias("mark"),
        F.col("w.mark.pos").alias("at"),
        F.xxhash64(F.slice("w.lines", F.lit(1), place - 1)).alias("left"),
        F.xxhash64(F.slice("w.lines", place, F.size("w.lines"))).alias("right"),
    )


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc, version, runs``: the line ranges (inclusive, from 0) of each document that stood before.

    A line belongs to a run if some stretch of lines around it has ``min_words``
    words or more and stands earlier: in a document of lower id (then lower text
    hash), or higher up in its own.

    Fingerprints that are selected at one place only go, with their windows.  The
    others' positions join: each with the first position of the same fingerprint
    from which the same lines extend to the left and to the right.  Windows reach
    out from their fingerprint to every extent that just has ``min_words`` words, so
    those that match, put together, are the match extended both ways line by line,
    against all earlier positions, without a row for each pair of positions.
    Nothing but single rows meets by fingerprint, so a join splits a frequent one.
    """
    spark = docs.sparkSession
    lines = written(line_table(docs, id_col, text_col), "lines")
    every = written(windows(lines, min_words), "windows")
    remove(spark, lines)
    position, start = F.struct("doc", "version", "at"), F.struct("doc", "version", "lo")
    marks = written(every.groupBy("mark").agg(F.min(position).alias("x"), F.max(position).alias("y")).where("x <> y").select("mark"), "marks")
    candidates = written(every.join(marks, "mark", "left_semi"), "candidates")
    remove(spark, every)
    match = ["mark", "left", "right"]
    firsts = written(candidates.groupBy(*match).agg(F.min(start).alias("x"), F.max(start).alias("y")).where("x <> y").select(*match, "x"), "firsts")
    later = candidates.join(firsts, match).where(start > F.col("x")).select("doc", "version", "lo", "hi")
    own = Window.partitionBy("doc", "version").orderBy("lo", "hi")
    reached = F.max("hi").over(own.rowsBetween(Window.unboundedPreceding, -1))
    islands = (
        later.withColumn("new", (F.coalesce(reached, F.lit(-2)) < F.col("lo") - 1).cast("int"))
        .withColumn("run", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc", "version", "run")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .groupBy("doc", "version")
        .agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs"))
    )
    out = written(islands, "runs")
    for table in (marks, candidates, firsts):
        remove(spark, table)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, runs_col: str = "runs") -> DataFrame:
    """``docs`` with later repeated runs of lines cut from its texts, and ``runs_col``, what was cut.

    Lines are equal if equal up to spaces, tabs and carriage returns at their
    ends; blank lines have no words, and go where they lie inside a run.  Of a
    run that repeats itself in place the first period stays.  A text all of
    whose lines go becomes empty; a null or empty one stays.  Rows equal in id
    and text are one document and stay equal.  Ids are whole numbers (or texts of
    them; others raise); null ids count as the lowest.
    Ranges are null where nothing was cut.  An empty table gives an empty one.
    """
    doc, version, runs_doc, runs_version = fresh(docs, "_doc", "_version", "_runs_doc", "_runs_version")
    if runs_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {runs_col}; give another runs_col")
    runs = repeated_runs(docs, id_col, text_col, min_words).select(F.col("doc").alias(runs_doc), F.col("version").alias(runs_version), F.col("runs").alias(runs_col))
    left = docs.withColumns(dict(zip((doc, version), _owner(id_col, text_col), strict=True)))
    # The runs grow with the data and have no bound, so they are never broadcast.
    joined = left.join(runs.hint("merge"), (F.col(doc) == F.col(runs_doc)) & (F.col(version) == F.col(runs_version)), "left")
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda _, i: ~F.exists(F.col(runs_col), lambda r: i.between(r["lo"], r["hi"])))
    return joined.withColumn(text_col, F.when(F.col(runs_col).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))).select(*docs.columns, runs_col)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("bigint").alias("n_lines"))
    removed = F.aggregate(F.coalesce("runs", F.array().cast("array<struct<lo:int,hi:int>>")), F.lit(0).cast("bigint"), lambda n, r: n + r["hi"] - r["lo"] + 1)
    text = F.coalesce("text", F.lit(""))
    return dedup_lines(docs).select("doc_id", "n_lines", removed.alias("n_removed"), F.length(text).cast("bigint").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))


OP10_SQL = f"""
WITH lines AS (
  SELECT doc_id, i - 1 AS pos, trim(l, E' \\t\\r') AS line, len(regexp_extract_all(l, '\\S+')) AS words
  FROM (SELECT doc_id, unnest(string_split(text, E'\\n')) AS l, generate_subscripts(string_split(text, E'\\n'), 1) AS i FROM documents)
), sums AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM lines WHERE words > 0
), places AS (
  SELECT *, upto - words AS before FROM sums
), every AS (
  SELECT doc_id, min(pos) OVER f AS lo, max(pos) OVER f AS hi, sum(words) OVER f AS words, list(md5(line)) OVER f AS content FROM places
  WINDOW f AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)
  UNION ALL
  SELECT doc_id, min(pos) OVER b, max(pos) OVER b, sum(words) OVER b, list(md5(line)) OVER b FROM places
  WINDOW b AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)
), firsts AS (
  SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, lo) AS k,
    first_value(doc_id) OVER (PARTITION BY content ORDER BY doc_id, lo) AS first_doc,
    first_value(lo) OVER (PARTITION BY content ORDER BY doc_id, lo) AS first_lo
  FROM every WHERE words >= {MIN_WORDS}
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS pos FROM firsts WHERE doc_id <> first_doc OR lo <> first_lo
), kept AS (
  SELECT d.doc_id, d.i - 1 AS pos, d.l, g.pos IS NULL AS stays
  FROM (SELECT doc_id, unnest(string_split(text, E'\\n')) AS l, generate_subscripts(string_split(text, E'\\n'), 1) AS i FROM documents) d
  LEFT JOIN gone g ON g.doc_id = d.doc_id AND g.pos = d.i - 1
), texts AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed, coalesce(string_agg(l, E'\\n' ORDER BY pos) FILTER (stays), '') AS t
  FROM kept GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CAST(length(coalesce(t, '')) AS BIGINT) AS kept_chars, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN texts USING (doc_id)
"""
