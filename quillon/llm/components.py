"""Connected components of a link table, without gathering it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import remove, written


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(x, y)``; ``component`` is one of its nodes.

    Contraction: each round every node goes to the neighbour (or itself) of least
    salted hash, links move along and loops go, until no links are left; then the
    moves are followed from the last round back.  A fresh salt in each round
    makes long chains shrink by a constant share as well.  Every round's tables
    are written, so lost executors cost one round.  Links to null are ignored; an
    empty table gives an empty one.
    """
    edges = written(links.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "links")
    moves: list[DataFrame] = []
    salt = 0
    while not edges.isEmpty():
        salt += 1

        def rank(c: str, salt: int = salt) -> object:
            return F.struct(F.xxhash64(F.lit(salt), F.col(c)).alias("h"), F.col(c).alias("n"))

        both = edges.select("x", rank("y").alias("r")).unionByName(edges.select(F.col("y").alias("x"), rank("x").alias("r")))
        move = written(both.groupBy("x").agg(F.min("r").alias("r")).select(F.col("x").alias("node"), F.least(F.col("r"), rank("x")).getField("n").alias("to")), "moves")
        moved = edges.join(move.select(F.col("node").alias("x"), F.col("to").alias("a")), "x").join(move.select(F.col("node").alias("y"), F.col("to").alias("b")), "y")
        after = written(moved.where("a <> b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct(), "links")
        remove(edges.sparkSession, edges)
        edges = after
        moves.append(move)
    if not moves:
        return edges.select(F.col("x").alias("node"), F.col("y").alias("component"))
    out = moves[-1].select("node", F.col("to").alias("component"))
    for move in reversed(moves[:-1]):
        later = out.select(F.col("node").alias("to"), "component")
        out = move.join(later, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    out = written(out, "components")
    for move in moves:
        remove(edges.sparkSession, move)
    return out
