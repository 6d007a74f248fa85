"""Expressed shares kept up to date over a stream of events (beyond the core)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import shared_folder


def pairs(events: DataFrame) -> DataFrame:
    """``gene, cell``: what each event says is expressed; once each."""
    gene = F.concat_ws("-", "event_type", F.hour("ts").cast("string"))
    return events.select(gene.alias("gene"), F.col("user_id").alias("cell")).dropDuplicates(["gene", "cell"])


def expressed_shares(spark: SparkSession, path: str) -> DataFrame:
    """``gene, pct`` after all that stands under ``path`` has streamed through a deduplicating state.

    The stream's pairs are written to the shared checkpoint folder, like its
    progress.  The state has an entry for each pair, as many as the result counts:
    which users ever did what, so that no watermark may forget one.
    """
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    out = os.path.join(shared_folder(spark), f"pairs-{uuid.uuid4().hex}")
    kept = pairs(stream)
    query = kept.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start(out)
    query.awaitTermination()
    found = spark.read.schema(kept.schema).parquet(out)
    n = found.select("cell").distinct().count()
    return found.groupBy("gene").agg((F.count("*") / F.lit(n)).alias("pct"))
