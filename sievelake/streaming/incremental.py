"""Listings that arrive as a stream, kept as one survey of sizes.

Each micro-batch is summed up by size and merged into the state, so the state
grows with the distinct sizes and a batch is never gathered.  A state's version is
the number of the batch it ends with, so a batch that is replayed counts once; a
state belongs to one checkpoint, whose numbers it follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import survey
from ..sources import state

SCHEMA = "size bigint, count bigint"


def merge_batch(path: str):
    """A function for foreachBatch."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if state.version(spark, path) > number:
            return
        fresh = survey.size_survey(batch).select("size", "count")
        both = state.load(spark, path, SCHEMA).unionByName(fresh)
        state.save(both.groupBy("size").agg(F.sum("count").alias("count")), path, number + 1)

    return merge


def start(stream: DataFrame, path: str, checkpoint: str):
    """stream: size of each file that is seen."""
    return stream.writeStream.foreachBatch(merge_batch(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
