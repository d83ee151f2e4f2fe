"""Connected components of a table of links, by alternating stars.

A bounded number of links is settled in one task.  Beyond it, each round hangs
the larger neighbours of every node, then the smaller ones, on the smallest;
after a number of rounds that grows with the logarithm of the nodes every edge
joins a node to the smallest of its component.  A node's neighbours are never
gathered: their smallest is an aggregate that is joined back.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, stored

LOCAL = 300_000  # links of at most 40 bytes that one task may settle


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _settle(kind: pa.DataType):
    """The result for all links at once, in one task."""

    def run(batches):
        up: dict = {}

        def root(x):
            while (above := up.setdefault(x, x)) != x:
                up[x] = x = up[above]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
        found = [(x, r) for x in list(up) if (r := root(x)) != x]
        for i in range(0, len(found), 50_000):
            ids, labels = zip(*found[i : i + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(labels, kind)], names=["id", "label"])

    return run


def components(links: DataFrame, local: int = LOCAL) -> DataFrame:
    """links: a, b of one ordered type, long or binary.  Returns id, label for every linked node but the
    smallest of each component; label is that smallest node.  Up to local distinct links are one task's work."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, path = stored(edges, "links")
    before = _state(edges)
    if 0 < before[0] <= local:
        kind = edges.schema["a"].dataType.simpleString()
        settled = edges.coalesce(1).mapInArrow(_settle(pa.int64() if kind == "bigint" else pa.binary()), f"id {kind}, label {kind}")
        out, _ = stored(settled, "stars")
        remove(edges.sparkSession, path)
        return out
    while before[0]:
        now, new_path = stored(_small_star(_large_star(edges)), "stars")
        after = _state(now)
        remove(edges.sparkSession, path)
        edges, path = now, new_path
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label"))
