"""What a run need not do again: sizes whose fingerprint hasn't changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import survey


def changed(targets: DataFrame, prints: DataFrame, cache: DataFrame) -> DataFrame:
    """Targets whose (size, fp) isn't in the cache."""
    return targets.join(prints, "size").join(cache, ["size", "fp"], "left_anti")


def skipped(targets: DataFrame, prints: DataFrame, cache: DataFrame) -> DataFrame:
    return targets.join(prints, "size").join(cache, ["size", "fp"], "left_semi").agg(F.count("*").alias("skipped"))


def next_targets(survey_table: DataFrame, prints: DataFrame, cache: DataFrame, n: int) -> DataFrame:
    """The cache is applied before the limit: unchanged sizes take no place among the n."""
    rest = changed(survey.candidates(survey_table), prints, cache)
    return rest.orderBy(F.desc("savings"), F.desc("size")).limit(n)


def pruned(cache: DataFrame, survey_table: DataFrame) -> DataFrame:
    """Cache rows of sizes that still occur."""
    return cache.join(survey_table.select("size"), "size", "left_semi")


def merged(cache: DataFrame, done: DataFrame) -> DataFrame:
    """New fingerprints win over old ones."""
    new = done.select("size", F.col("fp").alias("new_fp"))
    return cache.join(new, "size", "full_outer").select("size", F.coalesce("new_fp", "fp").alias("fp"))
