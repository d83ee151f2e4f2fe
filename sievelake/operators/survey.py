"""Survey of sizes: how many files have each, and what equal ones could save."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S



def not_below(files: DataFrame, min_size: int) -> DataFrame:
    return files.where((F.col("size") > 0) & (F.col("size") >= min_size))


def without_folder(files: DataFrame, segment: str) -> DataFrame:
    """Leaves out files in any folder of that name."""
    return files.where(~F.array_contains(F.split("dir", "/"), segment))


def totals(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"), F.count_distinct("size").alias("distinct_sizes")
    )


def size_survey(files: DataFrame) -> DataFrame:
    """size, count, savings: one shuffle of partial counts."""
    by_size = files.groupBy("size").agg(F.count("*").alias("count"))
    return by_size.withColumn("savings", F.col("size") * (F.col("count") - 1))


def fingerprints(files: DataFrame, name: str = "name") -> DataFrame:
    """size, fp: the sum of the names' hashes, whatever their order."""
    return files.groupBy("size").agg(S.wrapped_sum(S.fnv1a64(name)).alias("fp"))


def candidates(survey: DataFrame) -> DataFrame:
    return survey.where("count >= 2")


def top(survey: DataFrame, n: int) -> DataFrame:
    """The n sizes that could save most; equal savings: the larger size first."""
    return candidates(survey).orderBy(F.desc("savings"), F.desc("size")).limit(n)


def ranked(targets: DataFrame) -> DataFrame:
    """Adds rank from 1.  targets: a bounded list (top-n), so one task ranks it."""
    return targets.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("savings"), F.desc("size"))).cast("long"))


def bounded(survey: DataFrame, most: int) -> DataFrame:
    """The `most` sizes with the largest savings, exact counts."""
    return survey.orderBy(F.desc("savings"), F.desc("size")).limit(most)


def target_totals(targets: DataFrame) -> DataFrame:
    return targets.agg(
        F.count("*").alias("targets"),
        F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("expected_files"),
        F.coalesce(F.sum("savings"), F.lit(0)).cast("long").alias("expected_savings"),
    )


def progress(targets: DataFrame) -> DataFrame:
    """Files done after each target, in order of rank, and the percentage of all."""
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    done, whole = F.sum("count").over(w), F.sum("count").over(every)
    return ranked(targets).select("rank", "size", "count", done.alias("done"), F.floor(done * 100 / whole).cast("long").alias("percent"))


def remainder(targets: DataFrame, shown: int = 20, raw: bool = False) -> DataFrame:
    """Rows that display leaves out, and the totals over all: more, files, savings_text."""
    whole = target_totals(targets)
    return whole.select(
        F.greatest(F.col("targets") - shown, F.lit(0)).cast("long").alias("more"), F.col("expected_files").alias("files"), S.format_size("expected_savings", raw).alias("savings_text")
    )


def display(targets: DataFrame, shown: int = 20, raw: bool = False) -> DataFrame:
    """The first rows as text."""
    return ranked(targets).where(F.col("rank") <= shown).select(
        "rank", S.format_size("size", raw).alias("size_text"), S.format_count("count").alias("count_text"), S.format_size("savings", raw).alias("savings_text")
    )


def memory_cost(files: DataFrame) -> DataFrame:
    """Bytes that holding each size's paths would take: 32 and the name for a file, 64 and the path for a folder."""
    names = files.groupBy("size").agg(F.sum(32 + F.octet_length("name")).alias("names"), F.count("*").alias("files"))
    folders = files.select("size", "dir").distinct().groupBy("size").agg(F.sum(64 + F.octet_length("dir")).alias("folders"))
    return names.join(folders, "size").select("size", "files", (F.col("names") + F.col("folders")).cast("long").alias("bytes"))


def costliest(files: DataFrame) -> DataFrame:
    """The size whose paths would take most memory; of several the largest.  No files: no row."""
    most = memory_cost(files).agg(F.max(F.struct("bytes", "size", "files")).alias("m")).where("m is not null")
    return most.select("m.size", "m.files", "m.bytes")
