"""Exact duplicates within sizes: classes of equal content, a reference for each, and the plan.

Only files of sizes that occur twice are hashed; the text itself is never
shuffled.  A class's reference is an aggregate (smallest by bytes of the path,
then path) that is joined back on (size, hash): a frequent content is split like
any skewed join, where a window would put it into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import survey


def candidate_files(files: DataFrame, targets: DataFrame) -> DataFrame:
    return files.join(targets.select("size"), "size", "left_semi")


def candidate_paths(files: DataFrame, targets: DataFrame, most: int = 1000) -> DataFrame:
    """Paths of each target size in parts of about `most`, dealt by a hash of the path: a size that very many
    files share is neither one row nor one task.  targets: size, count."""
    parts = targets.select("size", F.ceil(F.col("count") / most).alias("parts"))
    place = F.conv(F.substring(F.md5("path"), 1, 8), 16, 10).cast("long")
    dealt = files.select("size", "path").join(parts, "size").withColumn("part", F.pmod(place, "parts"))
    found = dealt.groupBy("size", "part").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return found.select("size", "part", F.size("paths").cast("long").alias("files"), F.concat_ws(",", "paths").alias("paths"))


def hashed(files: DataFrame) -> DataFrame:
    """Adds sha, drops the content."""
    return files.withColumn("sha", F.sha2("content", 256)).drop("content")


def classes(files: DataFrame, *carried: str) -> DataFrame:
    """size, sha, members, src (the reference's path), and the reference's columns in carried as ref_ and their name."""
    order = F.struct(F.octet_length("path").alias("n"), F.col("path").alias("path"), *carried)
    found = files.groupBy("size", "sha").agg(F.count("*").alias("members"), F.min(order).alias("first"))
    return found.select("size", "sha", "members", F.col("first.path").alias("src"), *(F.col(f"first.{c}").alias(f"ref_{c}") for c in carried))


def content_groups(files: DataFrame) -> DataFrame:
    """Of each size: distinct contents, files, files that are copies."""
    return classes(files).groupBy("size").agg(
        F.count("*").alias("contents"), F.sum("members").alias("files"), F.sum(F.col("members") - 1).alias("copies")
    )


def pairs(files: DataFrame) -> DataFrame:
    """Equal files as pairs of a class's reference and each other member: n - 1 for n files, all others follow."""
    found = classes(files).where("members > 1").select("size", "sha", "src")
    return files.select("size", "sha", "path").join(found, ["size", "sha"]).where("path <> src").select("size", F.col("src").alias("path_a"), F.col("path").alias("path_b"))


def judged(files: DataFrame) -> DataFrame:
    """All files with the reference of their class and an action: reference, already (same inode or known and
    equal extents as the reference's) or dedup.  Columns ino and extents may be missing."""
    known = [c for c in ("ino", "extents") if c in files.columns]
    own = files.join(classes(files, *known).where("members > 1").drop("members"), ["size", "sha"])
    action = F.when(F.col("path") == F.col("src"), "reference")
    if "ino" in known:
        action = action.when(F.col("ino") == F.col("ref_ino"), "already")
    if "extents" in known:
        both = F.col("extents").isNotNull() & F.col("ref_extents").isNotNull()
        action = action.when(both & S.same_extents("extents", "ref_extents"), "already")
    return own.withColumn("action", action.otherwise("dedup")).drop(*(f"ref_{c}" for c in known))


def with_failures(actions: DataFrame, failures: DataFrame) -> DataFrame:
    """What judged gave, after an executor has carried out the plan: planned files that failed get the action
    error and their message in err.  failures: path, err, a row for each file that failed."""
    first = failures.groupBy(F.col("path").alias("failed")).agg(F.min("err").alias("err"))
    both = actions.join(first, actions["path"] == first["failed"], "left")
    failed = (F.col("action") == "dedup") & F.col("failed").isNotNull()
    return both.withColumn("action", F.when(failed, "error").otherwise(F.col("action"))).drop("failed")


def errors_of(outcome: DataFrame, mode: str = "reflink") -> DataFrame:
    """size, mode, err, src_path, dst_path of the files that failed.  outcome: of with_failures."""
    failed = outcome.where("action = 'error'")
    return failed.select("size", F.lit(mode).alias("mode"), F.coalesce("err", F.lit("")).alias("err"), F.col("src").alias("src_path"), F.col("path").alias("dst_path"))


def error_sizes(outcome: DataFrame) -> DataFrame:
    """Sizes in which something failed; they aren't remembered as done."""
    return outcome.where("action = 'error'").select("size").distinct()


def plan(files: DataFrame, mode: str = "reflink") -> DataFrame:
    """src, dst, size, mode: each dst once, no src is a dst."""
    return judged(files).where("action = 'dedup'").select("src", F.col("path").alias("dst"), "size", F.lit(mode).alias("mode"))


def plan_lines(actions: DataFrame, raw: bool = False) -> DataFrame:
    return actions.select(F.concat(F.lit("[dry-run] dedup: "), "dst", F.lit(" -> "), "src", F.lit(" ("), S.format_size("size", raw), F.lit(")")).alias("line"))


def verbose_lines(actions: DataFrame) -> DataFrame:
    return actions.select(F.concat(F.lit("    "), "dst", F.lit(" -> "), "src").alias("line"))


def _measures() -> list:
    dedup, already = F.col("action") == "dedup", F.col("action") == "already"
    return [
        F.coalesce(F.sum(F.when(dedup, F.col("size"))), F.lit(0)).cast("long").alias("bytes_saved"),
        F.count_if(dedup).alias("files_deduped"),
        F.count_if(already).alias("already_deduped"),
        F.count_if(F.col("action") == "error").alias("errors"),
    ]


def outcome_stats(outcome: DataFrame) -> DataFrame:
    """Measures of what judged or with_failures gave."""
    return outcome.agg(*_measures())


def stats(files: DataFrame) -> DataFrame:
    return outcome_stats(judged(files))


def outcome_group_stats(outcome: DataFrame) -> DataFrame:
    """Measures by size, sizes without any action left out."""
    return outcome.groupBy("size").agg(*_measures()).where("files_deduped + already_deduped + errors > 0")


def group_stats(files: DataFrame) -> DataFrame:
    return outcome_group_stats(judged(files))


def idle_groups(files: DataFrame) -> DataFrame:
    """Number of candidate sizes in which nothing is to do."""
    by_size = content_groups(files)
    return by_size.agg(F.count_if(F.col("copies") == 0).alias("idle_groups"), F.count("*").alias("groups"))


def verify(actions: DataFrame, files: DataFrame) -> DataFrame:
    """Planned pairs whose contents differ: must be 0."""
    left = files.select(F.col("path").alias("src"), F.col("sha").alias("src_sha"))
    right = files.select(F.col("path").alias("dst"), F.col("sha").alias("dst_sha"))
    joined = actions.join(left, "src").join(right, "dst")
    return joined.agg(F.count("*").alias("checked"), F.count_if(F.col("src_sha") != F.col("dst_sha")).alias("mismatches"))


def savings_gap(files: DataFrame) -> DataFrame:
    """What the survey promised of each candidate size against what equal contents give."""
    promised = survey.candidates(survey.size_survey(files))
    real = content_groups(files).select("size", (F.col("size") * F.col("copies")).alias("saved"))
    return promised.join(real, "size").select("size", F.col("savings").alias("promised"), "saved", (F.col("savings") - F.col("saved")).alias("gap"))
