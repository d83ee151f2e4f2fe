"""The anonymised error log: one line for each kind of error, none twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

HEADER = ["# Anonymised error report: one line for each kind of error.", "# Paths are given by shape only.", "#"]


def keyed(errors: DataFrame) -> DataFrame:
    """errors: size, mode, err, src_path, dst_path."""
    return errors.select(
        S.report_key("err", "src_path", "dst_path").alias("key"),
        "size",
        "mode",
        S.sanitize_error("err").alias("err"),
        S.path_pattern("src_path").alias("src"),
        S.path_pattern("dst_path").alias("dst"),
    )


def kinds(errors: DataFrame) -> DataFrame:
    """Kinds of errors: key, errors (how many), and size, mode, err, src, dst of the first by size and shapes.
    Rows are told apart by their shapes before any key is hashed: kinds are few, rows may be many.  The key that is
    returned is an aggregate, not the grouping column: what a caller asks of it (filters, a semi or anti join) can't
    be moved below both groupings, where it would hash a key for every row."""
    shapes = errors.select("size", "mode", S.sanitize_error("err").alias("err"), S.path_pattern("src_path").alias("src"), S.path_pattern("dst_path").alias("dst"))
    by_shape = shapes.groupBy("err", "src", "dst").agg(F.count("*").alias("errors"), F.min(F.struct("size", "mode")).alias("first"))
    keyed_shapes = by_shape.select(S.shape_key("err", "src", "dst").alias("key"), "errors", "first.size", "src", "dst", "first.mode", "err")
    first = F.min(F.struct("size", "src", "dst", "mode", "err", "key"))
    by_key = keyed_shapes.groupBy("key").agg(F.sum("errors").alias("errors"), first.alias("first"))
    return by_key.select("first.key", "errors", "first.size", "first.mode", "first.err", "first.src", "first.dst")


def known_keys(lines: DataFrame) -> DataFrame:
    """lines: value.  Comments and lines below 16 bytes don't count."""
    good = lines.where(~F.col("value").startswith("#") & (F.octet_length("value") >= 16))
    return good.select(F.substring("value", 1, 16).alias("key")).distinct()


def new_entries(entries: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """Entries with a key that isn't known, the first of each key by the given order."""
    rest = entries.join(known, "key", "left_anti")
    first = F.row_number().over(Window.partitionBy("key").orderBy(*order))
    return rest.withColumn("nth", first).where("nth = 1").drop("nth")


def lines_of(entries: DataFrame, version: str, stamp) -> DataFrame:
    """The log's lines; err is quoted."""
    quoted = F.regexp_replace(F.regexp_replace("err", r"([\\\"])", r"\\$1"), "\n", r"\\n")
    return entries.select(
        F.concat_ws(
            " ", "key", S.utc_stamp(stamp), F.lit(f"v={version}"), F.concat(F.lit("size="), F.col("size").cast("string")), F.concat(F.lit("mode="), "mode"),
            F.concat(F.lit('err="'), quoted, F.lit('"')), F.concat(F.lit("src={"), "src", F.lit("}")), F.concat(F.lit("dst={"), "dst", F.lit("}")),
        ).alias("value")
    )


def append(spark: SparkSession, errors: DataFrame, path: str, version: str, stamp) -> int:
    """Appends the new kinds of errors to a local log; returns how many lines that were.  Kinds of
    errors are few: their lines are written by the driver."""
    import os

    known = known_keys(spark.read.text(path)) if os.path.exists(path) else spark.createDataFrame([], "key string")
    new = kinds(errors).join(known, "key", "left_anti").orderBy("size", "src", "dst")
    rows = [r["value"] for r in lines_of(new, version, stamp).toLocalIterator()]
    if rows:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        fresh = not os.path.exists(path)
        with open(path, "a") as f:
            f.write("\n".join([*(HEADER if fresh else []), *rows]) + "\n")
    return len(rows)
