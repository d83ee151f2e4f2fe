"""Any relation as files: path, dir, name, size, content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents as a tree /source/lang/doc_id.txt.  Only the columns that a query uses are read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = F.concat(F.lit("/"), "source", F.lit("/"), "lang")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(
        "doc_id",
        "source",
        "lang",
        F.concat(folder, F.lit("/"), name).alias("path"),
        folder.alias("dir"),
        name.alias("name"),
        F.octet_length("text").cast("long").alias("size"),
        F.col("text").alias("content"),
    )


def with_shared_inode(files: DataFrame) -> DataFrame:
    """Adds ino: equal contents of one source share it, as hard links do."""
    files = files if "sha" in files.columns else files.withColumn("sha", F.sha2("content", 256))
    first = files.groupBy("source", "sha").agg(F.min("doc_id").alias("ino"))
    return files.join(first, ["source", "sha"])


def with_shared_extents(files: DataFrame) -> DataFrame:
    """Adds extents: equal contents of one language lie in one place, as after a reflink; those of the source
    that sorts first have none that are known.  files: hashed, with lang."""
    first = files.groupBy("lang", "sha").agg(F.min("doc_id").alias("place"))
    unknown = files.agg(F.min("source").alias("unknown"))
    extent = F.struct(F.lit(0).cast("long").alias("logical"), F.col("place").alias("physical"), F.col("size").alias("length"), F.lit(0).cast("long").alias("flags"))
    placed = files.join(first, ["lang", "sha"]).join(unknown, F.col("source") == F.col("unknown"), "left")
    return placed.withColumn("extents", F.when(F.col("unknown").isNull(), F.array(extent))).drop("place", "unknown")
