"""Helpers of the training-data operators: tables, the shared folder, files by any store."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all runs on this machine (tests), one of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("on a cluster, set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sievelake-")
        atexit.register(_remove_local, found.removeprefix("file://"))
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, in the application's own one, which goes when the application ends."""
    own = f"{shared_dir(spark)}/sievelake/{spark.sparkContext.applicationId}"
    if own not in _owned:
        _owned.add(own)
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(own)
        store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(at)
        store.deleteOnExit(at)
    return f"{own}/{name}-{uuid.uuid4().hex}"


_owned: set[str] = set()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path below the shared folder by Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes a table into the shared folder and reads it again: its lineage ends there,
    and a lost executor costs nothing of it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def file_system(path: str):
    """The store of a path and the path in it, for files that executors write themselves."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        if path.startswith("file:"):
            return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def column(name: str) -> Column:
    """A column by its plain name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [column(c) for c in df.columns]


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for further columns that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names."""
    gone = {n.lower() for n in names}
    return df.select(*(column(c) for c in df.columns if c.lower() not in gone)) if gone & {c.lower() for c in df.columns} else df


def map_columns(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """df.mapInArrow over columns of any name; run goes by their places."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, schema)


def with_columns(schema: T.StructType, **kinds: str) -> T.StructType:
    """A schema with more columns."""
    return T.StructType([*schema.fields, *(T.StructField(name, T._parse_datatype_string(kind)) for name, kind in kinds.items())])


def octets(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A string column as UTF-8, null as empty."""
    col = batch.column(column)
    if not pa.types.is_binary(col.type):
        col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
    return [x or b"" for x in col.to_pylist()]


def parts(raw: list[bytes], limit: int):
    """Ranges of a list of texts of about limit bytes, or one longer text."""
    i, n = 0, len(raw)
    while i < n:
        j, size = i, 0
        while j < n and (j == i or size + len(raw[j]) <= limit):
            size += len(raw[j])
            j += 1
        yield i, j
        i = j


def default_tokenizer(file: str) -> str:
    """Path of a public vocabulary file of the installed package."""
    import public_tokenizers

    return public_tokenizers.path(file)
