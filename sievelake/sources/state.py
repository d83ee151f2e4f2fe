"""State that lasts between runs: fingerprints by root and size, and the count of files.

A state is a folder of numbered versions, each written whole by Spark; the largest
one that carries Spark's mark of success is the state.  So a reader sees the old
rows or the new ones and never none, on any file system that Spark can write.
A state that is missing or can't be read is an empty one.
"""

from __future__ import annotations

import fcntl
import hashlib
import os
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

FINGERPRINTS = "size bigint, fp decimal(20,0)"
META = "file_count bigint"


def _fnv(text: str) -> int:
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def cache_path(folder: str, root: str) -> str:
    return os.path.join(folder, f"{_fnv(root):016x}.gob")


def meta_path(cache: str) -> str:
    return os.path.splitext(cache)[0] + ".meta"


def report_path(folder: str, root: str) -> str:
    return os.path.join(folder, f"{_fnv(root):016x}.log")


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm.org.apache.hadoop.fs.Path


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions, in order."""
    store, at, place = _store(spark, path)
    if not store.exists(at) or not store.getFileStatus(at).isDirectory():
        return []
    names = [s.getPath().getName() for s in store.listStatus(at)]
    return sorted(int(n[2:]) for n in names if n.startswith("v-") and store.exists(place(f"{path}/{n}/_SUCCESS")))


def version(spark: SparkSession, path: str) -> int:
    """The number of the state's version; 0 where there is none."""
    return (_versions(spark, path) or [0])[-1]


def load(spark: SparkSession, path: str, schema: str = FINGERPRINTS) -> DataFrame:
    """The state at a path; empty where there is none that can be read."""
    try:
        if found := _versions(spark, path):
            rows = spark.read.schema(schema).parquet(f"{path}/v-{found[-1]:020d}")
            rows.limit(1).collect()
            return rows
    except (PySparkException, Py4JJavaError):
        pass
    return spark.createDataFrame([], schema)


def save(state: DataFrame, path: str, number: int | None = None) -> None:
    """Adds a version, by default the next one.  Its rows may come from the version before, which stays;
    older ones go."""
    spark = state.sparkSession
    store, at, place = _store(spark, path)
    if store.exists(at) and not store.getFileStatus(at).isDirectory():
        store.delete(at, False)  # not a state
    number = version(spark, path) + 1 if number is None else number
    state.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{path}/v-{number:020d}")
    for old in _versions(spark, path)[:-2]:
        store.delete(place(f"{path}/v-{old:020d}"), True)


@contextmanager
def locked(folder: str, root: str):
    """One run at a time for a root; raises BlockingIOError when another one holds it."""
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, hashlib.sha256(root.encode()).hexdigest()[:16] + ".lock"), "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)
