"""A directory tree as a table: a Python data source with filters on size pushed into the scan.

Rows: path, dir, name, size, dev, ino of regular files.  Symbolic links and files
of other kinds are left out, names with a leading dot or underscore are not;
directories named .snapshots are left out below the root unless asked for;
directories that can't be read are skipped; empty files never count.
"""

from __future__ import annotations

import os
import stat
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

SCHEMA = "path string, dir string, name string, size bigint, dev bigint, ino bigint"
SNAPSHOTS = ".snapshots"
PARTS, LEVELS = 1000, 8  # parts of a scan to look for, and folders below the root to look in


@dataclass
class Part(InputPartition):
    folder: str
    deep: bool  # with all folders below, or its own files only


def scan(folder: str, least: int, snapshots: bool, deep: bool = True):
    todo = [folder]
    while todo:
        here = todo.pop()
        try:
            entries = list(os.scandir(here))
        except OSError:
            continue
        for e in entries:
            try:
                if e.is_symlink():
                    continue
                if e.is_dir(follow_symlinks=False):
                    if deep and (snapshots or e.name != SNAPSHOTS):
                        todo.append(e.path)
                    continue
                s = e.stat(follow_symlinks=False)
            except OSError:
                continue
            if stat.S_ISREG(s.st_mode) and s.st_size > 0 and s.st_size >= least:
                yield e.path, here, e.name, s.st_size, s.st_dev, s.st_ino


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.realpath(options["path"])
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        self.least = int(options.get("minsize", 0))
        self.snapshots = options.get("snapshots", "false").lower() == "true"

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("size",):
                self.least = max(self.least, int(f.value))
            elif isinstance(f, GreaterThan) and f.attribute == ("size",):
                self.least = max(self.least, int(f.value) + 1)
            else:
                yield f

    def partitions(self):
        """Folders are opened level by level until PARTS of them are known, at most LEVELS deep: a part for the
        files of each opened folder, and one for all that lies below each of the others."""
        parts, level = [], [self.root]
        for _ in range(LEVELS):
            if not level or len(parts) + len(level) >= PARTS:
                break
            below = []
            for folder in level:
                parts.append(Part(folder, False))
                try:
                    with os.scandir(folder) as entries:
                        below += [e.path for e in entries if e.is_dir(follow_symlinks=False) and (self.snapshots or e.name != SNAPSHOTS)]
                except OSError:
                    continue
            level = below
        return parts + [Part(f, True) for f in level]

    def read(self, partition):
        yield from scan(partition.folder, self.least, self.snapshots, partition.deep)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, min_size: int = 0, snapshots: bool = False) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    return spark.read.format("filetree").option("path", root).option("minsize", min_size).option("snapshots", str(snapshots).lower()).load()


#: The request for a file's extents and its layout (fixed values of the Linux interface): head of
#: start, length, flags, mapped, room, reserved; extents of logical, physical, length, 16 bytes, flags, 12 bytes.
FIEMAP, HEAD, EXTENT = 0xC020660B, "=QQLLLL", "=QQQ16xL12x"
#: Flags (fixed values): write the file out first; the last extent; one whose place isn't known (not yet
#: allocated, or within other data).
SYNC, LAST, NO_PLACE = 0x1, 0x1, 0x2 | 0x4 | 0x100 | 0x200
ROOM = 256  # extents asked for at once
EXTENTS = "array<struct<logical:bigint,physical:bigint,length:bigint,flags:bigint>>"


def extents_of(path: str) -> list[tuple[int, int, int, int]] | None:
    """A file's extents (logical, physical, length, flags); None where the file system doesn't tell their places."""
    import fcntl
    import struct

    found: list[tuple[int, int, int, int]] = []
    head, one = struct.calcsize(HEAD), struct.calcsize(EXTENT)
    try:
        with open(path, "rb") as f:
            start = 0
            while True:
                room = bytearray(struct.pack(HEAD, start, (1 << 64) - 1 - start, SYNC, 0, ROOM, 0) + bytes(ROOM * one))
                fcntl.ioctl(f, FIEMAP, room)
                n = struct.unpack_from(HEAD, room)[3]
                got = [struct.unpack_from(EXTENT, room, head + i * one) for i in range(n)]
                if any(e[3] & NO_PLACE for e in got):
                    return None
                found += got
                if not got or got[-1][3] & LAST:
                    return found
                start = got[-1][0] + got[-1][2]
    except OSError:
        return None


def add_extents(files: DataFrame) -> DataFrame:
    """Adds extents: null where they aren't known."""
    import pyarrow as pa
    from pyspark.sql import types as T

    schema = T.StructType([*files.schema.fields, T.StructField("extents", T._parse_datatype_string(EXTENTS))])
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("logical", "physical", "length", "flags")]))

    def run(batches):
        for b in batches:
            rows = [extents_of(p) for p in b.column("path").to_pylist()]
            told = [None if r is None else [dict(zip(("logical", "physical", "length", "flags"), e, strict=True)) for e in r] for r in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(told, kind)], names=schema.fieldNames())

    return files.mapInArrow(run, schema)


def hash_files(files: DataFrame, chunk: int = 256 * 1024) -> DataFrame:
    """Adds sha: SHA-256 of each file, read in chunks, or null if it can't be read."""
    import hashlib

    import pyarrow as pa
    from pyspark.sql import types as T

    def digest(path: str) -> str | None:
        h = hashlib.sha256()
        try:
            with open(path, "rb") as f:
                while block := f.read(chunk):
                    h.update(block)
        except OSError:
            return None
        return h.hexdigest()

    def run(batches):
        for b in batches:
            shas = pa.array([digest(p) for p in b.column("path").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, shas], names=[*b.schema.names, "sha"])

    return files.mapInArrow(run, T.StructType([*files.schema.fields, T.StructField("sha", T.StringType())]))
