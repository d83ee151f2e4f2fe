"""Line deduplication by range-partitioned hashes and keep bitmaps.

A line's key is the line without ASCII white space at both ends and with A-Z
lower-cased.  Keys of at least MIN_CHARS code points that stand in at least
MIN_DOCS documents keep their lines in one document only, the one with the
largest doc_id.

Each document sends one row for each of its keys (a 128-bit digest, never the
text).  Rows are dealt by ranges of (key, doc_id) and sorted, the largest doc_id
first, so that a task streams over the runs of equal keys and the first document
of a run is the one that keeps.  A frequent key's run may go over many tasks: of
its first and last run each task gives the number of documents and the few rows
that it can't judge alone; those meet a table of two rows a task.  The positions
that go meet by document and become a compressed bitmap of the lines kept.

Defined results: a null or empty text is one empty line; rows with the same
doc_id count as one document, and each row is judged by its own lines; a null
doc_id is a document below all others; an empty table gives no rows; other
columns pass through unchanged, but for those named as the two counts, which
these replace.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import columns, free_names, map_columns, octets, shuffle_partitions, stored, with_columns, without

MIN_CHARS, MIN_DOCS = 20, 3
NO_DOC = -(1 << 63)
BROADCAST_TASKS = 200_000  # tasks whose edges, two rows of some 50 bytes each, are sent to all; joined by a shuffle beyond
DROPS, UNDECIDED, COUNT = 0, 1, 2  # kinds of a stream's rows
STREAM = "kind int, one long, two long, task int, nth long, doc long, seal long, n_lines int, places array<int>"


def line_key(line: bytes, least: int) -> bytes | None:
    """The key of a line, if it is long enough to count."""
    key = line.strip(b" \t\n\x0b\x0c\r")
    if len(key) < least:
        return None
    key = key.lower()
    if len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return key


def _keys(least: int):
    def run(batches):
        for batch in batches:
            docs, sealed = batch.column("doc").to_pylist(), batch.column("seal").to_pylist()
            digests, names, seals, sizes, places = [], [], [], [], []
            for doc, seal, text in zip(docs, sealed, octets(batch, "text"), strict=True):
                lines = text.split(b"\n")
                found: dict[bytes, list[int]] = {}
                for i, line in enumerate(lines):
                    if len(line) >= least and (key := line_key(line, least)) is not None:
                        found.setdefault(xxh3_128_digest(key), []).append(i)
                digests.extend(found)
                names.extend([doc] * len(found))
                seals.extend([seal] * len(found))
                sizes.extend([len(lines)] * len(found))
                places.extend(found.values())
            if names:
                heads = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_pydict(
                    {
                        "one": pa.array(heads[:, 0], pa.int64()),
                        "two": pa.array(heads[:, 1], pa.int64()),
                        "doc": pa.array(names, pa.int64()),
                        "seal": pa.array(seals, pa.int64()),
                        "n_lines": pa.array(sizes, pa.int32()),
                        "places": pa.array(places, pa.list_(pa.int32())),
                    }
                )

    return run


def _stream_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "array<int>": pa.list_(pa.int32())}
    columns = [c.split() for c in STREAM.split(", ")]
    return pa.RecordBatch.from_pydict({name: pa.array(col, kinds[kind]) for (name, kind), col in zip(columns, zip(*rows, strict=True), strict=True)})


def _stream(min_docs: int):
    """Streams over runs of equal keys, largest document first.

    A row of any document but the run's first goes once the run has min_docs
    documents; rows of at most min_docs - 1 documents wait for that.
    """

    def run(batches):
        task = TaskContext.get().partitionId()
        out: list[tuple] = []
        key, docs, last, waiting, first = None, 0, None, [], True

        def end(final: bool):
            if key is not None and (first or final):
                out.append((COUNT, *key, task, docs, None, None, None, None))
                out.extend((UNDECIDED, *key, task, *x) for x in waiting)

        for batch in batches:
            for one, two, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (one, two) != key:
                    end(False)
                    first = key is None
                    key, docs, last, waiting = (one, two), 0, None, []
                if row[0] != last:
                    docs, last = docs + 1, row[0]
                if docs == 1:
                    if first:  # a task before this one may hold a larger document
                        waiting.append((0, *row))
                elif docs < min_docs:
                    waiting.append((docs - 1, *row))
                else:
                    if waiting:
                        out.extend((DROPS, *key, task, *x) for x in waiting if x[0])
                        waiting = [x for x in waiting if not x[0]]
                    out.append((DROPS, *key, task, docs - 1, *row))
            if len(out) > 5000:
                yield _stream_batch(out)
                out.clear()
        end(True)
        if out:
            yield _stream_batch(out)

    return run


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The operator proper: doc, seal (xxhash64 of the text), n_lines, n_dropped and bitmap, a zlib-compressed
    string of bits (most significant first, 1: the line stays).  Documents that keep all lines have no row.

    docs: doc, seal, text.
    """
    n = shuffle_partitions(docs.sparkSession)
    order = ["one", "two", F.col("doc").desc()]
    rows = docs.select("doc", "seal", "text").mapInArrow(_keys(min_chars), "one long, two long, doc long, seal long, n_lines int, places array<int>")
    streamed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_stream(min_docs), STREAM)
    found, _ = stored(streamed, "line-runs")
    # two rows a task
    by_key = Window.partitionBy("one", "two")
    edges = found.where(F.col("kind") == COUNT).select(
        "one",
        "two",
        "task",
        F.sum("nth").over(by_key).alias("docs"),
        (F.sum("nth").over(by_key.orderBy("task")) - F.col("nth")).alias("before"),
    )
    judged = (
        found.where(F.col("kind") == UNDECIDED)
        .join(F.broadcast(edges) if n <= BROADCAST_TASKS else edges, ["one", "two", "task"])
        .where((F.col("docs") >= min_docs) & (F.col("before") + F.col("nth") >= 1))
    )
    columns = ["doc", "seal", "n_lines", "places"]
    gone = found.where(F.col("kind") == DROPS).select(*columns).unionByName(judged.select(*columns))
    by_doc = gone.groupBy("doc", "seal").agg(F.max("n_lines").alias("n_lines"), F.flatten(F.collect_set("places")).alias("places"))
    return by_doc.mapInArrow(_bitmaps, "doc long, seal long, n_lines int, n_dropped int, bitmap binary")


def _bitmaps(batches):
    for batch in batches:
        n_lines, dropped, maps = batch.column("n_lines").to_pylist(), [], []
        for n, places in zip(n_lines, batch.column("places").to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[places] = False
            dropped.append(n - int(keep.sum()))
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_pydict(
            {
                "doc": batch.column("doc"),
                "seal": batch.column("seal"),
                "n_lines": pa.array(n_lines, pa.int32()),
                "n_dropped": pa.array(dropped, pa.int32()),
                "bitmap": pa.array(maps, pa.binary()),
            }
        )


def _apply(text_at: int, names: list[str]):
    def run(batches):
        for batch in batches:
            texts, sizes, dropped = [], [], []
            *own, bitmap = batch.columns
            for text, bits in zip(own[text_at].to_pylist(), bitmap.to_pylist(), strict=True):
                lines = (text or "").split("\n")
                sizes.append(len(lines))
                if bits is None:
                    texts.append(text)
                    dropped.append(0)
                    continue
                keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=len(lines))
                texts.append("\n".join([x for x, k in zip(lines, keep.tolist(), strict=True) if k]))
                dropped.append(len(lines) - int(keep.sum()))
            own[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64())], names=names)

    return run


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: tuple[str, str] = ("__n_lines", "__n_dropped")) -> DataFrame:
    """All rows and columns of docs with the text that stays, and two columns, named counts: lines before, lines dropped.

    The texts meet their bitmaps by (doc_id, hash of the text), so one shuffle
    moves texts.  Null texts stay null.
    """
    docs = without(docs, *counts)
    doc, seal, bitmap = free_names(docs, "__doc", "__seal", "__bitmap")
    marked = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)), seal: F.xxhash64(F.coalesce("text", F.lit("")))})
    bitmaps = keep_bitmaps(marked.select(F.col(doc).alias("doc"), F.col(seal).alias("seal"), "text"), min_chars, min_docs)
    bitmaps = bitmaps.select(F.col("doc").alias(doc), F.col("seal").alias(seal), F.col("bitmap").alias(bitmap))
    joined = marked.join(bitmaps, [doc, seal], "left").select(*columns(docs), bitmap)
    schema = with_columns(docs.schema, **{name: "long" for name in counts})
    return map_columns(joined, _apply(docs.columns.index("text"), schema.fieldNames()), schema)
