"""Length-delimited binary token records with masked checksums and an offset index.

A shard is a file of frames, one for each document, in ascending doc_id order:

    uint64 length | uint32 masked CRC-32C of those 8 bytes | payload | uint32 masked CRC-32C of the payload

all little-endian.  The payload is the serialized sequence: int64 doc_id, uint8
width of an id in bytes (2 or 4, by the tokenizer's largest id), then the ids.  Beside
it stands an index file of int64 pairs (offset of the frame, number of ids), so a
reader can fetch any record by itself, in any order.

Shards are written by executors under a temporary name and moved to their final
one, so a task that runs twice leaves one whole file.

Defined results: a null or empty text gives the end id alone; rows with a null
doc_id come first; equal doc_ids stand next to each other in the order of their
texts' hashes, each with its own record; an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import file_system, octets, parts, scratch, shuffle_partitions

#: The mask that record formats add to a stored checksum, and CRC-32C's reflected polynomial (fixed values).
MASK_DELTA = 0xA282EAD8
CASTAGNOLI = 0x82F63B78

NO_ID = -(1 << 63)
ROW = 256  # bytes of a message that are folded side by side
MANIFEST = "shard int, file string, index_file string, n_records long, n_ids long"


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Steps of two message bytes, and the effect of ROW zero bytes on each byte of a state."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(CASTAGNOLI), one >> 1)
    x = np.arange(65536, dtype=np.uint32)
    first = one[x & 255] ^ (x >> 8)
    two = one[first & 255] ^ (first >> 8)
    moved = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(ROW // 2):
        moved = two[moved & 0xFFFF] ^ (moved >> 16)
    return two, moved


def crc32c(messages: list[bytes]) -> np.ndarray:
    """CRC-32C of each message, all of them at once.

    A checksum is linear: messages are cut into rows (the first one filled with
    zeros in front), rows are folded side by side, then joined in order.
    """
    two, moved = _tables()
    n = len(messages)
    sizes = np.fromiter(map(len, messages), np.int64, n)
    if not n:
        return np.zeros(0, np.uint32)
    # the initial state of ones is the complement of the first four bytes; short messages get it by hand
    rows = np.maximum(1, -(-np.maximum(sizes, 4) // ROW))
    stop = np.cumsum(rows)
    board = np.zeros(int(stop[-1]) * ROW, np.uint8)
    for m, end, size in zip(messages, (stop * ROW).tolist(), sizes.tolist(), strict=True):
        board[end - size : end] = np.frombuffer(m, np.uint8)
    whole = sizes >= 4
    at = (stop * ROW - sizes)[whole]
    for k in range(4):
        board[at + k] ^= 0xFF
    words = board.view("<u2").reshape(-1, ROW // 2).T.astype(np.uint32)
    state = np.zeros(words.shape[1], np.uint32)
    for w in words:
        state = two[(state ^ w) & 0xFFFF] ^ (state >> 16)
    begin = stop - rows
    total = state[begin].copy()
    todo = np.flatnonzero(rows > 1)
    k = 1
    while len(todo):
        t = total[todo]
        total[todo] = moved[0][t & 255] ^ moved[1][(t >> 8) & 255] ^ moved[2][(t >> 16) & 255] ^ moved[3][t >> 24] ^ state[begin[todo] + k]
        k += 1
        todo = todo[rows[todo] > k]
    total ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(~whole).tolist():
        s = 0xFFFFFFFF
        for b in messages[i]:
            s ^= b
            for _ in range(8):
                s = (s >> 1) ^ (CASTAGNOLI if s & 1 else 0)
        total[i] = s ^ 0xFFFFFFFF
    return total


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint64)
    return ((((crc >> np.uint64(15)) | (crc << np.uint64(17))) + np.uint64(MASK_DELTA)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def frames(payloads: list[bytes]) -> list[bytes]:
    """Each payload with its length and both checksums."""
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    a, b = masked(crc32c(heads)).tolist(), masked(crc32c(payloads)).tolist()
    return [h + struct.pack("<I", x) + p + struct.pack("<I", y) for h, x, p, y in zip(heads, a, payloads, b, strict=True)]


def unframe(data: bytes, sizes: np.ndarray | None = None) -> list[bytes]:
    """Payloads of whole frames, every checksum tested."""
    heads, payloads, marks, at = [], [], [], 0
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("a record ends within its head")
        (size,) = struct.unpack_from("<Q", data, at)
        heads.append(data[at : at + 8])
        payload = data[at + 12 : at + 12 + size]
        if at + 16 + size > len(data):
            raise ValueError("a record ends before its length")
        marks.append((struct.unpack_from("<I", data, at + 8)[0], struct.unpack_from("<I", data, at + 12 + size)[0]))
        payloads.append(payload)
        at += 16 + size
    found = np.stack([masked(crc32c(heads)), masked(crc32c(payloads))], 1) if heads else np.zeros((0, 2), np.uint32)
    if not np.array_equal(found, np.array(marks, np.uint32).reshape(-1, 2)):
        raise ValueError("a record's checksum is wrong")
    return payloads


def pack_sequence(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    if len(ids) and int(ids.max()) >= 1 << (8 * width):
        raise ValueError(f"an id doesn't fit {width} bytes")
    return struct.pack("<qB", NO_ID if doc_id is None else doc_id, width) + ids.astype(f"<u{width}").tobytes()


def unpack_sequence(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, width = struct.unpack_from("<qB", payload)
    return None if doc_id == NO_ID else doc_id, np.frombuffer(payload, f"<u{width}", offset=9)


def write_token_records(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Encodes every text, appends end_id, writes shards in doc_id order; returns the manifest.

    docs: doc_id, text.  One range shuffle of the texts; a shard is written as it
    streams by, so a task holds one block of texts and no more.
    """
    spark = docs.sparkSession
    width = 2 if max(bpe.largest_id(tokenizer), end_id) < 1 << 16 else 4
    n = shuffle_partitions(spark)
    # rows with one doc_id, or none, may fill many ranges: their texts' hashes part them
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("seal"))
    ordered = keyed.repartitionByRange(n, "doc_id", "seal").sortWithinPartitions("doc_id", "seal", "text")

    def write(batches):
        shard = TaskContext.get().partitionId()
        encoder = bpe.library_encoder(tokenizer)
        name, mark = f"shard-{shard:06d}", uuid.uuid4().hex
        store, root = file_system(out_dir)
        out = index = None
        at = records = total = 0
        for batch in batches:
            ids_in, raw = batch.column("doc_id").to_pylist(), octets(batch, "text")
            for i, j in parts(raw, bpe.BLOCK_BYTES):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/.{name}-{mark}.rec", compression=None)
                    index = store.open_output_stream(f"{root}/.{name}-{mark}.idx", compression=None)
                ids, counts = encoder.batch(raw[i:j])
                stops = np.cumsum(counts)
                payloads = [
                    pack_sequence(d, np.append(ids[b - c : b], end_id), width) for d, b, c in zip(ids_in[i:j], stops.tolist(), counts.tolist(), strict=True)
                ]
                framed = frames(payloads)
                sizes = np.fromiter(map(len, framed), np.int64, len(framed))
                offsets = at + np.cumsum(sizes) - sizes
                out.write(b"".join(framed))
                index.write(np.stack([offsets, counts + 1], 1).astype("<i8").tobytes())
                at += int(sizes.sum())
                records += j - i
                total += int(counts.sum()) + j - i
        if out is not None:
            out.close()
            index.close()
            for kind in ("rec", "idx"):
                store.move(f"{root}/.{name}-{mark}.{kind}", f"{root}/{name}.{kind}")
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "file": [f"{out_dir}/{name}.rec"], "index_file": [f"{out_dir}/{name}.idx"], "n_records": [records], "n_ids": [total]}
            )

    return ordered.mapInArrow(write, MANIFEST)


def read_records(manifest: DataFrame, visit, schema: str, chunk: int = 8 << 20) -> DataFrame:
    """Reads every shard back by its index in chunks of about `chunk` bytes.

    manifest: the rows of write_token_records with a column start, the ids of all
    shards before.  visit(start, [(doc_id, ids)]) gives a dict of columns.
    """

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, path = file_system(row["file"])
                _, index_path = file_system(row["index_file"])
                with store.open_input_stream(index_path, compression=None) as f:
                    index = np.frombuffer(f.read(), "<i8").reshape(-1, 2)
                with store.open_input_file(path) as f:
                    stops, start, i = np.append(index[1:, 0], f.size()), row["start"], 0
                    while i < len(index):
                        j = max(i + 1, int(np.searchsorted(stops, index[i, 0] + chunk, "right")))
                        data = f.read_at(int(stops[j - 1] - index[i, 0]), int(index[i, 0]))
                        found = [unpack_sequence(p) for p in unframe(data)]
                        if [len(x) for _, x in found] != index[i:j, 1].tolist():
                            raise ValueError("the index and the records differ")
                        yield pa.RecordBatch.from_pydict(visit(start, found))
                        start += int(index[i:j, 1].sum())
                        i = j

    return manifest.mapInArrow(read, schema)


def with_starts(manifest: DataFrame) -> DataFrame:
    """Adds to each shard the ids of all shards before it.  One row a shard: as many as the write had tasks."""
    spark = manifest.sparkSession
    rows, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["shard"]):
        rows.append((*r, start))
        start += r["n_ids"]
    return spark.createDataFrame(rows, MANIFEST + ", start long").repartition(max(1, len(rows)))


def digest(start: int, found: list) -> dict:
    sizes = np.array([len(x) for _, x in found], np.int64)
    return {
        "doc_id": pa.array([d for d, _ in found], pa.int64()),
        "start": pa.array(start + np.cumsum(sizes) - sizes, pa.int64()),
        "n_tokens": pa.array(sizes, pa.int64()),
        "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for _, x in found], pa.int64()),
    }


def token_records(docs: DataFrame, tokenizer: str, end_id: int = 0, out_dir: str | None = None) -> DataFrame:
    """Writes the records of all documents and returns what is read back from the files:
    doc_id, start, n_tokens, ids_crc32."""
    out_dir = out_dir or scratch(docs.sparkSession, "records")
    manifest = with_starts(write_token_records(docs, out_dir, tokenizer, end_id))
    return read_records(manifest, digest, "doc_id long, start long, n_tokens long, ids_crc32 long").select(
        "doc_id", "start", "n_tokens", F.col("ids_crc32")
    )
