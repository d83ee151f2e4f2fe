"""Byte-level BPE by a global shuffle of distinct words, and decoding by the token-byte table.

1. Each task splits its texts into pre-tokens and numbers the distinct words it
   meets; a group is a run of texts that share such a numbering.  New words of a
   group go out in packed rows by a hash of the word (word, number in the group).
2. Each bucket of words encodes every distinct word once and sends ids back to
   the groups that asked for them.
3. The texts' word numbers, in the order of their positions, meet the ids of
   their group: ids are put in place of the words, texts are whole again.
   Decoding looks every id up in the token-byte table, which is as large as the vocabulary.

Texts themselves aren't shuffled: what travels is each word once for a group and
a compressed number for each pre-token.  A word stands at most once in a group,
and a group is named by its task and first block and bounded in bytes and words,
so neither frequent words nor many texts make a hot key.  Both passes over the
input must number words alike: an input that comes out of a shuffle, whose order
may change when an executor is lost, is written to the shared folder first, and a
digest of every block of texts is compared to make sure of it.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from . import bpe
from .common import octets, parts, shuffle_partitions, stored

#: A group ends with the block in which its distinct words or its texts' bytes pass these numbers; bounds
#: a task's dictionary and what one key can bring to a task.
GROUP_WORDS, GROUP_BYTES = 400_000, 32 << 20
TEXT_BYTES = 4 << 20  # bytes of texts of a block; each block looks all its distinct words up
PACKED = "part long, kind int, seq int, payload binary"


def _dump(*arrays: np.ndarray) -> bytes:
    """Arrays with their lengths, bytes of equal weight side by side, compressed."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        out.append(struct.pack("<cBQ", a.dtype.kind.encode(), a.itemsize, len(a)))
        out.append(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _load(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at, arrays = 1, []
    for _ in range(raw[0]):
        kind, size, n = struct.unpack_from("<cBQ", raw, at)
        at += 10
        planes = np.frombuffer(raw, np.uint8, size * n, at).reshape(size, n)
        arrays.append(np.ascontiguousarray(planes.T).view(np.dtype(f"{kind.decode()}{size}")).reshape(-1))
        at += size * n
    return arrays


class _Numbers:
    """Numbers of the distinct words of a group, in the order they are met."""

    def __init__(self):
        self.size = 0
        self.cache = bpe.WordCache(self._new, most=1 << 62)
        self.fresh: list[bytes] = []

    def _new(self, words: list[bytes]) -> list[list[int]]:
        self.fresh = words
        first, self.size = self.size, self.size + len(words)
        return [[i] for i in range(first, self.size)]

    def of(self, words: bpe.Words) -> tuple[np.ndarray, list[bytes]]:
        """The number of each pre-token, and the words that are new (the last numbers, in order)."""
        self.fresh = []
        flat, start, _ = self.cache.spans(words)
        return flat[start][words.codes] if len(words.codes) else np.zeros(0, np.int32), self.fresh


def _blocks(batches):
    """(group, number of the block in it, digest, doc_ids, texts, word numbers, pre-tokens by text, new words)."""
    numbers, group, seq, size, block = None, 0, 0, 0, 0
    for batch in batches:
        ids, raw = batch.column("doc_id"), octets(batch, "text")
        task = batch.column("task")[0].as_py() if batch.num_rows else 0
        for i, j in parts(raw, TEXT_BYTES):
            words = bpe.split_bytes(raw[i:j])
            names = ids.slice(i, j - i)
            keys = np.array([-(1 << 63) if x is None else x for x in names.to_pylist()], np.int64)
            seal = xxh3_64_intdigest(words.data + keys.tobytes()) - (1 << 63)
            if numbers is None:
                numbers, group, seq, size = _Numbers(), (task << 32) + block, 0, 0
            codes, fresh = numbers.of(words)
            yield group, seq, seal, keys, codes, words.counts, fresh, numbers.size - len(fresh)
            seq, block, size = seq + 1, block + 1, size + len(words.data)
            if numbers.size > GROUP_WORDS or size > GROUP_BYTES:
                numbers = None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    part, kind, seq, payload = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int64()), "kind": pa.array(kind, pa.int32()), "seq": pa.array(seq, pa.int32()), "payload": pa.array(payload, pa.binary())})


def _ask(buckets: int):
    def run(batches):
        for group, seq, seal, _, _, _, fresh, first in _blocks(batches):
            if not fresh:
                continue
            place = np.fromiter((xxh3_64_intdigest(w) % buckets for w in fresh), np.int64, len(fresh))
            order = np.argsort(place, kind="stable")
            cuts = np.flatnonzero(np.diff(place[order])) + 1
            rows = []
            for own in np.split(order, cuts):
                words = [fresh[i] for i in own.tolist()]
                sizes = np.fromiter(map(len, words), np.uint32, len(words))
                payload = _dump(np.array([group, seq, seal], np.int64), (own + first).astype(np.uint32), sizes, np.frombuffer(b"".join(words), np.uint8))
                rows.append((int(place[own[0]]), 0, seq, payload))
            yield _batch(rows)

    return run


class RankEncoder:
    """Byte-level BPE of single words by the tiktoken library, and the bytes of each id."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = bpe.read_ranks(path)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.wide = max(ranks.values()) >= 1 << 16
        table = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            table[i] = piece
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.size = np.fromiter(map(len, table), np.int64, len(table))
        self.start = np.cumsum(self.size) - self.size
        self.cache = bpe.WordCache(lambda words: [self.encoding._encode_single_piece(w) for w in words])

    def words(self, data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of words that stand one after the other, and the number of each word's."""
        end = np.cumsum(sizes.astype(np.int64))
        begin = end - sizes
        one, two = bpe.span_keys(data, begin, end)
        flat, start, size = self.cache.spans(bpe.Words(data, np.arange(len(sizes)), np.zeros(0, np.int64), begin, end, one, two))
        return bpe.ragged_take(flat, start, size, np.arange(len(sizes)))

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of ids, and the number of each id's bytes."""
        out, lens = bpe.ragged_take(self.bytes, self.start, self.size, ids)
        return out.tobytes(), lens


@lru_cache(maxsize=2)
def rank_encoder(path: str, pattern: str) -> RankEncoder:
    return RankEncoder(path, pattern)


def _encode(path: str, pattern: str):
    def run(batches):
        encoder = rank_encoder(path, pattern)
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                head, numbers, sizes, data = _load(payload)
                ids, counts = encoder.words(data.tobytes(), sizes)
                group, seq, _ = head.tolist()
                yield _batch([(group, 0, seq, _dump(head, numbers, counts.astype(np.uint32), ids.astype(np.uint32)))])

    return run


def _texts(batches):
    for group, seq, seal, keys, codes, counts, _, _ in _blocks(batches):
        yield _batch([(group, 1, seq, _dump(np.array([group, seq, seal], np.int64), keys, counts.astype(np.uint32), codes.astype(np.uint32)))])


def _joined(path: str, pattern: str, visit):
    def run(batches):
        encoder = rank_encoder(path, pattern)
        group, answers, seals, ready = None, [], {}, None
        for batch in batches:
            for part, kind, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "payload")), strict=True):
                if part != group:
                    group, answers, seals, ready = part, [], {}, None
                head, *rest = _load(payload)
                _, seq, seal = head.tolist()
                if kind == 0:
                    answers.append(rest)
                    if seals.setdefault(seq, seal) != seal:
                        raise RuntimeError("two blocks have one name")
                    continue
                if ready is None:
                    ready = _dictionary(answers)
                    answers = []
                keys, counts, codes = rest
                flat, start, size = ready
                if seals.get(seq, seal) != seal or (len(codes) and int(codes.max()) >= len(start)):
                    raise RuntimeError("the two passes over the texts have split them differently")
                ids, lens = bpe.ragged_take(flat, start, size, codes)
                upto = np.concatenate([[0], np.cumsum(lens)])
                cut = upto[np.concatenate([[0], np.cumsum(counts.astype(np.int64))])]
                data, sizes = encoder.decode(ids)
                places = np.concatenate([[0], np.cumsum(sizes)])[cut]
                yield pa.RecordBatch.from_pydict(visit(keys, ids.astype("<u4"), cut, data, places))

    return run


def _dictionary(answers: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids of all words of a group one after the other; the start and number of each word's by its number in the group."""
    if not answers:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint32), none, none
    numbers, counts, ids = (np.concatenate([a[k] for a in answers]) for k in range(3))
    starts = np.cumsum(counts.astype(np.int64)) - counts
    n = int(numbers.max()) + 1
    start, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
    start[numbers], size[numbers] = starts, counts
    return ids, start, size


def _digest(keys: np.ndarray, ids: np.ndarray, cut: np.ndarray, data: bytes, places: np.ndarray) -> dict:
    def hexes(buffer, at):
        return [hashlib.sha256(buffer[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    return {
        "doc_id": pa.array(keys, pa.int64(), mask=keys == -(1 << 63)),
        "n_tokens": pa.array(np.diff(cut), pa.int64()),
        "ids_sha256": hexes(memoryview(ids.tobytes()), cut * 4),
        "decoded_sha256": hexes(memoryview(data), places),
    }


def _lists(keys: np.ndarray, ids: np.ndarray, cut: np.ndarray, data: bytes, places: np.ndarray) -> dict:
    return {
        "doc_id": pa.array(keys, pa.int64(), mask=keys == -(1 << 63)),
        "ids": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids.astype(np.int32))),
        "decoded": pa.array([data[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)], pa.binary()),
    }


LISTS = "doc_id long, ids array<int>, decoded binary"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, ranks: str, pattern: str, visit=_lists, schema: str = LISTS) -> DataFrame:
    """Encodes every text by a file of ranks and decodes the ids again.

    docs: doc_id, text.  Returns by default doc_id, ids, decoded (bytes), a row for each input row.

    Null texts count as empty: no ids.  Special tokens' strings are ordinary text.
    Repeated or null doc_ids keep a row each; an empty table gives none; other columns are ignored.
    """
    n = shuffle_partitions(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs, _ = stored(docs, "texts")
    # the number of the input's partition, the same in both passes
    docs = docs.withColumn("task", F.spark_partition_id().cast("long"))
    asked = docs.mapInArrow(_ask(n), PACKED).repartitionById(n, F.col("part").cast("int"))
    answered = asked.mapInArrow(_encode(ranks, pattern), PACKED)
    # groups are about equal: dealt in turn by task and first block, no task gets many more than another
    turn = F.pmod(F.shiftright("part", 32) + F.col("part").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(n)).cast("int")
    together = answered.unionByName(docs.mapInArrow(_texts, PACKED)).repartitionById(n, turn).sortWithinPartitions("part", "kind", "seq")
    return together.mapInArrow(_joined(ranks, pattern, visit), schema)
