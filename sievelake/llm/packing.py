"""Vector bin packing of token sequences by the dot-product heuristic.

A training sequence has three limits at once: tokens, segments (pieces of
documents) and loss-bearing tokens.  A bin is filled one piece after another: of
the pieces that fit whole, the one whose demand has the largest dot product with
what the bin still has room for, each dimension weighted by its mean demand.
Where no piece fits whole, the one that fills most of the room is cut.  A bin
that can't be filled is divided into sequences whose lengths are powers of two,
which need no padding.

Packing is local to a task: it takes no shuffle, and a task holds a pool of
POOL documents' remainders.  At most one bin a task is left unfilled for want of
pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import bpe
from .common import octets, parts

POOL = 2048
PIECES = "doc_id long, start long, length long, ids binary, loss_tokens long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Places pieces of documents into bins as they come.

    limits: tokens, segments and loss-bearing tokens of a sequence, each at least 1.
    A document is (key, size, loss_from): its tokens from loss_from on bear loss.
    emit(key, start, length, loss, size, sequence, offset) is called for each placed piece.
    """

    def __init__(self, limits: tuple[int, int, int], emit, first_sequence: int = 0, pool: int = POOL):
        self.limits, self.emit, self.sequence, self.most = limits, emit, first_sequence, pool
        self.keys: list = []
        self.n = 0
        self.start, self.size, self.loss_from, self.total = (np.zeros(pool + 1, np.int64) for _ in range(4))

    def add(self, key, size: int, loss_from: int = 0) -> None:
        tokens, _, loss_most = self.limits
        whole = min(tokens, loss_most)
        start = 0
        if whole == tokens:  # full sequences need no search
            while size - start >= tokens:
                self._close([(key, start, tokens, loss_from, size)])
                start += tokens
        if start < size:
            i = self.n
            self.start[i], self.size[i], self.loss_from[i], self.total[i] = start, size - start, loss_from, size
            self.keys.append(key)
            self.n += 1
            if self.n > self.most:
                while self.n > self.most // 2:
                    self._fill()

    def finish(self) -> None:
        while self.n:
            self._fill()

    def _take(self, i: int, length: int) -> tuple:
        piece = (self.keys[i], int(self.start[i]), length, int(self.loss_from[i]), int(self.total[i]))
        if length == self.size[i]:
            last = self.n - 1
            for a in (self.start, self.size, self.loss_from, self.total):
                a[i] = a[last]
            self.keys[i] = self.keys[last]
            self.keys.pop()
            self.n = last
        else:
            self.start[i] += length
            self.size[i] -= length
        return piece

    def _fill(self) -> None:
        room = np.array(self.limits, np.int64)
        limits = np.array(self.limits, np.float64)
        pieces, weights = [], None
        while room[0] and room[1] and self.n:
            n = self.n
            start, size = self.start[:n], self.size[:n]
            free = np.maximum(self.loss_from[:n] - start, 0)  # tokens before the loss-bearing ones
            loss = np.maximum(size - free, 0)
            if weights is None:
                weights = np.array([size.mean(), 1.0, loss.mean()]) / limits
            most = np.minimum(np.minimum(size, room[0]), free + room[2])
            fits = most == size
            if room[1] == 1:  # the last segment: what fills most
                i = int(np.argmax(most))
                length = int(most[i])
            elif fits.any():
                pull = weights * room / limits / limits
                score = np.where(fits, pull[0] * size + pull[1] + pull[2] * loss, -1.0)
                i = int(np.argmax(score))
                length = int(size[i])
            else:
                i = int(np.argmax(most))
                length = int(most[i])
            if length == 0:
                break
            piece = self._take(i, length)
            room -= (length, 1, _loss(piece[1], length, piece[3]))
            pieces.append(piece)
        self._close(pieces)

    def _close(self, pieces: list[tuple]) -> None:
        """Writes a bin: as it is when full, else cut at powers of two."""
        left = sum(p[2] for p in pieces)
        room = left if left == self.limits[0] else 0
        at = 0
        for key, start, length, loss_from, total in pieces:
            while length:
                if not room:
                    room = 1 << (left.bit_length() - 1)
                    at = 0
                part = min(length, room)
                self.emit(key, start, part, _loss(start, part, loss_from), total, self.sequence, at)
                at += part
                start += part
                length -= part
                left -= part
                room -= part
                if not room:
                    self.sequence += 1


def _loss(start: int, length: int, loss_from: int) -> int:
    return max(0, start + length - max(start, loss_from))


def pack(docs: DataFrame, tokenizer: str, limits: tuple[int, int, int] = (1024, 256, 1024), end_id: int = 0, loss_from: str | None = None) -> DataFrame:
    """Tokenises every text, appends end_id, and packs all ids.

    docs: doc_id, text and, where loss_from names a column, the first token of a
    document that bears loss (all do without it, or where it is null).  Returns a
    row for each piece: doc_id, start, length, ids (little-endian uint32),
    loss_tokens, doc_tokens, sequence_id, offset.  Ids of sequences are unique, not gapless.

    Null or empty texts are the end id alone; repeated and null doc_ids are packed
    row by row; other columns are ignored; an empty table gives no rows.
    """
    columns = ["doc_id", "text", *([loss_from] if loss_from else [])]

    def run(batches):
        encoder = bpe.library_encoder(tokenizer)
        out: list[tuple] = []

        def emit(key, start, length, loss, total, sequence, offset):
            doc_id, ids = key
            out.append((doc_id, start, length, ids[start : start + length].tobytes(), loss, total, sequence, offset))

        packer = Packer(limits, emit, TaskContext.get().partitionId() << 33)
        for batch in batches:
            names, raw = batch.column("doc_id").to_pylist(), octets(batch, "text")
            begins = [x or 0 for x in batch.column(loss_from).to_pylist()] if loss_from else [0] * len(raw)
            for i, j in parts(raw, bpe.BLOCK_BYTES):
                ids, counts = encoder.batch(raw[i:j])
                ids = ids.astype("<u4")
                stops = np.cumsum(counts)
                for d, f, b, c in zip(names[i:j], begins[i:j], stops.tolist(), counts.tolist(), strict=True):
                    packer.add((d, np.append(ids[b - c : b], np.uint32(end_id))), c + 1, f)
                if len(out) > 2000:
                    yield _rows(out)
                    out.clear()
        packer.finish()
        if out:
            yield _rows(out)

    return docs.select(*columns).mapInArrow(run, PIECES)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = {"ids": pa.binary()}
    return pa.RecordBatch.from_pydict(
        {name: pa.array(col, kinds.get(name, pa.int64())) for name, col in zip((c.split()[0] for c in PIECES.split(", ")), zip(*out, strict=True), strict=True)}
    )
