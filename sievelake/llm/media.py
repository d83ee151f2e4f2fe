"""Texts kept as lossless WebP images, read back and described.

Four bytes make one pixel (red, green, blue, alpha), 48 pixels a row.  A text of
more than IMAGE_ROWS rows is kept as several images, one file after the other, so
that a long text is decoded in many lanes.  Files depend on nothing but the text.  All work is local to a task: no shuffle.

Defined results: a null text is an empty one, stored as one row of spaces;
repeated rows get equal values; rows keep their other columns out; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import webp
from .common import octets, parts

WIDTH, ROW_BYTES = 48, 192
IMAGE_ROWS = 1024
CACHE_BITS = 10
PALETTE_MOST = 16
ENCODE_BYTES, DECODE_BYTES = 3 << 20, 16 << 20
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
FILES = "doc_id long, n_bytes long, media binary"

#: Letters from the most to the least frequent one, for the code table of prose.
FREQUENT = b" etaoinshrdlucmfwygpbvkxqjz"


def _weights() -> np.ndarray:
    """Expected shares of bytes in prose, by a rule: falling with the rank of letters, small for all others."""
    w = np.full(256, 0.02)
    w[128:192] = 0.25  # continuation bytes
    w[[0xC3, 0xC2]] = 2.0
    w[[10, 44, 46, 45, 39]] = 0.8
    w[48:58] = 0.2
    for rank, b in enumerate(FREQUENT):
        w[b] = 16.0 / (1 + 0.45 * rank)
        if 97 <= b <= 122:
            w[b - 32] = w[b] / 25
    return w / w.sum()


@lru_cache(maxsize=2)
def table(prose: bool) -> webp.Codes:
    """The two fixed code tables: for prose, and for anything."""
    literal = _weights() if prose else np.full(256, 1 / 256)
    copies = 0.6 ** np.arange(webp.LENGTHS)
    hits = np.full(1 << CACHE_BITS, 1 / (1 << CACHE_BITS))
    green = np.concatenate([0.7 * literal, 0.03 * copies / copies.sum(), 0.27 * hits])
    near, far = np.full(webp.DISTANCES, 0.01), np.arange(webp.DISTANCES)
    near[14:32] += 1.0 / (1 + np.abs(far[14:32] - 22))
    lengths = [webp.code_lengths(w, 14) for w in (green, literal, literal, literal, near)]
    before = webp.Writer()
    before.put(0, 1)  # no transform
    return webp._codes(lengths, CACHE_BITS, before, True)


def swapped(x: np.ndarray) -> np.ndarray:
    """Little-endian words of payload bytes as ARGB pixels, and back."""
    x = x.astype(np.uint32)
    return (x & np.uint32(0xFF00FF00)) | ((x & np.uint32(0xFF)) << np.uint32(16)) | ((x >> np.uint32(16)) & np.uint32(0xFF))


def payload_of(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // ROW_BYTES)) * ROW_BYTES, b" ")


def store(payloads: list[bytes]) -> list[bytes]:
    """A file, or several in a row, for each payload."""
    slices, owner = [], []
    most = IMAGE_ROWS * ROW_BYTES
    for k, p in enumerate(payloads):
        for a in range(0, len(p), most):
            slices.append(p[a : a + most])
            owner.append(k)
    pixels = swapped(np.frombuffer(b"".join(slices), "<u4"))
    counts = np.fromiter((len(s) // 4 for s in slices), np.int64, len(slices))
    t = webp.tokens(pixels, counts, WIDTH, CACHE_BITS)
    lit = np.flatnonzero(t.kind == webp.LITERAL)
    image = np.repeat(np.arange(len(slices)), t.counts)
    own = image[lit]
    v = t.value[lit]
    cost = []
    for prose in (True, False):
        lens = table(prose).lengths
        each = lens[0][v >> 8 & 255] + lens[1][v >> 16 & 255] + lens[2][v & 255] + lens[3][v >> 24 & 255]
        cost.append(np.bincount(own, each, len(slices)))
    prose = cost[0] <= cost[1]
    bodies: list = [b""] * len(slices)
    for side in (True, False):
        members = np.flatnonzero(prose == side)
        if len(members):
            chosen = (prose == side)[image]
            some = webp.Tokens(t.kind[chosen], t.pixel[chosen], t.value[chosen], t.dist[chosen], t.counts[members])
            for k, body in zip(members.tolist(), webp.bodies(some, table(side)), strict=True):
                bodies[k] = body
    begin = np.cumsum(counts) - counts
    few = np.bincount(own, minlength=len(slices)) <= PALETTE_MOST  # every colour's first pixel is a literal or in a palette's reach
    files = []
    for k, body in enumerate(bodies):
        height = int(counts[k]) // WIDTH
        file = webp.file_of(WIDTH, height, body)
        if few[k]:
            image_k = pixels[begin[k] : begin[k] + counts[k]].reshape(height, WIDTH)
            if len(np.unique(image_k)) <= PALETTE_MOST:
                file = min(webp.encode(image_k, (webp.COLOR_INDEXING,)), file, key=len)
        files.append(file)
    out: list = [b""] * len(payloads)
    for k, file in zip(owner, files, strict=True):
        out[k] += file
    return out


def restore(media: list[bytes]) -> list[np.ndarray]:
    """The pixels of each text, all its images in a row."""
    return [np.concatenate([i.reshape(-1) for i in images]) for images in webp.decode(media)]


def feature_of(pixels: np.ndarray) -> str:
    """Rows, mean of each channel, and the share of pixels that repeat the one before."""
    c = pixels.astype("<u4").view(np.uint8).reshape(-1, 4)
    b, g, r, a = (c.sum(0, dtype=np.int64) / len(c)).tolist()
    same = int(np.count_nonzero(pixels[1:] == pixels[:-1])) / max(1, len(pixels) - 1)
    return f"rows={len(pixels) // WIDTH};r={r:.4f};g={g:.4f};b={b:.4f};a={a:.4f};same={same:.4f}"


def _stored(batches):
    """doc_ids, sizes and files of about DECODE_BYTES of texts."""
    for batch in batches:
        raw, ids = octets(batch, "text"), batch.column("doc_id")
        for i, j in parts(raw, DECODE_BYTES):
            own, media = raw[i:j], []
            for a, b in parts(own, ENCODE_BYTES):
                media += store([payload_of(x) for x in own[a:b]])
            yield ids.slice(i, j - i), [len(x) for x in own], media


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stored files of each text."""

    def run(batches):
        for ids, sizes, media in _stored(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, FILES)


def _described(ids: pa.Array, sizes: list[int], media: list[bytes]) -> pa.RecordBatch:
    pixels = restore(media)
    payloads = [swapped(p).astype("<u4").tobytes() for p in pixels]
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(sizes, pa.int64()),
            pa.array([len(p) for p in payloads], pa.int64()),
            pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
            pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
            pa.array([len(m) for m in media], pa.int64()),
            pa.array([hashlib.sha256(m).hexdigest() for m in media]),
            pa.array([feature_of(p) for p in pixels]),
        ],
        names=[c.split()[0] for c in FEATURES.split(", ")],
    )


def describe(media: DataFrame) -> DataFrame:
    """Reads stored files back and describes what they hold.  media: doc_id, n_bytes, media."""

    def run(batches):
        for batch in batches:
            sizes, every = batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist()
            for i, j in parts(every, DECODE_BYTES // 2):
                yield _described(batch.column("doc_id").slice(i, j - i), sizes[i:j], every[i:j])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def round_trip(docs: DataFrame) -> DataFrame:
    """describe(to_media(docs)) within one worker, so that files don't go through the JVM in between."""

    def run(batches):
        for ids, sizes, media in _stored(batches):
            yield _described(ids, sizes, media)

    return docs.select("doc_id", "text").mapInArrow(run, FEATURES)
