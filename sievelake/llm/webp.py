"""Lossless WebP: a decoder of many streams at once, and an encoder.

The decoder reads prefix codes (simple and normal ones, several groups by an
entropy image), back-references with the table of near distances, and the colour
cache, and inverts the predictor, cross-colour, subtract-green and
colour-indexing transforms; it writes ARGB pixel arrays.  Streams whose headers
are equal are decoded in step: each step yields one pixel of every stream by array
arithmetic, so the cost of Python is shared by thousands of images.

The encoder finds copies (equal pairs of pixels at one distance) and colour-cache
hits for many images at once.  Images of a batch use codes that depend on
nothing but the image itself: one of two fixed code tables, or a palette for at
most 16 colours, so equal images give equal files.
"""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, COLOR_INDEXING = range(4)
SIDE_MOST = 1 << 14

#: Order in which the lengths of the code-length code are stored (fixed values of the format).
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
#: Near distances by code, as (columns, rows) back (fixed values of the format).
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
CACHE_HASH = 0x1E35A7BD  # fixed value of the format
GREENS, LENGTHS, DISTANCES = 256, 24, 40
U32 = np.uint32


# --- prefix codes ------------------------------------------------------------


def code_lengths(weights: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a prefix code for weights (0: no code), none above most."""
    used = np.flatnonzero(weights)
    out = np.zeros(len(weights), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    w = weights.astype(np.float64)
    while True:
        heap = [(float(w[s]), i, (int(s),)) for i, s in enumerate(used)]
        heapq.heapify(heap)
        out[:] = 0
        tie = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            both = a[2] + b[2]
            out[list(both)] += 1
            heapq.heappush(heap, (a[0] + b[0], tie, both))
            tie += 1
        if out.max() <= most:
            return out
        w[used] = w[used] + w[used].sum() / (1 << most)  # flatter weights, shorter codes


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code of each symbol, its first bit lowest."""
    out = np.zeros(len(lengths), np.int64)
    code = 0
    for size in range(1, int(lengths.max(initial=0)) + 1):
        for s in np.flatnonzero(lengths == size).tolist():
            out[s] = int(f"{code:0{size}b}"[::-1], 2)
            code += 1
        code <<= 1
    return out


def lookup(lengths: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length by the next bits of a stream.  One symbol alone takes no bits."""
    symbol, size = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
    used = np.flatnonzero(lengths)
    if len(used) == 1:
        symbol[:] = used[0]
        return symbol, size
    if len(used) and sum(2.0 ** -int(n) for n in lengths[used]) != 1.0:
        raise ValueError("a prefix code isn't complete")
    codes = canonical(lengths)
    for s in used.tolist():
        symbol[codes[s] :: 1 << int(lengths[s])] = s
        size[codes[s] :: 1 << int(lengths[s])] = lengths[s]
    return symbol, size


class Bits:
    """Reads a stream from its lowest bit on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data + bytes(16), at

    def read(self, n: int) -> int:
        i = self.at >> 3
        x = int.from_bytes(self.data[i : i + 8], "little") >> (self.at & 7)
        self.at += n
        return x & ((1 << n) - 1)

    def lengths(self, alphabet: int) -> np.ndarray:
        out = np.zeros(alphabet, np.int64)
        if self.read(1):
            two = self.read(1)
            first = self.read(8 if self.read(1) else 1)
            out[first] = 1
            if two:
                out[self.read(8)] = 1
            return out
        own = np.zeros(19, np.int64)
        for i in range(4 + self.read(4)):
            own[CODE_LENGTH_ORDER[i]] = self.read(3)
        symbol, size = lookup(own, 7)
        left = 2 + self.read(2 + 2 * self.read(3)) if self.read(1) else alphabet
        at, last = 0, 8
        while at < alphabet and left > 0:
            left -= 1
            i = self.at >> 3
            peek = (int.from_bytes(self.data[i : i + 4], "little") >> (self.at & 7)) & 127
            self.at += int(size[peek])
            s = int(symbol[peek])
            if s < 16:
                out[at] = s
                at += 1
                last = s or last
                continue
            n, value = ((3 + self.read(2), last) if s == 16 else (3 + self.read(3), 0) if s == 17 else (11 + self.read(7), 0))
            if at + n > alphabet:
                raise ValueError("too many code lengths")
            out[at : at + n] = value
            at += n
        return out


class Writer:
    """Collects values from their lowest bit on."""

    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= int(value) << self.size
        self.size += n

    def lengths(self, lengths: np.ndarray) -> None:
        used = np.flatnonzero(lengths)
        if len(used) == 0:
            used = np.array([0])
        if len(used) <= 2 and used.max() < 256:
            self.put(1, 1)
            self.put(len(used) - 1, 1)
            small = used[0] < 2
            self.put(0 if small else 1, 1)
            self.put(used[0], 1 if small else 8)
            if len(used) == 2:
                self.put(used[1], 8)
            return
        runs, i, last = [], 0, 8
        values = lengths.tolist()
        while i < len(values):
            n = 1
            while i + n < len(values) and values[i + n] == values[i]:
                n += 1
            left, v = n, values[i]
            if v == 0:
                while left >= 3:
                    k = min(left, 138)
                    runs.append((18, k - 11, 7) if k >= 11 else (17, k - 3, 3))
                    left -= k
            else:
                if v != last:
                    runs.append((v, 0, 0))
                    left -= 1
                    last = v
                while left >= 3:
                    k = min(left, 6)
                    runs.append((16, k - 3, 2))
                    left -= k
            runs += [(v, 0, 0)] * left
            i += n
        own = code_lengths(np.bincount([r[0] for r in runs], minlength=19), 7)
        self.put(0, 1)
        n = max([4, *(i + 1 for i, s in enumerate(CODE_LENGTH_ORDER) if own[s])])
        self.put(n - 4, 4)
        for s in CODE_LENGTH_ORDER[:n]:
            self.put(own[s], 3)
        self.put(0, 1)
        codes, alone = canonical(own), np.count_nonzero(own) == 1
        for s, extra, bits in runs:
            if not alone:
                self.put(codes[s], int(own[s]))
            self.put(extra, bits)


# --- decoding ----------------------------------------------------------------


@dataclass
class Head:
    """What stands before the pixels of an image: all of it is equal for streams decoded in step."""

    width: int
    cache_bits: int
    groups: list  # of five arrays of code lengths
    entropy: np.ndarray | None = None  # group of each block
    entropy_bits: int = 0
    transforms: list = field(default_factory=list)  # (kind, bits, data) in the order they were applied
    tables: list | None = None

    def ready(self) -> list:
        """For each of the five codes: bits, and tables of all groups one after the other."""
        if self.tables is None:
            self.tables = []
            for k in range(5):
                bits = max(1, *(int(g[k].max(initial=0)) for g in self.groups))
                both = [lookup(g[k], bits) for g in self.groups]
                self.tables.append((bits, np.concatenate([s for s, _ in both]), np.concatenate([n for _, n in both])))
        return self.tables


@lru_cache(maxsize=64)
def near_distances(width: int) -> np.ndarray:
    return np.array([max(1, x + y * width) for x, y in NEAR], np.int64)


def read_pixels(head: Head, data: np.ndarray, at: np.ndarray, counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Pixels of streams with one head, decoded in step.

    data: all streams (uint8, 16 bytes more at the end); at: first bit of each stream's
    pixels; counts: pixels of each.  Returns the pixels and the bit after them.
    """
    tables = head.ready()
    n = len(at)
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    where = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), U32)
    window = np.ndarray((len(data) - 8,), np.uint64, data, strides=(1,))
    pos = at[order].astype(np.int64)
    back, left = np.zeros(n, np.int64), np.zeros(n, np.int64)
    cached = 1 << head.cache_bits if head.cache_bits else 0
    cache = np.zeros(n * cached, U32)
    cache_at = np.arange(n, dtype=np.int64) * cached
    shift = U32(32 - head.cache_bits) if cached else U32(0)
    near = near_distances(head.width)
    masks = [np.uint64((1 << t[0]) - 1) for t in tables]
    split = sum(tables[k][0] for k in range(4)) > 56
    steps = int(sizes[0]) if n else 0
    # number of streams still running at each step
    ends = np.searchsorted(-sizes, -np.arange(1, steps + 1), "right")
    blocks = -(-head.width // (1 << head.entropy_bits)) if head.entropy is not None else 0
    g = 0
    any_left = False
    for i in range(steps):
        m = int(ends[i])
        dst = where[:m] + i
        if any_left:
            copying = left[:m] > 0
            own = np.flatnonzero(~copying)
        else:
            own = None
        p = pos[:m] if own is None else pos[own]
        if head.entropy is not None:
            block = (i // head.width >> head.entropy_bits) * blocks + ((i % head.width) >> head.entropy_bits)
            g = int(head.entropy[block])
        w = window[p >> 3] >> (p & 7).astype(np.uint64)
        bits, symbols, lens = tables[0]
        x = (w & masks[0]).astype(np.int64) + (g << bits)
        s, size = symbols[x], lens[x].astype(np.int64)
        pixel = np.zeros(len(p), U32)
        lit = np.flatnonzero(s < GREENS)
        if len(lit):
            every = len(lit) == len(s)
            v = w if every else w[lit]
            used = size if every else size[lit]
            v = v >> used.astype(np.uint64)
            argb = (s if every else s[lit]).astype(U32) << U32(8)
            for k, up in ((1, 16), (2, 0), (3, 24)):
                if k == 3 and split:
                    q = (p if every else p[lit]) + used
                    v = window[q >> 3] >> (q & 7).astype(np.uint64)
                bits, symbols, lens = tables[k]
                x = (v & masks[k]).astype(np.int64) + (g << bits)
                one = lens[x]
                v = v >> one.astype(np.uint64)
                used = used + one
                argb |= symbols[x].astype(U32) << U32(up)
            if every:
                pixel, size = argb, used
            else:
                pixel[lit], size[lit] = argb, used
        rest = np.flatnonzero(s >= GREENS) if len(lit) < len(s) else lit[:0]
        if len(rest):
            hit = rest[s[rest] >= GREENS + LENGTHS]
            if len(hit):
                rows = hit if own is None else own[hit]
                pixel[hit] = cache[cache_at[rows] + (s[hit] - (GREENS + LENGTHS))]
            ref = rest[s[rest] < GREENS + LENGTHS]
            if len(ref):
                rows = ref if own is None else own[ref]
                q = p[ref] + size[ref]
                length, q = _extra(window, q, s[ref].astype(np.int64) - GREENS)
                bits, symbols, lens = tables[4]
                x = ((window[q >> 3] >> (q & 7).astype(np.uint64)) & masks[4]).astype(np.int64) + (g << bits)
                code, q = _extra(window, q + lens[x], symbols[x].astype(np.int64))
                dist = np.where(code > len(NEAR), code - len(NEAR), near[np.minimum(code, len(NEAR)) - 1])
                if (dist > i).any() or (length > sizes[rows] - i).any():
                    raise ValueError("a copy reaches outside the image")
                left[rows], back[rows] = length, dist
                size[ref] = q - p[ref]
                pixel[ref] = out[dst[rows] - dist]
                any_left = True
        if own is None:
            pos[:m] += size
            result = pixel
        else:
            pos[own] += size
            result = np.empty(m, U32)
            result[own] = pixel
            moved = np.flatnonzero(copying)
            result[moved] = out[dst[moved] - back[moved]]
        if any_left:
            left[:m] -= left[:m] > 0
            if not i & 15:
                any_left = bool(left[:m].any())
        out[dst] = result
        if cached:
            cache[cache_at[:m] + ((result * U32(CACHE_HASH)) >> shift)] = result
    pixels: list = [None] * n
    stop = np.zeros(n, np.int64)
    for k, o in enumerate(order.tolist()):
        pixels[o] = out[where[k] : where[k] + sizes[k]]
    stop[order] = pos
    return pixels, stop


def _extra(window: np.ndarray, q: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of length or distance prefixes and the bit after their extra bits."""
    n = np.maximum((prefix - 2) >> 1, 0)
    base = np.where(prefix < 4, prefix, (2 + (prefix & 1)) << n)
    more = (window[q >> 3] >> (q & 7).astype(np.uint64)).astype(np.uint64) & ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))
    return base + more.astype(np.int64) + 1, q + n


def _sub_image(bits: Bits, width: int, height: int) -> np.ndarray:
    head = _head(bits, width, height, main=False)
    data = np.frombuffer(bits.data, np.uint8)
    pixels, stop = read_pixels(head, data, np.array([bits.at]), np.array([width * height]))
    bits.at = int(stop[0])
    return pixels[0]


def _head(bits: Bits, width: int, height: int, main: bool) -> Head:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    entropy, entropy_bits, n = None, 0, 1
    if main and bits.read(1):
        entropy_bits = 2 + bits.read(3)
        block = 1 << entropy_bits
        codes = _sub_image(bits, -(-width // block), -(-height // block))
        entropy = ((codes >> U32(8)) & U32(0xFFFF)).astype(np.int64)
        n = int(entropy.max()) + 1
    alphabets = (GREENS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    groups = [[bits.lengths(a) for a in alphabets] for _ in range(n)]
    return Head(width, cache_bits, groups, entropy, entropy_bits)


def read_head(bits: Bits, width: int, height: int) -> Head:
    """Transforms and codes of a main image."""
    transforms = []
    while bits.read(1):
        kind = bits.read(2)
        if kind in [t[0] for t in transforms]:
            raise ValueError("a transform stands twice")
        if kind in (PREDICTOR, CROSS_COLOR):
            size = 2 + bits.read(3)
            block = 1 << size
            transforms.append((kind, size, _sub_image(bits, -(-width // block), -(-height // block)), width))
        elif kind == SUBTRACT_GREEN:
            transforms.append((kind, 0, None, width))
        else:
            n = 1 + bits.read(8)
            steps = _sub_image(bits, n, 1)
            palette = np.zeros(n, U32)
            for up in (0, 8, 16, 24):
                palette |= (np.cumsum((steps >> U32(up)) & U32(255)).astype(U32) & U32(255)) << U32(up)
            size = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, size, palette, width))
            width = -(-width // (1 << size))
    head = _head(bits, width, height, main=True)
    head.transforms = transforms
    return head


# --- transforms --------------------------------------------------------------


def _channels(x: np.ndarray) -> np.ndarray:
    """Blue, green, red, alpha as int32 along a new last axis."""
    return np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(*x.shape, 4).astype(np.int32)


def _joined(c: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray((c & 255).astype(np.uint8)).view("<u4").reshape(c.shape[:-1]).astype(U32)


def _predict(mode: int, l: np.ndarray, t: np.ndarray, tr: np.ndarray, tl: np.ndarray) -> np.ndarray:  # noqa: E741
    def mean(a, b):
        return (a + b) >> 1

    if mode == 0 or mode > 13:
        return np.array([0, 0, 0, 255], np.int32)
    if mode < 5:
        return (l, t, tr, tl)[mode - 1]
    if mode == 11:
        down, right = np.abs(t - tl).sum(-1, keepdims=True), np.abs(l - tl).sum(-1, keepdims=True)
        return np.where(down < right, l, t)
    if mode == 12:
        return np.clip(l + t - tl, 0, 255)
    if mode == 13:
        a = mean(l, t)
        d = a - tl
        return np.clip(a + np.sign(d) * (np.abs(d) >> 1), 0, 255)
    return (mean(mean(l, tr), t), mean(l, tl), mean(l, t), mean(tl, t), mean(t, tr), mean(mean(l, tl), mean(t, tr)))[mode - 5]


def _predictions(done: np.ndarray, y: int, x: int, modes: np.ndarray, bits: int) -> np.ndarray:
    h, w, _ = done.shape
    if y == 0:
        return done[0, x - 1] if x else np.array([0, 0, 0, 255], np.int32)
    if x == 0:
        return done[y - 1, 0]
    mode = int(modes[(y >> bits) * -(-w // (1 << bits)) + (x >> bits)])
    tr = done[y - 1, x + 1] if x + 1 < w else done[y, 0]
    return _predict(mode, done[y, x - 1], done[y - 1, x], tr, done[y - 1, x - 1])


def _unpredicted(left: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Adds predictions to what they left.  A pixel rests on its left neighbour and on three above, up to one
    to the right: pixels with equal x + 2 y don't rest on each other and are done at once."""
    height, width, _ = left.shape
    done = np.zeros((height, width, 4), np.int32)
    done[0, 0] = (left[0, 0] + [0, 0, 0, 255]) & 255
    done[0, 1:] = left[0, 1:]
    done[0] = np.cumsum(done[0], 0) & 255
    done[1:, 0] = left[1:, 0]
    done[:, 0] = np.cumsum(done[:, 0], 0) & 255
    per = -(-width // (1 << bits))
    for front in range(3, width + 2 * height - 2):
        y = np.arange(max(1, (front - width + 2) // 2), min(height - 1, (front - 1) // 2) + 1)
        x = front - 2 * y
        if not len(y):
            continue
        mode = modes[(y >> bits) * per + (x >> bits)]
        # right of the last pixel of a row stands the first one of the row below
        tr = np.where((x + 1 < width)[:, None], done[y - 1, np.minimum(x + 1, width - 1)], done[y, 0])
        around = done[y, x - 1], done[y - 1, x], tr, done[y - 1, x - 1]
        for m in np.unique(mode).tolist():
            own = np.flatnonzero(mode == m)
            done[y[own], x[own]] = (left[y[own], x[own]] + _predict(m, *(a[own] for a in around))) & 255
    return done


def _block_values(data: np.ndarray, bits: int, width: int, height: int) -> np.ndarray:
    per = -(-width // (1 << bits))
    y, x = np.arange(height) >> bits, np.arange(width) >> bits
    return data.reshape(-1, per)[y[:, None], x[None, :]]


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x & 255) ^ 128) - 128


def invert(kind: int, bits: int, data, width: int, image: np.ndarray) -> np.ndarray:
    """Undoes one transform of an image of ARGB rows; width: of the image that comes out."""
    height = image.shape[0]
    if kind == PREDICTOR:
        modes = ((data >> U32(8)) & U32(15)).astype(np.int64)
        return _joined(_unpredicted(_channels(image), modes, bits))
    c = _channels(image)
    if kind == SUBTRACT_GREEN:
        c[..., 0] += c[..., 1]
        c[..., 2] += c[..., 1]
        return _joined(c)
    if kind == CROSS_COLOR:
        code = _channels(_block_values(data, bits, width, height))
        green = _signed(c[..., 1])
        c[..., 2] += (_signed(code[..., 0]) * green) >> 5
        c[..., 0] += (_signed(code[..., 1]) * green) >> 5
        c[..., 0] += (_signed(code[..., 2]) * _signed(c[..., 2])) >> 5
        return _joined(c)
    each, depth = 1 << bits, 8 >> bits
    index = c[..., 1]
    if bits:
        spread = (index[:, :, None] >> (np.arange(each) * depth)) & ((1 << depth) - 1)
        index = spread.reshape(height, -1)[:, :width]
    return np.where(index < len(data), data[np.minimum(index, len(data) - 1)], U32(0))


# --- files -------------------------------------------------------------------


def _payload(file: bytes, at: int) -> tuple[int, int, int]:
    """Start and end of the image data, and where the next file starts."""
    if file[at : at + 4] != b"RIFF" or file[at + 8 : at + 16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    riff, size = struct.unpack_from("<I", file, at + 4)[0], struct.unpack_from("<I", file, at + 16)[0]
    if file[at + 20] != 0x2F:
        raise ValueError("not a lossless image")
    return at + 20, at + 20 + size, at + 8 + riff + (riff & 1)


def decode(files: list[bytes]) -> list[list[np.ndarray]]:
    """The images (rows of ARGB pixels) in each file; a file may hold several, one after the other."""
    images: list[list] = [[] for _ in files]
    streams, known = [], []
    data = b"".join(files) + bytes(24)
    base = 0
    together: dict[int, list] = {}
    for k, file in enumerate(files):
        at = 0
        while at < len(file):
            start, end, at_next = _payload(file, at)
            head4 = int.from_bytes(file[start + 1 : start + 5], "little")
            width, height = 1 + (head4 & 0x3FFF), 1 + (head4 >> 14 & 0x3FFF)
            if head4 >> 29:
                raise ValueError("unknown version")
            body = file[start + 5 : min(end, start + 5 + 4096)]
            found = None
            for i, (w, nbits, prefix, _) in enumerate(known):
                whole, part = nbits >> 3, nbits & 7
                if w == width and body[:whole] == prefix[:whole] and (not part or (len(body) > whole and (body[whole] ^ prefix[whole]) & ((1 << part) - 1) == 0)):
                    found = i
                    break
            if found is None:
                bits = Bits(file[start + 5 : end])
                head = read_head(bits, width, height)
                found = len(known)
                # heads that depend on the height can't be shared
                shared = head.entropy is None and all(t[0] in (SUBTRACT_GREEN, COLOR_INDEXING) for t in head.transforms)
                known.append((width if shared else -1, bits.at, file[start + 5 : start + 6 + (bits.at >> 3)], head))
            together.setdefault(found, []).append(len(streams))
            head = known[found][3]
            streams.append((k, len(images[k]), (base + start + 5) * 8 + known[found][1], head.width * height, width, height, (base + end) * 8))
            images[k].append(None)
            at = at_next
        base += len(file)
    buffer = np.frombuffer(data, np.uint8)
    for i, members in together.items():
        head = known[i][3]
        own = [streams[j] for j in members]
        pixels, stop = read_pixels(head, buffer, np.array([s[2] for s in own]), np.array([s[3] for s in own]))
        for (k, place, _, _, width, height, end), flat, last in zip(own, pixels, stop.tolist(), strict=True):
            if last > end:
                raise ValueError("an image ends before its last pixel")
            image = flat.reshape(height, -1)
            for t in reversed(head.transforms):
                image = invert(t[0], t[1], t[2], t[3], image)
            images[k][place] = image
    return images


# --- encoding ----------------------------------------------------------------

MIN_COPY, MAX_COPY = 3, 4096
LITERAL, CACHED, COPY = 0, 1, 2


@dataclass
class Tokens:
    """Tokens of many images, one image after the other."""

    kind: np.ndarray
    pixel: np.ndarray  # first pixel of the token
    value: np.ndarray  # the colour, the place in the cache, or the length of a copy
    dist: np.ndarray  # distance code of a copy
    counts: np.ndarray  # tokens of each image


def prefix_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, number of extra bits and extra bits of lengths or distances."""
    v = value - 1
    top = np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1
    n = np.where(v < 4, 0, top - 1)
    prefix = np.where(v < 4, v, 2 * top + ((v >> np.maximum(top - 1, 0)) & 1))
    return prefix, n, np.where(v < 4, 0, v & ((1 << n) - 1))


def tokens(pixels: np.ndarray, counts: np.ndarray, width: int, cache_bits: int) -> Tokens:
    n = len(pixels)
    ends = np.cumsum(counts)
    image = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    # copies: the last place of the same pair of pixels in the image
    mixed = (pixels[:-1].astype(np.uint64) << np.uint64(32) | pixels[1:].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    name = (mixed >> np.uint64(24)).astype(np.int64) | (image[:-1] << 40) if n > 1 else np.zeros(0, np.int64)
    order = np.argsort(name, kind="stable")
    a, b = order[:-1], order[1:]
    same = (name[a] == name[b]) & (pixels[a] == pixels[b]) & (image[a] == image[b])
    if n > 1:
        same &= (pixels[np.minimum(a + 1, n - 1)] == pixels[np.minimum(b + 1, n - 1)]) & (image[np.minimum(b + 1, n - 1)] == image[b])
    dist = np.zeros(n, np.int64)
    dist[b[same]] = (b - a)[same]
    begin = np.flatnonzero((dist > 0) & (np.concatenate([[0], dist[:-1]]) != dist) if n else np.zeros(0, bool))
    if len(begin):
        # a run may not go over the border of two images: its pairs don't
        stops = np.flatnonzero((dist > 0) & (np.concatenate([dist[1:], [0]]) != dist)) + 1
        size = stops - begin + 1
        touching = np.concatenate([[False], begin[1:] == stops[:-1]])
        begin, size = begin + touching, size - touching
        d = dist[np.minimum(begin, n - 1)]
        d = np.where(touching, dist[begin - touching], d)
        good = size >= MIN_COPY
        begin, size, d = begin[good], size[good], d[good]
        pieces = -(-size // MAX_COPY)
        if (pieces > 1).any():
            begin = np.repeat(begin, pieces)
            offset = (np.arange(len(begin)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * MAX_COPY
            size = np.minimum(np.repeat(size, pieces) - offset, MAX_COPY)
            d, begin = np.repeat(d, pieces), begin + offset
    else:
        size = d = begin
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, begin, 1)
    np.add.at(covered, begin + size, -1)
    free = np.cumsum(covered[:-1]) == 0
    kind = np.full(n, LITERAL, np.int8)
    value, code = pixels.astype(np.int64), np.zeros(n, np.int64)
    if cache_bits:
        place = ((pixels * U32(CACHE_HASH)) >> U32(32 - cache_bits)).astype(np.int64)
        key = (image << cache_bits) | place
        order = np.argsort(key, kind="stable")
        a, b = order[:-1], order[1:]
        hit = b[(key[a] == key[b]) & (pixels[a] == pixels[b])]
        kind[hit] = CACHED
        value[hit] = place[hit]
    table = near_distances(width)
    near_code = np.zeros(int(table.max()) + 1, np.int64)
    near_code[table[::-1]] = np.arange(len(table), 0, -1)
    kind[begin], value[begin] = COPY, size
    code[begin] = np.where(d < len(near_code), near_code[np.minimum(d, len(near_code) - 1)], 0)
    code[begin] = np.where(code[begin] > 0, code[begin], d + len(NEAR))
    free[begin] = True
    at = np.flatnonzero(free)
    return Tokens(kind[at], at, value[at], code[at], np.diff(np.concatenate([[0], np.searchsorted(at, ends)])))


@dataclass
class Codes:
    """Lengths and codes of the five alphabets; head: the bits that stand before the pixels."""

    lengths: list
    head: Writer
    codes: list = field(default_factory=list)

    def __post_init__(self):
        self.codes = [canonical(x) for x in self.lengths]
        self.sizes = [np.where(np.count_nonzero(x) == 1, 0, x) for x in self.lengths]


def symbols_of(t: Tokens) -> list[np.ndarray]:
    """What each alphabet has to write, in any order."""
    lit, hit, ref = (t.value[t.kind == k] for k in (LITERAL, CACHED, COPY))
    return [
        np.concatenate([lit >> 8 & 255, GREENS + prefix_of(ref)[0], GREENS + LENGTHS + hit]),
        lit >> 16 & 255,
        lit & 255,
        lit >> 24 & 255,
        prefix_of(t.dist[t.kind == COPY])[0],
    ]


def emit(t: Tokens, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """The bits of each image after the head, in words of 64 bits that start anew for each image; bits of each."""
    value, size = np.zeros(len(t.kind), np.uint64), np.zeros(len(t.kind), np.int64)

    def put(rows, alphabet, symbols):
        value[rows] |= codes.codes[alphabet][symbols].astype(np.uint64) << size[rows].astype(np.uint64)
        size[rows] += codes.sizes[alphabet][symbols]

    def more(rows, extra, n):
        value[rows] |= extra.astype(np.uint64) << size[rows].astype(np.uint64)
        size[rows] += n

    lit, hit, ref = (np.flatnonzero(t.kind == k) for k in (LITERAL, CACHED, COPY))
    v = t.value[lit]
    for alphabet, up in ((0, 8), (1, 16), (2, 0), (3, 24)):
        put(lit, alphabet, v >> up & 255)
    put(hit, 0, GREENS + LENGTHS + t.value[hit])
    prefix, n, extra = prefix_of(t.value[ref])
    put(ref, 0, GREENS + prefix)
    more(ref, extra, n)
    prefix, n, extra = prefix_of(t.dist[ref])
    put(ref, 4, prefix)
    more(ref, extra, n)
    upto = np.concatenate([[0], np.cumsum(size)])
    cut = np.concatenate([[0], np.cumsum(t.counts)])
    bits = upto[cut[1:]] - upto[cut[:-1]]
    head_bits = codes.head.size & 63
    words = (head_bits + bits + 63) // 64 + 1
    first = np.cumsum(words) - words
    offset = upto[:-1] - np.repeat(upto[cut[:-1]], t.counts) + head_bits + np.repeat(first, t.counts) * 64
    out = np.zeros(int(words.sum()) + 1, np.uint64)
    at, shift = offset >> 6, (offset & 63).astype(np.uint64)
    if len(at):
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out[at[starts]] = np.add.reduceat(value << shift, starts)
        over = np.flatnonzero((offset & 63) + size > 64)
        out[at[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])
    return out, np.stack([first, words, bits], 1)


def file_of(width: int, height: int, body: bytes) -> bytes:
    data = b"\x2f" + struct.pack("<I", (width - 1) | (height - 1) << 14 | 1 << 28) + body
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def bodies(t: Tokens, codes: Codes) -> list[bytes]:
    """Head and pixels of each image as bytes."""
    out, spans = emit(t, codes)
    whole = codes.head.size >> 6
    front = (codes.head.value & ((1 << (whole * 64)) - 1)).to_bytes(whole * 8, "little")
    if codes.head.size & 63 and len(spans):
        out[spans[:, 0]] |= np.uint64(codes.head.value >> (whole * 64))
    raw = out.astype("<u8").tobytes()
    tail = codes.head.size & 63
    return [front + raw[a * 8 : a * 8 + (tail + n + 7 >> 3)] for a, _, n in spans.tolist()]


def _codes(lengths: list, cache_bits: int, before: Writer, main: bool) -> Codes:
    before.put(1 if cache_bits else 0, 1)
    if cache_bits:
        before.put(cache_bits, 4)
    if main:
        before.put(0, 1)
    for x in lengths:
        before.lengths(x)
    return Codes(lengths, before)


def _own_codes(t: Tokens, cache_bits: int, before: Writer, main: bool) -> Codes:
    sizes = (GREENS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    return _codes([code_lengths(np.bincount(s, minlength=k), 14) for s, k in zip(symbols_of(t), sizes, strict=True)], cache_bits, before, main)


def _append(pixels: np.ndarray, width: int, into: Writer, cache_bits: int, main: bool) -> None:
    t = tokens(pixels.reshape(-1), np.array([pixels.size]), width, cache_bits)
    own = _own_codes(t, cache_bits, Writer(), main)
    body = int.from_bytes(bodies(t, own)[0], "little")
    _, spans = emit(t, own)
    into.put(body, own.head.size + int(spans[0, 2]))


def encode(image: np.ndarray, transforms: tuple = (), cache_bits: int = 0, block_bits: int = 3) -> bytes:
    """A file for one image of ARGB rows, its codes made for it, with the transforms that are named."""
    height, width = image.shape
    w, out = width, Writer()
    now = image.astype(U32)
    for kind in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        per, rows = -(-w // (1 << block_bits)), -(-height // (1 << block_bits))
        if kind == SUBTRACT_GREEN:
            c = _channels(now)
            c[..., 0] -= c[..., 1]
            c[..., 2] -= c[..., 1]
            now = _joined(c)
        elif kind == PREDICTOR:
            c = _channels(now)
            modes = np.arange(per * rows, dtype=np.int64) % 14
            left = np.empty_like(c)
            for y in range(height):
                for x in range(w):
                    left[y, x] = c[y, x] - _predictions(c, y, x, modes, block_bits)
            now = _joined(left)
            out.put(block_bits - 2, 3)
            _append((modes << 8).astype(U32), per, out, 0, False)
        elif kind == CROSS_COLOR:
            i = np.arange(per * rows, dtype=np.int64)
            code = np.stack([i * 37 % 256, i * 11 % 256, i * 91 % 256, np.full(len(i), 255)], 1).astype(np.int32)
            each = _channels(_block_values(_joined(code), block_bits, w, height))
            c = _channels(now)
            green, red = _signed(c[..., 1]), _signed(c[..., 2])
            c[..., 0] -= ((_signed(each[..., 1]) * green) >> 5) + ((_signed(each[..., 2]) * red) >> 5)
            c[..., 2] -= (_signed(each[..., 0]) * green) >> 5
            now = _joined(c)
            out.put(block_bits - 2, 3)
            _append(_joined(code), per, out, 0, False)
        else:
            palette, index = np.unique(now, return_inverse=True)
            if len(palette) > 256:
                raise ValueError("too many colours for a palette")
            index = index.reshape(now.shape)
            size = 3 if len(palette) <= 2 else 2 if len(palette) <= 4 else 1 if len(palette) <= 16 else 0
            each, depth = 1 << size, 8 >> size
            wide = -(-w // each)
            padded = np.zeros((height, wide * each), np.int64)
            padded[:, :w] = index
            packed = (padded.reshape(height, wide, each) << (np.arange(each) * depth)).sum(2)
            now = (U32(255) << U32(24)) | (packed.astype(U32) << U32(8))
            steps = _channels(palette)
            steps[1:] = steps[1:] - steps[:-1]
            out.put(len(palette) - 1, 8)
            _append(_joined(steps), len(palette), out, 0, False)
            w = wide
    out.put(0, 1)
    _append(now, w, out, cache_bits, True)
    return file_of(width, height, out.value.to_bytes((out.size + 7) // 8, "little"))
