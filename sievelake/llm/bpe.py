"""Byte-level BPE building blocks shared by the tokenising operators.

The split pattern of the public byte-level vocabularies is evaluated with array
arithmetic over a whole batch of texts instead of one regular-expression match
per word: characters are classed (letter, number, white space, other), a token
starts where the class changes, one plain space joins the word after it, and
English contractions are cut by hand.  Pre-tokens that repeat within a batch
are then recognised by a 128-bit hash, so that a vocabulary is asked once for
each distinct word of a batch.

Vocabulary files are parameters (paths); nothing of them is stored here.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

#: Code points with the Unicode property White_Space (fixed values).
WHITE_SPACE = [
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]

#: Bytes of text that are handled as one batch; bounds the memory of a task.
BLOCK_BYTES = 2 << 20


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """One class for each code point."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    text = "".join(map(chr, points))
    at = np.array(points)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, text):
            table[at[m.start() : m.end()]] = kind
    table[WHITE_SPACE] = SPACE
    return table


def token_starts(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Flags of the characters that start a pre-token.

    points: code points of all texts one after the other; doc_starts: index of
    the first character of each text that isn't empty.
    """
    n = len(points)
    kind = class_table()[points]
    first = np.zeros(n + 4, bool)
    first[doc_starts] = True
    start = np.zeros(n + 4, bool)
    start[0] = True
    start[1:n] = kind[1:] != kind[:-1]
    start |= first
    after_space = np.flatnonzero(start[1:n] & ~first[1:n] & (kind[:-1] == SPACE) & (kind[1:] != SPACE)) + 1
    start[after_space - 1] = True
    start[after_space[points[after_space - 1] == 32]] = False

    # 's 't 'm 'd 're 've 'll: only where the apostrophe starts a pre-token itself
    quote = np.flatnonzero(points == 39)
    quote = quote[start[quote]]
    if len(quote):
        padded = np.concatenate([points[: n].astype(np.int64), [0, 0, 0, 0]])
        one, two = padded[quote + 1], padded[quote + 2]
        same1 = ~first[quote + 1] & (quote + 1 < n)
        same2 = same1 & ~first[quote + 2] & (quote + 2 < n)
        single = same1 & np.isin(one, [ord(c) for c in "stmd"])
        double = same2 & (
            ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        )
        cut = quote[single]
        start[cut + 1] = False
        start[cut + 2] = True
        cut = quote[double]
        start[cut + 1] = False
        start[cut + 3] = True
    return start[:n]


def word_starts(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Flags of the characters that start a run of letters and digits, a run of white space, or any other character."""
    kind = class_table()[points]
    kind = np.where(kind == NUMBER, LETTER, kind)
    start = kind == OTHER
    start[1:] |= kind[1:] != kind[:-1]
    start[0] = True
    start[doc_starts] = True
    return start


@dataclass
class Words:
    """Pre-tokens of a batch of texts: codes[i] names the distinct word of pre-token i."""

    data: bytes
    codes: np.ndarray
    counts: np.ndarray  # pre-tokens of each text
    begin: np.ndarray  # of each distinct word in data
    end: np.ndarray
    one: np.ndarray  # the two halves of each distinct word's name
    two: np.ndarray

    def distinct(self) -> list[bytes]:
        data = self.data
        return [data[a:b] for a, b in zip(self.begin.tolist(), self.end.tolist(), strict=True)]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


#: keeps the first n bytes of a little-endian word
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def span_keys(data: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit values that name each byte span: its first and last eight bytes up to
    a length of 15 (with the length), a 128-bit digest beyond."""
    window = np.ndarray((len(data) + 1,), np.uint64, data + bytes(8), strides=(1,))
    size = end - begin
    one = window[begin] & _MASKS[np.minimum(size, 8)]
    # the bytes after the eighth; the length stands in the last byte
    two = np.where(size > 8, window[np.minimum(begin + 8, len(data))] & _MASKS[np.clip(size - 8, 0, 8)], np.uint64(0))
    two ^= size.astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(size > 15)
    if len(long):
        from xxhash import xxh3_128_digest

        digest = b"".join([xxh3_128_digest(data[a:b]) for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True)])
        both = np.frombuffer(digest, np.uint64).reshape(-1, 2)
        one[long] = both[:, 0]
        two[long] = both[:, 1] | np.uint64(0xF << 60)
    return one, two


def distinct_keys(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code for each pair, and the place of each code's first pair."""
    codes, _ = pd.factorize(mix64(one ^ (two * np.uint64(0x9E3779B97F4A7C15))))
    at = np.empty(int(codes.max()) + 1, np.int64)
    at[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    if not (np.array_equal(one[at][codes], one) and np.array_equal(two[at][codes], two)):
        # two different pairs mixed to the same value
        pairs = np.empty(len(one), [("one", np.uint64), ("two", np.uint64)])
        pairs["one"], pairs["two"] = one, two
        _, at, codes = np.unique(pairs, return_index=True, return_inverse=True)
    return codes, at


def split_bytes(raw: list[bytes], starts=token_starts, drop_space: bool = False) -> Words:
    """Pre-tokens of texts (UTF-8) and the distinct words among them, those of white space left out if asked."""
    data = b"".join(raw)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    if not data:
        none = np.zeros(0, np.int64)
        return Words(b"", none, np.zeros(len(raw), np.int64), none, none, none.astype(np.uint64), none.astype(np.uint64))
    octets = np.frombuffer(data, np.uint8)
    points = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) == len(octets):
        lead = None
    else:
        lead = np.flatnonzero((octets & 0xC0) != 0x80)
    ends = np.cumsum(sizes)
    doc_byte = (ends - sizes)[sizes > 0]
    doc_char = doc_byte if lead is None else np.searchsorted(lead, doc_byte)
    at_char = np.flatnonzero(starts(points, doc_char))
    begin = at_char if lead is None else lead[at_char]
    end = np.append(begin[1:], len(octets))
    if drop_space:
        visible = class_table()[points[at_char]] != SPACE
        begin, end = begin[visible], end[visible]
    counts = np.diff(np.concatenate([[0], np.searchsorted(begin, ends)]))
    if not len(begin):
        none = np.zeros(0, np.int64)
        return Words(data, none, counts, none, none, none.astype(np.uint64), none.astype(np.uint64))
    one, two = span_keys(data, begin, end)
    codes, at = distinct_keys(one, two)
    return Words(data, codes, counts, begin[at], end[at], one[at], two[at])


def ragged_take(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of values named by codes, one after the other, and their lengths."""
    lens = lengths[codes]
    total = int(lens.sum())
    step = np.ones(total, np.int64)
    some = lens > 0
    first, size = starts[codes][some], lens[some]
    if total:
        step[0] = first[0]
        at = np.cumsum(size)[:-1]
        step[at] = first[1:] - (first[:-1] + size[:-1] - 1)
    return values[np.cumsum(step)], lens


class WordCache:
    """ids of the words met so far, as sorted arrays; forgotten as a whole beyond a number of words.

    encode takes a list of words (bytes) and returns a list of their ids.
    """

    def __init__(self, encode, most: int = 1_500_000):
        self.encode, self.most = encode, most
        self._forget()

    def _forget(self) -> None:
        self.one = self.two = np.zeros(0, np.uint64)
        self.start = self.size = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.int32)

    def spans(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, and the start and number of each distinct word's ids in them."""
        if len(self.one) > self.most:
            self._forget()
        order = np.argsort(words.one)  # look-ups in order stay near each other in memory
        one, two = words.one[order], words.two[order]
        place, known = self._find(one, two)
        missing = np.flatnonzero(~known)
        if len(missing):
            self._learn(words, order[missing])
            place, known = self._find(one, two)
        back = np.empty(len(order), np.int64)
        back[order] = place
        return self.flat, self.start[back], self.size[back]

    def _learn(self, words: Words, missing: np.ndarray) -> None:
        """Encodes words in the order of their names and takes them up."""
        data = words.data
        ids = self.encode([data[a:b] for a, b in zip(words.begin[missing].tolist(), words.end[missing].tolist(), strict=True)])
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.array([i for x in ids for i in x], np.int32)
        start = (len(self.flat) + np.cumsum(size) - size).astype(np.int32)
        self.flat = np.concatenate([self.flat, flat])
        at = np.searchsorted(self.one, words.one[missing])
        # words with the same first half may stand in any order
        self.one, self.two = np.insert(self.one, at, words.one[missing]), np.insert(self.two, at, words.two[missing])
        self.start, self.size = np.insert(self.start, at, start), np.insert(self.size, at, size)

    def _find(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.one):
            return np.zeros(len(one), np.int64), np.zeros(len(one), bool)
        last = len(self.one) - 1
        place = np.minimum(np.searchsorted(self.one, one), last)
        hit = (self.one[place] == one) & (self.two[place] == two)
        rest = np.flatnonzero(~hit & (self.one[place] == one))
        while len(rest):
            place[rest] += 1
            rest = rest[place[rest] <= last]
            rest = rest[self.one[place[rest]] == one[rest]]
            hit[rest] = self.two[place[rest]] == two[rest]
            rest = rest[~hit[rest]]
        return np.minimum(place, last), hit


@lru_cache(maxsize=2)
def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies (a rule, not a table)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}


class LibraryEncoder:
    """The ids that the tokenizers library's encode(text, add_special_tokens=False) gives for a byte-level
    BPE file, asked once for each distinct word of a batch.

    The file's added tokens are one id each wherever they stand in a text; what lies
    between them is split by itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = {i: c for i, c in byte_alphabet().items()}
        self.cache = WordCache(self._encode)
        added = self.library.get_added_tokens_decoder()
        self.added = {t.content.encode(): i for i, t in added.items()}
        #: tokens that take white space or want word boundaries are left to the library
        self.plain = not any(t.lstrip or t.rstrip or t.single_word for t in added.values())
        self.cut = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + b")") if added else None

    def _encode(self, words: list[bytes]) -> list[tuple]:
        letters, tokenize = self.letters, self.model.tokenize
        return [[t.id for t in tokenize(w.decode("latin-1").translate(letters))] for w in words]

    def _between(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = split_bytes(raw)
        return in_place(words, *self.cache.spans(words))

    def batch(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts (UTF-8) one after the other and the number of each text's ids."""
        if not any(t in x for x in raw for t in self.added):
            return self._between(raw)
        cuts = [self.cut.split(x) for x in raw]
        spans, special = [x for c in cuts for x in c[::2]], [x for c in cuts for x in c[1::2]]
        whole = np.fromiter((len(c) // 2 + 1 for c in cuts), np.int64, len(cuts))
        ids, counts = self._between(spans)
        stops = np.cumsum(counts)
        last = np.zeros(len(spans), bool)
        last[np.cumsum(whole) - 1] = True
        ids = np.insert(ids, stops[~last], [self.added[t] for t in special])
        totals = np.add.reduceat(counts, np.cumsum(whole) - whole) + whole - 1
        if self.plain:
            return ids, totals
        lists = np.split(ids, np.cumsum(totals)[:-1])
        for k in np.flatnonzero(whole > 1).tolist():
            lists[k] = np.array(self.library.encode(raw[k].decode("utf-8", "replace"), add_special_tokens=False).ids, np.int64)
        return np.concatenate(lists), np.fromiter(map(len, lists), np.int64, len(lists))


def in_place(words: Words, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Puts the ids of the distinct words in the places of their pre-tokens; ids and the number of each text's."""
    out, lens = ragged_take(flat, starts, lengths, words.codes)
    upto = np.concatenate([[0], np.cumsum(lens)])
    cut = np.concatenate([[0], np.cumsum(words.counts)])
    return out, upto[cut[1:]] - upto[cut[:-1]]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def largest_id(path: str) -> int:
    """The largest id of a tokenizer file, its added tokens included."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)
