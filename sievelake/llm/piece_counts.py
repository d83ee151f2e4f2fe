"""Token counts by a linear longest-match automaton.

Greedy word pieces take the longest vocabulary entry at each place of a word.
A trie of the vocabulary gets failure links: where a character can't go on, the
link leads to the node of what remains after the pieces that can be cut off, and
the node knows how many pieces those are.  A word's count is then found in one
walk over its characters, without building any piece.

Words are runs of letters and digits; any other character that isn't white space
is a word by itself.  A word that the vocabulary can't spell is one unknown
token.  The vocabulary is a file and a parameter: initial pieces start with the
mark, the others continue a word.

Defined results: null and empty texts have no words and no tokens; every input
row gives a row; other columns are ignored.  A word costs time in proportion to
its length, however long.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import octets, parts

MARK = "▁"
UNKNOWN = -1


class Automaton:
    """next: (node, character) to node; link: node of what remains, or -1; popped: pieces cut off by the link."""

    def __init__(self, pieces, mark: str = MARK):
        self.mark = mark
        self.next: dict[tuple[int, str], int] = {}
        self.whole = [False, False]
        self.root, self.inner = 0, 1
        children: list[list[tuple[str, int]]] = [[], []]
        for piece in pieces:
            node, rest = (self.root, piece) if piece.startswith(mark) else (self.inner, piece)
            if not rest:
                continue
            for c in rest:
                to = self.next.get((node, c))
                if to is None:
                    to = self.next[node, c] = len(self.whole)
                    self.whole.append(False)
                    children.append([])
                    children[node].append((c, to))
                node = to
            self.whole[node] = True
        self.link, self.popped = [-1] * len(self.whole), [0] * len(self.whole)
        level = [self.root, self.inner]
        while level:
            below = []
            for u in level:
                for c, v in children[u]:
                    below.append(v)
                    if self.whole[v]:
                        self.link[v], self.popped[v] = self.inner, 1
                        continue
                    z, n = self.link[u], self.popped[u]
                    while z >= 0 and (z, c) not in self.next:
                        n += self.popped[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[v], self.popped[v] = self.next[z, c], n
            level = below

    def count(self, word: str) -> int:
        """Pieces of a word, or UNKNOWN."""
        step, link, popped = self.next, self.link, self.popped
        node, n = self.root, 0
        for c in self.mark + word:
            while (to := step.get((node, c))) is None:
                if link[node] < 0:
                    return UNKNOWN
                n += popped[node]
                node = link[node]
            node = to
        while node != self.inner:
            if link[node] < 0:
                return UNKNOWN
            n += popped[node]
            node = link[node]
        return n


def greedy(word: str, pieces: set[str], mark: str = MARK) -> int:
    """The same count by trying the longest piece first at each place (for tests)."""
    text, at, n, longest = mark + word, 0, 0, max(map(len, pieces))
    while at < len(text):
        for end in range(min(len(text), at + longest), at, -1):
            piece = text[at:end]
            if piece in pieces and (at > 0) == (not piece.startswith(mark)):
                at, n = end, n + 1
                break
        else:
            return UNKNOWN
    return n


def read_pieces(path: str) -> list[str]:
    """Normal pieces of a sentencepiece vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Counter:
    def __init__(self, path: str):
        self.automaton = Automaton(read_pieces(path))
        self.cache = bpe.WordCache(lambda words: [[self.automaton.count(w.decode("utf-8", "replace"))] for w in words])

    def batch(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, tokens and unknown words of each text."""
        words = bpe.split_bytes(raw, bpe.word_starts, drop_space=True)
        if not len(words.codes):
            none = np.zeros(len(raw), np.int64)
            return none, none, none
        flat, start, _ = self.cache.spans(words)
        found = flat[start][words.codes].astype(np.int64)
        cut = np.concatenate([[0], np.cumsum(words.counts)])

        def by_text(x):
            upto = np.concatenate([[0], np.cumsum(x)])
            return upto[cut[1:]] - upto[cut[:-1]]

        return words.counts, by_text(np.abs(found)), by_text(found < 0)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every text; an unknown word is one token.  No shuffle."""

    def run(batches):
        own = counter(vocabulary)
        for batch in batches:
            raw = octets(batch, "text")
            for i, j in parts(raw, bpe.BLOCK_BYTES):
                words, tokens, unknown = own.batch(raw[i:j])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(i, j - i),
                        "n_words": pa.array(words, pa.int64()),
                        "n_tokens": pa.array(tokens, pa.int64()),
                        "n_unknown": pa.array(unknown, pa.int64()),
                    }
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
