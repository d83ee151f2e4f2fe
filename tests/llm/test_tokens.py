import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import regex

public_tokenizers = pytest.importorskip("public_tokenizers")

from sievelake.llm import bpe, packing, piece_counts, records, word_shuffle  # noqa: E402

JSON, RANKS, PIECES = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"))
ODD = ["", None, "a", " ", "it's 's 'tt 'rex x'll'd", "  a \n b\n\n", "é'l 1٣ x²½ 　c", "日本 語!?\n", "<|endoftext|> x", "a <|endoftext|><|endoftext|>\n <|endof", "word " * 3000, "a" * 5000, "same", "same"]


def docs_of(spark, texts, extra=False):
    rows = [(i if i % 5 else i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    return df if extra else df.drop("ids")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_split_is_the_pattern():
    pattern = regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(1)
    letters = list("ab's trevlmd'  \n\t12é!日 S　")
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    words = bpe.split_bytes([t.encode() for t in texts])
    names, at = words.distinct(), 0
    for text, n in zip(texts, words.counts.tolist(), strict=True):
        assert [names[k].decode() for k in words.codes[at : at + n]] == pattern.findall(text)
        at += n


def test_word_cache_forgets_and_tells_halves_apart(monkeypatch):
    cache = bpe.WordCache(lambda ws: [[len(w), w[0]] for w in ws], most=3)
    for text in (b"aa bb cc dd", b"ee ff gg hh ii", b"aa bb zz"):
        words = bpe.split_bytes([text])
        ids, _ = bpe.in_place(words, *cache.spans(words))
        assert ids.tolist() == [x for w in words.distinct() for x in (len(w), w[0])]
    one = np.array([5, 5, 5, 7], np.uint64)
    two = np.array([1, 2, 1, 1], np.uint64)
    codes, at = bpe.distinct_keys(one, two)
    assert codes[0] == codes[2] and len(set(codes.tolist())) == 3
    monkeypatch.setattr(bpe, "mix64", lambda h: h * np.uint64(0))  # every name collides
    codes, at = bpe.distinct_keys(one, two)
    assert codes[0] == codes[2] and len(set(codes.tolist())) == 3


def test_crc32c_and_frames():
    assert [hex(x) for x in records.crc32c([b"123456789", bytes(32), bytes([255] * 32), bytes(range(32)), b""])] == ["0xe3069283", "0x8a9136aa", "0x62a8ab43", "0x46dd794e", "0x0"]
    payloads = [b"", b"a", b"abc" * 1000, os.urandom(255), os.urandom(256), os.urandom(257)]
    data = b"".join(records.frames(payloads))
    assert records.unframe(data) == payloads
    for place in (0, 9, 14, len(data) - 1):
        with pytest.raises(ValueError):
            records.unframe(data[:place] + bytes([data[place] ^ 1]) + data[place + 1 :])
    with pytest.raises(ValueError):
        records.unframe(data[:-5])


def test_records_round_trip(spark, library, tmp_path):
    docs = docs_of(spark, ODD, extra=True)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in records.token_records(docs, JSON, out_dir=f"file://{tmp_path}/r").collect()}
    start = 0
    for i, text in enumerate(ODD):
        ids = library(text) + [0]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not [f for f in os.listdir(tmp_path / "r") if f.startswith(".") and not f.endswith(".crc")]
    assert records.token_records(docs.limit(0), JSON).count() == 0
    odd = spark.createDataFrame([(None, "x"), (3, "b"), (3, "a")], "doc_id long, text string")
    assert [r["doc_id"] for r in records.token_records(odd, JSON).orderBy("start").collect()] == [None, 3, 3]


def test_packing_takes_each_id_once(spark, library):
    rows = packing.pack(docs_of(spark, ODD * 3), JSON).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in enumerate(ODD * 3):
        ids, at = library(text) + [0], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids"] == np.array(ids[at : at + r["length"]], "<u4").tobytes()
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack(docs_of(spark, []), JSON).count() == 0


@pytest.mark.parametrize("limits", [(64, 4, 64), (64, 2, 20), (100, 8, 30), (1, 1, 1)])
def test_packer_holds_all_limits(limits):
    rng = random.Random(3)
    sizes = [(rng.choice([1, 3, 7, 64, 65, 200, 30]), rng.randint(0, 80)) for _ in range(600)]
    seen, sequences = defaultdict(list), defaultdict(list)

    def emit(key, start, length, loss, total, sequence, offset):
        seen[key].append((start, length))
        sequences[sequence].append((offset, length, loss))

    packer = packing.Packer(limits, emit, pool=50)
    for i, (size, loss_from) in enumerate(sizes):
        packer.add(i, size, loss_from)
    packer.finish()
    for i, (size, _) in enumerate(sizes):
        at = 0
        for start, length in sorted(seen[i]):
            assert start == at and length > 0
            at += length
        assert at == size
    for pieces in sequences.values():
        assert sum(p[1] for p in pieces) <= limits[0] and len(pieces) <= limits[1] and sum(p[2] for p in pieces) <= limits[2]


def test_bpe_by_distinct_words(spark, monkeypatch):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    docs = docs_of(spark, ODD, extra=True).repartition(3)
    lists = {r["doc_id"]: r for r in word_shuffle.encode(docs, RANKS, public_tokenizers.PATTERN).collect()}
    short = {r["doc_id"]: r for r in word_shuffle.encode(docs, RANKS, public_tokenizers.PATTERN, word_shuffle._digest, word_shuffle.DIGEST).collect()}
    assert len(lists) == len(ODD)
    for i, text in enumerate(ODD):
        ids = own.encode_ordinary(text or "")
        assert lists[i]["ids"] == ids and lists[i]["decoded"] == (text or "").encode()
        assert short[i]["n_tokens"] == len(ids) and short[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert word_shuffle.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_texts_with_added_tokens(library):
    rng = random.Random(4)
    bits = ["<|endoftext|>", " ", "a", "<|", "x y", "\n", "", "é's", "|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 8))) for _ in range(1500)]
    ids, counts = bpe.LibraryEncoder(JSON).batch([t.encode() for t in texts])
    assert ids.tolist() == [i for t in texts for i in library(t)]
    assert counts.tolist() == [len(library(t)) for t in texts]


def test_ids_that_need_four_bytes(spark, library, tmp_path):
    assert bpe.largest_id(JSON) == 50256
    with pytest.raises(ValueError):
        records.pack_sequence(1, np.array([70_000]), 2)
    docs = spark.createDataFrame([(3, "some text")], "doc_id long, text string")
    row = records.token_records(docs, JSON, end_id=70_000, out_dir=f"file://{tmp_path}/r").first()
    ids = library("some text") + [70_000]
    assert tuple(row) == (3, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_records_and_packing_of_one_id(spark):
    texts = [f"text {i}" for i in range(200)]
    for key in (None, 7):
        docs = spark.createDataFrame([(key, t, "n", i) for i, t in enumerate(texts)], "doc_id long, text string, start string, offset int").repartition(3)
        got = records.token_records(docs, JSON).collect()
        assert len(got) == 200 and {r["doc_id"] for r in got} == {key}
        assert sorted(r["start"] for r in got) == np.cumsum([0] + [r["n_tokens"] for r in sorted(got, key=lambda r: r["start"])])[:-1].tolist()
        assert len({r["ids_crc32"] for r in got}) == 200
        pieces = packing.pack(docs, JSON).collect()
        assert {r["doc_id"] for r in pieces} == {key} and sum(r["length"] for r in pieces) == sum(r["n_tokens"] for r in got)
        assert [len(x.collect()) for x in (word_shuffle.encode(docs, RANKS, public_tokenizers.PATTERN), piece_counts.count_tokens(docs, PIECES))] == [200, 200]


def test_tasks_with_equal_first_blocks(spark, tmp_path):
    """Every task's first block is the same long text, or the same rows with null ids."""
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    long = " ".join(f"w{i % 5000}" for i in range(900_000))
    assert len(long) > bpe.BLOCK_BYTES
    rows = [[(1, long), (2, "first file's words")], [(1, long), (3, "others here")], [(None, "same"), (None, "more")], [(None, "same"), (None, "less")]]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/d")
    want = sorted((str(d), own.encode_ordinary(t)) for part in rows for d, t in part)
    docs = spark.read.parquet(f"{tmp_path}/d")
    for df in (docs, docs.repartition(4)):
        assert sorted((str(r["doc_id"]), r["ids"]) for r in word_shuffle.encode(df, RANKS, public_tokenizers.PATTERN).collect()) == want


def test_longest_match_automaton():
    pieces = ["▁", "▁a", "▁ab", "▁abc", "b", "bc", "bcd", "c", "cd", "d", "de", "▁abcdx", "xyz", "x"]
    automaton, rng = piece_counts.Automaton(pieces), random.Random(2)
    for _ in range(4000):
        word = "".join(rng.choice("abcdexyz") for _ in range(rng.randint(1, 12)))
        assert automaton.count(word) == piece_counts.greedy(word, set(pieces)), word


def test_token_counts_of_odd_rows(spark):
    schema = "doc_id long, text string, word string, n_tokens int"
    rows = [(None, "two words", "x", 1), (None, "two words", "x", 2), (3, None, "x", 3), (3, "", "x", 4)]
    got = piece_counts.count_tokens(spark.createDataFrame(rows, schema), PIECES).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["3", "3", "None", "None"]
    assert len({tuple(r) for r in got}) == 2
    assert piece_counts.count_tokens(spark.createDataFrame([], schema), PIECES).count() == 0


def test_token_counts(spark):
    every = piece_counts.read_pieces(PIECES)
    words = regex.compile(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")
    got = {r["doc_id"]: tuple(r)[1:] for r in piece_counts.count_tokens(docs_of(spark, ODD, extra=True), PIECES).collect()}
    for i, text in enumerate(ODD):
        counts = [piece_counts.greedy(w, set(every)) if len(w) < 100 else piece_counts.Automaton(every).count(w) for w in set(words.findall(text or ""))]
        found = dict(zip(set(words.findall(text or "")), counts, strict=True))
        n = [found[w] for w in words.findall(text or "")]
        assert got[i] == (len(n), sum(map(abs, n)), sum(x < 0 for x in n))
