import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from sievelake.llm.common import default_tokenizer  # noqa: E402

from .test_duplicates import brute_lines, brute_near  # noqa: E402


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(11)
    words = [f"w{i}x" for i in range(300)]
    lines = ["A line that stands in many documents", "Another line seen again and again"]
    docs, toxic = [], set()
    for i in range(240):
        text = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        if i % 8 == 0:
            text.insert(5, rng.choice(["grubbery", "oafishly"]))
            toxic.add(i)
        body = " ".join(text)
        docs.append((i, "\n".join([body, *(x for x in lines if rng.random() < 0.1)])))
    for i in range(240, 300):  # near and exact copies of clean documents
        base = docs[rng.choice([k for k in range(240) if k % 8])][1].split(" ")
        if i % 2:
            base[len(base) // 2] = "changed"
        docs.append((i, " ".join(base)))
    docs += [(300, None), (301, ""), (302, lines[0]), (303, lines[0]), (304, lines[0] + "\n" + lines[1])]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    now, want = spark.read.parquet(f"{tmp_path}/documents.parquet"), [d for d in docs if d[0] not in toxic]
    columns = now.columns
    kept = corpus_pipeline.drop_toxic(spark, now, str(tmp_path))
    assert kept.columns == columns and sorted((r["doc_id"], r["text"]) for r in kept.collect()) == want
    dropped = brute_lines(want)
    want = [(i, t) for i, _, n, t in dropped if n == 0 or t]
    cut = corpus_pipeline.drop_lines(spark, kept, str(tmp_path))
    assert cut.columns == columns and sorted((r["doc_id"], r["text"] or "") for r in cut.collect()) == sorted(want)
    assert all(r["n_chars"] == len(r["text"] or "") for r in cut.collect())
    good = {int(s[1:].split(",")[0]) for s in brute_near(want, 5, 80) if s.endswith("True)")}
    want = {i: t for i, t in want if i in good}
    near = corpus_pipeline.drop_near_duplicates(spark, cut, str(tmp_path))
    assert near.columns == columns and {r["doc_id"]: r["text"] or "" for r in near.collect()} == want
    assert len(want) < 260

    library = Tokenizer.from_file(default_tokenizer("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert set(pieces) == set(want)
    for i, text in want.items():
        ids, at = library.encode(text, add_special_tokens=False).ids + [0], 0
        for start, length, crc, total in sorted(pieces[i]):
            assert start == at and total == len(ids) and crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
            at += length
        assert at == len(ids)


def test_odd_tables(spark, tmp_path):
    """Empty tables, null and repeated doc_ids, columns named like those that the stages add."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, `__score` string, `__SEAL` int, `__doc` int, label string, `a.b` int, `__n_lines` int"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.pack(spark, empty, str(tmp_path)).count() == 0

    line = "The same line that stands in every text"
    texts = [(None, "one two three four five six seven\n" + line), (None, "other words stand in this one here\n" + line), (4, "a third text of its own words\n" + line), (4, line)]
    texts += [(5, None), (5, None), (None, "")]
    rows = [(i, t, "en", "s", len(t or ""), "x", 1, 2, "l", 3, 4) for i, t in texts]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    calm = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert sorted(map(str, calm.collect())) == sorted(map(str, docs.collect()))
    cut = corpus_pipeline.drop_lines(spark, calm, str(tmp_path))
    assert cut.columns == docs.columns
    # three documents' worth of nothing: null ids are one document, so the line stands in two only
    assert sorted(map(str, cut.collect())) == sorted(map(str, docs.collect()))
    kept = corpus_pipeline.drop_near_duplicates(spark, cut, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    pieces = corpus_pipeline.pack(spark, kept, str(tmp_path)).collect()
    assert len({(r["doc_id"], r["ids_crc32"]) for r in pieces if r["start"] == 0}) >= 5 and sum(r["start"] == 0 for r in pieces) == len(rows)
