import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def text(name, n=30):
    return " ".join(f"{name}{i}" for i in range(n))


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, s, len(t or "")) for i, t, s in rows], "doc_id long, text string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(((r["doc_id"], r["text"], r["source"]) for r in out.collect()), key=str)


def test_unique_texts_stay_whatever_rows_share_their_id(spark):
    rows = [(1, text("a"), "x"), (None, text("a") + " more", "x"), (None, text("b"), "x"), (None, text("c"), "y")]
    rows += [(5, text("a"), "x"), (5, text("d"), "x"), (None, None, "x"), (None, "", "x"), (5, None, "x"), (5, None, "x")]
    want = [r for k, r in enumerate(rows) if k not in (1, 4)]
    assert kept(spark, rows) == sorted(want, key=str)


def test_one_row_of_each_group_stays(spark):
    rows = [(7, text("a"), s) for s in "zyx"]  # repeated rows
    rows += [(None, text("b") + end, "x") for end in ("", " end", " fin", "")]  # all ids null
    rows += [(8, text("c") + end, "x") for end in ("", " end")]  # one id, two near texts
    rows += [(9, text("c"), "x"), (None, text("c"), "x"), (10, text("d"), "x")]
    out = kept(spark, rows)
    assert [r for r in out if r[0] in (7, 10)] == sorted([(7, text("a"), "x"), (10, text("d"), "x")], key=str)
    assert [r[0] for r in out if r[1].startswith("b0")] == [None]
    assert [r[0] for r in out if r[1].startswith("c0")] == [8]
    assert len(out) == 4
    assert out == kept(spark, rows[::-1])
