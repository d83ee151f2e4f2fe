import pytest

from sievelake.llm import near_dup


@pytest.mark.parametrize("n", range(1, 8))
def test_blocks_of_few_words(n):
    raw = [b" ".join(b"w%d" % i for i in range(n)), b""]
    sets = near_dup.shingle_sets(raw, 5)
    assert [len(s) for s in sets] == [max(1, n - 4), 0]
    assert (near_dup.shingle_sets([*raw, b"one two three four five six seven"], 5)[0] == sets[0]).all()


def test_a_table_of_one_short_text(spark):
    docs = spark.createDataFrame([(4, "two words")], "doc_id long, text string")
    assert [tuple(r) for r in near_dup.near_duplicates(docs, 5, 80).collect()] == [(4, 1, 4, True)]
