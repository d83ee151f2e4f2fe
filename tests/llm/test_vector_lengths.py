import numpy as np

from sievelake.llm import forest

from .test_dense_vectors import brute


def test_vectors_of_every_length_link_with_their_own(spark):
    rng = np.random.default_rng(22)
    rows, want = [], []
    for dim, n in ((8, 60), (5, 40), (3, 20)):
        x = rng.standard_normal((n, dim))
        x[n // 2 :] = x[: n // 2] + 0.05 * rng.standard_normal((n // 2, dim))
        x[1] = x[0]  # an exact copy
        links, least = brute(x)
        want += [(len(rows) + i, int(links[i]), len(rows) + int(least[i]), bool(least[i] == i)) for i in range(n)]
        rows += [(len(rows) + i, v.tolist()) for i, v in enumerate(x)]
    rows.append((999, [2.0]))
    want.append((999, 0, 999, True))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(tuple(r) for r in forest.near_vectors(df, leaf=16).collect()) == want
