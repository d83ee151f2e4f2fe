import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from sievelake.llm import forest


def brute(x, threshold=0.9):
    """n_links and smallest row reachable of each row."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = [np.flatnonzero(row >= threshold) for a in range(0, len(x), 1000) for row in x[a : a + 1000] @ x.T]
    least, done = np.arange(len(x)), np.zeros(len(x), bool)
    for i in range(len(x)):
        todo = [] if done[i] else [i]
        done[i] = True
        while todo:
            near = linked[todo.pop()]
            fresh = near[~done[near]]
            done[fresh], least[fresh] = True, i
            todo += fresh.tolist()
    return np.array([len(n) - 1 for n in linked]), least


def test_a_dense_cluster_loses_no_link(spark, tmp_path):
    rng = np.random.default_rng(21)
    n, dim = 20_100, 64
    x = rng.standard_normal((n, dim))
    x[::3] = rng.standard_normal(dim) + 0.3 * rng.standard_normal((len(x[::3]), dim))
    x[1:3000:3] = x[4:3003:3] + 0.05 * rng.standard_normal((1000, dim))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": list(x)}), f"{tmp_path}/v.parquet", row_group_size=3000)
    rows = forest.near_vectors(spark.read.parquet(f"{tmp_path}/v.parquet")).toPandas().sort_values("vec_id")
    links, least = brute(x)
    assert links.max() > 5000
    print("links found", rows["n_links"].sum(), "of", links.sum())
    assert np.array_equal(rows["n_links"], links)
    assert np.array_equal(rows["component_id"], least) and np.array_equal(rows["kept"], least == np.arange(n))


def test_recall_with_fifty_thousand_vectors(spark, tmp_path):
    """Beyond the sample whose links no cut parts: 10,000 near copies, pairs near the threshold, the rest at random."""
    rng = np.random.default_rng(23)
    n, dim = 50_000, 64
    x = rng.standard_normal((n, dim))
    x[:10_000] = x[0] + 0.2 * rng.standard_normal((10_000, dim))
    base = x[20_000:23_000] / np.linalg.norm(x[20_000:23_000], axis=1, keepdims=True)
    off = rng.standard_normal(base.shape)
    off -= (off * base).sum(1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cosine = np.repeat([0.905, 0.93, 0.96], 1000)[:, None]
    x[30_000:33_000] = cosine * base + np.sqrt(1 - cosine**2) * off
    order = rng.permutation(n)
    x = x[order].astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": list(x)}), f"{tmp_path}/v.parquet", row_group_size=5000)
    rows = forest.near_vectors(spark.read.parquet(f"{tmp_path}/v.parquet")).toPandas().sort_values("vec_id")
    u = forest.unit(x.astype(np.float64))
    links = np.concatenate([(u[a : a + 1000] @ u.T >= 0.9).sum(1) - 1 for a in range(0, n, 1000)])
    found = rows["n_links"].to_numpy()
    pairs = (order >= 20_000) & (order < 33_000) & (links > 0)
    print("links found", found.sum(), "of", links.sum(), "; pairs apart", found[pairs].sum(), "of", links[pairs].sum())
    assert (found <= links).all()
    assert found.sum() >= 0.99 * links.sum() and found[pairs].sum() >= 0.98 * links[pairs].sum()
