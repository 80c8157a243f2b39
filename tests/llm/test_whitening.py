import numpy as np
import pytest

from riskloom.llm import whitening as W

DDL = "vec_id bigint, embedding array<double>, label int, component string, n string, dim string"


def rows_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0, "x", "y", "z") for i, v in rows], DDL).repartition(parts)


def brute(x, k):
    """n, exact deviations, whitened columns, shares of the variance."""
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    d = u - s / n
    v = d.T @ d / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    return n, dev, (x - s / n) @ vectors / np.sqrt(values), values / v.trace()


def test_equals_eigh(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 20)) * np.linspace(1, 9, 20) @ np.linalg.qr(rng.normal(size=(20, 20)))[0]
    v = np.concatenate([v, v[:80], v[:80] + 1e-9])  # repeats, before and after rounding
    out = W.whiten(rows_of(spark, list(enumerate(v.tolist()))), 6).toPandas()
    n, dev, w, share = brute(np.floor(v * 256).astype(np.int64), 6)
    assert (out.n == n).all() and len(out) == 460 * 6 and out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9
    got = out.pivot(index="vec_id", columns="component", values="whitened").loc[range(460)].values
    flip = np.sign((got * w).sum(0))
    assert np.abs(got * flip - w).max() < 1e-9
    assert np.allclose(out.groupby("component").explained.first().values, share, rtol=1e-12)
    assert [int(x) for x in out[out.component == 1].set_index("vec_id").loc[range(460)].deviation] == dev


@pytest.mark.parametrize("n, rank", [(1, 1), (7, 7), (30, 30), (31, 12), (40, 1)])
def test_factor_and_rotations(n, rank):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, rank)) * 10.0 ** rng.uniform(-3, 3, rank)
    v = a @ a.T
    order, low = W.pivoted_cholesky(v)
    assert low.shape == (n, rank) and np.allclose(np.triu(low, 1), 0)
    assert (np.diff(low.diagonal()) <= 1e-12 * low[0, 0]).all()
    assert np.abs(low @ low.T - v[order][:, order]).max() <= 1e-13 * n * np.abs(v).max()
    values, vectors = W.eigen(v)
    assert np.allclose(values, np.linalg.svd(a, compute_uv=False) ** 2, rtol=1e-5, atol=1e-12 * values[0])
    assert np.abs(vectors.T @ vectors - np.eye(rank)).max() < 1e-12
    assert np.abs((vectors * values) @ vectors.T - v).max() <= 1e-12 * np.abs(v).max()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [3.0, -2.0]), (None, [0.5, 0.0]), (3, None), (4, [nan, 1.0]), (5, [1.0, inf]),
            (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [5.0]), (10, [7.0]), (11, [-0.001])]
    out = W.whiten(rows_of(spark, rows)).collect()
    ids = sorted((str(r.vec_id), r.component) for r in out)
    # one vector of length 3 has no variance, vectors of length 1 have one component
    assert ids == sorted([(i, c) for i in ("1", "2", "2", "None") for c in (1, 2)] + [("9", 1), ("10", 1), ("11", 1)])
    assert {r.n for r in out} == {3} and all(r.identity_error < 1e-12 for r in out)
    x = np.array([[256, 512], [256, 512], [768, -512], [128, 0]])
    _, dev, w, _ = brute(x, 2)
    mine = sorted(int(r.deviation) for r in out if r.component == 1 and str(r.vec_id) in ("1", "2", "None"))
    assert mine == sorted(dev)
    assert W.whiten(rows_of(spark, [])).collect() == []
    assert W.whiten(rows_of(spark, [(1, [2.0, 2.0]), (2, [2.0, 2.0])])).collect() == []


def test_extreme_entries_are_exact(spark):
    def got(vectors):
        return {r.vec_id: r.deviation for r in W.whiten(rows_of(spark, list(enumerate(vectors)))).collect()}

    def want(x):
        s = [sum(c) for c in zip(*x)]
        dev = [sum((len(x) * a - b) ** 2 for a, b in zip(r, s)) for r in x]
        return {i: d if d < 10 ** 38 else None for i, d in enumerate(dev)}

    large = want([[2 ** 60, -2 ** 61], [2 ** 60 - 2 ** 10, 256], [-256, 1], [0, 0]])
    assert min(large.values()) > 1 << 63
    assert got([[2.0 ** 52, -2.0 ** 53], [2.0 ** 52 - 4, 1.0], [-1.0, 2.0 ** -8], [0.0, 0.0]]) == large
    ends = want([[2 ** 63 - 1, 0], [-2 ** 63, 256], [2 ** 61, -2 ** 62], [256, 256]])
    assert None in ends.values() and got([[1e300, 0.0], [-1e300, 1.0], [2.0 ** 53, -2.0 ** 54], [1.0, 1.0]]) == ends


def test_query(spark):
    import __spark_entry__ as E
    rows = E.queries()["op12_cholesky_jacobi"](spark, "/root/testdata/sf0.001").toPandas()
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas()
    n, dev, w, share = brute(np.floor(np.array(e.embedding.tolist(), float) * 256).astype(np.int64), 4)
    got = rows.pivot(index="vec_id", columns="component", values="whitened").loc[e.vec_id].values
    assert np.abs(np.abs(got) - np.abs(w)).max() < 1e-9 and (rows.n == n).all() and rows.identity_error.max() < 1e-9
    assert rows[rows.component == 1].set_index("vec_id").loc[e.vec_id].deviation.tolist() == dev
    assert rows.deviation.dtype == np.int64
