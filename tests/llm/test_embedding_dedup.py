import numpy as np
import pytest

from riskloom.llm import embedding_dedup as E

DDL = "vec_id bigint, embedding array<float>, label int, cid string, n int"


def brute(rows, least=0.98):
    vecs = []
    for _, v, label, *_ in rows:
        ok = v is not None and label is not None and None not in v and np.isfinite(v).all() and np.any(v)
        vecs.append(np.array(v, np.float32).astype(float) if ok else None)
    n = len(rows)
    part, links = list(range(n)), [0] * n

    def find(x):
        while part[x] != x:
            x = part[x]
        return x
    for i in range(n):
        for j in range(i):
            a, b = vecs[i], vecs[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) \
                    and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= least:
                links[i] += 1
                links[j] += 1
                part[find(i)] = find(j)
    least_ = {}
    for i in range(n):
        if rows[i][0] is not None:
            r = find(i)
            least_[r] = min(least_.get(r, rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], links[i], rows[i][0] if vecs[i] is None else least_.get(find(i))) for i in range(n)), key=str)


def got(spark, rows, parts=3):
    out = E.link(spark.createDataFrame(rows, DDL).repartition(parts)).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=str)


@pytest.mark.parametrize("held", [E.BLOCK_BYTES, 2 * 16 * 24 * 8, 1])
def test_equals_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(E, "TILE", 16)
    monkeypatch.setattr(E, "BLOCK_BYTES", held)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 24))
    rows = []
    for i in range(150):
        v = base[i % 6] + rng.normal(size=24) * rng.choice((0, 0.05, 0.14, 0.3, 2))
        rows.append((i, v.astype(np.float32).tolist(), int(i % 7 == 0), "x", 0))
    want = brute(rows)
    assert any(n for _, n, _ in want)
    assert got(spark, rows) == want


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (3, [2.0, 4.0, 6.0], 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [0.0, 0.0, 0.0], 0),
            (8, [1.0, None, 3.0], 0), (9, [float("nan"), 1.0, 1.0], 0), (10, [float("inf"), 1.0, 1.0], 0), (11, [], 0),
            (12, [1.0, 2.0], 0), (None, v, 0), (None, [9.0, -1.0, 0.0], 2), (13, [1.0, 2.0, 3.1], 0)]
    rows = [(*r, "x", 0) for r in rows]
    assert got(spark, rows) == brute(rows)


def test_ends_of_the_range(spark):
    top, low = 1.7e308, 5e-324
    vecs = [(1, [1e200, 1e200]), (2, [1e200, 1e200]), (3, [1e-200, 1e-200]), (4, [2e-200, 2e-200]), (5, [low, low]),
            (6, [top, top]), (7, [top, -top]), (8, [1e200, 1e-200]), (9, [low, 0.0]), (10, [-low, 0.0]), (11, [3.0, 3.1])]
    rows = spark.createDataFrame([(i, v, 0) for i, v in vecs], "vec_id bigint, embedding array<double>, label int")
    out = {r.vec_id: (r.n_links, r.component_id) for r in E.link(rows.repartition(3)).collect()}
    assert out == {**{i: (6, 1) for i in (1, 2, 3, 4, 5, 6, 11)}, 7: (0, 7), 8: (1, 8), 9: (1, 8), 10: (0, 10)}


def test_a_tile_is_shipped_once_a_block_pair(spark):
    """All tiles wanted with all: as many copies of a tile as there are blocks, whatever the tiles."""
    for n in (16, 80):
        tiles = spark.createDataFrame([(1, (i // 7 << 32) + i % 7, [0.0], [1.0], [i], [1], b"") for i in range(n)],
                                      "label int, tile bigint, low array<double>, high array<double>, ids array<bigint>, "
                                      "n array<bigint>, vecs binary")
        dealt = E._blocks(tiles, 4)
        assert sorted(r["count"] for r in dealt.groupBy("block").count().collect()) == [n // 8] * 8
        a, b = (dealt.select("label", dealt["tile"].alias("t" + k), dealt["block"].alias(s)) for k, s in (("a", "one"), ("b", "two")))
        shipped = E._shipped(tiles, a.join(b, "label").where("ta <= tb")).collect()
        assert len(shipped) == n * 8
        assert sum(len(r.others) for r in shipped) == n * (n + 1) // 2


def test_empty_table(spark):
    assert got(spark, []) == []


@pytest.mark.parametrize("dim", [1, 3, 40])
def test_bounds_lose_no_pair(dim):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(80, dim))
    x = np.concatenate([x, x[:30] + rng.normal(size=(30, dim)) * 0.1])
    x /= np.sqrt((x * x).sum(1))[:, None]
    i, j = E.candidates(x, x, 0.95)
    assert {(a, b) for a, b in zip(i.tolist(), j.tolist())} >= set(map(tuple, np.argwhere(x @ x.T >= 0.95).tolist()))


def test_forest_joins_what_the_links_join():
    rng = np.random.default_rng(1)
    i, j = rng.integers(0, 60, 45), rng.integers(0, 60, 45)
    a, b = E.forest(i, j, 60)

    def parts(x, y):
        p = list(range(60))
        for _ in range(60):
            for s, t in zip(x.tolist(), y.tolist()):
                p[s] = p[t] = min(p[s], p[t])
        return p
    assert parts(i, j) == parts(a, b) and len(a) < 60
