import duckdb
import pytest
from helpers import DOC_DDL, no_docs, odd_docs, odd_rows

from riskloom.llm import mixing


def filled(sizes, weights):
    """Targets by raising the water level step by step."""
    goal, total = {}, 1.5 * sum(sizes.values())
    free = dict(weights)
    while free:
        left = total - sum(goal.values())
        level = left / sum(free.values())
        over = [s for s in free if level * free[s] >= 2 * sizes[s]]
        if not over:
            return goal | {s: level * w for s, w in free.items()}
        for s in over:
            goal[s] = 2.0 * sizes[s]
            del free[s]
    return goal


@pytest.mark.parametrize("sizes", [[5, 5, 5], [1000, 1, 1, 1], [1, 1, 1000, 3, 0, 7, 7], [0, 0], [3]])
def test_targets(spark, sizes):
    named = {f"s{i}": n for i, n in enumerate(sizes)}
    got = {r.source: r.target for r in mixing.targets(
        spark.createDataFrame(list(named.items()), "source string, source_size bigint")).collect()}
    want = filled(named, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(named))})
    assert got == pytest.approx(want)


def test_cut_is_exact(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (i % 17 + 1)), "en", f"s{i % 5}", 0) for i in range(400)], DOC_DDL)
    rows = mixing.mix(docs.repartition(6)).collect()
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert sum(r.taken for r in own) == int(own[0].target + 0.5)
        assert sum(0 < r.cut < r.size for r in own) <= 1
        assert all(r.taken <= 2 * r.size for r in own)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_rows_repeat_as_the_plan_says(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (i % 9 + 1)), "en", f"s{i % 4}", 0) for i in range(200)], DOC_DDL)
    plan = {r.doc_id: r for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    times = {}
    for r in out.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    for i, r in plan.items():
        whole = r.epochs + (1 if 2 * r.cut >= r.size else 0)
        assert times.get(i, 0) == whole, r


def test_odd_rows_and_sql(spark):
    docs = odd_docs(spark)
    rows = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", odd_rows())
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, con.execute(mixing.ORACLE).fetchall()))
    assert all(len(r) == len(docs.columns) for r in mixing.mixed(docs).collect())


def test_empty_table(spark):
    assert mixing.mix(no_docs(spark)).count() == 0 and mixing.mixed(no_docs(spark)).count() == 0
