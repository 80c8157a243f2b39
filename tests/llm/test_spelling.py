import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import no_docs, odd_docs, odd_rows

from riskloom.llm import spelling as L

DDL = "doc_id bigint, text string"


def brute_words(rows, drop_mod=97, min_chars=5, min_n=3):
    found = Counter()
    for i, text in rows:
        for raw in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop_mod and h % drop_mod == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if n >= min_n and len(w) >= min_chars}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[p + (len(a) >= len(b)):] == b[p + (len(b) >= len(a)):]


def brute(words):
    form, near = {}, {}
    for w, n in words.items():
        own = sorted((-m, v) for v, m in words.items() if one_apart(w, v))
        near[w] = len(own)
        form[w] = own[0][1] if own and -own[0][0] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, near[w], words.get(form[w])))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_words(spark):
    rng = random.Random(4)
    letters = "abcABCÄäéÿ×÷xyz"
    rows = [(rng.choice((None, i, i, i)), " ".join("".join(rng.choices(letters, k=rng.choice((1, 3, 5, 6, 45)))) * rng.choice((1, 1, 3))
                                                 + rng.choice(("", ",", "1", "ā", "你", "\U0001f600", "²")) for _ in range(80))) for i in range(60)]
    rows = rows + rows[:20] + rows[:20]
    df = spark.createDataFrame(rows, DDL).repartition(3)
    for mod, chars, n in ((97, 5, 3), (3, 1, 1), (0, 4, 2)):
        want = brute_words(rows, mod, chars, n)
        assert len(want) > 20
        assert dict(L.words(df, drop_mod=mod, min_chars=chars, min_n=n).collect()) == want


def test_groups_equal_brute_force(spark):
    rng = random.Random(7)
    base = ["".join(rng.choices("abcdeé", k=rng.randrange(4, 11))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "abababa"]
    found = {}
    for w in base:
        for _ in range(8):
            v = list(w)
            for _ in range(rng.choice((0, 1, 1, 2))):
                p, kind = rng.randrange(len(v)), rng.randrange(3)
                v[p:p + (kind > 0)] = rng.choice("abcdeé") * (kind < 2)
            if len(v) >= 4:
                found["".join(v)] = rng.choice((3, 3, 4, 6, 12, 25, 50, 101, 1000))
    want = brute(found)
    assert sum(r[4] for r in want) > 300 and any(r[2] != (r[1] or r[0]) for r in want)
    df = spark.createDataFrame(sorted(found.items()), "word string, n bigint").repartition(4)
    assert got(L.group(df)) == want


def test_all_pairs_of_a_small_alphabet(spark):
    words = ["".join("ab"[i >> k & 1] for k in range(n)) for n in (4, 5, 6, 7) for i in range(1 << n)]
    want = brute({w: 3 for w in words})
    assert got(L.group(spark.createDataFrame([(w, 3) for w in words], "word string, n bigint"))) == want


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = np.random.default_rng(2)
    for places in (3, 4, 9):
        cost = rng.integers(0, 6, (200, places)).astype(float)
        cost[rng.random(cost.shape) < 0.3] = np.inf
        cost[:, [0, -1]] = np.where(np.isinf(cost[:, [0, -1]]), 9, cost[:, [0, -1]])
        at = L.pivots(cost)
        assert (at[:, 1] - at[:, 0] >= 2).all()
        for row, (p, q) in zip(cost, at.tolist()):
            assert row[p] + row[q] == min(row[i] + row[j] for i in range(places) for j in range(i + 2, places))


def test_long_words_and_chains(spark):
    found = {"x" * 30_000: 3, "x" * 30_001: 9, "x" * 29_999 + "y": 4, "chain": 3, "chainb": 6, "chainbc": 12, "chainbcd": 24, "chainbcde": 49}
    out = {r[0]: r for r in got(L.group(spark.createDataFrame(list(found.items()), "word string, n bigint")))}
    assert out["x" * 30_000][1:] == ("x" * 30_001, "x" * 30_001, 3, 2, 9)
    assert out["x" * 29_999 + "y"][1:] == (None, "x" * 29_999 + "y", 4, 1, None)
    assert out["chain"][2] == out["chainbcd"][2] == out["chainbcde"][2] == "chainbcde"


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    want = brute(brute_words(rows))
    assert want and got(L.group(L.words(odd_docs(spark)))) == want
    assert got(L.group(L.words(no_docs(spark)))) == []


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_and_sql(spark, sf):
    import __spark_entry__ as E
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    want = brute(brute_words([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    assert got(E.queries()["op11_pivotal_grams"](spark, f"/root/testdata/{sf}")) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    assert sorted(con.execute(E.oracle_sql()["op11_pivotal_grams"]).fetchall(), key=str) == want
