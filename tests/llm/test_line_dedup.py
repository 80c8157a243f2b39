import hashlib
from collections import defaultdict

import pytest
from helpers import no_docs, odd_docs, odd_rows

from riskloom.llm import line_dedup as L

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, min_docs, min_chars=1):
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(held[key(x)]) < min_docs]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def got(df, **options):
    out = L.dedup(df, **options)
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    return sorted(map(tuple, out.collect()), key=str)


def test_equals_brute_force(spark):
    rows = []
    for i in range(60):
        lines = [f"own line {i}", "Licence  A" if i % 3 else " licence  a\t", "", f"of {i // 6}", "\x0b", "ÄÖ tail", "ÄÖ tail" if i % 2 else "äö tail"]
        rows.append((i, "\n".join(lines[i % 5:] + lines[:i % 4])))
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(5)
    for least in (2, 10, 31):
        want = brute(rows, least)
        assert any(r[3] for r in want)
        assert got(df, min_docs=least) == want
    assert got(df, min_docs=2, min_chars=7) == brute(rows, 2, 7)


def test_threshold_counts_documents(spark):
    rows = [(i, "a\na\na\nb") for i in range(9)] + [(8, "a"), (8, "A ")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    assert got(df) == brute(rows, 10) and not any(r[3] for r in got(df))  # nine ids, eleven rows
    rows.append((9, "\ta"))
    more = got(spark.createDataFrame(rows, "doc_id int, text string"))
    assert more == brute(rows, 10) and (9, "", 1, 1) in more


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert got(odd_docs(spark), min_docs=2) == brute(rows, 2)
    assert got(no_docs(spark)) == []
    long = [(i, "\n".join(f"{n % 977} x" for n in range(40_000))) for i in (1, 2, None, None)]
    assert got(spark.createDataFrame(long, "doc_id int, text string"), min_docs=3) == brute(long, 3)
    assert got(spark.createDataFrame(long, "doc_id int, text string"), min_docs=4) == brute(long, 4)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    import __spark_entry__ as E
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 10)
    rows = E.queries()["op13_line_hashes"](spark, f"/root/testdata/{sf}").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(
        ((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in want), key=str)
    assert any(r.n_dropped for r in rows)
