import random
import re
from collections import defaultdict

import pytest
from helpers import clones, no_docs, odd_docs, odd_rows, prose

from riskloom.llm import ngram_join


def brute(rows, k, percent):
    sets, ids = [], []
    for i, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        sets.append({tuple(w[j:j + k]) for j in range(max(len(w) - k + 1, 1))} if w else set())
        ids.append(i)
    part = list(range(len(ids)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x
    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                part[find(a)] = find(b)
    least = defaultdict(list)
    for a, i in enumerate(ids):
        least[find(a)].append(i)
    return sorted(((i, len(s), min((x for x in least[find(a)] if x is not None), default=None) if s else i)
                   for a, (i, s) in enumerate(zip(ids, sets))), key=str)


def got(docs, **kw):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link(docs, **kw).collect()), key=str)


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_equals_brute_force(spark, k, percent):
    rows = clones()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert got(docs, words=k, percent=percent) == brute(rows, k, percent)


def test_large_group_of_near_copies_and_a_hot_passage(spark):
    rng = random.Random(5)
    base, passage = prose(rng, 200).split(), prose(rng, 60)
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    own = [f"w{i}" for i in range(3000)]
    rows += [(1000 + i, passage + " " + prose(rng, rng.randrange(1, 90), own)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    assert got(docs) == brute(rows, 4, 85)


def test_odd_rows(spark):
    assert got(odd_docs(spark)) == brute([(r[0], r[1]) for r in odd_rows()], 4, 85)


def test_empty_table(spark):
    assert got(no_docs(spark)) == []
