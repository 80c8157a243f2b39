import random

import pytest

from riskloom.llm.common import components


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(1)
    edges = {"chain": [(i, i + 1) for i in range(40)], "star": [(7, i) for i in range(50)],
             "random": [(rng.randrange(90), rng.randrange(90)) for _ in range(60)], "none": []}[kind]
    part = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                part[a] = part[b] = min(part[a], part[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == part
