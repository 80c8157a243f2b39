import numpy as np
from conftest import SF_MID
from helpers import no_docs, odd_docs, odd_rows
from pyspark.sql import functions as F

from riskloom.llm import rule_quality
from riskloom.llm.common import table
from riskloom.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in QUERIES["op3_sparse_rules"](spark, SF_MID).collect()}
    labels = table(spark, SF_MID, "labels").collect()
    held = [(rows[r.doc_id], r.quality) for r in labels if rows[r.doc_id].held_out]
    assert len(held) > 80
    assert np.mean([r.predicted == q for r, q in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())


def test_rules_compile_to_a_column(spark):
    rules = [(2.0, (("a", True, 1.0), ("b", False, 3.0))), (-1.0, (("a", False, 1.0),))]
    rows = spark.createDataFrame([(0.5, 4.0), (0.5, 2.0), (2.0, 9.0)], "a double, b double")
    got = [r.s for r in rows.select(rule_quality.score((0.25, rules)).alias("s")).collect()]
    assert np.allclose(got, [1 / (1 + np.exp(-x)) for x in (2.25, 0.25, -0.75)])
    assert "PythonUDF" not in rows.select(rule_quality.score((0.25, rules)))._jdf.queryExecution().toString()


def test_odd_rows_and_nothing_to_learn(spark):
    stats = rule_quality.statistics(odd_docs(spark))
    assert stats.count() == len(odd_rows())
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    one = spark.createDataFrame([(4, 1), (4, None), (None, 0), (6, 1)], "doc_id bigint, quality int")
    for labels, want in ((none, 0.5), (one, 1 - 1e-6)):
        model = rule_quality.fit(stats, labels)
        got = [r.s for r in stats.select(rule_quality.score(model).alias("s")).collect()]
        assert len(got) == len(odd_rows()) and np.allclose(got, want)
    both = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id bigint, quality int")
    assert stats.select(rule_quality.score(rule_quality.fit(stats, both)).alias("s")).where(F.col("s").isNull()).count() == 0
    assert rule_quality.statistics(no_docs(spark)).count() == 0


def test_repeated_ids_and_lost_classes(spark):
    good, bad = "A quiet sentence stands here, and another one follows it.", "#$%& ||| 99 @@@ ~~~"
    for ids in ((1, 2), (None, 2)):
        rows = [(ids[i % 2], (good if i % 2 else bad) + f" {i % 50}", "en", "a", 0) for i in range(2000)]
        stats = rule_quality.statistics(spark.createDataFrame(rows, no_docs(spark).schema).repartition(3))
        labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id bigint, quality int")
        got = {r.doc_id: r.s for r in stats.select("doc_id", rule_quality.score(rule_quality.fit(stats, labels, max_rows=10)).alias("s")).collect()}
        assert got[2] > 0.5 and (ids[0] is None or got[1] < 0.5)
    # one class is two rows of three thousand: a cut by hash leaves it out
    rows = [(i, (bad if i < 2 else good) + f" {i}", "en", "a", 0) for i in range(3000)]
    stats = rule_quality.statistics(spark.createDataFrame(rows, no_docs(spark).schema))
    labels = spark.createDataFrame([(i, int(i > 1)) for i in range(3000)], "doc_id bigint, quality int")
    model = rule_quality.fit(stats, labels, max_rows=20)
    got = {r.doc_id: r.s for r in stats.select("doc_id", rule_quality.score(model).alias("s")).collect()}
    assert max(got[0], got[1]) < min(s for i, s in got.items() if i > 1)


def brute_statistics(text):
    data = text.encode()
    classes = {"space": b" \t\r\x0b\x0c", "newline": b"\n", "symbol": b"#*$%&<>@^~_=+", "stop": b".,", "bang": b"!?", "bar": b"|",
               "digit": b"0123456789", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "wide": bytes(range(128, 256))}
    out = {f"share_{k}": sum(b in v for b in data) / max(len(data), 1) for k, v in classes.items()}
    out["share_punct"] = sum(not any(b in v for v in classes.values()) for b in data) / max(len(data), 1)
    words, lines = data.split(), data.split(b"\n")
    n = max(len(words), 1)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    again = sum(bool(x.split()) and x in lines[:i] for i, x in enumerate(lines))
    return out | {"log_words": np.log1p(len(words)), "word_bytes": sum(map(len, words)) / n, "distinct_words": len(set(words)) / n,
                  "repeated_words": len(covered) / n, "words_a_line": len(words) / len(lines), "repeated_lines": again / len(lines)}


def test_statistics_equal_brute_force(spark):
    texts = ["", "one", "a b c d e f a b c d e f", "x\nx\n\ny\nx", "Ünï #1! | ok?\ta_b", " \n ", "w " * 40 + "end."]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], no_docs(spark).schema)
    for r in rule_quality.statistics(df).collect():
        want = brute_statistics(texts[r.doc_id])
        assert all(abs(r[k] - v) < 1e-12 for k, v in want.items()) and set(want) == set(rule_quality.STATISTICS), texts[r.doc_id]


def test_rules_are_the_paths_of_the_trees(spark):
    """A rule holds for exactly the rows that pass its node: summed over the leaves, every tree places a row once."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(3)
    x = rng.random((300, 2))
    rows = spark.createDataFrame([(float(a), float(b), float(a > 0.5) if b > 0.4 else float(a < 0.2)) for a, b in x], "a double, b double, label double")
    train = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    model = GBTClassifier(maxIter=3, maxDepth=3, seed=1).fit(train.select("features", "label"))
    rules = rule_quality.paths(model, ["a", "b"])
    want = set()

    def walk(node, conditions):
        if conditions:
            low, high = {}, {}
            for k, most, at in conditions:
                (high if most else low)[k] = min(at, high.get(k, np.inf)) if most else max(at, low.get(k, -np.inf))
            want.add(tuple(sorted([(k, False, v) for k, v in low.items()] + [(k, True, v) for k, v in high.items()])))
        if hasattr(node, "leftChild") and "InternalNode" in node.getClass().getSimpleName():
            k, at = ["a", "b"][node.split().featureIndex()], float(node.split().threshold())
            walk(node.leftChild(), [*conditions, (k, True, at)])
            walk(node.rightChild(), [*conditions, (k, False, at)])
    for tree in model.trees:
        walk(tree._call_java("rootNode"), [])
    assert set(rules) == want and len(rules) == len(want)
