"""Quality classifier by a sparse rule ensemble.

Statistics of every whole text are the features. Boosted trees are fitted to the labelled rows,
every path from a root to a node becomes a conjunctive rule over the statistics, a lasso logistic
regression over the rules keeps few of them, and those kept are compiled into one Spark column
expression that scores all rows.

Fitting takes about ``max_rows`` labelled rows at most (those of lowest hash of id and statistics, rows equal in
both once; where that would leave out a class, the lowest of each class), scoring all rows and whole texts, however
long. Null and empty texts have zero for every statistic and are scored like others; null ids match no label;
several labels of one id are averaged. Where there is nothing to learn from, or one class only, the
score is the share of label 1 (0.5 without labels). Repeated rows give repeated rows, an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_texts, hashed_words, map_slices, stored
from .fertility import repeated_lines, repeated_words

#: Byte classes that are counted, each as a share of the text's bytes.
CLASSES = ("space", "newline", "upper", "lower", "digit", "symbol", "stop", "bang", "bar", "punct", "wide")


def _class_table() -> np.ndarray:
    t = np.full(256, CLASSES.index("punct"), np.int64)
    for name, chars in (("space", " \t\r\x0b\x0c"), ("newline", "\n"), ("symbol", "#*$%&<>@^~_=+"), ("stop", ".,"),
                        ("bang", "!?"), ("bar", "|"), ("digit", "0123456789"),
                        ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("lower", "abcdefghijklmnopqrstuvwxyz")):
        t[[ord(c) for c in chars]] = CLASSES.index(name)
    t[128:] = CLASSES.index("wide")
    return t


TABLE = _class_table()
STATISTICS = (*(f"share_{c}" for c in CLASSES), "log_words", "word_bytes", "distinct_words", "repeated_words",
              "words_a_line", "repeated_lines")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, STATISTICS) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            texts = byte_texts(batch, text_col)
            n = len(texts)
            size = np.fromiter(map(len, texts), np.int64, n)
            key = np.repeat(np.arange(n) * len(CLASSES), size) + TABLE[np.frombuffer(b"".join(texts), np.uint8)]
            shares = np.bincount(key, minlength=n * len(CLASSES)).reshape(n, -1) / np.maximum(size, 1)[:, None]
            start, end, h = hashed_words(b"\n".join(texts))
            cuts = np.searchsorted(start, np.concatenate([[0], np.cumsum(size + 1)]))
            counts = np.diff(cuts)
            some = np.maximum(counts, 1)
            kinds = [len(np.unique(h[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            sums = np.concatenate([[0], np.cumsum(end - start)])
            letters = sums[cuts[1:]] - sums[cuts[:-1]]
            lines = np.array([t.count(b"\n") + 1 for t in texts])
            out = {id_col: batch.column(id_col)} | {f"share_{c}": shares[:, i] for i, c in enumerate(CLASSES)}
            return out | {"log_words": np.log1p(counts), "word_bytes": letters / some,
                          "distinct_words": np.array(kinds) / some,
                          "repeated_words": repeated_words(h, counts) / some, "words_a_line": counts / lines,
                          "repeated_lines": np.array([repeated_lines(t) for t in texts]) / lines}
        return f

    return map_slices(docs.select(id_col, text_col), make,
                      f"`{id_col}` {kind}, " + ", ".join(f"{s} double" for s in STATISTICS), text_col)


Rule = tuple[tuple[str, bool, float], ...]  # (statistic, at most, threshold) of each condition


def paths(model, names: Iterable[str]) -> list[Rule]:
    """Every path from a root to another node of the trees, conditions on one statistic and side
    merged, each rule once."""
    names, rules = list(names), {}

    def walk(node, low: dict, high: dict) -> None:
        if low or high:
            rule = tuple(sorted([(k, False, v) for k, v in low.items()] + [(k, True, v) for k, v in high.items()]))
            rules.setdefault(rule)
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            k, at = names[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), low, high | {k: min(at, high.get(k, np.inf))})
            walk(node.rightChild(), low | {k: max(at, low.get(k, -np.inf))}, high)

    for tree in model.trees:
        walk(tree._call_java("rootNode"), {}, {})
    return list(rules)


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for name, most, at in rule:
        out = out & ((F.col(name) <= at) if most else (F.col(name) > at))
    return out.cast("double")


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
        max_rows: int = 40_000, trees: int = 12, depth: int = 3, lasso: float = 0.002) -> tuple[float, list[tuple[float, Rule]]]:
    """(intercept, weighted rules) learned from the rows of ``stats`` that have a label."""
    own = (labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
           .agg(F.avg(F.col(label_col).cast("double")).alias("avg")))
    rows = stats.join(own, stats[id_col] == own["_id"]).select(
        *STATISTICS, F.expr("cast(avg >= 0.5 as double)").alias("label"),
        F.xxhash64(id_col, *STATISTICS, F.lit(7)).alias("key")).withColumn("h", F.pmod("key", F.lit(1 << 30)))
    rows = stored(rows, "labelled")
    total, ones = rows.agg(F.count("*"), F.sum("label")).first()
    if not total or ones in (0, total):
        share = ones / total if total else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return float(np.log(share / (1 - share))), []
    once = rows.dropDuplicates(["key", "label"])
    some = stored(once.where(F.col("h") < int((1 << 30) * min(1.0, max_rows / total))), "sample")
    if some.select("label").distinct().count() < 2:
        order = Window.partitionBy("label").orderBy("h", "key")
        some = stored(once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= max(max_rows // 2, 1)).drop("r"), "sample")
    rows = some
    train = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows)
    boosted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, maxBins=64, subsamplingRate=1.0,
                            featureSubsetStrategy="all", seed=5).fit(train.select("features", "label"))
    rules = paths(boosted, STATISTICS)
    if not rules:
        share = ones / total
        return float(np.log(share / (1 - share))), []
    wide = rows.select("label", *[holds(r).alias(f"r{i}") for i, r in enumerate(rules)])
    wide = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(wide)
    linear = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False) \
        .fit(wide.select("features", "label").coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, 1)))
    weights = linear.coefficients.toArray()
    return float(linear.intercept), [(float(w), r) for w, r in zip(weights, rules) if w]


def score(model: tuple[float, list[tuple[float, Rule]]]) -> Column:
    """The kept rules as one column: the logistic of their weighted sum."""
    intercept, rules = model
    total = F.lit(intercept)
    for weight, rule in rules:
        total = total + F.lit(weight) * holds(rule)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))
