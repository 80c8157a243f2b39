"""Small document tables with the odd cases that every operator must take."""
import random

DOC_DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n, words=None):
    words = words or [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "vu", "sa") for b in ("ran", "tel", "mon", "dis", "k", "pe")]
    out = []
    for i in range(n):
        w = rng.choice(words)
        out.append(w.capitalize() if i % 9 == 0 else w + "." if i % 9 == 8 else w)
    return " ".join(out)


def odd_rows():
    """Nulls in every column, empty and white texts, repeated rows, ties, a very long text."""
    rng = random.Random(3)
    p = prose(rng, 60)
    return [(1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \n\t ", "en", None, 4), (None, p, "en", "b", 1),
            (None, None, None, None, None), (4, p, "en", "b", 1), (4, p, "en", "b", 1), (4, "other text under one id", "de", "c", 9),
            (5, "x" * 300_000, "en", "a", 300_000), (6, prose(rng, 40_000), "en", "c", 1), (7, "!!! 123 ---", "en", "a", 11),
            (8, "Zwölf Boxkämpfer jagen Viktor quer \U0001f600 über", "de", "é", 40), (9, "one", "en", "a", 3)]


def odd_docs(spark):
    """The odd rows, with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(odd_rows(), DOC_DDL)
    for name in ("id", "key", "size", "n", "h", "digest", "ids", "token", "g", "root", "spans", "start", "kept"):
        df = df.withColumn(name, F.lit(name))
    return df


def no_docs(spark):
    return spark.createDataFrame([], DOC_DDL)


def clones(seed=1, n=60):
    """Near copies, exact copies and unrelated texts: (id, text)."""
    rng = random.Random(seed)
    base = [prose(rng, 120).split() for _ in range(4)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 5, 20))):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows + [(1000 + i, prose(rng, rng.randrange(1, 40))) for i in range(20)]
