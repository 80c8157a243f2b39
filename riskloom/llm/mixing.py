"""Mixing sources to target weights.

Every row gets a hash-random key. Rows are range-sorted by key within their source, distributed
prefix sums give the words before each row, and each source is cut at its exact budget: whole
epochs first, then the rows before the cut, the row at the cut in part.

Null texts have size 0; a null source is a source of its own, last in order; a null id has the
key of the empty text. Rows of equal key are ordered by id and size, so repeated rows are
interchangeable. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.prefix import running_totals

WORD = r"[^\x20\x09-\x0D]+"
#: Fixed shares: weights that repeat over the sources by code point, the mix's size against all
#: words, most epochs of one source.
WEIGHTS, SHARE_HALVES, MOST = (5, 2, 1), 3, 2


def n_words(text) -> F.col:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(id_column):
    """Hash-random key of an id; a null id has that of the empty text."""
    return F.md5(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the words of all sources times
    SHARE_HALVES / 2, shared by weight, no source above MOST times its size.

    A source reaches its limit before another if its size for its weight is smaller, so the
    sources in that order are at their limit up to one of them; sums over the sources before and
    after each tell which. One row a source is all that is sorted here."""
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in WEIGHTS]),
                          ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
                           % len(WEIGHTS) + 1).cast("int"))
    full = 1
    for w in WEIGHTS:
        full *= w
    by = Window.orderBy(F.expr(f"source_size * ({full} div weight)"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum(F.col("source_size") * MOST).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (sizes.withColumn("weight", weight)
            .withColumn("total", F.sum("source_size").over(everything))
            .withColumn("before", before).withColumn("rest", rest)
            .withColumn("limited", F.col("source_size") * (2 * MOST) * F.col("rest")
                        <= F.col("weight") * (F.col("total") * SHARE_HALVES - F.col("before") * 2))
            .withColumn("held", F.coalesce(F.sum(F.expr(f"if(limited, source_size * {MOST}, 0)")).over(everything), F.lit(0)))
            .withColumn("free", F.sum(F.expr("if(limited, 0, weight)")).over(everything))
            .select("source", "source_size", F.expr(
                f"if(limited, source_size * {float(MOST)}D, "
                f"(weight * (total * {SHARE_HALVES / 2}D - held)) / free)").alias("target")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, key, epochs, cut, taken) of every row: whole epochs of
    its source, words taken of it in the last one, and of both together."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       n_words(F.col(text_col)).alias("size"), random_key(F.col(id_col)).alias("key"))
    summed = running_totals(slim, ["source"], ["key", "id", "size"], {"start": "size"})
    goal = targets(summed.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumnRenamed("source", "of")
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.coalesce(F.floor(budget / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    left = budget - epochs * F.col("source_size")
    cut = F.least(F.greatest(left - F.col("start"), F.lit(0)), F.col("size"))
    return (summed.join(goal, F.col("source").eqNullSafe(F.col("of")))
            .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "key",
                    epochs.cast("long").alias("epochs"), cut.cast("long").alias("cut"),
                    (epochs * F.col("size") + cut).cast("long").alias("taken")))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with every row as often as the mix takes it: once for each whole epoch of its
    source, and once more before the cut. The row at the cut goes in whole if half of it or more
    is within the budget. Where the cut is in a source depends on one key, so rows are
    chosen without a join on them."""
    plan = mix(docs, id_col, text_col, source_col)
    place = F.struct(F.col("key"), F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"), F.col("size"))
    cuts = plan.groupBy(F.col(source_col).alias("__of")).agg(
        F.max("epochs").alias("__epochs"), F.max(F.when((F.col("cut") > 0) & (2 * F.col("cut") >= F.col("size")), place)).alias("__last"))
    own = F.struct(random_key(F.col(id_col)).alias("key"), F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"),
                   n_words(F.col(text_col)).alias("size"))
    times = F.when(own["size"] > 0, F.col("__epochs") + F.coalesce((own <= F.col("__last")).cast("long"), F.lit(0))).otherwise(0)
    return (docs.join(F.broadcast(cuts) if _few(cuts) else cuts, F.col(source_col).eqNullSafe(F.col("__of")))
            .withColumn("__times", times).where("__times > 0")
            .withColumn("__turn", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*docs.columns))


def _few(cuts: DataFrame, most: int = 10_000) -> bool:
    """Whether there are few sources, so that a row of each may be broadcast."""
    return cuts.limit(most + 1).count() <= most


ORACLE = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           md5(coalesce(doc_id::VARCHAR, '')) AS key
    FROM documents),
started AS (
    SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS LAST, size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
           (sum(size) OVER (PARTITION BY source))::BIGINT AS source_size
    FROM sized),
ranked AS (
    SELECT source, source_size,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
    FROM (SELECT DISTINCT source, source_size FROM started)),
crossed AS (
    -- where all sources with a smaller size for their weight are at their limit, is this one too?
    SELECT a.source, a.source_size, a.weight,
           (SELECT sum(source_size) FROM ranked)::DOUBLE * 1.5 AS total,
           coalesce((SELECT sum(2 * b.source_size) FROM ranked b
             WHERE b.source_size * (10 // b.weight) < a.source_size * (10 // a.weight)), 0) AS before,
           (SELECT sum(b.weight) FROM ranked b
             WHERE b.source_size * (10 // b.weight) >= a.source_size * (10 // a.weight)) AS rest
    FROM ranked a),
held AS (
    SELECT *, 2 * source_size * rest <= weight * (total - before) AS limited FROM crossed),
goals AS (
    SELECT source, source_size,
           CASE WHEN limited THEN 2.0::DOUBLE * source_size
                ELSE (weight * (total - coalesce((SELECT sum(2 * source_size) FROM held WHERE limited), 0)::DOUBLE))
                     / (SELECT sum(weight) FROM held WHERE NOT limited)::DOUBLE END AS target
    FROM held),
cut AS (
    SELECT s.*, g.target, floor(g.target + 0.5)::BIGINT AS budget
    FROM started s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0::BIGINT
            ELSE (budget // source_size) * size
                 + least(greatest(budget % source_size - start, 0), size) END::BIGINT AS taken
FROM cut
"""
