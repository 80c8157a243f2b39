"""Percentiles from mergeable sketches (ST3, ST8, and A3/A8 kept up to date).

A KLL sketch of ``K`` holds a bounded number of values whatever it has seen. Sketches of minutes merge into hours, days or
any longer bucket without the rows. A quantile's rank is off by at most ``rank_bound()`` of the rows with 99%
confidence (0.28%), merged or not; up to about ``K`` rows a bucket it is exact. Rows without a time or a value are in
no sketch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 1000


def rank_bound(k: int = K) -> float:
    """Largest error of a rank, as a share of the rows, with 99% confidence (the sketch's published fit)."""
    return 2.296 / k ** 0.9723


def by_bucket(df: DataFrame, bucket, value: str = "latency_ms", k: int = K) -> DataFrame:
    """(bucket, n, sketch) of the rows with a ``value``; ``bucket`` is a column. Works on streams too."""
    return (df.where(F.col(value).isNotNull()).groupBy(bucket.alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch")))


def rolled_up(sketches: DataFrame, unit: str, k: int = K) -> DataFrame:
    """Sketches of smaller buckets merged to those of ``unit`` (``hour``, ``day``, ...)."""
    return (sketches.where(F.col("bucket").isNotNull()).groupBy(F.date_trunc(unit, "bucket").alias("bucket"))
            .agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch")))


def quantiles(sketches: DataFrame, probs: list[float]) -> DataFrame:
    """(bucket, n, p, value), a row for each of ``probs``."""
    p = F.array(*[F.lit(float(x)) for x in probs])
    values = F.kll_sketch_get_quantile_double("sketch", p)
    return sketches.select("bucket", "n", F.explode(F.arrays_zip(p.alias("p"), values.alias("value"))).alias("q")) \
        .select("bucket", "n", F.col("q.p").alias("p"), F.col("q.value").alias("value"))


def rank_errors(found: DataFrame, df: DataFrame, bucket, value: str = "latency_ms") -> DataFrame:
    """``found`` (rows of :func:`quantiles`) with ``rank_error``: how far ``p`` lies outside the exact ranks that
    the value holds among the rows of its bucket, as a share of them."""
    rows = df.where(F.col(value).isNotNull()).select(bucket.alias("_bucket"), F.col(value).alias("_v"))
    # a row a distinct value
    counts = rows.groupBy("_bucket", "_v").agg(F.count(F.lit(1)).alias("_n"))
    per = found.join(counts, F.col("bucket") == F.col("_bucket")).groupBy("bucket", "n", "p", "value").agg(
        F.sum("_n").alias("_all"), F.sum(F.when(F.col("_v") < F.col("value"), F.col("_n")).otherwise(0)).alias("_below"),
        F.sum(F.when(F.col("_v") <= F.col("value"), F.col("_n")).otherwise(0)).alias("_upto"))
    off = F.greatest(F.lit(0.0), F.col("_below") / F.col("_all") - F.col("p"), F.col("p") - F.col("_upto") / F.col("_all"))
    return per.select("bucket", "n", "p", "value", off.alias("rank_error"))
