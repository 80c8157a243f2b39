"""Distributed running totals, and tables that cut lineage."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.session import checkpoint_dir


#: Removes an execution's shuffle files when it ends. Else they stay until the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Writes of ``spark``'s frames in here leave no shuffle files behind. What is written needs them no more; a frame
    that is written twice is computed twice anyway."""
    was = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, was)


def stored(df: DataFrame, what: str = "t") -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read back: its lineage ends
    there, so a lost executor costs no recomputation of what led to it, and its shuffle files go."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def window_sum(value: str, by: list[str], order: list[str]):
    """Sum of ``value`` over the rows before, within ``by``."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1))


def running_totals(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """``df`` with, for each ``out: value`` of ``values``, the sum of ``value`` over the rows before
    this one within ``keys``, by ``order`` (nulls last).

    Rows are range-sorted, so a hot key spreads over many partitions; each partition sums its own
    rows and adds the total of the partitions before it (one row a key and partition). ``df`` should
    be slim; it is written once so that the ranges stay as they are."""
    cut = stored(df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in [*keys, *order]])
                 .withColumn("_part", F.spark_partition_id()), "ranges")
    # keys as one comparable value, so that null keys join too
    cut = cut.withColumn("_key", F.struct(*[F.col(c).isNull().alias(f"n{i}") for i, c in enumerate(keys)],
                                          *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"k{i}")
                                            for i, c in enumerate(keys)]) if keys else F.lit(0))
    totals = cut.groupBy("_key", "_part").agg(*[F.sum(v).alias(f"_sum_{out}") for out, v in values.items()])
    totals = totals.select("_key", "_part", *[
        F.coalesce(window_sum(f"_sum_{out}", ["_key"] if keys else [], ["_part"]), F.lit(0)).alias(f"_before_{out}")
        for out in values])
    summed = cut.select("*", *[F.coalesce(window_sum(v, ["_key", "_part"], order), F.lit(0)).alias(f"_inner_{out}")
                               for out, v in values.items()])
    joined = summed.join(totals, ["_key", "_part"])
    return joined.select(*df.columns, *[(F.col(f"_before_{out}") + F.col(f"_inner_{out}")).alias(out) for out in values])
