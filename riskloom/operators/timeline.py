"""Skew-safe per-user timelines.

A plain ``Window.partitionBy(user)`` sends all rows of a user to one task. One user may hold a
third of the log. Range frames are swept (:mod:`riskloom.operators.sweep`), rows frames run in row chunks; the
anchored counters split off users above ``HOT_USER_ROWS`` rows (found by one count per user). Null users
and null times are included: keys join null-safely, chunk sizes follow from the requested frames.

* **time-bucket context** (range frames up to ``width``): every row goes to its own bucket
  ``floor(ts/width)`` and, flagged as context, to the next one. A frame ``[t-W, t]`` with
  ``W <= width`` lies inside the current and previous bucket, so a window partitioned by
  ``(user, bucket)`` is exact for the non-context rows, and a partition holds at most two
  buckets of one user.
* **row index** (rows frames): the per-user position ``_row`` in (timestamp, id) order is the
  sum of the counts of the earlier fine buckets (a small window over an aggregate with one row
  per user and active bucket) plus the position inside the bucket.
* **row-chunk context** (last N rows): rows go to chunk ``floor(_row/C)`` and, as context, to
  the next chunk; with ``N <= C`` a rows frame of N is exact and a partition has 2C rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.schema import HOUR_US

DAY_US = 24 * HOUR_US
DEFAULT_CHUNK = 4096
# A user with more rows than this takes the skew-safe plan; everybody else is windowed in
# one exchange by user. The hot-user list therefore has at most rows / HOT_USER_ROWS keys,
# which is the size bound that makes broadcasting it safe.
HOT_USER_ROWS = 250_000


def has_hot_keys(df: DataFrame, key: str, threshold: int) -> bool:
    """Whether any key has more than ``threshold`` rows: one small job over the key column. Without
    one the hot branch would be empty and is left out of the plan; the result is the same."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > threshold).limit(1).count() > 0


def split_hot_keys(df: DataFrame, key: str = "user_id",
                   threshold: int = HOT_USER_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows of normal keys, rows of hot keys). One partial aggregate counts rows per key;
    keys above ``threshold`` (at most total/threshold of them) are broadcast to both sides."""
    hot = (df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
           .where(F.col("_n") > threshold).select(key))
    hb = F.broadcast(hot.withColumnRenamed(key, "_hot"))
    same = F.col(key).eqNullSafe(F.col("_hot"))
    return df.join(hb, same, "left_anti"), df.join(hb, same, "left_semi")


def join_null_safe(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` where null equals null; the other side's keys are dropped."""
    o = other.withColumnsRenamed({k: f"_o_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    return df.join(o, on).drop(*[f"_o_{k}" for k in keys])


def with_ts_us(df: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    return df.withColumn("_ts_us", F.unix_micros(F.col(ts_col).cast("timestamp")))


def bucket_context(df: DataFrame, width_us: int) -> DataFrame:
    """Duplicate rows into (own bucket, ctx=false) and (next bucket, ctx=true)."""
    b = F.floor(F.col("_ts_us") / F.lit(width_us)).cast("long")
    own = F.struct(F.col("_b0").alias("b"), F.lit(False).alias("ctx"))
    both = F.array(own, F.struct((F.col("_b0") + 1).alias("b"), F.lit(True).alias("ctx")))
    # rows without a time have one bucket and are nobody's context
    return (df.withColumn("_b0", b)
            .withColumn("_bc", F.explode(F.when(F.col("_b0").isNull(), F.array(own)).otherwise(both)))
            .select("*", F.col("_bc.b").alias("_bkt"), F.col("_bc.ctx").alias("_ctx"))
            .drop("_bc", "_b0"))


def with_user_row_index(df: DataFrame, user: str = "user_id", id_col: str = "transaction_id",
                        bucket_us: int = HOUR_US) -> DataFrame:
    """Add ``_row`` (0-based per-user index by (ts, id)) and ``_prev_ts_us`` (latest strictly
    earlier timestamp of the user, null for the first).

    Needs ``_ts_us``. Shuffles: one partial aggregate by (user, fine bucket), a window over
    that aggregate by user (one row per active bucket), one exchange of the rows by
    (user, fine bucket)."""
    d = df.withColumn("_hb", F.floor(F.col("_ts_us") / F.lit(bucket_us)).cast("long"))
    per_b = d.groupBy(user, "_hb").agg(F.count(F.lit(1)).alias("_n"),
                                        F.max("_ts_us").alias("_bmax"))
    wb = Window.partitionBy(user).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    per_b = per_b.select(user, "_hb",
                         F.coalesce(F.sum("_n").over(wb), F.lit(0)).alias("_off"),
                         F.max("_bmax").over(wb).alias("_prev_b_max"))
    j = join_null_safe(d, per_b, [user, "_hb"])
    w_rows = Window.partitionBy(user, "_hb").orderBy("_ts_us", id_col)
    w_range = (Window.partitionBy(user, "_hb").orderBy("_ts_us")
               .rangeBetween(Window.unboundedPreceding, -1))
    return (j.withColumn("_row", F.col("_off") + F.row_number().over(w_rows) - 1)
            .withColumn("_prev_ts_us",
                        F.coalesce(F.max("_ts_us").over(w_range), F.col("_prev_b_max")))
            .drop("_hb", "_off", "_prev_b_max"))


def running_max(df: DataFrame, col: str, out: str, user: str = "user_id",
                bucket_us: int = HOUR_US) -> DataFrame:
    """``out`` = max of ``col`` over the user's rows with timestamp <= the row's (inclusive),
    without a whole-user partition: in-bucket range window + max of earlier buckets."""
    d = df.withColumn("_hb2", F.floor(F.col("_ts_us") / F.lit(bucket_us)).cast("long"))
    per_b = d.groupBy(user, "_hb2").agg(F.max(col).alias("_bm"))
    wb = Window.partitionBy(user).orderBy("_hb2").rowsBetween(Window.unboundedPreceding, -1)
    per_b = per_b.select(user, "_hb2", F.max("_bm").over(wb).alias("_before"))
    w_in = (Window.partitionBy(user, "_hb2").orderBy("_ts_us")
            .rangeBetween(Window.unboundedPreceding, 0))
    j = join_null_safe(d, per_b, [user, "_hb2"])
    inb = F.max(col).over(w_in)
    return (j.withColumn(out, F.greatest(inb, F.col("_before")))
            .drop("_hb2", "_before"))


def chunk_context(df: DataFrame, chunk: int = DEFAULT_CHUNK, reach: int | None = None, total: str | None = None) -> DataFrame:
    """Rows in (own row chunk, ctx=false) and, the last ``reach`` of a chunk, in (next chunk, ctx=true). With ``total``
    (column of the number of the user's rows) not in a next chunk that has no rows."""
    c = F.floor(F.col("_row") / F.lit(chunk)).cast("long")
    own = F.struct(F.col("_c0").alias("c"), F.lit(False).alias("ctx"))
    both = F.array(own, F.struct((F.col("_c0") + 1).alias("c"), F.lit(True).alias("ctx")))
    late = F.col("_row") % chunk >= F.lit(chunk - min(reach or chunk, chunk))
    if total:
        late = late & ((F.col("_c0") + 1) * chunk < F.col(total))
    return (df.withColumn("_c0", c)
            .withColumn("_cc", F.explode(F.when(late, both).otherwise(F.array(own))))
            .select("*", F.col("_cc.c").alias("_chunk"), F.col("_cc.ctx").alias("_ctx"))
            .drop("_cc", "_c0"))


def hours_between_us(later: Column, earlier: Column) -> Column:
    return (later - earlier) / F.lit(float(HOUR_US))
