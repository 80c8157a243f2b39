"""Sketches against exact ranks, beyond the size up to which they are exact."""
import datetime as dt

from pyspark.sql import functions as F

from conftest import T0
from riskloom.operators import sketches as SK


def _rows(spark, n):
    at = F.lit(T0).cast("timestamp") + F.expr("make_dt_interval(0, 0, 0, id % 7200)")
    return spark.range(n).select(at.alias("at"), (F.xxhash64("id") % 100_000 / 7.0).alias("latency_ms"))


def test_merged_minutes_keep_the_bound(spark):
    rows = _rows(spark, 216_000)
    minutes = SK.by_bucket(rows, F.date_trunc("minute", "at"))
    found = SK.quantiles(SK.rolled_up(minutes, "hour"), [0.0, 0.01, 0.5, 0.95, 0.99, 1.0])
    errors = SK.rank_errors(found, rows, F.date_trunc("hour", "at")).collect()
    assert {r.n for r in errors} == {108_000} and len(errors) == 12
    assert max(r.rank_error for r in errors) <= 4 * SK.rank_bound()
    assert max(len(bytes(r.sketch)) for r in SK.rolled_up(minutes, "hour").collect()) < 50_000


def test_small_buckets_are_exact_and_missing_values_left_out(spark):
    rows = [(T0 + dt.timedelta(seconds=i), float(i)) for i in range(100)] + [(T0, None), (None, 5.0), (T0 + dt.timedelta(days=1), None)]
    df = spark.createDataFrame(rows, "at timestamp, latency_ms double")
    minutes = SK.by_bucket(df, F.date_trunc("minute", "at"))
    got = {(r.n, r.p): r.value for r in SK.quantiles(SK.rolled_up(minutes, "day"), [0.5, 0.99]).collect()}
    assert got == {(100, 0.5): 49.0, (100, 0.99): 98.0}
    assert SK.quantiles(SK.rolled_up(SK.by_bucket(df.limit(0), F.date_trunc("minute", "at")), "day"), [0.5]).count() == 0
