"""Invariants on the driver's tables."""
import datetime as dt

from pyspark.sql import functions as F

from conftest import SF_SMALL, profile_rows
from riskloom.operators import joins as J
from riskloom.operators import windows as W
from riskloom.plans.features import build_features
from riskloom.sources import testdata as TD


def _log(spark):
    return TD.mapped_log(spark, SF_SMALL)


def test_point_in_time_later_rows_change_nothing(spark):
    log = _log(spark)
    cut = log.agg(F.percentile_approx(F.unix_micros("timestamp"), 0.5)).first()[0]
    early = log.where(F.unix_micros("timestamp") <= cut)
    prof = profile_rows(spark, [])
    a = build_features(early, prof)
    b = build_features(log, prof).join(early.select("transaction_id"), "transaction_id",
                                        "left_semi").select(*a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_later_rows_change_no_score_with_profiles(spark):
    """Profiles as of a cut date score later rows; rows after any of them change nothing."""
    from riskloom.operators.aggregates import build_profiles
    log = _log(spark)
    us = log.agg(F.percentile_approx(F.unix_micros("timestamp"), F.array(F.lit(0.4), F.lit(0.7)))).first()[0]
    cut = F.timestamp_micros(F.lit(us[0]))
    early = log.where(F.unix_micros("timestamp") <= us[1])
    a = build_features(early, build_profiles(early, None, cut))
    b = build_features(log, build_profiles(log, None, cut)).join(early.select("transaction_id"), "transaction_id", "left_semi")
    assert a.where("has_profile").count() > 0 and a.where("not has_profile").count() > 0
    assert a.exceptAll(b.select(*a.columns)).count() == 0


def test_counts_monotone_and_w8_consistent(spark):
    v = W.velocity_features(_log(spark))
    assert v.where((F.col("txn_count_1h") > F.col("txn_count_6h"))
                   | (F.col("txn_count_6h") > F.col("txn_count_24h"))).count() == 0
    c = W.velocity_counts(_log(spark)).select("transaction_id", F.col("txn_count_24h").alias("c"))
    j = v.join(c, "transaction_id")
    assert j.where(F.col("c") != F.col("txn_count_24h")).count() == 0


def test_interval_join_counts_equal_window_counts(spark):
    log = _log(spark)
    pairs = J.history_interval_join(log, 24).groupBy("transaction_id").count()
    w = W.velocity_counts(log, (24,))
    j = w.join(pairs, "transaction_id", "left").fillna(0, ["count"])
    assert j.where(F.col("count") != F.col("txn_count_24h")).count() == 0


def test_hot_plan_equals_plain_plan(spark):
    log = _log(spark)
    from riskloom.plans import catalog
    prof = catalog.Ctx(spark, SF_SMALL).profiles
    a = build_features(log, prof)
    b = build_features(log.repartition(23, "transaction_id"), prof, chunk=100)
    assert a.count() == b.count() == log.count()
    assert a.exceptAll(b).count() == 0
    o = TD.mapped_orders(spark, SF_SMALL)
    assert W.velocity_batch(o).exceptAll(W.velocity_batch(o.repartition(23, "transaction_id"))).count() == 0
    x = W.anchored_counter(log, 3600)
    y = W.anchored_counter(log, 3600, hot_threshold=None)
    assert x.exceptAll(y).count() == 0 and x.count() == log.count()


def test_hot_split_routes_heavy_user(spark):
    from riskloom.operators.timeline import split_hot_keys
    log = _log(spark)
    top = log.groupBy("user_id").count().orderBy(F.desc("count")).first()
    normal, hot = split_hot_keys(log, "user_id", top["count"] - 1)
    assert hot.select("user_id").distinct().count() >= 1
    assert normal.count() + hot.count() == log.count()


def test_insert_if_absent_idempotent(spark):
    from riskloom.operators.aggregates import build_profiles
    log = _log(spark)
    allp = build_profiles(log, TD.mapped_users(spark, SF_SMALL))
    some = allp.where(F.col("user_id") < F.lit("U000008"))
    once = J.insert_if_absent(some, allp)
    twice = J.insert_if_absent(once, allp)
    assert once.count() == twice.count() == allp.count()
