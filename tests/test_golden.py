"""Golden cases from the reference's own assertions (FIXTURES.md §4)."""
import datetime as dt
import math

from pyspark.sql import functions as F

from conftest import T0, profile_rows, txn_rows
from riskloom.functions import scoring as SC
from riskloom.plans.features import build_features, score_features


def test_risk_level_and_decision_ladders(spark):
    cases = [(0.1, "LOW"), (0.29, "LOW"), (0.3, "MEDIUM"), (0.31, "MEDIUM"), (0.59, "MEDIUM"),
             (0.6, "HIGH"), (0.61, "HIGH"), (0.84, "HIGH"), (0.85, "CRITICAL"), (0.86, "CRITICAL"),
             (0.99, "CRITICAL")]
    df = spark.createDataFrame(cases, "s double, expected string")
    got = df.select("expected", SC.risk_level("s").alias("lv")).collect()
    assert all(r.expected == r.lv for r in got)
    dec = spark.createDataFrame([(0.1, "APPROVE"), (0.4, "APPROVE"), (0.7, "REVIEW"),
                                 (0.9, "DECLINE")], "s double, expected string")
    got = dec.select("expected", SC.decision(SC.risk_level("s")).alias("d")).collect()
    assert all(r.expected == r.d for r in got)


def _features(spark, txns, profiles=None):
    prof = profile_rows(spark, profiles or [])
    return {r.transaction_id: r for r in build_features(txn_rows(spark, txns), prof).collect()}


US_PROFILE = dict(user_id="U1", home_country="US", account_age_days=365, avg_txn_amount=100.0,
                  std_txn_amount=50.0, avg_monthly_txns=20, primary_device_id="d1")


def test_amount_log_and_zscore(spark):
    f = _features(spark, [dict(transaction_id="T1", user_id="U1", timestamp=T0, amount=150.0)],
                  [US_PROFILE])["T1"]
    assert f.amount == 150.0
    assert math.isclose(f.amount_log, math.log1p(150.0))
    assert math.isclose(f.amount_zscore, 1.0)


def test_merchant_order_foreign_and_night(spark):
    f = _features(spark, [
        dict(transaction_id="A", user_id="U1", timestamp=T0, merchant_category="crypto_exchange"),
        dict(transaction_id="B", user_id="U2", timestamp=T0, merchant_category="grocery"),
        dict(transaction_id="C", user_id="U3", timestamp=T0, country="NG"),
        dict(transaction_id="D", user_id="U4", timestamp=dt.datetime(2024, 1, 15, 3, 0)),
    ], [US_PROFILE, {**US_PROFILE, "user_id": "U3"}])
    assert f["A"].merchant_risk_score > f["B"].merchant_risk_score
    assert f["C"].is_foreign == 1.0 and f["C"].is_high_risk_country == 1.0
    assert f["D"].is_night == 1.0 and f["D"].is_high_risk_hour == 1.0


def test_risk_factors_full_set(spark):
    feats = build_features(txn_rows(spark, [dict(
        transaction_id="T", user_id="U1", timestamp=dt.datetime(2024, 1, 15, 2, 0), amount=5000.0,
        merchant_category="money_transfer", country="RU", device_id="new", is_new_device=True,
        device_age_days=0)]), profile_rows(spark, [US_PROFILE]))
    r = score_features(feats).first()
    assert r.risk_factors == ["HIGH_AMOUNT", "HIGH_RISK_MERCHANT", "HIGH_RISK_COUNTRY",
                              "FOREIGN_TRANSACTION", "NEW_DEVICE", "OFF_HOURS"]
    assert 0.0 <= r.fraud_score <= 1.0
    assert r.risk_level in ("LOW", "MEDIUM", "HIGH", "CRITICAL")
    assert r.decision in ("APPROVE", "REVIEW", "DECLINE")


def test_some_factor_without_profile(spark):
    feats = build_features(txn_rows(spark, [dict(
        transaction_id="T", user_id="U9", timestamp=dt.datetime(2024, 1, 15, 3, 0), amount=5000.0,
        merchant_category="crypto_exchange", country="NG", is_new_device=True,
        device_age_days=0)]), profile_rows(spark, []))
    r = score_features(feats).first()
    assert len(r.risk_factors) > 0 and "HIGH_AMOUNT" not in r.risk_factors


def test_invalid_request_rejected(spark):
    from riskloom import schema as S
    from riskloom.operators.filters import validate_requests
    df = spark.createDataFrame([("TXN-1",) + (None,) * (len(S.REQUEST.fields) - 1)], S.REQUEST)
    ok, bad = validate_requests(df)
    assert ok.count() == 0
    assert set(bad.first().reasons) >= {"missing_user_id", "missing_amount",
                                        "missing_merchant_category"}


def test_seed_users_inserted_once(spark):
    from riskloom.operators.joins import insert_if_absent
    seeds = profile_rows(spark, [
        dict(user_id="U000001", home_country="US", account_age_days=365, avg_txn_amount=150.0,
             std_txn_amount=75.0, avg_monthly_txns=25, primary_device_id="device_001"),
        dict(user_id="U000005", home_country="DE", account_age_days=450, avg_txn_amount=300.0,
             std_txn_amount=150.0, avg_monthly_txns=20, primary_device_id="device_005")])
    empty = profile_rows(spark, [])
    once = insert_if_absent(empty, seeds)
    twice = insert_if_absent(once, seeds)
    assert sorted(r.user_id for r in twice.collect()) == ["U000001", "U000005"]
    assert twice.where(F.col("user_id") == "U000005").first().home_country == "DE"
