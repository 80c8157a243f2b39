"""Composed jobs: the 34-feature table (P20), the rule-scored table and the score log.

Plan shape: one sweep for the range windows (range-sorted events, no partition by user), row chunks for the rows frames,
then the profile join (sort-merge by user, split by AQE where a user is hot, or broadcast when AQE sees a small side), the
dimension joins (broadcast, fixed size) and projections only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import schema as S
from riskloom.functions import features as FX
from riskloom.functions import scoring as SC
from riskloom.operators import windows as W
from riskloom.operators.joins import enrich_dims, enrich_profile
from riskloom.operators.timeline import DEFAULT_CHUNK, hours_between_us, with_ts_us

KEEP = ["txn_seq", "transaction_id", "user_id", "timestamp", "merchant_category", "country",
        "device_id", "is_fraud", "fraud_type", "latency_ms", "currency",
        "merchant_category_code"]


def _given(df: DataFrame, name: str) -> Column | None:
    return F.col(name) if name in df.columns else None


def feature_columns(df: DataFrame) -> dict[str, Column]:
    """The 34 features (doubles) on a frame that went through the windows and J1/J2."""
    hour = FX.hour_of_day("timestamp", _given(df, "hour_of_day"))
    dow = FX.day_of_week("timestamp", _given(df, "day_of_week"))
    amt = FX.amount("amount")
    country = FX.country_or_default("country")
    home = F.when(F.col("has_profile"), F.col("home_country")).otherwise(F.lit("US"))
    new_dev = FX.is_new_device("is_new_device")
    age = FX.device_age_days("device_age_days")
    beh = FX.behavior(amt, F.col("has_profile"), F.col("avg_txn_amount"),
                      F.col("std_txn_amount"))
    gap = F.coalesce(hours_between_us(F.col("_ts_us"), F.col("_prev_ts_us")), F.lit(24.0))
    d = lambda c: F.col(c).cast("double")
    return {
        "amount": amt,
        "amount_log": FX.amount_log("amount"),
        "hour_of_day": hour.cast("double"),
        "day_of_week": dow.cast("double"),
        "is_weekend": FX.flag(FX.is_weekend("timestamp", _given(df, "is_weekend"))),
        "is_night": FX.flag(FX.is_night(hour)),
        "is_high_risk_hour": FX.flag(FX.is_high_risk_hour(hour)),
        "merchant_risk_score": FX.merchant_risk(F.col("_dim_merchant_risk")),
        "is_high_risk_merchant": FX.flag(FX.is_high_risk_merchant("merchant_category")),
        "is_cash_equivalent": FX.flag(FX.is_cash_equivalent("merchant_category")),
        "is_online": FX.flag(FX.is_online("merchant_category")),
        "txn_count_1h": d("txn_count_1h"),
        "txn_count_6h": d("txn_count_6h"),
        "txn_count_24h": d("txn_count_24h"),
        "amount_sum_1h": d("amount_sum_1h"),
        "amount_sum_24h": d("amount_sum_24h"),
        "unique_merchants_24h": d("unique_merchants_24h"),
        "unique_countries_24h": d("unique_countries_24h"),
        "time_since_last_txn_hours": gap,
        "velocity_score": FX.velocity_score(d("txn_count_1h"), d("txn_count_6h"),
                                            d("txn_count_24h"), d("amount_sum_1h")),
        "amount_zscore": beh["amount_zscore"],
        "amount_vs_avg_ratio": beh["amount_vs_avg_ratio"],
        "is_above_95th_percentile": beh["is_above_95th_percentile"],
        "merchant_diversity_score": W.merchant_diversity_expr(),
        "spending_velocity_vs_normal": W.spending_velocity_expr(
            F.col("has_profile"), F.col("avg_txn_amount"), F.col("avg_monthly_txns")),
        "is_foreign": FX.flag(FX.is_foreign(country, home, _given(df, "is_foreign"))),
        "is_high_risk_country": FX.flag(FX.is_high_risk_country(country)),
        "country_risk_score": FX.country_risk(F.col("_dim_country_risk")),
        "distance_from_home": FX.distance_km(home, country),
        "is_impossible_travel": W.impossible_travel_expr(),
        "is_new_device": FX.flag(new_dev),
        "device_age_days": age.cast("double"),
        "device_risk_score": FX.device_risk(new_dev, age),
        "devices_used_24h": d("devices_used_24h"),
    }


def build_features(txn: DataFrame, profiles: DataFrame, chunk: int = DEFAULT_CHUNK, only: str | None = None,
                   past: str | None = None) -> DataFrame:
    """Transactions → identifying columns + ``has_profile`` + the 34 features (P20 order).
    Range windows (W1-W4, W11) come from one sweep, rows frames (W5-W7) from row chunks. ``only``: a boolean column of
    ``txn``; rows where it is false are history for the others and end with the windows. ``past``: a boolean column; rows
    where it is true lie more than a day before all others of their user that matter, and are in no range window."""
    vel = W.user_windows(with_ts_us(txn), W.velocity_columns((1, 6, 24), (1, 24), (24,), (24,)),
                         W.history_columns(100, 10, True), chunk=chunk, past=past)
    if only:
        vel = vel.where(only).drop(only)
    vel = enrich_profile(vel, profiles)
    j = enrich_dims(vel)
    feats = feature_columns(j)
    keep = [c for c in KEEP if c in j.columns and c not in feats]
    return j.select(*keep, "has_profile", *[feats[n].alias(n) for n in S.FEATURE_NAMES])


def score_features(features: DataFrame, version: str = S.RULE_MODEL_VERSION,
                   confidence: float = 0.8) -> DataFrame:
    """Rule-scored transactions: features + score record (P12-P16) + ``risk_factors``.
    ``scored_at`` = transaction time + the call's latency (a column of the log)."""
    score = SC.rule_score()
    lat = F.col("latency_ms") if "latency_ms" in features.columns else F.lit(0.0)
    scored_at = F.timestamp_micros(F.unix_micros("timestamp")
                                   + (lat * 1000).cast("long"))
    rec = SC.score_record(score, F.lit(confidence), SC.risk_factors_from_features(),
                          F.lit(version), scored_at, lat)
    out_names = {"fraud_score", "risk_level", "decision", "confidence", "risk_factors",
                 "model_version", "scored_at", "latency_ms"}
    keep = [c for c in features.columns if c not in out_names]
    # the score log keeps the 4-decimal score; the 3-digit response value is P16's
    return features.select(*keep, score.alias("_raw_score"), *rec) \
        .withColumn("fraud_score", F.col("_raw_score")).drop("_raw_score")


def score_log(scored: DataFrame) -> DataFrame:
    """The ``fraud_scores`` table view of a scored frame (4-decimal score)."""
    return scored.select([f.name for f in S.SCORE.fields])
