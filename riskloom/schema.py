"""Schemas, fixed reference values and the dimension frames built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------
# FIXED VALUES (must equal the reference for equal results; stated as given, in their order)
# ---------------------------------------------------------------------------------------------
# Merchant categories in generator order: (category, merchant category code, risk score).
MERCHANTS = [
    ("grocery", 5411, 0.10),
    ("gas_station", 5541, 0.15),
    ("restaurant", 5812, 0.12),
    ("online_retail", 5999, 0.30),
    ("electronics", 5732, 0.40),
    ("jewelry", 5944, 0.50),
    ("travel", 4722, 0.25),
    ("entertainment", 7832, 0.15),
    ("atm_withdrawal", 6011, 0.20),
    ("money_transfer", 4829, 0.60),
    ("crypto_exchange", 6051, 0.80),
    ("gambling", 7995, 0.55),
]
HIGH_RISK_MERCHANTS = ["money_transfer", "crypto_exchange", "gambling", "jewelry"]
CASH_EQUIVALENT_MERCHANTS = ["atm_withdrawal", "money_transfer", "crypto_exchange"]
ONLINE_MERCHANTS = ["online_retail", "crypto_exchange"]
UNKNOWN_MERCHANT_RISK = 0.3

# Countries with their risk score.
COUNTRIES = [
    ("US", 0.10), ("UK", 0.12), ("CA", 0.11), ("DE", 0.12), ("FR", 0.13),
    ("BR", 0.35), ("NG", 0.60), ("RU", 0.50), ("CN", 0.30), ("IN", 0.25),
]
HIGH_RISK_COUNTRIES = ["NG", "RU", "BR"]
UNKNOWN_COUNTRY_RISK = 0.3
# Country pairs 1000 km apart (either direction); other distinct pairs are 5000 km.
NEAR_COUNTRY_PAIRS = [("US", "CA"), ("UK", "DE"), ("UK", "FR"), ("DE", "FR")]
NEAR_DISTANCE_KM = 1000.0
FAR_DISTANCE_KM = 5000.0
TRAVEL_SPEED_KMH = 500.0          # minimum plausible speed; impossible if < half the time

# Profile defaults inside a present profile.
PROFILE_DEFAULTS = {
    "home_country": "US", "account_age_days": 0, "avg_txn_amount": 100.0,
    "std_txn_amount": 50.0, "avg_monthly_txns": 20, "primary_device_id": "",
}

# Risk-level ladder (lower edge inclusive) and decisions.
THRESHOLD_LOW = 0.3
THRESHOLD_MEDIUM = 0.6
THRESHOLD_HIGH = 0.85
FRAUD_SCORE_CUT = 0.5            # "fraud" in statistics: score > 0.5
HIGH_RISK_VIEW_CUT = 0.6         # high-risk view: score > 0.6
SLA_LATENCY_MS = 150.0
SCORE_TTL_SECONDS = 300
PROFILE_TTL_SECONDS = 3600
RECENT_HISTORY_TTL_SECONDS = 3600
RECENT_HISTORY_SIZE = 100
RATE_LIMIT_REQUESTS = 1000
RATE_LIMIT_WINDOW_SECONDS = 60
MODEL_VERSION = "v1.0.0"
RULE_MODEL_VERSION = "rule-v1"

# Risk-factor names, in output order.
RISK_FACTORS = ["HIGH_AMOUNT", "HIGH_RISK_MERCHANT", "HIGH_RISK_COUNTRY",
                "FOREIGN_TRANSACTION", "NEW_DEVICE", "OFF_HOURS"]

# The 34 model features in their fixed order.
FEATURE_NAMES = [
    "amount", "amount_log", "hour_of_day", "day_of_week", "is_weekend", "is_night",
    "is_high_risk_hour",
    "merchant_risk_score", "is_high_risk_merchant", "is_cash_equivalent", "is_online",
    "txn_count_1h", "txn_count_6h", "txn_count_24h", "amount_sum_1h", "amount_sum_24h",
    "unique_merchants_24h", "unique_countries_24h", "time_since_last_txn_hours",
    "velocity_score",
    "amount_zscore", "amount_vs_avg_ratio", "is_above_95th_percentile",
    "merchant_diversity_score", "spending_velocity_vs_normal",
    "is_foreign", "is_high_risk_country", "country_risk_score", "distance_from_home",
    "is_impossible_travel",
    "is_new_device", "device_age_days", "device_risk_score", "devices_used_24h",
]
FRAUD_TYPES = ["card_testing", "account_takeover", "bust_out", "synthetic_identity",
               "friendly_fraud"]
# ---------------------------------------------------------------------------------------------

HOUR_US = 3_600_000_000

TRANSACTION = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("timestamp", T.TimestampType(), True),
    T.StructField("amount", T.DoubleType(), True),
    T.StructField("currency", T.StringType(), True),
    T.StructField("merchant_category", T.StringType(), True),
    T.StructField("merchant_category_code", T.IntegerType(), True),
    T.StructField("country", T.StringType(), True),
    T.StructField("is_foreign", T.BooleanType(), True),
    T.StructField("device_id", T.StringType(), True),
    T.StructField("device_age_days", T.IntegerType(), True),
    T.StructField("is_new_device", T.BooleanType(), True),
    T.StructField("hour_of_day", T.IntegerType(), True),
    T.StructField("day_of_week", T.IntegerType(), True),
    T.StructField("is_weekend", T.BooleanType(), True),
    T.StructField("user_account_age_days", T.IntegerType(), True),
    T.StructField("is_fraud", T.IntegerType(), True),
    T.StructField("fraud_type", T.StringType(), True),
])

REQUEST = T.StructType([
    T.StructField("transaction_id", T.StringType(), True),
    T.StructField("user_id", T.StringType(), True),
    T.StructField("amount", T.DoubleType(), True),
    T.StructField("currency", T.StringType(), True),
    T.StructField("merchant_category", T.StringType(), True),
    T.StructField("country", T.StringType(), True),
    T.StructField("device_id", T.StringType(), True),
    T.StructField("timestamp", T.TimestampType(), True),
    T.StructField("ip_address", T.StringType(), True),
    T.StructField("user_agent", T.StringType(), True),
    T.StructField("session_id", T.StringType(), True),
])

PROFILE = T.StructType([
    T.StructField("user_id", T.StringType(), False),
    T.StructField("home_country", T.StringType(), True),
    T.StructField("account_age_days", T.IntegerType(), True),
    T.StructField("avg_txn_amount", T.DoubleType(), True),
    T.StructField("std_txn_amount", T.DoubleType(), True),
    T.StructField("avg_monthly_txns", T.IntegerType(), True),
    T.StructField("primary_device_id", T.StringType(), True),
    T.StructField("merchant_diversity", T.DoubleType(), True),
    T.StructField("risk_score", T.DoubleType(), True),
    T.StructField("updated_at", T.TimestampType(), True),
])

SCORE = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("fraud_score", T.DoubleType(), True),
    T.StructField("risk_level", T.StringType(), True),
    T.StructField("decision", T.StringType(), True),
    T.StructField("confidence", T.DoubleType(), True),
    T.StructField("risk_factors", T.ArrayType(T.StringType()), True),
    T.StructField("model_version", T.StringType(), True),
    T.StructField("latency_ms", T.DoubleType(), True),
    T.StructField("scored_at", T.TimestampType(), True),
])

MODEL = T.StructType([
    T.StructField("model_version", T.StringType(), False),
    T.StructField("model_type", T.StringType(), True),
    T.StructField("training_date", T.TimestampType(), True),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType()), True),
    T.StructField("feature_names", T.ArrayType(T.StringType()), True),
    T.StructField("is_active", T.BooleanType(), True),
])


def merchant_dim(spark: SparkSession) -> DataFrame:
    """12-row merchant dimension (fixed size: always safe to broadcast)."""
    return spark.createDataFrame(
        [(i, n, c, float(r)) for i, (n, c, r) in enumerate(MERCHANTS)],
        "merchant_idx int, merchant_category string, merchant_category_code int, "
        "merchant_risk_score double")


def country_dim(spark: SparkSession) -> DataFrame:
    """10-row country dimension (fixed size: always safe to broadcast)."""
    return spark.createDataFrame(
        [(i, c, float(r)) for i, (c, r) in enumerate(COUNTRIES)],
        "country_idx int, country string, country_risk_score double")
