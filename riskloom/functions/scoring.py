"""Score, risk level, decision, risk factors and the score record.

The reference ships no trained model or weights. ``rule_score`` is a labelled stand-in built
from the reference's own features (SURVEY §7); the learned path is
:mod:`riskloom.operators.learning`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import schema as S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rule_score(f: dict | None = None) -> Column:
    """Deterministic stand-in score in [0, 1], 4 decimals. ``f`` maps feature names to
    Columns (defaults to the feature columns of the same name)."""
    g = lambda n: _c((f or {}).get(n, n))
    velocity_counts = F.least(F.lit(10.0), g("txn_count_1h") * 3.0
                              + g("txn_count_6h") * 0.5 + g("txn_count_24h") * 0.1)
    raw = (F.lit(0.02) + g("merchant_risk_score") * 0.35 + g("country_risk_score") * 0.30
           + g("device_risk_score") * 0.30 + velocity_counts * 0.02 + g("is_foreign") * 0.15
           + g("is_above_95th_percentile") * 0.25 + g("is_high_risk_hour") * 0.15)
    return F.round(F.least(F.lit(1.0), raw), 4)


# P12
def risk_level(score) -> Column:
    s = _c(score)
    return (F.when(s < S.THRESHOLD_LOW, F.lit("LOW"))
            .when(s < S.THRESHOLD_MEDIUM, F.lit("MEDIUM"))
            .when(s < S.THRESHOLD_HIGH, F.lit("HIGH"))
            .when(s.isNotNull(), F.lit("CRITICAL")))


# P13
def decision(level) -> Column:
    lv = _c(level)
    return (F.when(lv.isin("LOW", "MEDIUM"), F.lit("APPROVE"))
            .when(lv == "HIGH", F.lit("REVIEW"))
            .when(lv == "CRITICAL", F.lit("DECLINE")))


# P15
def risk_factors(high_amount: Column, high_risk_merchant: Column, high_risk_country: Column,
                 foreign: Column, new_device: Column, off_hours: Column) -> Column:
    """Ordered factor names whose condition holds (null conditions do not fire)."""
    conds = [high_amount, high_risk_merchant, high_risk_country, foreign, new_device, off_hours]
    arr = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n))
                    for n, c in zip(S.RISK_FACTORS, conds)])
    return F.filter(arr, lambda x: x.isNotNull())


def risk_factors_from_features() -> Column:
    """P15 on the feature columns; HIGH_AMOUNT needs a profile (it is the above-95th flag,
    which is 0 without one)."""
    return risk_factors(F.col("is_above_95th_percentile") > 0,
                        F.col("is_high_risk_merchant") > 0,
                        F.col("is_high_risk_country") > 0,
                        F.col("is_foreign") > 0,
                        F.col("is_new_device") > 0,
                        F.col("is_high_risk_hour") > 0)


# P14 + P16
def score_record(score: Column, confidence: Column, factors: Column, version: Column,
                 scored_at: Column, latency_ms: Column | None = None) -> list:
    """Response columns. Level and decision use the unrounded score, the reported score is
    rounded to 3 digits. A null score (row could not be scored) becomes the error fallback:
    0.5, UNKNOWN, REVIEW, confidence 0, [SCORING_ERROR]."""
    ok = score.isNotNull()
    level = risk_level(score)
    cols = [
        F.when(ok, F.round(score, 3)).otherwise(F.lit(0.5)).alias("fraud_score"),
        F.when(ok, level).otherwise(F.lit("UNKNOWN")).alias("risk_level"),
        F.when(ok, decision(level)).otherwise(F.lit("REVIEW")).alias("decision"),
        F.when(ok, confidence).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(ok, factors).otherwise(F.array(F.lit("SCORING_ERROR"))).alias("risk_factors"),
        version.alias("model_version"),
        scored_at.alias("scored_at"),
    ]
    if latency_ms is not None:
        cols.append(F.when(ok, latency_ms).otherwise(F.lit(0.0)).alias("latency_ms"))
    return cols


# P18
def score_band(score) -> Column:
    s = _c(score)
    return (F.when(s < S.THRESHOLD_LOW, F.lit("low"))
            .when(s < S.THRESHOLD_MEDIUM, F.lit("medium"))
            .when(s.isNotNull(), F.lit("high")))


def category_label(cat) -> Column:
    """Dashboard label: the first ``_`` becomes a blank, words capitalized."""
    return F.initcap(F.regexp_replace(_c(cat), r"^([^_]*)_", "$1 "))
