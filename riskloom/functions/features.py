"""Scalar feature expressions (built-in Spark functions only; all stay in whole-stage codegen).

Every function returns a :class:`Column`; inputs are column names or Columns. Missing values are
treated as missing keys and receive the reference's defaults.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import schema as S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _flag(cond: Column) -> Column:
    """Boolean condition as a 0.0/1.0 double (null → 0.0)."""
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


# P1
def amount(amount_col="amount") -> Column:
    return F.coalesce(_c(amount_col).cast("double"), F.lit(0.0))


def amount_log(amount_col="amount") -> Column:
    return F.log1p(amount(amount_col))


# P2 (Q22: a given value wins, else it is derived from the timestamp, else the default)
def hour_of_day(ts="timestamp", given: Column | None = None) -> Column:
    parts = ([given] if given is not None else []) + [F.hour(_c(ts)), F.lit(12)]
    return F.coalesce(*parts)


def day_of_week(ts="timestamp", given: Column | None = None) -> Column:
    """Monday = 0 (``weekday``, not ``dayofweek``)."""
    parts = ([given] if given is not None else []) + [F.weekday(_c(ts)), F.lit(0)]
    return F.coalesce(*parts)


def is_weekend(ts="timestamp", given: Column | None = None) -> Column:
    parts = ([given] if given is not None else []) + [F.weekday(_c(ts)) >= 5, F.lit(False)]
    return F.coalesce(*parts)


# P3
def is_night(hour: Column) -> Column:
    return (hour >= 23) | (hour <= 5)


def is_high_risk_hour(hour: Column) -> Column:
    return (hour >= 0) & (hour <= 6)


# P4 (risk comes from the broadcast merchant dimension, J2)
def merchant_risk(dim_risk: Column) -> Column:
    return F.coalesce(dim_risk, F.lit(S.UNKNOWN_MERCHANT_RISK))


def is_high_risk_merchant(cat="merchant_category") -> Column:
    return F.coalesce(_c(cat).isin(*S.HIGH_RISK_MERCHANTS), F.lit(False))


def is_cash_equivalent(cat="merchant_category") -> Column:
    return F.coalesce(_c(cat).isin(*S.CASH_EQUIVALENT_MERCHANTS), F.lit(False))


def is_online(cat="merchant_category") -> Column:
    return F.coalesce(_c(cat).isin(*S.ONLINE_MERCHANTS), F.lit(False))


# P5
def country_or_default(country="country") -> Column:
    return F.coalesce(_c(country), F.lit("US"))


def is_foreign(country: Column, home: Column, given: Column | None = None) -> Column:
    derived = country != home
    return F.coalesce(given, derived) if given is not None else derived


def is_high_risk_country(country: Column) -> Column:
    return F.coalesce(country.isin(*S.HIGH_RISK_COUNTRIES), F.lit(False))


def country_risk(dim_risk: Column) -> Column:
    return F.coalesce(dim_risk, F.lit(S.UNKNOWN_COUNTRY_RISK))


# P6
def distance_km(a: Column, b: Column) -> Column:
    """0 for the same country, 1000 for the near pairs (either way), else 5000."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    near = None
    for x, y in S.NEAR_COUNTRY_PAIRS:
        p, q = min(x, y), max(x, y)
        c = (lo == p) & (hi == q)
        near = c if near is None else (near | c)
    return (F.when(a == b, F.lit(0.0))
            .when(near, F.lit(S.NEAR_DISTANCE_KM))
            .otherwise(F.lit(S.FAR_DISTANCE_KM)))


# P7
def is_new_device(given="is_new_device") -> Column:
    return F.coalesce(_c(given), F.lit(False))


def device_age_days(given="device_age_days") -> Column:
    return F.coalesce(_c(given), F.lit(30))


def device_risk(is_new: Column, age_days: Column) -> Column:
    return (F.when(is_new, F.lit(0.8))
            .when(age_days < 7, F.lit(0.5))
            .when(age_days < 30, F.lit(0.3))
            .otherwise(F.lit(0.1)))


# P9
def fingerprint(col: Column, n: int) -> Column:
    """First ``n`` hex characters of md5 of the text."""
    return F.substring(F.md5(col.cast("string")), 1, n)


# P10
def behavior(amount_c: Column, has_profile: Column, avg: Column, std: Column) -> dict:
    """z-score, ratio and the above-95th flag; 0, 1, 0 when there is no profile."""
    std1 = F.greatest(std, F.lit(1.0))
    return {
        "amount_zscore": F.when(has_profile, (amount_c - avg) / std1).otherwise(F.lit(0.0)),
        "amount_vs_avg_ratio": F.when(has_profile, amount_c / F.greatest(avg, F.lit(1.0)))
        .otherwise(F.lit(1.0)),
        "is_above_95th_percentile": F.when(has_profile, _flag(amount_c > avg + 2 * std1))
        .otherwise(F.lit(0.0)),
    }


# P11
def velocity_score(c1h: Column, c6h: Column, c24h: Column, sum1h: Column) -> Column:
    return F.least(F.lit(10.0),
                   c1h * 3.0 + c6h * 0.5 + c24h * 0.1
                   + F.least(F.lit(1.0), sum1h / 1000.0) * 2.0)


def flag(cond: Column) -> Column:
    return _flag(cond)
