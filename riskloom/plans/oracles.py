"""Independent DuckDB SQL for the correctness oracle.

The SQL is written differently from the Spark plans on purpose: velocity windows are
self-joins with explicit time predicates, rows frames are joins on row numbers, anchored
counters are recursive CTEs, ranking metrics are pair counts. Only the input mapping
(:func:`riskloom.sources.testdata.mapped_sql`) is shared.
"""

from __future__ import annotations

from riskloom import schema as S
from riskloom.sources.testdata import PROFILE_CUT, mapped_sql

H = S.HOUR_US


def _values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in r)
                     + ")" for r in rows)
    return f"(VALUES {body}) AS v({', '.join(cols)})"


def dist_sql(a: str, b: str) -> str:
    pairs = " OR ".join(f"({a} = '{x}' AND {b} = '{y}') OR ({a} = '{y}' AND {b} = '{x}')"
                        for x, y in S.NEAR_COUNTRY_PAIRS)
    return (f"CASE WHEN {a} = {b} THEN 0.0 WHEN {pairs} THEN {S.NEAR_DISTANCE_KM} "
            f"ELSE {S.FAR_DISTANCE_KM} END")


def profiles_sql(src: str = "txn", cut: str | None = f"TIMESTAMP '{PROFILE_CUT}'") -> str:
    """A10 in SQL over ``src`` (rows with timestamp <= cut; all rows without a cut)."""
    where = f'WHERE "timestamp" <= {cut}' if cut else ""
    ref = cut if cut else "last_ts"
    return f"""
pa AS (
  SELECT user_id, avg(amount) AS avg_txn_amount,
         coalesce(stddev_samp(amount), 0.0) AS std_txn_amount, count(*) AS n,
         min("timestamp") AS first_ts, max("timestamp") AS last_ts,
         count(DISTINCT merchant_category) AS nm
  FROM {src} {where} GROUP BY user_id
),
pd AS (
  SELECT user_id, device_id FROM (
    SELECT user_id, device_id,
           row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, device_id) AS r
    FROM {src} {where} {'AND' if where else 'WHERE'} device_id IS NOT NULL
    GROUP BY user_id, device_id) WHERE r = 1
),
profiles AS (
  SELECT a.user_id, coalesce(u.home_country, 'US') AS home_country,
         CAST(date_diff('day', CAST(first_ts AS DATE), CAST({ref} AS DATE)) AS INTEGER)
           AS account_age_days,
         avg_txn_amount, std_txn_amount,
         CAST(ceil(n / greatest(1, ceil(date_diff('day', CAST(first_ts AS DATE),
              CAST({ref} AS DATE)) / 30.0))) AS INTEGER) AS avg_monthly_txns,
         d.device_id AS primary_device_id,
         least(1.0, nm / 10.0) AS merchant_diversity, 0.0 AS risk_score,
         CAST({ref} AS TIMESTAMP) AS updated_at
  FROM pa a LEFT JOIN pd d ON d.user_id = a.user_id
  LEFT JOIN users u ON u.user_id = a.user_id
)"""


def feature_ctes() -> str:
    """txn → tx (µs, row numbers) → velocity / rows / device joins → feat (34 features)."""
    mdim = _values([(n, c, float(r)) for n, c, r in S.MERCHANTS], ["cat", "code", "risk"])
    cdim = _values([(c, float(r)) for c, r in S.COUNTRIES], ["ctry", "risk"])
    hr = "','".join(S.HIGH_RISK_MERCHANTS)
    ce = "','".join(S.CASH_EQUIVALENT_MERCHANTS)
    on = "','".join(S.ONLINE_MERCHANTS)
    hc = "','".join(S.HIGH_RISK_COUNTRIES)
    return f"""
tx AS (
  SELECT *, epoch_us("timestamp") AS tus,
         row_number() OVER (PARTITION BY user_id ORDER BY "timestamp", transaction_id) AS rn
  FROM txn
),
vel AS (
  SELECT a.transaction_id,
         count(b.transaction_id) FILTER (WHERE b.tus >= a.tus - {H}) AS c1,
         count(b.transaction_id) FILTER (WHERE b.tus >= a.tus - {6 * H}) AS c6,
         count(b.transaction_id) AS c24,
         coalesce(sum(b.amount) FILTER (WHERE b.tus >= a.tus - {H}), 0.0) AS s1,
         coalesce(sum(b.amount), 0.0) AS s24,
         count(DISTINCT CASE WHEN b.transaction_id IS NOT NULL THEN coalesce(b.merchant_category, '') END) AS um,
         count(DISTINCT CASE WHEN b.transaction_id IS NOT NULL THEN coalesce(b.country, '') END) AS uc
  FROM tx a LEFT JOIN tx b
    ON b.user_id = a.user_id AND b.tus < a.tus AND b.tus >= a.tus - {24 * H}
  GROUP BY a.transaction_id
),
devs AS (
  SELECT a.transaction_id, greatest(1, count(DISTINCT b.device_id)) AS d24
  FROM tx a JOIN tx b
    ON b.user_id = a.user_id AND b.tus <= a.tus AND b.tus >= a.tus - {24 * H}
  GROUP BY a.transaction_id
),
lastt AS (
  SELECT a.transaction_id, max(b.tus) AS prev_tus
  FROM tx a LEFT JOIN tx b ON b.user_id = a.user_id AND b.tus < a.tus
  GROUP BY a.transaction_id
),
rowsf AS (
  SELECT a.transaction_id, count(b.transaction_id) AS hn,
         count(DISTINCT b.merchant_category) AS hm,
         sum(b.amount) FILTER (WHERE b.rn >= a.rn - 10) AS spend10,
         max(CASE WHEN b.rn = a.rn - 1 THEN b.country END) AS prev_country,
         max(CASE WHEN b.rn = a.rn - 1 THEN b.tus END) AS prev_row_tus
  FROM tx a LEFT JOIN tx b ON b.user_id = a.user_id AND b.rn < a.rn AND b.rn >= a.rn - 100
  GROUP BY a.transaction_id
),
mdim AS (SELECT cat, CAST(code AS INTEGER) AS code, CAST(risk AS DOUBLE) AS risk FROM {mdim}),
cdim AS (SELECT ctry, CAST(risk AS DOUBLE) AS risk FROM {cdim}),
base AS (
  SELECT t.*, p.user_id IS NOT NULL AS has_profile,
         coalesce(p.home_country, 'US') AS home_country,
         coalesce(p.avg_txn_amount, 100.0) AS avg_amt,
         coalesce(p.std_txn_amount, 50.0) AS std_amt,
         coalesce(p.avg_monthly_txns, 20) AS monthly,
         coalesce(p.primary_device_id, '') AS primary_device_id,
         coalesce(p.account_age_days, 0) AS account_age_days,
         hour(t."timestamp") AS hh, isodow(t."timestamp") - 1 AS dw,
         coalesce(t.country, 'US') AS ctry
  FROM tx t LEFT JOIN profiles p ON p.user_id = t.user_id AND t."timestamp" > p.updated_at
),
feat AS (
  SELECT b.txn_seq, b.transaction_id, b.user_id, b."timestamp", b.merchant_category,
         b.country, b.device_id, b.is_fraud, b.fraud_type, b.latency_ms, b.has_profile,
         b.home_country, b.avg_amt, b.std_amt, b.monthly, b.primary_device_id,
         b.merchant_category_code AS given_code,
         coalesce(b.amount, 0.0) AS amount,
         ln(1 + coalesce(b.amount, 0.0)) AS amount_log,
         CAST(b.hh AS DOUBLE) AS hour_of_day,
         CAST(b.dw AS DOUBLE) AS day_of_week,
         CASE WHEN b.dw >= 5 THEN 1.0 ELSE 0.0 END AS is_weekend,
         CASE WHEN b.hh >= 23 OR b.hh <= 5 THEN 1.0 ELSE 0.0 END AS is_night,
         CASE WHEN b.hh BETWEEN 0 AND 6 THEN 1.0 ELSE 0.0 END AS is_high_risk_hour,
         coalesce(m.risk, {S.UNKNOWN_MERCHANT_RISK}) AS merchant_risk_score,
         m.code AS merchant_code,
         CASE WHEN b.merchant_category IN ('{hr}') THEN 1.0 ELSE 0.0 END AS is_high_risk_merchant,
         CASE WHEN b.merchant_category IN ('{ce}') THEN 1.0 ELSE 0.0 END AS is_cash_equivalent,
         CASE WHEN b.merchant_category IN ('{on}') THEN 1.0 ELSE 0.0 END AS is_online,
         CAST(v.c1 AS DOUBLE) AS txn_count_1h, CAST(v.c6 AS DOUBLE) AS txn_count_6h,
         CAST(v.c24 AS DOUBLE) AS txn_count_24h, v.s1 AS amount_sum_1h, v.s24 AS amount_sum_24h,
         CAST(v.um AS DOUBLE) AS unique_merchants_24h, CAST(v.uc AS DOUBLE) AS unique_countries_24h,
         coalesce((b.tus - l.prev_tus) / {float(H)}, 24.0) AS time_since_last_txn_hours,
         least(10.0, v.c1 * 3.0 + v.c6 * 0.5 + v.c24 * 0.1 + least(1.0, v.s1 / 1000.0) * 2.0)
           AS velocity_score,
         CASE WHEN b.has_profile THEN (coalesce(b.amount, 0.0) - b.avg_amt) / greatest(b.std_amt, 1.0)
              ELSE 0.0 END AS amount_zscore,
         CASE WHEN b.has_profile THEN coalesce(b.amount, 0.0) / greatest(b.avg_amt, 1.0)
              ELSE 1.0 END AS amount_vs_avg_ratio,
         CASE WHEN b.has_profile AND coalesce(b.amount, 0.0) > b.avg_amt + 2 * greatest(b.std_amt, 1.0)
              THEN 1.0 ELSE 0.0 END AS is_above_95th_percentile,
         CASE WHEN r.hn > 0 THEN least(1.0, r.hm / 10.0) ELSE 0.5 END AS merchant_diversity_score,
         CASE WHEN b.has_profile AND r.spend10 IS NOT NULL
              THEN r.spend10 / greatest(b.avg_amt * b.monthly / 30.0, 1.0) ELSE 1.0 END
           AS spending_velocity_vs_normal,
         CASE WHEN coalesce(b.is_foreign, b.ctry <> b.home_country) THEN 1.0 ELSE 0.0 END AS is_foreign,
         CASE WHEN b.ctry IN ('{hc}') THEN 1.0 ELSE 0.0 END AS is_high_risk_country,
         coalesce(c.risk, {S.UNKNOWN_COUNTRY_RISK}) AS country_risk_score,
         {dist_sql('b.home_country', 'b.ctry')} AS distance_from_home,
         CASE WHEN r.prev_country IS NOT NULL AND r.prev_country <> b.ctry
                   AND (b.tus - r.prev_row_tus) / {float(H)} < {dist_sql('r.prev_country', 'b.ctry')} / 500.0 * 0.5
              THEN 1.0 ELSE 0.0 END AS is_impossible_travel,
         CASE WHEN coalesce(b.is_new_device, false) THEN 1.0 ELSE 0.0 END AS is_new_device,
         CAST(coalesce(b.device_age_days, 30) AS DOUBLE) AS device_age_days,
         CASE WHEN coalesce(b.is_new_device, false) THEN 0.8
              WHEN coalesce(b.device_age_days, 30) < 7 THEN 0.5
              WHEN coalesce(b.device_age_days, 30) < 30 THEN 0.3 ELSE 0.1 END AS device_risk_score,
         CAST(d.d24 AS DOUBLE) AS devices_used_24h
  FROM base b
  LEFT JOIN vel v ON v.transaction_id = b.transaction_id
  LEFT JOIN devs d ON d.transaction_id = b.transaction_id
  LEFT JOIN lastt l ON l.transaction_id = b.transaction_id
  LEFT JOIN rowsf r ON r.transaction_id = b.transaction_id
  LEFT JOIN mdim m ON m.cat = b.merchant_category
  LEFT JOIN cdim c ON c.ctry = b.ctry
),
scored AS (
  SELECT f.*,
         round(least(1.0, 0.02 + merchant_risk_score * 0.35 + country_risk_score * 0.30
               + device_risk_score * 0.30
               + least(10.0, txn_count_1h * 3.0 + txn_count_6h * 0.5 + txn_count_24h * 0.1) * 0.02
               + is_foreign * 0.15 + is_above_95th_percentile * 0.25 + is_high_risk_hour * 0.15), 4)
           AS fraud_score
  FROM feat f
),
scored2 AS (
  SELECT s.*,
         CASE WHEN fraud_score < 0.3 THEN 'LOW' WHEN fraud_score < 0.6 THEN 'MEDIUM'
              WHEN fraud_score < 0.85 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level,
         CASE WHEN fraud_score < 0.6 THEN 'APPROVE' WHEN fraud_score < 0.85 THEN 'REVIEW'
              ELSE 'DECLINE' END AS decision,
         list_filter([CASE WHEN is_above_95th_percentile > 0 THEN 'HIGH_AMOUNT' END,
                      CASE WHEN is_high_risk_merchant > 0 THEN 'HIGH_RISK_MERCHANT' END,
                      CASE WHEN is_high_risk_country > 0 THEN 'HIGH_RISK_COUNTRY' END,
                      CASE WHEN is_foreign > 0 THEN 'FOREIGN_TRANSACTION' END,
                      CASE WHEN is_new_device > 0 THEN 'NEW_DEVICE' END,
                      CASE WHEN is_high_risk_hour > 0 THEN 'OFF_HOURS' END],
                     lambda x: x IS NOT NULL) AS risk_factors,
         0.8 AS confidence, '{S.RULE_MODEL_VERSION}' AS model_version,
         make_timestamp(epoch_us("timestamp") + CAST(latency_ms * 1000 AS BIGINT)) AS scored_at
  FROM scored s
)"""


def with_ctes(*blocks: str) -> str:
    return "WITH " + ",\n".join(b.strip().rstrip(",") for b in blocks if b.strip())


def base_ctes() -> str:
    """mapping + profiles + features + scored (DuckDB runs only the CTEs a query uses)."""
    return with_ctes(mapped_sql(), profiles_sql(), feature_ctes())
