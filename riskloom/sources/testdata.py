"""Stand-in inputs built from the driver's test tables.

The driver's tables carry no transactions, profiles or scores, so ``events`` joined to
``customer`` is read as a transaction log (mapping fixed in FIXTURES.md §3). This module only
produces rows in the schemas the jobs expect; every feature, score, aggregate and state fold is
computed by the operators in :mod:`riskloom.operators` on whatever rows it gets.

``mapped_sql()`` is the same mapping in DuckDB SQL, used as the input CTE of the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import schema as S
from riskloom.session import ensure_session_defaults


#: Profiles are built from the log up to here and count for later transactions only.
PROFILE_CUT = "2024-01-15 00:00:00"
#: An earlier state of them, for merges.
EARLIER_CUT = "2024-01-02 00:00:00"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(values: list, idx: Column) -> Column:
    """values[idx] for a 0-based integer column (a constant array lookup)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _user_key(c: Column) -> Column:
    return F.concat(F.lit("U"), F.lpad(c.cast("string"), 6, "0"))


def mapped_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transaction log (FIXTURES §1 labelled schema) plus ``latency_ms`` of the scoring call.

    Columns: txn_seq, transaction_id, user_id, timestamp, amount, currency, merchant_category,
    merchant_category_code, country, is_foreign, device_id, device_age_days, is_new_device,
    is_fraud, fraud_type, latency_ms.
    """
    ensure_session_defaults(spark)
    ev = read_table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", "props")
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    names = [m[0] for m in S.MERCHANTS]
    codes = [m[1] for m in S.MERCHANTS]
    countries = [c[0] for c in S.COUNTRIES]
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("int")
    j = ev.join(cu, ev.user_id == cu.c_custkey, "left").withColumn("k", k)
    home = _pick(countries, F.col("c_nationkey") % 10)
    country = F.when(F.col("k") % 10 == 3,
                     _pick(countries, (F.col("user_id") + F.col("k")) % 10)).otherwise(home)
    new_dev = F.col("k") % 10 == 7
    is_fraud = ((F.col("event_type") == "error") & (F.col("k") >= 50)).cast("int")
    return j.select(
        F.col("event_id").alias("txn_seq"),
        F.concat(F.lit("TXN-"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias(
            "transaction_id"),
        _user_key(F.col("user_id")).alias("user_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("value").alias("amount"),
        F.lit("USD").alias("currency"),
        _pick(names, F.col("k") % 12).alias("merchant_category"),
        _pick(codes, F.col("k") % 12).alias("merchant_category_code"),
        country.alias("country"),
        (country != home).alias("is_foreign"),
        F.concat(F.lit("device_"), F.col("user_id").cast("string"),
                 F.when(new_dev, F.concat(F.lit("_"), F.col("k").cast("string")))
                 .otherwise(F.lit(""))).alias("device_id"),
        F.when(new_dev, F.col("k") % 3).otherwise(3 + (F.col("k") * 37) % 362)
        .cast("int").alias("device_age_days"),
        new_dev.alias("is_new_device"),
        is_fraud.alias("is_fraud"),
        F.when(is_fraud == 1, _pick(S.FRAUD_TYPES, F.col("k") % 5)).alias("fraud_type"),
        (20 + (F.col("event_id") * 7919) % 160).cast("double").alias("latency_ms"),
    )


def mapped_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, home_country) for every customer."""
    countries = [c[0] for c in S.COUNTRIES]
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return cu.select(_user_key(F.col("c_custkey")).alias("user_id"),
                     _pick(countries, F.col("c_nationkey") % 10).alias("home_country"))


def mapped_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as a second, day-grain log with timestamp ties (FIXTURES §3)."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                                   "o_totalprice")
    names = [m[0] for m in S.MERCHANTS]
    countries = [c[0] for c in S.COUNTRIES]
    return o.select(
        F.col("o_orderkey").alias("txn_seq"),
        F.concat(F.lit("ORD-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias(
            "transaction_id"),
        _user_key(F.col("o_custkey")).alias("user_id"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.col("o_totalprice").alias("amount"),
        _pick(names, F.col("o_orderkey") % 12).alias("merchant_category"),
        _pick(countries, F.col("o_orderkey") % 10).alias("country"),
    )


def mapped_requests(log: DataFrame) -> DataFrame:
    """Scoring requests from the log with some defective rows (missing user, missing
    merchant, non-positive amount) so that validation has work to do."""
    seq = F.col("txn_seq")
    return log.select(
        "transaction_id",
        F.when(seq % 101 == 3, F.lit(None).cast("string")).otherwise(F.col("user_id"))
        .alias("user_id"),
        F.when(seq % 97 == 5, -F.col("amount")).otherwise(F.col("amount")).alias("amount"),
        F.col("currency"),
        F.when(seq % 89 == 7, F.lit(None).cast("string")).otherwise(F.col("merchant_category"))
        .alias("merchant_category"),
        "country", "device_id", "timestamp")


# ---- the same mapping in DuckDB SQL (input CTEs of the oracles) ----------------------------

def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def mapped_sql() -> str:
    names = _sql_list([m[0] for m in S.MERCHANTS])
    codes = _sql_list([m[1] for m in S.MERCHANTS])
    countries = _sql_list([c[0] for c in S.COUNTRIES])
    ftypes = _sql_list(S.FRAUD_TYPES)
    return f"""
ev_k AS (
  SELECT e.*, c.c_nationkey, CAST(regexp_extract(e.props, '([0-9]+)', 1) AS INTEGER) AS k
  FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey
),
ev_m AS (
  SELECT *, {countries}[c_nationkey % 10 + 1] AS home,
         CASE WHEN k % 10 = 3 THEN {countries}[(user_id + k) % 10 + 1]
              ELSE {countries}[c_nationkey % 10 + 1] END AS ctry
  FROM ev_k
),
txn AS (
  SELECT event_id AS txn_seq,
         'TXN-' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS transaction_id,
         'U' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS user_id,
         CAST(ts AS TIMESTAMP) AS "timestamp",
         value AS amount,
         'USD' AS currency,
         {names}[k % 12 + 1] AS merchant_category,
         CAST({codes}[k % 12 + 1] AS INTEGER) AS merchant_category_code,
         ctry AS country,
         ctry <> home AS is_foreign,
         'device_' || CAST(user_id AS VARCHAR) ||
           CASE WHEN k % 10 = 7 THEN '_' || CAST(k AS VARCHAR) ELSE '' END AS device_id,
         CAST(CASE WHEN k % 10 = 7 THEN k % 3 ELSE 3 + (k * 37) % 362 END AS INTEGER)
           AS device_age_days,
         k % 10 = 7 AS is_new_device,
         CAST(CASE WHEN event_type = 'error' AND k >= 50 THEN 1 ELSE 0 END AS INTEGER) AS is_fraud,
         CASE WHEN event_type = 'error' AND k >= 50 THEN {ftypes}[k % 5 + 1] END AS fraud_type,
         CAST(20 + (event_id * 7919) % 160 AS DOUBLE) AS latency_ms
  FROM ev_m
),
users AS (
  SELECT 'U' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS user_id,
         {countries}[c_nationkey % 10 + 1] AS home_country
  FROM customer
)"""
