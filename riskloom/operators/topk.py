"""Sorts, limits and top-k (T1-T7). Global top-k is ``orderBy().limit()`` which Spark plans as
``TakeOrderedAndProject`` (per-partition top-k, then a merge of k rows per partition); top-k per
group is ``row_number() <= k`` which Spark 3.5+ runs with a group-limit before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom import schema as S


# T1
def user_recent(txn: DataFrame, user_id: str, limit: int = 50) -> DataFrame:
    return (txn.where(F.col("user_id") == F.lit(user_id))
            .orderBy(F.col("timestamp").desc_nulls_last(), F.col("transaction_id"))
            .limit(limit))


# T2
def recent_transactions(scored: DataFrame, limit: int = 100, fraud_only: bool = False) -> DataFrame:
    d = scored
    if fraud_only:
        d = d.where(F.coalesce(F.col("fraud_score"), F.lit(0.0)) > S.FRAUD_SCORE_CUT)
    return d.orderBy(F.col("scored_at").desc_nulls_last(), F.col("transaction_id")).limit(limit)


# T3
def top_per_user(txn: DataFrame, n: int = 100, user: str = "user_id") -> DataFrame:
    """Last ``n`` transactions of every user (newest first, rank 1 = newest). The window has a
    rank limit, so Spark keeps at most n rows per user before and after the shuffle."""
    w = Window.partitionBy(user).orderBy(F.col("timestamp").desc_nulls_last(),
                                         F.col("transaction_id").desc())
    return txn.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# T4
def latest_score(scores: DataFrame) -> DataFrame:
    """Last write per transaction id (ties on ``scored_at``: larger model version string)."""
    rec = F.struct(*[F.col(c) for c in scores.columns if c != "transaction_id"])
    key = F.struct(F.col("scored_at"), F.col("model_version"))
    return (scores.groupBy("transaction_id").agg(F.max_by(rec, key).alias("_r"))
            .select("transaction_id", "_r.*"))


# T5
ALERT_MESSAGES = {
    # FIXED VALUES: alert types and messages as shown by the dashboard.
    "high_risk": "High-risk transaction detected from new device",
    "velocity": "Unusual velocity pattern detected for user",
}


def alerts(scored: DataFrame, limit: int = 10, velocity_threshold: float = 3.0) -> DataFrame:
    """Newest ``limit`` alerts. Conditions (ours; the dashboard draws them at random):
    ``high_risk`` = new device and score >= 0.6; ``velocity`` = velocity score >= threshold.
    A transaction meeting both yields one alert per type."""
    # one pass: each row brings the types it meets
    high = (F.col("is_new_device") > 0) & (F.col("fraud_score") >= S.THRESHOLD_MEDIUM)
    fast = F.col("velocity_score") >= velocity_threshold
    types = F.array_compact(F.array(F.when(high, F.lit("high_risk")), F.when(fast, F.lit("velocity"))))
    found = scored.where(high | fast).select(F.explode(types).alias("alert_type"), "transaction_id", "user_id", "scored_at")
    msg = F.when(F.col("alert_type") == "high_risk", F.lit(ALERT_MESSAGES["high_risk"])) \
        .otherwise(F.lit(ALERT_MESSAGES["velocity"]))
    return (found.withColumn("message", msg)
            .orderBy(F.col("scored_at").desc(), F.col("transaction_id"), F.col("alert_type"))
            .limit(limit))


# T6
def feature_importance(importances, names: list[str], spark, k: int = 15) -> DataFrame:
    """Top ``k`` features by importance (the vector has one entry per feature: small)."""
    rows = [(n, float(importances[i])) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("feature")).limit(k)


# T7
def seeded_shuffle(df: DataFrame, seed: int = 42, id_col: str = "transaction_id") -> DataFrame:
    """Deterministic shuffle: order by a seeded hash of the id (range-partitioned sort)."""
    from riskloom.operators.learning import seeded_key
    return df.orderBy(seeded_key(id_col, seed), F.col(id_col))


def time_order(df: DataFrame, ts: str = "timestamp", id_col: str = "transaction_id") -> DataFrame:
    return df.orderBy(F.col(ts), F.col(id_col))


def positions(ordered: DataFrame) -> DataFrame:
    """``ordered`` (a sorted frame) with ``position``, 1 for the first row: its place within its range
    partition plus the rows of the partitions before (one count a partition)."""
    from riskloom.operators.prefix import stored, window_sum
    placed = stored(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered") \
        .withColumn("_part", F.shiftright("_at", 33))
    before = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")) \
        .select("_part", F.coalesce(window_sum("_n", [], ["_part"]), F.lit(0)).alias("_before"))
    inside = F.col("_at") - F.shiftleft("_part", 33)
    return placed.join(before, "_part").select(*ordered.columns, (F.col("_before") + inside + 1).alias("position"))
