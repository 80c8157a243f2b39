"""Aggregations (A1-A12) and the exact percentile used by the latency rollups.

All aggregates are partial+final hash aggregates. Percentiles are exact without collecting a
group: values are first counted per (group, value), map-side combined, then range-sorted running
totals over that histogram give the ranks, so the distinct values of one group spread over many
tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import schema as S
from riskloom.operators.prefix import running_totals, stored
from riskloom.operators.timeline import join_null_safe


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- exact percentiles --------------------------------------------------------------------

def exact_percentiles(df: DataFrame, keys: list[str], value: str,
                      probs: dict[str, float], counted: str | None = None) -> DataFrame:
    """Linear-interpolated percentiles (same definition as Spark ``percentile`` and SQL
    ``percentile_cont``) per group; result columns named by ``probs`` keys.

    Histogram (group, value) → count, then per group the cumulative count; the value at
    0-based rank k is the smallest value with cum > k. Without ``keys`` there is one row. With ``counted``
    the rows are such a histogram already, and that column holds the counts."""
    v = F.col(value)
    hist = df.where(v.isNotNull())
    if counted:
        hist = hist.select(*keys, value, F.col(counted).alias("_cnt"))
    else:
        hist = hist.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_cnt"))
    before = running_totals(hist, keys, [value], {"_before": "_cnt"})
    total = before.groupBy(*keys).agg(F.sum("_cnt").alias("_n"))
    if keys:
        h = join_null_safe(before, total, keys)
    else:
        h = before.withColumn("_n", total.select("_n").scalar())
    h = h.withColumn("_cum", F.col("_before") + F.col("_cnt"))
    aggs = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        lo = F.floor(pos)
        hi = F.ceil(pos)
        aggs += [F.min(F.when(F.col("_cum") > lo, v)).alias(f"_lo_{name}"),
                 F.min(F.when(F.col("_cum") > hi, v)).alias(f"_hi_{name}"),
                 F.first(pos - lo, ignorenulls=True).alias(f"_fr_{name}")]
    r = h.groupBy(*keys).agg(*aggs)
    outs = [(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_fr_{n}"))
            .cast("double").alias(n) for n in probs]
    return r.select(*keys, *outs)


def _mean(value: str, n: str) -> Column:
    """Mean of ``value`` over rows that stand for ``n`` rows each; missing values don't count."""
    return F.try_divide(F.sum(F.col(value) * F.col(n)), F.sum(F.when(F.col(value).isNotNull(), F.col(n))))


# ---- A1 -----------------------------------------------------------------------------------

def fraud_statistics(scores: DataFrame, hours: int | None = None,
                     as_of: Column | None = None) -> DataFrame:
    """Totals over the score log: count, fraud (score > 0.5, null → 0), rate, declined,
    review. ``hours=None`` keeps the literal behaviour (all rows); otherwise only rows scored
    after ``as_of - hours``. An empty input gives one row of zeros."""
    s = scores
    if hours is not None:
        ref = as_of if as_of is not None else F.current_timestamp()
        s = s.where(F.col("scored_at") > ref - F.expr(f"INTERVAL {int(hours)} HOURS"))
    fraud = F.coalesce(F.col("fraud_score"), F.lit(0.0)) > S.FRAUD_SCORE_CUT
    total = F.count(F.lit(1))
    fc = F.count_if(fraud)
    return s.agg(
        total.alias("total_transactions"),
        fc.alias("fraud_count"),
        F.coalesce(F.try_divide(fc.cast("double"), total.cast("double")), F.lit(0.0))
        .alias("fraud_rate"),
        F.count_if(F.col("decision") == "DECLINE").alias("declined_count"),
        F.count_if(F.col("decision") == "REVIEW").alias("review_count"),
    )


# ---- A2 -----------------------------------------------------------------------------------

def daily_summary(scores: DataFrame) -> DataFrame:
    """Per day of ``scored_at``: totals, fraud count, averages, declined and review counts,
    newest day first."""
    return (scores.groupBy(F.date_trunc("day", "scored_at").alias("day"))
            .agg(F.count(F.lit(1)).alias("total_transactions"),
                 F.count_if(F.col("fraud_score") > S.FRAUD_SCORE_CUT).alias("fraud_count"),
                 F.avg("fraud_score").alias("avg_fraud_score"),
                 F.avg("latency_ms").alias("avg_latency_ms"),
                 F.count_if(F.col("decision") == "DECLINE").alias("declined_count"),
                 F.count_if(F.col("decision") == "REVIEW").alias("review_count"))
            .orderBy(F.col("day").desc()))


# ---- A3 -----------------------------------------------------------------------------------

def hourly_rollup(scored: DataFrame) -> DataFrame:
    """Fills the hourly analytics table: per hour of ``scored_at`` counts, amounts, average
    score and latency, exact p50/p95/p99 latency. ``scored`` carries the transaction amount
    (score log joined to transactions)."""
    fraud = F.col("fraud_score") > S.FRAUD_SCORE_CUT
    # one pass over the rows: an aggregate per hour and latency, from which sums and ranks both follow
    cells = stored(scored.groupBy(F.date_trunc("hour", "scored_at").alias("hour_bucket"), "latency_ms").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(fraud).alias("fraud_count"),
        F.count_if(F.col("decision") == "DECLINE").alias("declined_count"),
        F.count_if(F.col("decision") == "REVIEW").alias("review_count"),
        F.sum("amount").alias("total_amount"),
        F.sum(F.when(fraud, F.col("amount"))).alias("fraud_amount"),
        F.sum("fraud_score").alias("_score"), F.count("fraud_score").alias("_scores")), "rollup")
    added = lambda c: F.sum(c).alias(c)
    base = cells.groupBy("hour_bucket").agg(
        *[added(c) for c in ("total_transactions", "fraud_count", "declined_count", "review_count")],
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("total_amount", "fraud_amount")],
        F.try_divide(F.sum("_score"), F.sum("_scores")).alias("avg_score"),
        _mean("latency_ms", "total_transactions").alias("avg_latency_ms"))
    pct = exact_percentiles(cells, ["hour_bucket"], "latency_ms",
                            {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95,
                             "p99_latency_ms": 0.99}, "total_transactions")
    return base.join(pct, "hour_bucket", "left")


# ---- A4 -----------------------------------------------------------------------------------

def user_velocity(history: DataFrame, as_of: Column, hours: int = 24,
                  user: str | None = None) -> DataFrame:
    """Per user (or one user): count, amount sum (0 if none), distinct merchants and
    countries over rows with ``timestamp > as_of - hours``."""
    h = history.where(F.col("timestamp") > as_of - F.expr(f"INTERVAL {int(hours)} HOURS"))
    h = h.where(F.col("timestamp") <= as_of)
    if user is not None:
        h = h.where(F.col("user_id") == F.lit(user))
    return h.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("txn_count"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_amount"),
        F.countDistinct("merchant_category").alias("unique_merchants"),
        F.countDistinct("country").alias("unique_countries"))


# ---- A5 / A6 ------------------------------------------------------------------------------

def class_balance(df: DataFrame, label: str = "is_fraud", by: list[str] | None = None) -> DataFrame:
    r = F.avg(F.col(label).cast("double"))
    g = df.groupBy(*(by or []))
    return g.agg(F.count(F.lit(1)).alias("n"), r.alias("fraud_ratio"),
                 F.try_divide(1.0 - r, r).alias("scale_pos_weight"))


def value_counts(df: DataFrame, col: str, where: Column | None = None) -> DataFrame:
    d = df.where(where) if where is not None else df
    return (d.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col(col)))


# ---- A7 / A8 ------------------------------------------------------------------------------

def latency_summary(scores: DataFrame, sla_ms: float = S.SLA_LATENCY_MS) -> DataFrame:
    """Load-test style summary: requests, failures (latency > SLA), failure %, requests per
    second over the covered span, median, mean, p95, p99."""
    at = F.unix_micros("scored_at")
    cells = stored(scores.groupBy("latency_ms").agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_from"),
                                                    F.max(at).alias("_to")), "latencies")
    base = cells.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("requests"),
        F.coalesce(F.sum(F.when(F.col("latency_ms") > sla_ms, F.col("_n"))), F.lit(0)).alias("failures"),
        _mean("latency_ms", "_n").alias("mean_latency_ms"),
        ((F.max("_to") - F.min("_from")) / 1e6).alias("_span_s"))
    names = {"median_latency_ms": 0.5, "p95_latency_ms": 0.95, "p99_latency_ms": 0.99}
    pct = exact_percentiles(cells, [], "latency_ms", names, "_n").select(F.struct(*names)).scalar()
    j = base.withColumn("_pct", pct).select("*", "_pct.*")
    return j.where("requests > 0").select(
        "requests", "failures",
        (F.try_divide(F.col("failures") * 100.0, F.greatest(F.lit(1), F.col("requests"))))
        .alias("failure_pct"),
        F.try_divide(F.col("requests").cast("double"), F.greatest(F.lit(1.0), F.col("_span_s")))
        .alias("requests_per_s"),
        "median_latency_ms", "mean_latency_ms", "p95_latency_ms", "p99_latency_ms")


def latency_by_minute(scores: DataFrame, last_minutes: int | None = 60,
                      as_of: Column | None = None) -> DataFrame:
    d = scores.withColumn("minute", F.date_trunc("minute", "scored_at"))
    if last_minutes is not None:
        ref = as_of if as_of is not None else F.current_timestamp()
        d = d.where((F.col("scored_at") > ref - F.expr(f"INTERVAL {int(last_minutes)} MINUTES"))
                    & (F.col("scored_at") <= ref))
    pct = exact_percentiles(d, ["minute"], "latency_ms",
                            {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95,
                             "p99_latency_ms": 0.99})
    return pct.orderBy("minute")


# ---- A9 -----------------------------------------------------------------------------------

def platform_kpis(txn: DataFrame, scores: DataFrame, users: DataFrame) -> DataFrame:
    """One row: totals, fraud count and rate, mean latency, throughput (scores per second of
    covered time), counts of users / transactions / predictions, and the two dashboard
    flags (mean latency < 50 ms, throughput > 3000/s). One aggregate per table; the two
    single numbers enter as scalar subqueries."""
    s = scores.agg(
        F.count(F.lit(1)).alias("predictions"),
        F.count_if(F.col("fraud_score") > S.FRAUD_SCORE_CUT).alias("fraud_count"),
        F.avg("latency_ms").alias("mean_latency_ms"),
        ((F.max(F.unix_micros("scored_at")) - F.min(F.unix_micros("scored_at"))) / 1e6)
        .alias("_span_s"))
    # the other two tables contribute one number each: scalar subqueries, no join
    j = s.withColumn("transactions", txn.agg(F.count(F.lit(1))).scalar()) \
        .withColumn("users", users.agg(F.count(F.lit(1))).scalar())
    thr = F.try_divide(F.col("predictions").cast("double"), F.greatest(F.lit(1.0), F.col("_span_s")))
    return j.select(
        F.col("transactions").alias("total_transactions"), "fraud_count",
        F.coalesce(F.try_divide(F.col("fraud_count").cast("double"),
                                F.col("predictions").cast("double")), F.lit(0.0))
        .alias("fraud_rate"),
        "mean_latency_ms", thr.alias("throughput_per_s"), "users", "transactions",
        "predictions",
        (F.col("mean_latency_ms") < 50).alias("latency_target_met"),
        (thr > 3000).alias("throughput_target_met"))


# ---- A10 ----------------------------------------------------------------------------------

def build_profiles(txn: DataFrame, users: DataFrame | None = None,
                   as_of: Column | None = None) -> DataFrame:
    """Behavioural baselines per user from the log (re-aimed: the reference draws them at
    random). With ``as_of`` only rows at or before it are used, so a profile never sees later
    rows; ``updated_at`` is ``as_of`` or the user's last transaction.

    avg / sample std of amount (0 for one row), monthly count = ceil(n / months) with
    months = max(1, ceil(days from first transaction to as_of / 30)), merchant diversity
    min(1, distinct / 10), account age in days, most used device (ties: smallest id), home
    country from ``users`` (default US)."""
    d = txn if as_of is None else txn.where(F.col("timestamp") <= as_of)
    agg = d.groupBy("user_id").agg(
        F.avg("amount").alias("avg_txn_amount"),
        F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias("std_txn_amount"),
        F.count(F.lit(1)).alias("_n"),
        F.min("timestamp").alias("_first"),
        F.max("timestamp").alias("_last"),
        F.countDistinct("merchant_category").alias("_nm"))
    ref = as_of if as_of is not None else F.col("_last")
    days = F.datediff(ref, F.col("_first"))
    months = F.greatest(F.lit(1), F.ceil(days / 30.0))
    prof = agg.select(
        "user_id", days.cast("int").alias("account_age_days"), "avg_txn_amount",
        "std_txn_amount", F.ceil(F.col("_n") / months).cast("int").alias("avg_monthly_txns"),
        F.least(F.lit(1.0), F.col("_nm") / 10.0).alias("merchant_diversity"),
        F.lit(0.0).alias("risk_score"), ref.cast("timestamp").alias("updated_at"))
    dev = (d.where(F.col("device_id").isNotNull()).groupBy("user_id", "device_id")
           .agg(F.count(F.lit(1)).alias("_c"))
           .groupBy("user_id")
           .agg(F.min(F.struct((-F.col("_c")).alias("neg"), F.col("device_id").alias("d")))
                .alias("_best"))
           .select("user_id", F.col("_best.d").alias("primary_device_id")))
    prof = prof.join(dev, "user_id", "left")
    if users is not None:
        prof = prof.join(users.select("user_id", "home_country"), "user_id", "left")
    else:
        prof = prof.withColumn("home_country", F.lit(None).cast("string"))
    prof = prof.withColumn("home_country", F.coalesce("home_country", F.lit("US")))
    return prof.select([f.name for f in S.PROFILE.fields])


# ---- A11 ----------------------------------------------------------------------------------

def batch_summary(results: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Per batch: count, total latency, mean latency (total / count, 0 when empty)."""
    g = results.groupBy(batch_col).agg(F.count(F.lit(1)).alias("total_count"),
                                       F.coalesce(F.sum("latency_ms"), F.lit(0.0))
                                       .alias("total_latency_ms"))
    return g.withColumn("avg_latency_ms", F.coalesce(
        F.try_divide(F.col("total_latency_ms"), F.col("total_count").cast("double")),
        F.lit(0.0)))


# ---- A12 ----------------------------------------------------------------------------------

def active_model(models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(active model rows, violation report with one row when more than one is active)."""
    act = models.where(F.col("is_active"))
    viol = (act.agg(F.count(F.lit(1)).alias("active_count"),
                    F.sort_array(F.collect_list("model_version")).alias("versions"))
            .where(F.col("active_count") > 1))
    return act, viol
