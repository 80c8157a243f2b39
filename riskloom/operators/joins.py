"""Joins (J1-J9).

Dimension joins (J2) broadcast the fixed 12/10-row dimensions. Every other join is left to
Catalyst/AQE (sort-merge with skew splitting, or broadcast when runtime statistics show a small
side); nothing whose size grows with the data is broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import schema as S

PROFILE_FIELDS = ["home_country", "account_age_days", "avg_txn_amount", "std_txn_amount",
                  "avg_monthly_txns", "primary_device_id"]


# J1
def enrich_profile(txn: DataFrame, profiles: DataFrame, user: str = "user_id") -> DataFrame:
    """Left join to the profile table; a profile with an ``updated_at`` counts only for rows of
    later ``timestamp``, so no row sees its own or later rows in it. ``has_profile`` tells whether a row existed; field
    defaults (home US, age 0, avg 100, std 50, monthly 20, device '') fill missing fields
    either way, but behavioral features use their no-profile defaults when it is false."""
    timed = "timestamp" in txn.columns and "updated_at" in profiles.columns
    p = profiles.select(user, *[F.col(c) for c in PROFILE_FIELDS if c in profiles.columns],
                        F.lit(True).alias("has_profile"), *[F.col("updated_at").alias("_profile_at")] * timed)
    drop = [c for c in PROFILE_FIELDS + ["has_profile"] if c in txn.columns]
    j = txn.drop(*drop).join(p, user, "left")
    if timed:
        # a profile counts for what comes after it
        known = F.col("has_profile") & (F.col("_profile_at").isNull() | (F.col("timestamp") > F.col("_profile_at")))
        j = j.withColumn("has_profile", F.coalesce(known, F.lit(False))).drop("_profile_at")
        j = j.withColumns({c: F.when(F.col("has_profile"), F.col(c)) for c in PROFILE_FIELDS if c in p.columns})
    out = j.withColumn("has_profile", F.coalesce(F.col("has_profile"), F.lit(False)))
    for c in PROFILE_FIELDS:
        dflt = F.lit(S.PROFILE_DEFAULTS[c])
        out = out.withColumn(c, F.coalesce(F.col(c), dflt) if c in p.columns else dflt)
    return out


# J2
def enrich_dims(txn: DataFrame, spark=None) -> DataFrame:
    """Merchant code/risk and country risk from the fixed dimensions (broadcast: 12 and 10
    rows, independent of the data size). Unknown keys keep nulls; features default them."""
    spark = spark or txn.sparkSession
    m = S.merchant_dim(spark).select(
        F.col("merchant_category").alias("_m_cat"),
        F.col("merchant_category_code").alias("_dim_merchant_code"),
        F.col("merchant_risk_score").alias("_dim_merchant_risk"))
    c = S.country_dim(spark).select(F.col("country").alias("_c_code"),
                                    F.col("country_risk_score").alias("_dim_country_risk"))
    j = txn.join(F.broadcast(m), txn["merchant_category"] == m["_m_cat"], "left")
    j = j.join(F.broadcast(c), F.coalesce(j["country"], F.lit("US")) == c["_c_code"], "left")
    return j.drop("_m_cat", "_c_code")


# J3
def high_risk_transactions(txn: DataFrame, scores: DataFrame, cut: float = S.HIGH_RISK_VIEW_CUT,
                           limit: int = 1000) -> DataFrame:
    """Transactions joined to every score above ``cut`` (duplicates kept), newest score first,
    first ``limit`` (transaction id breaks ties)."""
    t = txn.select("transaction_id", "user_id", "amount", "merchant_category", "country")
    s = scores.where(F.col("fraud_score") > cut).select(
        "transaction_id", "fraud_score", "risk_level", "decision", "risk_factors", "scored_at")
    return (t.join(s, "transaction_id", "inner")
            .orderBy(F.col("scored_at").desc(), F.col("transaction_id"))
            .limit(limit))


# J4
CELL_ROWS = 20_000


def history_interval_join(txn: DataFrame, hours: int = 24, user: str = "user_id",
                          id_col: str = "transaction_id", cell_rows: int = CELL_ROWS) -> DataFrame:
    """Pairs (transaction, earlier transaction of the same user within ``hours``), lower edge
    inclusive, strictly earlier timestamps. Equi key (user, time bucket of width W) plus a
    range residual: each row probes its own and the previous bucket, so the join stays an equi-join
    (no nested loop).

    A bucket that would meet more than ``cell_rows`` rows is cut into a grid: its rows and the rows they meet
    are dealt by a hash of the id into parts of about that size, each part is copied along the other axis, and every pair
    meets in one cell. Rows without a user or a time are in no pair."""
    w_us = hours * S.HOUR_US
    base = txn.select(user, id_col, "timestamp", "amount", "merchant_category", "country") \
        .withColumn("_t", F.unix_micros(F.col("timestamp"))).where(F.col(user).isNotNull() & F.col("_t").isNotNull())
    cur = base.withColumn("_b", F.floor(F.col("_t") / w_us).cast("long"))
    hist = cur.withColumn("_b0", F.col("_b")).withColumn("_b", F.explode(F.array(F.col("_b0"), F.col("_b0") + 1)))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(cell_rows))).cast("int")
    own = F.count_if(F.col("_b") == F.col("_b0"))
    grid = (hist.groupBy(F.col(user).alias("_gu"), F.col("_b").alias("_gb")).agg(F.count(F.lit(1)).alias("_met"), own.alias("_own"))
            .where((F.col("_met") > cell_rows) & (F.col("_own") > 0))
            .select("_gu", "_gb", parts(F.col("_own")).alias("_rows"), parts(F.col("_met")).alias("_cols")))

    def dealt(rows: DataFrame, mine: str, other: str, place: str, copies: str) -> DataFrame:
        one = lambda c: F.coalesce(F.col(c), F.lit(1))
        d = rows.join(grid, (F.col(user) == F.col("_gu")) & (F.col("_b") == F.col("_gb")), "left")
        return (d.withColumn(place, F.pmod(F.xxhash64(id_col, "_t"), one(mine)).cast("int"))
                .withColumn(copies, F.explode(F.sequence(F.lit(0), one(other) - 1)))
                .drop("_gu", "_gb", "_rows", "_cols"))

    cur = dealt(cur, "_rows", "_cols", "_i", "_j")
    hist = dealt(hist.drop("_b0"), "_cols", "_rows", "_j", "_i")
    h = hist.select(*[F.col(c).alias("h_" + c) for c in hist.columns])
    j = cur.join(h, (cur[user] == h["h_" + user]) & (cur["_b"] == h["h__b"]) & (cur["_i"] == h["h__i"]) & (cur["_j"] == h["h__j"])
                 & (h["h__t"] < cur["_t"]) & (h["h__t"] >= cur["_t"] - F.lit(w_us)), "inner")
    return j.select(cur[user], cur[id_col], cur["timestamp"],
                    h["h_" + id_col].alias("hist_transaction_id"),
                    h["h_timestamp"].alias("hist_timestamp"),
                    h["h_amount"].alias("hist_amount"),
                    h["h_merchant_category"].alias("hist_merchant_category"),
                    h["h_country"].alias("hist_country"))


# J5
def orphan_transactions(txn: DataFrame, users: DataFrame, user: str = "user_id") -> DataFrame:
    return txn.join(users.select(user), user, "left_anti")


def orphan_scores(scores: DataFrame, txn: DataFrame) -> DataFrame:
    return scores.join(txn.select("transaction_id"), "transaction_id", "left_anti")


# J6
def upsert_profiles(old: DataFrame, new: DataFrame, as_of: Column,
                    key: str = "user_id") -> DataFrame:
    """Merge: given (non-null) fields of ``new`` override, absent keys are inserted.
    ``updated_at`` becomes ``as_of`` for rows whose values changed or that are new."""
    fields = [c for c in old.columns if c not in (key, "updated_at")]
    o = old.select(key, *[F.col(c).alias("o_" + c) for c in fields + ["updated_at"]],
                   F.lit(True).alias("_old"))
    n = new.select(key, *[F.col(c).alias("n_" + c) for c in fields if c in new.columns],
                   F.lit(True).alias("_new"))
    j = o.join(n, key, "full_outer")
    outs, changed = [], F.lit(False)
    for c in fields:
        if ("n_" + c) in n.columns:
            v = F.coalesce(F.col("n_" + c), F.col("o_" + c))
            changed = changed | ~F.col("o_" + c).eqNullSafe(v)
        else:
            v = F.col("o_" + c)
        outs.append(v.alias(c))
    is_new = F.col("_old").isNull()
    upd = F.when(is_new | (F.col("_new").isNotNull() & changed), as_of) \
        .otherwise(F.col("o_updated_at"))
    return j.select(key, *outs, upd.alias("updated_at"))


# J7
def insert_if_absent(existing: DataFrame, new: DataFrame, key: str = "user_id") -> DataFrame:
    """Insert only new keys (ON CONFLICT DO NOTHING); idempotent. Duplicate new keys keep the
    first by the remaining columns' order."""
    order = Window.partitionBy(key).orderBy(*[c for c in existing.columns if c != key] or [key])
    fresh = (new.join(existing.select(key), key, "left_anti").withColumn("_rn", F.row_number().over(order))
             .where("_rn = 1").drop("_rn"))
    return existing.unionByName(fresh.select(*existing.columns))


# J8
def reuse_scores(requests: DataFrame, score_cache: DataFrame, as_of: Column,
                 ttl_seconds: int = S.SCORE_TTL_SECONDS) -> tuple[DataFrame, DataFrame]:
    """Split requests into (hits with the cached score, work list to score). A cache entry
    is live while ``as_of <= written_at + ttl`` (expired is strict ``>``); the latest live
    write wins (equal times: the highest score)."""
    live = score_cache.where(as_of <= F.col("written_at") + F.expr(f"INTERVAL {ttl_seconds} SECONDS"))
    rest = [F.col(c).desc() for c in score_cache.columns if c not in ("transaction_id", "written_at")]
    w = Window.partitionBy("transaction_id").orderBy(F.col("written_at").desc(), *rest)
    latest = live.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    hits = requests.select("transaction_id").join(latest, "transaction_id", "inner")
    todo = requests.join(latest.select("transaction_id"), "transaction_id", "left_anti")
    return hits, todo


# J9
def profile_cascade(sources: list[DataFrame], key: str = "user_id") -> DataFrame:
    """Whole profile row from the first source (by list order) that has the key; of several rows
    in one source the first by its columns' order."""
    parts = [s.withColumn("_prio", F.lit(i)) for i, s in enumerate(sources)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_prio", *[c for c in u.columns if c not in (key, "_prio")])
    return u.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_prio")
