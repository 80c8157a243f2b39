"""Hand-made edges (FIXTURES.md §5)."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import T0, profile_rows, txn_rows
from riskloom.operators import evaluation as E
from riskloom.operators import windows as W
from riskloom.plans.features import build_features

H = dt.timedelta(hours=1)
US = dt.timedelta(microseconds=1)


def _by_id(df):
    return {r.transaction_id: r for r in df.collect()}


@pytest.mark.parametrize("hours", [1, 6, 24])
def test_window_edge_exact_and_one_microsecond(spark, hours):
    w = dt.timedelta(hours=hours)
    rows = [dict(transaction_id="A0", user_id="U1", timestamp=T0),
            dict(transaction_id="A1", user_id="U1", timestamp=T0 + w),        # exactly W apart
            dict(transaction_id="B0", user_id="U2", timestamp=T0),
            dict(transaction_id="B1", user_id="U2", timestamp=T0 + w + US)]   # 1 µs more
    df = txn_rows(spark, rows)
    online = _by_id(W._clean(W.user_windows(df, W.velocity_columns((hours,), (), ()))))
    assert online["A1"][f"txn_count_{hours}h"] == 1
    assert online["B1"][f"txn_count_{hours}h"] == 0
    if hours in (1, 24):
        batch = _by_id(W.velocity_batch(df))
        assert batch["A1"][f"txn_count_{hours}h"] == 0   # lower edge exclusive
        assert batch["B1"][f"txn_count_{hours}h"] == 0


def test_first_row_defaults(spark):
    df = txn_rows(spark, [dict(transaction_id="T", user_id="U1", timestamp=T0)])
    f = build_features(df, profile_rows(spark, [dict(user_id="U1", home_country="US",
                                                     avg_txn_amount=100.0, std_txn_amount=50.0,
                                                     avg_monthly_txns=20)])).first()
    assert f.time_since_last_txn_hours == 24.0
    assert f.merchant_diversity_score == 0.5 and f.spending_velocity_vs_normal == 1.0
    assert f.txn_count_1h == f.txn_count_24h == 0.0
    assert W.velocity_batch(df).first().time_since_last_txn == 0.0


@pytest.mark.parametrize("dest,delta,expected", [
    ("CA", H - US, 1.0), ("CA", H, 0.0), ("NG", 5 * H - US, 1.0), ("NG", 5 * H, 0.0),
    ("US", US, 0.0)])
def test_impossible_travel(spark, dest, delta, expected):
    df = txn_rows(spark, [dict(transaction_id="A", user_id="U1", timestamp=T0, country="US"),
                          dict(transaction_id="B", user_id="U1", timestamp=T0 + delta,
                               country=dest)])
    r = _by_id(W.impossible_travel(df))
    assert r["B"].is_impossible_travel == expected
    assert r["A"].is_impossible_travel == 0.0


def test_zero_std_avg_null_amount_unknown_dims_device_ages(spark):
    prof = profile_rows(spark, [dict(user_id="U1", home_country="US", avg_txn_amount=0.0,
                                     std_txn_amount=0.0, avg_monthly_txns=0)])
    df = txn_rows(spark, [
        dict(transaction_id="Z", user_id="U1", timestamp=T0, amount=5.0,
             merchant_category="pet_shop", country="XX"),
        dict(transaction_id="N", user_id="U2", timestamp=T0, amount=None),
        dict(transaction_id="D6", user_id="U3", timestamp=T0, device_age_days=6),
        dict(transaction_id="D7", user_id="U4", timestamp=T0, device_age_days=7),
        dict(transaction_id="D29", user_id="U5", timestamp=T0, device_age_days=29),
        dict(transaction_id="D30", user_id="U6", timestamp=T0, device_age_days=30)])
    f = _by_id(build_features(df, prof))
    assert f["Z"].amount_zscore == 5.0 and f["Z"].amount_vs_avg_ratio == 5.0
    assert f["Z"].merchant_risk_score == 0.3 and f["Z"].country_risk_score == 0.3
    assert f["N"].amount == 0.0
    assert [f[k].device_risk_score for k in ("D6", "D7", "D29", "D30")] == [0.5, 0.3, 0.3, 0.1]


def test_empty_tables(spark):
    from riskloom import schema as S
    from riskloom.operators.aggregates import batch_summary, fraud_statistics
    empty = spark.createDataFrame([], S.SCORE)
    r = fraud_statistics(empty).first()
    assert (r.total_transactions, r.fraud_count, r.fraud_rate, r.declined_count,
            r.review_count) == (0, 0, 0.0, 0, 0)
    assert batch_summary(empty.withColumn("batch_id", F.lit(1))).count() == 0


def test_one_class_metrics_are_null(spark):
    df = spark.createDataFrame([(0.1, 0), (0.5, 0), (0.9, 0)], "score double, label int")
    assert E.roc_auc(df).first()[0] is None
    assert E.average_precision(df).first()[0] is None


def _brute_metrics(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y != 1]
    auc = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))
    ths = sorted({s for s, _ in pairs}, reverse=True)
    ap, prev_r, best = 0.0, 0.0, None
    for t in ths:
        tp = sum(1 for s, y in pairs if s >= t and y == 1)
        fp = sum(1 for s, y in pairs if s >= t and y != 1)
        p, r = tp / (tp + fp), tp / len(pos)
        ap += (r - prev_r) * p
        prev_r = r
        f1 = 2 * p * r / (p + r + 1e-10)
        if best is None or f1 > best[0] or (f1 == best[0] and t < best[1]):
            best = (f1, t)
    return auc, ap, best[1]


def test_ranking_metrics_with_ties(spark):
    pairs = [(0.3, 1), (0.3, 0), (0.5, 1), (0.5, 1), (0.5, 0), (0.1, 0), (0.9, 1), (0.9, 0),
             (0.2, 1), (0.7, 0), (0.7, 1)]
    df = spark.createDataFrame(pairs, "score double, label int")
    auc, ap, th = _brute_metrics(pairs)
    assert abs(E.roc_auc(df).first()[0] - auc) < 1e-12
    assert abs(E.average_precision(df).first()[0] - ap) < 1e-12
    assert E.best_threshold(df).first().threshold == th
    c = E.confusion(df).first()
    assert c.tn + c.fp + c.fn + c.tp == len(pairs)


def test_ttl_edge(spark):
    from riskloom.operators.filters import unexpired
    df = spark.createDataFrame([("a", T0)], "k string, written_at timestamp")
    assert unexpired(df, F.lit(T0 + dt.timedelta(seconds=300)), 300).count() == 1
    assert unexpired(df, F.lit(T0 + dt.timedelta(seconds=300, microseconds=1)), 300).count() == 0


@pytest.mark.parametrize("hot", [250_000, None])
def test_anchored_counter_edges(spark, hot):
    rows = [dict(transaction_id="E0", user_id="U1", timestamp=T0),
            dict(transaction_id="E1", user_id="U1", timestamp=T0 + H),          # at anchor + W
            dict(transaction_id="E2", user_id="U1", timestamp=T0 + H + US),     # new window
            dict(transaction_id="E3", user_id="U1", timestamp=T0 + H + 2 * US)]
    r = _by_id(W.anchored_counter(txn_rows(spark, rows), 3600, hot_threshold=hot))
    assert [r[k].count_in_window for k in ("E0", "E1", "E2", "E3")] == [1, 2, 1, 2]
    lim = _by_id(W.rate_limit(txn_rows(spark, rows), limit=1, window_seconds=3600,
                              hot_threshold=hot))
    assert [lim[k].allowed for k in ("E0", "E1", "E2", "E3")] == [True, False, True, False]
    assert lim["E1"].count_in_window == 1     # a denied event leaves the count unchanged


@pytest.mark.parametrize("hot", [250_000, None])
def test_anchored_counter_over_many_blocks(spark, hot):
    """1,500 rows of one user, ties included, and two short users against a plain loop."""
    rng = random.Random(7)
    rows, at = [], T0
    for i in range(1500):
        at += rng.choice([0, 1, 700, 1800, 3600, 3601]) * dt.timedelta(seconds=1)
        rows.append(dict(transaction_id=f"B{i:04d}", user_id="U1", timestamp=at))
    rows += [dict(transaction_id="C0", user_id="U2", timestamp=T0), dict(transaction_id="N0", user_id=None, timestamp=T0),
             dict(transaction_id="N1", user_id=None, timestamp=T0 + US)]
    want, state = {}, {}
    for r in rows:
        a, n = state.get(r["user_id"], (None, 0))
        a, n = (r["timestamp"], 1) if a is None or r["timestamp"] > a + H else (a, n + 1)
        state[r["user_id"]] = a, n
        want[r["transaction_id"]] = n
    df = txn_rows(spark, rows).repartition(5)
    got = W.anchored_counter(df, 3600, hot_threshold=hot).collect()
    assert {r.transaction_id: r.count_in_window for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("cell", [20_000, 7, 1])
def test_history_pairs_of_a_user_with_half_of_the_log(spark, cell):
    """Every pair once, however finely the cells are cut; ties, the window's edges, null users and times."""
    from riskloom.operators import joins as J
    rng = random.Random(5)
    rows = [dict(transaction_id=f"T{i:03d}", user_id="hot" if i % 2 else f"u{i % 7}",
                 timestamp=T0 + rng.randrange(0, 60) * H) for i in range(240)]
    rows += [dict(transaction_id="N0", user_id=None, timestamp=T0), dict(transaction_id="N1", user_id="hot", timestamp=None)]
    want = sorted((a["transaction_id"], b["transaction_id"]) for a in rows for b in rows
                  if a["user_id"] and a["user_id"] == b["user_id"] and a["timestamp"] and b["timestamp"]
                  and a["timestamp"] - 24 * H <= b["timestamp"] < a["timestamp"])
    got = J.history_interval_join(txn_rows(spark, rows), 24, cell_rows=cell)
    assert sorted((r.transaction_id, r.hist_transaction_id) for r in got.collect()) == want


def test_limit_of_50_and_history_of_100(spark):
    rows = [dict(transaction_id=f"T{i:03d}", user_id="U1", timestamp=T0 + i * US)
            for i in range(101)]
    df = txn_rows(spark, rows)
    lim = _by_id(W.rate_limit(df.where(F.col("transaction_id") < "T051"), limit=50,
                              window_seconds=60))
    assert sum(1 for r in lim.values() if not r.allowed) == 1 and not lim["T050"].allowed
    hist = _by_id(W.recent_history(df, 100))
    assert len(hist["T100"].recent_history) == 100
    assert hist["T100"].recent_history[0].transaction_id == "T000"


def test_two_scores_latest_wins(spark):
    from riskloom import schema as S
    from riskloom.operators.topk import latest_score
    s = spark.createDataFrame([("X", 0.2, "LOW", "APPROVE", 0.8, [], "v1", 1.0, T0),
                               ("X", 0.9, "CRITICAL", "DECLINE", 0.8, [], "v1", 1.0, T0 + H)],
                              S.SCORE)
    assert latest_score(s).first().fraud_score == 0.9
