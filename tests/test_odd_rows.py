"""Null keys, null times, ties and cancellation: window plans, counters, metrics, upserts."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import T0, txn_rows
from riskloom.operators import evaluation as E
from riskloom.operators import sweep
from riskloom.operators import windows as W
from riskloom.operators.prefix import running_totals

H = dt.timedelta(hours=1)
M = dt.timedelta(minutes=1)


def _rows():
    rows = [dict(transaction_id=f"T{i:02d}", user_id="U1" if i % 4 else "U2", timestamp=T0 + (i // 2) * 7 * H,
                 amount=float(i), merchant_category=None if i % 5 == 0 else f"m{i % 3}") for i in range(30)]
    return rows + [dict(transaction_id="N1", user_id="U1", timestamp=None), dict(transaction_id="N2", user_id=None, timestamp=T0),
                   dict(transaction_id="N3", user_id=None, timestamp=T0 + H), dict(transaction_id="N4", user_id=None, timestamp=None)]


def _past(rows, r, hours, lower):
    t = r["timestamp"]
    return [x for x in rows if t and x["timestamp"] and x["user_id"] == r["user_id"] and lower(x["timestamp"], t - hours * H)]


@pytest.mark.parametrize("cell, chunk", [(10 ** 16, 6000), (3_600_000_000, 2), (11 * 3_600_000_000, 3)])
def test_windows_equal_brute_force_on_odd_rows(spark, monkeypatch, cell, chunk):
    """Nulls and ties, users over one and many cells, values that come again inside and outside a window."""
    rows = [dict(dict(amount=10.0, merchant_category="grocery", country="US", device_id="d1"), **r) for r in _rows()]
    rows += [dict(transaction_id=f"D{i:02d}", user_id="U3", timestamp=T0 + i * 5 * H, amount=0.1, merchant_category="m", country=None,
                  device_id=None if i % 3 else f"d{i % 2}") for i in range(25)]
    log = txn_rows(spark, rows).repartition(7)
    monkeypatch.setattr(sweep, "CELL", cell)
    spans = W.velocity_columns((1, 24, 48), (48,), (24, 48), (24,))
    got = {r.transaction_id: r for r in W.user_windows(log, spans, W.history_columns(2, 2, True, 2), chunk=chunk).collect()}
    tied = {r.transaction_id: r for r in W.velocity_batch(log).collect()}
    assert len(got) == len(tied) == len(rows)
    low = dt.datetime(1, 1, 1)
    for r in rows:
        g, t = got[r["transaction_id"]], r["timestamp"]
        for h in (1, 24, 48):
            past = [x for x in _past(rows, r, h, lambda a, b: a >= b) if x["timestamp"] < t]
            assert g[f"txn_count_{h}h"] == len(past)
            if h > 1:
                assert g[f"unique_merchants_{h}h"] == len({x["merchant_category"] for x in past})
                assert g[f"unique_countries_{h}h"] == len({x["country"] for x in past})
        assert g.amount_sum_48h == pytest.approx(sum(x["amount"] for x in past), abs=1e-9)
        now = [x for x in _past(rows, r, 24, lambda a, b: a >= b) if x["timestamp"] <= t]
        assert g.devices_used_24h == max(1, len({x["device_id"] for x in now} - {None}))
        order = sorted((x for x in rows if x["user_id"] == r["user_id"]), key=lambda x: (x["timestamp"] or low, x["transaction_id"]))
        at = [x["transaction_id"] for x in order].index(r["transaction_id"])
        assert g._row == at and [x.transaction_id for x in g.recent_history] == [x["transaction_id"] for x in order[max(at - 2, 0):at]]
        before = [x for x in order[:at] if x["timestamp"]] if t else []
        past = [x for x in before if x["timestamp"] > t - 24 * H]
        b = tied[r["transaction_id"]]
        assert (b.txn_count_24h, b.unique_merchants_24h, b.unique_countries_24h) == (
            len(past), len({x["merchant_category"] for x in past}), len({x["country"] for x in past}))
        assert b.txn_amount_24h == pytest.approx(sum(x["amount"] for x in past), abs=1e-9)
        assert b.time_since_last_txn == ((t - before[-1]["timestamp"]) / H if before else 0.0)


@pytest.mark.parametrize("hot", [5, None])
def test_hot_counters_equal_plain_ones_on_odd_rows(spark, hot):
    log = txn_rows(spark, _rows())
    for limit in (None, 2):
        a, b = W.anchored_counter(log, 7 * 3600, limit), W.anchored_counter(log, 7 * 3600, limit, hot_threshold=hot)
        assert a.count() == log.count() and a.exceptAll(b).count() == 0


def test_a_busy_user_is_linear(spark):
    """One user with 200,000 rows in a day."""
    import time
    n = 200_000
    log = spark.range(n, numPartitions=8).selectExpr(
        "concat('T', lpad(id, 6, '0')) transaction_id", "'U' user_id", f"timestamp_micros({1_700_000_000_000_000} + id * 432000) timestamp",
        "cast(id % 7 as double) amount", "concat('m', id % 13) merchant_category", "concat('c', id % 5) country",
        "concat('d', id % 50000) device_id")
    began = time.time()
    out = W.velocity_features(log).agg(F.sum("txn_count_24h"), F.max("txn_count_1h"), F.max("unique_merchants_24h"), F.max("devices_used_24h")).first()
    assert tuple(out) == (n * (n - 1) // 2, 3600 * 1_000_000 // 432_000, 13, 50_000)
    assert time.time() - began < 60


def test_batch_velocity_null_amount_and_no_cancellation(spark):
    rows = [dict(transaction_id=f"A{i}", user_id="U1", timestamp=T0 + i * M, amount=0.1) for i in range(3)]
    rows += [dict(transaction_id="B0", user_id="U1", timestamp=T0 + 10 * M, amount=1e17),
             dict(transaction_id="B1", user_id="U1", timestamp=T0 + 10 * M, amount=None),
             dict(transaction_id="B2", user_id="U1", timestamp=T0 + 10 * M, amount=5.0)]
    r = {x.transaction_id: x for x in W.velocity_batch(txn_rows(spark, rows)).collect()}
    assert r["B0"].txn_amount_24h == pytest.approx(0.3) and r["B0"].txn_count_24h == 3
    assert r["B1"].txn_count_24h == 4 and r["B1"].txn_amount_24h == pytest.approx(1e17)
    assert r["B2"].txn_count_24h == 5 and r["B2"].time_since_last_txn == 0.0


def _folded(times, window):
    out, anchor, n = [], None, 0
    for t in times:
        if anchor is None or t > anchor + window:
            anchor, n = t, 0
        n += 1
        out.append((anchor, n))
    return out


@pytest.mark.parametrize("hot", [250_000, None])
def test_long_segments_follow_their_chain(spark, hot):
    import random
    rng = random.Random(7)
    at = sorted(rng.randrange(0, 4000) for _ in range(150))
    rows = [dict(transaction_id=f"E{i:03d}", user_id="U1", timestamp=T0 + dt.timedelta(seconds=s)) for i, s in enumerate(at)]
    got = {r.transaction_id: r for r in W.anchored_counter(txn_rows(spark, rows), 100, hot_threshold=hot).collect()}
    for i, (anchor, n) in enumerate(_folded(at, 100)):
        r = got[f"E{i:03d}"]
        assert (r.window_start, r.count_in_window) == (T0 + dt.timedelta(seconds=anchor), n)


def test_limit_zero_allows_the_first_and_null_times_have_no_window(spark):
    rows = [dict(transaction_id="A", user_id="U1", timestamp=T0), dict(transaction_id="B", user_id="U1", timestamp=T0 + M),
            dict(transaction_id="C", user_id="U1", timestamp=None)]
    r = {x.transaction_id: x for x in W.rate_limit(txn_rows(spark, rows), 0, 3600).collect()}
    assert (r["A"].allowed, r["B"].allowed, r["C"].allowed) == (True, False, None)
    assert r["C"].window_start is None and r["C"].count_in_window is None


def test_metrics_use_raw_scores(spark):
    rows = [(0.39996, 1), (0.4, 1), (0.40004, 0), (0.2, 0), (0.90001, 1), (0.90002, 0), (0.5, 1)]
    df = spark.createDataFrame(rows, "score double, label int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert E.roc_auc(df).first()[0] == pytest.approx(auc)
    best = E.best_threshold(df).first()
    c = E.confusion(df, best.threshold).first()
    assert c.tp / (c.tp + c.fn) == pytest.approx(best.recall)
    assert E.pr_curve(df).count() == 7


def test_running_totals_with_null_keys(spark):
    rows = [(k, i % 7, i) for i in range(90) for k in ("a", None)]
    got = running_totals(spark.createDataFrame(rows, "k string, o int, v int").repartition(4), ["k"], ["o", "v"], {"s": "v"}).collect()
    assert len(got) == len(rows)
    for k in ("a", None):
        total = 0
        for r in sorted((r for r in got if r.k == k), key=lambda r: (r.o, r.v)):
            assert r.s == total
            total += r.v


def _scores(spark, rows):
    return spark.createDataFrame(rows, "transaction_id string, fraud_score double, scored_at timestamp")


def test_upsert_replaces_by_id(spark, tmp_path):
    from riskloom.sources.sinks import upsert_score_log
    path, day = str(tmp_path / "log"), dt.timedelta(days=1)
    read = lambda: sorted((r.transaction_id, r.fraud_score) for r in spark.read.parquet(path).collect())
    upsert_score_log(spark, _scores(spark, [("a", 0.1, T0), ("b", 0.2, T0), ("c", 0.3, T0 + 5 * day)]), path)
    upsert_score_log(spark, _scores(spark, [("a", 0.5, T0 + day), ("d", 0.1, T0 + day), ("d", 0.9, T0 + day + M)]), path)
    assert read() == [("a", 0.5), ("b", 0.2), ("c", 0.3), ("d", 0.9)]
    upsert_score_log(spark, _scores(spark, [("c", 0.4, T0)]), path)   # its old day holds no row any more
    assert read() == [("a", 0.5), ("b", 0.2), ("c", 0.4), ("d", 0.9)]


def test_upsert_raises_on_a_failed_read(spark, tmp_path):
    from riskloom.sources.sinks import upsert_score_log
    path = tmp_path / "log" / "score_date=2024-01-15"
    path.mkdir(parents=True)
    (path / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        upsert_score_log(spark, _scores(spark, [("a", 0.1, T0)]), str(tmp_path / "log"))
    assert (path / "part-0.parquet").read_bytes() == b"not parquet"


def test_splits_keep_rows_with_nulls(spark):
    from riskloom.operators import learning as L
    log = txn_rows(spark, _rows()).withColumn("is_fraud", F.when(F.col("transaction_id") != "T01", F.lit(0)))
    for split in (L.chrono_split(log), L.stratified_split(log), L.stratified_folds(log)):
        assert split.count() == log.count()


def test_cluster_needs_a_shared_checkpoint_folder():
    from types import SimpleNamespace

    from riskloom.session import checkpoint_dir
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=lambda d: None)
    with pytest.raises(ValueError):
        checkpoint_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))
