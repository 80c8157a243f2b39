"""Streams (availableNow over time-ordered Parquet files) equal their batch twins."""
import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from riskloom.operators import windows as W
from riskloom.plans import catalog
from riskloom.session import checkpoint_dir
from riskloom.streaming import jobs as ST


def _dirs(spark, name):
    base = f"{checkpoint_dir(spark)}/test-{name}-{uuid.uuid4().hex[:8]}"
    return {k: f"{base}/{k}" for k in ("src", "out", "ckpt", "hist")}


def _stream(spark, df, d, ts="timestamp", close=False):
    ST.write_time_chunks(df, d["src"], ts, 3)
    if close:
        ST.write_closing_row(df, d["src"], ts)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(d["src"])


def _same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_stream_counters_equal_batch(spark):
    log = catalog.Ctx(spark, SF_SMALL).log
    d = _dirs(spark, "vel")
    s = ST.run_to_table(spark, ST.stream_velocity(_stream(spark, log, d, close=True), 3600), d["out"], d["ckpt"])
    b = W.anchored_counter(log, 3600)
    assert _same(s.select("user_id", "transaction_id", "window_start", "count_in_window"), b)
    d = _dirs(spark, "rl")
    s = ST.run_to_table(spark, ST.stream_rate_limit(_stream(spark, log, d, close=True), 2, 86400),
                        d["out"], d["ckpt"])
    assert _same(s, W.rate_limit(log, 2, 86400).select(*s.columns))


def test_counters_on_rows_out_of_order(spark):
    """Rows shuffled within the watermark give what the batch gives."""
    from conftest import T0, txn_rows
    s = dt.timedelta(seconds=1)
    at = [300, 0, 390, 120, 600, 480, 900, 770, 1300, 1290]
    rows = [dict(transaction_id=f"E{i}", user_id="U1", timestamp=T0 + x * s) for i, x in enumerate(at)]
    log = txn_rows(spark, rows)
    for limit in (None, 0, 1, 2):
        d = _dirs(spark, "ooo")
        for r in rows:  # one micro-batch each
            txn_rows(spark, [r]).coalesce(1).write.mode("append").parquet(d["src"])
        ST.write_closing_row(log, d["src"], "timestamp")
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(d["src"])
        out = ST.run_to_table(spark, ST.stream_velocity(stream, 120, limit), d["out"], d["ckpt"])
        batch = W.anchored_counter(log, 120, limit)
        assert _same(batch, out) and batch.count() == len(rows), limit


def test_stream_rejects_and_ttl(spark):
    from conftest import T0, profile_rows, txn_rows
    d = _dirs(spark, "ttl")
    day = dt.timedelta(days=1)
    rows = [dict(transaction_id="A", user_id="U1", timestamp=T0),
            dict(transaction_id="A", user_id="U1", timestamp=T0 + dt.timedelta(seconds=300)),  # still live
            dict(transaction_id="B", user_id=None, timestamp=T0 + day),                        # rejected
            dict(transaction_id="A", user_id="U1", timestamp=T0 + 2 * day)]                    # TTL over
    for r in rows:
        txn_rows(spark, [r]).coalesce(1).write.mode("append").parquet(d["src"])
    stream = spark.readStream.schema(txn_rows(spark, rows).schema).option("maxFilesPerTrigger", 1).parquet(d["src"])
    ST.stream_score(spark, stream, profile_rows(spark, []), d["hist"], d["out"], d["ckpt"]).awaitTermination()
    got = sorted((r.transaction_id, r.timestamp, r.risk_level, r.decision) for r in spark.read.parquet(d["out"]).collect())
    assert [(g[0], g[1]) for g in got] == [("A", T0), ("A", T0 + 2 * day), ("B", T0 + day)]
    assert got[2][2:] == ("UNKNOWN", "REVIEW")


@pytest.mark.parametrize("cuts", [1, 4, 12])
def test_scores_do_not_depend_on_the_cuts(spark, cuts):
    """Repeats inside and across batches; every row scored once the TTL is over, with the same features; old state goes."""
    from conftest import T0, profile_rows, txn_rows
    s = dt.timedelta(seconds=1)
    rows = [dict(transaction_id=f"R{i % 20 // 2}", user_id=f"U{i % 3}", timestamp=T0 + i * 97 * s, amount=float(i + 1),
                 merchant_category=("grocery", "crypto_exchange")[i % 2]) for i in range(80)]
    d = _dirs(spark, f"cuts{cuts}")
    each = -(-len(rows) // cuts)
    for n, at in enumerate(range(0, len(rows), each)):
        ST.score_batch(spark, txn_rows(spark, rows[at:at + each]), n, profile_rows(spark, []), d["hist"], d["out"], buckets=3)
    last, due = {}, []
    for r in rows:
        i, t = r["transaction_id"], r["timestamp"]
        if i not in last or t > last[i] + 300 * s:
            last[i] = t
            due.append(r)
    assert 0 < len(due) < len(rows) and len({r["transaction_id"] for r in due}) < len(due)
    from riskloom.plans.features import build_features, score_features
    want = score_features(build_features(txn_rows(spark, due), profile_rows(spark, [])))
    columns = ["transaction_id", "timestamp", "fraud_score", "risk_level", "txn_count_24h", "amount_sum_24h", "merchant_diversity_score"]
    got = spark.read.parquet(d["out"])
    assert got.count() == len(due) and _same(want.select(*columns), got.select(*columns))
    assert all(len(ST._versions(spark, d["hist"] + "/rows", b)) <= 2 for b in range(3))
    # a batch that runs again changes nothing
    n = -(-len(rows) // each) - 1
    ST.score_batch(spark, txn_rows(spark, rows[n * each:]), n, profile_rows(spark, []), d["hist"], d["out"], buckets=3)
    assert _same(want.select(*columns), spark.read.parquet(d["out"]).select(*columns))


def test_state_is_bounded(spark, monkeypatch):
    from conftest import T0, txn_rows
    monkeypatch.setattr(ST, "HISTORY_ROWS", 5)
    rows = [dict(transaction_id=f"R{u}{i:03d}", user_id=f"U{u}", timestamp=T0 + i * dt.timedelta(hours=(12, 1)[u])) for u in (0, 1) for i in range(40)]
    kept = ST._recent_state(txn_rows(spark, rows)).groupBy("user_id").count().collect()
    assert {r.user_id: r["count"] for r in kept} == {"U0": 5, "U1": 25}


def test_stream_dedupe_and_late_rows(spark):
    log = catalog.Ctx(spark, SF_SMALL).log
    rep = log.limit(100).withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 MINUTE"))
    d = _dirs(spark, "dd")
    out = ST.run_to_table(spark, ST.stream_dedupe(_stream(spark, log.unionByName(rep), d)),
                          d["out"], d["ckpt"])
    assert out.count() == log.count()
    # a row far older than the watermark arriving last is dropped
    late = log.limit(1).withColumn("transaction_id", F.lit("LATE")) \
        .withColumn("timestamp", F.lit(dt.datetime(2023, 1, 1)))
    late.write.mode("append").parquet(d["src"])
    q = (ST.stream_dedupe(spark.readStream.schema(log.schema).parquet(d["src"]))
         .writeStream.format("parquet").option("path", d["out"])
         .option("checkpointLocation", d["ckpt"]).trigger(availableNow=True).start())
    q.awaitTermination()
    res = spark.read.parquet(d["out"])
    assert res.where(F.col("transaction_id") == "LATE").count() == 0
    assert res.count() == log.count()          # restart from checkpoint: nothing repeated


def test_stream_score_equals_batch(spark):
    c = catalog.Ctx(spark, SF_SMALL)
    d = _dirs(spark, "score")
    q = ST.stream_score(spark, _stream(spark, c.log, d), c.profiles, d["hist"], d["out"], d["ckpt"])
    q.awaitTermination()
    s = spark.read.parquet(d["out"]).select("transaction_id", "fraud_score", "risk_level")
    b = c.scored.select("transaction_id", "fraud_score", "risk_level")
    assert _same(s, b)


def test_stream_recent_matches_brute_force(spark):
    log = catalog.Ctx(spark, SF_SMALL).log
    d = _dirs(spark, "recent")
    s = ST.run_to_table(spark, ST.stream_recent(_stream(spark, log, d, close=True)), d["out"], d["ckpt"])
    got = {r.transaction_id: (r.history_size, r.oldest_id, r.newest_id) for r in s.collect()}
    rows = sorted(log.select("user_id", "transaction_id", "timestamp").collect(),
                  key=lambda r: (r.user_id, r.timestamp, r.transaction_id))
    items, last, user = [], None, None
    for r in rows:
        if r.user_id != user:
            items, last, user = [], None, r.user_id
        if last is not None and r.timestamp > last + dt.timedelta(seconds=3600):
            items = []
        exp = (len(items), items[0] if items else None, items[-1] if items else None)
        assert got[r.transaction_id] == exp
        items = (items + [r.transaction_id])[-100:]
        last = r.timestamp


def test_stream_hourly_counts_equal_batch(spark):
    out = catalog.QUERIES["stream_hourly"](spark, SF_SMALL).where(
        F.col("total_transactions") > 0)
    from riskloom.operators.aggregates import hourly_rollup
    b = hourly_rollup(catalog.Ctx(spark, SF_SMALL).scored).select("hour_bucket", "total_transactions",
                                                                   "fraud_count")
    s = out.where(F.col("hour_bucket") < F.lit("2025-01-01")).select(
        "hour_bucket", "total_transactions", "fraud_count")
    assert _same(s, b)
