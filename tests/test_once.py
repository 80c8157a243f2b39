"""What is read several times is computed once, and tasks stay bounded as rows grow."""
import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, T0, profile_rows, txn_rows
from riskloom.operators import learning as L
from riskloom.operators import sweep
from riskloom.operators import timeline as TL
from riskloom.operators import windows as W
from riskloom.operators.prefix import FREE_SHUFFLES, stored
from riskloom.plans import catalog
from riskloom.plans.features import build_features
from riskloom.streaming import jobs as ST


def _counted(spark, df, name):
    """``df`` with a column that counts in an accumulator how often its rows are computed."""
    seen = spark.sparkContext.accumulator(0)

    def tick(x):
        seen.add(1)
        return x
    return df.withColumn(name, F.udf(tick, df.schema[name].dataType)(name)), seen


def _labelled(spark, n=400):
    rows = [(f"T{i}", i % 4 == 0, float(i % 4 == 0) + (i * 37 % 101) / 90.0, float(i)) for i in range(n)]
    return spark.createDataFrame(rows, "transaction_id string, fraud boolean, a double, b double") \
        .select("transaction_id", F.col("fraud").cast("int").alias("label"), "a", "b")


def test_scaler_computes_its_rows_once(spark):
    df, seen = _counted(spark, _labelled(spark), "a")
    scaled, stats = L.standard_scale(df.select("transaction_id", "a", "b"), ["a", "b"])
    assert len(scaled.collect()) == 400 and seen.value == 400
    assert stats["b"][0] == pytest.approx(199.5)


@pytest.mark.parametrize("name, column", [
    ("latency_by_minute", "scored_at"), ("cache_hit_rate", "scored_at"), ("upsert_score_log", "scored_at"),
    ("commit_score_log", "scored_at"), ("active_model_metrics", "fraud_score")])
def test_query_scores_once(spark, monkeypatch, name, column):
    runs = []

    def score(features):
        df, seen = _counted(spark, plain(features), column)
        runs.append(seen)
        return df
    plain = catalog.score_features
    monkeypatch.setattr(catalog, "score_features", score)
    n = catalog.Ctx(spark, SF_SMALL).log.count()
    catalog.QUERIES[name](spark, SF_SMALL).collect()
    assert 0 < sum(s.value for s in runs) <= n


def test_model_computes_its_features_once(spark, monkeypatch):
    seen = []

    def build(*args, **kw):
        df, n = _counted(spark, plain(*args, **kw), "amount")
        seen.append(n)
        return df
    plain = catalog.build_features
    monkeypatch.setattr(catalog, "build_features", build)
    monkeypatch.setattr(L, "train_gbt", lambda d, *a, **kw: d.count())
    monkeypatch.setattr(L, "calibrate", lambda m, d: d.count())
    monkeypatch.setattr(catalog, "_MODELS", {})
    m = catalog._model(spark, SF_SMALL)
    n = catalog.Ctx(spark, SF_SMALL).log.count()
    assert m["model"] + m["calibrator"] + m["test"].count() == n
    assert sum(s.value for s in seen) == n


def test_training_runs_in_few_partitions(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier
    used = []
    fit = GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, d, *a: used.append(d.rdd.getNumPartitions()) or fit(self, d, *a))
    data = L.assemble(_labelled(spark), ["a", "b"])
    L.train_gbt(data.repartition(40), maxIter=2, maxDepth=2)
    cv = L.cross_validate(data, 2, "label", maxIter=2, maxDepth=2)
    assert len(used) == 3 and max(used) <= 2 * spark.sparkContext.defaultParallelism
    assert 0.5 < cv["roc_auc_mean"] <= 1.0
    assert L.training_partitions(36_000_000, 12) == 24 and L.training_partitions(10**9, 12) == 500


def test_ranks_shuffle_the_rows_once_and_keep_null_keys(spark):
    rows = [(f"T{i}", [None, 0, 1][i % 3], T0 + dt.timedelta(seconds=i) if i % 5 else None) for i in range(90)]
    df = spark.createDataFrame(rows, "transaction_id string, label int, timestamp timestamp").withColumn("wide", F.lit("w"))
    split = L.stratified_split(df.withColumn("wide", F.concat("wide", "transaction_id")), "label", 0.2)
    by = {r.label: (r.n, r.t) for r in split.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect()}
    assert by == {None: (30, 6), 0: (30, 6), 1: (30, 6)}
    chrono = L.chrono_split(df, 0.8)
    assert chrono.where("split = 'train'").count() == 72 and chrono.where("timestamp is null and split = 'train'").count() == 18
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = split._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # counts by bucket, their running sums, the sums by bucket, the rows
    assert plan.count("Exchange hashpartitioning") == 4, plan


def test_next_chunk_without_rows_gets_no_context(spark):
    log = txn_rows(spark, [dict(transaction_id=f"{u}{i:03d}", user_id=u, timestamp=T0 + dt.timedelta(minutes=i))
                           for u, n in (("a", 4), ("b", 5), ("c", 9)) for i in range(n)])
    placed = W.recent(TL.with_ts_us(log), [], rows=True)
    assert {(r.user_id, r._rows) for r in placed.collect()} == {("a", 4), ("b", 5), ("c", 9)}
    ctx = TL.chunk_context(placed, 4, 4, "_rows").where("_ctx").groupBy("user_id").count().collect()
    assert {(r.user_id, r["count"]) for r in ctx} == {("b", 4), ("c", 8)}
    got = {r.transaction_id: r._hist_n for r in W.user_windows(log, rows_cols=W.history_columns(2, 0, False), chunk=2).collect()}
    assert got == {f"{u}{i:03d}": min(i, 2) for u, n in (("a", 4), ("b", 5), ("c", 9)) for i in range(n)}


def test_chunks_are_several_files_of_one_batch(spark, tmp_path):
    # nearly all rows in the first chunk, one in the last
    at = [T0 + dt.timedelta(seconds=i) for i in range(200)] + [T0 + dt.timedelta(hours=9)]
    log = txn_rows(spark, [dict(transaction_id=f"T{i:03d}", user_id=f"u{i % 3}", timestamp=t) for i, t in enumerate(at)])
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    files = ST.write_time_chunks(log, src, "timestamp", 3, file_rows=15)
    assert files == 5 and ST._data_files(spark, src) == 15
    ST.write_closing_row(log, src, "timestamp")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(src)
    got = ST.run_to_table(spark, ST.stream_velocity(stream, 3600), out, ckpt)
    want = W.anchored_counter(log, 3600).select("user_id", "transaction_id", "window_start", "count_in_window")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def _shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [found.apply(i).getName() for i in range(found.size())]
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def _left(spark, before, most=0):
    """Number of shuffle files that weren't there before; the cleaner works by itself, so it gets some time."""
    until = time.time() + 20
    while (left := len(_shuffle_files(spark) - before)) > most and time.time() < until:
        time.sleep(0.2)
    return left


def test_stored_tables_leave_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    df = L.stratified_split(_labelled(spark).repartition(5, "b"), "label", 0.2)
    assert len(stored(df).collect()) == 400
    assert not _left(spark, before)
    assert len(df.collect()) == 400 and len(stored(df).collect()) == 400  # it may be written again
    assert spark.conf.get(FREE_SHUFFLES) == "false"


def test_scored_batches_leave_no_shuffle_files(spark, tmp_path):
    log = txn_rows(spark, [dict(transaction_id=f"T{i}", user_id=f"u{i % 3}", timestamp=T0 + dt.timedelta(minutes=i)) for i in range(60)])
    before = _shuffle_files(spark)
    for n in range(2):
        ST.score_batch(spark, log.where(F.minute("timestamp") % 2 == n), n, profile_rows(spark, []), str(tmp_path / "h"), str(tmp_path / "out"), buckets=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60
    # what is left are counts of users, ids and times: no rows with features
    assert _left(spark, before, 10) <= 10


def test_history_rows_end_with_the_windows(spark):
    log = txn_rows(spark, [dict(transaction_id=f"T{i:02d}", user_id=f"u{i % 3}", timestamp=T0 + dt.timedelta(minutes=7 * i), amount=float(i))
                           for i in range(40)])
    prof = profile_rows(spark, [dict(user_id="u1", home_country="US", avg_txn_amount=20.0, std_txn_amount=5.0, avg_monthly_txns=9)])
    late = F.col("transaction_id") >= "T30"
    every = build_features(log, prof).where(late)
    some = build_features(log.withColumn("_due", late), prof, only="_due")
    assert some.columns == every.columns
    assert sorted(map(str, some.collect())) == sorted(map(str, every.collect())) and some.count() == 10


def test_old_history_makes_no_events(spark):
    """Rows over a day before a user's due rows are in no range window: the same features from fewer events."""
    log = txn_rows(spark, [dict(transaction_id=f"T{i:02d}", user_id=f"u{i % 3}", timestamp=T0 + dt.timedelta(hours=2 * i), amount=float(i),
                                merchant_category=["grocery", "online"][i % 2], device_id=f"d{i % 5}") for i in range(40)])
    late = F.col("transaction_id") >= "T30"
    old = F.col("timestamp") < F.lit(T0 + dt.timedelta(hours=60 - 24))
    every = build_features(log, profile_rows(spark, [])).where(late)
    some = build_features(log.withColumn("_due", late).withColumn("_past", old), profile_rows(spark, []), only="_due", past="_past")
    assert sorted(map(str, some.collect())) == sorted(map(str, every.collect()))
    rows = TL.with_ts_us(log).select(F.col("user_id").alias("k"), F.col("_ts_us").alias("t"), F.lit(0).alias("r"), old.alias("q"),
                                     F.struct("transaction_id").alias("row"))
    assert sweep._events(rows, W.velocity_columns((1,), (), ())).count() == 40 + 22


def test_cells_are_fewer_than_the_events(spark):
    """What a cell inherits is shuffled three times, so the cells must be few beside the rows of a user."""
    log = txn_rows(spark, [dict(transaction_id=f"T{i}", user_id="u", timestamp=T0 + dt.timedelta(minutes=20 * i)) for i in range(216)])
    rows = TL.with_ts_us(log).select(F.lit("u").alias("k"), F.col("_ts_us").alias("t"), F.lit(0).alias("r"), F.lit(False).alias("q"),
                                     F.struct("transaction_id").alias("row"))
    events = sweep._events(rows, W.velocity_columns((1, 6, 24), (), (), ()))
    cells = sweep._celled(events).select("k", "_cell").distinct().count()
    assert events.count() == 4 * 216 and cells <= 4 * 4 + 1


def _trained(monkeypatch):
    """Settings of the fits that follow, which are made with two rounds."""
    used = []

    def train(d, *args, **kw):
        used.append(L.GBT_DEFAULTS | kw)
        return plain(d, *args, **kw | {"maxIter": 2, "maxDepth": 2})
    plain = L.train_gbt
    monkeypatch.setattr(L, "train_gbt", train)
    return used


def test_cross_validate_query_trains_all_rounds(spark, monkeypatch):
    used = _trained(monkeypatch)
    got = {r.metric: r.value for r in catalog.QUERIES["cross_validate"](spark, SF_SMALL).collect()}
    assert [u["maxIter"] for u in used] == [200] * 5 and got["folds"] == 5 and 0 <= got["roc_auc_mean"] <= 1


def test_train_pipeline_query_trains_all_rounds_of_all_folds(spark, monkeypatch):
    used = _trained(monkeypatch)
    got = {r.metric: r.value for r in catalog.QUERIES["train_pipeline"](spark, SF_SMALL).collect()}
    assert [u["maxIter"] for u in used] == [200] * 6 and got["cv.folds"] == 5 and 0 <= got["metrics.roc_auc"] <= 1


def test_folds_fitted_at_a_time_or_together_are_the_same(spark, monkeypatch):
    data = L.assemble(_labelled(spark), ["a", "b"]).persist()
    together = L.cross_validate(data, 3, "label", maxIter=2, maxDepth=2)
    monkeypatch.setattr(L, "PARTITION_ROWS", 500)
    assert L.cross_validate(data, 3, "label", maxIter=2, maxDepth=2) == together
    data.unpersist()
