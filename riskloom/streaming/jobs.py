"""Structured Streaming twins of the batch operators (ST1-ST8).

The reference scores request by request with keyed TTL state. Here a stream of transactions
(any file or message source with the transaction schema) runs through the same operators:

* ST1 ``stream_score``: ``foreachBatch`` job. Each micro-batch is validated (F1), joined to the profiles
  (stream-static), featurised together with the kept history of the batch's users, rule-scored and appended to the score
  log. An id is scored again once the TTL of its last scoring is over, whether the repeat comes in the same batch or
  a later one; requests that fail validation get the fallback record. The history is a state table: of every user
  the last HISTORY_ROWS rows and the last HISTORY_HOURS hours, which is all that a feature looks back on. A batch
  reads the user buckets it touches and writes them anew under its own number, so its cost doesn't grow with the log;
  a replayed batch reads the state before it and replaces its own output.
* ST2 ``stream_dedupe``: ``dropDuplicatesWithinWatermark`` on the transaction id.
* ST3 / ST8: watermarked event-time windows (append mode), ``percentile_approx``.
* ST4-ST6: ``applyInPandasWithState`` per user with event-time timeouts as TTL; events wait in
  the state until the watermark has passed them and are folded in time order.
* ST7: stateless filter.

Late data policy (ours; the reference has none): watermark 10 minutes, later rows dropped.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import schema as S
from riskloom.operators.prefix import shuffles_freed

WATERMARK = "10 minutes"

# ---------------------------------------------------------------------------------------------
# ST1
# ---------------------------------------------------------------------------------------------


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


#: What is kept of a user; buckets of the state tables; how long an id is remembered beyond its TTL (rows that come
#: later out of order are scored again).
HISTORY_ROWS, HISTORY_HOURS, BUCKETS, LATE = 100, 24, 64, "1 day"


def _versions(spark: SparkSession, path: str, bucket: int) -> list[int]:
    """Numbers of the batches that wrote the bucket."""
    at = f"{path}/bucket={bucket}"
    if not _exists(spark, at):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(at)
    names = [f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def _state(spark: SparkSession, path: str, buckets: list[int], batch_id: int, schema: T.StructType) -> DataFrame:
    """The buckets as the batches before ``batch_id`` left them."""
    newest = {b: [v for v in _versions(spark, path, b) if v < batch_id][-1:] for b in buckets}
    paths = [f"{path}/bucket={b}/batch={v}" for b, vs in newest.items() for v in vs]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _keep_state(spark: SparkSession, rows: DataFrame, path: str, buckets: list[int], batch_id: int, bucket) -> None:
    """Writes the buckets as of this batch; versions older than the one it read go."""
    with shuffles_freed(rows.sparkSession):
        (rows.withColumn("bucket", bucket).withColumn("batch", F.lit(batch_id)).repartition("bucket")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path))
    for b in buckets:
        for v in [v for v in _versions(spark, path, b) if v < batch_id][:-1]:
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}/batch={v}")
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _touched(rows: DataFrame, bucket) -> list[int]:
    return [r.b for r in rows.select(bucket.alias("b")).distinct().collect()]  # BUCKETS at most


def _due(requests: DataFrame, seen: DataFrame, ttl_seconds: int) -> DataFrame:
    """The requests that are scored: later than the TTL after the id's last scoring (``seen``), and within the batch
    not within the TTL of an earlier one that is. Of requests of one id and time one is, by the rest of its columns."""
    from riskloom.operators.windows import anchored_counter
    key = F.struct("transaction_id", F.unix_micros("timestamp"), F.xxhash64(*requests.columns))
    ttl = F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS")
    past = seen.select("transaction_id", F.col("timestamp").alias("_last"))
    open_ = (requests.join(past, "transaction_id", "left")
             .where(F.col("_last").isNull() | F.col("timestamp").isNull() | (F.col("timestamp") > F.col("_last") + ttl))
             .drop("_last").withColumn("_key", F.to_json(key)).dropDuplicates(["_key"]))
    many = open_.groupBy("transaction_id").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    again = open_.join(many, "transaction_id", "left_semi")
    if not again.limit(1).count():
        return open_.drop("_key")
    counted = anchored_counter(again, ttl_seconds, key="transaction_id", id_col="_key")
    later = counted.where("count_in_window > 1").select("_key")
    return open_.join(later, "_key", "left_anti").drop("_key")


def _recent_state(rows: DataFrame) -> DataFrame:
    """What is kept of the users' rows: back to the earlier of the HISTORY_ROWS-th last row and HISTORY_HOURS before the last.
    Rows without a time leave no history."""
    order = Window.partitionBy("user_id").orderBy(F.desc("timestamp"), F.desc("transaction_id"))
    last = (rows.where("timestamp is not null").withColumn("_rn", F.row_number().over(order))
            .where(F.col("_rn") <= HISTORY_ROWS).groupBy("user_id")
            .agg(F.min("timestamp").alias("_first"), F.max("timestamp").alias("_newest")))
    since = F.least("_first", F.col("_newest") - F.expr(f"INTERVAL {HISTORY_HOURS} HOURS"))
    return rows.join(last.select("user_id", since.alias("_since")), "user_id").where("timestamp >= _since").drop("_since")


def score_batch(spark: SparkSession, batch: DataFrame, batch_id: int, profiles: DataFrame,
                history_path: str, scores_path: str, buckets: int = BUCKETS) -> None:
    """One micro-batch of ST1 (also usable as a batch job on any slice of the log)."""
    from riskloom.functions import scoring as SC
    from riskloom.operators.filters import validate_requests
    from riskloom.operators.prefix import stored
    from riskloom.plans.features import build_features, score_features

    ok, bad = validate_requests(batch)
    by_user = F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")
    by_id = F.pmod(F.xxhash64("transaction_id"), F.lit(buckets)).cast("int")
    rows_path, ids_path = f"{history_path}/rows", f"{history_path}/ids"
    ids = _touched(ok, by_id)
    seen = _state(spark, ids_path, ids, batch_id, ok.select("transaction_id", "timestamp").schema)
    due = stored(_due(ok, seen, S.SCORE_TTL_SECONDS), "due")
    users = _touched(due, by_user)
    kept = _state(spark, rows_path, users, batch_id, due.schema)
    # rows without an id are history only; what lies over a day before a user's rows of the batch is in none of their range windows
    first = due.groupBy("user_id").agg(F.min("timestamp").alias("_first"))
    past = F.coalesce(F.col("timestamp") < F.col("_first") - F.expr(f"INTERVAL {HISTORY_HOURS} HOURS"), F.lit(False))
    mine = kept.join(first, "user_id").withColumns({"_due": F.lit(False), "_past": past}).drop("_first")
    rows = due.withColumns({"_due": F.col("transaction_id").isNotNull(), "_past": F.lit(False)}).unionByName(mine)
    scored = score_features(build_features(rows, profiles, only="_due", past="_past"))
    # a request that can't be scored gets the fallback record
    lat = F.col("latency_ms") if "latency_ms" in bad.columns else F.lit(0.0)
    at = F.timestamp_micros(F.unix_micros("timestamp") + (lat * 1000).cast("long"))
    failed = bad.select("transaction_id", "user_id", "timestamp", *SC.score_record(
        F.lit(None).cast("double"), F.lit(0.8), F.array().cast("array<string>"), F.lit(S.RULE_MODEL_VERSION), at, lat))
    scored = scored.unionByName(failed, allowMissingColumns=True)
    with shuffles_freed(scored.sparkSession):
        (scored.withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(scores_path))
    _keep_state(spark, _recent_state(kept.unionByName(due)), rows_path, users, batch_id, by_user)
    last = seen.unionByName(due.select(*seen.columns)).where("timestamp is not null").groupBy("transaction_id").agg(
        F.max("timestamp").alias("timestamp"))
    newest = due.agg(F.max("timestamp")).scalar()
    fresh = last.where(newest.isNull() | (F.col("timestamp") + F.expr(f"INTERVAL {S.SCORE_TTL_SECONDS} SECONDS") + F.expr(f"INTERVAL {LATE}") >= newest))
    _keep_state(spark, fresh, ids_path, ids, batch_id, by_id)


def stream_score(spark: SparkSession, stream: DataFrame, profiles: DataFrame, history_path: str,
                 scores_path: str, checkpoint: str, trigger: dict | None = None):
    """ST1: start the scoring stream; returns the StreamingQuery."""
    def run(batch_df: DataFrame, batch_id: int) -> None:
        b = batch_df.persist()
        try:
            score_batch(spark, b, batch_id, profiles, history_path, scores_path)
        finally:
            b.unpersist()
    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


# ---------------------------------------------------------------------------------------------
# ST2, ST3, ST7, ST8
# ---------------------------------------------------------------------------------------------

def stream_dedupe(stream: DataFrame, ttl_seconds: int = S.SCORE_TTL_SECONDS,
                  ts: str = "timestamp") -> DataFrame:
    """ST2: a transaction id seen again within the TTL is dropped. The watermark guarantees at
    least ``ttl_seconds``; repeats after that may also be dropped until the state expires."""
    return (stream.withWatermark(ts, f"{int(ttl_seconds)} seconds")
            .dropDuplicatesWithinWatermark(["transaction_id"]))


def stream_hourly(scored: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """ST3: A3 per event-time hour of ``scored_at``; emitted when the watermark passes."""
    fraud = F.col("fraud_score") > S.FRAUD_SCORE_CUT
    g = scored.withWatermark("scored_at", watermark).groupBy(F.window("scored_at", "1 hour"))
    return g.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(fraud).alias("fraud_count"),
        F.count_if(F.col("decision") == "DECLINE").alias("declined_count"),
        F.count_if(F.col("decision") == "REVIEW").alias("review_count"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_amount"),
        F.coalesce(F.sum(F.when(fraud, F.col("amount"))), F.lit(0.0)).alias("fraud_amount"),
        F.avg("fraud_score").alias("avg_score"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.percentile_approx("latency_ms", [0.5, 0.95, 0.99], 10000).alias("_p"),
    ).select(F.col("window.start").alias("hour_bucket"), "total_transactions", "fraud_count",
             "declined_count", "review_count", "total_amount", "fraud_amount", "avg_score",
             "avg_latency_ms", F.col("_p")[0].alias("p50_latency_ms"),
             F.col("_p")[1].alias("p95_latency_ms"), F.col("_p")[2].alias("p99_latency_ms"))


def stream_alerts(scored: DataFrame, velocity_threshold: float = 3.0) -> DataFrame:
    """ST7: T5's alert conditions as rows arrive (stateless)."""
    from riskloom.operators.topk import ALERT_MESSAGES
    hr = (F.col("is_new_device") > 0) & (F.col("fraud_score") >= S.THRESHOLD_MEDIUM)
    vel = F.col("velocity_score") >= velocity_threshold
    types = F.filter(F.array(F.when(hr, F.lit("high_risk")), F.when(vel, F.lit("velocity"))),
                     lambda x: x.isNotNull())
    a = scored.where(hr | vel).select(F.explode(types).alias("alert_type"), "transaction_id",
                                      "user_id", "scored_at")
    msg = F.when(F.col("alert_type") == "high_risk", F.lit(ALERT_MESSAGES["high_risk"])) \
        .otherwise(F.lit(ALERT_MESSAGES["velocity"]))
    return a.withColumn("message", msg)


def stream_latency(scored: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """ST8: latency percentiles per event-time minute."""
    g = scored.withWatermark("scored_at", watermark).groupBy(F.window("scored_at", "1 minute"))
    return g.agg(F.percentile_approx("latency_ms", [0.5, 0.95, 0.99], 10000).alias("_p"),
                 F.count(F.lit(1)).alias("requests")) \
        .select(F.col("window.start").alias("minute"), "requests",
                F.col("_p")[0].alias("p50_latency_ms"), F.col("_p")[1].alias("p95_latency_ms"),
                F.col("_p")[2].alias("p99_latency_ms"))


def stream_latency_sketches(scored: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """ST8/ST3: a mergeable latency sketch per event-time minute, to be rolled up to any longer bucket."""
    from riskloom.operators.sketches import by_bucket
    return by_bucket(scored.withWatermark("scored_at", watermark), F.window("scored_at", "1 minute")) \
        .select(F.col("bucket.start").alias("bucket"), "n", "sketch")


# ---------------------------------------------------------------------------------------------
# ST4-ST6: keyed state with TTL (applyInPandasWithState, event-time timeouts)
# ---------------------------------------------------------------------------------------------

COUNTER_OUT = T.StructType([
    T.StructField("user_id", T.StringType()), T.StructField("transaction_id", T.StringType()),
    T.StructField("window_start", T.TimestampType()),
    T.StructField("count_in_window", T.LongType()), T.StructField("allowed", T.BooleanType()),
])
#: State of a key: what the fold carries, and events that wait for the watermark (both JSON).
ORDERED_STATE = T.StructType([T.StructField("carry", T.StringType()), T.StructField("waiting", T.StringType())])


def _ordered_fn(fold, columns: list[str], ttl_us):
    """A keyed fold in event-time order. Events wait in the state until the watermark has passed
    them, so rows that arrive out of order within the watermark are folded in (time, id) order;
    the number waiting is bounded by a key's events within the watermark delay. ``fold(carry, t,
    id)`` gives the new carry and an output row; the key expires ``ttl_us(carry)`` microseconds
    of event time after what it carries."""
    def fn(key, pdfs, state):
        import pandas as pd
        carry, waiting = None, []
        if state.exists:
            carry, waiting = json.loads(state.get[0]), json.loads(state.get[1])
        if not state.hasTimedOut:
            for p in pdfs:
                waiting += [[int(t), i] for t, i in zip(p["_t"].to_numpy(), p["transaction_id"].to_numpy())]
        mark = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda w: (w[0], str(w[1])))
        ready = [w for w in waiting if w[0] <= mark]
        waiting = waiting[len(ready):]
        rows = []
        for t, i in ready:
            carry, row = fold(carry, t, i)
            rows.append((key[0], i, *row))
        ends = [w[0] for w in waiting[:1]] or ([ttl_us(carry)] if carry is not None else [])
        if ends and (waiting or ends[0] > mark):
            state.update((json.dumps(carry), json.dumps(waiting)))
            state.setTimeoutTimestamp(max(ends[0], mark) // 1000 + 1)
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame(rows, columns=columns)
    return fn


def _counter_fn(window_us: int, limit: int | None):
    most = None if limit is None else max(int(limit), 1)

    def fold(carry, t, _):
        anchor, n = carry or (None, 0)
        anchor, n = (t, 1) if anchor is None or t > anchor + window_us else (anchor, n + 1)
        ok = most is None or n <= most
        n = n if most is None else min(n, most + 1)
        return [anchor, n], (_stamp(anchor), n if ok else most, ok)
    return _ordered_fn(fold, [f.name for f in COUNTER_OUT.fields], lambda c: c[0] + window_us)


def _stamp(us: int):
    import pandas as pd
    return pd.Timestamp(us, unit="us")


def stream_velocity(stream: DataFrame, window_seconds: int = 3600,
                    limit: int | None = None, watermark: str = WATERMARK) -> DataFrame:
    """ST5 (ST6 with ``limit``): anchored counters per user as events arrive."""
    from pyspark.sql.streaming.state import GroupStateTimeout
    d = stream.withWatermark("timestamp", watermark) \
        .select("user_id", "transaction_id", "timestamp",
                F.unix_micros("timestamp").alias("_t"))
    return d.groupBy("user_id").applyInPandasWithState(
        _counter_fn(int(window_seconds) * 1_000_000, limit), COUNTER_OUT, ORDERED_STATE,
        "append", GroupStateTimeout.EventTimeTimeout)


def stream_rate_limit(stream: DataFrame, limit: int = S.RATE_LIMIT_REQUESTS,
                      window_seconds: int = S.RATE_LIMIT_WINDOW_SECONDS,
                      watermark: str = WATERMARK) -> DataFrame:
    """ST6: allowed while the window's count is below ``limit``; denied events do not count."""
    return stream_velocity(stream, window_seconds, limit, watermark)


RECENT_OUT = T.StructType([
    T.StructField("user_id", T.StringType()), T.StructField("transaction_id", T.StringType()),
    T.StructField("history_size", T.LongType()), T.StructField("oldest_id", T.StringType()),
    T.StructField("newest_id", T.StringType()),
])


def _recent_fn(size: int, ttl_us: int):
    def fold(carry, t, i):
        items, last = carry or ([], None)
        if last is not None and t > last + ttl_us:   # the cached list expired
            items = []
        return [(items + [i])[-size:], t], (len(items), items[0] if items else None, items[-1] if items else None)
    return _ordered_fn(fold, [f.name for f in RECENT_OUT.fields], lambda c: c[1] + ttl_us)


def stream_recent(stream: DataFrame, size: int = S.RECENT_HISTORY_SIZE,
                  ttl_seconds: int = S.RECENT_HISTORY_TTL_SECONDS,
                  watermark: str = WATERMARK) -> DataFrame:
    """ST4: per event, the user's cached history before it (last ``size`` ids; the cache
    expires ``ttl_seconds`` after its last write)."""
    from pyspark.sql.streaming.state import GroupStateTimeout
    d = stream.withWatermark("timestamp", watermark) \
        .select("user_id", "transaction_id", "timestamp", F.unix_micros("timestamp").alias("_t"))
    return d.groupBy("user_id").applyInPandasWithState(
        _recent_fn(size, int(ttl_seconds) * 1_000_000), RECENT_OUT, ORDERED_STATE, "append",
        GroupStateTimeout.EventTimeTimeout)


# ---------------------------------------------------------------------------------------------
# Helpers to drive a stream from files (tests and registered queries)
# ---------------------------------------------------------------------------------------------

#: Rows of a file of a chunk, if the chunks are of equal size.
FILE_ROWS = 250_000


def _data_files(spark: SparkSession, path: str) -> int:
    if not _exists(spark, path):
        return 0
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    return sum(not n.startswith(("_", ".")) for n in names)


def write_time_chunks(df: DataFrame, path: str, ts: str, n_chunks: int = 4, file_rows: int = FILE_ROWS) -> int:
    """Write ``df`` as ``n_chunks`` successive file sets in time order (one job each, so file
    times follow event time and the file source reads them in that order). Returns the number of files of a chunk, the same
    for all, which is the ``maxFilesPerTrigger`` that makes a chunk a batch: it grows with the rows, so that no task writes
    a whole chunk."""
    b = df.agg(F.min(F.unix_micros(ts)).alias("lo"), F.max(F.unix_micros(ts)).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, hi = b["lo"], b["hi"]
    if lo is None:
        return 1
    spark = df.sparkSession
    files = max(1, -(-b["n"] // (n_chunks * file_rows)))
    before = _data_files(spark, path)
    step = (hi - lo) // n_chunks + 1
    for i in range(n_chunks):
        a, z = lo + i * step, lo + (i + 1) * step
        inside = (F.unix_micros(ts) >= a) & (F.unix_micros(ts) < z)
        part = df.where(inside | F.col(ts).isNull() if i == 0 else inside)
        with shuffles_freed(spark):
            part.repartition(files).write.mode("append").parquet(path)
        # a partition without rows wrote no file: empty ones make up for it
        for _ in range(before + files * (i + 1) - _data_files(spark, path)):
            spark.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(path)
    return files


def write_closing_row(df: DataFrame, path: str, ts: str) -> None:
    """One row two days after the last, so that the watermark passes all of ``df``. Stateful folds
    hold the row itself back."""
    last = df.agg(F.max(ts)).first()[0]
    if last is not None:
        (df.where(F.col(ts).isNotNull()).limit(1).withColumn(ts, F.lit(last) + F.expr("INTERVAL 2 DAYS"))
         .withColumn("transaction_id", F.lit("SENTINEL")).select(*df.columns).coalesce(1).write.mode("append").parquet(path))


def run_to_table(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str,
                 mode: str = "append") -> DataFrame:
    """Run a streaming frame to completion (availableNow) into a Parquet file sink and read
    the committed result back."""
    q = (stream.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).outputMode(mode)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)
