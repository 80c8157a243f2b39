"""Point-in-time window operators per user.

Edges (integer microseconds, ``_ts_us``):

* ``online`` variant (W1-W4): history rows with ``t - W <= ts < t`` (lower edge inclusive,
  strictly earlier timestamps only, so ties never count);
* ``batch`` variant (W10): rows earlier in (timestamp, id) order with ``t - W < ts <= t``.

Plans. ``user_windows`` takes the range windows (W1-W4, W8, W10, W11) from the event-and-expiry sweep, which is linear in
the rows and splits any user, day or value over many tasks. Rows frames (W5-W7, W9) run in (user, row chunk)
partitions with the last rows of the chunk before as context; the row index comes from the sweep. Chunks are 4,096
rows or as long as the longest frame. No plan depends on how many rows a user has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import features as FX
from riskloom.operators.prefix import stored
from riskloom.operators.sweep import Span, recent
from riskloom.operators.timeline import (DEFAULT_CHUNK, HOT_USER_ROWS, chunk_context, hours_between_us,
                                         has_hot_keys, running_max, split_hot_keys, with_ts_us,
                                         with_user_row_index)
from riskloom.schema import HOUR_US

USER = "user_id"
TID = "transaction_id"
UNB = Window.unboundedPreceding


def _ensure_ts(df: DataFrame) -> DataFrame:
    return df if "_ts_us" in df.columns else with_ts_us(df)


# ---- the plan ------------------------------------------------------------------------------

class Frames(dict):
    """Rows-frame columns by name, and how many rows back the widest of their frames reaches."""

    def __init__(self, reach: int = 0, **columns):
        super().__init__(**columns)
        self.reach = reach


def user_windows(df: DataFrame, spans: list[Span] | None = None, rows_cols: Frames | None = None,
                 user: str = USER, id_col: str = TID, chunk: int = DEFAULT_CHUNK, past: str | None = None) -> DataFrame:
    """Add ``_row`` (with ``rows_cols``), ``_prev_ts_us`` and the given window columns.

    ``spans``: range windows for the sweep. ``rows_cols``: name → ``fn(w)`` with ``w`` a window in
    (timestamp, id) order. A chunk is at least as long as the frames' reach, so its size doesn't change values. ``past``: a
    boolean column of the rows that are in no range window."""
    d = recent(_ensure_ts(df), spans or [], user, id_col, rows=bool(rows_cols), past=past).drop("_before")
    for s in spans or []:
        if s.current:
            d = d.withColumn(s.name, F.greatest(F.lit(1).cast("long"), F.col(s.name)))
    if not rows_cols:
        return d
    w = Window.partitionBy(user, "_chunk").orderBy("_row")
    ctx = chunk_context(d, max(chunk, rows_cols.reach), rows_cols.reach, "_rows").drop("_rows")
    return (ctx.select("*", *[fn(w).alias(n) for n, fn in rows_cols.items()])
            .where(~F.col("_ctx")).drop("_chunk", "_ctx"))


# ---- column factories ----------------------------------------------------------------------

def velocity_columns(hours=(1, 6, 24), amount_hours=(1, 24), distinct_hours=(24,),
                     device_hours=()) -> list[Span]:
    """W1 counts, W2 sums, W3 distincts over ``[t-W, t)``; W11 devices over ``[t-W, t]``, at least 1. A missing
    merchant or country is one value of its own, a missing device none; rows without a time have no history."""
    out = [Span(f"txn_count_{h}h", "count", h * HOUR_US) for h in hours]
    out += [Span(f"amount_sum_{h}h", "sum", h * HOUR_US, "amount") for h in amount_hours]
    for h in distinct_hours:
        out += [Span(f"unique_{name}_{h}h", "distinct", h * HOUR_US, col, missing="")
                for name, col in (("merchants", "merchant_category"), ("countries", "country"))]
    return out + [Span(f"devices_used_{h}h", "distinct", h * HOUR_US, "device_id", current=True) for h in device_hours]


def history_columns(n_diversity: int = 100, n_spend: int = 10, travel: bool = True,
                    n_history: int = 0) -> Frames:
    """Rows-frame inputs of W5 (distinct merchants of the last 100), W6 (sum of the last 10
    amounts), W7 (previous row's country and time) and W9 (the last n rows)."""
    cols = Frames(max(n_diversity, n_spend, n_history, 1))
    if n_diversity:
        cols["_hist_merchants"] = lambda w: F.size(F.collect_set("merchant_category").over(
            w.rowsBetween(-n_diversity, -1)))
        cols["_hist_n"] = lambda w: F.count(F.lit(1)).over(w.rowsBetween(-n_diversity, -1))
    if n_spend:
        cols["_recent_spend"] = lambda w: F.sum("amount").over(w.rowsBetween(-n_spend, -1))
    if travel:
        cols["_prev_country"] = lambda w: F.lag("country", 1).over(w)
        cols["_prev_row_ts_us"] = lambda w: F.lag("_ts_us", 1).over(w)
    if n_history:
        cols["recent_history"] = lambda w: F.collect_list(F.struct(
            F.col(TID).alias("transaction_id"), F.col("timestamp"), F.col("amount"),
            F.col("merchant_category"), F.col("country"), F.col("device_id"))).over(
            w.rowsBetween(-n_history, -1))
    return cols


_HELPERS = ["_row", "_prev_ts_us", "_hist_merchants", "_hist_n", "_recent_spend",
            "_prev_country", "_prev_row_ts_us"]


def _clean(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in _HELPERS if c in df.columns])


# ---- W1-W4, W8, W11 ------------------------------------------------------------------------

def velocity_counts(df: DataFrame, hours=(1, 6, 24)) -> DataFrame:
    """Number of the user's transactions in ``[t-W, t)``."""
    return _clean(user_windows(df, velocity_columns(hours, (), ())))


def velocity_amounts(df: DataFrame, hours=(1, 24)) -> DataFrame:
    """Amount sums in ``[t-W, t)``, 0 when none."""
    return _clean(user_windows(df, velocity_columns((), hours, ())))


def velocity_distinct(df: DataFrame, hours=(24,)) -> DataFrame:
    """Distinct merchants and countries in ``[t-W, t)``."""
    return _clean(user_windows(df, velocity_columns((), (), hours)))


def devices_24h(df: DataFrame) -> DataFrame:
    """Distinct devices in ``[t-24h, t]`` including the current row, floor 1."""
    return _clean(user_windows(df, velocity_columns((), (), (), (24,))))


def gap_hours_expr(default_gap_hours: float = 24.0) -> Column:
    return F.coalesce(hours_between_us(F.col("_ts_us"), F.col("_prev_ts_us")),
                      F.lit(float(default_gap_hours)))


def time_since_last(df: DataFrame, default_gap_hours: float = 24.0) -> DataFrame:
    """Hours since the latest strictly earlier transaction of the user."""
    d = user_windows(df)
    return _clean(d.withColumn("time_since_last_txn_hours", gap_hours_expr(default_gap_hours)))


def velocity_features(df: DataFrame, default_gap_hours: float = 24.0,
                      with_devices: bool = True) -> DataFrame:
    """W1-W4 (+ W11) and the velocity score P11 in one plan."""
    cols = velocity_columns((1, 6, 24), (1, 24), (24,), (24,) if with_devices else ())
    v = user_windows(df, cols)
    v = v.withColumn("time_since_last_txn_hours", gap_hours_expr(default_gap_hours))
    return _clean(v.withColumn("velocity_score", FX.velocity_score(
        F.col("txn_count_1h"), F.col("txn_count_6h"), F.col("txn_count_24h"),
        F.col("amount_sum_1h"))))


# ---- W5, W6, W7, W9 ------------------------------------------------------------------------

def merchant_diversity_expr() -> Column:
    """min(1, distinct merchants of the last 100 / 10); 0.5 without history."""
    return F.when(F.col("_hist_n") > 0,
                  F.least(F.lit(1.0), F.col("_hist_merchants") / 10.0)).otherwise(F.lit(0.5))


def spending_velocity_expr(has_profile: Column, avg: Column, monthly: Column) -> Column:
    """Sum of the last 10 amounts / max(avg·monthly/30, 1); 1.0 without history/profile."""
    expected = F.greatest(avg * monthly / 30.0, F.lit(1.0))
    return F.when(has_profile & F.col("_recent_spend").isNotNull(),
                  F.col("_recent_spend") / expected).otherwise(F.lit(1.0))


def impossible_travel_expr() -> Column:
    """The previous transaction was in another country and the elapsed hours are below
    half of distance / 500 km/h (strict)."""
    prev = F.col("_prev_country")
    cur = FX.country_or_default("country")
    dist = FX.distance_km(prev, cur)
    hours = hours_between_us(F.col("_ts_us"), F.col("_prev_row_ts_us"))
    cond = prev.isNotNull() & (prev != cur) & (hours < dist / 500.0 * 0.5)
    return FX.flag(cond)


def merchant_diversity(df: DataFrame) -> DataFrame:
    d = user_windows(df, rows_cols=history_columns(100, 0, False))
    return _clean(d.withColumn("merchant_diversity_score", merchant_diversity_expr()))


def spending_history(df: DataFrame) -> DataFrame:
    """W6 input: ``_recent_spend`` (sum of the previous 10 amounts) per transaction."""
    d = user_windows(df, rows_cols=history_columns(0, 10, False))
    return d.drop("_row", "_prev_ts_us")


def impossible_travel(df: DataFrame) -> DataFrame:
    d = user_windows(df, rows_cols=history_columns(0, 0, True))
    return _clean(d.withColumn("is_impossible_travel", impossible_travel_expr()))


def recent_history(df: DataFrame, n: int = 100) -> DataFrame:
    """The last ``n`` earlier transactions as an array of structs (oldest first)."""
    return _clean(user_windows(df, rows_cols=history_columns(0, 0, False, n)))


# ---- W10 -----------------------------------------------------------------------------------

def velocity_batch(df: DataFrame) -> DataFrame:
    """W10, batch variant: rows earlier in (timestamp, id) order with ``t-W < ts <= t``;
    gap to the previous row in that order, 0.0 for the first (and for tied rows). Missing amounts
    add nothing, missing categories count as one value, rows without a time have no history."""
    edge = lambda h: h * HOUR_US - 1
    spans = [Span(f"txn_count_{h}h", "count", edge(h)) for h in (1, 24)]
    spans += [Span(f"txn_amount_{h}h", "sum", edge(h), "amount") for h in (1, 24)]
    spans += [Span(f"unique_{name}_24h", "distinct", edge(24), col, missing="")
              for name, col in (("merchants", "merchant_category"), ("countries", "country"))]
    out = recent(_ensure_ts(df), spans, ties=True)
    gap = hours_between_us(F.col("_ts_us"), F.col("_prev_ts_us"))
    return out.withColumn("time_since_last_txn", F.coalesce(gap, F.lit(0.0))).drop("_before", "_prev_ts_us")


# ---- W12 / W13: anchored counters ------------------------------------------------------------

FOLD_BLOCK = 256

def _long_anchors(times: DataFrame, w_us: int) -> DataFrame:
    """(k, a): the window starts of segments longer than one window. ``times`` (k, seg, t) holds
    their distinct times.

    The start after one at time t is the first event later than t + window; within a segment it
    comes at most two windows after t, so it is found inside time buckets. Starting at the segment's first event
    the chain is followed by doubling: with jumps of 1, 2, 4, ... starts, each round joins the
    starts found so far with the jumps, so a chain of n starts takes log2(n) rounds."""
    step = 2 * w_us + 1
    b = F.floor(F.col("t") / F.lit(step))
    # a row is also offered to the bucket before its own
    spread = times.select("k", "seg", "t", F.explode(F.array(
        F.struct(b.alias("b"), F.lit(True).alias("own")),
        F.struct((b - 1).alias("b"), F.lit(False).alias("own")))).alias("x")).select("k", "seg", "t", "x.b", "x.own")
    # from late to early, so that the frame only grows
    after = Window.partitionBy("k", "seg", "b").orderBy("_late").rangeBetween(Window.unboundedPreceding, -(w_us + 1))
    jump = stored(spread.withColumn("_late", -F.col("t")).withColumn("to", -F.max("_late").over(after)).where("own and to is not null").select("k", "t", "to"), "jumps")
    found = stored(times.groupBy("k", "seg").agg(F.min("t").alias("a")).select("k", "a"), "anchors")

    def hop(starts, jumps):
        j = jumps.withColumnsRenamed({"k": "_k"})
        return starts.join(j, F.col("k").eqNullSafe(F.col("_k")) & (F.col("a") == F.col("t"))).select("k", F.col("to").alias("a"))

    while True:
        more = stored(hop(found, jump), "anchors")
        if not more.limit(1).count():
            return found
        found = stored(found.union(more).distinct(), "anchors")
        two = jump.withColumnsRenamed({"k": "_k", "t": "_t", "to": "_to"})
        jump = stored(jump.join(two, F.col("k").eqNullSafe(F.col("_k")) & (F.col("to") == F.col("_t")))
                      .select("k", "t", F.col("_to").alias("to")), "jumps")


def _placed_by_fold(d: DataFrame, w_us: int) -> DataFrame:
    """(k, id, anchor, n) of users with a bounded number of rows: one shuffle by user, then a fold
    over the user's sorted rows. The fold's results are gathered in blocks, so that adding
    one copies a block at most."""
    pair = "struct<anchor: bigint, n: bigint>"

    def step(done, row):
        last = F.element_at(done, -1)
        opens = last["anchor"].isNull() | (row["t"] > last["anchor"] + F.lit(w_us))
        return F.concat(done, F.array(F.struct(
            F.when(opens, row["t"]).otherwise(last["anchor"]).alias("anchor"),
            F.when(opens, F.lit(1).cast("long")).otherwise(last["n"] + 1).alias("n"))))

    def block(done, rows):
        carried = F.element_at(F.element_at(done, -1), -1)
        return F.concat(done, F.array(F.slice(F.aggregate(rows, F.array(carried), step), 2, FOLD_BLOCK)))

    users = d.groupBy("k").agg(F.sort_array(F.collect_list(F.struct(F.col("_ts_us").alias("t"), "id"))).alias("rows"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / F.lit(FOLD_BLOCK)).cast("int")),
                         lambda b: F.slice("rows", b * FOLD_BLOCK + 1, FOLD_BLOCK))
    nothing = F.array(F.array(F.lit(None).cast(pair)))
    placed = F.slice(F.flatten(F.aggregate(blocks, nothing, block)), F.lit(2), F.size("rows"))
    return (users.select("k", "rows", placed.alias("placed"))
            .select("k", F.explode(F.arrays_zip("rows", "placed")).alias("x"))
            .select("k", F.col("x.rows.id").alias("id"), F.col("x.placed.anchor").alias("anchor"), F.col("x.placed.n").alias("n")))


def _placed_by_jumps(d: DataFrame, w_us: int) -> DataFrame:
    """The same for users of any size, no user or segment in one task.

    An event more than ``window`` after the previous one always opens a window, so the log splits
    into segments at such gaps. A segment no longer than the window has one anchor, its start;
    longer ones follow their chain of anchors (:func:`_long_anchors`). An event's anchor is the
    latest one at or before it, its position the row number after that anchor."""
    prev = F.col("_prev_ts_us")
    start = F.when(prev.isNull() | ((F.col("_ts_us") - prev) > F.lit(w_us)), F.col("_ts_us"))
    rows = with_user_row_index(d, "k", "id").withColumn("_start", start)
    ev = stored(running_max(rows, "_start", "seg", "k").select("k", "id", "_ts_us", "seg"), "segments")
    span = ev.groupBy("k", "seg").agg(F.max("_ts_us").alias("_end")).where(F.col("_end") - F.col("seg") > w_us)
    long_ = span.select(F.col("k").alias("_k"), F.col("seg").alias("_seg"))
    in_long = F.col("k").eqNullSafe(F.col("_k")) & (F.col("seg") == F.col("_seg"))
    times = stored(ev.join(long_, in_long, "left_semi").select("k", "seg", F.col("_ts_us").alias("t")).distinct(), "times")
    starts = _long_anchors(times, w_us).select(F.col("k").alias("_k"), F.col("a").alias("_a"))
    mark = F.coalesce("_a", F.when(F.col("_ts_us") == F.col("seg"), F.col("seg")))
    marked = ev.join(starts, F.col("k").eqNullSafe(F.col("_k")) & (F.col("_ts_us") == F.col("_a")), "left") \
        .select("k", "id", "_ts_us", mark.alias("_mark"))
    n = F.row_number().over(Window.partitionBy("k", "anchor").orderBy("_ts_us", "id")).cast("long")
    return running_max(marked, "_mark", "anchor", "k").select("k", "id", "anchor", n.alias("n"))


def anchored_counter(df: DataFrame, window_seconds: int, limit: int | None = None,
                     key: str = USER, id_col: str = TID,
                     hot_threshold: int | None = HOT_USER_ROWS) -> DataFrame:
    """Counter windows that start at an event and end ``window_seconds`` later (an event at
    exactly anchor + window still belongs; a strictly later one opens the next window).

    Returns (key, id, ``window_start``, ``count_in_window``); with ``limit`` (W13) also
    ``allowed`` (the first event of a window always, others up to position ``limit``), and
    ``count_in_window`` is the stored count, which a denied event does not raise. Events without
    a time are in no window: start, count and ``allowed`` are null.

    Users of up to ``hot_threshold`` rows are folded in one shuffle (:func:`_placed_by_fold`), users
    above it follow jumps (:func:`_placed_by_jumps`); both give the same rows."""
    w_us = int(window_seconds) * 1_000_000
    d = _ensure_ts(df).select(F.col(key).alias("k"), F.col(id_col).alias("id"), "_ts_us")
    timeless = d.where(F.col("_ts_us").isNull())
    d = d.where(F.col("_ts_us").isNotNull())
    if hot_threshold is None:
        placed = _placed_by_jumps(d, w_us)
    elif not has_hot_keys(d, "k", hot_threshold):
        placed = _placed_by_fold(d, w_us)
    else:
        normal, hot = split_hot_keys(d, "k", hot_threshold)
        placed = _placed_by_fold(normal, w_us).unionByName(_placed_by_jumps(hot, w_us))
    res = placed.unionByName(
        timeless.select("k", "id", F.lit(None).cast("long").alias("anchor"), F.lit(None).cast("long").alias("n")))
    res = res.select(F.col("k").alias(key), F.col("id").alias(id_col), F.timestamp_micros("anchor").alias("window_start"),
                     F.col("n").alias("count_in_window"))
    if limit is not None:
        most = max(int(limit), 1)
        res = (res.withColumn("allowed", F.col("count_in_window") <= F.lit(most))
               .withColumn("count_in_window", F.when(F.col("count_in_window").isNotNull(), F.least(
                   F.col("count_in_window"), F.lit(most).cast("long")))))
    return res


def rate_limit(df: DataFrame, limit: int = 1000, window_seconds: int = 60,
               key: str = USER, id_col: str = TID, **kw) -> DataFrame:
    """Allowed while the window's count is below ``limit``."""
    return anchored_counter(df, window_seconds, limit, key, id_col, **kw)
