"""Event-and-expiry sweep: counts, sums and distinct counts over a user's recent past, in linear time.

A row at time t counts for later rows up to ``t + reach``. So it makes two events: it enters at t and leaves at
``t + reach``. A value of a distinct count enters with each of its rows and leaves at the earlier of
``t + reach`` and the next row of the same value. What a row sees is the running sum of the events strictly before it.

Events are summed inside cells of six hours of one user; what a cell inherits is the total of the user's cells before it,
a running sum over one row a cell. A user has at most four cells a day of the log, so no user, day or value has to
fit a task, and there is no other plan for busy users. Amounts are summed as exact decimals, so nothing cancels. The rows travel
with the events, so that they aren't joined again.

Rows without a time have no history and are nobody's; they stand first in the order of a user's rows. A null user is a
user like any other.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.schema import HOUR_US

#: Amounts count to ten decimals; values that are no number or beyond 10^28 count as missing.
AMOUNT = "decimal(38,10)"
#: Place of rows without a time, rank of an expiry (behind all rows of its time).
TIMELESS, LAST = -(1 << 60), (1 << 31) - 1
#: Width of a cell. A row makes events at its time and an hour, six hours and a day later: narrower cells would be almost as
#: many as the events, and as much to shuffle.
CELL = 6 * HOUR_US
UNB = Window.unboundedPreceding


class Span(NamedTuple):
    """One output. ``kind``: count, sum or distinct of ``value`` over the rows t' with t' < t <= t' + ``reach``
    (microseconds). Distinct only: ``current``: rows of time t count too; ``missing``: what a null value counts as
    (None: as nothing)."""
    name: str
    kind: str
    reach: int
    value: str | None = None
    current: bool = False
    missing: str | None = None


def _celled(df: DataFrame) -> DataFrame:
    return df.withColumn("_cell", F.floor(F.col("t") / F.lit(CELL)).cast("long"))


def _inherited(cut: DataFrame, keys: list[str], values: list[Column], of, more: list[Column] = ()) -> DataFrame:
    """(keys, _cell, ...) of the cells of ``cut``: ``of(name, window)`` of every per-cell value over a window of the key's cells,
    and ``more`` columns."""
    per = cut.groupBy(*keys, "_cell").agg(*values)
    order = Window.partitionBy(*keys).orderBy("_cell")
    return per.select(*keys, "_cell", *[of(n, order).alias(f"in_{n}") for n in per.columns[len(keys) + 1:]], *more)


def _with_next(values: DataFrame) -> DataFrame:
    """``values`` (k, c, v, t, r) with ``next``: place of the next row of the same value, rows of one place among each other too."""
    keys = ["k", "c", "v"]
    cut = _celled(values)
    place = F.struct("t", "r")
    later = _inherited(cut, keys, [F.min(place).alias("first")], lambda n, w: F.lead(n).over(w))
    inside = F.lead(place).over(Window.partitionBy(*keys, "_cell").orderBy("t", "r"))
    return (cut.withColumn("inside", inside).join(later, [*keys, "_cell"])
            .withColumn("next", F.coalesce("inside", "in_first"))
            .select("k", "c", "t", "r", F.col("next.t").alias("next_t"), F.col("next.r").alias("next_r")))


def _events(rows: DataFrame, spans: list[Span]) -> DataFrame:
    """(k, t, r, n, a0, b0, a1, ..., row) of ``rows`` (k, t, r, q, values, row): the rows (n = 1) and what every span gains at a
    place: ``a`` (for ``current`` seen by the place's rows too), ``b`` behind it. Rows with ``q`` are in no span."""
    zero = {s: F.lit(0).cast(AMOUNT if s.kind == "sum" else "long") for s in spans}
    moves = [f"a{i}" for i in range(len(spans))] + [f"b{i}" for i, s in enumerate(spans) if s.current]

    def gains(a: dict, b: dict) -> list[Column]:
        return [*[a.get(s, zero[s]).alias(f"a{i}") for i, s in enumerate(spans)],
                *[b.get(s, zero[s]).alias(f"b{i}") for i, s in enumerate(spans) if s.current]]

    def moved(df: DataFrame, steps: list[tuple]) -> DataFrame:
        """A row for each (t, r, a, b) of ``steps``, picked by number: no arrays of structs are built."""
        step = F.explode(F.array(*[F.lit(i) for i in range(len(steps))])).alias("step")

        def pick(of: list[Column]) -> Column:
            out = of[-1]
            for i in reversed(range(len(of) - 1)):
                out = F.when(F.col("step") == i, of[i]).otherwise(out)
            return out

        each = [gains(a, b) for _, _, a, b in steps]
        return df.select("*", step).select(
            "k", pick([x[0] for x in steps]).alias("t"), pick([x[1] for x in steps]).alias("r"), F.lit(0).alias("n"),
            *[pick([g[j] for g in each]).alias(c) for j, c in enumerate(moves)], F.lit(None).cast(rows.schema["row"].dataType).alias("row"))

    t, r, timed = F.col("t"), F.col("r"), (F.col("t") > TIMELESS) & ~F.col("q")
    plain = [s for s in spans if s.kind != "distinct"]
    sums = sorted({s.value for s in plain if s.kind == "sum"})
    own = {v: f"x{j}" for j, v in enumerate(sums)}
    exact = rows.withColumns({own[v]: F.when(timed, F.expr(f"try_cast(`{v}` as {AMOUNT})")) for v in sums}) if sums else rows
    gain = {s: timed.cast("long") if s.kind == "count" else F.coalesce(own[s.value], zero[s]) for s in plain}
    out = exact.select("k", "t", "r", F.lit(1).alias("n"), *gains(gain, {}), "row")

    reaches = sorted({s.reach for s in plain})
    if reaches:
        out = out.union(moved(exact.where(timed), [(t + reach, F.lit(LAST), {
            s: (-gain[s]).cast(AMOUNT if s.kind == "sum" else "long") for s in plain if s.reach == reach}, {}) for reach in reaches]))
    distinct = [s for s in spans if s.kind == "distinct"]
    if distinct:
        columns = sorted({s.value for s in distinct})
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(v).cast("string").alias("v")) for c, v in enumerate(columns)]))
        values = (rows.where(timed).select("k", "t", "r", each.alias("e")).select("k", "e.c", "e.v", "t", "r")
                  .where("v is not null"))
        mine = {s: F.when(F.col("c") == columns.index(s.value), F.lit(1)).otherwise(F.lit(0)).cast("long") for s in distinct}
        steps = [(t, r, mine, {})]
        for reach in sorted({s.reach for s in distinct}):
            some = {s: -mine[s] for s in distinct if s.reach == reach}
            again = F.coalesce(F.col("next_t") <= t + reach, F.lit(False))
            steps.append((F.when(again, F.col("next_t")).otherwise(t + reach), F.when(again, F.col("next_r")).otherwise(F.lit(LAST)),
                          {s: F.when(again, x).otherwise(F.lit(0)) if s.current else x for s, x in some.items()},
                          {s: F.when(again, F.lit(0)).otherwise(x) for s, x in some.items() if s.current}))
        out = out.union(moved(_with_next(values), steps))
    return out


def _swept(rows: DataFrame, spans: list[Span], ties: bool, id_col: str | None) -> DataFrame:
    """``row.*`` with ``_before``, ``_prev_ts_us``, the spans and, with ``id_col``, ``_row``."""
    cut = _celled(_events(rows, spans))
    moves = [c for c in cut.columns if c[0] in "ab"]
    entry = F.when((F.col("n") > 0) & (F.col("t") > TIMELESS), F.col("t"))
    per = [F.sum("n").alias("n"), F.max(entry).alias("prev"), *[F.sum(c).alias(c) for c in moves]]
    inherited = _inherited(cut, ["k"], per, lambda n, w: (F.max if n == "prev" else F.sum)(n).over(w.rowsBetween(UNB, -1)),
                           [F.sum("n").over(Window.partitionBy("k")).alias("all_n")])
    cell = Window.partitionBy("k", "_cell")
    if ties:  # rows have places of their own; a row stands before what else is there
        w = through = cell.orderBy("t", "r", F.desc("n")).rowsBetween(UNB, -1)
    else:  # an expiry stands between its time and the next
        order = cell.orderBy(F.col("t") * 2 + (F.col("r") == LAST).cast("long"))
        w, through = order.rangeBetween(UNB, -1), order.rangeBetween(UNB, 0)
    inside = {"n": F.sum("n").over(w), "prev": F.max(entry).over(w)} | {
        c: F.sum(c).over(through if c[0] == "a" and spans[int(c[1:])].current else w) for c in moves}
    place = F.row_number().over(Window.partitionBy("k", "_cell", "t", "n").orderBy(f"row.{id_col}")) - 1 if id_col else F.lit(0)
    run = cut.select("k", "_cell", "n", "row", place.alias("place"), *[x.alias(f"s_{c}") for c, x in inside.items()]).where("n > 0")
    run = run.join(inherited, ["k", "_cell"])

    def total(c: str) -> Column:
        return F.coalesce(F.col(f"s_{c}"), F.lit(0)) + F.coalesce(F.col(f"in_{c}"), F.lit(0))

    out = [(total(f"a{i}") + total(f"b{i}") if s.current else total(f"a{i}")).cast("double" if s.kind == "sum" else "long").alias(s.name)
           for i, s in enumerate(spans)]
    return run.select("row.*", total("n").alias("_before"), F.coalesce("s_prev", "in_prev").alias("_prev_ts_us"), *out,
                      *([(total("n") + (0 if ties else F.col("place"))).alias("_row"), F.col("all_n").alias("_rows")] if id_col else []))


def recent(df: DataFrame, spans: list[Span], user: str = "user_id", id_col: str = "transaction_id", ties: bool = False,
           rows: bool = False, past: str | None = None) -> DataFrame:
    """``df`` (with ``_ts_us``) with the spans' outputs, ``_before`` (the user's rows before this one), ``_prev_ts_us``
    (time of the last of them that has one; null if none) and, with ``rows``, ``_row`` (place among the user's rows by
    time and id, from 0) and ``_rows`` (their number).

    A row's past are the rows of strictly earlier times; with ``ties`` also those of the same time and a smaller id.
    ``past``: a boolean column; where it is true a row only has its place among the user's rows and counts in no span. That
    changes nothing for rows that lie more than the longest reach behind it."""
    key = F.when(F.col(user).isNull(), F.lit("")).otherwise(F.concat(F.lit("u"), F.col(user).cast("string")))
    kinds = sorted({(s.value, s.missing) for s in spans if s.value}, key=str)
    values = [F.col(v) if m is None else F.coalesce(F.col(v).cast("string"), F.lit(m)) for v, m in kinds]
    slim = df.select(key.alias("k"), F.coalesce("_ts_us", F.lit(TIMELESS)).alias("t"),
                     (F.col(past) if past else F.lit(False)).alias("q"), *[c.alias(f"v{j}") for j, c in enumerate(values)],
                     F.struct(*df.columns).alias("row"))
    rank = F.row_number().over(Window.partitionBy("k", "t").orderBy(f"row.{id_col}")) if ties else F.lit(0)
    named = [s._replace(value=f"v{kinds.index((s.value, s.missing))}") if s.value else s for s in spans]
    return _swept(slim.withColumn("r", rank), named, ties, id_col if rows else None)
