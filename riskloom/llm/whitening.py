"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its triangular factor.

Vectors become integers, floor(scale * entry). The fit list is each distinct integer vector once: n
vectors with exact sums S a dimension. Spark sums the scatter of x - S/n over the cluster; what reaches the
driver is one matrix of the vectors' length. There V = L L' is factored with diagonal pivoting, and the
columns of the triangular L are rotated in pairs until all are orthogonal. Their squared norms are the
eigenvalues of V and the normalised columns its unit eigenvectors; V itself is never iterated on, which
keeps small eigenvalues accurate. The sign is chosen so that a component's largest entry is positive.

Rows whose vector is null, empty or holds null or non-finite entries are dropped. Entries beyond the
range of a long take its ends. Every vector length has a fit of its own (their matrices must fit the driver
together). Directions without variance can't be whitened and give no component, so fewer than asked for
come back where the fit list has fewer dimensions (none for a single distinct vector). Repeated rows
count once in the fit and come back as often as they are given; equal eigenvalues keep the order in which
the rotations leave them. Null ids are returned as they are; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored

#: Vectors worked on together, tasks a core that sum the scatter, sweeps of rotations at most.
BLOCK, TASKS, SWEEPS = 2048, 4, 60


@dataclass
class Whitening:
    """Fit of one vector length: size and exact sums of the fit list, leading components as columns,
    their eigenvalues, the trace of the covariance."""
    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in double; the whole part of S/n is taken off in integers."""
        whole = np.array([s // self.n for s in self.sums], object)
        rest = np.array([s % self.n / self.n for s in self.sums])
        if all(abs(w) < 1 << 62 for w in whole) and (not x.size or max(-int(x.min()), int(x.max())) < 1 << 62):
            return (x - whole.astype(np.int64)).astype(float) - rest
        return (x.astype(object) - whole).astype(float) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums over the dimensions of (n x - S)^2."""
        top = max([0, *(abs(s) for s in self.sums)]) + self.n * max(0, -int(x.min()), int(x.max())) if x.size else 0
        if top * top * x.shape[1] < 1 << 63:
            d = x * self.n - np.array(self.sums, np.int64)
            return (d * d).sum(1).tolist()
        d = x.astype(object) * self.n - np.array(self.sums, object)
        return (d * d).sum(1).tolist()


def _integers(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, dim, x) of the rows that count: x holds the integers as little-endian longs."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vec").cast(pa.list_(pa.float64()))
            flat, off = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            good = column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(off) > 0)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            good &= bad[off[1:]] == bad[off[:-1]]
            with np.errstate(over="ignore", invalid="ignore"):
                low = np.floor(flat * scale)
                x = np.where(low >= 2.0 ** 63, np.iinfo(np.int64).max, np.clip(low, -2.0 ** 63, 2.0 ** 62).astype(np.int64))
                between = (low > 2.0 ** 62) & (low < 2.0 ** 63)
                x[between] = low[between].astype(np.int64)
            at = np.flatnonzero(good)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at)), pa.array((off[at + 1] - off[at]).astype(np.int32)),
                 pa.array([x[off[i]:off[i + 1]].astype("<i8").tobytes() for i in at], pa.binary())], names=["id", "dim", "x"])

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    return map_batches(rows, run, f"id {kind}, dim int, x binary")


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """Runs of up to BLOCK rows of equal length: (rows, length, matrix)."""
    for batch in batches:
        dims = batch.column("dim").to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            for s in range(0, len(at), BLOCK):
                rows = batch.take(pa.array(at[s:s + BLOCK]))
                yield rows, dim, np.frombuffer(b"".join(rows.column("x").to_pylist()), "<i8").reshape(-1, dim)


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By length: how many vectors, and the exact sum of every dimension."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for _, dim, x in _blocks(batches):
            own = total.setdefault(dim, [0, np.zeros(dim, object)])
            own[0] += len(x)
            # halves of 32 bits can't overflow within a block
            own[1] += (x >> 32).sum(0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
        for dim, (n, s) in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()),
                 pa.array([str(v) for v in s])], names=["dim", "i", "n", "s"])

    got = map_batches(fit, run, "dim int, i int, n bigint, s string").groupBy("dim", "i").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dim", "i").collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in got:  # one row a dimension
        out.setdefault(r.dim, (r.n, []))[1].append(int(r.s))
    return out


def _covariances(fit: DataFrame, empty: dict[int, Whitening]) -> dict[int, np.ndarray]:
    """By length: the covariance, divisor n, of the centred vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for _, dim, x in _blocks(batches):
            d = empty[dim].centred(x)
            total[dim] = total.get(dim, 0.0) + d.T @ d
        for dim, m in total.items():
            i, j = np.triu_indices(dim)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim), pa.int32()), pa.array(i, pa.int32()),
                                              pa.array(j, pa.int32()), pa.array(m[i, j])], names=["dim", "i", "j", "s"])

    # few long tasks: each gives a matrix
    tasks = TASKS * fit.sparkSession.sparkContext.defaultParallelism
    got = map_batches(fit.coalesce(tasks), run, "dim int, i int, j int, s double").groupBy("dim", "i", "j").agg(
        F.sum("s").alias("s")).toArrow()  # half a matrix a length
    dims, i, j, s = (got[c].to_numpy() for c in ("dim", "i", "j", "s"))
    out = {}
    for dim in empty:
        own, m = dims == dim, np.zeros((dim, dim))
        m[i[own], j[own]] = s[own] / empty[dim].n
        out[dim] = np.maximum(m, m.T) if dim == 1 else m + np.triu(m, 1).T
    return out


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, L): v[order][:, order] = L L' with L lower triangular, its pivots falling; columns stop where
    what is left is rounding."""
    n = len(v)
    a, order, cols = v.copy(), np.arange(n), []
    floor = n * np.finfo(float).eps * max(v.diagonal().max(initial=0.0), 0.0)
    for k in range(n):
        p = k + int(np.argmax(a.diagonal()[k:]))
        if a[p, p] <= floor:
            break
        if p != k:
            a[[k, p]], order[[k, p]] = a[[p, k]], order[[p, k]]
            a[:, [k, p]] = a[:, [p, k]]
            for c in cols:
                c[[k, p]] = c[[p, k]]
        col = np.zeros(n)
        col[k:] = a[k:, k] / np.sqrt(a[k, k])
        a[k:, k:] -= np.outer(col[k:], col[k:])
        cols.append(col)
    return order, np.array(cols).T.reshape(n, len(cols))


def jacobi_columns(factor: np.ndarray) -> np.ndarray:
    """The columns of ``factor`` rotated in pairs until all are orthogonal. A round rotates disjoint pairs
    together, and the rounds of a sweep meet every pair once (a round-robin)."""
    w = factor.copy()
    r = w.shape[1]
    if r < 2:
        return w
    seats = list(range(r)) + ([-1] if r % 2 else [])
    tol = np.finfo(float).eps * np.sqrt(r)
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(min(p, q), max(p, q)) for p, q in zip(seats[:half], seats[::-1][:half]) if p >= 0 and q >= 0]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            i, j = np.array(pairs).T
            x, y = w[:, i], w[:, j]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            off = np.abs(c) / np.sqrt(a * b)
            worst = max(worst, off.max())
            turn = off > tol
            if not turn.any():
                continue
            i, j, x, y, a, b, c = i[turn], j[turn], x[:, turn], y[:, turn], a[turn], b[turn], c[turn]
            zeta = (b - a) / (2 * c)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            cos = 1 / np.sqrt(1 + t * t)
            sin = cos * t
            w[:, i], w[:, j] = cos * x - sin * y, sin * x + cos * y
        if worst <= tol:
            break
    return w


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of a positive semidefinite matrix by falling value; directions without
    variance are left out."""
    order, factor = pivoted_cholesky(v)
    w = jacobi_columns(factor)
    values = (w * w).sum(0)
    by = np.argsort(-values, kind="stable")
    vectors = np.zeros_like(w)
    vectors[order] = (w / np.sqrt(values))[:, by]
    top = np.abs(vectors).argmax(0)
    return values[by], vectors * np.where(vectors[top, np.arange(len(by))] < 0, -1.0, 1.0)


def fit(integers: DataFrame, components: int) -> dict[int, Whitening]:
    """Whitening of every vector length. ``integers`` (dim, x) holds each distinct vector once."""
    none = {dim: Whitening(n, s, np.zeros((dim, 0)), np.zeros(0), 0.0) for dim, (n, s) in _sums(integers).items()}
    models = {}
    for dim, v in _covariances(integers, none).items():
        values, vectors = eigen(v)
        models[dim] = Whitening(none[dim].n, none[dim].sums, vectors[:, :components], values[:components],
                                float(v.trace()))
    return models


def _projected(rows: DataFrame, models: dict[int, Whitening]) -> DataFrame:
    """``rows`` (id, dim, x) → (id, dim, deviation, w): exact deviation, whitened leading components."""
    kind = rows.schema["id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(models)  # a few columns of each length

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, dim, x in _blocks(batches):
            m = shared.value[dim]
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), block.column("dim"), pa.array([str(v) for v in m.deviations(x)]),
                 pa.array(m.whitened(x).tolist(), pa.list_(pa.float64()))], names=["id", "dim", "deviation", "w"])

    return map_batches(rows, run, f"id {kind}, dim int, deviation string, w array<double>")


def identity_errors(fit_list: DataFrame, models: dict[int, Whitening], components: int) -> dict[int, float]:
    """By length: the largest entry of the whitened fit list's covariance minus the identity, measured."""
    w = _projected(fit_list.select(F.lit(None).cast("int").alias("id"), "dim", "x"), models)
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    got = w.groupBy("dim").agg(*[F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs]).collect()
    return {r.dim: max([abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if j < len(models[r.dim].values)], default=0.0) for r in got}


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vec_col: str = "embedding",
           scale: float = 256.0) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for every counted vector and
    leading component. deviation (decimal(38,0), null if it has more digits) is the exact sum over the dimensions of
    (n x - S)^2, explained the component's share of the variance, identity_error that of the whole fit."""
    rows = stored(_integers(vectors, id_col, vec_col, scale), "integers")
    fit_list = stored(rows.select("dim", "x").distinct(), "fit-list")
    models = fit(fit_list, components)
    errors = identity_errors(fit_list, models, components)
    spark = vectors.sparkSession
    facts = spark.createDataFrame(
        [(dim, k + 1, m.n, float(m.values[k] / m.trace), float(errors[dim])) for dim, m in models.items() for k in range(len(m.values))],
        "dim int, component int, n bigint, explained double, identity_error double")
    out = _projected(rows, models).select(
        "id", "dim", F.expr("try_cast(deviation as decimal(38,0))").alias("deviation"), F.posexplode("w").alias("k", "whitened"))
    return out.withColumn("component", F.col("k") + 1).join(F.broadcast(facts), ["dim", "component"]).select(
        F.col("id").alias(id_col), "component", "n", "deviation", "whitened", "explained", "identity_error")
