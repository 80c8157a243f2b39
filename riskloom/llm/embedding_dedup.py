"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are compared only with vectors of their label and length. Equal vectors are one class.
Second moments of all unit vectors, summed over the cluster, give the principal axes. The classes
of a label, range-sorted by their place on the first axis, are cut into tiles, and two tiles are
compared unless their boxes on the leading axes are farther apart than any linked pair can be.
Inside a pair of tiles the products are accumulated axis by axis, leading ones first; what is left
is at most the product of the suffix norms, and a pair is given up once it can't reach the
threshold. Pairs that remain are decided by their cosine in double precision on the vectors as
given. A pair of tiles reports link counts and a spanning forest of its links, never all pairs.
Tiles are shipped in blocks: a task takes the tiles of two blocks once for all their pairs.

Vectors that are null, zero or hold null or non-finite components, and those without a label, link
with nothing. Other components may have any size that a double has: each vector is taken times the
power of two that brings its largest one near 1, which changes no cosine. Repeated rows are vectors like any other; a null id names a component only where all
its ids are null. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import components, map_batches, stored

#: Rows of a tile; axes of its box; axes after which pairs are tested.
TILE, BOX = 2048, 6
#: Blocks that the tiles of the largest label are dealt into, and the most bytes of vectors a block holds
#: (beyond it there are more blocks).
BLOCKS, BLOCK_BYTES = 8, 64 << 20
STEPS = (4, 8, 16, 32)
#: Slack on bounds against rounding; exact decisions don't use it.
SLACK = 1e-9


def _rows(batch: pa.RecordBatch, col: str) -> list:
    """Vectors as double arrays; None for those that can't link."""
    column = batch.column(col).cast(pa.list_(pa.float64()))
    flat, off = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    good = column.is_valid().to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    out = []
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        v = flat[a:b]
        out.append(_scaled(v) if good[i] and b > a and bad[a] == bad[b] and v.any() else None)
    return out


def _scaled(v: np.ndarray) -> np.ndarray:
    """``v`` times a power of two, its largest component from 1/2 to 1, so that squares and sums stay in
    the range of doubles."""
    return np.ldexp(v, -np.frexp(np.abs(v).max())[1])


def _keyed(vectors: DataFrame, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """(id, label, key, dim, vec): key digests label and vector, null where nothing can link."""
    ids, labels = (vectors.schema[c].dataType.simpleString() for c in (id_col, label_col))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = _rows(batch, "vec")
            has = batch.column("label").is_valid().to_pylist()
            raw = [v.astype("<f8").tobytes() if v is not None and h else None for v, h in zip(vecs, has)]
            labels_ = [repr(x).encode() for x in batch.column("label").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"),
                 pa.array([r and xxh3_128_digest(k + b"\0" + r) for r, k in zip(raw, labels_)], pa.binary()),
                 pa.array([r and len(r) // 8 for r in raw], pa.int32()), pa.array(raw, pa.binary())],
                names=["id", "label", "key", "dim", "vec"])

    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    return map_batches(rows, run, f"id {ids}, label {labels}, key binary, dim int, vec binary")


def _axes(classes: DataFrame, dim: int) -> np.ndarray:
    """Principal axes of the unit vectors of length ``dim``, as columns, leading first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                m = _units(_matrix(batch.column("vec").to_pylist(), dim))
                total += m.T @ m
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])],
                                         names=["i", "j", "s"])

    got = map_batches(classes.where(F.col("dim") == dim).select("vec"), run, "i int, j int, s double") \
        .groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()  # dim^2 / 2 rows
    m = np.zeros((dim, dim))
    i, j, s = (got[c].to_numpy() for c in "ijs")
    m[i, j] = s
    m[j, i] = s
    return np.linalg.eigh(m)[1][:, ::-1]


def _matrix(raw: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f8").reshape(-1, dim)


def _units(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(1))[:, None]


def _tiles(classes: DataFrame, dim: int, axes: np.ndarray) -> DataFrame:
    """(label, tile, low, high, ids, n, vecs): runs of classes by label and place on the first axis; the
    tiles of a label in a partition are numbered on end."""
    label = classes.schema["label"].dataType.simpleString()
    first = axes[:, 0].copy()

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _units(_matrix(batch.column("vec").to_pylist(), dim)) if batch.num_rows else np.zeros((0, dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m @ first)],
                                             names=[*batch.schema.names, "place"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, made, held, of = TaskContext.get().partitionId(), -1, [], None

        def close():
            nonlocal made
            m = _units(_matrix([r["vec"] for r in held], dim)) @ axes[:, :BOX]
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([of], label_type), pa.array([(part << 32) + made], pa.int64()),
                 pa.array([m.min(0).tolist()]), pa.array([m.max(0).tolist()]),
                 pa.array([[r["cid"] for r in held]], pa.list_(pa.int64())),
                 pa.array([[r["n"] for r in held]], pa.list_(pa.int64())),
                 pa.array([b"".join(r["vec"] for r in held)], pa.binary())],
                names=["label", "tile", "low", "high", "ids", "n", "vecs"])

        for batch in batches:
            label_type = batch.schema.field("label").type
            for r in batch.to_pylist():
                if held and (r["label"] != of or len(held) >= TILE):
                    yield close()
                    held.clear()
                of = r["label"]
                held.append(r)
        if held:
            yield close()

    rows = classes.where(F.col("dim") == dim).select("label", "cid", "n", "vec")
    placed = map_batches(rows, place, f"label {label}, cid bigint, n bigint, vec binary, place double")
    ranged = placed.repartitionByRange("label", "place", "cid").sortWithinPartitions("label", "place", "cid")
    return map_batches(ranged, cut, f"label {label}, tile bigint, low array<double>, high array<double>, "
                                    "ids array<bigint>, n array<bigint>, vecs binary")


def candidates(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of unit vectors on principal axes whose product may reach ``least``: partial
    products over the leading axes plus the product of the suffix norms."""
    dim = a.shape[1]
    steps = [s for s in STEPS if s < dim] + [dim]
    part, at = np.zeros((len(a), len(b))), 0
    pairs = None
    for step in steps:
        sa, sb = (np.sqrt(np.maximum((m[:, step:] ** 2).sum(1), 0)) for m in (a, b))
        if pairs is None:
            part += a[:, at:step] @ b[:, at:step].T
            alive = part + sa[:, None] * sb[None] >= least - SLACK
            if step == dim or alive.sum() * 8 <= alive.size:
                pairs = np.nonzero(alive)
                part = part[pairs]
        else:
            i, j = pairs
            more = np.empty(len(i))
            for s in range(0, len(i), 1 << 16):
                t = slice(s, s + (1 << 16))
                more[t] = np.einsum("ij,ij->i", a[i[t], at:step], b[j[t], at:step])
            part = part + more
            alive = part + sa[i] * sb[j] >= least - SLACK
            pairs, part = (i[alive], j[alive]), part[alive]
        at = step
    return pairs


def _blocks(tiles: DataFrame, dim: int) -> DataFrame:
    """(label, tile, block, low, high): the tiles of a label in order, as many to a block as give
    BLOCKS blocks for the largest label, and no more than BLOCK_BYTES hold."""
    own = tiles.groupBy("label", F.shiftright("tile", 32).alias("part")).agg(F.count("*").alias("tiles"), F.min("tile").alias("first"))
    most = own.groupBy("label").agg(F.sum("tiles").alias("n")).agg(F.max("n")).first()[0] or 0
    size = max(1, min(-(-most // BLOCKS), BLOCK_BYTES // (8 * dim * TILE)))
    # a row for each partition that a label has
    before = own.select("label", "part", "first", (F.sum("tiles").over(Window.partitionBy("label").orderBy("part")) - F.col("tiles")).alias("before"))
    return (tiles.select("label", F.shiftright("tile", 32).alias("part"), "tile", "low", "high").join(before, ["label", "part"])
            .select("label", "tile", F.floor((F.col("before") + F.col("tile") - F.col("first")) / size).alias("block"), "low", "high"))


def _shipped(tiles: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (label, one, two, tile, others, ids, n, vecs), those of two blocks together: every tile that
    has a wanted pair there, once, and the tiles to compare it with."""
    of = ["label", "one", "two"]
    sides = wanted.select(*of, F.explode(F.array(F.struct(F.col("ta").alias("tile"), F.col("tb").alias("other")), F.struct(
        F.col("tb").alias("tile"), F.lit(None).cast("bigint").alias("other")))).alias("s"))
    needed = sides.groupBy(*of, F.col("s.tile").alias("tile")).agg(F.collect_list("s.other").alias("others"))  # at most a block
    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as the work isn't in the bytes
    return (needed.join(tiles.select("tile", "ids", "n", "vecs"), "tile").repartition(parts, *of)
            .sortWithinPartitions(*of, "tile"))


def _compare(shipped: DataFrame, dim: int, axes: np.ndarray, least: float) -> DataFrame:
    """(a, b, n): for each pair of tiles the links of a class, counted with repeats (b null), and a
    spanning forest of the links (a, b)."""

    def opened(r: dict) -> tuple:
        x = _matrix([r["vecs"]], dim)
        return x, _units(x) @ axes, np.sqrt((x * x).sum(1)), np.array(r["ids"], np.int64), np.array(r["n"], np.int64)

    def compared(one: tuple, two: tuple, same: bool):
        (x, px, nx, ia, na), (y, py, ny, ib, nb) = one, two
        i, j = candidates(px, py, least)
        if same:
            i, j = i[i < j], j[i < j]
        ok = np.zeros(len(i), bool)
        for s in range(0, len(i), 1 << 16):
            t = slice(s, s + (1 << 16))
            ok[t] = np.einsum("ij,ij->i", x[i[t]], y[j[t]]) / (nx[i[t]] * ny[j[t]]) >= least
        i, j = i[ok], j[ok]
        if not len(i):
            return None
        ca = np.zeros(len(ia), np.int64)
        cb = ca if same else np.zeros(len(ib), np.int64)
        np.add.at(ca, i, nb[j])
        np.add.at(cb, j, na[i])
        tree = forest(i, j if same else j + len(ia), len(ia) + (0 if same else len(ib)))
        names = ia if same else np.concatenate([ia, ib])
        counted = [(ia, ca)] if same else [(ia, ca), (ib, cb)]
        ids = np.concatenate([k[c > 0] for k, c in counted])
        n = np.concatenate([c[c > 0] for _, c in counted])
        ta, tb = names[tree[0]], names[tree[1]]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([ids, ta])),
             pa.array(np.concatenate([np.zeros(len(ids), np.int64), tb]), mask=np.arange(len(ids) + len(ta)) < len(ids)),
             pa.array(np.concatenate([n, np.zeros(len(ta), np.int64)]))], names=["a", "b", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, others = None, {}, {}

        def block():
            for a, bs in others.items():
                for b in bs:
                    found = compared(held[a], held[b], a == b)
                    if found is not None:
                        yield found

        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                key = (repr(r["label"]), r["one"], r["two"])
                if key != of:
                    yield from block()
                    held.clear(), others.clear()
                    of = key
                held[r["tile"]], others[r["tile"]] = opened(r), r["others"]
        yield from block()

    return map_batches(shipped, run, "a bigint, b bigint, n bigint")


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same rows as (i, j) do, at most n: each row to the least of its part."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, low[i], m)
        np.minimum.at(new, low[j], m)
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    at = np.flatnonzero(low != np.arange(n))
    return at, low[at]


def link(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
         least: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: other vectors of its label with cosine
    ``least`` or more, the smallest id reachable, whether that is its own."""
    keyed = stored(_keyed(vectors, id_col, label_col, vec_col), "vectors")
    classes = stored(keyed.where("key is not null").groupBy("key").agg(
        F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec"),
        F.count("*").alias("n"), F.min("id").alias("least")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    dims = [r.dim for r in classes.select("dim").distinct().collect()]
    found = None
    near = 2 - 2 * least + SLACK
    for dim in dims:
        axes = _axes(classes, dim)
        tiles = stored(_tiles(classes, dim, axes), "tiles")
        dealt = _blocks(tiles, dim)
        one, two = (dealt.select("label", *[F.col(c).alias(c + k) for c in ("tile", "block", "low", "high")]) for k in "ab")
        k = min(BOX, dim)
        gap = sum((F.pow(F.greatest(F.lit(0.0), F.col("lowa")[i] - F.col("highb")[i], F.col("lowb")[i] - F.col("higha")[i]), 2)
                   for i in range(k)), F.lit(0.0))
        wanted = one.join(two, "label").where("tilea <= tileb").where(gap <= near).select(
            "label", F.col("blocka").alias("one"), F.col("blockb").alias("two"), F.col("tilea").alias("ta"), F.col("tileb").alias("tb"))
        links = stored(_compare(_shipped(tiles, wanted), dim, axes, least), "links")
        found = links if found is None else found.union(links)
    own = classes.select("key", "cid", "n", "least")
    if found is None:
        named = own.select("key", (F.col("n") - 1).alias("n_links"), F.col("least").alias("component_id"))
    else:
        roots = stored(components(found.where("b is not null").select("a", "b")), "roots")
        counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
        placed = (own.join(counts, own["cid"] == counts["a"], "left").join(roots, own["cid"] == roots["node"], "left")
                  .select("key", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                          F.coalesce("root", "cid").alias("root")))
        least_ = placed.groupBy("root").agg(F.min("least").alias("component_id"))
        named = placed.join(least_, "root").select("key", "n_links", "component_id")
    out = keyed.select("id", "key").join(named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
