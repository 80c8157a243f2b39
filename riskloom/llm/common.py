"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.prefix import stored  # noqa: F401  (used by the operators)
from riskloom.session import ship_package

#: Texts are worked on in slices of about so many bytes, which bounds a task's memory.
SLICE_BYTES = 4 << 20
#: Entries that a per-task word table holds before it starts anew.
MEMO_ENTRIES = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col, mod: int):
    """crc32(id as text) mod ``mod``; a null id counts as the empty text (0)."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")), F.lit(0)) % mod


def slices(batch: pa.RecordBatch, text: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows of at most ``limit`` text bytes (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    size = np.nan_to_num(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False))
    start, total = 0, 0
    for i in range(n):
        if i > start and total + size[i] > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size[i]
    yield batch.slice(start, n - start)


def map_slices(df: DataFrame, make: Callable, schema: str, text: str = "text") -> DataFrame:
    """``mapInArrow`` over slices: ``make()`` runs once a task and returns
    ``f(batch) -> dict of columns``; the dict is turned into a batch of ``schema``."""
    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema.fields]
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch, text):
                cols = f(part)
                if cols is not None:
                    yield pa.RecordBatch.from_arrays(
                        [_array(cols[n], arrow.field(n).type) for n in names], schema=arrow)

    return map_batches(df, run, schema)


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow``, with the package on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def list_array(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of rows of ``counts`` values each out of ``flat``."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat, kind))


def byte_texts(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    col = batch.column(text)
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def words_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` (what ``bytes.split`` yields) and their count per text."""
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = t.split()
        counts[i] = len(own)
        words += own
    return words, counts


#: ASCII white space, the only separators of words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random value for each byte, powers of an odd base and of its inverse modulo 2^64.
BASE, BLOCK = 0x9E3779B97F4A7C13, 1 << 20
BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(BLOCK + 1, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p, out=p))
    return out[0], out[1]


def hashed_words(joined: bytes, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word: a polynomial in its bytes, out of running sums. Words are also
    cut before the bytes marked in ``breaks``."""
    buf = np.frombuffer(joined, np.uint8)
    space = SPACE[buf]
    ahead = space if breaks is None else space | breaks
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1] if breaks is None else space[:-1] | breaks[1:]]))
    end = np.flatnonzero(~space & np.concatenate([ahead[1:], [True]])) + 1
    power, inverse = _powers()
    h = np.zeros(len(start), np.uint64)
    for a in range(0, len(buf), BLOCK):
        b = min(a + BLOCK, len(buf))
        i, j = np.searchsorted(start, [a, b])
        if i == j:
            continue
        run = np.zeros(b - a + 1, np.uint64)
        np.cumsum(BYTES[buf[a:b]] * power[:b - a], out=run[1:])
        at = start[i:j] - a
        h[i:j] = (run[np.minimum(end[i:j], b) - a] - run[at]) * inverse[at]
        if end[j - 1] > b:  # runs on behind the block
            own, total = buf[start[j - 1]:end[j - 1]], 0
            for k in range(0, len(own), BLOCK):
                part = own[k:k + BLOCK]
                total += int((BYTES[part] * power[:len(part)]).sum()) * pow(BASE, k, 1 << 64)
            h[j - 1] = total % (1 << 64)
    return start, end, mix(h + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def text_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and how many each text has."""
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    start, _, h = hashed_words(b"\n".join(texts))
    return h, np.diff(np.searchsorted(start, np.concatenate([[0], np.cumsum(size)])))


class Memo(dict):
    """Word → row of a compressed list-of-ids table; unknown words are encoded together.

    ``encode(list of words) -> (all ids, ids per word)``. The table starts anew once it holds
    more than ``limit`` words, so its memory is bounded whatever the corpus."""

    def __init__(self, encode: Callable, limit: int = MEMO_ENTRIES):
        super().__init__()
        self.encode, self.limit, self.new = encode, limit, []
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new.clear()
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def __missing__(self, word) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at

    def defer(self, words: list) -> np.ndarray:
        """Rows of the words; those of new ones are filled by the next ``settle``."""
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def settle(self) -> None:
        if self.new:
            self._add(self.encode(self.new))

    def rows(self, words: list) -> np.ndarray:
        if len(self) > self.limit:
            self.reset()
        at = self.defer(words)
        self.settle()
        return at

    def _add(self, coded: tuple[np.ndarray, np.ndarray]) -> None:
        flat, n = coded
        first, total = len(self) - len(self.new), len(flat)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self) > len(self.n):
            self.n = np.concatenate([self.n, np.zeros_like(self.n)])
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.flat[self.used:self.used + total] = flat
        self.start[first:len(self)] = self.used + np.cumsum(n) - n
        self.n[first:len(self)] = n
        self.used += total
        self.new.clear()

    def gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of the rows, one after another."""
        n = self.n[at].astype(np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        pos = np.arange(total) + np.repeat(self.start[at] - (ends - n), n)
        return self.flat[pos]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and shift) on an array."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


FIRST = np.ones(1, bool)


def rolled_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` hashes in a row."""
    n = len(hashes)
    rolled = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k if n >= k else 0):
        rolled = mix(rolled + hashes[j:n - k + 1 + j] + np.uint64(k))
    return rolled


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``k``-word shingles of each text. A shorter text has its
    whole sequence as one shingle, a text without words has none."""
    rolled = rolled_hashes(hashes, k)
    out, at = [], 0
    for c in counts.tolist():
        if c >= k:
            own = np.sort(rolled[at:at + c - k + 1])
            out.append(own[np.concatenate([FIRST, own[1:] != own[:-1]])])
        elif c:
            h = np.zeros(1, np.uint64)
            for j in range(c):
                h = mix(h + hashes[at + j:at + j + 1] + np.uint64(c))
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the graph of ``edges`` (a, b): root is the smallest node reachable.

    Alternating large-star and small-star steps: each links every neighbour of a node to the
    smallest one it knows, until every node hangs on one root. Minima are pre-aggregated and the
    joins have one unique side, so Spark splits the rows of a hub among tasks."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        e = stored(hung.select("u", F.col("m").alias("v"))
                   .union(hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
                   .distinct(), "links")
        # done when no node has two parents, or both a parent and a child
        sides = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            e.select("v", F.lit(0), F.lit(1)))
        if not sides.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").limit(1).count():
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


#: Bits of the filters below; they only save shuffling, so a full one costs time, not rows.
FILTER_BITS = 24


def bits_for(n: int) -> int:
    """Bits of a filter over ``n`` hashes as a power of two: about 16 a hash, from 2^20 up to 2^28
    (32 MB, whatever the data)."""
    return min(max(20, (16 * n).bit_length()), 28)


def filter_bits(hashes: DataFrame, col: str, size: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of 2^``size`` bits with the low bits of every 64-bit hash in ``col`` set; its
    size doesn't depend on the hashes."""
    low = F.pmod(F.col(col), F.lit(1 << size))
    bits = (hashes.select(low.alias("p")).groupBy(F.expr("p div 64").alias("at"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits")).toArrow())
    out = np.zeros(1 << size >> 6, np.int64)
    out[bits["at"].to_numpy()] = bits["bits"].to_numpy()
    return out


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes may be in the bitmap (those in it surely are)."""
    low = hashes.astype(np.int64) & (64 * len(bits) - 1)
    return (bits[low >> 6] >> (low & 63) & 1).astype(bool)


def may_hold_udf(spark: SparkSession, bits: np.ndarray):
    """``may_hold`` as a function of a 64-bit column."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(may_hold(shared.value, h.to_numpy()))
    return test
