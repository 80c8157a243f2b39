r"""Spelling variant grouping: words one edit apart, found by pivotal grams.

Words are maximal runs of ``[A-Za-zÀ-ÿ]`` with A-Z lower-cased. Of the (document, run) pairs whose
crc32 of ``<id>:<run>`` is a multiple of ``drop_mod`` the run loses one code point, which plants
misspellings; ``drop_mod=0`` counts runs as they are. Words of ``min_chars`` code points or more, found ``min_n``
times or more, are compared.

Join. Bigrams are ordered by how many words hold them, rare ones first. A word's prefix is its three first
bigrams, with every further place of the last of them; dynamic programming over its places chooses two
disjoint bigrams of the prefix with the least count, the pivots. One edit leaves one of two disjoint
bigrams whole. So of two words one edit apart, the one whose last prefix bigram is not the later one has a
pivot that is in the other's prefix, at the same place from the start with all before it unchanged, or at the
same place from the end with all behind it unchanged. The join key is both lengths, that place and the hash of
what is unchanged there, with that half of the remaining side which the edit doesn't lie in, so groups of equal keys
stay small where common bigrams don't. Pairs that meet are compared by a signature and verified by edit distance.

A word's form is its near word of largest n (ties: the smallest in code-point order) if that n is at least
``ratio`` times the word's own, else null; its root is the end of the chain of forms.

Null and empty texts have no words; a null id counts as the empty text; repeated rows count each time; very
long texts and words are worked on whole. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO_ENTRIES, byte_texts, map_batches, mix, slices, stored

#: In UTF-8 U+00C0 to U+00FF are C3 80 to C3 BF; other bytes above 7F begin or go on with other code points.
OTHER = re.compile(rb"[\xc2\xc4-\xf7][\x80-\xbf]+")
LETTERS = bytes(b if 0x61 <= b <= 0x7A or b == 0xC3 or 0x80 <= b <= 0xBF else 0x20 for b in range(256))
#: Disjoint bigrams that are pivots, bigrams of a prefix; buckets of the bigram counts; words worked on together.
PIVOTS, PREFIX, BUCKETS, BATCH = 2, 3, 1 << 16, 4096
#: A word's own steps to a near word's length; an odd number that sets places apart in a key.
STEPS, SPREAD = (-1, 0, 1), 0x9E3779B97F4A7C15
#: Code points of words of one length worked on together.
POINTS = 1 << 20


def runs(text: bytes) -> list[bytes]:
    """The lower-cased runs of a text."""
    text = text.lower()
    if not text.isascii():
        text = OTHER.sub(b" ", text)
    return text.translate(LETTERS).split()


def shorter(run: bytes, h: int) -> bytes:
    """The run without its code point ``h`` % length."""
    s = run.decode()
    at = h % len(s)
    return (s[:at] + s[at + 1:]).encode()


def _moved(crc: int, most: int) -> np.ndarray:
    """What a crc32 so far adds to that of the next 0 to ``most`` bytes: crc32 is linear in its start."""
    zero = b"\0"
    out, own, none = np.zeros(most + 1, np.uint32), crc, 0
    for k in range(most + 1):
        out[k] = own ^ none
        own, none = zlib.crc32(zero, own), zlib.crc32(zero, none)
    return out


#: Runs of more bytes are hashed one by one.
SHORT = 40


class Counts(dict):
    """Run → row of arrays with its crc32, its bytes and how often it was counted."""

    def __init__(self):
        super().__init__()
        self.names: list[bytes] = []
        self.crc, self.size, self.n = np.zeros(1 << 14, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def __missing__(self, run: bytes) -> int:
        at = self[run] = len(self.names)
        if at == len(self.n):
            self.crc, self.size, self.n = (np.concatenate([a, np.zeros_like(a)]) for a in (self.crc, self.size, self.n))
        self.names.append(run)
        self.crc[at], self.size[at] = zlib.crc32(run), len(run)
        return at

    def add(self, base: int, own: list[bytes], drop_mod: int) -> None:
        """Counts the runs of a document whose crc32 begins with ``base``."""
        rows = np.fromiter(map(self.__getitem__, own), np.int64, len(own))
        if drop_mod:
            size = self.size[rows]
            h = self.crc[rows] ^ _moved(base, SHORT)[np.minimum(size, SHORT)]
            for i in np.flatnonzero(size > SHORT).tolist():
                h[i] = zlib.crc32(own[i], base)
            hit = np.flatnonzero(h % np.uint32(drop_mod) == 0)
            if len(hit):
                rows[hit] = [self[shorter(own[i], int(h[i]))] for i in hit.tolist()]
        np.add.at(self.n, rows, 1)


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_mod: int = 97,
          min_chars: int = 5, min_n: int = 3) -> DataFrame:
    """(word, n) of all texts, counted in tasks first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counts()

        def out() -> pa.RecordBatch:
            names = np.array(held.names, object)
            at = np.flatnonzero((held.n[:len(names)] > 0) & (held.size[:len(names)] >= min_chars))
            return pa.RecordBatch.from_arrays([pa.array(names[at], pa.binary()).cast(pa.string()), pa.array(held.n[at])],
                                              names=["word", "n"])

        for batch in batches:
            for part in slices(batch):
                for i, text in zip(part.column("id").to_pylist(), byte_texts(part)):
                    held.add(zlib.crc32(f"{'' if i is None else i}:".encode()), runs(text), drop_mod)
                if len(held) > MEMO_ENTRIES:
                    yield out()
                    held = Counts()
        if held:
            yield out()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(
        (F.col("n") >= min_n) & (F.char_length("word") >= min_chars))


def _by_length(found: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, code points as a matrix) of the words of each length."""
    size = np.fromiter(map(len, found), np.int64, len(found))
    for length in np.unique(size).tolist():
        of = np.flatnonzero(size == length)
        few = max(POINTS // length, 1)
        for at in (of[s:s + few] for s in range(0, len(of), few)):
            yield at, np.frombuffer("".join(found[i] for i in at).encode("utf-32-le"), "<u4").reshape(-1, length).astype(np.uint64)


def _bigrams(points: np.ndarray) -> np.ndarray:
    """Every bigram as one number, in order of its place."""
    return points[:, :-1] << np.uint64(21) | points[:, 1:]


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (mix(grams.copy()) % np.uint64(BUCKETS)).astype(np.int64)


def gram_counts(found: DataFrame) -> np.ndarray:
    """How many words hold a bigram of each bucket. Any order of the bigrams is exact, so buckets may be shared."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, points in _by_length(batch.column("word").to_pylist()):
                b = np.sort(_bucket(_bigrams(points)), axis=1)
                first = np.ones(b.shape, bool)
                first[:, 1:] = b[:, 1:] != b[:, :-1]
                total += np.bincount(b[first], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["b", "n"])

    got = map_batches(found.select("word"), run, "b int, n bigint").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)  # BUCKETS rows at most
    out[got["b"].to_numpy()] = got["n"].to_numpy()
    return out


def pivots(cost: np.ndarray, k: int = PIVOTS) -> np.ndarray:
    """Places of the ``k`` disjoint bigrams of least total cost of every row; infinite costs are out.

    best[p] is the least cost of j bigrams that end at or before place p; the j-th one, if it stands at p, adds to
    the best of j - 1 that end at p - 2 or before."""
    rows, places = np.arange(len(cost)), cost.shape[1]
    ends, best = [], np.zeros_like(cost)
    for j in range(k):
        here = cost.copy()
        if j:
            here[:, :2] = np.inf
            here[:, 2:] += best[:, :-2]
        best = np.minimum.accumulate(here, axis=1)
        # the place that the best up to p ends at: the last one where the minimum fell
        fell = np.ones(here.shape, bool)
        fell[:, 1:] = best[:, 1:] < best[:, :-1]
        ends.append(np.maximum.accumulate(np.where(fell, np.arange(places), 0), axis=1))
    out, at = np.zeros((len(cost), k), np.int64), np.full(len(cost), places - 1)
    for j in reversed(range(k)):
        out[:, j] = ends[j][rows, at]
        at = out[:, j] - 2
    return out


def _sides(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first and of the last 0, 1, 2, ... code points of every word."""
    n, length = points.shape
    out = np.empty((2, length + 1, n), np.uint64)
    out[0, 0], out[1, 0] = 1, 2
    for c in range(length):
        out[0, c + 1] = mix(out[0, c] + points[:, c])
        out[1, c + 1] = mix(out[1, c] + points[:, length - 1 - c])
    return out[0], out[1]


def place_keys(first: np.ndarray, last: np.ndarray, i: np.ndarray, p: np.ndarray, pair: tuple[int, int],
               length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, key) for the bigrams at places ``p`` of words ``i``, if they are to be whole in a pair of words of the
    lengths ``pair``: keys with the bigram at its place from the start and all before it, and keys with its place from
    the end and all behind it. What is left on the other side of the bigram holds the edit, which leaves one of its
    halves as it is: a key each."""
    for side, (own, other, reach) in enumerate(((first, last, p + 2), (last, first, length - p))):
        at = np.flatnonzero(reach <= min(pair))
        j, reach = i[at], reach[at]
        half = (min(pair) - reach) // 2
        tag = reach.astype(np.uint64) * np.uint64(SPREAD) + np.uint64((4 * pair[0] + pair[1] - pair[0] + 1) * 2 + side)
        yield j, mix(mix(own[reach + half, j]) + tag)
        more = half > 0
        j, reach, half = j[more], reach[more], half[more]
        yield j, mix(mix(own[reach, j]) + mix(other[half, j] + tag[more]))


def signatures(points: np.ndarray) -> np.ndarray:
    """Parities of the code points in 32 bits and of the bigrams in 32 more. One edit turns at most two of the former and
    four of the latter."""
    letters = np.bitwise_xor.reduce(np.uint64(1) << (mix(points.copy()) & np.uint64(31)), axis=1)
    pairs = np.bitwise_xor.reduce(np.uint64(1) << (mix(_bigrams(points)) & np.uint64(31)), axis=1)
    return letters | pairs << np.uint64(32)


def _keys(found: DataFrame, counts: np.ndarray, index: bool) -> DataFrame:
    """(key, w, last, sig) of ``found`` (w, word): the places of every word's prefix (``index``) or of its pivots, once for
    each length a near word may have; ``last`` is the rank of the word's last prefix bigram."""
    shared = found.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.argsort(np.argsort(shared.value, kind="stable")).astype(np.uint64)
        for big in batches:
            for start in range(0, big.num_rows, BATCH):
                batch = big.slice(start, BATCH)
                w = batch.column("w").to_numpy()
                for rows, points in _by_length(batch.column("word").to_pylist()):
                    length = points.shape[1]
                    grams = _bigrams(points)
                    bucket = _bucket(grams)
                    order = rank[bucket] << np.uint64(42) | grams
                    end = np.partition(order, PREFIX - 1, axis=1)[:, PREFIX - 1]
                    inside = order <= end[:, None]
                    if index:
                        i, p = np.nonzero(inside)
                    else:
                        p = pivots(np.where(inside, shared.value[bucket], np.inf))
                        i, p = np.repeat(np.arange(len(p)), p.shape[1]), p.ravel()
                    first, last = _sides(points)
                    of, keys = zip(*[x for step in STEPS for x in place_keys(
                        first, last, i, p, (length + step, length) if index else (length, length + step), length)])
                    of = np.concatenate(of)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view(np.int64)), pa.array(w[rows][of]),
                         pa.array((end >> np.uint64(42)).astype(np.int32)[of]), pa.array(signatures(points).view(np.int64)[of])],
                        names=["key", "w", "last", "sig"])

    return map_batches(found.select("w", "word"), run, "key bigint, w bigint, last int, sig bigint")


def near_pairs(found: DataFrame) -> DataFrame:
    """(a, b), a < b: the words of ``found`` (w, word, ...) one inserted, deleted or replaced code point apart."""
    counts = gram_counts(found)
    own = _keys(found, counts, False)
    other = _keys(found, counts, True).withColumnsRenamed({"key": "key2", "w": "w2", "last": "last2", "sig": "sig2"})
    turned = F.col("sig").bitwiseXOR(F.col("sig2"))
    # sizes are estimated from the words, which the keys exceed many times: not to be broadcast
    met = own.join(other.hint("merge"), (F.col("key") == F.col("key2")) & (F.col("w") != F.col("w2")) & (F.col("last") <= F.col("last2"))
                   & (F.bit_count(turned.bitwiseAND(0xFFFFFFFF)) <= 2) & (F.bit_count(F.shiftrightunsigned(turned, 32)) <= 4))
    maybe = met.select(F.least("w", "w2").alias("a"), F.greatest("w", "w2").alias("b")).distinct()
    one, two = (found.select(F.col("w").alias(c), F.col("word").alias(f"word_{c}")) for c in "ab")
    return maybe.join(one, "a").join(two, "b").where(F.levenshtein("word_a", "word_b", 1) == 1).select("a", "b")


def roots(forms: DataFrame, rounds: int) -> DataFrame:
    """(w, root) of ``forms`` (w, form): the end of the chain of forms, by doubling jumps: 2^rounds steps at least."""
    at = forms.select("w", F.col("form").alias("root"))
    for _ in range(rounds):
        onward = at.select(F.col("w").alias("root"), F.col("root").alias("next"))
        at = stored(at.join(onward, "root", "left").select("w", F.coalesce("next", "root").alias("root")), "roots")
    return at


def group(found: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n) of four code points or more."""
    found = stored(found.select("word", "n").withColumn("w", F.monotonically_increasing_id()), "words")
    pairs = stored(near_pairs(found), "near-words")
    sides = pairs.union(pairs.select("b", "a")).toDF("w", "v")
    near = sides.join(found.select(F.col("w").alias("v"), F.col("word").alias("near"), F.col("n").alias("near_n")), "v")
    # the largest n first, then the smallest word
    best = near.groupBy("w").agg(F.count("*").alias("n_near"), F.min(F.struct(
        (-F.col("near_n")).alias("n"), F.col("near").alias("word"), F.col("v").alias("v"))).alias("best"))
    rows = found.join(best, "w", "left").withColumn("to", F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best")))
    rows = stored(rows.select("w", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("to.v").alias("form_w"),
                              F.col("to.word").alias("form"), (-F.col("to.n")).alias("form_n")), "forms")
    # n grows by the ratio with every step of a chain
    span = rows.where("form_w is not null").agg(F.min("n").alias("low"), F.max("form_n").alias("high")).first()
    steps = 0 if span.low is None else int(np.log(span.high / span.low) / np.log(ratio) + 1e-9) + 1
    ends = roots(rows.where("form_w is not null").select("w", F.col("form_w").alias("form")), steps.bit_length())
    named = ends.join(found.select(F.col("w").alias("root"), F.col("word").alias("root_word")), "root").select("w", "root_word")
    return rows.join(named, "w", "left").select(
        "word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.col("n_near").cast("long").alias("n_near"), "form_n")


#: DuckDB SQL for the query's rows: crc32 from its polynomial bit by bit into a table, then byte by byte; near words by
#: equal texts with one code point left out.
ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT range AS i, range AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tbl AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS raw FROM documents),
pairs AS (
  SELECT id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_transform(range(0, octet_length(encode(id || ':' || run)) * 2, 2),
                   lambda p: CAST('0x' || hex(encode(id || ':' || run))[p + 1:p + 2] AS BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295)) AS h
  FROM pairs, tbl),
cut AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
              ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest
         FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS p)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form,
         CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, form AS at FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(e.at, f.word) AS root, f.n, f.n_near, f.form_n FROM forms f LEFT JOIN ends e ON f.word = e.word
"""
