"""Substring dedup by sliding sentence spans.

A text is cut into sentences: at full stops, exclamation and question marks and at line ends;
sentences of more than LONGEST words are cut further after words chosen by their hash, so that a
passage is cut alike wherever it stands. Each code point of a script written without spaces is a word
of its own there, and counts as half a word or, in alphabets such as Thai, a quarter.

A run has ``run`` consecutive sentences, and more where these hold fewer than ``least_words`` words:
from each sentence on, and back from each sentence, as many as it takes. So runs cover a passage from its
first sentence to its last wherever it has that many sentences and words, however short they are. Runs are
hashed (128 bits of their words, ASCII letters lower-cased) and joined over all documents. The first occurrence of a run, by id and place, stays; every sentence that a later
occurrence covers is removed with the white space after it.

Rows of equal id are one document: what only they share is no repeat between them (a repeat within
one text is). Null ids come after all others and count as one id. Null texts stay null, empty ones
empty; an empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, filter_bits, hashed_words, map_slices, may_hold, may_hold_udf, mix, stored

RUN, LEAST_WORDS, LONGEST = 3, 12, 16
#: Inside a long sentence, one word in so many ends a piece.
PIECE = 6
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?"]] = True
#: Stops of other scripts.
STOPS = np.array(sorted(map(ord, "\u061f\u06d4\u0964\u0965\u104b\u1362\u17d4\u3002\uff01\uff0e\uff1f\uff61")), np.uint32)
#: First code point of a block and quarters of a word that one of its code points counts as; 0: words
#: are set apart by spaces.
BLOCKS = ((0, 0), (0xE00, 1), (0x10A0, 0), (0x1780, 1), (0x1800, 0), (0x1950, 1), (0x1A00, 0), (0x1A20, 1), (0x1AB0, 0),
          (0x2E80, 2), (0x3130, 0), (0x31A0, 2), (0xA000, 0), (0xF900, 2), (0xFB00, 0), (0xFF00, 2), (0xFFA0, 0),
          (0xFFE0, 2), (0xFFF0, 0), (0x20000, 2), (0x40000, 0))
STARTS, QUARTERS = (np.array(x, np.uint32) for x in zip(*BLOCKS))
SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def wide(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, length, code point) of the code points of two bytes or more that are stops or in
    scripts without spaces."""
    at = np.flatnonzero(buf >= 0xD8)
    size = np.where(buf[at] < 0xE0, 2, np.where(buf[at] < 0xF0, 3, 4))
    point = (buf[at] & (0x7F >> size)).astype(np.uint32)
    for j in range(1, 4):
        more = size > j
        point[more] = point[more] << np.uint32(6) | (buf[at[more] + j] & 0x3F)
    use = (QUARTERS[np.searchsorted(STARTS, point, side="right") - 1] > 0) | np.isin(point, STOPS)
    return at[use], size[use], point[use]


class Sentences:
    """Sentences of some texts: first byte of each, text of each, and runs of them (first sentence
    and number of sentences), in order of place."""

    def __init__(self, texts: list[bytes], run: int, least_words: int):
        joined = b"\n".join(texts).lower()
        buf = np.frombuffer(joined, np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.base = np.cumsum(size) - size
        at, size, point = wide(buf)
        quarters = QUARTERS[np.searchsorted(STARTS, point, side="right") - 1]
        breaks = None
        if quarters.any():
            breaks = np.zeros(len(buf) + 1, bool)
            breaks[at[quarters > 0]] = breaks[(at + size)[quarters > 0]] = True
            breaks = breaks[:-1]
        start, end, word = hashed_words(joined, breaks)
        n = len(start)
        self.of = np.zeros(0, np.int64)
        self.first = self.start = np.zeros(0, np.int64)
        self.h = (np.zeros(0, np.uint64),) * 2
        self.runs = self.length = np.zeros(0, np.int64)
        self.first_run = np.zeros(len(texts), np.int64)
        if not n:
            return
        weight = np.full(n, 4)
        weight[np.searchsorted(start, at[quarters > 0])] = quarters[quarters > 0]
        doc = np.searchsorted(self.base, start, side="right") - 1
        lines = np.cumsum(buf == 10)
        last = STOP[buf[end - 1]]
        stops = np.isin(point, STOPS)
        ends = np.searchsorted(end, (at + size)[stops])
        last[ends[end[ends] == (at + size)[stops]]] = True
        last[:-1] |= lines[start[1:]] > lines[end[:-1] - 1]
        last[-1] = True
        head = np.concatenate([[0], np.flatnonzero(last[:-1]) + 1])
        length = np.diff(np.concatenate([head, [n]]))
        last |= np.repeat(length > LONGEST, length) & (mix(word) % np.uint64(PIECE) == 0)
        head = np.concatenate([[0], np.flatnonzero(last[:-1]) + 1])
        at = np.arange(n) - np.repeat(head, np.diff(np.concatenate([head, [n]])))
        last |= at % LONGEST == LONGEST - 1
        head = np.concatenate([[0], np.flatnonzero(last[:-1]) + 1])
        words = np.diff(np.concatenate([head, [n]]))
        at = (np.arange(n) - np.repeat(head, words)).astype(np.uint64)
        self.start, self.of = start[head], doc[head]
        self.first = np.searchsorted(self.of, np.arange(len(texts)))
        m = len(head)
        if m < run:
            return
        # the shortest runs that begin, and those that end, at each sentence
        total = np.concatenate([[0], np.cumsum(np.add.reduceat(weight, head))])
        place = np.arange(m)
        to = np.maximum(place + run, np.searchsorted(total, total[:-1] + 4 * least_words))
        since = np.minimum(place + 1 - run, np.searchsorted(total, total[1:] - 4 * least_words, side="right") - 1)
        fore = to <= m
        fore[fore] = self.of[to[fore] - 1] == self.of[fore]
        back = since >= 0
        back[back] = self.of[since[back]] == self.of[back]
        back[back] = to[since[back]] != place[back] + 1  # those that are not there yet
        self.runs = np.concatenate([place[fore], since[back]])
        self.length = np.concatenate([to[fore], place[back] + 1]) - self.runs
        order = np.lexsort((self.length, self.runs))
        self.runs, self.length = self.runs[order], self.length[order]
        self.first_run = np.searchsorted(self.of[self.runs], np.arange(len(texts)))
        found = []
        for seed in SEEDS:
            unit = np.add.reduceat(mix(word * seed + at), head)
            h = np.zeros(len(self.runs), np.uint64)
            for j, use in self.steps(np.arange(len(h))):
                h[use] = mix(h[use] * seed + unit[self.runs[use] + j])
            found.append(h)
        self.h = tuple(found)

    def steps(self, runs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(j, those of the given runs that have a sentence j)."""
        j = 0
        while len(runs):
            yield j, runs
            j += 1
            runs = runs[self.length[runs] > j]

    def repeats(self) -> np.ndarray:
        """Of the runs, those that their own text has had before."""
        order = np.lexsort((self.runs, self.h[1], self.h[0], self.of[self.runs]))
        same = np.zeros(len(order), bool)
        a, b = order[1:], order[:-1]
        same[a] = ((self.h[0][a] == self.h[0][b]) & (self.h[1][a] == self.h[1][b])
                   & (self.of[self.runs[a]] == self.of[self.runs[b]]))
        return same


def _spans(docs: DataFrame, id_col: str, text_col: str, run: int, least: int, bits=None) -> DataFrame:
    """(h1, h2, id, at) of each distinct run of each text (at: its number there); with ``bits``, of runs that may be in it,
    and th, the hash of the text."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = None if bits is None else docs.sparkSession.sparkContext.broadcast(bits)
    cols = [F.col(id_col).alias("id"), F.col(text_col).alias("text")]
    if shared:
        cols.append(F.xxhash64(text_col).alias("th"))

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            s = Sentences(byte_texts(batch), run, least)
            keep = ~s.repeats()
            if shared:
                keep &= may_hold(shared.value, s.h[0].view(np.int64))
            at = np.flatnonzero(keep)
            doc = s.of[s.runs[at]]
            out = {"h1": s.h[0][keep].view(np.int64), "h2": s.h[1][keep].view(np.int64),
                   "id": batch.column("id").take(pa.array(doc)), "at": at - s.first_run[doc]}
            if shared:
                out["th"] = batch.column("th").take(pa.array(doc))
            return out
        return f

    return map_slices(docs.select(*cols), make, f"h1 bigint, h2 bigint, id {kind}, at int" + ", th bigint" * bool(shared))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN,
             least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, th, ats, firsts): of each text (th: its hash) the numbers of its runs that a
    document of smaller id has, and those documents."""
    firsts = stored(_spans(docs, id_col, text_col, run, least_words).groupBy("h1", "h2")
                    .agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "runs")
    spans = _spans(docs, id_col, text_col, run, least_words, filter_bits(firsts, "h1"))
    return (spans.join(firsts, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("first")))
            .groupBy("id", "th").agg(F.collect_set("at").alias("ats"), F.array_sort(F.collect_set("first")).alias("firsts")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN,
          least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, text, n_sentences, n_removed, first_in): every text without the sentences that a
    non-first occurrence of a run covers; ``first_in`` lists the documents where these runs stay
    (without those inside the text itself)."""
    found = stored(repeated(docs, id_col, text_col, run, least_words), "repeats")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    hit = may_hold_udf(spark, filter_bits(found, "th"))("th")  # other texts need no join
    rows = rows.withColumn("hit", hit)
    kind = docs.schema[id_col].dataType.simpleString()
    none = F.lit(None).cast("array<int>").alias("ats"), F.array().cast(f"array<{kind}>").alias("firsts")
    marked = found.withColumnsRenamed({"id": "_id", "th": "_th"})
    joined = (rows.where("hit").join(marked, F.col("th").eqNullSafe(F.col("_th")) & F.col("id").eqNullSafe(F.col("_id")), "left")
              .select("id", "text", "ats", F.coalesce("firsts", none[1]).alias("firsts")))
    rows = rows.where("not hit").select("id", "text", *none).union(joined)

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            texts = byte_texts(batch)
            s = Sentences(texts, run, least_words)
            gone = np.zeros(len(s.start), bool)
            marks = [np.flatnonzero(s.repeats())]
            for i, ats in enumerate(batch.column("ats").to_pylist()):
                if ats:
                    marks.append(s.first_run[i] + np.array(ats, np.int64))
            for j, use in s.steps(np.concatenate(marks)):
                gone[s.runs[use] + j] = True
            n = np.bincount(s.of, minlength=len(texts))
            removed = np.bincount(s.of[gone], minlength=len(texts))
            out = batch.column("text").to_pylist()
            for i in np.flatnonzero(removed).tolist():
                a, b = s.first[i], s.first[i] + n[i]
                cuts = np.concatenate([s.start[a:b] - s.base[i], [len(texts[i])]])
                parts = [texts[i][:cuts[0]]]
                parts += [texts[i][cuts[j]:cuts[j + 1]] for j in np.flatnonzero(~gone[a:b]).tolist()]
                out[i] = b"".join(parts).decode()
            return {id_col: batch.column("id"), "text": out, "n_sentences": n, "n_removed": removed, "first_in": batch.column("firsts")}
        return f

    return map_slices(rows, make, f"`{id_col}` {kind}, text string, n_sentences int, n_removed int, first_in array<{kind}>")
