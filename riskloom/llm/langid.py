"""Language identification by a string kernel.

The blended-spectrum presence kernel of two texts counts the byte n-grams (n = 1, 2, 3, of the
lower-cased text, all that isn't a letter taken as one space) that both have, over the geometric
mean of their counts. n-grams are held in 2^15 hashed slots. The kernel to a few landmark texts of
each language gives the Nystroem features; one-versus-rest kernel ridge regression on them gives a
weight for each landmark and language. A batch of texts is scored by matrix products: presence
rows times landmark rows give the kernel, times the weights the outputs.

The outputs have no bias: a text that shares next to nothing with the landmarks scores about 0.5, and
some texts of a learned language score less. What tells the two apart is the share of a text's n-grams
that the landmarks of the winning language hold. ``identified`` can ask for a part of the share that
all but USUAL of the language's labelled rows have (landmarks are measured against the others), drawn towards
that of all labelled rows where a language has few.

Fitting takes a bounded sample of labelled rows (``max_rows``, the rows of each language of lowest hash of
id and text, rows equal in both once, ties by text); prediction covers all rows and whole texts. Null texts and texts without a letter are
``und`` with score 0, as is everything where there is nothing to learn from. Null ids stay null,
repeated rows give repeated rows, an empty table gives no rows; other columns aren't read by
``predict`` and are passed through by ``identified``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, map_slices, slices, stored

SLOTS = 1 << 15
NONE = "und"
LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that aren't letters count as spaces; bytes of other scripts stay.
FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
SPACES = regex.compile(rb" +")
#: Rows of presence held at once.
ROWS = 128
#: Quantile of the labelled rows of a language whose share of known n-grams is the language's usual one.
#: That of all labelled rows counts as FEW rows beside a language's own.
USUAL, FEW = 0.01, 10


def presence(texts: list[str]) -> np.ndarray:
    """A row for each text, 1 in the slots of the n-grams it has."""
    own = [SPACES.sub(b" ", (" " + t.lower() + " ").encode().translate(FOLD)) for t in texts]
    rows = np.zeros((len(own), SLOTS), np.float32)
    for row, t in zip(rows, own):
        b = np.frombuffer(t, np.uint8).astype(np.uint32)
        row[b] = 1
        two = b[:-1] << 8 | b[1:]
        row[256 + (two * np.uint32(0x9E3779B1) >> np.uint32(20))] = 1  # 2^12 slots
        three = two[:-1] << 8 | b[2:]
        row[8192 + ((three * np.uint32(0x85EBCA6B) >> np.uint32(17)) % (SLOTS - 8192))] = 1
    return rows


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Shared n-grams over the geometric mean of the counts."""
    norm = np.sqrt(np.maximum(rows.sum(1), 1))[:, None] * np.sqrt(np.maximum(landmarks.sum(1), 1))[None]
    return (rows @ landmarks.T) / norm


def shares(rows: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The part of each row's n-grams that each row of ``held`` has."""
    return (rows @ held.T) / np.maximum(rows.sum(1), 1)[:, None]


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # 0/1 rows, packed bits
    weights: np.ndarray    # landmark x language
    held: np.ndarray       # n-grams that a language's landmarks hold, packed bits
    usual: np.ndarray      # least usual share of them in a text of the language

    def outputs(self, rows: np.ndarray) -> np.ndarray:
        return kernel(rows, np.unpackbits(self.landmarks, axis=1).astype(np.float32)) @ self.weights

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.outputs(presence(texts))

    def fits(self, rows: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Shares of the rows' n-grams that their languages ``best`` hold, over the usual ones (1
        where those are 0)."""
        own = shares(rows, np.unpackbits(self.held, axis=1).astype(np.float32))[np.arange(len(rows)), best]
        usual = self.usual[best]
        return np.where(usual > 0, own / np.where(usual > 0, usual, 1), 1)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        max_rows: int = 2400, landmarks: int = 64, ridge: float = 1e-3) -> Model:
    """Fit on at most ``max_rows`` rows (as many for each language, those of lowest hash) with at
    most ``landmarks`` landmarks, also shared out among the languages."""
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
                           F.xxhash64(F.col(id_col), F.col(text_col), F.lit(7)).alias("key")) \
        .withColumn("h", F.pmod("key", F.lit(1 << 30))).where("lang is not null and text is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        none = np.zeros((0, SLOTS // 8), np.uint8)
        return Model([], none, np.zeros((0, 0)), none, np.zeros(0))
    each = max(max_rows // len(counts), 1)
    names = sorted(counts)

    def lowest(some: DataFrame) -> DataFrame:
        once = some.groupBy("lang", "h", "key").agg(F.min("text").alias("text"))
        order = Window.partitionBy("lang").orderBy("h", "key")
        return once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= each).select("lang", "r", "text")

    # a first cut by hash, a little above the number wanted, then the exact one; where repeated rows leave a
    # language too few in the cut, it is ranked without one
    top = F.create_map(*[F.lit(x) for c in names for x in
                         (c, min(1 << 30, int((1 << 30) * (each * 1.5 + 50) / counts[c])))])
    best = stored(lowest(rows.where(F.col("h") < top[F.col("lang")])), "sample")
    held = {r.lang: r["count"] for r in best.groupBy("lang").count().collect()}
    short = [c for c in names if held.get(c, 0) < min(each, counts[c])]
    if short:
        best = best.where(~F.col("lang").isin(short)).union(lowest(rows.where(F.col("lang").isin(short))))

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text").to_pylist()
            packed = [np.packbits(p).tobytes() for i in range(0, len(texts), ROWS)
                      for p in presence(texts[i:i + ROWS]).astype(bool)]
            return {"lang": batch.column("lang"), "r": batch.column("r"), "bits": packed}
        return f

    got = map_slices(best, make, "lang string, r int, bits binary").collect()
    got.sort(key=lambda r: (r.r, r.lang))
    bits = np.frombuffer(b"".join(r.bits for r in got), np.uint8).reshape(len(got), -1)
    marks = bits[:max(landmarks, len(names))]
    full = np.unpackbits(marks, axis=1).astype(np.float32)
    k = np.concatenate([kernel(np.unpackbits(bits[i:i + ROWS], axis=1).astype(np.float32), full)
                        for i in range(0, len(bits), ROWS)]).astype(float)
    of = np.array([names.index(r.lang) for r in got])
    y = np.where(of[:, None] == np.arange(len(names)), 1.0, -1.0)
    # rows of a language weigh as much as those of any other
    w = 1 / np.bincount(of, minlength=len(names))[of][:, None]
    gram = kernel(full, full).astype(float)
    a = k.T @ (w * k) + ridge * gram + 1e-9 * np.eye(len(gram))
    times = np.stack([full[of[:len(full)] == i].sum(0) for i in range(len(names))])
    once, twice = ((times >= n).astype(np.float32) for n in (1, 2))
    share = np.concatenate([shares(np.unpackbits(bits[i:i + ROWS], axis=1).astype(np.float32), once)
                            for i in range(0, len(bits), ROWS)])
    share[:len(full)] = shares(full, twice)  # without the landmark itself
    share = share[np.arange(len(of)), of]
    # a language's only landmark has no others to be measured against
    alone = np.bincount(of[:len(full)], minlength=len(names)) < 2
    known = ~alone[of] | (np.arange(len(of)) >= len(full))
    pooled = np.quantile(share[known], USUAL) if known.any() else 0.0
    usual = np.full(len(names), pooled)
    for i in range(len(names)):
        own = share[known & (of == i)]
        if len(own):
            usual[i] = (np.quantile(own, USUAL) * len(own) + pooled * FEW) / (len(own) + FEW)
    return Model(names, marks, np.linalg.solve(a, k.T @ (w * y)), np.packbits(once.astype(bool), axis=1), usual)


def _predictor(model: Model):
    def f(texts: list, fits: np.ndarray | None = None) -> tuple[list[str], np.ndarray]:
        lang, score = [NONE] * len(texts), np.zeros(len(texts))
        use = [i for i, t in enumerate(texts) if t and model.languages and LETTER.search(t)]
        for i in range(0, len(use), ROWS):
            at = use[i:i + ROWS]
            rows = presence([texts[j] for j in at])
            out = model.outputs(rows)
            best = out.argmax(1)
            if fits is not None:
                fits[at] = model.fits(rows, best)
            score[at] = np.clip((out.max(1) + 1) / 2, 0, 1)
            for j, b in zip(at, best.tolist()):
                lang[j] = model.languages[b]
        return lang, score
    return f


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score); score 0 to 1: half of one plus the winning output."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by landmarks and languages

    def make():
        own = _predictor(shared.value)

        def f(batch: pa.RecordBatch) -> dict:
            lang, score = own(batch.column(text_col).to_pylist())
            return {id_col: batch.column(id_col), "lang_pred": lang, "score": score}
        return f

    return map_slices(docs.select(id_col, text_col), make,
                      f"`{id_col}` {kind}, lang_pred string, score double", text_col)


def identified(docs: DataFrame, model: Model, least: float, text_col: str = "text", least_share: float = 0.0) -> DataFrame:
    """The rows of ``docs`` that are in some learned language with a score of ``least`` or more and
    of whose n-grams it holds ``least_share`` of its usual share or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _predictor(shared.value)
        for batch in batches:
            for part in slices(batch, text_col):
                fits = np.zeros(part.num_rows)
                lang, score = own(part.column(text_col).to_pylist(), fits)
                keep = np.array([x != NONE for x in lang], bool) & (score >= least) & (fits >= least_share)
                yield part.filter(pa.array(keep))

    return map_batches(docs, run, docs.schema)
