r"""Line dedup: explode normalised lines, hash them, count the distinct documents of every hash, drop
the lines of a hash found in too many documents, reassemble the rest by position.

A text is split at ``\n``; a line's key is the line without ``[\x20\x09-\x0D]`` at both ends, A-Z
lower-cased. A key of ``min_chars`` code points or more that ``min_docs`` documents or more hold loses
all its lines in every document, the first ones too. Keys are hashed to 128 bits.

Lines go through shuffles as hashes with an id or a position, never as text. A bitmap of the keys that
go, sized by their number, keeps all other lines out of the join; a text is shuffled only if it loses
lines, and lines to drop are found once for equal texts. Frequent lines and texts are the many
side of joins whose other side is unique, so Spark can split them.

A null or empty text is one empty line (with ``min_chars`` 1 or more empty keys never go). A text that
loses all its lines becomes the empty text. A document is an id: rows that repeat an id count once, null
ids together count as one, and every row is answered by itself. Very long texts are worked on whole, one
at a time. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import bits_for, byte_texts, filter_bits, list_array, map_slices, may_hold, may_hold_udf, stored

#: What is stripped from the ends of a line.
BLANK = b" \t\n\x0b\x0c\r"


def key_of(line: bytes) -> bytes:
    return line.strip(BLANK).lower()  # on bytes: A-Z only


def _chars(key: bytes) -> int:
    return len(key) - sum(0x80 <= b < 0xC0 for b in key) if not key.isascii() else len(key)


def _hashes(keys: list[bytes]) -> np.ndarray:
    """128 bits of each key as two 64-bit columns."""
    return np.frombuffer(b"".join(map(xxh3_128_digest, keys)), "<i8").reshape(-1, 2)


def _long_enough(keys, min_chars: int) -> list[bytes]:
    if min_chars <= 1:
        return [k for k in keys if len(k) >= min_chars]
    return [k for k in keys if _chars(k) >= min_chars]


def frequent_keys(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """(k1, k2): hashes of the keys that ``min_docs`` documents or more hold. ``docs`` (id, text)."""

    def make():
        def lines(batch: pa.RecordBatch) -> dict:
            found, counts = [], []
            for text in byte_texts(batch):
                own = _long_enough(set(map(key_of, text.split(b"\n"))), min_chars)
                found += own
                counts.append(len(own))
            h = _hashes(found)
            return {"id": batch.column("id").take(pa.array(np.repeat(np.arange(len(counts)), counts))),
                    "k1": h[:, 0], "k2": h[:, 1]}
        return lines

    kind = docs.schema["id"].dataType.simpleString()
    held = map_slices(docs, make, f"id {kind}, k1 bigint, k2 bigint").distinct()  # one row a document and key
    return held.groupBy("k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("k1", "k2")


def _places(docs: DataFrame, bits: np.ndarray, min_chars: int) -> DataFrame:
    """(t1, t2, k1, k2, at): for every text and key that may go, where its lines are. ``docs`` (t1, t2, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def make():
        def lines(batch: pa.RecordBatch) -> dict:
            rows, keys, at, n_at, seen = [], [], [], [], set()
            ids = list(zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist()))
            for i, text in enumerate(byte_texts(batch)):
                if ids[i] in seen:
                    continue
                seen.add(ids[i])
                places: dict[bytes, list[int]] = {}
                for p, line in enumerate(text.split(b"\n")):
                    places.setdefault(key_of(line), []).append(p)
                own = _long_enough(places, min_chars)
                keys += own
                rows += [i] * len(own)
                for k in own:
                    at += places[k]
                    n_at.append(len(places[k]))
            h = _hashes(keys)
            hit = may_hold(shared.value, h[:, 0])
            n_at = np.array(n_at, np.int64)
            rows = pa.array(np.array(rows, np.int64)[hit])
            return {"t1": batch.column("t1").take(rows), "t2": batch.column("t2").take(rows),
                    "k1": h[hit, 0], "k2": h[hit, 1],
                    "at": list_array(np.array(at, np.int32)[np.repeat(hit, n_at)], n_at[hit], pa.int32())}
        return lines

    return map_slices(docs, make, "t1 bigint, t2 bigint, k1 bigint, k2 bigint, at array<int>")


def _without(docs: DataFrame) -> DataFrame:
    """(id, text, n_lines, n_dropped) of rows (id, text, at): the lines at ``at`` left out."""

    def make():
        def kept(batch: pa.RecordBatch) -> dict:
            texts, n_lines, n_dropped = [], [], []
            for text, at in zip(byte_texts(batch), batch.column("at").to_pylist()):
                lines = text.split(b"\n")
                gone = set(at or ())
                texts.append(b"\n".join([x for p, x in enumerate(lines) if p not in gone]))
                n_lines.append(len(lines))
                n_dropped.append(len(gone))
            return {"id": batch.column("id"), "text": pa.array(texts, pa.binary()).cast(pa.string()),
                    "n_lines": n_lines, "n_dropped": n_dropped}
        return kept

    kind = docs.schema["id"].dataType.simpleString()
    return map_slices(docs, make, f"id {kind}, text string, n_lines bigint, n_dropped bigint")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10,
          min_chars: int = 1) -> DataFrame:
    """(id, text, n_lines, n_dropped) of every row: the text without the lines whose key ``min_docs``
    documents or more hold, lines before that, lines dropped."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    gone = stored(frequent_keys(slim, min_docs, min_chars), "frequent-lines")
    rows = slim.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(2), "text")})
    places = _places(rows.select("t1", "t2", "text"), filter_bits(gone, "k1", bits_for(gone.count())), min_chars)
    # copies of a text in several tasks bring the same places
    drops = stored(places.join(gone, ["k1", "k2"], "left_semi").distinct().groupBy("t1", "t2").agg(
        F.flatten(F.collect_list("at")).alias("at")), "line-drops")
    touched = may_hold_udf(spark, filter_bits(drops, "t1", bits_for(drops.count())))
    marked = rows.withColumn("hit", touched("t1"))
    cut = _without(marked.where("hit").join(drops, ["t1", "t2"], "left").select("id", "text", "at"))
    text = F.coalesce("text", F.lit(""))
    whole = marked.where("not hit").select(
        "id", text.alias("text"), F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    return whole.union(cut).withColumnRenamed("id", id_col)


#: DuckDB SQL for the query's rows.
ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
gone AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT doc_id, pos, line, k IN (SELECT k FROM gone) AS drop_it FROM keyed)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (drop_it) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT drop_it), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
