"""Token ids in directly addressable codes.

``write`` range-sorts documents by id, encodes their whole texts and packs the ids of each sorted
run into segments; ``read`` gives every document's ids back; ``Codes.at`` reads one token without
decoding its neighbours, and ``token_at`` reads one from the files by byte offsets.

The files are uncompressed text, a line a segment: its numbers, its payload in base64 (three bytes in four characters, so
that any byte has a known place), and ids and lengths of its documents as JSON. The directory holds the file of each
payload and its offset there.

Format of a segment's payload: magic, count and number of levels; then for each level its number
of entries, one byte for each (eight bits of the id, lowest first), and, but for the last level, a
continuation bitmap (bit set: the id goes on in the next level) with a rank directory (set bits
before each 512-bit block). Token i starts with byte i of level 0; where its bit is set, its next
byte stands in the next level at the rank of that bit.

Null and empty texts hold the end id alone. Null ids stand first; rows of equal id are ordered by
a hash of their text, so repeated rows are interchangeable. An empty table writes no segment and
reads back as no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import os
import re
from base64 import b64decode, b64encode
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memo, byte_texts, list_array, map_batches, slices

MAGIC = b"DAC1"
BLOCK = 512
#: Tokens that a segment takes before it is closed.
SEGMENT = 1 << 20
#: Distinct words whose ids a task keeps before it starts anew.
WORDS = 1_000_000
#: A comma or full stop after a letter or digit and before white space is a token of its own.
STOP = re.compile(rb"(?<=[a-z0-9])([.,])(?=[\x20\x09-\x0D]|$)")


def pack(ids: np.ndarray) -> bytes:
    levels, cur = [], ids.astype(np.uint32)
    while True:
        rest = cur >> np.uint32(8)
        goes = rest > 0
        levels.append((cur.astype(np.uint8), goes))
        if not goes.any():
            break
        cur = rest[goes]
    out = [MAGIC, np.array([len(ids), len(levels)], "<u8").tobytes()]
    for i, (chunk, goes) in enumerate(levels):
        out += [np.array([len(chunk)], "<u8").tobytes(), chunk.tobytes()]
        if i + 1 < len(levels):
            per = np.add.reduceat(goes, np.arange(0, len(goes), BLOCK), dtype=np.int64)
            out += [np.packbits(goes, bitorder="little").tobytes(), (np.cumsum(per) - per).astype("<u4").tobytes()]
    return b"".join(out)


def token_of(get: Callable[[int, int], bytes], i: int) -> int:
    """Token ``i`` of a payload of which ``get(offset, length)`` reads some bytes: per level its size, one byte of the
    token, at most a block of the bitmap and one entry of the rank directory."""
    if get(0, 4) != MAGIC:
        raise ValueError("not a payload of directly addressable codes")
    count, levels = (int(x) for x in np.frombuffer(get(4, 16), "<u8"))
    if not 0 <= i < count:
        raise IndexError(i)
    at, value = 20, 0
    for level in range(levels):
        n = int.from_bytes(get(at, 8), "little")
        value |= get(at + 8 + i, 1)[0] << 8 * level
        if level + 1 == levels:
            break
        block, bits = i // BLOCK, at + 8 + n
        ranks = bits + (n + 7) // 8
        own = get(bits + block * BLOCK // 8, (i >> 3) + 1 - block * BLOCK // 8)
        if not own[-1] >> (i & 7) & 1:
            break
        before = own[:-1] + bytes([own[-1] & (1 << (i & 7)) - 1])
        i = int.from_bytes(get(ranks + 4 * block, 4), "little") + int.from_bytes(before, "little").bit_count()
        at = ranks + 4 * ((n + BLOCK - 1) // BLOCK)
    return value


class Codes:
    """A payload, addressed in place."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a payload of directly addressable codes")
        head = np.frombuffer(payload, "<u8", 2, 4)
        self.payload, self.n, at, self.levels = payload, int(head[0]), 20, []
        for i in range(int(head[1])):
            n = int(np.frombuffer(payload, "<u8", 1, at)[0])
            chunk = np.frombuffer(payload, np.uint8, n, at + 8)
            at += 8 + n
            bits = ranks = None
            if i + 1 < int(head[1]):
                bits = np.frombuffer(payload, np.uint8, (n + 7) // 8, at)
                at += len(bits)
                ranks = np.frombuffer(payload, "<u4", (n + BLOCK - 1) // BLOCK, at)
                at += 4 * len(ranks)
            self.levels.append((chunk, bits, ranks))

    def at(self, i: int) -> int:
        """Token ``i``, by one byte of each level it has."""
        return token_of(lambda at, n: self.payload[at:at + n], i)

    def all(self) -> np.ndarray:
        """All tokens, level by level from the last."""
        rest = None
        for chunk, bits, _ in reversed(self.levels):
            value = chunk.astype(np.uint32)
            if bits is not None:
                goes = np.unpackbits(bits, count=len(chunk), bitorder="little").astype(bool)
                value[goes] |= rest << np.uint32(8)
            rest = value
        return rest


#: ASCII characters that are no letter, digit or white space, all as full stops; bytes of texts whose
#: other characters are letters of U+00C0 to U+00FF.
MARKS = bytes(c if c >= 128 or chr(c).isalnum() or c in b"\x20\x09\x0a\x0b\x0c\x0d" else ord(".") for c in range(256))
LATIN = bytes([*range(128), *range(0x80, 0xC0), 0xC3])


def spaced(text: bytes) -> bytes:
    """The lower-case text with a space before commas and full stops that end a word and stand
    alone there, which leaves its tokens as they are."""
    if not text.translate(None, LATIN) and b"\xc3\x97" not in text and b"\xc3\xb7" not in text:
        marks = text.translate(MARKS)
        if b".. " not in marks and b"..\n" not in marks:
            for end in (b". ", b", ", b".\n", b",\n"):
                text = text.replace(end, b" " + end)
            return text
    return STOP.sub(rb" \1", text)


#: Runs that the vocabulary's pattern keeps apart in lower-case ASCII words without apostrophes.
RUNS = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")


class WordIds:
    """Ids of whole texts by a vocabulary that drops white space: a text's ids are those of its
    words, one after another, so each distinct word goes to the tokenizer once.

    Words of Latin letters, and the runs of other ASCII words, need neither the vocabulary's
    normalizer nor its pattern and go to a copy of the tokenizer without them, many in a line;
    each of them ends in a token that ends a word. All other words take the tokenizer as it is.

    Strings of added tokens in a text are ordinary text, or with ``added`` those tokens, as the
    library has it: texts with one go to the unchanged tokenizer as a whole."""

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.whole, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.whole, self.plain):
            t.encode_special_tokens = True  # their strings in a text are ordinary text
        self.library = Tokenizer.from_file(path) if added else None
        self.added = [t.content.lower().encode() for t in self.whole.get_added_tokens_decoder().values()] if added else []
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.memo = Memo(self._encode, WORDS)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts, runs, rest = [], np.zeros(len(words), np.int64), []
        for i, w in enumerate(words):
            t = w.decode().lower()
            if t.isalpha() and (w.isascii() or max(t) < "\u0250"):
                parts.append(t)
                runs[i] = 1
            elif w.isascii() and b"'" not in w:
                own = RUNS.findall(t)
                parts += own
                runs[i] = len(own)
            else:
                rest.append(i)
        lines = [" ".join(parts[i:i + 1024]) for i in range(0, len(parts), 1024)]
        found = [np.array(e.ids, np.int32) for i in range(0, len(lines), 16)
                 for e in self.plain.encode_batch_fast(lines[i:i + 16], add_special_tokens=False)]
        plain = np.concatenate([np.zeros(0, np.int32), *found])
        last = np.concatenate([[0], np.flatnonzero(self.ends[plain]) + 1])
        if len(last) != len(parts) + 1:
            raise ValueError("the vocabulary has tokens that don't end words at their ends")
        n = np.diff(last[np.concatenate([[0], np.cumsum(runs)])])
        if not rest:
            return plain, n
        own = [self.whole.encode(words[i].decode(), add_special_tokens=False).ids for i in rest]
        n[rest] = [len(x) for x in own]
        out = np.empty(int(n.sum()), np.int32)
        where = np.repeat(runs > 0, n)
        out[where] = plain
        out[~where] = np.concatenate([np.array(x, np.int32) for x in own])
        return out, n

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per text)."""
        words: list[bytes] = []
        cuts, own = [0], {}
        for i, t in enumerate(texts):
            low = t.lower()
            if any(a in low for a in self.added):
                own[i] = np.array(self.library.encode(t.decode(), add_special_tokens=False).ids, np.int32)
            else:
                words += spaced(low).split()
            cuts.append(len(words))
        at = self.memo.rows(words)
        ends = np.concatenate([[0], np.cumsum(self.memo.n[at], dtype=np.int64)])
        flat, n = self.memo.gather(at), np.diff(ends[cuts])
        if own:
            parts = np.split(flat, np.cumsum(n)[:-1])
            for i, ids in own.items():
                parts[i], n[i] = ids, len(ids)
            flat = np.concatenate(parts)
        return flat, n


@lru_cache(maxsize=1)
def word_ids(path: str, added: bool = False) -> WordIds:
    """One for all tasks of a worker process, so that a later task finds the words of earlier ones."""
    return WordIds(path, added)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id",
          text_col: str = "text") -> None:
    """Encode and write ``docs`` in ascending order of id: segments under ``path``/segments, and
    under ``path``/directory where each begins, in tokens of the store and in bytes of its file."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["part", "segment", "n_tokens", "ids", "lengths", "payload"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, segment = word_ids(vocabulary, added=True), TaskContext.get().partitionId(), 0
        keys, ids, lengths, held = [], [], [], 0

        def close():
            tokens = np.concatenate(ids)
            key = pa.concat_arrays(keys)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([len(tokens)], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), key),
                 list_array(np.concatenate(lengths), np.array([len(key)]), pa.int64()),
                 pa.array([b64encode(pack(tokens)).decode()], pa.string())], names=names)

        for batch in batches:
            for part_ in slices(batch, text_col):
                flat, n = coder.of(byte_texts(part_, text_col))
                ends = np.cumsum(n)
                keys.append(part_.column(0))
                lengths.append(n + 1)
                ids.append(np.insert(flat, ends, end_id))
                held += len(ids[-1])
                if held >= SEGMENT:
                    yield close()
                    segment, held = segment + 1, 0
                    keys.clear(), ids.clear(), lengths.clear()
        if keys:
            yield close()

    by = [F.col(id_col).asc_nulls_first(), F.xxhash64(text_col).asc()]
    rows = docs.select(id_col, text_col).repartitionByRange(*by).sortWithinPartitions(*by)
    made = map_batches(rows, run, f"part int, segment int, n_tokens bigint, ids array<{kind}>, lengths array<bigint>, payload string")
    (made.select(F.concat_ws("\t", "part", "segment", "n_tokens", "payload",
                             F.to_json(F.struct("ids", "lengths"), {"ignoreNullFields": "false"})).alias("line"))
     .write.option("compression", "none").text(f"{path}/segments"))
    spark = docs.sparkSession
    line = spark.read.text(f"{path}/segments").withColumn("numbers", F.substring_index("value", "\t", 3))
    number = lambda i: F.split_part("numbers", F.lit("\t"), F.lit(i))
    # slim rows, read twice below
    line.select(number(1).cast("int").alias("part"), number(2).cast("int").alias("segment"), number(3).cast("long").alias("n_tokens"),
                F.col("_metadata.file_name").alias("file"), (F.octet_length("value") + 1).cast("long").alias("size"),
                (F.octet_length("numbers") + 1).alias("skip")).write.parquet(f"{path}/lines")
    own = spark.read.parquet(f"{path}/lines")
    parts = own.groupBy("part").agg(F.sum("n_tokens").alias("own")).select(
        "part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("base"))
    inner = Window.partitionBy("part").orderBy("segment")
    (own.join(parts, "part").select(
        "part", "segment", (F.col("base") + F.sum("n_tokens").over(inner) - F.col("n_tokens")).alias("base"), "n_tokens",
        "file", (F.sum("size").over(inner) - F.col("size") + F.col("skip")).alias("byte"))
     .write.parquet(f"{path}/directory"))
    spark.createDataFrame([(f"`{id_col}` {kind}",)], "id string").coalesce(1).write.parquet(f"{path}/kind")


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(part, segment, at, id, n_tokens, tokens) of every document written under ``path``: ``at`` is
    its first token in the segment, ``tokens`` its ids as little-endian 32-bit integers."""
    kind = spark.read.parquet(f"{path}/kind").first()[0].rpartition("` ")[2]
    head = F.from_json(F.substring_index("value", "\t", -1), f"ids array<{kind}>, lengths array<bigint>")
    rows = spark.read.text(f"{path}/segments").withColumn("h", head).select("value", "h.ids", "h.lengths")
    schema = f"part int, segment int, at bigint, `{id_col}` {kind}, n_tokens bigint, tokens binary"
    names = ["part", "segment", "at", id_col, "n_tokens", "tokens"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                part, segment, _, payload, _ = row.column("value")[0].as_py().split("\t", 4)
                tokens = Codes(b64decode(payload)).all().astype("<u4").tobytes()
                key = row.column("ids").flatten()
                n = row.column("lengths").flatten().to_numpy()
                ends = np.cumsum(n)
                for a in range(0, len(key), 1024):
                    b = min(a + 1024, len(key))
                    own = [tokens[4 * (e - m):4 * e] for e, m in zip(ends[a:b].tolist(), n[a:b].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(part)] * (b - a), pa.int32()),
                         pa.array([int(segment)] * (b - a), pa.int32()),
                         pa.array(ends[a:b] - n[a:b], pa.int64()), key.slice(a, b - a),
                         pa.array(n[a:b], pa.int64()), pa.array(own, pa.binary())], names=names)

    return map_batches(rows, run, schema)


def with_starts(documents: DataFrame, path: str) -> DataFrame:
    """Rows of ``read``, or columns made of them, with ``start``: the tokens of all documents before."""
    first = documents.sparkSession.read.parquet(f"{path}/directory").select("part", "segment", "base")
    return documents.join(first, ["part", "segment"]).withColumn("start", F.col("base") + F.col("at")).drop(
        "part", "segment", "at", "base")


def token_at(spark: SparkSession, path: str, position: int) -> int | None:
    """The token at a position of the whole store: a directory row, then some bytes of one file."""
    first = spark.read.parquet(f"{path}/directory").where((F.col("base") <= position) & (F.col("base") + F.col("n_tokens") > position)).first()
    if first is None or position < 0:
        return None
    with PlainFile(spark, f"{path}/segments/{first.file}") as file:
        return token_of(lambda at, n: file.base64(first.byte, at, n), position - first.base)


class PlainFile:
    """A file of any file system that Spark reaches, read by offsets; ``taken`` counts the bytes."""

    def __init__(self, spark: SparkSession, path: str):
        name = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.stream, self.taken = name.getFileSystem(spark._jsc.hadoopConfiguration()).open(name), 0

    def __enter__(self) -> PlainFile:
        return self

    def __exit__(self, *_) -> None:
        self.stream.close()

    def bytes(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        self.taken += n
        return bytes(self.stream.readNBytes(n))

    def base64(self, start: int, at: int, n: int) -> bytes:
        """Bytes ``at`` to ``at + n`` of what stands in base64 from ``start`` on."""
        a, b = at // 3, (at + n + 2) // 3
        return b64decode(self.bytes(start + 4 * a, 4 * (b - a)))[at - 3 * a:at - 3 * a + n]
