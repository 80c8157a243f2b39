"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pieces of many texts are laid end to end as byte tokens. An inverted index holds,
for every merge, the positions where its token pair stands. Merges are replayed in rank order:
each is applied at all its positions at once, and only the pairs with the touched neighbours are
looked up anew and indexed. Every distinct piece is merged once for all its occurrences.

Rows are independent of each other: a null text is the empty text and has no ids, repeated rows
give repeated rows, a null id stays null, an empty table gives no rows, and columns other than
the id and the text are not read. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Memo, list_array, map_batches, slices

#: Texts of about so many bytes share one replay; bytes of texts that are cut into pieces at a time.
REPLAY_BYTES, CUT_BYTES = 4 << 20, 1 << 20
#: Distinct pieces whose ids a task keeps before it starts anew.
PIECES = 200_000
NONE = np.iinfo(np.int32).max
SHIFT = 20


class Vocabulary:
    """Ranks of byte strings, and the rank that each mergeable pair of ids makes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        made = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    made[(a << SHIFT) + b] = rank
        self.made = made
        self.keys = np.array(sorted(made), np.int64)
        self.rank = np.array([made[k] for k in self.keys.tolist()], np.int32)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where they don't merge."""
        key = (left.astype(np.int64) << SHIFT) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_one(word: bytes, v: Vocabulary) -> list[int]:
    """The merges of one piece, lowest rank first, leftmost first."""
    ids = v.bytes[np.frombuffer(word, np.uint8)].tolist()
    while len(ids) > 1:
        best = min((v.made.get((a << SHIFT) + b, NONE), i) for i, (a, b) in enumerate(zip(ids, ids[1:])))
        if best[0] == NONE:
            break
        ids[best[1]:best[1] + 2] = [best[0]]
    return ids


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def gather(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs ``flat[start:start + n]``, one after another."""
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(start - (ends - n), n)]


def replay(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, ids per piece) of distinct pieces."""
    whole = np.fromiter(map(v.ranks.get, words, repeat(-1)), np.int32, len(words))
    counts = (whole >= 0).astype(np.int64)
    todo = [i for i in np.flatnonzero(whole < 0).tolist() if words[i]]
    if not todo:
        return whole[whole >= 0], counts
    size = np.fromiter((len(words[i]) for i in todo), np.int64, len(todo))
    tok = v.bytes[np.frombuffer(b"".join([words[i] for i in todo]), np.uint8)]
    n, ends = len(tok), np.cumsum(size)
    right = np.arange(1, n + 1, dtype=np.int64)
    right[ends - 1] = -1
    left = np.arange(-1, n - 1, dtype=np.int64)
    left[ends - size] = -1
    rank = np.full(n, NONE, np.int32)
    live = np.ones(n, bool)
    mark = np.zeros(n, bool)
    odd: set[int] = set()  # positions after which a lower merge arose: their pieces are done singly
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def enter(pos: np.ndarray) -> int:
        """Look up the pairs that begin at ``pos`` and index them; the lowest rank among them."""
        pos = pos[right[pos] >= 0]
        r = v.pairs(tok[pos], tok[right[pos]])
        rank[pos] = r
        known = r != NONE
        pos, r = pos[known], r[known]
        if not len(r):
            return NONE
        order = np.argsort(r, kind="stable")
        pos, r = pos[order], r[order]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        for k, part in zip(r[np.r_[0, cuts]].tolist(), np.split(pos, cuts) if len(cuts) else [pos]):
            if k not in index:
                index[k] = []
                heapq.heappush(queue, k)
            index[k].append(part)
        return int(r[0])

    enter(np.flatnonzero(right >= 0))
    while queue:
        k = heapq.heappop(queue)
        found = index.pop(k)
        pos = found[0] if len(found) == 1 else distinct(np.concatenate(found))
        pos = pos[(rank[pos] == k) & live[pos]]
        if not len(pos):
            continue
        gone = right[pos]
        mark[pos] = True
        clash = mark[gone].any()
        mark[pos] = False
        if clash:  # a run such as aaa: leftmost first
            taken, last = [], -1
            for p in np.sort(pos).tolist():
                if p != last:
                    taken.append(p)
                    last = int(right[p])
            pos = np.array(taken, np.int64)
            gone = right[pos]
        after = right[gone]
        tok[pos], live[gone], rank[gone], right[pos] = k, False, NONE, after
        has = after >= 0
        left[after[has]] = pos[has]
        rank[pos] = NONE
        before = left[pos]
        touched = np.concatenate([pos, before[before >= 0]])
        if len(touched) > 1:
            touched = distinct(touched)
        if enter(touched) < k:
            odd.update(touched.tolist())
    own = np.add.reduceat(live.astype(np.int64), ends - size)
    ids = tok[live]
    singly = {j: merge_one(words[todo[j]], v) for j in
              {int(np.searchsorted(ends, p, side="right")) for p in odd}}
    if singly:
        rows = np.split(ids, np.cumsum(own)[:-1])
        for j, row in singly.items():
            rows[j], own[j] = np.array(row, np.int32), len(row)
        ids = np.concatenate(rows)
    counts[todo] = own
    flat = np.concatenate([whole, ids])
    start = np.arange(len(words))
    start[todo] = len(words) + np.cumsum(own) - own
    return gather(flat, start, counts), counts


class Found(dict):
    """Numbers of values in the order of their first appearance."""

    def __missing__(self, value) -> int:
        at = self[value] = len(self)
        return at


class Encoder:
    """Texts to ids. Texts without two neighbouring white-space characters are cut at spaces and
    line ends, where the pattern cuts anyway, and a piece is split and merged once for all its
    occurrences; other texts are split by the pattern as they are."""

    def __init__(self, path: str, pattern: str):
        self.v = vocabulary(path)
        self.split = regex.compile(pattern).findall
        self.doubled = regex.compile(r"\s\s").search
        self.memo = Memo(self._merge, PIECES)

    def _merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = Found()
        flat: list[int] = []
        n = np.zeros(len(pieces), np.int64)
        for i, p in enumerate(pieces):
            if p[:1] == "\x02":
                own = [p[1:]]
            elif p == "\n":
                own = [p]
            else:
                own = self.split(p[1:] if p[:1] == "\x01" else " " + p)
            n[i] = len(own)
            flat += own
        at = np.fromiter(map(found.__getitem__, flat), np.int64, len(flat))
        ids, counts = replay([m.encode() for m in found], self.v)
        start = np.cumsum(counts) - counts
        ends = np.concatenate([[0], np.cumsum(counts[at])])
        cuts = np.concatenate([[0], np.cumsum(n)])
        return gather(ids, start[at], counts[at]), np.diff(ends[cuts])

    def cut(self, text: str) -> list[str]:
        """Pieces of a text: \\x01 marks one without a space before it, \\x02 one match."""
        if not text:
            return []
        if "\x01" in text or "\x02" in text or self.doubled(text):
            return ["\x02" + m for m in self.split(text)]
        return ("\x01" + text.replace("\n", " \n \x01")).split(" ")

    def cut_all(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Pieces of all texts, and how many each has."""
        flat: list[str] = []
        n = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = self.cut(t)
            n[i] = len(own)
            flat += own
        return flat, n


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) of every whole text, by the ranks in ``path``; each match of ``pattern``
    is encoded by itself and no special tokens are made."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids array<int>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(path, pattern)
        held: list[tuple] = []
        size = 0

        def flush():
            memo = coder.memo
            for ids, at, n in held:
                flat = memo.gather(at)
                ends = np.concatenate([[0], np.cumsum(memo.n[at], dtype=np.int64)])
                words = np.concatenate([[0], np.cumsum(n)])
                counts = ends[words[1:]] - ends[words[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(counts), list_array(flat, counts, pa.int32())],
                    names=[id_col, "n_tokens", "ids"])
            held.clear()
            if len(memo) > memo.limit:
                memo.reset()

        for batch in batches:
            for part in slices(batch, text_col, CUT_BYTES):
                texts = [x or "" for x in part.column(text_col).to_pylist()]
                flat, n = coder.cut_all(texts)
                held.append((part.column(id_col), coder.memo.defer(flat), n))
                size += sum(map(len, texts))
                if size >= REPLAY_BYTES:
                    coder.memo.settle()
                    yield from flush()
                    size = 0
        coder.memo.settle()
        yield from flush()

    return map_batches(docs.select(id_col, text_col), run, schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``encoded`` with ``decoded``: the bytes that its ids stand for."""
    kind = encoded.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids array<int>, decoded binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path).tokens
        for batch in batches:
            col = batch.column("ids")
            off = col.offsets.to_numpy()
            ids = col.values.to_numpy()
            texts = [b"".join(map(tokens.__getitem__, ids[a:b].tolist())) for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())],
                                             names=[*batch.schema.names, "decoded"])

    return map_batches(encoded.select(id_col, "n_tokens", "ids"), run, schema)
