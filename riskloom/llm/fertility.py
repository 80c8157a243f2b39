"""Quality rules by tokenizer fertility.

Base counts come from the words and lines of a text. The method tokenizes the words with a public
vocabulary that falls back to bytes and measures, over the whole text, code points per token, the
share of byte-fallback tokens and the entropy of the token ids; a text is rejected where one of
them lies outside the band of its script, however short it is (the entropy asked of a short text is less).
Each distinct word is tokenized once a task; a text's
tokens are those of its words.

Null and empty texts have no words, fail the base rules and aren't kept. Null ids stay null,
repeated rows give repeated rows, an empty table gives no rows; columns other than the id and the
text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, byte_texts, map_slices, mix, text_hashes, words_of

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
#: Base rules: least words, most words in repeated windows of so many words, in percent.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5


@dataclass(frozen=True)
class Band:
    """Accepted range of code points per token, most byte-fallback tokens, least bits of entropy."""
    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float


#: First code point and script of a block, for the scripts that have a band of their own.
BLOCKS = ((0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "semitic"),
          (0x780, "other"), (0x900, "indic"), (0xE00, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
          (0x2000, "other"), (0x2E80, "east_asian"), (0xA000, "other"), (0xAC00, "east_asian"),
          (0xD800, "other"), (0xF900, "east_asian"), (0xFB00, "other"), (0x20000, "east_asian"))
BANDS = {
    "latin": Band(1.45, 8.0, 0.10, 4.3),
    "greek": Band(0.8, 6.0, 0.30, 4.0),
    "cyrillic": Band(0.9, 7.0, 0.20, 4.0),
    "semitic": Band(0.5, 5.0, 0.60, 3.5),
    "indic": Band(0.3, 5.0, 0.90, 3.0),
    "east_asian": Band(0.25, 3.0, 0.95, 3.0),
    "other": Band(0.2, 8.0, 0.90, 2.5),
}
#: The entropy floor holds from so many tokens on; below, it falls as the most that a text's tokens can have.
LEAST_TOKENS = 50
#: Distinct words whose tokens a task keeps before it starts anew.
WORDS = 500_000
STARTS = np.array([a for a, _ in BLOCKS], np.uint32)
NAMES = sorted(BANDS)
OF_BLOCK = np.array([NAMES.index(n) for _, n in BLOCKS])


def script(text: str) -> str:
    """The script with most letters; texts without letters are ``other``."""
    if text.isascii():
        return "latin" if any(c.isalpha() for c in text) else "other"
    letters = "".join(filter(str.isalpha, text))
    if not letters:
        return "other"
    points = np.frombuffer(letters.encode("utf-32-le"), np.uint32)
    if points.max() < STARTS[1]:
        return "latin"
    return NAMES[int(np.bincount(OF_BLOCK[np.searchsorted(STARTS, points, side="right") - 1], minlength=len(NAMES)).argmax())]


def repeated_words(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words of each text in windows of WINDOW words that the text has twice or more."""
    n, k = len(hashes), WINDOW
    out = np.zeros(len(counts), np.int64)
    if n < k:
        return out
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    rolled = mix(doc[:n - k + 1].astype(np.uint64) + np.uint64(k))
    for j in range(k):
        rolled = mix(rolled + hashes[j:n - k + 1 + j])
    at = np.flatnonzero(doc[:n - k + 1] == doc[k - 1:])
    order = at[np.argsort(rolled[at])]
    same = rolled[order[1:]] == rolled[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = twice.copy()
    for j in range(1, k):
        cover[j:] |= twice[:-j]
    sums = np.concatenate([[0], np.cumsum(cover)])
    return sums[ends] - sums[ends - counts]


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


class Pieces:
    """Token ids of words by a sentencepiece vocabulary."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.memo = Memo(self._encode, WORDS)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat, n = [], np.zeros(len(words), np.int64)
        for i in range(0, len(words), 4096):
            for j, own in enumerate(self.model.encode([w.decode() for w in words[i:i + 4096]], num_threads=1), i):
                n[j] = len(own)
                flat += own
        return np.array(flat, np.int32), n

    def measures(self, words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, byte-fallback tokens and entropy in bits of each text."""
        at = self.memo.rows(words)
        ids = self.memo.gather(at)
        ends = np.concatenate([[0], np.cumsum(self.memo.n[at], dtype=np.int64)])
        tokens = np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])
        doc = np.repeat(np.arange(len(counts)), tokens)
        in_bytes = np.bincount(doc[self.is_byte[ids]], minlength=len(counts))
        key = np.sort(doc * len(self.is_byte) + ids)
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, int)
        c = np.diff(cuts)
        inner = np.bincount(key[cuts[:-1]] // len(self.is_byte), c * np.log2(c), minlength=len(counts)) if len(c) \
            else np.zeros(len(counts))
        some = np.maximum(tokens, 1)
        return tokens, in_bytes, np.maximum(np.log2(some) - inner / some, 0)


def measure(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
            bands: dict[str, Band] = BANDS) -> DataFrame:
    """(id, base counts, base_failed, script, n_tokens, chars_per_token, byte_share, entropy, kept)."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"`{id_col}` {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
              "n_repeat_words bigint, base_failed boolean, script string, n_tokens bigint, "
              "chars_per_token double, byte_share double, entropy double, kept boolean")

    def make():
        pieces = Pieces(vocabulary)

        def f(batch: pa.RecordBatch) -> dict:
            texts = byte_texts(batch, text_col)
            words, counts = words_of(texts)
            repeated = repeated_words(text_hashes(texts)[0], counts)
            tokens, in_bytes, entropy = pieces.measures(words, counts)
            chars = np.array([len(t.translate(None, SPACE).decode()) for t in texts], np.int64)
            scripts = [script(t.decode()) for t in texts]
            failed = (counts < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * counts)
            some = np.maximum(tokens, 1)
            per, share = chars / some, in_bytes / some
            low, high, most, least = (np.array([getattr(bands[s], n) for s in scripts]) for n in
                                      ("least_chars", "most_chars", "most_bytes", "least_entropy"))
            least = least * np.minimum(np.log2(some) / np.log2(LEAST_TOKENS), 1)
            inside = (per >= low) & (per <= high) & (share <= most) & (entropy >= least)
            return {id_col: batch.column(id_col), "n_words": counts, "word_chars": chars,
                    "n_symbols": [len(t) - len(t.translate(None, SYMBOLS)) for t in texts],
                    "n_dup_lines": [repeated_lines(t) for t in texts], "n_repeat_words": repeated,
                    "base_failed": failed, "script": scripts, "n_tokens": tokens, "chars_per_token": per,
                    "byte_share": share, "entropy": entropy,
                    "kept": ~failed & inside}
        return f

    return map_slices(docs.select(id_col, text_col), make, schema, text_col)
