"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

Three patterns give the base spans. The method adds strings in a sensitive context that the
compressor can't explain: a candidate is compressed by itself, primed with a dictionary of common identifiers
and the text around it; those marginal bytes over its length are its novelty. Words and identifiers that the
dictionary or the surrounding text holds cost little, random strings as much as their characters allow: digits cost
less than letters, so novelty is set against the size of the candidate's own alphabet. ``scan`` and ``redact`` leave
other copies of a candidate out of the text around it, so a secret written twice doesn't explain itself.
Candidates whose letters stand in runs that read like words (nearly all pairs of letters are in the dictionary or around)
and that have few digits are names, paths or dates, not keys. The lines of a key that fill several lines are one candidate.

Spans are in code points, end exclusive. A null or empty text has none; a null id stays null;
repeated rows give repeated rows; an empty table gives no rows; columns other than the id and the
text aren't read by ``scan`` and are passed through by ``redact``. Whole texts of any length are
scanned, in time linear in their length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from math import log2

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import map_batches, map_slices, slices

#: Fixed patterns and kinds, in the order in which spans of equal start stand.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_ASSIGN, MIN_ACCESS = 8, 16

#: Words that make what follows them, on their line or the next ones, sensitive.
SENSITIVE = re.compile(r"pass(?:word|wd|phrase)|pwd|secret|token|credential|bearer|authorization"
                       r"|private[ _-]?key|api[ _-]?key|access[ _-]?key|client[ _-]?key|signature",
                       re.IGNORECASE | re.ASCII)
#: Key characters; the lines below that are made of them alone go on, a shorter one before the end mark of a
#: key too.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_=.~-]{16,}(?=[\x20\t]*(?:\r?\n|\Z)))*"
                       r"(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_=.~-]+(?=[\x20\t]*\r?\n[\x20\t]*-----END))?")
LINE = re.compile(r"[A-Za-z0-9+/_=.~-]+")
RUN = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
LEAST = 16
#: Reach of a sensitive word, code points of context on either side, least novelty: marginal bytes over those of a
#: random string of the candidate's alphabet.
REACH, AROUND, NOVELTY = 80, 512, 0.8
#: Character classes and how many characters each has.
ALPHABETS = ((re.compile("[0-9]"), 10), (re.compile("[a-f]"), 6), (re.compile("[g-z]"), 20), (re.compile("[A-F]"), 6),
             (re.compile("[G-Z]"), 20), (re.compile("[+/_=.~-]"), 7))
#: Names: digits at most, least letters of a run, least part of known pairs in a run and of letters in such runs.
NAME_DIGITS, NAME_RUN, NAME_PAIRS, NAME_LETTERS = 8, 3, 0.75, 0.8
LETTERS = re.compile("[a-z]+")


#: Dictionary content: identifiers and words that code and configuration are made of.
IDENTIFIERS = (
    "abstract access account action address admin alias allow amount application argument array "
    "async attribute authorization available await backend balance base64 bearer binary boolean "
    "branch buffer bucket build bytes cache callback certificate channel char class client cluster "
    "collection column command comment commit config configuration connection console const "
    "constructor container content context controller cookie count create credential currency "
    "current cursor customer database dataset datetime debug default define delete deploy "
    "description destination device dictionary directory disable document domain double driver "
    "dynamic element email enable encoding endpoint engine enum environment error event example "
    "exception execute export expression extends false field filename filter final float folder "
    "format function gateway generate global group handler hash header hostname identifier "
    "implements import include index input insert instance integer interface internal invoice "
    "iterator javascript json kernel key language latest length level library license limit list "
    "local localhost location login manager master matrix maximum member memory message metadata "
    "method minimum model module namespace network node null number object option order output "
    "override package page parameter parent password path pattern payload payment permission "
    "platform pointer policy port prefix private process product profile project property "
    "protected protocol provider proxy public publish query queue random reader receive record "
    "reference region register release remote replace repository request required resource "
    "response result return router sample schedule schema scope script search secret select "
    "sequence serial server service session setting shared signature snapshot source spring "
    "standard start state static status storage stream string struct subscription suffix super "
    "switch system table target template test thread timeout timestamp token transaction true "
    "type undefined unique update upload user username uuid value variable vector version virtual "
    "void warning webhook window worker workspace writer your_api_key your_password changeme "
    "example_token placeholder xxxxxxxxxxxxxxxx 0000000000000000 0123456789 "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ https://www. http:// .com .org .json"
)


def _pairs(text: str) -> set[str]:
    return {x[i:i + 2] for x in LETTERS.findall(text.lower()) for i in range(len(x) - 1)}


class Novelty:
    def __init__(self, identifiers: str):
        self.identifiers, self.pairs = identifiers.encode(), _pairs(identifiers)

    def size(self, own: bytes, around: bytes) -> int:
        """Compressed bytes of ``own`` after the dictionary and ``around``."""
        primed = zstandard.ZstdCompressionDict(self.identifiers + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(c.compress(own)) - len(c.compress(b""))

    def name(self, own: str, sides: str) -> bool:
        """Whether nearly all letters stand in runs that read like words, with few digits (also: neither)."""
        if sum(c.isdigit() for c in own) > NAME_DIGITS:
            return False
        if not any(c.isalnum() for c in own):
            return True
        known, good, letters = self.pairs | _pairs(sides), 0, 0
        for run in LETTERS.findall(own.lower()):
            letters += len(run)
            if len(run) >= NAME_RUN and sum(run[i:i + 2] in known for i in range(len(run) - 1)) >= NAME_PAIRS * (len(run) - 1):
                good += len(run)
        return good > 0 and good >= NAME_LETTERS * letters

    def found(self, text: str, start: int, end: int, lines: list[tuple[int, int]], copies: bool = True) -> bool:
        """Whether the ``lines`` of ``text[start:end]`` cost as much as random strings would after what stands around
        them; without ``copies``, other copies of a line are taken out of that."""
        sides = text[max(0, start - AROUND):start], text[end:end + AROUND]
        cost = random = 0.0
        names = True
        for a, b in lines:
            own = text[a:b]
            around = "\n".join(sides if copies else (x.replace(own, "") for x in sides))
            cost += self.size(own.encode(), around.encode())
            random += len(own) * log2(max(sum(n for kind, n in ALPHABETS if kind.search(own)), 2)) / 8
            names = names and self.name(own, around)
        return cost >= NOVELTY * random and not names


def _apart(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the spans' union, in order."""
    starts, ends = [], []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Runs of key characters that begin within reach after a sensitive word, once each. The words and the runs of the
    text are walked side by side."""
    runs = (m.span() for m in RUN.finditer(text))
    run, at = next(runs, None), 0
    for m in SENSITIVE.finditer(text):
        stop, at = m.end() + REACH, max(at, m.end())
        while run and max(run[0], at) < stop:
            start = max(run[0], at)
            if run[1] - start < LEAST:
                if run[1] > at and run[1] > stop:
                    break  # a later word may still cut into the run
                run = next(runs, None)
                continue
            c = CANDIDATE.match(text, start)
            yield c.span()
            at = c.end()
            while run and run[1] <= at:
                run = next(runs, None)


def find(text: str, novelty: Novelty, copies: bool = True) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of one text, by start, then kind; ``copies``: whether other copies
    of a candidate in its surroundings explain it."""
    if not text:
        return []
    spans = []
    low = text.lower()
    if any(n in low for n in NAMES):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    starts, ends = _apart(spans)
    for start, end in candidates(text):
        lines = [x.span() for x in LINE.finditer(text, start, end)]
        lines = [(a, b) for a, b in lines if (i := bisect_right(ends, a)) == len(ends) or starts[i] >= b]
        if lines and novelty.found(text, start, end, lines, copies):
            spans += [("novel", a, b) for a, b in lines]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): all spans of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        novelty = Novelty(IDENTIFIERS)

        def f(batch: pa.RecordBatch) -> dict:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t or "", novelty, copies=False)]
                     for t in batch.column(text_col).to_pylist()]
            return {id_col: batch.column(id_col), "spans": spans}
        return f

    return map_slices(docs.select(id_col, text_col), make,
                      f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>", text_col)


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with every span, overlapping ones joined, replaced by ``mark``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(IDENTIFIERS)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in slices(batch, text_col):
                texts = [t and cover(t, find(t, novelty, copies=False), mark) for t in part.column(at).to_pylist()]
                yield part.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return map_batches(docs, run, docs.schema)


def cover(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    out, last = [], 0
    for _, a, b in spans:
        if a >= last:
            out += [text[last:a], mark]
        last = max(last, b)
    return "".join([*out, text[last:]]) if out else text
