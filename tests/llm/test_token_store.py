import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import no_docs, odd_docs, odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskloom.llm import token_store

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=2000))
def test_codes_round_trip_and_random_access(ids):
    codes = token_store.Codes(token_store.pack(np.array(ids, np.uint32)))
    assert codes.all().tolist() == ids
    assert [codes.at(i) for i in range(0, len(ids), 7)] == ids[::7]
    with pytest.raises(IndexError):
        codes.at(len(ids))


TEXTS = ["", "Don't STOP!! it's 1234,5", "foo.. bar., (baz) a,b 3.14 $%&*** ###", "ÉTÉ Straße İstanbul ΑΣ ός", "e\u0301t\u00e9 Å \u212b ª µ ŉ",
         "日本語 テスト 🎉x", "a\u00a0b\u2003c", "<|endoftext|> x<|startoftext|>", "word. Word, WORD.\nword,\tend.", "'s 't 'll x's", "ﬁ ǆ", "café. naïve, tout,\nça. ", "a×. b÷, c", "x. , y .. z,. w", "«a». b…, c"]


@pytest.mark.parametrize("text", TEXTS)
def test_words_equal_library(text):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    ids, n = token_store.word_ids(PATH).of([text.encode(), b"", text.encode()])
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want + want and n.tolist() == [len(want), 0, len(want)]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abZ éÉ×«'.,!1<|>\n\u0301İΣ日"), max_size=40))
def test_words_equal_library_on_any_text(text):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    assert token_store.word_ids(PATH).of([text.encode()])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


ADDED = ["a <|endoftext|> b", "<|endoftext|>", "<|ENDOFTEXT|> x", "x<|startoftext|>y <|endoftext|><|endoftext|>.", "<| endoftext|> <|", "no mark, at all."]


def test_added_tokens_as_in_the_library(spark, tmp_path):
    tokenizer = Tokenizer.from_file(PATH)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in ADDED]
    assert want[0] == [320, 49407, 321]
    ids, n = token_store.word_ids(PATH, added=True).of([t.encode() for t in ADDED])
    assert ids.tolist() == sum(want, []) and n.tolist() == [len(x) for x in want]
    path = str(tmp_path / "tokens")
    token_store.write(spark.createDataFrame(list(enumerate(ADDED)), "doc_id bigint, text string"), path, PATH, end_id=1)
    got = {r.doc_id: np.frombuffer(bytes(r.tokens), "<u4").tolist() for r in token_store.read(spark, path).collect()}
    assert got == {i: x + [1] for i, x in enumerate(want)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", " ", "a", "É.", "'s", "日", "\n"]), max_size=12))
def test_added_tokens_anywhere(parts):
    text = "".join(parts)
    assert token_store.word_ids(PATH, added=True).of([text.encode()])[0].tolist() == \
        Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_store_equals_library(spark, tmp_path):
    tokenizer = Tokenizer.from_file(PATH)
    path = str(tmp_path / "tokens")
    token_store.write(odd_docs(spark).repartition(3), path, PATH, end_id=1)
    rows = token_store.with_starts(token_store.read(spark, path), path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((r[0] for r in odd_rows()), key=lambda i: -1 if i is None else i)
    want = {}
    for i, text, *_ in odd_rows():
        want.setdefault(i, []).append(tokenizer.encode(text or "", add_special_tokens=False).ids + [1])
    start = 0
    for r in rows:
        ids = np.frombuffer(bytes(r.tokens), "<u4").tolist()
        assert ids in want[r.doc_id] and len(ids) == r.n_tokens and r.start == start
        assert zlib.crc32(bytes(r.tokens)) == zlib.crc32(np.array(ids, "<u4").tobytes())
        if r.n_tokens < 100:
            assert [token_store.token_at(spark, path, start + k) for k in (0, r.n_tokens - 1)] == [ids[0], 1]
        start += r.n_tokens
    assert token_store.token_at(spark, path, start) is None and token_store.token_at(spark, path, -1) is None


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "tokens")
    token_store.write(no_docs(spark), path, PATH, end_id=1)
    assert token_store.with_starts(token_store.read(spark, path), path).count() == 0


def test_one_token_takes_some_bytes_of_a_file(spark, tmp_path, monkeypatch):
    """A store of three files and over a hundred thousand tokens; each of a spread of positions takes under 400 bytes."""
    tokenizer, path, taken = Tokenizer.from_file(PATH), str(tmp_path / "to kens"), []
    texts = [f"{i} the quick brown fox {i * 7919} jumps over " * 60 for i in range(150)]
    monkeypatch.setattr(token_store, "SEGMENT", 9_000)
    token_store.write(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), path, PATH, end_id=1)
    want = [x for t in texts for x in [*tokenizer.encode(t, add_special_tokens=False).ids, 1]]
    real = token_store.PlainFile.__exit__
    monkeypatch.setattr(token_store.PlainFile, "__exit__", lambda self, *a: (taken.append(self.taken), real(self, *a))[1])
    at = [0, 1, len(want) // 3, len(want) // 2, len(want) - 1]
    assert len(want) > 100_000 and [token_store.token_at(spark, path, i) for i in at] == [want[i] for i in at]
    assert len(taken) == len(at) and max(taken) < 400
    assert token_store.token_at(spark, path, len(want)) is None


def test_string_and_null_ids_come_back(spark, tmp_path):
    path = str(tmp_path / "tokens")
    docs = spark.createDataFrame([("a\tb\n\"", "one two"), (None, None), ("é", "")], "name string, text string")
    token_store.write(docs, path, PATH, end_id=1, id_col="name")
    got = {r.name: r.n_tokens for r in token_store.read(spark, path, "name").collect()}
    assert got == {"a\tb\n\"": 3, None: 1, "é": 1}
