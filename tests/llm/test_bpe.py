import hashlib

import public_tokenizers
import pytest
import tiktoken
from helpers import no_docs, odd_docs, odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", " ", "\n", "a  b", " a\n b ", "\n\nx\ty \n", "aaaaaaaa aaaaaaaaaaaaaaaaaaaaaaaaa", "\x01z \x02y", "don't  we'll\r\n x",
         "日本語 テスト 🎉🎉", "Zwölf Boxkämpfer", "x" * 3000, "1234 5678", "a  b", "=" * 70]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(PATH).ranks,
                             special_tokens={})


def one(coder, text):
    flat, _ = coder.cut_all([text])
    return coder.memo.gather(coder.memo.rows(flat)).tolist()


@pytest.mark.parametrize("text", TEXTS)
def test_equals_library(reference, text):
    assert one(bpe.Encoder(PATH, public_tokenizers.PATTERN), text) == reference.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab c\n\té's1.,🎉"), max_size=60))
def test_equals_library_on_any_text(text):
    coder = bpe.Encoder(PATH, public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.v.ranks, special_tokens={})
    assert one(coder, text) == own.encode_ordinary(text)


def test_merges_of_one_piece_agree_with_the_replay():
    v = bpe.vocabulary(PATH)
    words = [w.encode() for w in ("tionstionings", "abcabcabcabc", "zzzzzzzzzzz", "überhaupt", "antidisestablishment")]
    ids, n = bpe.replay(words, v)
    at = 0
    for w, c in zip(words, n.tolist()):
        if w not in v.ranks:
            assert ids[at:at + c].tolist() == bpe.merge_one(w, v)
        at += c


def test_round_trip(spark, reference):
    ids = bpe.encode(odd_docs(spark), PATH, public_tokenizers.PATTERN)
    rows = bpe.decode(ids, PATH).collect()
    want = sorted((str(r[0]), hashlib.md5((r[1] or "").encode()).hexdigest()) for r in odd_rows())
    assert sorted((str(r.doc_id), hashlib.md5(bytes(r.decoded)).hexdigest()) for r in rows) == want
    assert all(reference.decode_bytes(r.ids) == bytes(r.decoded) and r.n_tokens == len(r.ids) for r in rows)


def test_empty_table(spark):
    assert bpe.decode(bpe.encode(no_docs(spark), PATH, public_tokenizers.PATTERN), PATH).count() == 0
