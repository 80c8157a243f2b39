import random
import re
from collections import Counter

import public_tokenizers
from conftest import SF_SMALL
from helpers import no_docs, odd_docs, odd_rows, prose

from riskloom.llm import fertility

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(w[j:j + 5]) for j in range(len(w) - 4)]
    n = Counter(runs)
    cover = {j + k for j, x in enumerate(runs) if n[x] > 1 for k in range(5)}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(cover),
            len(w) < 10 or 100 * len(cover) > 20 * len(w))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_counts(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in fertility.measure(docs, PATH).collect():
        assert tuple(r[c] for c in BASE) == brute(texts[r.doc_id])


def test_measures_are_those_of_the_words(spark):
    import numpy as np
    rng = random.Random(4)
    rows = [(1, prose(rng, 80)), (2, " ".join(["same"] * 90)), (3, "日本語 テスト " * 40), (4, prose(rng, 500))]
    pieces = fertility.Pieces(PATH)
    got = {r.doc_id: r for r in fertility.measure(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH).collect()}
    for i, text in rows:
        ids = [x for w in pieces.model.encode(text.split()) for x in w]
        p = np.array(list(Counter(ids).values())) / len(ids)
        assert got[i].n_tokens == len(ids) and abs(got[i].entropy + (p * np.log2(p)).sum()) < 1e-9
        assert abs(got[i].byte_share - pieces.is_byte[ids].mean()) < 1e-12
    assert got[4].kept and not got[2].kept and got[3].script == "east_asian"


def test_bands_hold_at_every_length(spark):
    rng = random.Random(1)

    def junk(n):
        return " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(2, 7))) for _ in range(n))

    def signs(n):
        return " ".join("".join(chr(0xE000 + rng.randrange(3000)) for _ in range(6)) for _ in range(n))

    bad = [junk(12), junk(14), junk(40), junk(200), signs(12), signs(60), " ".join(["same", "word"] * 6)]
    good = ["All human beings are born free and equal in dignity and rights", "The weather was fine and we walked along the river until dark, "
            "then went home and had our supper by the fire while the children told us what they had seen in the woods that day, and nobody slept before midnight",
            "የሰው ልጅ ሁሉ ሲወለድ ነጻና በክብርና በመብትም እኩልነት ያለው ነው። የተፈጥሮ ማስተዋልና ሕሊና ስላለው አንዱ ሌላውን በወንድማማችነት መንፈስ መመልከት ይገባዋል"]
    got = {r.doc_id: r for r in fertility.measure(spark.createDataFrame(list(enumerate(bad + good)), "doc_id bigint, text string"), PATH).collect()}
    assert min(got[i].n_tokens for i in (0, 1)) >= 10 and max(got[i].n_tokens for i in (0, 1)) < 50 <= got[2].n_tokens
    assert not any(got[i].kept for i in range(len(bad)))
    assert all(got[len(bad) + i].kept for i in range(len(good)))


def test_odd_rows(spark):
    got = fertility.measure(odd_docs(spark), PATH).collect()
    assert sorted(str(tuple(r[c] for c in ("doc_id", *BASE))) for r in got) == sorted(
        str((r[0], *brute(r[1]))) for r in odd_rows())
    assert not any(r.kept for r in got if r.base_failed)
    assert fertility.measure(no_docs(spark), PATH).count() == 0
