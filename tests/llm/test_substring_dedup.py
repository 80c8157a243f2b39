import random
from collections import Counter

from helpers import no_docs, odd_docs, odd_rows, prose

from riskloom.llm import substring_dedup


def out(docs):
    return {r.doc_id: r for r in substring_dedup.dedup(docs).collect()}


def test_repeated_passage_stays_once(spark):
    rng = random.Random(2)
    own = [f"w{i}" for i in range(5000)]
    passage = prose(rng, 63)
    rows = [(i, " ".join([prose(rng, 45, own), passage, prose(rng, 45, own)])) for i in range(20)]
    clean = [(100 + i, prose(rng, 90, own)) for i in range(10)]
    r = out(spark.createDataFrame(rows + clean, "doc_id bigint, text string").repartition(4))
    assert r[0].text == rows[0][1] and r[0].n_removed == 0
    for i, text in rows[1:]:
        assert passage not in r[i].text and r[i].text.startswith(text[:150]) and r[i].n_removed >= 5
        assert r[i].first_in == ([0] if i else [])
    for i, text in clean:
        assert r[i].text == text and r[i].n_removed == 0 and r[i].first_in == []


def test_equals_brute_force(spark):
    """Removed sentences are those in a run that an earlier document, or an earlier place, has."""
    rng = random.Random(8)
    blocks = [" ".join(prose(rng, 9) for _ in range(3)) for _ in range(6)]
    rows = [(i, " ".join(rng.choice(blocks) for _ in range(rng.randrange(1, 5)))) for i in range(40)]
    r = out(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    seen = set()
    for i, text in rows:
        s = [x + "." for x in text.split(".") if x.strip()]
        gone, own = set(), set()
        for j in range(len(s) - 2):
            run = tuple(x.strip().lower() for x in s[j:j + 3])
            if run in seen or run in own:
                gone |= {j, j + 1, j + 2}
            own.add(run)
        seen |= own
        assert r[i].text.split() == "".join(x for j, x in enumerate(s) if j not in gone).split(), i
        assert (r[i].n_sentences, r[i].n_removed) == (len(s), len(gone))


def test_long_sentence_without_stops(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(80))
    rows = [(i, f"a{i} b{i} c{i} {passage} d{i} e{i}") for i in range(5)]
    r = out(spark.createDataFrame(rows, "doc_id bigint, text string"))
    words = Counter(w for x in r.values() for w in x.text.split())
    assert sum(words[w] > 1 for w in passage.split()) < 30  # all but the ends of the passage


def test_short_lines_and_unspaced_text(spark):
    """Passages of 60 words in sentences or lines of 2 and 3 words, and of scripts without spaces, go whole."""
    rng = random.Random(5)

    def short(end):
        return end.join(" ".join(f"k{rng.randrange(10**6)}" for _ in range(n)) for n in [2, 3] * 12) + end

    def signs(first, n, many):
        return "".join(chr(first + rng.randrange(many)) for _ in range(n))

    passages = [short(". "), short("\n"), short("!\n"), "".join(signs(0x4E00, rng.randrange(3, 30), 5000) + "。" for _ in range(12)),
                "\n".join(signs(0x3041, 8, 80) for _ in range(12)), " ".join(signs(0x0E01, 20, 46) for _ in range(8)) + ".",
                " ".join([f"k{rng.randrange(10**6)} w{i}." for i in range(5)] + [f"{prose(rng, 9)} {rng.random()} end."] * 1
                         + [f"t{rng.randrange(10**6)}." for _ in range(4)])]
    for k, passage in enumerate(passages):
        rows = [(i, f"{prose(rng, 36, [f'o{i}x{j}' for j in range(900)])}\n{passage}\nZ{i} {prose(rng, 36, [f'q{i}x{j}' for j in range(900)])}")
                for i in range(4)]
        r = out(spark.createDataFrame(rows, "doc_id bigint, text string"))
        assert r[0].text == rows[0][1] and r[0].n_removed == 0
        for i, text in rows[1:]:
            before, after = text.split(passage)
            assert r[i].text.split() == (before + after).split(), (k, i)
            assert r[i].first_in == [0]
    few = [(i, f"a{i} b. Yes. No. Oh. z{i} c.") for i in range(3)]  # fewer than 12 words in common
    assert all(x.n_removed == 0 for x in out(spark.createDataFrame(few, "doc_id bigint, text string")).values())


def test_odd_rows(spark):
    got = substring_dedup.dedup(odd_docs(spark)).collect()
    assert len(got) == len(odd_rows())
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].text is None and by[2][0].text == "" and by[3][0].text == " \n\t "
    texts = {r[0]: r[1] for r in odd_rows()}
    assert by[5][0].text == texts[5] and by[8][0].text == texts[8]
    # rows of one id are no repeats of each other; a null id comes last
    assert all(r.n_removed == 0 for r in by[4])
    assert max(r.n_removed for r in by[None]) > 0


def test_empty_table(spark):
    assert substring_dedup.dedup(no_docs(spark)).count() == 0
