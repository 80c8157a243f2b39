import base64
import random
from collections import Counter

import corpus_pipeline as P
import public_tokenizers
from conftest import SF_MID, SF_SMALL
from helpers import no_docs, odd_docs
from test_ngram_join import brute
from test_secrets import plain

from riskloom.llm import bpe, langid, mixing
from riskloom.llm.common import stored, table


def test_stages_against_brute_force(spark):
    docs = table(spark, SF_SMALL, "documents")
    seen = []
    for name, stage in P.STAGES:
        out = stored(stage(spark, docs, SF_SMALL), name)
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        seen.append((name, docs.collect(), out.collect(), out))
        docs = out
    (_, raw, known, _), (_, _, single, _), (_, _, clean, clean_df), (_, before, mixed, _), (_, _, ids, ids_df) = seen

    model = langid.fit(table(spark, SF_SMALL, "documents").where(
        "pmod(crc32(cast(cast(doc_id as string) as binary)), 4) <> 2"))
    found = {r.doc_id: r for r in langid.predict(table(spark, SF_SMALL, "documents"), model).collect()}
    assert {r.doc_id for r in known} == {r.doc_id for r in raw if found[r.doc_id].lang_pred != "und" and found[r.doc_id].score >= 0.25}

    groups = brute([(r.doc_id, r.text) for r in known], 5, 80)
    assert len({c for _, _, c in groups}) < len(known)
    assert sorted(r.doc_id for r in single) == sorted(i for i, _, c in groups if i == c)

    texts = {r.doc_id: r.text for r in single}
    assert {r.doc_id for r in clean} == set(texts)
    for r in clean:
        assert (r.text == texts[r.doc_id]) == ("[SECRET]" not in r.text)
        if plain(texts[r.doc_id]):
            assert "[SECRET]" in r.text and not plain(r.text)

    plan = {r.doc_id: r for r in mixing.mix(clean_df).collect()}
    times = Counter(r.doc_id for r in mixed)
    assert all(times.get(i, 0) == (r.epochs + (2 * r.cut >= r.size) if r.size else 0) for i, r in plan.items())
    assert {(r.doc_id, r.text) for r in mixed} <= {(r.doc_id, r.text) for r in before}

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert len(ids) == len(mixed)
    texts = {r.doc_id: r.text for r in mixed}
    assert all(bytes(r.decoded).decode() == texts[r.doc_id] for r in bpe.decode(ids_df, path).collect())


def test_texts_of_no_learned_language_go(spark):
    rng = random.Random(3)
    foreign = ["ภาษาไทยเป็นภาษาที่มีระดับเสียงของคำแน่นอนหรือวรรณยุกต์", "Все люди рождаются свободными и равными в своём достоинстве",
               "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心", "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια",
               "Wszyscy ludzie rodzą się wolni i równi pod względem swojej godności i swych praw.",
               base64.b64encode(rng.randbytes(300)).decode()]
    foreign += [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(n))
                for n in (12, 40, 100, 400)]
    clean = ["All human beings are born free and equal in dignity and rights.", "the dog and the cat",
             "Alle Menschen sind frei und gleich an Würde und Rechten geboren."]
    docs = table(spark, SF_MID, "documents").select("doc_id", "text", "lang")
    more = [(10**9 + i, t, None) for i, t in enumerate(foreign)] + [(2 * 10**9 + i, t, None) for i, t in enumerate(clean)]
    got = P.language_id(spark, docs.union(spark.createDataFrame(more, docs.schema)), SF_MID).collect()
    assert [r.text for r in got if 10**9 <= r.doc_id < 2 * 10**9] == []
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")} | {
        2 * 10**9 + i for i in range(len(clean))}


def test_odd_rows_go_through_every_stage(spark):
    docs = odd_docs(spark)
    sizes = {}
    for name, stage in P.STAGES:
        out = stored(stage(spark, docs, SF_SMALL), name)
        sizes[name] = out.count()
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns, name
    # each stage on the same odd rows: letterless texts go; one row of equal texts stays; none; empty ones go
    assert sizes["language_id"] == 8 and sizes["ngram_jaccard"] == 11 and sizes["secret_scan"] == 13
    assert sizes["bpe_encode"] == 13


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e f g", "en"), (1, "a b c d e f g", "en"), (2, "a b c d e f g", "de"), (3, "", "en"), (3, "", "en"),
            (None, "a b c d e f g", "en"), (4, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = P.ngram_jaccard(spark, docs, SF_SMALL).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter({(1, "a b c d e f g"): 1, (3, ""): 2, (4, None): 1})


def test_empty_table(spark):
    docs = no_docs(spark)
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.count() == 0, name


def test_run_is_registered(spark):
    import __spark_entry__ as E
    assert E.queries()["pipeline"] is P.run and "pipeline" not in E.oracle_sql()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in E.queries()) == 1
