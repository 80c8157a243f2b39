import random

import numpy as np
from conftest import SF_MID
from helpers import no_docs, odd_docs, odd_rows

from riskloom.llm import langid
from riskloom.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op7_string_kernel_language"](spark, SF_MID).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(docs) and len(held) > 150
    assert np.mean([docs[r.doc_id].lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_kernel_equals_sets():
    texts = ["Der Hund bellt", "the dog barks", "", "éçà"]
    p = langid.presence(texts)
    sets = [set(np.flatnonzero(x)) for x in p]
    k = langid.kernel(p, p)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert abs(k[i, j] - len(a & b) / max(len(a) * len(b), 1) ** 0.5) < 1e-6


def test_odd_rows_and_nothing_to_learn(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(("der", "und", "nicht") if i % 2 else ("the", "and", "not")) for _ in range(9)),
             "de" if i % 2 else "en", None, 0) for i in range(40)]
    model = langid.fit(spark.createDataFrame(rows, no_docs(spark).schema))
    got = langid.predict(odd_docs(spark), model).collect()
    assert len(got) == len(odd_rows())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for i in (1, 2, 3, 7):
        assert (by[i].lang_pred, by[i].score) == ("und", 0)
    assert by[4].lang_pred in ("de", "en")
    kept = langid.identified(odd_docs(spark), model, 0.0)
    assert kept.columns == odd_docs(spark).columns and kept.count() == sum(r.lang_pred != "und" for r in got)
    none = langid.fit(no_docs(spark))
    assert {r.lang_pred for r in langid.predict(odd_docs(spark), none).collect()} == {"und"}
    assert langid.predict(no_docs(spark), model).count() == 0


def test_repeated_and_null_ids(spark):
    rng = random.Random(2)
    words = {"de": ("der", "und", "nicht", "hund"), "en": ("the", "and", "not", "dog")}
    text = lambda c: " ".join(rng.choice(words[c]) for _ in range(9))
    for of in (lambda i: 5, lambda i: None, lambda i: i % 2):
        rows = [(of(i), text("de" if i % 2 else "en"), "de" if i % 2 else "en", None, 0) for i in range(3000)]
        df = spark.createDataFrame(rows, no_docs(spark).schema).repartition(3)
        model = langid.fit(df, max_rows=60)
        assert model.languages == ["de", "en"]
        own = langid.identified(df, model, 0.25, least_share=0.3)
        assert own.count() == 3000
        pred = model.scores([text("de"), text("en")]).argmax(1).tolist()
        assert pred == [0, 1]
    # one text many times, beside a language that the cut by hash leaves out
    rows = [(1, "der hund und der hund", "de", None, 0)] * 4000 + [(i, text("en"), "en", None, 0) for i in range(40)] + [(None, "le chien", "fr", None, 0)]
    model = langid.fit(spark.createDataFrame(rows, no_docs(spark).schema), max_rows=30)
    assert model.languages == ["de", "en", "fr"] and (model.usual > 0).all()
    assert model.scores(["der hund", "the dog and", "le chien"]).argmax(1).tolist() == [0, 1, 2]


def test_few_rows_take_the_pooled_share(spark):
    words = ("the", "and", "not", "dog", "cat", "over", "house")
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(words, k=12)), "en", None, 0) for i in range(200)] + [(900, "der hund bellt", "de", None, 0)]
    model = langid.fit(spark.createDataFrame(rows, no_docs(spark).schema), max_rows=200)
    assert model.languages == ["de", "en"] and abs(model.usual[0] - model.usual[1]) < 0.05 < model.usual[0]
    fits = model.fits(langid.presence(["der hund bellt", "xq zzw vvk"]), np.array([0, 0]))
    assert fits[0] >= 1 > 0.6 > fits[1]
    one = langid.fit(spark.createDataFrame([rows[-1]], no_docs(spark).schema))
    assert one.usual.tolist() == [0] and (one.fits(langid.presence(["xq"]), np.array([0])) == 1).all()
