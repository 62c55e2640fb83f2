import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.llm import langid as L


def corpus(n=240):
    rnd = random.Random(5)
    parts = {"en": ["the", "ing", "wh", "ow", "sh"], "fr": ["é", "eau", "que", "ç", "oi"], "de": ["sch", "ung", "ä", "pf", "ß"]}
    rows = []
    for k in range(n):
        lang = rnd.choice(list(parts))
        rows.append((k, " ".join("".join(rnd.choices(parts[lang], k=3)) for _ in range(rnd.randint(5, 60))), lang))
    return rows


def test_held_out_accuracy_and_defined_cases(spark):
    odd = [(1000, None, "en"), (1001, "", "fr"), (1002, "12 !! 3", "de"), (1003, "the showing" * 3, None), (1004, "ñ", "en"), (1005, "日本語のテキスト" * 40, "ja")]
    rows = corpus() + odd
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string").repartition(4)
    out = {r.doc_id: r for r in L.identify(docs, L.fit(docs, L.fold() != 0)).withColumn("held_out", L.fold() == 0).collect()}
    held = [r for r in rows[:240] if out[r[0]].held_out]
    assert len(held) > 30 and sum(out[k].lang_pred == lang for k, _, lang in held) / len(held) > 0.97
    assert all(out[k].lang_pred == "und" and out[k].score == 0 for k in (1000, 1001, 1002))
    assert out[1003].lang_pred == "en" and all(0 <= r.score <= 1 for r in out.values())
    kept = L.keep_identified(docs, L.fit(docs, F.lit(True)))
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in L.identify(docs, L.fit(docs, F.lit(True))).collect()] == [(1, "und", 0.0)]
    assert L.identify(docs.limit(0), L.fit(docs.limit(0), F.lit(True))).count() == 0


def test_bundles_equal_the_definition():
    texts = ["Abc é!", "zz top", "", "q"]
    v, letters = L.bundles(texts, 128)
    for t, got in zip(texts, v, strict=True):
        s = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        total = np.zeros(128)
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            x, y, z = (L.letter_vectors(np.array([ord(k)]), 128)[0].astype(int) for k in (a, b, c))
            total += np.roll(x, 2) * np.roll(y, 1) * z
        total = total / np.linalg.norm(total) if any(k.isalpha() for k in t) else total * 0
        assert np.allclose(got, total, atol=1e-5)
    assert letters.tolist() == [4, 5, 0, 1]


def test_small_samples_repeated_rows_and_long_texts(spark):
    rows = corpus(60) + [(k, t, lang) for k, t, lang in corpus(5)] + [(900, "the showing wh " * 40_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("score", "lang_pred", "salt", "rank")})
    for most in (1, 3, 15):
        names, _ = L.fit(docs, F.lit(True), per_language=most)
        assert names == ["de", "en", "fr"]
    out = L.identify(docs, L.fit(docs, F.lit(True))).collect()
    assert len(out) == len(rows) and {r.lang_pred for r in out if r.doc_id == 900} == {"en"}


def test_prediction_equals_brute_force():
    """Language and score of whole texts from the definition: all n-grams, their vectors, prototypes, cosines."""
    rows = corpus(40)
    gram = {}

    def vector(t):
        s = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        total = np.zeros(L.DIMENSIONS)
        for g in zip(s, s[1:], s[2:], strict=False):
            if g not in gram:
                x, y, z = (L.letter_vectors(np.array([ord(k)]))[0].astype(int) for k in g)
                gram[g] = np.roll(x, 2) * np.roll(y, 1) * z
            total += gram[g]
        return total / np.linalg.norm(total)

    v = np.array([vector(t) for _, t, _ in rows])
    langs = np.array([lang for *_, lang in rows])
    names = sorted(set(langs))
    own = np.array([v[langs == n].sum(axis=0) for n in names])
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    predicted, score = L.predictor(names, own.astype(np.float32))([t for _, t, _ in rows])
    cosine = v @ own.T
    assert predicted == [names[k] for k in cosine.argmax(axis=1)]
    assert np.allclose(score, np.clip(cosine.max(axis=1), 0, 1), atol=1e-4)


def test_ties_go_to_the_first_name():
    one = np.eye(1, L.DIMENSIONS, dtype=np.float32)
    assert L.predictor(["x", "y"], np.concatenate([one, one]))(["some text"])[0] == ["x"]


def test_too_many_languages_fail(spark, monkeypatch):
    monkeypatch.setattr(L, "LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2"):
        L.fit(spark.createDataFrame(corpus(60), "doc_id long, text string, lang string"), F.lit(True))


def test_sample_is_bounded(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "en").otherwise("fr").alias("lang"))
    got = {r.lang: r["count"] for r in L.sample(rows, 64).groupBy("lang").count().collect()}
    assert set(got) == {"en", "fr"} and all(40 <= n <= 64 for n in got.values())
