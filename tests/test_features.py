import math
import re
from collections import Counter

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from resonance.functions.text import ENGLISH_STOP_WORDS
from resonance.learning import stages
from resonance.operators import features

TEXTS = [
    "The quick brown fox; the lazy dog!",
    "Été à la plage: été, quick fox_2 a b",
    "quick quick QUICK brown",
    "",
    "the and of",
    "dog dog fox brown lazy",
]


def expected_terms(text):
    found = [w for w in re.findall(r"\b\w\w+\b", text.lower()) if w not in ENGLISH_STOP_WORDS]
    return found + [f"{a} {b}" for a, b in zip(found, found[1:])]


def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string").repartition(3)


def expected_tfidf(size):
    docs = [Counter(expected_terms(t)) for t in TEXTS]
    tf, df = Counter(), Counter()
    for d in docs:
        tf.update(d)
        df.update(d.keys())
    vocab = sorted(tf, key=lambda w: (-tf[w], w))[:size]
    out = {}
    for i, d in enumerate(docs):
        w = {t: d[t] * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in vocab if t in d}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out.update({(i, t): v / norm for t, v in w.items()})
    return sorted(vocab), out


def test_stop_words_are_sparks(spark):
    from pyspark.ml.feature import StopWordsRemover

    theirs = StopWordsRemover.loadDefaultStopWords("english")
    assert set(ENGLISH_STOP_WORDS) == {w for w in theirs if "'" not in w}


def test_terms(spark):
    rows = features.with_terms(frame(spark), "t").collect()
    assert {r["id"]: r["terms"] for r in rows} == {i: expected_terms(t) for i, t in enumerate(TEXTS)}


def test_tfidf_long_and_vector_forms_agree_with_the_definition(spark):
    vocab, want = expected_tfidf(8)
    long = {(r["id"], r["term"]): r["weight"] for r in features.tfidf_long(frame(spark), "id", "t", size=8).collect()}
    assert long.keys() == want.keys() and all(abs(long[k] - want[k]) < 1e-12 for k in want)
    model = stages.TfidfVectorizer(inputCol="t", outputCol="v", size=8).fit(frame(spark))
    assert stages.tfidf_terms(model) == vocab
    for r in model.transform(frame(spark)).collect():
        for j, term in enumerate(vocab):
            assert abs(r["v"][j] - want.get((r["id"], term), 0.0)) < 1e-12


def test_vocabulary_comes_from_the_fitted_texts_only(spark):
    model = stages.TfidfVectorizer(inputCol="t", outputCol="v", size=50, ngrams=1).fit(frame(spark).where("id = 2"))
    assert stages.tfidf_terms(model) == ["brown", "quick"]
    assert model.transform(frame(spark).where("id = 1")).first()["v"].numNonzeros() == 1


def test_hashed_embedding(spark):
    rows = {r["id"]: r["e"] for r in features.hashed_embedding(frame(spark), "t", "e").collect()}
    assert all(v.size == 384 for v in rows.values())
    assert abs(rows[0].norm(2) - 1) < 1e-12 and rows[3].norm(2) == 0
    again = features.hashed_embedding(spark.createDataFrame([(TEXTS[0].upper(),)], "t string"), "t", "e").first()["e"]
    assert np.allclose(again.toArray(), rows[0].toArray())


def test_user_encoder_and_width_check(spark):
    def load():
        return lambda texts: np.array([[len(t), 1.0, 2.0] for t in texts])

    rows = features.encoded_embedding(frame(spark), "t", load, "e", dim=3).collect()
    assert {r["id"]: r["e"][0] for r in rows} == {i: float(len(t)) for i, t in enumerate(TEXTS)}
    try:
        features.encoded_embedding(frame(spark), "t", load, "e", dim=4).collect()
    except Exception as e:  # noqa: BLE001
        assert "expected 4" in str(e)
    else:
        raise AssertionError("a wrong width must fail")


def test_word_embeddings_embed_each_word(spark):
    out = features.word_embeddings(frame(spark), "t")
    assert out.count() == sum(len(t.split()) for t in TEXTS)
    assert out.where("word = 'quick'").select(F.countDistinct(vector_to_array("embedding"))).first()[0] == 1


def test_scaler_keeps_constants_at_zero_and_counts_nulls_as_zero(spark):
    df = spark.createDataFrame([(1.0, 5), (3.0, 5), (None, 5)], "a double, b int")
    model = stages.PopulationScaler(inputCols=["a", "b"], outputCol="v").fit(df)
    got = np.array([r["v"].toArray() for r in model.transform(df).collect()])
    a = np.array([1.0, 3.0, 0.0])
    assert np.allclose(got[:, 0], (a - a.mean()) / a.std()) and np.all(got[:, 1] == 0)


def test_category_flags(spark):
    df = spark.createDataFrame([("Poll",), ("Reel",), (None,)], "k string")
    got = [r["v"].toArray().tolist() for r in stages.CategoryFlags(inputCol="k", outputCol="v").transform(df).collect()]
    poll, text = [0, 0, 0, 0, 1, 0, 0], [0, 0, 0, 0, 0, 1, 0]
    assert got == [poll, text, text]
    plain = df.select(features.one_hot(F.col("k")).alias("v")).collect()
    assert plain[1]["v"] == [0.0] * 7


def test_a_constant_has_no_density(spark):
    from resonance.operators import describe

    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert describe.kde(df, "a").count() == 0 and describe.kde(df.limit(1), "b").count() == 0
    assert describe.kde(df, "b").count() == 200


def test_vectors_and_words_of_documents_without_a_label(spark, sf):
    from __spark_entry__ import queries
    from resonance.plans import standins

    labelled = standins.table(spark, sf, "labels").select("doc_id")
    rest = standins.table(spark, sf, "documents").join(labelled, "doc_id", "left_anti")
    with_words = {r["doc_id"] for r in rest.where(F.col("text").rlike(r"[^\s]")).select("doc_id").collect()}
    vectors = queries()["e7_text_embeddings"](spark, sf).join(rest.select("doc_id"), "doc_id").collect()
    lengths = {r["doc_id"]: r["norm"] for r in queries()["e7_embedding_lengths"](spark, sf).collect()}
    assert len(vectors) == rest.count() > 50 and any(r["norm"] for r in vectors)
    assert all(len(r["embedding"]) == 384 and r["norm"] == lengths[r["doc_id"]] for r in vectors)
    words = queries()["r12_all_words_with_post_attributes"](spark, sf).join(rest.select("doc_id"), "doc_id")
    assert {r["doc_id"] for r in words.select("doc_id").distinct().collect()} == with_words
