"""The corpus pipeline, stage by stage."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_similarity import brute
from tests.llm.test_tokens import WORD, check_pieces


def staged(spark, docs, sf, n):
    for _, stage in corpus_pipeline.STAGES[:n]:
        docs = stage(spark, docs, sf)
    return docs


def test_stages_keep_columns_and_clean_documents(spark, sf, docs):
    told = corpus_pipeline.told_language(spark, docs, sf)
    assert told.columns == docs.columns and told.dtypes == docs.dtypes
    assert told.count() >= docs.where(F.col("text").rlike(r"\p{L}")).count() * 0.99
    left = corpus_pipeline.without_boilerplate(spark, docs, sf)
    assert left.dtypes == docs.dtypes
    assert left.where("n_chars <> length(text)").count() == 0


def test_one_document_of_each_group(spark, sf, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want, _ = brute(texts, 5, 80, 100)
    kept = {r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, docs, sf).collect()}
    assert kept == set(want.values())


def test_pieces_hold_the_masked_documents(spark, sf, docs):
    clean = staged(spark, docs, sf, 4).cache()
    library = Tokenizer.from_file(public_tokenizers.path(WORD))
    want = {r["doc_id"]: library.encode(r["text"], add_special_tokens=False).ids + [1] for r in clean.collect()}
    check_pieces(corpus_pipeline.packed(spark, clean, sf).collect(), want)
    assert not any("@mail" in r["text"] for r in clean.collect())


def test_odd_rows_pass_all_stages(spark, odd, none, sf):
    for n in range(1, 6):
        out = staged(spark, odd, sf, n)
        assert out.count() > 0 and (n == 5 or out.columns == odd.columns)
    assert staged(spark, none, sf, 5).count() == 0
