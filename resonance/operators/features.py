"""Feature lists and text, category and numeric features as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resonance.functions import scalars as S
from resonance.functions.text import ENGLISH_STOP_WORDS, terms_sql, tokens_sql

# The feature lists of the four kinds of model, text sizes.
BASELINE = ("weekday", "hour", "month", "impressions")
TEXT = ("weekday", "hour", "month", "reactions", "comments", "reposts", "saves")
TUNING = ("weekday", "month", "hour", "impressions", "reactions", "comments", "reposts", "saves")
SCORING = ("impressions", "reactions", "comments", "reposts", "saves", "likes")
VOCABULARY_SIZE = 3000
EMBEDDING_SIZE = 384

BROADCAST_TERMS = 200_000

# The target is (reactions + comments + reposts) / impressions, so lists that
# hold those columns give the answer away. These do not.
LEAK_FREE = {
    "baseline": ("weekday", "hour", "month"),
    "text": ("weekday", "hour", "month"),
    "tuning": ("weekday", "month", "hour"),
    "scoring": (),
}


def population_stats(df: DataFrame, cols: Sequence[str]) -> Column:
    """Mean and population deviation of each column as a scalar subquery; nulls count as 0, as in the models' scaler.

    A constant column has deviation 1, so that scaling leaves it at 0.
    """
    parts = []
    for c in cols:
        number = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        sd = F.stddev_pop(number)
        parts += [F.avg(number).alias(f"{c}_mean"), F.when(sd > 0, sd).otherwise(1.0).alias(f"{c}_sd")]
    stats = df.agg(*parts)
    return stats.select(F.struct(*stats.columns).alias("s")).scalar()


def standard_scale(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Replace each column by its standard score over ``fit_on`` (default: ``df``); a null counts as 0."""
    stats = population_stats(fit_on if fit_on is not None else df, cols)
    scaled = {
        c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.col("_s")[f"{c}_mean"]) / F.col("_s")[f"{c}_sd"] for c in cols
    }
    return df.withColumn("_s", stats).withColumns(scaled).drop("_s")


def one_hot(c: Column, categories: Iterable[str] = S.POST_TYPES) -> Column:
    """0/1 array over the categories in alphabetical order; unknown or null is all 0."""
    return F.array(*[F.when(c == k, 1.0).otherwise(0.0) for k in sorted(categories)])


def with_terms(df: DataFrame, text: str, out: str = "terms", ngrams: int = 2,
               stop_words: Iterable[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """Add the words and word pairs of a text as an array column."""
    return (
        df.withColumn("_tokens", F.expr(tokens_sql(text, stop_words)))
        .withColumn(out, F.expr(terms_sql("_tokens", ngrams)))
        .drop("_tokens")
    )


def exploded(df: DataFrame, keep: Sequence[str], array: Column, name: str, pos: str | None = None) -> DataFrame:
    """``keep`` and one row per entry of ``array``, whose entries are not null.

    From a plain explode Spark infers the filter "the array is not empty" and
    pushes it down to the scan, where it builds the whole array a second time.
    """
    names = [pos, name] if pos else [name]
    generate = F.posexplode_outer(array) if pos else F.explode_outer(array)
    return df.select(*keep, generate.alias(*names)).where(F.col(name).isNotNull())


def term_counts(df: DataFrame, doc_id: str, text: str, **options) -> DataFrame:
    """``doc_id, term, tf``; the counts are complete before the shuffle."""
    return (
        exploded(with_terms(df.select(doc_id, text), text, **options), [doc_id], F.col("terms"), "term")
        .groupBy(doc_id, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


TERM_SCHEMA = "term string, tf long, df long"


def _batch_terms(batch: pa.RecordBatch, ngrams: int) -> Iterator[pa.RecordBatch]:
    """Term, occurrences and number of texts in a batch of token lists: words, then pairs of neighbours if wanted.

    Words are numbered, so that a pair is one number; only the distinct pairs become strings.
    """
    tokens = batch.column(0)
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    coded = tokens.flatten().dictionary_encode()
    names, words = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    texts = np.repeat(np.arange(len(sizes)), sizes)
    if not len(words):
        return
    keys, tf, df = _counted(words, texts)
    yield _term_batch(names.take(pa.array(keys)), tf, df)
    beside = texts[1:] == texts[:-1]
    if ngrams > 1 and beside.any():
        keys, tf, df = _counted((words[:-1] * len(names) + words[1:])[beside], texts[1:][beside])
        first, second = (names.take(pa.array(k)) for k in divmod(keys, len(names)))
        yield _term_batch(pc.binary_join_element_wise(first, second, " "), tf, df)


def _counted(keys: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, how often each comes, and in how many texts; ``texts`` ascends."""
    order = np.argsort(keys, kind="stable")
    keys, texts = keys[order], texts[order]
    new = np.r_[True, keys[1:] != keys[:-1]]
    starts = np.flatnonzero(new)
    in_texts = np.add.reduceat((new | np.r_[True, texts[1:] != texts[:-1]]).astype(np.int64), starts)
    return keys[starts], np.diff(np.r_[starts, len(keys)]), in_texts


def _term_batch(terms: pa.Array, tf: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
    columns = [terms.cast(pa.string()), pa.array(tf, pa.int64()), pa.array(df, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["term", "tf", "df"])


def vocabulary(df: DataFrame, text: str, size: int = VOCABULARY_SIZE, ngrams: int = 2,
               stop_words: Iterable[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """The most frequent terms: ``term, tf, df``; ties go by term.

    One shuffle, of partial sums per term: a batch of texts counts its terms, and in how many texts each is, before they
    leave Python.
    """
    terms_sql("_tokens", ngrams)  # refuses other lengths

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batch_terms(batch, ngrams)

    return (
        df.select(F.expr(tokens_sql(text, stop_words)).alias("_tokens"))
        .mapInArrow(count, TERM_SCHEMA)
        .groupBy("term")
        .agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
        .orderBy(F.col("tf").desc(), "term")
        .limit(size)
    )


def tfidf_long(df: DataFrame, doc_id: str, text: str, fit_on: DataFrame | None = None,
               size: int = VOCABULARY_SIZE, **options) -> DataFrame:
    """TF-IDF weights of the vocabulary's terms: ``doc_id, term, weight``.

    Weight is tf * (ln((1 + n) / (1 + df)) + 1), each text scaled to length 1;
    vocabulary and n come from ``fit_on``. The vocabulary has at most ``size``
    rows; up to ``BROADCAST_TERMS`` it is broadcast, and only its terms are shuffled.
    """
    source = fit_on if fit_on is not None else df
    n_docs = source.select(F.count(text).alias("n")).scalar()
    idf = F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1
    vocab = vocabulary(source, text, size, **options).withColumn("_n", n_docs).select("term", idf.alias("idf"))
    weights = (
        exploded(with_terms(df.select(doc_id, text).where(F.col(doc_id).isNotNull()), text, **options), [doc_id], F.col("terms"), "term")
        .join(F.broadcast(vocab) if size <= BROADCAST_TERMS else vocab, "term")
        .groupBy(doc_id, "term", "idf")
        .agg(F.count(F.lit(1)).alias("tf"))
        .select(doc_id, F.struct("term", (F.col("tf") * F.col("idf")).alias("w")).alias("e"))
    )
    # A text's terms meet as one array, so that their length needs no second pass over the texts.
    whole = weights.groupBy(doc_id).agg(F.collect_list("e").alias("_e"))
    norm = F.sqrt(F.aggregate("_e", F.lit(0.0), lambda a, e: a + e["w"] * e["w"]))
    each = whole.select(doc_id, norm.alias("_norm"), F.explode_outer("_e").alias("e"))
    return each.select(doc_id, "e.term", (F.col("e.w") / F.col("_norm")).alias("weight"))


def hashed_embedding(df: DataFrame, text: str, out: str = "embedding", dim: int = EMBEDDING_SIZE,
                     **options) -> DataFrame:
    """Unit vector of hashed terms: a lexical stand-in, not a semantic embedding."""
    clean = df.withColumn("_text", F.coalesce(text, F.lit("")))
    hashed = HashingTF(numFeatures=dim, inputCol="_terms", outputCol="_counts").transform(
        with_terms(clean, "_text", "_terms", **options)
    )
    unit = Normalizer(p=2.0, inputCol="_counts", outputCol=out).transform(hashed)
    return unit.drop("_text", "_terms", "_counts")


def encoded_embedding(df: DataFrame, text: str, load_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
                      out: str = "embedding", dim: int = EMBEDDING_SIZE) -> DataFrame:
    """Vectors from a user's encoder, loaded once per Python worker and fed in batches.

    ``load_encoder()`` runs on the executors and returns a function from texts to
    a matrix. Filter rows before this step: predicates do not cross Python.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, _vector array<double>"

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load_encoder()
        for batch in batches:
            vectors = np.asarray(encoder(batch[text].fillna("").tolist()), dtype=float).reshape(len(batch), -1)
            if len(batch) and vectors.shape[1] != dim:
                raise ValueError(f"encoder gave {vectors.shape[1]} dimensions, expected {dim}")
            yield batch.assign(_vector=list(vectors))

    return df.mapInPandas(encode, schema).withColumn(out, array_to_vector("_vector")).drop("_vector")


def joined_embedding(df: DataFrame, vectors: DataFrame, key: str, vector: str, out: str = "embedding") -> DataFrame:
    """Vectors from a table of precomputed ones, by key."""
    table = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias(out))
    return df.join(table, key, "left")


def word_embeddings(df: DataFrame, text: str, embed: Callable[[DataFrame, str], DataFrame] = hashed_embedding,
                    keep: Sequence[str] = ("*",)) -> DataFrame:
    """One row per word of each text with the ``keep`` columns and the word's vector in ``embedding``.

    A kept text is repeated for each of its words: name the columns that are needed.
    Each distinct word is embedded once and joined back. A very common word makes
    one side of that join skewed, which AQE splits.
    """
    words = exploded(df, list(keep), S.words(F.col(text)), "word", "pos")
    vectors = embed(words.select("word").distinct(), "word")
    return words.join(vectors, "word")


def vector_norm(c: str) -> Column:
    """Length of a vector column, from the entries that are stored: of a sparse vector those other than 0."""
    return F.sqrt(F.aggregate(F.unwrap_udt(c)["values"], F.lit(0.0), lambda a, x: a + x * x))
