"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams by language inside tasks and sums them with one aggregation; the model is a
matrix of log probabilities (languages by buckets), small whatever the corpus, and is broadcast. Scoring
gathers the matrix at a text's n-grams and sums by text in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonance.llm import pretokens
from resonance.llm.support import judged, mixed, slices

#: Buckets of each order, as a power of two: log probabilities of one language fit a core's cache.
BUCKET_BITS = 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Languages whose counts a task holds at once before it passes them on.
HELD = 64


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, where each text's begin in the flat array, and its number of letters.

    Texts are lower-cased; everything but letters counts as one kind of gap, and grams of gaps only are left out.
    """
    texts = [f" {t.lower()} " for t in texts]
    cp = pretokens.code_points("".join(texts))
    edges = np.append(0, np.cumsum([len(t) for t in texts]))
    letter = pretokens.class_table()[cp] == pretokens.LETTER
    sym = np.where(letter, cp, np.uint32(32)).astype(np.uint64)
    n = len(sym)
    parts, places = [], []
    with np.errstate(over="ignore"):
        rolled = np.zeros(n, np.uint64)
        for order in range(1, max(ORDERS) + 1):
            shifted = np.append(sym[order - 1:], np.full(order - 1, 32, np.uint64))
            rolled = rolled * np.uint64(0x100000001B3) + shifted
            # A gram begins with a letter, or with a gap and then a letter; the two gaps between texts keep
            # grams of up to three characters within theirs.
            if order in ORDERS:
                own = letter if order == 1 else letter | np.append(letter[1:], False)
                at = np.flatnonzero(own)
                bucket = (mixed(rolled[at], order) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
                parts.append(bucket + np.int32(ORDERS.index(order) << BUCKET_BITS))
                places.append(at)
    at = np.concatenate(places)
    order = np.argsort(at, kind="stable")
    letters = np.append(0, np.cumsum(letter))
    return np.concatenate(parts)[order], np.searchsorted(at[order], edges), np.diff(letters[edges])


def buckets() -> int:
    return len(ORDERS) << BUCKET_BITS


def gram_counts(docs: DataFrame, text: str, label: str) -> DataFrame:
    """``label, bucket, n`` over all rows with a text and a label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}

        def passed() -> Iterator[pd.DataFrame]:
            for name, counts in held.items():
                at = np.flatnonzero(counts)
                yield pd.DataFrame({"label": name, "bucket": at.astype(np.int32), "n": counts[at]})
            held.clear()

        for batch in batches:
            for name, group in batch.groupby("label"):
                if name not in held and len(held) >= HELD:
                    yield from passed()
                texts = group["text"].tolist()
                for a, b in slices(texts):
                    found = np.bincount(grams(texts[a:b])[0], minlength=buckets())
                    held[name] = held.get(name, 0) + found
        yield from passed()

    rows = docs.select(F.col(label).alias("label"), F.col(text).alias("text")).dropna()
    counts = rows.mapInPandas(run, "label string, bucket int, n long")
    return counts.groupBy("label", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    labels: list[str]
    log_probs: np.ndarray  # labels x buckets
    log_prior: np.ndarray


def train(docs: DataFrame, text: str = "text", label: str = "lang") -> Model:
    """Fit on all given rows with a text and a label; one row of the matrix per label."""
    counted = docs.where(F.col(text).isNotNull()).groupBy(F.col(label).alias("label")).count().dropna()
    documents = {r["label"]: r["count"] for r in counted.collect()}  # one row per language
    labels = sorted(documents)
    if not labels:
        return Model([], np.zeros((0, buckets()), np.float32), np.zeros(0))
    counts = np.full((len(labels), buckets()), SMOOTHING)
    place = {name: i for i, name in enumerate(labels)}
    cells = gram_counts(docs, text, label).toPandas()  # at most languages x buckets
    counts[cells["label"].map(place).to_numpy(), cells["bucket"].to_numpy()] += cells["n"].to_numpy()
    # Each order is a distribution of its own.
    per_order = counts.reshape(len(labels), len(ORDERS), -1)
    log_probs = np.log(per_order / per_order.sum(axis=2, keepdims=True)).reshape(len(labels), -1)
    n = np.array([documents[x] for x in labels], float)
    return Model(labels, log_probs.astype(np.float32), np.log(n / n.sum()))


def score(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the best label (-1: none) and its posterior."""
    if not model.labels or not texts:
        return np.full(len(texts), -1), np.zeros(len(texts))
    found, edges, letters = grams(texts)
    total = np.empty((len(model.labels), len(texts)))
    for i, row in enumerate(model.log_probs):
        sums = np.add.reduceat(np.append(row[found], np.float32(0)).astype(np.float64), edges[:-1])
        total[i] = np.where(np.diff(edges) > 0, sums, 0) + model.log_prior[i]
    best = total.argmax(axis=0)
    posterior = 1 / np.exp(total - total.max(axis=0)).sum(axis=0)
    return np.where(letters > 0, best, -1), np.where(letters > 0, posterior, 0.0)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` in ``row``, ``lang_pred`` and ``score`` of every row.

    A text that is null or has no letter gets ``und`` and 0, and so does every text if the model has learned
    no language. Repeated rows are kept; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets

    def judge(texts: list[str]) -> dict:
        names = np.array([*shared.value.labels, "und"], object)
        found = [score(shared.value, texts[a:b]) for a, b in slices(texts)]
        best, sure = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0))
        return {"lang_pred": names[best], "score": sure}

    return judged(docs, F.col(text), judge, "lang_pred string, score double").select("row", "out.*")
