"""Token counts of sections by the offsets of a document's own encoding.

A document is encoded once, as a whole. Token spans (in characters) are joined with section spans by
binary search over the section starts, and a token that crosses a border is allocated by a stated rule.
Everything happens where the document is read; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonance.llm.bpe import Vocabulary, encoder
from resonance.llm.support import slices

RULES = ("first", "last", "largest")


def line_starts(text: str) -> list[int]:
    """Sections of a text: its lines, each with its line end; an empty text is one empty section."""
    starts, at = [0], text.find("\n")
    while at >= 0 and at + 1 < len(text):
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return starts


def allocate(begin: np.ndarray, end: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Section of each token ``[begin, end)`` by ``rule``, and the sections of its first and last character.

    ``first`` and ``last`` take the section of that character; ``largest`` the one that holds most of the
    token's characters, the earlier of equals.
    """
    first = np.searchsorted(starts, begin, side="right") - 1
    last = np.searchsorted(starts, end - 1, side="right") - 1
    if rule == "first":
        return first, first, last
    if rule == "last":
        return last, first, last
    own, crossing = first.copy(), np.flatnonzero(last > first)
    for i in crossing.tolist():  # few: tokens rarely cross a border
        edges = np.clip(np.append(starts[first[i]: last[i] + 1], end[i]), begin[i], end[i])
        own[i] = first[i] + int(np.argmax(np.diff(edges)))
    return own, first, last


def attribute(docs: DataFrame, vocabulary: Vocabulary, rule: str = "first", sections=line_starts,
              key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per section: ``key, section, start, length, n_tokens, n_crossing, doc_tokens``.

    ``sections`` gives the ascending starts of a text's sections, the first of them 0. ``n_tokens`` sums to
    ``doc_tokens`` over a document; ``n_crossing`` counts tokens that lie in this section and another. A token
    that holds only later bytes of a character lies where that character lies. Null texts count as empty: one
    section without tokens. Repeated rows and null keys are kept as they are; an empty table gives no row.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # fixed size: the vocabulary file
    kind = docs.schema[key].dataType.simpleString()

    def of_text(t: str, size: np.ndarray) -> tuple[np.ndarray, ...]:
        end = np.cumsum(size)
        begin = end - np.maximum(size, 1)
        starts = np.array(sections(t), np.int64)
        own, first, last = allocate(begin, np.maximum(end, begin + 1), starts, rule)
        n = len(starts)
        cross = last > first
        marks = np.bincount(first[cross], minlength=n + 1) - np.bincount(last[cross] + 1, minlength=n + 1)[: n + 1]
        return starts, np.diff(np.append(starts, len(t))), np.bincount(own, minlength=n), np.cumsum(marks)[:n]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(shared.value)
        for batch in batches:
            texts = batch["t"].tolist()
            for a, b in slices(texts):
                _, counts, chars = enc.encode(texts[a:b], spans=True)
                edges = np.append(0, np.cumsum(counts)).tolist()
                found = [of_text(texts[a + i], chars[edges[i]: edges[i + 1]]) for i in range(b - a)]
                n = [len(x[0]) for x in found]
                out = {"k": np.repeat(batch["k"].to_numpy()[a:b], n), "section": np.concatenate([np.arange(x) for x in n])}
                for name, values in zip(("start", "length", "n_tokens", "n_crossing"), zip(*found)):
                    out[name] = np.concatenate(values)
                yield pd.DataFrame(out | {"doc_tokens": np.repeat(counts, n)})

    # Keys travel as text: a column of numbers and nulls would be rounded on its way.
    rows = docs.select(F.col(key).cast("string").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    schema = f"k string, section long, start long, length long, n_tokens long, n_crossing long, doc_tokens long"
    found = rows.mapInPandas(run, schema)
    return found.select(F.col("k").cast(kind).alias(key), *found.columns[1:])
