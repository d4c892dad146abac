"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resonance.sources.scratch import shuffles_dropped  # noqa: F401

#: Characters handled at once inside a task; keeps numpy's buffers at some tens of MB.
SLICE_CHARS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` characters together (one text at least)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Flat positions of the ranges ``[start, start + length)``, one after another."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.repeat(starts.astype(np.int64) - (ends - lengths), lengths) + np.arange(ends[-1])


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: An odd multiplier and its inverse modulo 2^64, for hashes of ranges.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0..n-1`` modulo 2^64; kept per process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        steps = np.full(size, np.uint64(base))
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``values[start:end]``; equal ranges have equal hashes wherever they lie."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
        h = (sums[ends] - sums[starts]) * powers(INVERSE, n + 1)[starts]
        return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def judged(docs: DataFrame, text: Column, judge: Callable[[list[str]], dict], schema: str) -> DataFrame:
    """Two columns: ``row``, all columns of ``docs`` as they are, and ``out``, what ``judge`` says of ``text``.

    ``judge`` gets a batch of texts (null: empty) and returns columns of the same length. Only the text goes to
    Python, so no name or type of another column matters.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(judge(batch.tolist()))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    # Not repeated where a filter on the result could be pushed below it.
    out = F.pandas_udf(run, schema).asNondeterministic()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(F.struct(*columns).alias("row"), out(F.coalesce(text, F.lit(""))).alias("out"))


def row_columns(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of ``docs`` out of ``row``, some of them changed."""
    return [changed[c].alias(c) if c in changed else F.col(f"row.`{c}`") for c in docs.columns]
