"""Scores of feature vectors made of two parts, without putting the parts together.

A tree's leaves are bits. What a part of the features rules out (the leaves behind splits on its features that it does
not pass) is a mask; the leaf a whole vector falls into is the one bit that the masks of its parts have in common. So
each part is looked at once, however many vectors it takes part in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resonance.explain.trees import tree_nodes

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Words of masks worked on at once in a task, vectors whose masks it keeps, and rows of a batch.
WORDS, KNOWN, ROWS = 1 << 21, 1 << 13, 1 << 12


def _bits(a: int, b: int, n: int) -> np.ndarray:
    """Mask words with the bits ``[a, b)`` set, ``n`` words."""
    value = (1 << b) - (1 << a)
    return np.array([(value >> (64 * i)) & (2**64 - 1) for i in range(n)], np.uint64)


class LeafSets:
    """The splits of an ensemble, each with the leaves it rules out, and the value of every leaf."""

    def __init__(self, spark: SparkSession, model):
        nodes = tree_nodes(spark, model).toPandas()
        if (nodes["categories"].fillna(-1) != -1).any():
            raise ValueError("only continuous splits are known here")
        self.splits: list[tuple[int, float, int, np.ndarray, np.ndarray]] = []  # feature, threshold, first word, masks
        full, values, word = [], [], 0
        for _, tree in nodes.sort_values(["tree", "id"]).groupby("tree"):
            at = {r.id: r for r in tree.itertuples()}
            order, stack, spans = [], [0], {}
            while stack:  # leaves from left to right
                i = stack.pop()
                if at[i].leftChild < 0:
                    spans[i] = (len(order), len(order) + 1)
                    order.append(at[i].prediction * at[i].weight)
                else:
                    stack += [at[i].rightChild, at[i].leftChild]
            n = -(-len(order) // 64)
            for i in sorted(at, reverse=True):  # children have larger numbers
                if at[i].leftChild >= 0:
                    left, right = spans[at[i].leftChild], spans[at[i].rightChild]
                    spans[i] = (left[0], right[1])
                    self.splits.append((int(at[i].feature), float(at[i].threshold), word, ~_bits(*left, n), ~_bits(*right, n)))
            full.append(_bits(0, len(order), n))
            values.append(np.pad(np.array(order), (0, n * 64 - len(order))))
            word += n
        self.full, self.values, self.trees = np.concatenate(full), np.concatenate(values), len(full)

    def masks(self, x: np.ndarray, columns: range) -> np.ndarray:
        """Leaves (as mask words) that ``x``, the features numbered ``columns``, leaves open, a row for each row."""
        out = np.tile(self.full, (len(x), 1))
        for feature, threshold, word, not_left, not_right in self.splits:
            if feature in columns:
                passed = x[:, feature - columns.start] <= threshold
                for k in range(len(not_left)):
                    # A split passed rules out the leaves on its right.
                    out[:, word + k] &= np.where(passed, not_right[k], not_left[k])
        return out

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Prediction for the vectors whose parts have the masks ``a`` and ``b``."""
        both = a & b
        rows, words = np.nonzero(both)
        # A power of two: its logarithm is exact.
        leaf = words * 64 + np.log2(both[rows, words]).astype(np.int64)
        return self.values[leaf].reshape(len(a), self.trees).sum(axis=1)


class _Known:
    """Masks of the vectors a task has met: few vectors are many rows' where a part of the features has few values."""

    def __init__(self, found: LeafSets, columns: range):
        self.found, self.columns, self.numbers = found, columns, {}
        self.step = max(1, WORDS // max(len(found.full), len(columns), 1))

    def of(self, x: np.ndarray) -> tuple[list[tuple[bytes, int, int]], list[bool]]:
        """Mask and its two names for each row, and whether the task meets its vector for the first time."""
        rows = [row.tobytes() for row in x]
        if len(self.numbers) + len(x) > KNOWN:
            self.numbers = {}
        new: dict[bytes, int] = {}
        for i, row in enumerate(rows):
            if row not in self.numbers:
                new.setdefault(row, i)
        at, first = list(new.values()), [False] * len(rows)
        for k in range(0, len(at), self.step):
            for i, mask in zip(at[k: k + self.step], self.found.masks(x[at[k: k + self.step]], self.columns)):
                data = mask.tobytes()
                names = np.frombuffer(hashlib.blake2b(data, digest_size=16).digest(), np.int64).tolist()
                self.numbers[rows[i]], first[i] = (data, *names), True
        return [self.numbers[row] for row in rows], first


def with_masks(df: DataFrame, keep: Sequence[str], sets, columns: range, features: str = "features",
               named: bool = False) -> DataFrame:
    """``keep`` and ``mask``, the leaves that the features numbered ``columns`` leave open; ``sets`` is broadcast.

    ``named``: each mask has its names ``a`` and ``b``, 64-bit hashes, and is null itself but for the first rows that have it.
    """
    part = F.slice(vector_to_array(features), columns.start + 1, len(columns))
    rows = df.select(*keep, part.alias("_x"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_x").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(sets.value, columns)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                some = batch.slice(at, ROWS)
                x = some.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(len(some), len(columns))
                found, first = known.of(x)
                columns_ = [some.column(c) for c in keep]
                if not named:
                    masks = pa.array([m for m, _, _ in found], pa.binary())
                    yield pa.RecordBatch.from_arrays([*columns_, masks], names=[*keep, "mask"])
                    continue
                masks = pa.array([m if new else None for (m, _, _), new in zip(found, first)], pa.binary())
                names = [pa.array([f[k] for f in found], pa.int64()) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([*columns_, *names, masks], names=[*keep, "a", "b", "mask"])

    return rows.mapInArrow(run, f"{kept}, {'a long, b long, ' * named}mask binary")


def scores_of_kinds(sets, kinds, mask: str, of: str) -> Column:
    """Predictions, as an array, for a mask column with each of the masks numbered in the array ``of``; ``kinds``: broadcast masks."""
    @F.pandas_udf("array<double>")
    def scores(mask: pd.Series, of: pd.Series) -> pd.Series:
        found, out = sets.value, []
        step = max(1, WORDS // max(len(found.full), 1))
        for m, numbers in zip(mask, of):
            each, back = np.unique(np.asarray(numbers), return_inverse=True)
            own = np.frombuffer(m, np.uint64)[None]
            parts = [found.scores(kinds.value[each[at: at + step]], own) for at in range(0, len(each), step)]
            out.append(np.concatenate(parts)[back])
        return pd.Series(out, dtype=object)

    return scores(F.col(mask), F.col(of))


def joint_score(sets, a: str = "mask", b: str = "word_mask") -> Column:
    """Prediction from two mask columns."""
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        found = sets.value
        step = max(1, WORDS // max(len(found.full), 1))
        parts = [np.zeros(0)]
        for at in range(0, len(a), step):
            left, right = (np.frombuffer(b"".join(c.iloc[at: at + step]), np.uint64).reshape(-1, len(found.full)) for c in (a, b))
            parts.append(found.scores(left, right))
        return pd.Series(np.concatenate(parts))

    return score(F.col(a), F.col(b))
