"""Document fingerprints by randomised edit embedding.

A shared random walk reads a string: at step ``j`` it stands on a character and moves on if a random bit of
(step, character) says so. Two strings at a small edit distance, read by the same walk, fall into step again
soon after each edit, so the sequences of characters read differ in few places (Hamming distance).

A text is cut at content-defined anchors and the walk starts anew at each, so that edits stay local and all
pieces of a batch walk in step. Bits sampled from the steps of a piece make its bands; the fingerprint keeps,
for each slot, the least hash of all bands of the text (a min-wise sample), two hex digits for each. Equal
texts have equal fingerprints; the likeness of two is the share of equal slots, corrected for chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonance.llm.pretokens import code_points
from resonance.llm.support import mixed, slices

#: Anchors: a character whose window of WINDOW hashes to 0 modulo 2 ** ANCHOR_BITS begins a piece; so does every
#: MOST characters without an anchor.
WINDOW, ANCHOR_BITS, MOST = 4, 5, 96
#: Steps of a walk for each character of the longest piece.
STRETCH = 3
#: Bands of a piece and steps sampled for each.
BANDS, SAMPLED = 2, 24
#: Slots of a fingerprint.
SLOTS = 128
SEED = 20240607


class Walk:
    """The random choices all walks share, drawn once from SEED."""

    def __init__(self) -> None:
        random = np.random.default_rng(SEED)
        steps = MOST * STRETCH
        self.moves = random.integers(0, 2, (steps, 256), np.uint8)
        self.bits = random.integers(0, 2, (BANDS, steps, 256), np.uint8).astype(np.uint64)
        self.sampled = np.zeros((BANDS, steps), bool)
        for band in self.sampled:
            # Short pieces end early: of every few steps one is sampled, in each band another.
            at = np.arange(0, steps, STRETCH) + random.integers(0, STRETCH, steps // STRETCH)
            band[at] = True
            band[at[SAMPLED:]] &= random.random(len(at) - SAMPLED) < 0.5

    def bands(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each band of each piece (bands x pieces); ``symbols`` are below 256."""
        out = np.empty((BANDS, len(starts)), np.uint64)
        piece, at = np.arange(len(starts)), starts.copy()
        seen = np.ones((BANDS, len(starts)), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(len(self.moves)):
                live = at < ends
                if not live.all():
                    out[:, piece[~live]] = seen[:, ~live]
                    piece, at, ends, seen = piece[live], at[live], ends[live], seen[:, live]
                    if not len(piece):
                        break
                c = symbols[at]
                for b in range(BANDS):
                    if self.sampled[b, j]:
                        seen[b] = seen[b] * np.uint64(0x5851F42D4C957F2D) + self.bits[b, j][c] + np.uint64(j)
                at = at + self.moves[j][c]
            out[:, piece] = seen
        return np.stack([mixed(row, b) for b, row in enumerate(out)])


def pieces(cp: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Starts of the pieces of all texts; ``edges`` are the texts' ends, from 0."""
    n = len(cp)
    with np.errstate(over="ignore"):
        rolled = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            rolled = rolled * np.uint64(0x100000001B3) + np.append(cp[k:], np.zeros(k, cp.dtype)).astype(np.uint64)
    start = mixed(rolled, 2) >> np.uint64(64 - ANCHOR_BITS) == 0
    sizes = np.diff(edges)
    whole = np.arange(n) + WINDOW <= np.repeat(edges[1:], sizes)  # windows that end within their text
    start &= whole
    start[edges[:-1][sizes > 0]] = True
    at = np.flatnonzero(start)
    gap = np.diff(np.append(at, n))
    more = (gap - 1) // MOST  # further pieces in a gap longer than MOST
    extra = np.repeat(at, more) + MOST * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    return np.sort(np.concatenate([at, extra]))


_walk: list[Walk] = []


def fingerprints(texts: list[str]) -> np.ndarray:
    """SLOTS bytes for each text; all 0 for an empty one."""
    if not _walk:
        _walk.append(Walk())
    out = np.zeros((len(texts), SLOTS), np.uint8)
    cp = code_points("".join(texts))
    if not len(cp):
        return out
    edges = np.append(0, np.cumsum([len(t) for t in texts]))
    starts = pieces(cp, edges)
    symbols = (cp ^ (cp >> np.uint32(8))).astype(np.uint8)
    hashes = _walk[0].bands(symbols, starts, np.append(starts[1:], len(cp))).T.ravel()
    owner = np.repeat(np.searchsorted(edges, starts, side="right") - 1, BANDS)
    slot = (hashes >> np.uint64(57)).astype(np.int64)  # SLOTS is 2 ** 7
    order = np.lexsort((hashes & np.uint64((1 << 57) - 1), owner * SLOTS + slot))
    place = (owner * SLOTS + slot)[order]
    first = np.append(True, place[1:] != place[:-1])
    flat = np.full(len(texts) * SLOTS, np.uint64(0))
    has = np.zeros(len(flat), bool)
    flat[place[first]], has[place[first]] = hashes[order][first], True
    flat, has = flat.reshape(-1, SLOTS), has.reshape(-1, SLOTS)
    # An empty slot takes the nearest filled one before it, going round, together with the distance to it.
    twice = np.concatenate([has, has], axis=1)
    last = np.maximum.accumulate(np.where(twice, np.arange(2 * SLOTS), -1), axis=1)[:, SLOTS:]
    away = np.arange(SLOTS, 2 * SLOTS) - last
    borrowed = mixed(np.take_along_axis(flat, np.maximum(last, 0) % SLOTS, 1) + away.astype(np.uint64), 5)
    out[:] = np.where(has.any(axis=1, keepdims=True), borrowed >> np.uint64(56), 0).astype(np.uint8)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of text that two documents have in common (0 to 1), from equal slots."""
    chance = 1 / 256
    shared = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    return 2 * shared / (1 + shared)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of ``following``, or all of that if it is shorter."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Rows of a range of keys, and the fewest and most ranges.
RANGE_ROWS, FEWEST, MOST_RANGES = 5_000, 16, 20_000


def in_ranges(rows: DataFrame) -> DataFrame:
    """``rows`` (columns ``k`` and ``t``) with the range of their key, and the neighbour that each range needs.

    A range holds a run of keys; ``ghost`` marks a copy of the first row of the following range (in descending
    order, after the last the first again), which the last row of the range is followed by.
    """
    spark: SparkSession = rows.sparkSession
    n = rows.count()
    wanted = min(max(FEWEST, -(-n // RANGE_ROWS)), MOST_RANGES)
    bounds = sorted(set(rows.select(F.col("k").cast("double").alias("k")).approxQuantile("k", [i / wanted for i in range(1, wanted)], 0.25 / wanted)))
    if bounds:
        cut = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="kd", outputCol="range")
        ranged = cut.transform(rows.withColumn("kd", F.col("k").cast("double"))).drop("kd").withColumn("range", F.col("range").cast("int"))
    else:
        ranged = rows.withColumn("range", F.lit(0))
    heads = sorted((r["range"], r["k"]) for r in ranged.groupBy("range").agg(F.max("k").alias("k")).collect())  # one row per range
    if not heads:
        return ranged.withColumn("ghost", F.lit(False))
    to = [heads[(i + 1) % len(heads)][0] for i in range(len(heads))]  # the range above, whose last row comes before this head
    targets = spark.createDataFrame([(k, t) for (_, k), t in zip(heads, to)], "hk long, target int")
    head_rows = ranged.join(F.broadcast(targets), F.col("k") == F.col("hk"))  # one row per range
    ghosts = head_rows.select("k", "t", F.col("target").alias("range"), F.lit(True).alias("ghost"))
    dealt = ranged.withColumn("ghost", F.lit(False)).unionByName(ghosts)
    return dealt.repartition(len(heads), "range").sortWithinPartitions("range", "ghost", F.desc("k"), "t")


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edit by the following document, in descending order of the key.

    Columns: ``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. Null texts
    count as empty; two empty texts are alike. Rows of one key follow each other in the order of their texts; a
    null key comes last. Other columns are not read; an empty table gives an empty table.
    """
    lowest = -(1 << 63)
    rows = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(lowest)).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []  # the last row read, whose follower is not known yet

        def judged(now: list[tuple]) -> pd.DataFrame:
            """All rows of ``now`` but the last of them, each with the next."""
            prints = fingerprints([t for _, _, _, t in now])
            pairs = [i for i in range(len(now) - 1) if now[i][0] == now[i + 1][0] and not now[i][1]]
            texts = [edited(now[i][3], now[i + 1][3]) for i in pairs]
            changed = fingerprints(texts)
            at = np.array(pairs, int)
            return pd.DataFrame({
                "k": [now[i][2] for i in pairs],
                "n_chars": [len(now[i][3]) for i in pairs],
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in texts],
                "fingerprint": [prints[i].tobytes().hex() for i in pairs],
                "edited_fingerprint": [x.tobytes().hex() for x in changed],
                "near_edited": likeness(prints[at], changed),
                "near_next": likeness(prints[at], prints[at + 1]),
            })

        for batch in batches:
            found = list(zip(batch["range"].tolist(), batch["ghost"].tolist(), batch["k"].tolist(), batch["t"].tolist()))
            for a, b in slices([t for *_, t in found]):
                now = held + found[a:b]
                held = now[-1:]
                if any(x[0] == y[0] and not x[1] for x, y in zip(now, now[1:])):
                    yield judged(now)

    out = in_ranges(rows).mapInPandas(
        run,
        "k long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
    kind = docs.schema[key].dataType
    return out.withColumn("k", F.when(F.col("k") != lowest, F.col("k")).cast(kind)).withColumnRenamed("k", key)
