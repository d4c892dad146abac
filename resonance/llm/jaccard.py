"""Exact join of word-shingle sets by Jaccard similarity, as a metric-space join.

Sets that link differ in at most ``r`` shingles, ``r`` known from the smaller size. Two kinds of metric pruning
follow from that, both exact:

1. *Size annuli.* The size of a set is its distance from the empty set, a pivot all sets share. Annuli grow
   geometrically; a set within reach of the annulus below it is replicated there. In an annulus the shingle
   space is cut into more than ``r`` buckets, so linked sets agree on a whole bucket: its content is a cell.
   A cell's least set is the pivot of a region, and the region holds every set that shares a cell with it.
   Pivots drawn from the documents alone would not do: most pairs of documents share nothing and lie at the
   same distance 1, where no triangle inequality tells them apart.
2. *Voronoi regions.* A region joins by choosing pivots, giving each set to its nearest one and replicating it
   to every other whose distance is within twice the radius of that; parts join in the same way until they are
   small or no longer shrink, and are then compared set by set.

Copies of a set are one class. Regions of many sets are cut into blocks, each pair of blocks a task, so a task
holds a bounded number of sets. Tasks return a forest of their links, not all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonance.llm.components import components
from resonance.llm.shingles import shingle_sets
from resonance.llm.support import judged, mixed, ragged, shuffles_dropped, slices
from resonance.sources.scratch import written

#: Growth of the annuli.
RATIO = 1.6
#: Cells a task gathers before it passes them on, and cells in one range.
FLUSH = 750_000
RANGE_CELLS = 1_000_000
#: Sets in a block of a large region.
BLOCK = 256
#: Bytes of sets that travel to their regions at once, and rounds in which they travel at most.
ROUND_BYTES, ROUNDS = 64 << 20, 8
#: Sets for each round up to which their tasks, or their keys, are sent to all texts.
TASKS_SENT, KEYS_SENT = 100_000, 2_000_000
#: Parts of a region below this size are compared directly; pivots of a larger one.
SMALL, PIVOTS = 48, 6


@dataclass(frozen=True)
class Rule:
    """Sets link when ``den * intersection >= num * union``."""

    num: int
    den: int

    def __post_init__(self) -> None:
        lows = [1]
        while lows[-1] < 1 << 40:
            lows.append(max(lows[-1] + 1, math.ceil(lows[-1] * RATIO)))
        cuts = []
        for low, high in zip(lows, [x - 1 for x in lows[1:]]):
            reach = high * (self.den - self.num) // self.num
            spare = 0
            for _ in range(4):  # buckets that may be empty in all but one of some 100 000 sets
                k = reach + 1 + spare
                empty = k * math.exp(-low / k)
                spare = math.ceil(empty + 4.5 * math.sqrt(empty))
            cuts.append((reach + 1 + spare, spare) if reach else (0, 0))
        object.__setattr__(self, "lows", np.array(lows[:-1]))
        object.__setattr__(self, "highs", np.array([x - 1 for x in lows[1:]]))
        object.__setattr__(self, "cuts", cuts)

    @property
    def radius(self) -> float:
        return 1 - self.num / self.den

    def annuli(self, n: int) -> list[int]:
        """The annuli in which a set of ``n`` shingles meets others: its own and those below within reach."""
        own = int(np.searchsorted(self.lows, n, side="right")) - 1
        found = [own]
        while found[-1] and n * self.num <= self.highs[found[-1] - 1] * self.den:
            found.append(found[-1] - 1)
        return [c for c in found if self.cuts[c][0]]

    def cells(self, hashes: np.ndarray) -> np.ndarray:
        """48-bit keys of a set's buckets in its annuli.

        Empty buckets count only for a set that has more of them than its annulus spares; two linked sets
        agree on more buckets than that, so they agree on one that counts in both.
        """
        out = []
        for c in self.annuli(len(hashes)):
            k, spare = self.cuts[c]
            bucket = ((hashes >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            edges = np.searchsorted(bucket, np.arange(k + 1))
            with np.errstate(over="ignore"):
                sums = np.append(np.uint64(0), np.cumsum(mixed(hashes, 7), dtype=np.uint64))
                content = sums[edges[1:]] - sums[edges[:-1]]
                key = mixed(content + mixed(np.arange(k, dtype=np.uint64), c + 11), 5) >> np.uint64(16)
            full = edges[1:] > edges[:-1]
            out.append(key if k - full.sum() > spare else key[full])
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def identity(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set, as signed integers."""
    with np.errstate(over="ignore"):
        sums = [mixed(hashes, s).sum(dtype=np.uint64) + np.uint64(len(hashes)) for s in (3, 4)]
    return tuple(int(mixed(np.array([s]), 9).view(np.int64)[0]) for s in sums)


def of_texts(batches: Iterator[pd.DataFrame], width: int) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    for batch in batches:
        texts = batch["t"].tolist()
        for a, b in slices(texts):
            yield batch.iloc[a:b], shingle_sets(texts[a:b], width)


def set_rows(docs: DataFrame, width: int, rule: Rule) -> DataFrame:
    """Of each row: set size, the set's two hashes, number of cells. Keys do not go to Python."""

    def judge(texts: list[str]) -> dict:
        found: dict[str, list] = {"n": [], "s1": [], "s2": [], "m": []}
        for a, b in slices(texts):
            for s in shingle_sets(texts[a:b], width):
                for name, value in zip(found, (len(s), *identity(s), sum(rule.cuts[c][0] for c in rule.annuli(len(s))) if len(s) else 0)):
                    found[name].append(value)
        return {name: np.array(values, np.int64) for name, values in found.items()}

    return judged(docs, F.col("t"), judge, "n long, s1 long, s2 long, m long").select("row.k", "out.*")


def shared_cells(docs: DataFrame, width: int, rule: Rule, ranges: int) -> DataFrame:
    """``cell, node, pivot`` of cells with several sets; a set is named by its first hash.

    Cells leave a task sorted, in packed ranges. Of sets that share a cell within a task only the least goes to
    the cell's range; the others go to ranges of their own, without a pivot, and get it by a join. So a cell
    that very many sets share sends one entry for each task to its range.
    """

    def packed(cell: np.ndarray, node: np.ndarray) -> Iterator[pd.DataFrame]:
        order = np.lexsort((node, cell))
        cell, node = cell[order], node[order]
        same = np.append(False, cell[1:] == cell[:-1])
        keep = ~(same & np.append(False, node[1:] == node[:-1]))
        cell, node, same = cell[keep], node[keep], np.append(False, cell[keep][1:] == cell[keep][:-1])[: keep.sum()]
        shared = np.append(same[1:], False)  # another set of this task has the cell
        part = ((cell >> np.uint64(16)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        part = np.where(same, ranges + (node % np.uint64(ranges)).astype(np.int64), part)
        order = np.argsort(part, kind="stable")
        cell, node, shared, part = cell[order], node[order], shared[order], part[order]
        begins = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        rows = [
            (int(part[a]), cell[a:b].tobytes(), node[a:b].tobytes(), shared[a:b].tobytes())
            for a, b in zip(begins, np.append(begins[1:], len(part)))
        ]
        yield pd.DataFrame(rows, columns=["part", "cell", "node", "shared"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, nodes, size = [], [], 0
        for _, sets in of_texts(batches, width):
            for s in sets:
                if len(s) and len(own := rule.cells(s)):
                    cells.append(own)
                    nodes.append(np.full(len(own), identity(s)[0], np.int64).view(np.uint64))
                    size += len(own)
                if size >= FLUSH:
                    yield from packed(np.concatenate(cells), np.concatenate(nodes))
                    cells, nodes, size = [], [], 0
        if size:
            yield from packed(np.concatenate(cells), np.concatenate(nodes))

    def meet(part: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cell, node, shared = (np.frombuffer(b"".join(rows[c]), t) for c, t in (("cell", "<u8"), ("node", "<u8"), ("shared", bool)))
        if part[0] >= ranges:
            return pd.DataFrame({"cell": cell.view(np.int64), "node": node.view(np.int64), "pivot": pd.NA}).astype({"pivot": "Int64"})
        order = np.lexsort((node, cell))
        cell, node, shared = cell[order], node[order], shared[order]
        begins = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        sizes = np.diff(np.append(begins, len(cell)))
        several = (node[begins + sizes - 1] != node[begins]) | np.logical_or.reduceat(shared, begins)
        keep = np.repeat(several, sizes)
        pivot = np.repeat(node[begins], sizes)
        out = {"cell": cell[keep].view(np.int64), "node": node[keep].view(np.int64), "pivot": pivot[keep].view(np.int64)}
        return pd.DataFrame(out).astype({"pivot": "Int64"})

    entries = docs.mapInPandas(run, "part long, cell binary, node binary, shared binary")
    met = written(entries.groupBy("part").applyInPandas(meet, "cell long, node long, pivot long"), "jaccard-cells")
    placed = met.where("pivot is not null")
    pivots = placed.select("cell", "pivot").distinct()
    late = met.where("pivot is null").drop("pivot").join(pivots, "cell")
    return placed.unionByName(late)


def short(hashes: np.ndarray) -> bytes:
    """48 of the 64 bits of each hash: within a region that is as good, and a quarter less to move."""
    return (hashes >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def long(packed: bytes) -> np.ndarray:
    parts = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return np.pad(parts, ((0, 0), (0, 2))).view("<u8").ravel()


class Forest:
    """Union-find over a task's sets."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def roots(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))


class Region:
    """The sets of one task, with shared shingles as small integers."""

    def __init__(self, sets: list[np.ndarray], rule: Rule):
        self.rule = rule
        self.size = np.array([len(s) for s in sets], np.int64)
        flat, count = np.concatenate(sets), None
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count[column] > 1
        owner = np.repeat(np.arange(len(sets)), self.size)[shared]
        self.column = column[shared]
        self.length = np.bincount(owner, minlength=len(sets))
        self.start = np.cumsum(self.length) - self.length
        self.flag = np.zeros(len(count), np.int64)
        self.forest = Forest(len(sets))

    def overlap(self, i: int, others: np.ndarray) -> np.ndarray:
        """Intersection sizes of set ``i`` with each of ``others``."""
        own = self.column[self.start[i]: self.start[i] + self.length[i]]
        self.flag[own] = 1
        hits = self.flag[self.column[ragged(self.start[others], self.length[others])]]
        self.flag[own] = 0
        sums = np.append(0, np.cumsum(hits))
        ends = np.cumsum(self.length[others])
        return sums[ends] - sums[ends - self.length[others]]

    def compare(self, i: int, others: np.ndarray) -> np.ndarray:
        """Distances of ``others`` from set ``i``; links are noted."""
        both = self.overlap(i, others)
        union = self.size[i] + self.size[others] - both
        for j in others[self.rule.den * both >= self.rule.num * union].tolist():
            self.forest.link(i, j)
        return 1 - both / union

    def directly(self, members: np.ndarray) -> None:
        for at, i in enumerate(members.tolist()):
            rest = members[at + 1:]
            rest = rest[self.forest.roots()[rest] != self.forest.root(i)]
            small, large = np.minimum(self.size[rest], self.size[i]), np.maximum(self.size[rest], self.size[i])
            rest = rest[self.rule.den * small >= self.rule.num * large]
            if len(rest):
                self.compare(i, rest)

    def join(self, members: np.ndarray) -> None:
        """Find a forest of all links among ``members``."""
        if len(members) <= SMALL:
            return self.directly(members)
        pivots = members[np.linspace(0, len(members) - 1, PIVOTS).astype(int)]
        away = np.stack([self.compare(p, members) for p in pivots.tolist()])
        if len(np.unique(self.forest.roots()[members])) == 1:
            return None
        near = away <= away.min(axis=0) + 2 * self.rule.radius + 1e-9
        parts = [members[row] for row in near]
        if sum(len(p) ** 2 for p in parts) > 0.7 * len(members) ** 2:
            return self.directly(members)
        for part in parts:
            self.join(part)
        return None


def region_links(docs: DataFrame, reps: DataFrame, members: DataFrame, width: int, rule: Rule) -> list[DataFrame]:
    """``a, b``: a forest of the links of every region, between the representatives of classes.

    ``reps`` has ``s1, rep, n``. Sets travel to their regions in rounds, each a part of the regions and a table of links:
    they take more disk than the texts, as a set goes to every region it is in, and a round's files go when it ends.
    """
    kind = docs.schema["k"].dataType.simpleString()
    inside = members.select("pivot", "node").distinct()
    sizes = inside.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).withColumnRenamed("pivot", "p")
    blocked = inside.join(sizes, F.col("pivot") == F.col("p")).withColumn(
        "own", F.pmod(F.xxhash64("node", "pivot"), F.col("blocks")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tasks = blocked.select("node", "pivot", "own", other).select(
        "node", F.struct("pivot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).alias("task")
    )
    of_node = tasks.groupBy("node").agg(F.collect_list("task").alias("tasks"))
    wanted = written(of_node.join(reps, F.col("node") == F.col("s1")).select("rep", "n", "tasks"), "jaccard-tasks")
    travels, sets = wanted.agg(F.sum(F.col("n") * F.size("tasks")), F.count(F.lit(1))).first()
    rounds = max(1, min(ROUNDS, -(-6 * (travels or 0) // ROUND_BYTES)))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, sets in of_texts(batches, width):
            rows = [
                (t["pivot"], t["i"], t["j"], k, short(s))
                for k, tasks, s in zip(batch["k"].tolist(), batch["tasks"], sets) for t in tasks
            ]
            for a in range(0, len(rows), 2000):
                yield pd.DataFrame(rows[a: a + 2000], columns=["pivot", "i", "j", "k", "s"])

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows["k"].tolist()
        region = Region([long(s) for s in rows["s"]], rule)
        region.join(np.arange(len(keys)))
        return pd.DataFrame([(keys[i], keys[j]) for i, j in region.forest.links], columns=["a", "b"])

    links = []
    for now in range(rounds):
        known = docs
        mine = F.filter("tasks", lambda t: F.pmod(F.xxhash64(t["pivot"]), F.lit(rounds)) == now)
        some = wanted.select("rep", mine.alias("tasks")).where(F.size("tasks") > 0)
        # Texts move only where the tasks of a round are too many to be sent to them, and then those that have some.
        if sets <= rounds * TASKS_SENT:
            some = F.broadcast(some)
        elif sets <= rounds * KEYS_SENT:
            known = docs.join(F.broadcast(some.select("rep")), F.col("k") == F.col("rep"), "left_semi")
        texts = known.join(some, F.col("k") == F.col("rep")).select("k", "t", "tasks")
        placed = texts.mapInPandas(spread, f"pivot long, i int, j int, k {kind}, s binary")
        found = placed.groupBy("pivot", "i", "j").applyInPandas(join, f"a {kind}, b {kind}").distinct()
        links.append(written(found, "jaccard-links"))
    return links


def similar_groups(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id`` of every row: groups of texts whose shingle sets link.

    Sets hold the distinct ``width``-word shingles of the whole text (one, if it has fewer words); two link when
    ``den * intersection >= num * union``, and a component is named by its least key. A null text, or one without
    words, has no shingles and is a component by itself. Rows of one key count as linked. A null key gets a null
    component. Other columns are not read; an empty table gives an empty table.
    """
    spark, rule = docs.sparkSession, Rule(num, den)
    with shuffles_dropped(spark):
        return _similar_groups(docs, width, rule, key, text)


def _similar_groups(docs: DataFrame, width: int, rule: Rule, key: str, text: str) -> DataFrame:
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    sets = written(set_rows(rows, width, rule), "jaccard-sets")
    classes = sets.where("n > 0 and k is not null").groupBy("s1", "s2").agg(F.min("k").alias("rep"), F.min("n").alias("n"))
    total = sets.agg(F.sum("m")).first()[0] or 0
    usable = rows.where("k is not null and t <> ''")
    members = shared_cells(usable, width, rule, max(1, -(-total // RANGE_CELLS)))
    links = region_links(usable, classes.select("s1", "rep", "n").distinct(), members, width, rule)
    groups = components(reduce(DataFrame.unionByName, links))
    named = classes.join(groups, F.col("rep") == F.col("node"), "left").select(
        F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.coalesce("component", "rep").alias("component")
    )
    found = sets.join(named, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("n") > 0), "left")
    return found.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "k").alias("component_id"))
