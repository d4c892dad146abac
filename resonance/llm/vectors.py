"""Near-duplicate embeddings over sharded hierarchical navigable small-world graphs.

Equal vectors are one class. Classes are dealt to shards; each shard builds a layered graph by batched
insertion, and every class queries every shard in blocks. All rows of a block walk the graph in step, so a
step is a few numpy operations. A query whose beam is full of links widens it; so does a block whose sampled
queries, compared with the whole shard, show too low a recall. Past the widest beam the shard is scanned.
Links are verified in double precision; blocks return link counts and, instead of all pairs, each vector with
the least vector its block connects it to, and components are unions of those.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonance.llm.components import components
from resonance.llm.support import mixed
from resonance.sources.scratch import written

#: Classes in a shard (four shards at least) and in a block of queries.
SHARD_ROWS, LEAST_SHARDS, BLOCK_ROWS = 16_384, 4, 8_192
#: Neighbours of a node above the base layer and on it; one node in LAYER is also on the next layer.
DEGREE, BASE_DEGREE, LAYER = 12, 24, 16
#: Beam when building, first and widest beam when searching; queries in step; nodes expanded in a step.
BUILD_BEAM, FIRST_BEAM, WIDEST_BEAM, STEP_ROWS, EXPANDED = 48, 32, 128, 512, 4
#: Bytes for the marks of nodes that rows in step have met.
STAMPS = 64_000_000
#: Queries of a block that are compared with the whole shard, and the recall of links they must show.
AUDITED, RECALL = 256, 0.99
#: Single-precision slack when collecting links to verify.
SLACK = 1e-4


def fresh(stamp: np.ndarray, own: np.ndarray, near: np.ndarray) -> np.ndarray:
    """``near`` with -1 for nodes a row has met before; ``own`` are the rows' places in ``stamp``."""
    mark = np.arange(1, near.shape[1] + 1, dtype=np.uint8)[None, :]
    node = np.maximum(near, 0)
    new = (near >= 0) & (stamp[own, node] == 0)
    row, place = np.nonzero(new)
    stamp[own[row, 0], node[row, place]] = mark[0, place]
    return np.where(new & (stamp[own, node] == mark), near, -1)


def walk(vectors: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities of the ``beam`` best nodes found for each query, best first; -1 where fewer."""
    out_ids = np.full((len(queries), beam), -1, np.int32)
    out_sims = np.full((len(queries), beam), -np.inf, np.float32)
    step = max(1, min(STEP_ROWS, STAMPS // max(len(vectors), 1)))
    for a in range(0, len(queries), step):
        rows = np.arange(a, min(a + step, len(queries)))
        own = np.arange(len(rows))[:, None]
        # Of each row and node, the place (from 1) at which the row first met it.
        stamp = np.zeros((len(rows), len(vectors)), np.uint8)
        ids = np.full((len(rows), beam), -1, np.int32)
        sims = np.full((len(rows), beam), -np.inf, np.float32)
        done = np.zeros((len(rows), beam), bool)
        near, sim = fresh(stamp, own, entry[rows]), None
        while len(rows):
            sim = np.matmul(vectors[near], queries[rows][:, :, None])[:, :, 0]
            sim[near < 0] = -np.inf
            all_sims = np.concatenate([sims, sim], axis=1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(all_sims, best, 1), axis=1, kind="stable"), 1)
            sims = np.take_along_axis(all_sims, best, 1)
            ids = np.take_along_axis(np.concatenate([ids, near], axis=1), best, 1)
            done = np.take_along_axis(np.concatenate([done, near < 0], axis=1), best, 1)
            waiting = ~done & (ids >= 0)
            live = waiting.any(axis=1)
            if not live.all():
                ended = ~live
                out_ids[rows[ended]], out_sims[rows[ended]] = ids[ended], sims[ended]
                rows, own, ids, sims, done, waiting = (x[live] for x in (rows, own, ids, sims, done, waiting))
                if not len(rows):
                    break
            # The first few waiting places of each row.
            place = np.argsort(~waiting, axis=1, kind="stable")[:, :EXPANDED]
            chosen = np.take_along_axis(waiting, place, 1)
            np.put_along_axis(done, place, True, 1)
            near = neighbours[np.take_along_axis(ids, place, 1)]
            near[~chosen] = -1
            near = fresh(stamp, own, near.reshape(len(rows), -1))
    return out_ids, out_sims


def diverse(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 for none) up to ``degree`` neighbours.

    A candidate is taken if it is nearer to the node than to any taken before; free places go to the best others.
    """
    own = vectors[ids]
    between = np.matmul(own, own.transpose(0, 2, 1))
    taken = np.zeros(ids.shape, bool)
    for j in range(ids.shape[1]):
        nearer = (between[:, j, :j] > sims[:, j, None]) & taken[:, :j]
        taken[:, j] = (ids[:, j] >= 0) & ~nearer.any(axis=1) & (taken[:, :j].sum(axis=1) < degree)
    rank = np.where(taken, 0, np.where(ids >= 0, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :degree]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)


class Graph:
    """Layers over unit vectors; layer ``l`` holds the first ``counts[l]`` of them."""

    def __init__(self, vectors: np.ndarray, counts: list[int], layers: list[np.ndarray]):
        self.vectors, self.counts, self.layers = vectors, counts, layers

    @staticmethod
    def build(vectors: np.ndarray) -> Graph:
        """``vectors`` in random order: then each layer is a prefix of the one below."""
        counts = [len(vectors)]
        while counts[-1] > LAYER * 4:
            counts.append(-(-counts[-1] // LAYER))
        graph = Graph(vectors, counts, [np.zeros((0, 0), np.int32)] * len(counts))
        for layer in reversed(range(len(counts))):
            degree = DEGREE if layer else BASE_DEGREE
            graph.layers[layer] = np.full((counts[layer], degree), -1, np.int32)
            at = 0
            while at < counts[layer]:
                size = min(max(64, at // 2), 1024, counts[layer] - at)
                graph.insert(layer, at, at + size, degree)
                at += size
        return graph

    def insert(self, layer: int, a: int, b: int, degree: int) -> None:
        """Link the vectors ``a..b`` on a layer that holds those before."""
        v, links = self.vectors, self.layers[layer]
        own = v[a:b] @ v[a:b].T
        np.fill_diagonal(own, -np.inf)
        near = min(BUILD_BEAM, b - a)
        place = np.argpartition(-own, near - 1, axis=1)[:, :near]
        ids, sims = (place + a).astype(np.int32), np.take_along_axis(own, place, 1)
        if a:
            entry = self.entries(v[a:b], layer, a)
            found, sim = walk(v, links, v[a:b], entry, BUILD_BEAM)
            ids, sims = np.concatenate([ids, found], axis=1), np.concatenate([sims, sim], axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        ids[sims == -np.inf] = -1
        links[a:b] = diverse(v, ids, sims, degree)
        # Each new link also leads back; a node with too many links chooses again.
        back = links[a:b]
        source = np.repeat(np.arange(a, b, dtype=np.int32), degree)[(back >= 0).ravel()]
        target = back[back >= 0]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        # A node that very many new ones name keeps the first of them; others still reach it by their own link.
        count = np.minimum(count, 2 * degree)
        width = int(count.max(initial=0))
        added = np.full((len(nodes), width), -1, np.int32)
        for j in range(width):
            has = count > j
            added[has, j] = source[first[has] + j]
        for x in range(0, len(nodes), STEP_ROWS):
            own = nodes[x: x + STEP_ROWS]
            ids = np.concatenate([links[own], added[x: x + STEP_ROWS]], axis=1)
            ids = np.where((ids[:, :, None] == ids[:, None, :]).argmax(axis=2) == np.arange(ids.shape[1]), ids, -1)
            sims = np.matmul(v[ids], v[own][:, :, None])[:, :, 0]
            sims[ids < 0] = -np.inf
            order = np.argsort(-sims, axis=1, kind="stable")
            links[own] = diverse(v, np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), degree)

    def entries(self, queries: np.ndarray, layer: int, held: int) -> np.ndarray:
        """Where the queries enter ``layer``: the best few of the layers above, or the layer's first nodes."""
        above = [x for x in range(layer + 1, len(self.counts))]
        if not above or held < self.counts[layer + 1]:
            return np.tile(np.arange(min(held, 4), dtype=np.int32), (len(queries), 1))
        entry = np.tile(np.arange(min(self.counts[-1], 4), dtype=np.int32), (len(queries), 1))
        for x in reversed(above):
            entry, _ = walk(self.vectors, self.layers[x], queries, entry, 8)
            entry = np.where(entry >= 0, entry, entry[:, :1])
        return entry

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        return walk(self.vectors, self.layers[0], queries, self.entries(queries, 0, len(self.vectors)), beam)


def scanned(graph: Graph, queries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (query, node) above ``threshold``, by comparison with every node."""
    rows, nodes = [], []
    for a in range(0, len(queries), STEP_ROWS):
        q, n = np.nonzero(queries[a: a + STEP_ROWS] @ graph.vectors.T >= threshold)
        rows.append(q + a)
        nodes.append(n)
    return np.concatenate(rows), np.concatenate(nodes)


def probes(graph: Graph, threshold: float, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors made to link, just, with a node each: nodes turned by the angle of the threshold in a random direction."""
    nodes = np.linspace(0, len(graph.vectors) - 1, min(AUDITED, len(graph.vectors))).astype(int)
    if graph.vectors.shape[1] < 2:
        return graph.vectors[nodes], nodes
    v = graph.vectors[nodes].astype(np.float64)
    side = np.random.default_rng(len(own)).normal(size=v.shape)
    side -= (side * v).sum(axis=1, keepdims=True) * v
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = min(1.0, threshold + 2 * SLACK)
    return (cosine * v + (1 - cosine**2) ** 0.5 * side).astype(np.float32), nodes


def near_pairs(graph: Graph, queries: np.ndarray, threshold: float, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (query, node) above ``threshold`` and the beam the audit asked for (0: the scan).

    ``own`` is the node that is the query itself, or -1. An audit asks for ``RECALL`` of the links of sampled queries,
    matches with themselves left out, and of the probes' links; so it says something where hardly any vectors link.
    """
    sample = np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(int)
    true_rows, true_nodes = scanned(graph, queries[sample], threshold)
    truth = {(q, n) for q, n in zip(sample[true_rows].tolist(), true_nodes.tolist()) if own[q] != n}
    planted, targets = probes(graph, threshold, own)
    beam = min(FIRST_BEAM, len(graph.vectors))
    while beam <= min(WIDEST_BEAM, len(graph.vectors)):
        near, _ = graph.search(planted, beam)
        if (near == targets[:, None]).any(axis=1).mean() < RECALL:
            beam *= 2
            continue
        pairs, left, wide = [], np.arange(len(queries)), beam
        while len(left) and wide <= WIDEST_BEAM:
            ids, sims = graph.search(queries[left], min(wide, len(graph.vectors)))
            full = (sims[:, -1] >= threshold) & (ids.shape[1] < len(graph.vectors))
            row, place = np.nonzero((sims >= threshold) & (ids >= 0) & ~full[:, None])
            pairs.append((left[row], ids[row, place]))
            left, wide = left[full], wide * 2
        if len(left):  # more links than the widest beam holds
            row, node = scanned(graph, queries[left], threshold)
            pairs.append((left[row], node))
        rows, nodes = (np.concatenate(x) for x in zip(*pairs))
        audited = np.isin(rows, sample)
        found = set(zip(rows[audited].tolist(), nodes[audited].tolist()))
        if len(truth & found) >= RECALL * len(truth):
            return rows, nodes, beam
        beam *= 2
    return *scanned(graph, queries, threshold), 0


def united(rows: np.ndarray, nodes: np.ndarray, row_ids: np.ndarray, node_ids: np.ndarray) -> dict[int, int]:
    """The least id each linked id is connected to by these pairs."""
    ids, back = np.unique(np.concatenate([row_ids[rows], node_ids[nodes]]), return_inverse=True)
    a, b = back[: len(rows)], back[len(rows):]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return dict(zip(ids.tolist(), ids[label].tolist()))
        label = new


def near_vectors(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding",
                 shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``key, n_links, component_id, kept, beam``: each vector's links at cosine ``threshold`` or more.

    Null or zero vectors, and those with null or non-finite parts, link with nothing; so do vectors of different
    length. Every row counts as a vector, also one of a repeated id. ``beam`` is the widest beam an audit asked
    for (0: a scan). Other columns are not read; an empty table gives an empty table.
    """
    kind = vectors.schema[key].dataType.simpleString()
    good = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    good = F.coalesce(good & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(good, F.col("v")))
    named = rows.select("k", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    usable = named.where("v is not null and k is not null")
    classes = written(
        usable.groupBy("h1", "h2").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")),
        "vector-classes",
    )
    total = classes.count()
    shards, blocks = max(LEAST_SHARDS, -(-total // shard_rows)), max(1, -(-total // BLOCK_ROWS))
    dealt = classes.select("rep", "copies", "v", F.size("v").alias("dim")).withColumns({
        "shard": F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int"),
        "block": F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(blocks)).cast("int"),
    })

    def indexed(shard: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["rep"].to_numpy()
        order = np.argsort(mixed(ids.astype(np.int64).view(np.uint64), 1))
        v = np.stack(pdf["v"].tolist())[order]
        unit = (v / np.linalg.norm(v / np.abs(v).max(axis=1, keepdims=True), axis=1, keepdims=True)
                / np.abs(v).max(axis=1, keepdims=True)).astype(np.float32)
        graph = Graph.build(unit)
        links = b"".join(x.tobytes() for x in graph.layers)
        counts = np.array(graph.counts, np.int64).tobytes()
        row = (shard[0], shard[1], ids[order].tobytes(), pdf["copies"].to_numpy()[order].tobytes(), v.tobytes(), counts, links)
        return pd.DataFrame([row], columns=["shard", "dim", "ids", "copies", "v", "counts", "links"])

    graphs = written(
        dealt.groupBy("shard", "dim").applyInPandas(
            indexed, "shard int, dim int, ids binary, copies binary, v binary, counts binary, links binary"
        ),
        "vector-graphs",
    )

    def queried(task: tuple, graph_rows: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        columns = ["rep", "to", "n", "beam"]
        if not len(graph_rows) or not len(pdf):
            return pd.DataFrame(columns=columns)
        g, dim = graph_rows.iloc[0], int(task[1])
        node_ids, copies = np.frombuffer(g["ids"], np.int64), np.frombuffer(g["copies"], np.int64)
        exact = np.frombuffer(g["v"], np.float64).reshape(-1, dim)
        counts = np.frombuffer(g["counts"], np.int64).tolist()
        flat, layers, at = np.frombuffer(g["links"], np.int32), [], 0
        for i, n in enumerate(counts):
            degree = DEGREE if i else BASE_DEGREE
            layers.append(flat[at: at + n * degree].reshape(n, degree))
            at += n * degree

        def units(x: np.ndarray) -> np.ndarray:
            x = x / np.abs(x).max(axis=1, keepdims=True)
            return x / np.linalg.norm(x, axis=1, keepdims=True)

        ids, v = pdf["rep"].to_numpy(np.int64), np.stack(pdf["v"].tolist())
        unit, node_unit = units(v), units(exact)
        graph = Graph(node_unit.astype(np.float32), counts, layers)
        order = np.argsort(node_ids)
        place = np.minimum(np.searchsorted(node_ids, ids, sorter=order), len(node_ids) - 1)
        own = np.where(node_ids[order[place]] == ids, order[place], -1)
        q, n, beam = near_pairs(graph, unit.astype(np.float32), threshold - SLACK, own)
        other = ids[q] != node_ids[n]
        q, n = q[other], n[other]
        sure = np.zeros(len(q), bool)
        for a in range(0, len(q), 1 << 16):
            part = slice(a, a + (1 << 16))
            sure[part] = np.einsum("ij,ij->i", unit[q[part]], node_unit[n[part]]) >= threshold
        q, n = q[sure], n[sure]
        pair = np.unique(q * len(node_ids) + n)
        q, n = pair // len(node_ids), pair % len(node_ids)
        near = np.bincount(q, copies[n], len(ids)).astype(np.int64)
        to = united(q, n, ids, node_ids) if len(q) else {}
        linked = np.flatnonzero(near)
        out = pd.DataFrame({"rep": ids[linked], "to": ids[linked], "n": near[linked], "beam": beam})
        forest = pd.DataFrame({"rep": list(to), "to": list(to.values()), "n": 0, "beam": beam})
        return pd.concat([out, forest], ignore_index=True).astype({"rep": np.int64, "to": np.int64, "n": np.int64})

    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    asked = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dim", "block", "rep", "v")
    asked = asked.select("shard", "dim", "block", "rep", "v")
    index = graphs.select("*", every)
    met = written(
        index.groupBy("shard", "dim", "block").cogroup(asked.groupBy("shard", "dim", "block")).applyInPandas(
            lambda task, g, q: queried((task[0], task[1]), g, q), "rep long, to long, n long, beam int"
        ),
        "vector-links",
    )
    groups = components(met.where("n = 0 and rep <> to").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    links = met.where("n > 0").groupBy("rep").agg(F.sum("n").alias("n"), F.max("beam").alias("beam"))
    of_class = (
        classes.select("h1", "h2", "rep", "copies")
        .join(links, "rep", "left")
        .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            F.col("h1").alias("c1"), F.col("h2").alias("c2"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component"), "beam",
        )
    )
    usable_row = F.col("v").isNotNull() & F.col("k").isNotNull()
    found = named.select("k", "h1", "h2", usable_row.alias("usable")).join(
        of_class, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & F.col("usable"), "left"
    )
    component = F.coalesce("component", "k").cast(kind)
    return found.select(
        F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), (F.col("k") == component).alias("kept"), "beam",
    )
