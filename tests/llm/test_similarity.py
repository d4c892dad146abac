"""Near copies, fingerprints, vectors and components against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from resonance.llm import fingerprint, jaccard, vectors
from resonance.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i: i + width]) for i in range(max(1, len(words) - width + 1))}


def grouped(ids, linked):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def brute(texts, width, num, den):
    sets = {i: shingles(t, width) for i, t in texts.items()}
    links = [
        (a, b) for a, b in itertools.combinations(sets, 2)
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    ]
    return grouped(sets, links), {i: len(s) for i, s in sets.items()}


def variants(n, seed, lengths=(4, 300)):
    """Texts in families whose members differ by a few words, around both thresholds."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    texts, base = {}, []
    for i in range(n):
        if i % 12 == 0:
            base = [word() for _ in range(r.randint(*lengths))]
        own = list(base)
        for _ in range(r.randint(0, max(1, len(base) // 40))):
            at = r.randrange(len(own))
            own[at: at + r.randint(0, 1)] = [word()] * r.randint(0, 2)
        texts[i] = " ".join(own)
    return texts


@pytest.mark.parametrize("width, num", [(3, 90), (5, 80)])
def test_groups_equal_brute_force(spark, width, num, monkeypatch):
    texts = variants(420, 7)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want, sizes = brute(texts, width, num, 100)
    found = {r["doc_id"]: r for r in jaccard.similar_groups(frame, width, num, 100).collect()}
    assert {i: r["component_id"] for i, r in found.items()} == want
    assert {i: r["n_shingles"] for i, r in found.items()} == sizes
    assert 20 < len(set(want.values())) < 400


@pytest.mark.parametrize("tasks, keys", [(100_000, 2_000_000), (0, 2_000_000), (0, 0)])
def test_sets_travel_to_their_regions_in_rounds(spark, monkeypatch, tasks, keys):
    texts, kept = variants(300, 5), []
    monkeypatch.setattr(jaccard, "TASKS_SENT", tasks)
    monkeypatch.setattr(jaccard, "KEYS_SENT", keys)
    monkeypatch.setattr(jaccard, "ROUND_BYTES", 5000)
    monkeypatch.setattr(jaccard, "written", lambda df, label, whole=jaccard.written: kept.append((label, whole(df, label))) or kept[-1][1])
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want, _ = brute(texts, 3, 90, 100)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(frame, 3, 90).collect()} == want
    rounds = [df.count() for label, df in kept if label == "jaccard-links"]
    assert len(rounds) == jaccard.ROUNDS and sum(n > 0 for n in rounds) > 1


def test_large_regions_are_cut_into_blocks(spark, monkeypatch):
    texts = variants(240, 11, (200, 210))
    texts = {i: " ".join(texts[0].split()[:150] + texts[i].split()[-50:]) for i in texts} | {1000 + i: t for i, t in texts.items()}
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "FLUSH", 5000)
    monkeypatch.setattr(jaccard, "RANGE_CELLS", 2000)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    want, _ = brute(texts, 3, 90, 100)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(frame, 3, 90).collect()} == want


def test_voronoi_parts_lose_no_link():
    rule = jaccard.Rule(90, 100)
    r = np.random.default_rng(2)
    base = [r.integers(0, 1 << 60, 120, dtype=np.uint64) for _ in range(12)]
    sets = []
    for i in range(300):
        own = base[i % 12].copy()
        own[r.integers(0, 120, r.integers(0, 12))] = r.integers(0, 1 << 60, 1, dtype=np.uint64)
        sets.append(np.unique(own))
    region = jaccard.Region(sets, rule)
    region.join(np.arange(len(sets)))
    links = [
        (a, b) for a, b in itertools.combinations(range(len(sets)), 2)
        if 100 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 90 * (len(sets[a]) + len(sets[b]) - n)
    ]
    assert grouped(range(300), region.forest.links) == grouped(range(300), links)


@pytest.mark.parametrize("num", [80, 90])
def test_linked_sets_share_a_cell(num):
    rule, r = jaccard.Rule(num, 100), np.random.default_rng(4)
    for n in [*range(1, 60), 100, 333, 1500]:
        own = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        most = n * (100 - num) // num  # differences a linked set may have
        for gone in {0, most // 2, most}:
            new = r.integers(0, 1 << 63, most - gone, dtype=np.uint64)
            other = np.unique(np.concatenate([own[gone:], new]))
            both = len(np.intersect1d(own, other))
            if 100 * both >= num * (len(own) + len(other) - both) and most:
                assert set(rule.cells(own)) & set(rule.cells(other)), (n, gone)


def test_groups_of_odd_rows(odd, none):
    rows = jaccard.similar_groups(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[5]["component_id"] == 1 and by_id[1]["n_shingles"] == 2
    assert all(by_id[i]["n_shingles"] == 0 and by_id[i]["component_id"] == i for i in (2, 3, 4))
    assert by_id[None]["component_id"] is None
    assert jaccard.similar_groups(none).count() == 0


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(230)] + [(i, i + 1) for i in range(500, 560)]
    frame = spark.createDataFrame(edges + [(3, 3), (None, 4)], "a long, b long")
    want = grouped({x for e in edges for x in e}, edges)
    found = {row["node"]: row["component"] for row in components(frame).collect()}
    assert found == {i: c for i, c in want.items() if any(i in e for e in edges if e[0] != e[1])}
    assert components(frame.where("a < 0")).count() == 0


def test_fingerprints_follow_the_contract(docs):
    rows = {r["doc_id"]: r for r in fingerprint.fingerprint_edits(docs).collect()}
    order = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    prints = {}
    for at, (i, text) in enumerate(order):
        following = order[(at + 1) % len(order)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        assert rows[i]["n_chars"] == len(text)
        assert rows[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert prints.setdefault(text, rows[i]["fingerprint"]) == rows[i]["fingerprint"]
        assert rows[i]["edited_fingerprint"] == fingerprint.fingerprints([changed])[0].tobytes().hex()
    above = [r["near_edited"] > r["near_next"] for r in rows.values()]
    assert np.mean(above) > 0.95
    assert np.mean([r["near_edited"] for r in rows.values()]) > 0.4 > 0.1 > np.mean([r["near_next"] for r in rows.values()])


def test_fingerprints_of_odd_rows(odd, none, spark, monkeypatch):
    assert fingerprint.fingerprint_edits(odd).count() == odd.count()
    assert fingerprint.fingerprint_edits(none).count() == 0
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    row = fingerprint.fingerprint_edits(one).first()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()


def test_an_edit_stays_local():
    text = " ".join(f"word{i * 7919 % 1000}" for i in range(400))
    a, b = fingerprint.fingerprints([text, text[:900] + "X" + text[900:]])
    assert fingerprint.likeness(a[None], b[None])[0] > 0.9


def vector_rows(n=900, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(40, 16))
    x = r.normal(size=(n, 16))
    near = np.arange(n) % 2 == 0
    x[near] = centres[r.integers(0, 40, near.sum())] + 0.15 * r.normal(size=(near.sum(), 16))
    x[5] = x[3]
    x[6] = 4 * x[3]
    return x.astype(np.float32)


def test_vectors_equal_brute_force(spark):
    x = vector_rows()
    rows = [(int(i), [float(v) for v in x[i]]) for i in range(len(x))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    want = grouped(range(len(x)), zip(*(a.tolist() for a in np.nonzero(near))))
    found = {r["vec_id"]: r for r in vectors.near_vectors(frame).collect()}
    links = np.array([found[i]["n_links"] for i in range(len(x))])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.99 * near.sum()
    assert {i: r["component_id"] for i, r in found.items()} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.values())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], "x"), (2, None, "x"), (3, [0.0, 0.0], "x"), (4, [1.0, nan], "x"), (5, [inf, 1.0], None), (6, [], "x"),
            (7, [1.0, None], "x"), (8, [2.0, 0.0], "x"), (9, [1.0, 0.0, 0.0], "x"), (None, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep string")
    found = vectors.near_vectors(frame).collect()
    assert len(found) == len(rows)
    by_id = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found}
    assert by_id[1] == (2, 1) and by_id[8] == (2, 1)
    assert all(by_id[i] == (0, i) for i in (2, 3, 4, 5, 6, 7, 9)) and by_id[None] == (0, None)
    assert vectors.near_vectors(frame.where("vec_id < 0")).count() == 0


def test_large_ids_beside_nulls_are_not_confused(spark):
    rows = [(2**60 + 1, "a b c d e f g"), (2**60 + 2, "h i j k l m n"), (None, "o p q r s t"), (2**60 + 3, "a b c d e f g")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(frame).collect()}
    assert found == {2**60 + 1: 2**60 + 1, 2**60 + 2: 2**60 + 2, 2**60 + 3: 2**60 + 1, None: None}


def test_components_that_do_not_end_are_an_error(spark, monkeypatch):
    from resonance.llm import components as module

    monkeypatch.setattr(module, "MAX_ROUNDS", 1)
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    with pytest.raises(RuntimeError, match="not complete"):
        components(edges)


def some_vectors(n, d=32, seed=9):
    v = np.random.default_rng(seed).normal(size=(n, d))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def test_audit_sees_a_broken_graph_where_nothing_links():
    v = some_vectors(3000)
    graph = vectors.Graph.build(v)
    _, _, beam = vectors.near_pairs(graph, v[:600], 0.95, np.arange(600))
    assert 0 < beam <= vectors.WIDEST_BEAM
    # No node leads to another: no query links with any but itself, yet the probes do not find their nodes.
    broken = vectors.Graph(v, graph.counts, [np.full_like(x, -1) for x in graph.layers])
    rows, nodes, beam = vectors.near_pairs(broken, v[:600], 0.95, np.arange(600))
    assert beam == 0 and (rows == nodes).all() and len(rows) == 600


def test_probes_link_with_their_nodes_and_hardly_more():
    v = some_vectors(500, 8)
    graph = vectors.Graph.build(v)
    planted, targets = vectors.probes(graph, 0.95, np.arange(500))
    cosines = (planted.astype(np.float64) * v[targets]).sum(axis=1)
    assert (cosines >= 0.95).all() and (cosines < 0.951).all()
    one = vectors.Graph.build(some_vectors(5, 1))
    assert len(vectors.probes(one, 0.95, np.arange(5))[0]) == 5
