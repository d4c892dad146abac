"""Encoding, section counts and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from resonance.llm import attribution, bpe, packing

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


@pytest.fixture(scope="module")
def byte_vocabulary():
    return bpe.Vocabulary.read(public_tokenizers.path(BYTE))


@pytest.fixture(scope="module")
def word_vocabulary():
    return bpe.Vocabulary.read(public_tokenizers.path(WORD))


def odd_texts(n=1500):
    r = random.Random(3)
    letters = "aab''''srtmdlvez  \n\t,.!09é字😀ΣÉ½ ́"
    return ["", "a" * 700, "ab" * 400, "ΑΣ ΟΔΟΣ", "<|endoftext|>", "a<|endoftext|> b"] + [
        "".join(r.choice(letters) for _ in range(r.randint(1, 40))) for _ in range(n)
    ]


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_ids_equal_the_library(name):
    library, mine = Tokenizer.from_file(public_tokenizers.path(name)), bpe.Encoder(bpe.Vocabulary.read(public_tokenizers.path(name)))
    texts = odd_texts()
    ids, counts, _ = mine.encode(texts)
    edges = np.append(0, np.cumsum(counts))
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[edges[i]: edges[i + 1]].tolist() == e.ids, texts[i]


def test_long_word_merges_alike(byte_vocabulary):
    r = random.Random(5)
    word = "".join(r.choice("abcde") for _ in range(5000))
    want = Tokenizer.from_file(public_tokenizers.path(BYTE)).encode(word).ids
    assert bpe.Encoder(byte_vocabulary).encode([word])[0].tolist() == want


def test_forgetting_changes_nothing(byte_vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    enc, fresh = bpe.Encoder(byte_vocabulary), bpe.Encoder(byte_vocabulary)
    for t in odd_texts(60):
        assert enc.encode([t])[0].tolist() == bpe.Encoder(byte_vocabulary).encode([t])[0].tolist()
    assert len(fresh.hashes) == 0


def test_round_trip(odd, none, byte_vocabulary):
    library = Tokenizer.from_file(public_tokenizers.path(BYTE))
    rows = bpe.encode_decode(odd, byte_vocabulary).select("row.doc_id", "row.text", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert len(rows) == odd.count()
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.encode_decode(none, byte_vocabulary).count() == 0


@pytest.mark.parametrize("rule", attribution.RULES)
def test_sections_against_offsets(odd, none, byte_vocabulary, rule):
    library = Tokenizer.from_file(public_tokenizers.path(BYTE))
    rows = attribution.attribute(odd.where("doc_id is not null and doc_id <> 10").distinct(), byte_vocabulary, rule).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    found = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["section"])):
        found.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["n_tokens"], r["n_crossing"], r["doc_tokens"]))
    for i, text in texts.items():
        if i in (None, 10):
            continue
        offsets = library.encode(text, add_special_tokens=False).offsets
        starts = attribution.line_starts(text)
        ends = starts[1:] + [len(text)]
        owner = np.repeat(np.arange(len(starts)), np.diff(starts + [len(text)]))
        n, cross = [0] * len(starts), [0] * len(starts)
        for a, b in offsets:
            parts = owner[a:b].tolist()
            n[{"first": parts[0], "last": parts[-1], "largest": max(sorted(set(parts)), key=parts.count)}[rule]] += 1
            for p in set(parts) if len(set(parts)) > 1 else ():
                cross[p] += 1
        assert found[i] == [(a, b - a, x, y, len(offsets)) for a, b, x, y in zip(starts, ends, n, cross)], i
    assert attribution.attribute(none, byte_vocabulary).count() == 0


def check_pieces(rows, want, capacity=2048):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(want)
    for i, own in pieces.items():
        ids, at = want[i], 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            part = np.array(ids[at: at + r["length"]], "<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        padding += capacity - at
    return padding, len(sequences)


def test_packing_of_documents(docs, word_vocabulary):
    library = Tokenizer.from_file(public_tokenizers.path(WORD))
    want = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    padding, _ = check_pieces(packing.pack(docs, word_vocabulary).collect(), want)
    assert padding < 2048
    padding, n = check_pieces(packing.pack(docs, word_vocabulary, shard_rows=40).collect(), want)
    assert padding < 2048 * 12 and n > 60


def test_packing_of_odd_rows(odd, none, word_vocabulary):
    rows = packing.pack(odd, word_vocabulary).collect()
    whole = [r for r in rows if r["start"] == 0]
    assert len(whole) == odd.count()
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in whole)
    assert packing.pack(none, word_vocabulary).count() == 0


def test_assignment_fills_and_balances():
    r = random.Random(1)
    for n in (0, 1, 3, 400):
        lengths = sorted((r.randint(1, 2047) for _ in range(n)), reverse=True)
        found = packing.assign(lengths)
        loads, costs = {}, {}
        for length, parts in zip(lengths, found):
            assert sum(p[1] for p in parts) == length
            for _, size, s, offset in parts:
                assert offset == loads.get(s, 0)
                loads[s] = loads.get(s, 0) + size
                costs[s] = costs.get(s, 0) + packing.cost(size)
        assert sum(x == 2048 for x in loads.values()) == sum(lengths) // 2048
    full = [costs[s] for s in loads if loads[s] == 2048]
    assert max(full) < 1.6 * min(full)


LARGE = [(2**60 + 1, "one two three four five"), (2**60 + 2, "six seven eight nine ten"), (None, "no id here at all")]


@pytest.mark.parametrize("run", [
    lambda d, v: packing.pack(d, v).select("doc_id").distinct(), lambda d, v: attribution.attribute(d, v).select("doc_id").distinct()])
def test_large_ids_beside_nulls_stay_as_they_are(spark, word_vocabulary, run):
    docs = spark.createDataFrame(LARGE, "doc_id long, text string").coalesce(1)
    found = run(docs, word_vocabulary)
    assert {r["doc_id"] for r in found.collect()} == {i for i, _ in LARGE} and dict(found.dtypes) == {"doc_id": "bigint"}


def test_copies_of_a_row_are_spread_over_shards(spark, word_vocabulary):
    docs = spark.range(0, 600, 1, 3).selectExpr("1 AS doc_id", "repeat('a copy ', 40) AS text")
    found = packing.pack(docs, word_vocabulary, shard_rows=60).collect()
    assert len({r["sequence_id"] >> 40 for r in found}) > 5
    lengths = {}
    for r in found:
        lengths.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in lengths.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0, *[n for _, n in pieces]])[:-1].tolist()
