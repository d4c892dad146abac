"""The trie of conversation beginnings against one built in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from resonance.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, path string, conv int, n long, key string"


def brute(rows):
    conversations = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            symbol = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest() + len(text.encode()).to_bytes(4, "big")
            conversations[c].append((turn is not None, turn or 0, symbol, (role, text)))
    own = {c: [t[3] for t in sorted(turns)] for c, turns in conversations.items()}
    members = defaultdict(list)
    lengths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole = own.get(base, [])[:h] + turns[h:]
        lengths[c] = len(whole)
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
    below = defaultdict(list)
    for path in members:
        if path:
            below[path[:-1]].append(path)
    found = {}
    for path in sorted(members, key=len, reverse=True):
        m, kids = members[path], below[path]
        ends = ",".join(str(c) for c in sorted(m) if lengths[c] == len(path))
        found[path] = (
            min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(kids),
            sum(found[k][5] for k in kids) or 1,
            sum(found[k][6] for k in kids) + ((len(m) - 1) * len(path[-1][1].encode()) if path else 0),
            hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted(found.values(), key=repr)


def check(spark, rows, parts=4):
    frame = spark.createDataFrame([(*r, "p", 1, 2, "k") for r in rows], SCHEMA).repartition(parts)
    got = sorted((tuple(r) for r in tries.prefix_trie(frame).collect()), key=repr)
    assert got == brute(rows)
    return got


def talks(n, seed, turns=(1, 12), words=("a", "b", "é", "")):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]), r.choice(words)) for c in range(n) for t in range(r.randint(*turns))]


def test_nodes_of_random_talks(spark):
    assert len(check(spark, talks(300, 1))) > 500


def test_blocks_and_pieces_meet_anywhere(spark, monkeypatch):
    monkeypatch.setattr(tries, "BLOCK", 7)
    monkeypatch.setattr(tries, "PIECE", 3)
    check(spark, talks(200, 2, words=("a", "b")), parts=9)
    # Copies over many blocks: what ends at one node is in all of them.
    copies = [(c, t, "user", "same") for c in range(5, 400) for t in range(12)]
    assert len(check(spark, copies)) == 13


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, None, "user", ""), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "assistant", "y"),
        (None, 0, "user", "x"), (None, None, None, None), (7, -3, "u", "long " * 20_000), (-3, 1, "user", "x"), (-5, 1, "user", "x"),
        (1152921504606846976, 0, "user", "x"), (1152921504606846977, 0, "user", "y"), (1152921504606846978, None, "user", "y"),
        (2, 1, "us", "erx"), (2, 2, "user", "x"),
    ]
    check(spark, rows)
    assert check(spark, [(4, 0, "user", "only lent")])[0][1] == 0


def test_long_talks(spark, monkeypatch):
    monkeypatch.setattr(tries, "STEP", 50)
    long = [(c, t, "user", str(t) if t < cut else f"{c}-{t}") for c, cut, n in
            ((0, 0, 300), (5, 200, 260), (10, 200, 200), (15, 64, 64), (20, 64, 65), (25, 63, 64), (30, 200, 200), (35, 500, 210))
            for t in range(n)]
    check(spark, long + talks(40, 3))


def test_no_conversations(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert tries.prefix_trie(frame).collect() == []


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_given_table(spark, sf, size):
    frame = spark.read.parquet(f"{sf.rsplit('/', 1)[0]}/{size}/conversations.parquet")
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in tries.prefix_trie(frame).collect()), key=repr) == brute(rows)
