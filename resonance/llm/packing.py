"""Cost-balanced packing of token sequences for training.

A document's ids are cut into full windows, each a sequence by itself, and a rest. Rests are packed per
shard: in descending length, each goes to the sequence of lowest estimated cost (linear in tokens plus
quadratic attention within the document) that still has room; a rest that no sequence can hold is cut over
those with room, lowest cost first. A shard opens exactly as many sequences as its rests fill, so at most
one sequence of each shard is padded.

Ids leave a task only as rests (shorter than a window); one shuffle deals them to shards. A shard holds
some thousands of rests whatever the corpus, so its memory is bounded.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonance.llm.bpe import Vocabulary, encoder
from resonance.llm.support import slices

#: Tokens in a sequence.
CAPACITY = 2048
#: Documents whose rests are packed together.
SHARD_ROWS = 4096
#: Shards that the copies of one row are spread over, in groups of neighbours.
SALTS = 1024
#: Cost of a piece: LINEAR per token and QUADRATIC per pair of its tokens.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048


def cost(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


def assign(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int, int]]]:
    """Pieces ``(start, length, sequence, offset)`` of each rest; ``lengths`` descend, each below capacity.

    The number of sequences is the sum of lengths over capacity, rounded up: the last one alone is smaller.
    """
    total = sum(lengths)
    full, left = divmod(total, capacity)
    room = [capacity] * full + ([left] if left else [])
    size = list(room)
    spent = [0.0] * len(room)
    heap = [(0.0, s) for s in range(len(room))]
    out, longest = [], max(room, default=0)
    for length in lengths:
        pieces, at, aside = [], 0, []
        if length <= longest:  # else no sequence can have room for all of it
            while heap:
                c, s = heapq.heappop(heap)
                if room[s] >= length:
                    pieces.append((0, length, s, size[s] - room[s]))
                    room[s] -= length
                    spent[s] = c + cost(length)
                    at = length
                    if room[s]:
                        heapq.heappush(heap, (spent[s], s))
                    break
                aside.append((c, s))
            for entry in aside:
                heapq.heappush(heap, entry)
            if at < length:
                longest = max((room[s] for _, s in heap), default=0)
        while at < length:
            c, s = heapq.heappop(heap)
            take = min(length - at, room[s])
            pieces.append((at, take, s, size[s] - room[s]))
            room[s] -= take
            at += take
            if room[s]:
                heapq.heappush(heap, (c + cost(take), s))
        out.append(pieces)
    return out


def pack(docs: DataFrame, vocabulary: Vocabulary, end_id: int = 1, capacity: int = CAPACITY,
         shard_rows: int = SHARD_ROWS, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``).

    A document's ids end with ``end_id``. A null text is taken as empty and gives that id alone. Rows with
    equal or null keys are packed as documents of their own, repeated rows in shards of their own (rows are told apart
    by their place in the table, which must be the same if it is read again). Of rests of equal length the one with the
    lesser key (as text) comes first. Other columns are not read. An empty table gives no row. Vocabularies of more than
    65 536 ids are refused.
    """
    if vocabulary.size > 1 << 16:
        raise ValueError("ids of this vocabulary do not fit 16 bits")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)  # fixed size: the vocabulary file
    kind = docs.schema[key].dataType.simpleString()
    shards = max(1, -(-docs.count() // shard_rows))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(shared.value)
        for batch in batches:
            texts, keys, shard = batch["t"].tolist(), batch["k"].tolist(), batch["s"].tolist()
            for a, b in slices(texts):
                ids, counts, _ = enc.encode(texts[a:b])
                edges = np.append(0, np.cumsum(counts)).tolist()
                rows = []
                for i in range(a, b):
                    own = np.append(ids[edges[i - a]: edges[i - a + 1]], end_id).astype("<u2")
                    n = len(own)
                    for start in range(0, n, capacity):
                        piece = own[start: start + capacity]
                        crc = None
                        if len(piece) == capacity and not with_ids:
                            piece, crc = None, zlib.crc32(piece.astype("<u4").tobytes())
                        rows.append((shard[i], keys[i], start, n, crc, None if piece is None else piece.tobytes()))
                yield pd.DataFrame(rows, columns=["s", "k", "start", "n", "crc", "piece"]).astype({"crc": "Int64"})

    def shard_pieces(shard: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pieces = rows["piece"].tolist()
        sizes = np.array([capacity if p is None else len(p) // 2 for p in pieces], np.int64)
        rows = rows.assign(size=sizes)
        order = rows.sort_values(["size", "k", "start", "n"], ascending=[False, True, True, True]).index.tolist()
        full = [i for i in order if sizes[i] == capacity]
        rest = [i for i in order if sizes[i] < capacity]
        keys, starts, totals, crcs = (rows[c].tolist() for c in ("k", "start", "n", "crc"))
        base, out = int(shard[0]) << 40, []

        def put(i: int, start: int, length: int, sequence: int, offset: int) -> None:
            own = pieces[i]
            part = None if own is None else np.frombuffer(own, "<u2")[start: start + length].astype("<u4")
            crc = int(crcs[i]) if part is None else zlib.crc32(part.tobytes())
            row = (keys[i], starts[i] + start, length, crc, totals[i], base + sequence, offset)
            out.append((*row, part.tolist()) if with_ids else row)

        for sequence, i in enumerate(full):
            put(i, 0, capacity, sequence, 0)
        for i, found in zip(rest, assign([int(sizes[i]) for i in rest], capacity)):
            for start, length, sequence, offset in found:
                put(i, start, length, len(full) + sequence, offset)
        return pd.DataFrame(out, columns=names)

    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = f"`{key}` string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(key), F.col(text), F.monotonically_increasing_id() % SALTS), F.lit(shards)).alias("s"),
        F.col(key).cast("string").alias("k"),  # a column of numbers and nulls would be rounded on its way
        F.coalesce(F.col(text), F.lit("")).alias("t"),
    )
    pieces = rows.mapInPandas(cut, f"s long, k string, start long, n long, crc long, piece binary")
    packed = pieces.groupBy("s").applyInPandas(shard_pieces, schema + (", ids array<int>" if with_ids else ""))
    return packed.withColumn(key, F.col(f"`{key}`").cast(kind))
