"""The trie of conversation beginnings, from sorted conversations.

Conversations are sorted as sequences of turns; a node of the trie is a run of neighbours that agree in their first d
turns. In a block of sorted neighbours the edges, each as deep as two neighbours agree, are taken in descending depth;
a union-find joins runs, and every join is a branching node. Between two branching nodes lie chains of nodes with the
same members. What touches the ends of a block may go on in the next one: each block hands on only the nodes along its
first and its last conversation, with the sums of what hangs below them; these forests are merged node by node.

Texts are never gathered: a turn is a symbol of 20 bytes. A conversation is cut into pieces of bounded length, and only
as much of it is sorted as another may share: 64 turns, or all its turns where another one begins with the same 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resonance.llm.support import shuffles_dropped
from resonance.sources.scratch import written

#: Bytes of a symbol: 16 of the turn's digest, 4 of its text's length in bytes.
SYMBOL = 20
#: Turns that all conversations are sorted by; most turns another conversation can lend; turns of a piece.
FRONT, LENT, PIECE = 64, 8, 4096
#: Conversations of a block; bytes of ids hashed at once; nodes of a chain that one row stands for at first.
BLOCK, ID_BYTES, STEP = 200_000, 16_384, 10_000

NOTHING = hashlib.sha256(b"").hexdigest()
#: Kinds of rows a block gives: a whole node, one whose parent goes on elsewhere, a node that goes on elsewhere, ids.
WHOLE, BELOW, OPEN, IDS = 0, 1, 2, 3
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "ends_sha256 string")
ROW = f"kind int, path binary, above binary, {NODE}, bytes long, part int, seq long"


def symbols(conversations: DataFrame) -> DataFrame:
    """``conv, turn, symbol`` of every turn. Rows without a conversation are left out; null roles and texts are empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # The length of the role keeps role and text apart.
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    size = F.lpad(F.hex(F.octet_length(text)), 8, "0")
    turns = conversations.where(F.col("conv_id").isNotNull())
    return turns.select(F.col("conv_id").cast("long").alias("conv"), "turn", F.unhex(F.concat(digest, size)).alias("symbol"))


def _binary(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of a binary column without nulls."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset: column.offset + len(column) + 1]
    return offsets, memoryview(column.buffers()[2] or b"")


def pieces(turns: DataFrame) -> DataFrame:
    """Conversations in order of turns (null first; equal ones by symbol), cut into pieces: ``conv, part, seq, n, blob``.

    Turns are dealt by ranges of (conversation, turn), so a conversation with very many turns lies in many tasks.
    """
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("symbol")]
    names = ["conv", "part", "seq", "n", "blob"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, conv, held = TaskContext.get().partitionId(), 0, None, b""
        rows: list[tuple] = []

        def flush() -> None:
            nonlocal seq, held
            if held:
                rows.append((conv, part, seq, len(held) // SYMBOL, held))
                seq, held = seq + 1, b""

        for batch in batches:
            if not len(batch):
                continue
            convs = batch.column("conv").to_numpy(zero_copy_only=False)
            offsets, data = _binary(batch.column("symbol"))
            starts = np.flatnonzero(np.r_[True, convs[1:] != convs[:-1]]).tolist() + [len(convs)]
            for a, b in zip(starts, starts[1:]):
                if convs[a] != conv:
                    flush()
                    conv = int(convs[a])
                while a < b:
                    to = min(b, a + PIECE - len(held) // SYMBOL)
                    held += bytes(data[offsets[a]: offsets[to]])
                    a = to
                    if len(held) == PIECE * SYMBOL:
                        flush()
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=names).cast(kinds)
                rows.clear()
        flush()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=names).cast(kinds)

    kinds = pa.schema(list(zip(names, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))))
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "symbol")
    return dealt.mapInArrow(cut, "conv long, part int, seq long, n long, blob binary")


def _part(blob: Column, start: Column, n: Column | int | None = None) -> Column:
    """Turns ``[start, start + n)`` of a blob, or all from ``start``."""
    n = F.lit(2**31 - 1 if n is None else n * SYMBOL) if not isinstance(n, Column) else n * SYMBOL
    return F.substring(blob, (start * SYMBOL + 1).cast("int"), n.cast("int"))


def _joined(start: Column, blob: Column) -> Column:
    """Aggregate: blobs put together in order of their starts."""
    parts = F.array_sort(F.collect_list(F.struct(start.alias("s"), blob.alias("b"))))
    return F.aggregate(parts, F.lit(b""), lambda x, y: F.concat(x, y["b"]))


def lent_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first one of its five."""
    return F.crc32(conv.cast("string").cast("binary")) % (LENT + 1)


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv, length, key, alone`` of every rebuilt conversation, and all of them that go on below their key.

    Conversation c begins with the first h turns of conversation c - c % 5 (as many as there are) and goes on with its
    own turns after its first h. ``key`` is what it is sorted by; ``alone`` says that the key is only its beginning and
    no other conversation begins like that.
    """
    cut = written(pieces(symbols(conversations)), "pieces")
    in_order = Window.partitionBy("conv").orderBy("part", "seq")
    # Small rows, one for thousands of turns: a long conversation is still one window of few rows.
    starts = cut.select("conv", "part", "seq", "n").withColumn("until", F.sum("n").over(in_order))
    starts = starts.select("conv", "part", "seq", (F.col("until") - F.col("n")).alias("start"))
    placed = written(cut.join(starts, ["conv", "part", "seq"]), "placed-pieces")

    first = placed.where(F.col("start") < FRONT + LENT)
    front = first.groupBy("conv").agg(_joined(F.col("start"), F.col("blob").substr(F.lit(1), (F.lit(FRONT + LENT) - F.col("start")).cast("int") * SYMBOL)).alias("front"))
    total = placed.groupBy("conv").agg(F.sum("n").alias("total"))
    own = written(front.join(total, "conv"), "fronts")

    base = own.select(F.col("conv").alias("base"), F.col("front").alias("lent"))
    c = own.withColumn("h", lent_turns(F.col("conv"))).withColumn("base", F.col("conv") - F.col("conv") % 5)
    c = c.join(base, "base", "left").withColumn("lent", _part(F.coalesce("lent", F.lit(b"")), F.lit(0), F.col("h")))
    length = F.octet_length("lent") / SYMBOL + F.greatest(F.col("total") - F.col("h"), F.lit(0))
    key = F.substring(F.concat("lent", _part(F.col("front"), F.col("h"))), 1, FRONT * SYMBOL)
    c = written(c.select("conv", "h", "lent", length.cast("long").alias("length"), key.alias("key")), "rebuilt")

    long = c.where(F.col("length") >= FRONT)
    shared = long.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key")
    more = c.where(F.col("length") > FRONT)
    twins = more.join(shared, "key", "left_semi")
    rest = placed.join(twins.select("conv", "h"), "conv").where(F.col("start") + F.col("n") > F.col("h"))
    skipped = F.greatest(F.col("h") - F.col("start"), F.lit(0))
    rest = rest.groupBy("conv").agg(_joined(F.col("start"), _part(F.col("blob"), skipped)).alias("rest"))
    whole = twins.join(rest, "conv").select("conv", "length", F.concat("lent", "rest").alias("key"), F.lit(False).alias("alone"))
    alone = more.join(shared, "key", "left_anti").select("conv", "length", "key", F.lit(True).alias("alone"))
    short = c.where(F.col("length") <= FRONT).select("conv", "length", "key", F.lit(False).alias("alone"))
    return short.unionByName(alone).unionByName(whole), alone


class Part:
    """A component: neighbours that agree in their first ``depth`` turns, seen as the node of that depth.

    ``kids``, ``leaves`` and ``saved`` sum the subtrees below the node that are whole; ``tops`` are rows that wait for
    the node's least conversation.
    """

    __slots__ = ("run", "depth", "n", "least", "kids", "leaves", "saved", "ends", "open", "tops")

    def __init__(self, run: int, depth: int, n: int, least: int, ends: str | None, is_open: bool, goes_on: bool):
        self.run, self.depth, self.n, self.least, self.ends, self.open = run, depth, n, least, ends, is_open
        self.kids = self.leaves = int(goes_on)
        self.saved, self.tops = 0, []


class Block:
    """The forest of one block of sorted conversations."""

    def __init__(self, part: int, before: int, convs: np.ndarray, keys: list[bytes], alone: np.ndarray):
        self.rows: list[tuple] = []
        self.part, self.before = part, before  # its task, and the conversations of earlier blocks there
        fresh = np.array([True, *(a != b for a, b in zip(keys, keys[1:]))])
        self.starts = np.flatnonzero(fresh)
        ends = np.r_[self.starts[1:], len(keys)]
        self.keys = [keys[i] for i in self.starts]
        last = len(self.keys) - 1
        self.paths = {r: self.prefixes(self.keys[r]) for r in {0, last}}
        parts = []
        for r, (a, b) in enumerate(zip(self.starts.tolist(), ends.tolist())):
            if alone[a]:
                hashed = NOTHING
            elif r in (0, last):
                hashed = None
                self.ids(self.paths[r][-1], a, convs[a:b])
            else:
                hashed = hashlib.sha256(",".join(map(str, convs[a:b].tolist())).encode()).hexdigest()
            parts.append(Part(r, len(self.keys[r]) // SYMBOL, b - a, int(convs[a]), hashed, r in (0, last), bool(alone[a])))
        self.join(parts)

    @staticmethod
    def prefixes(key: bytes) -> list[bytes]:
        """The digest of every prefix of a key, by depth."""
        h, out = hashlib.md5(), []
        out.append(h.digest())
        for i in range(0, len(key), SYMBOL):
            h.update(key[i: i + SYMBOL])
            out.append(h.digest())
        return out

    def ids(self, path: bytes, at: int, convs: np.ndarray) -> None:
        """Rows of the ids that end at a node, in order; the node's other ids may be in other blocks."""
        step = ID_BYTES // 20
        for i in range(0, len(convs), step):
            text = ",".join(map(str, convs[i: i + step].tolist()))
            self.rows.append((IDS, path, None, None, None, None, None, None, None, None, text, None, self.part, self.before + at + i))

    def agree(self, a: bytes, b: bytes) -> int:
        """Turns in which two keys agree."""
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            return n // SYMBOL
        differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
        return int(differ.argmax()) // SYMBOL

    def join(self, parts: list[Part]) -> None:
        depths = np.array([self.agree(a, b) for a, b in zip(self.keys, self.keys[1:])], np.int64)
        up = list(range(len(parts)))

        def root(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for edge in np.argsort(-depths, kind="stable").tolist():
            depth, left, right = int(depths[edge]), root(edge), root(edge + 1)
            node = self.raised(parts[left], depth)
            self.hang(node, parts[right], depth)
            up[right], parts[left], parts[right] = left, node, None
        top = parts[root(0)]
        self.close(top, 0)

    def raised(self, part: Part, depth: int) -> Part:
        """``part`` itself if it is the node of that depth, else a new node with ``part`` below it."""
        if part.depth == depth:
            return part
        node = Part(part.run, depth, 0, part.least, NOTHING, False, False)
        self.hang(node, part, depth)
        return node

    def hang(self, node: Part, part: Part, depth: int) -> None:
        """Close ``part`` up to the depth below ``node`` and put it below."""
        node.n += part.n
        node.least = min(node.least, part.least)
        if part.open:
            # Seen along the block's first or last conversation, whose prefixes have names.
            node.open, node.run = True, part.run
        closed = self.close(part, depth + 1)
        if closed:
            leaves, saved, top = closed
            node.kids, node.leaves, node.saved = node.kids + 1, node.leaves + leaves, node.saved + saved
            node.tops.append(top)

    def close(self, part: Part, to: int) -> tuple[int, int, int] | None:
        """Rows of the nodes from ``part`` up to depth ``to``: all have its members. Leaves, saving and row of the top."""
        key, n = self.keys[part.run], part.n
        if part.open:
            paths = self.paths[part.run]
            for top in part.tops:
                self.rows[top] = (BELOW, None, paths[part.depth], *self.rows[top][3:])
            kids, leaves, saved, ends = part.kids, part.leaves, part.saved, part.ends
            for d in range(part.depth, to - 1, -1):
                size = int.from_bytes(key[d * SYMBOL - 4: d * SYMBOL], "big") if d else 0
                self.rows.append((OPEN, paths[d], paths[d - 1] if d else None, part.least, d, None, n, kids, leaves, saved, ends, size, self.part, None))
                kids, leaves, saved, ends = 0, 0, 0, NOTHING
            return None
        for top in part.tops:
            row = self.rows[top]
            self.rows[top] = (*row[:5], part.least, *row[6:])
        leaves, saved, kids, ends = part.leaves if part.kids else 1, part.saved, part.kids, part.ends
        for d in range(part.depth, to - 1, -1):
            if n > 1:
                saved += (n - 1) * int.from_bytes(key[d * SYMBOL - 4: d * SYMBOL], "big")
            self.rows.append((WHOLE, None, None, part.least, d, part.least, n, kids, leaves, saved, ends, None, None, None))
            kids, ends = 1, NOTHING
        return leaves, saved, len(self.rows) - 1


def grown(sorted_convs: DataFrame) -> DataFrame:
    """Rows of ``ROW``: the forest of every block of ``conv, key, alone`` in order of key and conversation."""
    names = [c.split()[0] for c in ROW.split(", ")]
    kinds = [pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string(), pa.int64(), pa.int32(), pa.int64()]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, convs, keys, alone = TaskContext.get().partitionId(), 0, [], [], []

        def emitted() -> Iterator[pa.RecordBatch]:
            rows = Block(part, before, np.concatenate(convs), keys, np.concatenate(alone)).rows
            for i in range(0, len(rows), 50_000):
                columns = zip(*rows[i: i + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                some = batch.slice(at, BLOCK)
                if keys and len(keys) + len(some) > BLOCK:
                    yield from emitted()
                    before, convs, keys, alone = before + len(keys), [], [], []
                convs.append(some.column("conv").to_numpy(zero_copy_only=False))
                keys += some.column("key").to_pylist()
                alone.append(some.column("alone").to_numpy(zero_copy_only=False))
        if keys:
            yield from emitted()

    return sorted_convs.mapInArrow(grow, ROW)


def merged(open_rows: DataFrame) -> DataFrame:
    """The nodes along the ends of blocks, each put together from all blocks it lies in.

    What hangs below them is added up where it lies; the last step, from the deepest node up, is one task over as many
    rows as there are different nodes along the ends of blocks, twice a key's length for each block at most.
    """
    nodes = open_rows.groupBy("path").agg(
        F.min("above").alias("above"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        # A node's ids are in one place (a hash), in several (nulls), or nowhere (the hash of nothing).
        F.max(F.when(F.col("ends_sha256") != NOTHING, F.col("ends_sha256"))).alias("ends_sha256"),
        F.max("bytes").alias("bytes"),
    )
    names = ["path", *[c.split()[0] for c in NODE.split(", ")]]
    kinds = pa.schema(list(zip(names, [pa.binary(), *[pa.int64()] * 7, pa.string()])))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = {}
        for batch in batches:
            for row in batch.to_pylist():
                nodes[row["path"]] = row
        for row in sorted(nodes.values(), key=lambda r: -r["depth"]):
            row["n_leaves"] = row["n_leaves"] if row["n_children"] else 1
            row["saved_tokens"] += (row["n_convs"] - 1) * row["bytes"]
            above = nodes.get(row["above"])
            row["parent_conv_id"] = above and above["conv_id"]
            if above:
                above["n_children"] += 1
                above["n_leaves"] += row["n_leaves"]
                above["saved_tokens"] += row["saved_tokens"]
        found = list(nodes.values())
        for i in range(0, len(found), 10_000):
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in found[i: i + 10_000]], schema=kinds)

    return nodes.repartition(1).mapInArrow(total, f"path binary, {NODE}")


def hashed_ids(id_rows: DataFrame) -> DataFrame:
    """``path, ids_sha256``: one hash over the ids of a node, which come in order and are never held together.

    A hash over one list has one place after another to it: a node whose ids are in many blocks is read by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, state = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([state.hexdigest()])], names=["path", "ids_sha256"])

        for batch in batches:
            for p, text in zip(batch.column("path").to_pylist(), batch.column("ends_sha256").to_pylist()):
                if p != path:
                    if state is not None:
                        yield done()
                    path, state = p, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
        if state is not None:
            yield done()

    rows = id_rows.select("path", "part", "seq", "ends_sha256").repartition("path").sortWithinPartitions("path", "part", "seq")
    return rows.mapInArrow(run, "path binary, ids_sha256 string")


def tails(alone: DataFrame) -> DataFrame:
    """The nodes below the key of a conversation that no other begins like: a chain of one member."""
    spark = alone.sparkSession
    last = F.floor((F.col("length") - FRONT - 1) / STEP)
    steps = alone.select("conv", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("step"))
    steps = steps.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv", "step")
    start = F.lit(FRONT + 1) + F.col("step") * STEP
    depth = F.explode(F.sequence(start, F.least(start + STEP - 1, F.col("length")))).alias("depth")
    rows = steps.select("conv", "length", depth)
    at_end = F.col("depth") == F.col("length")
    values = {
        "conv_id": F.col("conv"), "depth": F.col("depth"), "parent_conv_id": F.col("conv"), "n_convs": F.lit(1),
        "n_children": F.when(at_end, 0).otherwise(1), "n_leaves": F.lit(1), "saved_tokens": F.lit(0),
        "ends_sha256": F.when(at_end, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(NOTHING),
    }
    kinds = dict(c.split() for c in NODE.split(", "))
    return rows.select(*[v.cast(kinds[c]).alias(c) for c, v in values.items()])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Columns of ``NODE`` for every node of the trie of rebuilt conversations (see :func:`rebuilt`).

    Takes ``conv_id, turn, role, text``; other columns do not matter. Rows without a conversation are left out, null
    roles and texts are empty, a null turn comes first, equal turns are ordered by a digest of role and text, repeated
    rows are repeated turns. No conversations: no nodes. A conversation that shares its first 64 turns with another is
    sorted whole, at 20 bytes a turn.
    """
    spark = conversations.sparkSession
    columns = [c.split()[0] for c in NODE.split(", ")]
    with shuffles_dropped(spark):
        convs, alone = rebuilt(conversations)
        in_order = convs.select("conv", "key", "alone").repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
        rows = written(grown(in_order), "forests")
        spine = written(merged(rows.where(F.col("kind") == OPEN)), "spines")
    ids = hashed_ids(rows.where(F.col("kind") == IDS))
    ends = F.coalesce("ids_sha256", "ends_sha256", F.lit(NOTHING))
    spines = spine.join(ids, "path", "left").withColumn("ends_sha256", ends).select(*columns)
    least = spine.select(F.col("path").alias("above"), F.col("conv_id").alias("least"))
    below = rows.where(F.col("kind") == BELOW).join(least, "above").withColumn("parent_conv_id", F.col("least"))
    whole = rows.where(F.col("kind") == WHOLE).select(*columns)
    return whole.unionByName(below.select(*columns)).unionByName(spines).unionByName(tails(alone))
