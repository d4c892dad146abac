"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round every word finds its pair of lowest
rank, by binary search over the sorted pair keys, and merges all its occurrences from left to right;
words without a known pair leave the array. Merged symbols always come later in the merge list than
their parts, so a round does what merging one pair at a time would do.

A batch encodes each distinct word once, and each worker process keeps a bounded table of words it has
encoded. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonance.llm import pretokens
from resonance.llm.support import judged, range_hashes, ragged, slices

#: Words of more bytes are merged one pair at a time from a heap: rounds would be quadratic in their length.
LONG_WORD = 512
#: Words a process remembers before it starts anew.
REMEMBERED = 400_000
#: The bytes that stand for themselves in byte-level vocabularies (fixed values); others follow from U+0100 on.
PRINTABLE = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary file."""
    shown = {b: chr(b) for b in PRINTABLE}
    hidden = [b for b in range(256) if b not in shown]
    return shown | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


@dataclass
class Vocabulary:
    """Tables of one byte-level BPE vocabulary; a few MB, whatever the corpus."""

    name: str
    single: np.ndarray  # id of each byte
    final: np.ndarray  # id of each byte as the last of a word
    pair_keys: np.ndarray  # sorted left * size + right
    pair_ranks: np.ndarray
    merged: np.ndarray  # id by rank
    size: int
    token_bytes: np.ndarray  # all tokens' bytes, one after another
    token_starts: np.ndarray
    token_lengths: np.ndarray
    specials: dict[str, int] = field(default_factory=dict)
    lower: bool = False  # NFC and lower case, white space dropped

    @staticmethod
    def read(path: str) -> Vocabulary:
        """From the JSON file of the tokenizers library at ``path`` (on the driver)."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        ids: dict[str, int] = dict(model["vocab"])
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        suffix = model.get("end_of_word_suffix") or ""
        shown = byte_characters()
        back = {c: b for b, c in shown.items()}
        size = max([*ids.values(), *specials.values()]) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] * size + ids[b] for a, b in merges], np.int64)
        merged = np.array([ids[a + b] for a, b in merges], np.int32)
        order = np.argsort(keys, kind="stable")
        pieces = [b""] * size
        for word, i in ids.items():
            if word not in specials:
                body = word[: -len(suffix)] if suffix and word.endswith(suffix) else word
                pieces[i] = bytes(back[c] for c in body)
        for word, i in specials.items():
            pieces[i] = word.encode()
        lengths = np.array([len(p) for p in pieces], np.int64)
        return Vocabulary(
            name=path,
            single=np.array([ids[shown[b]] for b in range(256)], np.int32),
            final=np.array([ids[shown[b] + suffix] for b in range(256)], np.int32),
            pair_keys=keys[order],
            pair_ranks=order.astype(np.int32),
            merged=merged,
            size=size,
            token_bytes=np.frombuffer(b"".join(pieces), np.uint8),
            token_starts=np.cumsum(lengths) - lengths,
            token_lengths=lengths,
            specials=specials,
            lower=spec.get("normalizer") is not None,
        )

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; the number of merges where there is none."""
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], len(self.merged)).astype(np.int32)

    def merge_rounds(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words: flat symbols and symbols per word, both before and after."""
        none = len(self.merged)
        n_words = len(lengths)
        word = np.repeat(np.arange(n_words), lengths)
        done_symbols, done_words = [], []
        follows = np.append(word[1:] == word[:-1], False)  # a pair begins here
        rank = np.full(len(symbols), none, np.int32)
        i = np.flatnonzero(follows)
        rank[i] = self.ranks(symbols[i], symbols[i + 1])
        while len(symbols):
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, begins)
            sizes = np.diff(np.append(begins, len(word)))
            ended = least == none
            if ended.any():
                out = np.repeat(ended, sizes)
                done_symbols.append(symbols[out])
                done_words.append(word[out])
                symbols, word, rank, follows = (x[~out] for x in (symbols, word, rank, follows))
                least, sizes = least[~ended], sizes[~ended]
                if not len(symbols):
                    break
            hit = rank == np.repeat(least, sizes)
            # Of overlapping occurrences (runs of hits) every second one merges, from the left.
            at = np.flatnonzero(hit)
            run = np.append(True, np.diff(at) > 1)
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            gone = at + 1
            follows[at] = follows[gone]
            keep = np.ones(len(symbols), bool)
            keep[gone] = False
            stale = np.zeros(len(symbols), bool)
            stale[at] = True
            before = at[at > 0] - 1
            # The pair before a merged symbol: its left part may be a symbol that has just gone.
            before = np.where(keep[before], before, before - 1)
            stale[before] = True
            symbols, word, rank, follows, stale = (x[keep] for x in (symbols, word, rank, follows, stale))
            rank[stale] = none
            i = np.flatnonzero(stale & follows)
            rank[i] = self.ranks(symbols[i], symbols[i + 1])
        symbols = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int32)
        word = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=n_words)

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of one long word: lowest rank first, then leftmost, from a heap."""
        n, none = len(symbols), len(self.merged)
        syms = symbols.tolist()
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        first = self.ranks(symbols[:-1], symbols[1:])
        heap = [(int(r), i, syms[i], syms[i + 1]) for i, r in enumerate(first) if r != none]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if syms[i] is not None else n
            if j >= n or syms[i] != a or syms[j] != b:
                continue
            syms[i], syms[j] = int(self.merged[rank]), None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            around = [(x, y) for x, y in ((before[i], i), (i, after[i])) if x >= 0 and y < n]
            if around:
                new = self.ranks(np.array([syms[x] for x, _ in around]), np.array([syms[y] for _, y in around]))
                for (x, y), r in zip(around, new):
                    if r != none:
                        heapq.heappush(heap, (int(r), x, syms[x], syms[y]))
        return np.array([s for s in syms if s is not None], np.int32)

    def encode_words(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as flat bytes and bytes per word."""
        ends = np.cumsum(lengths)
        symbols = self.single[flat]
        symbols[ends - 1] = self.final[flat[ends - 1]]
        long = lengths > LONG_WORD
        if not long.any():
            return self.merge_rounds(symbols, lengths)
        out = np.repeat(long, lengths)
        ids, counts = self.merge_rounds(symbols[~out], lengths[~long])
        starts = (np.cumsum(counts) - counts).tolist()
        parts, sizes, k = [], np.zeros(len(lengths), np.int64), 0
        for i in range(len(lengths)):
            if long[i]:
                part = self.merge_long(symbols[ends[i] - lengths[i]: ends[i]])
            else:
                part = ids[starts[k]: starts[k] + counts[k]]
                k += 1
            parts.append(part)
            sizes[i] = len(part)
        return np.concatenate(parts), sizes


class Encoder:
    """Encodes batches of texts with one vocabulary, remembering words within a process."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def word_ids(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: where its ids begin in ``self.ids``, and how many there are."""
        h, one, back = np.unique(range_hashes(cp, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, h)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == h[known]
        if not known.all():
            if len(self.hashes) + len(h) > REMEMBERED:
                self.forget()
                known[:] = False
            one, new = one[~known], h[~known]
            chars = cp[ragged(starts[one], ends[one] - starts[one])]
            size = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
            total = np.append(0, np.cumsum(size))
            edges = np.append(0, np.cumsum(ends[one] - starts[one]))
            flat = np.frombuffer(chars.tobytes().decode("utf-32-le").encode(), np.uint8)
            ids, counts = self.vocabulary.encode_words(flat, np.diff(total[edges]))
            place = np.searchsorted(self.hashes, new)
            self.at = np.insert(self.at, place, len(self.ids) + np.cumsum(counts) - counts)
            self.counts = np.insert(self.counts, place, counts)
            self.hashes = np.insert(self.hashes, place, new)
            self.ids = np.concatenate([self.ids, ids])
            at = np.searchsorted(self.hashes, h)
        return self.at[at][back], self.counts[at][back]

    def encode(self, texts: list[str], spans: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Ids of all texts in one array, ids per text, and with ``spans`` the characters per id.

        Spans are not for vocabularies that lower their text.
        A special token's string in a text becomes its id. A character that is cut over several ids
        counts for the id that holds its first byte.
        """
        v = self.vocabulary
        if not v.lower:
            specials = [s for s in v.specials if any(s in t for t in texts)]
            if specials:
                return self.encode_with_specials(texts, specials, spans)
        elif any(s in t for t in texts for s in v.specials):
            return self.encode_with_specials(texts, list(v.specials), spans)
        if v.lower:
            texts = [lowered(t) for t in texts]
        cp = pretokens.code_points("".join(texts))
        sizes = np.array([len(t) for t in texts], np.int64)
        edges = np.append(0, np.cumsum(sizes))
        first = np.zeros(len(cp) + 1, bool)
        first[edges] = True
        starts, ends = (pretokens.bare_words if v.lower else pretokens.spaced_words)(cp, first[:-1])
        at, counts = self.word_ids(cp, starts, ends) if len(starts) else (starts, starts)
        ids = self.ids[ragged(at, counts)] if len(starts) else np.zeros(0, np.int32)
        words = np.searchsorted(starts, edges)
        total = np.append(0, np.cumsum(counts))
        per_text = np.diff(total[words])
        if not spans:
            return ids, per_text, None
        size = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        byte_at = np.append(0, np.cumsum(size))
        token_ends = np.cumsum(v.token_lengths[ids])
        # Characters whose first byte lies before the end of each token.
        chars = np.searchsorted(byte_at[:-1], token_ends, side="left")
        return ids, per_text, np.diff(np.append(0, chars))

    def encode_with_specials(self, texts: list[str], specials: list[str], spans: bool):
        """As :meth:`encode`, for texts that hold special tokens: each is cut at them."""
        cut = re.compile("|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)))
        plain, owner, put = [], [], []
        for i, t in enumerate(texts):
            at = 0
            for m in cut.finditer(t):
                plain.append(t[at: m.start()])
                owner.append(i)
                put.append(self.vocabulary.specials[m.group()])
                at = m.end()
            plain.append(t[at:])
            owner.append(i)
            put.append(-1)
        kept = self.vocabulary.specials
        self.vocabulary.specials = {}
        try:
            ids, counts, chars = self.encode(plain, spans)
        finally:
            self.vocabulary.specials = kept
        put_at = np.array(put)
        has = put_at >= 0
        where = np.cumsum(counts)[has]
        names = {i: s for s, i in kept.items()}
        ids = np.insert(ids, where, put_at[has]).astype(np.int32)
        if chars is not None:
            chars = np.insert(chars, where, [len(names[i]) for i in put_at[has]])
        return ids, np.bincount(owner, counts + has, len(texts)).astype(np.int64), chars


def lowered(text: str) -> str:
    """NFC and lower case, one character at a time as the tokenizer does."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


def joined_numbers(v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decimal strings of all ids, each with a comma after it: bytes, starts, lengths."""
    parts = [b"%d," % i for i in range(v.size)]
    lengths = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """The process's encoder for this vocabulary."""
    if vocabulary.name not in _encoders:
        _encoders[vocabulary.name] = Encoder(vocabulary)
    return _encoders[vocabulary.name]


def encode_decode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", with_ids: bool = False) -> DataFrame:
    """All columns of ``docs`` in ``row``, token count, digests of ids and of the decoded text; ids too if asked for.

    A null text is taken as empty: no ids, digests of the empty string. Repeated rows are kept; an empty table
    gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # fixed size: the vocabulary file

    def judge(texts: list[str]) -> dict:
        v = shared.value
        enc, (numbers, number_at, number_len) = encoder(v), joined_numbers(v)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        if with_ids:
            out["ids"] = []
        for a, b in slices(texts):
            ids, counts, _ = enc.encode(texts[a:b])
            edges = np.append(0, np.cumsum(counts))
            size, length = number_len[ids], v.token_lengths[ids]
            listed = numbers[ragged(number_at[ids], size)].tobytes()
            spelled = v.token_bytes[ragged(v.token_starts[ids], length)].tobytes()
            cut = np.append(0, np.cumsum(size))[edges].tolist()
            end = np.append(0, np.cumsum(length))[edges].tolist()
            out["n_tokens"] += counts.tolist()
            out["ids_sha256"] += [hashlib.sha256(listed[x: max(x, y - 1)]).hexdigest() for x, y in zip(cut, cut[1:])]
            decoded = [spelled[x:y].decode("utf-8", "replace") for x, y in zip(end, end[1:])]
            out["decoded_sha256"] += [hashlib.sha256(t.encode()).hexdigest() for t in decoded]
            if with_ids:
                out["ids"] += [ids[x:y] for x, y in zip(edges[:-1], edges[1:])]
        return out

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return judged(docs, F.col(text), judge, schema).select("row", "out.*")
