"""Personal data by patterns and a skip-chain conditional random field.

Patterns find whole emails, addresses, cards and phone numbers. What they drop (a card that touches another
number, a phone number followed by an address) is left to the field: tokens with a digit or an ``@`` are its
nodes; neighbours share a chain potential, repeated tokens (equal but for punctuation) a skip potential, and loopy
message passing settles the labels of a document together. Its potentials are smoothed log ratios of counts over all documents,
labelled by the patterns. A span it adds must still look like its kind.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonance.llm.support import judged

KINDS = ("email", "ip", "card", "phone")
#: Labels of tokens: the kinds, and none.
LABELS = (*KINDS, "none")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A run of digits is tried from its start only: from inside it the same would follow.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
MARKS = ".,;:!?\"'`*#$%&|<>[]{}=~^_/\\"
WORN_PHONE = re.compile(r"[+(]?[0-9][\x20().0-9-]*[0-9]")
#: Weight of shape priors, smoothing, bound of a log potential, weights of chain and skip, rounds of messages.
PRIOR, SMOOTHING, BOUND, CHAIN, SKIP, ROUNDS = 5.0, 0.5, 4.0, 0.5, 1.0, 8
#: Least probability of an added label.
SURE = 0.8


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def is_card(text: str) -> bool:
    number = digits(text)
    return 13 <= len(number) <= 19 and luhn(number)


def is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern, found from each ``@``."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at + 1)
        start = at
        while m and start > free and text[start - 1] in LOCAL:
            start -= 1
        if m and start < at:
            found.append((start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", free)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the patterns, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if is_ip(m.group())]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if is_card(m.group())]
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return out


def shape(token: str) -> str:
    """What a token looks like; the only feature of a node."""
    n = len(digits(token))
    if "@" in token:
        return "email" if emails(token) == [(0, len(token))] else "at"
    if IP.fullmatch(token):
        return "ip" if is_ip(token) else "dots"
    if CARD.fullmatch(token) and 13 <= n <= 19:
        return "card" if luhn(digits(token)) else "long"
    if re.fullmatch(r"\+[0-9]{1,3}", token):
        return "plus"
    if token.startswith("+") and WORN_PHONE.fullmatch(token):
        return "plus long" if n >= 9 else "plus"
    if re.fullmatch(r"\([0-9]{2,4}\)", token):
        return "area"
    if re.fullmatch(r"(\([0-9]{2,4}\)|[0-9]{2,4}-)?[0-9]{3}-[0-9]{4}", token):
        return "local"
    if re.fullmatch(r"[0-9]+", token):
        return f"number {min(n, 5)}"
    return "other"


#: What shapes say before any count.
SHAPE_PRIOR = {"email": "email", "ip": "ip", "card": "card", "plus long": "phone", "plus": "phone", "area": "phone", "local": "phone"}


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans of tokens with a digit or an ``@``, without marks around them."""
    out = []
    for m in TOKEN.finditer(text):
        word = m.group()
        body = word.strip(MARKS)
        if body.endswith(")") and "(" not in body:
            body = body.rstrip(")").rstrip(MARKS)
        if body.startswith("(") and ")" not in body:
            body = body.lstrip("(")
        if body:
            a = m.start() + word.index(body)
            out.append((a, a + len(body)))
    return out


def label_of(span: tuple[int, int], base: list[tuple[int, int, int]]) -> int:
    return next((k for k, a, b in base if a <= span[0] and span[1] <= b), len(KINDS))


@dataclass
class Graph:
    """Nodes and edges of many texts."""

    owner: list[int]
    spans: list[tuple[int, int]]
    shapes: list[str]
    labels: list[int]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def graph(texts: list[str], bases: list[list[tuple[int, int, int]]]) -> Graph:
    """Chain edges join tokens with blanks between them; skip edges each token to the next like it in its text."""
    g = Graph([], [], [], [], [], [])
    for i, (text, base) in enumerate(zip(texts, bases)):
        last: dict[str, int] = {}
        base = sorted(base, key=lambda s: s[1])
        at = 0
        for a, b in tokens(text):
            node = len(g.spans)
            while at < len(base) and base[at][2] <= a:
                at += 1
            word = text[a:b]
            if g.owner and g.owner[-1] == i and not text[g.spans[-1][1]: a].strip(" -"):
                g.chain.append((node - 1, node))
            like = "".join(c for c in word.lower() if c.isalnum() or c in "@.")
            if len(like) > 4:
                if like in last:
                    g.skip.append((last[like], node))
                last[like] = node
            g.owner.append(i)
            g.spans.append((a, b))
            g.shapes.append(shape(word))
            g.labels.append(label_of((a, b), base[at: at + 4]))
    return g


@dataclass
class Field:
    """Log potentials: of each shape, and of pairs of labels along the chain and between repeated tokens."""

    node: dict[str, np.ndarray]
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, g: Graph) -> np.ndarray:
        """Label probabilities of each node, after ROUNDS rounds of messages along all edges."""
        n, m = len(g.spans), len(LABELS)
        unknown = self.node["other"]
        own = np.stack([self.node.get(s, unknown) for s in g.shapes])
        edges = np.array(g.chain + g.skip, int).reshape(-1, 2)
        pair = np.concatenate([np.tile(CHAIN * self.chain, (len(g.chain), 1, 1)), np.tile(SKIP * self.skip, (len(g.skip), 1, 1))])
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
        half = len(edges)
        back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        message = np.zeros((2 * half, m))
        for _ in range(ROUNDS if half else 0):
            belief = own.copy()
            np.add.at(belief, target, message)
            out = (belief[source] - message[back])[:, :, None] + pair
            top = out.max(axis=1, keepdims=True)
            new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
            message = 0.5 * message + 0.5 * (new - new.max(axis=1, keepdims=True))
        belief = own.copy()
        np.add.at(belief, target, message)
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True) if n else np.zeros((0, m))


def field_from(counts: dict[tuple[str, str, int], int]) -> Field:
    """Potentials from counts of (kind of factor, feature, label)."""
    m = len(LABELS)
    node: dict[str, np.ndarray] = {}
    for feature in {f for kind, f, _ in counts if kind == "node"} | set(SHAPE_PRIOR) | {"other"}:
        n = np.full(m, SMOOTHING)
        n[LABELS.index(SHAPE_PRIOR.get(feature, "none"))] += PRIOR
        for label in range(m):
            n[label] += counts.get(("node", feature, label), 0)
        node[feature] = np.clip(np.log(n / n.sum()), -2 * BOUND, 0)

    def pairs(kind: str) -> np.ndarray:
        n = np.full((m, m), SMOOTHING) + np.eye(m) * PRIOR
        for label in range(m):
            for other in range(m):
                n[label, other] += counts.get((kind, str(label), other), 0)
        n = n + n.T if kind == "skip" else n
        p = n / n.sum()
        return np.clip(np.log(p / np.outer(p.sum(axis=1), p.sum(axis=0))), -BOUND, BOUND)

    return Field(node, pairs("chain"), pairs("skip"))


def train(docs: DataFrame, text: str = "text") -> Field:
    """Count node and edge labels, as the patterns give them, over all texts; a small table comes back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            texts = batch["t"].tolist()
            g = graph(texts, [base_spans(t) for t in texts])
            counts.update(("node", s, k) for s, k in zip(g.shapes, g.labels))
            counts.update(("chain", str(g.labels[a]), g.labels[b]) for a, b in g.chain)
            counts.update(("skip", str(g.labels[a]), g.labels[b]) for a, b in g.skip)
        rows = [(*key, n) for key, n in counts.items()]
        yield pd.DataFrame(rows, columns=["kind", "feature", "label", "n"])

    rows = docs.where(F.col(text).rlike("[0-9@]")).select(F.col(text).alias("t"))
    found = rows.mapInPandas(run, "kind string, feature string, label int, n long")
    total = found.groupBy("kind", "feature", "label").agg(F.sum("n").alias("n"))
    return field_from({(r["kind"], r["feature"], r["label"]): r["n"] for r in total.collect()})


def looks_like(kind: int, text: str) -> bool:
    if kind == 0:
        return emails(text) == [(0, len(text))]
    if kind == 1:
        return bool(IP.fullmatch(text)) and is_ip(text)
    if kind == 2:
        return bool(CARD.fullmatch(text)) and is_card(text)
    return bool(WORN_PHONE.fullmatch(text)) and 7 <= len(digits(text)) <= 15


def added_spans(texts: list[str], bases: list[list[tuple[int, int, int]]], field: Field) -> list[list[tuple[int, int, int]]]:
    """Spans of the field that meet no span of the patterns; neighbours of one label make one span."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    g = graph(texts, bases)
    if not g.spans:
        return out
    p = field.marginals(g)
    label = np.where(p.max(axis=1) >= SURE, p.argmax(axis=1), len(KINDS)).tolist()
    joined = {b for a, b in g.chain if label[a] == label[b] == 3}  # a phone number may be several tokens
    taken = [sorted((a, b) for _, a, b in base) for base in bases]
    runs: list[list[int]] = []
    for i, k in enumerate(label):
        a, b = g.spans[i]
        if k == len(KINDS) or any(x < b and a < y for x, y in taken[g.owner[i]]):
            continue
        if runs and i in joined and runs[-1][3] == i - 1:
            runs[-1][2:] = [b, i]
        else:
            runs.append([k, a, b, i])
    for k, a, b, i in runs:
        if looks_like(k, texts[g.owner[i]][a:b]):
            out[g.owner[i]].append((k, a, b))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first replaces both."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """All columns of ``docs`` in ``row``, a count of pattern spans for each kind, ``base_sha256``, ``spans`` and ``masked``.

    Positions are code points, ends exclusive. Null texts count as empty; ``masked`` is the text with its spans
    replaced by their kinds, null where there is none. Repeated rows are kept; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)  # labels x shapes
    nothing = hashlib.sha256(b"").hexdigest()

    def judge(texts: list[str]) -> dict:
        at = [i for i, t in enumerate(texts) if t]
        some = [texts[i] for i in at]
        bases = [base_spans(t) for t in some]
        every = [b + a for b, a in zip(bases, added_spans(some, bases, shared.value))]
        counts = np.zeros((len(texts), len(KINDS)), np.int64)
        digest, spans, plain = [nothing] * len(texts), [""] * len(texts), [None] * len(texts)
        for i, t, base, full in zip(at, some, bases, every):
            counts[i] = np.bincount([k for k, _, _ in base], minlength=len(KINDS))
            digest[i] = hashlib.sha256(listed(base).encode()).hexdigest()
            spans[i] = listed(full)
            plain[i] = masked(t, full) if full else None
        columns = {f"n_{k}": counts[:, i] for i, k in enumerate(KINDS)}
        return columns | {"base_sha256": digest, "spans": spans, "masked": pd.Series(plain, dtype=object)}

    useful = F.when(F.col(text).rlike("[0-9@]"), F.col(text))  # other texts have no span
    schema = ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, masked string"
    return judged(docs, useful, judge, schema).select("row", "out.*")
