"""Word-shingle sets of texts as sorted 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np

from resonance.llm.support import mixed, range_hashes

#: What separates words, and what lower-casing touches, is ASCII only.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def word_hashes(data: bytes) -> np.ndarray:
    """Hash of every word of UTF-8 ``data``, A-Z lower-cased."""
    b = LOWER[np.frombuffer(data, np.uint8)]
    inside = np.concatenate([[False], ~WHITE[b], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return range_hashes(b, edge[0::2], edge[1::2])


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Distinct shingles of ``width`` words of each text, ascending.

    A text of fewer words is one shingle; one without words, or null, has none.
    """
    data = [(t or "").encode() for t in texts]
    words = word_hashes(b"\n".join(data) + b"\n")
    inside = np.concatenate([[False], ~WHITE[np.frombuffer(b"\n".join(data) + b"\n", np.uint8)]])
    begins = np.flatnonzero(inside[1:] & ~inside[:-1])
    edges = np.append(0, np.cumsum([len(d) + 1 for d in data]))
    at = np.searchsorted(begins, edges)
    out = []
    with np.errstate(over="ignore"):
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            n = b - a
            if n == 0:
                out.append(np.zeros(0, np.uint64))
                continue
            size = min(n, width)
            h = words[a: b - size + 1].copy()
            for k in range(1, size):
                h = mixed(h, k) + words[a + k: b - size + 1 + k]
            out.append(np.unique(mixed(h, size)))
    return out
