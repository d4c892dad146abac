"""Splitting of texts into the words a tokenizer merges, as flat numpy arrays.

Characters fall into letters, numbers, white space and the rest; the rules of the two public
vocabularies are then a few comparisons of neighbouring classes.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: The white space of the tokenizers' patterns.
WHITE = (9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@cache
def class_table() -> np.ndarray:
    """Class of every code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            kinds[c] = LETTER
        elif kind == "N":
            kinds[c] = NUMBER
    kinds[list(WHITE)] = SPACE
    return kinds


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def contractions(cp: np.ndarray, kinds: np.ndarray, first: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of 's 't 're 've 'm 'll 'd that begin a word.

    ``first`` marks the first character of each text. With ``spaced``, a space before the
    apostrophe belongs to the word of the apostrophe, so no contraction begins there.
    """
    n = len(cp)
    at = np.flatnonzero(cp == 39)
    at = at[at + 1 < n]
    if not len(at):
        return at, at
    before = np.maximum(at - 1, 0)
    begins = first[at] | ((kinds[before] != OTHER) & ~((cp[before] == 32) & spaced))
    at = at[begins & ~first[at + 1]]
    one = cp[at + 1]
    third = np.minimum(at + 2, n - 1)
    two = np.where((at + 2 < n) & ~first[third], cp[third], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e")))
    long |= (one == ord("l")) & (two == ord("l"))
    keep = short | long
    at, size = at[keep], np.where(short, 2, 3)[keep]
    return at, at + size


def spaced_words(cp: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte-level words: a run of one class with one space before it; the other white space by itself.

    Of white space before a word, the last character stands alone unless it is a plain space,
    which joins the word. Every character lies in exactly one word.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = class_table()[cp]
    change = np.ones(n, bool)
    change[1:] = (kinds[1:] != kinds[:-1]) | first[1:]
    white = kinds == SPACE
    plain = cp == 32
    # The last character of a run of white space that is followed by a word of the same text.
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~first[1:]
    start = change | last
    joined = np.zeros(n, bool)
    joined[1:] = last[:-1] & plain[:-1]
    start &= ~joined
    begin, end = contractions(cp, kinds, first, spaced=True)
    if len(begin):
        start[begin] = True
        inside = np.concatenate([begin + 1, begin[end - begin == 3] + 2])
        start[inside] = False
        start[end[end < n]] = True
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n)


def bare_words(cp: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without white space: runs of letters, single numbers, runs of the rest."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = class_table()[cp]
    start = np.ones(n, bool)
    start[1:] = (kinds[1:] != kinds[:-1]) | first[1:] | (kinds[1:] == NUMBER)
    begin, end = contractions(cp, kinds, first, spaced=False)
    if len(begin):
        start[begin] = True
        start[np.concatenate([begin + 1, begin[end - begin == 3] + 2])] = False
        start[end[end < n]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    keep = kinds[starts] != SPACE
    return starts[keep], ends[keep]
