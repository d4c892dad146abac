"""Toxicity by a lexicon trie, matched with Levenshtein automata, and the context of each match.

The lexicon holds whole words and stems. It is learned from labelled rows: words and word beginnings that many
toxic documents have and hardly any other, beside a short base list. Each distinct token runs through the trie
once, in a process: the automaton's states (token position, errors) step along the trie's letters, so a
misspelled term is found without comparing it with every entry. A token that clean documents use is no
misspelling. In a document every entry counts once, in its gravest context: quoted or reported terms weigh less.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonance.llm.support import judged

#: Terms that are known without labels, and how sure one of them is.
BASE_TERMS = ("idiot", "idiots", "stupid", "moron", "morons", "loser", "losers", "trash", "scum", "clown", "pathetic",
              "worthless", "disgusting", "imbecile", "dumbass", "bastard", "asshole", "bitch", "retard", "scumbag")
BASE_SURENESS = 0.9
#: Labelled rows a model is fitted on, at most (in expectation).
SAMPLE_ROWS = 12_000
#: An entry has at least this many toxic documents, this share of them, and this precision.
LEAST_DOCUMENTS, LEAST_SHARE, LEAST_PRECISION = 4, 0.02, 0.9
#: Lengths of word beginnings, and how many more toxic documents a stem must have than any one of its words.
STEM_LENGTHS, STEM_GAIN = range(3, 9), 1.5
#: Errors allowed by length of an entry, and what a match with errors is worth.
ERRORS = ((5, 1), (9, 2))
WORTH = (1.0, 0.5, 0.35)
#: Context: characters before a term in which a reporting word counts, and what a quoted or reported term is worth.
WINDOW, QUOTED_WORTH = 60, 0.6
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“", "‘": "’"}
#: Quotation marks, and the empty lines between paragraphs.
#: An apostrophe within a word is no mark.
MARKS = re.compile("[" + "".join(sorted({*QUOTES, *QUOTES.values()} - {"’"})) + r"]|(?<!\w)’|’(?!\w)|\n[^\S\n]*\n")
REPORTING = re.compile(r"\b(?:said|says|called|wrote|quoted?|term|word|insult)\b[\s:,]*$")
TOKEN = re.compile(r"[^\W_]+")
REMEMBERED = 400_000


def errors_allowed(length: int) -> int:
    return max([k for least, k in ERRORS if length >= least], default=0)


@dataclass
class Trie:
    """Letters lead to nodes; a node may end a word or a stem."""

    steps: list[dict[str, int]] = field(default_factory=lambda: [{}])
    words: dict[int, str] = field(default_factory=dict)
    stems: dict[int, str] = field(default_factory=dict)

    def add(self, term: str, stem: bool) -> None:
        node = 0
        for c in term:
            if c not in self.steps[node]:
                self.steps[node][c] = len(self.steps)
                self.steps.append({})
            node = self.steps[node][c]
        (self.stems if stem else self.words)[node] = term

    def matches(self, token: str, most: int = 2) -> Iterator[tuple[str, int]]:
        """Entries the token is, or is within the entry's allowed errors of, and the errors.

        Stems match the beginning of a token, without errors. The automaton of ``token`` has a state for each
        (position, errors); it accepts where it can reach the token's end.
        """
        n = len(token)
        todo = [(0, {(i, i) for i in range(min(most, n) + 1)})]
        while todo:
            node, states = todo.pop()
            if node in self.words:
                term = self.words[node]
                spent = min((e + n - i for i, e in states), default=most + 1)
                if spent <= errors_allowed(len(term)):
                    yield term, spent
            for c, child in self.steps[node].items():
                after = set()
                for i, e in states:
                    if i < n and token[i] == c:
                        after.add((i + 1, e))
                    elif e < most:
                        after.add((i, e + 1))  # a letter of the entry is missing in the token
                        if i < n:
                            after.add((i + 1, e + 1))  # another letter instead
                            if i + 1 < n and token[i + 1] == c:
                                after.add((i + 2, e + 1))  # one letter too many
                            if e + 2 <= most and i + 2 < n and token[i + 2] == c:
                                after.add((i + 3, e + 2))  # two letters too many
                if after:
                    todo.append((child, after))
        node = 0
        for c in token:
            node = self.steps[node].get(c, -1)
            if node < 0:
                return
            if node in self.stems:
                yield self.stems[node] + "*", 0


def possible(terms: list[str]) -> re.Pattern:
    """What a token must hold to match any of ``terms``: with ``k`` errors one of ``k + 1`` parts stays whole.

    The first part then stands at the token's beginning and the last at its end.
    """
    first, inner, last = set(), set(), set()
    for term in terms:
        if term.endswith("*"):
            first.add(term[:-1])
            continue
        parts = errors_allowed(len(term)) + 1
        cuts = [len(term) * i // parts for i in range(parts + 1)]
        pieces = [term[a:b] for a, b in zip(cuts, cuts[1:])]
        first.add(pieces[0])
        last.update(pieces[-1:] if parts > 1 else [])
        inner.update(pieces[1:-1])
    either = lambda words: "|".join(map(re.escape, sorted(words)))
    kinds = [(first, "^(?:{})"), (inner, "(?:{})"), (last, "(?:{})$")]
    return re.compile("|".join(form.format(either(words)) for words, form in kinds if words) or r"(?!)")


@dataclass
class Model:
    """``sureness`` of each entry (stems end with ``*``), tokens that clean documents use, and the base rate."""

    sureness: dict[str, float]
    clean: frozenset[str]
    base: float

    def trie(self) -> Trie:
        trie = Trie()
        for term in self.sureness:
            trie.add(term.rstrip("*"), term.endswith("*"))
        return trie


class Scorer:
    """Scores texts, remembering tokens within a process."""

    def __init__(self, model: Model):
        self.model, self.trie = model, model.trie()
        self.possible = possible(list(model.sureness)).search
        self.seen: set[str] = set()
        self.hits: dict[str, dict[str, float]] = {}

    def learn(self, tokens: set[str]) -> None:
        for token in filter(self.possible, tokens):
            found: dict[str, float] = {}
            for term, errors in self.trie.matches(token):
                if errors and (token in self.model.clean or token[0].isdigit()):
                    continue
                found[term] = max(found.get(term, 0.0), self.model.sureness[term] * WORTH[errors])
            if found:
                self.hits[token] = found
        self.seen |= tokens

    def score(self, text: str) -> float:
        lowered = text.lower()
        tokens = set(TOKEN.findall(lowered))
        if len(self.seen) > REMEMBERED:  # before the missing tokens are told: all of this text's are, then
            self.seen.clear()
            self.hits.clear()
        self.learn(tokens - self.seen)
        clear = 1 - self.model.base
        if not self.hits.keys().isdisjoint(tokens):
            best: dict[str, float] = {}
            quoted = quotations(lowered)
            for m in TOKEN.finditer(lowered):
                for term, worth in self.hits.get(m.group(), {}).items():
                    if worth > best.get(term, 0.0):
                        worth *= context_worth(lowered, m.start(), m.end(), quoted)
                        best[term] = max(best.get(term, 0.0), worth)
            for worth in best.values():
                clear *= 1 - worth
        return 1 - clear


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans between paired quotation marks, in order and apart, by one pass over the text.

    A mark that closes an open quotation opens none. A quotation left open ends with its paragraph, unquoted: a
    stray mark turns no later paragraph inside out.
    """
    opened: dict[str, int] = {}
    spans: list[tuple[int, int]] = []
    for m in MARKS.finditer(text):
        mark = m.group()
        if mark.isspace():
            opened.clear()
            continue
        ended = [o for o in opened if QUOTES[o] == mark]
        for opening in ended:
            start = opened.pop(opening)
            while spans and spans[-1][0] >= start:  # quotations inside this one
                spans.pop()
            if not spans or spans[-1][1] <= start:
                spans.append((start, m.end()))
            else:  # marks of two kinds that cross
                spans[-1] = (spans[-1][0], m.end())
        if not ended and mark in QUOTES:
            opened.setdefault(mark, m.start())
    return spans


def context_worth(text: str, start: int, end: int, quoted: list[tuple[int, int]]) -> float:
    """1, or less if the term stands in one of the ``quoted`` spans or after a reporting word."""
    at = bisect_right(quoted, (start, len(text))) - 1
    if at >= 0 and end <= quoted[at][1]:
        return QUOTED_WORTH
    return QUOTED_WORTH if REPORTING.search(text[max(0, start - WINDOW): start]) else 1.0


def term_counts(rows: DataFrame) -> DataFrame:
    """``term, toxic, clean``: documents of each kind with a word or a word beginning (``stem*``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                words = set(TOKEN.findall(text.lower()))
                own = counts[int(toxic)]
                own.update(words)
                own.update({w[:n] + "*" for w in words for n in STEM_LENGTHS if len(w) > n})
            if len(counts[0]) + len(counts[1]) > 1_000_000:
                yield listed(*counts)
                counts = (Counter(), Counter())
        if counts[0] or counts[1]:
            yield listed(*counts)

    def listed(clean: Counter, toxic: Counter) -> pd.DataFrame:
        terms = list(clean.keys() | toxic.keys())
        return pd.DataFrame({"term": terms, "toxic": [toxic[t] for t in terms], "clean": [clean[t] for t in terms]})

    found = rows.mapInPandas(run, "term string, toxic long, clean long")
    return found.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled rows, some ``sample_rows`` of them at most, drawn by a hash of the key.

    Copies of a text count once. Without toxic rows the base list alone remains.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("toxic"))
    total = known.count()
    share = min(1.0, sample_rows / max(total, 1))
    drawn = known.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000))
    # The sample is bounded, so one side of this join is.
    rows = docs.select(key, F.col(text).alias("text")).join(F.broadcast(drawn), key).where("text is not null")
    once = rows.groupBy(F.xxhash64("text").alias("t")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    once, counts = once.drop("t").persist(), None
    try:
        kinds = {int(r["toxic"]): r["count"] for r in once.groupBy("toxic").count().collect()}
        n_toxic, n_clean = kinds.get(1, 0), kinds.get(0, 0)
        least = max(LEAST_DOCUMENTS, LEAST_SHARE * n_toxic)
        counts = term_counts(once).persist()
        frequent = counts.where((F.col("toxic") >= least) & (F.col("toxic") >= LEAST_PRECISION * (F.col("toxic") + F.col("clean"))))
        # At most the sample's toxic documents over ``least``, times the terms of one: a small table.
        found = {r["term"]: (r["toxic"], r["clean"]) for r in frequent.collect()}
        base = {r["term"]: (r["toxic"], r["clean"]) for r in counts.where(F.col("term").isin(*BASE_TERMS)).collect()}
        sureness = {t: sure(*base.get(t, (0, 0)), prior=BASE_SURENESS) for t in BASE_TERMS}
        sureness |= chosen(found)
        sureness = {t: s for t, s in sureness.items() if s >= 0.5}
        model = Model(sureness, frozenset(), 0.0)
        near = near_tokens(counts, model)
        sample = once.select("text", "toxic").mapInPandas(unmatched(Model(sureness, near, 0.0)), "toxic long, n long")
        left = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
        base_rate = (left.get(1, 0) + 0.5) / (left.get(1, 0) + left.get(0, 0) + 10) if n_toxic + n_clean else 0.05
        return Model(sureness, near, min(base_rate, 0.5))
    finally:
        once.unpersist()
        if counts is not None:
            counts.unpersist()


def unmatched(model: Model):
    """Counts, in a task, documents without any match."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            none = np.array([scorer.score(t) == 0 for t in batch["text"]], bool)
            yield pd.DataFrame({"toxic": batch["toxic"], "n": none.astype(np.int64)})

    return run


def near_tokens(counts: DataFrame, model: Model) -> frozenset[str]:
    """Tokens of the sample's clean documents that an automaton would take for misspelled terms."""
    words = counts.where((F.col("clean") > 0) & (F.col("clean") * 4 > F.col("toxic")) & ~F.col("term").endswith("*"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, may = model.trie(), possible(list(model.sureness)).search
        for batch in batches:
            yield pd.DataFrame({"term": [t for t in filter(may, batch["term"]) if any(e for _, e in trie.matches(t))]}, dtype=object)

    return frozenset(r["term"] for r in words.select("term").mapInPandas(run, "term string").collect())  # of a bounded sample


def sure(toxic: int, clean: int, prior: float = 0.5) -> float:
    return (toxic + 2 * prior) / (toxic + clean + 2)


def chosen(found: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Words among ``found``, and stems that stand for more than any one of their words."""
    words = {t: n for t, n in found.items() if not t.endswith("*") and len(t) > 2}
    best_word: dict[str, int] = {}
    for word, (toxic, _) in words.items():
        for n in STEM_LENGTHS:
            best_word[word[:n]] = max(best_word.get(word[:n], 0), toxic)
    stems = {
        t[:-1]: n for t, n in found.items() if t.endswith("*") and n[0] >= STEM_GAIN * best_word.get(t[:-1], 0)
    }
    kept: dict[str, tuple[int, int]] = {}
    # The most telling first, the longer of equals; a beginning or continuation of a kept stem adds nothing.
    for stem in sorted(stems, key=lambda s: (5 * stems[s][1] - stems[s][0], -len(s), s)):
        if not any(stem.startswith(k) or k.startswith(stem) for k in kept):
            kept[stem] = stems[stem]
    out = {w: sure(*n) for w, n in words.items()}
    return out | {s + "*": sure(*n) for s, n in kept.items()}


_scorers: dict[str, Scorer] = {}


def score_texts(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """All columns of ``docs`` in ``row``, ``score`` and ``predicted`` of every row.

    Null and empty texts get the rate of texts without matches. Repeated rows are kept; an empty table gives an
    empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    name = uuid.uuid4().hex  # a process keeps the scorer of one model

    def judge(texts: list[str]) -> dict:
        if name not in _scorers:
            _scorers.clear()
            _scorers[name] = Scorer(shared.value)
        scores = np.array([_scorers[name].score(t) for t in texts], float)
        return {"score": scores, "predicted": (scores >= threshold).astype(np.int32)}

    return judged(docs, F.col(text), judge, "score double, predicted int").select("row", "out.*")
