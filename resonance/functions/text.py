"""Text terms as one SQL expression, shared by DataFrames and saved ML stages."""

from __future__ import annotations

from collections.abc import Iterable

# Spark's English stop words, without those that hold an apostrophe
# (a term never holds one, so they could never match).
ENGLISH_STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him
    his himself she her hers herself it its itself they them their theirs themselves
    what which who whom this that these those am is are was were be been being have
    has had having do does did doing a an the and but if or because as until while
    of at by for with about against between into through during before after above
    below to from up down in out on off over under again further then once here
    there when where why how all any both each few more most other some such no nor
    not only own same so than too very s t can will just don should now cannot could
    ought would
    """.split()
)

# A term is a run of two or more letters, digits or underscores of any script.
TERM_PATTERN = r"(?U)\b\w\w+\b"


def tokens_sql(text: str, stop_words: Iterable[str] = ENGLISH_STOP_WORDS) -> str:
    """SQL of the lower-case tokens of column ``text`` without stop words."""
    found = f"regexp_extract_all(lower({text}), r'{TERM_PATTERN}', 0)"
    stops = ", ".join("'" + w.replace("'", "") + "'" for w in stop_words)
    return f"filter({found}, w -> w NOT IN ({stops}))" if stops else found


def bigrams_sql(tokens: str) -> str:
    """SQL of the pairs of neighbouring entries of array column ``tokens``."""
    n = f"greatest(size({tokens}) - 1, 0)"
    return (
        f"zip_with(slice({tokens}, 1, {n}), slice({tokens}, 2, {n}), "
        "(a, b) -> concat(a, ' ', b))"
    )


def terms_sql(tokens: str, ngrams: int = 2) -> str:
    """SQL of the term list of ``tokens``: words, then word pairs if wanted."""
    if ngrams not in (1, 2):
        raise ValueError("ngrams is 1 or 2")
    return tokens if ngrams == 1 else f"concat({tokens}, {bigrams_sql(tokens)})"
