"""Quality rules from the repetition that a suffix array shows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm.common import documents

#: Repeated substrings of at least so many words count as covered.
MIN_REPEAT = 5
#: The share of words that repeats may cover, and the longest repeat as a share of the words and in words.
MAX_COVERED, MAX_LONGEST, LONG_REPEAT = 0.5, 0.4, 20
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
WORDS_FROM = 3
SYMBOLS = "#*$%&|<>"


def longest_matches(ids: np.ndarray) -> np.ndarray:
    """For every position the length of the longest substring that starts there and also elsewhere.

    Ranks of substrings of 1, 2, 4, ... words are refined until all suffixes differ, which sorts the
    suffixes.  The common prefix of neighbours in that order is read off the ranks from the
    longest power down.  A suffix shares its longest match with one of its two neighbours.
    """
    n = len(ids)
    if n < 2:
        return np.zeros(n, np.int64)
    levels = []
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        levels.append(np.append(rank, -1))
        if rank.max() == n - 1:
            break
        after = np.zeros(n, np.int64)
        after[: max(n - width, 0)] = rank[width:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
        width *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(a + common, n)] == levels[k][np.minimum(b + common, n)]
        common += np.where(same, 1 << k, 0)
    match = np.zeros(n, np.int64)
    match[a] = common
    match[b] = np.maximum(match[b], common)
    return match


def covered(match: np.ndarray, least: int) -> int:
    """Words in the union of the repeated substrings of ``least`` words or more."""
    n = len(match)
    starts = np.flatnonzero(match >= least)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + match[starts], -1)
    return int((np.cumsum(edges[:n]) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int, int]:
    """Words, their characters, symbols, repeated lines, words in repeated 3-word windows, covered words, longest repeat."""
    if not text:
        return (0,) * 7
    raw = text.encode()
    words = raw.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # White space is ASCII, so what the words lack of the bytes is a count of characters.
    chars = len(text) - (len(raw) - sum(map(len, words)))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.split()]
    match = longest_matches(ids)
    longest = int(match.max()) if len(match) else 0
    return (
        len(words), chars, symbols, len(lines) - len(set(lines)),
        covered(match, WORDS_FROM), covered(match, MIN_REPEAT), longest,
    )


_FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")


def quality_rules(docs: DataFrame, text: str = "text", key: str = "doc_id", max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST, carry: tuple[str, ...] = ()) -> DataFrame:
    """Figures of every row, ``base_failed`` and ``kept``; ``carry`` names columns to pass through.

    A suffix array over the words gives all maximal repeated substrings.  A text fails if those of
    ``MIN_REPEAT`` words or more cover over ``max_covered`` of its words, or if the longest
    has ``LONG_REPEAT`` words or more and over ``max_longest`` of them.  It also fails
    (``base_failed``) with fewer than 50 words or if over half of its words stand in
    3-word windows that occur again.  A null or empty text has no words and fails.
    Rows keep their repeats; each text is looked at by itself, in one narrow pass.
    """

    @F.pandas_udf(", ".join(f"{n} long" for n in _FIGURES))
    def figures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([measure(t) for t in texts], columns=list(_FIGURES), dtype="int64")

    rows = docs.select(F.col(key), *[c for c in carry if c != key], figures(F.col(text)).alias("_figures"))
    rows = rows.select(*[c for c in rows.columns if c != "_figures"], *[F.col("_figures")[n].alias(n) for n in _FIGURES])
    n = F.col("n_words")
    base = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    repeats = (F.col("n_covered") > max_covered * n) | (
        (F.col("longest_repeat") >= LONG_REPEAT) & (F.col("longest_repeat") > max_longest * n)
    )
    return rows.withColumns({"base_failed": base, "kept": ~base & ~repeats})


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat",
        "base_failed", "kept",
    )
