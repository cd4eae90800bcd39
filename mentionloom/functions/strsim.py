"""String similarities.

Edit similarity, Dice and abbreviation similarity are native expressions.  Those
that Spark lacks are Arrow-batched pandas UDFs; each distinct pair of a batch is
computed once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import extract_abbreviation, sort_characters


def edit_similarity(a: Column, b: Column) -> Column:
    """1 minus Levenshtein distance over the longer length; if either is empty, the other's length."""
    n, m = F.length(a), F.length(b)
    return F.when(n == 0, m.cast("double")).when(m == 0, n.cast("double")).otherwise(1 - F.levenshtein(a, b) / F.greatest(n, m))


def abbreviation_similarity(a: Column, b: Column) -> Column:
    """How well an abbreviation fits a name: sorted letters against its capitals, the better of two ways."""

    def one(use_first: bool) -> Column:
        short, letters = sort_characters(F.lower(a)), sort_characters(F.lower(extract_abbreviation(b, use_first)))
        n, m = F.length(short), F.length(letters)
        return edit_similarity(short, letters) * F.greatest(n, m) / (n + F.abs(n - m))

    return F.greatest(one(False), one(True))


def grams(text: Column, n: int = 2) -> Column:
    """Character n-grams in order; none for shorter texts."""
    last = F.length(text) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def dice_bigrams(a: Column, b: Column) -> Column:
    """Twice the shared distinct 2-grams over the distinct 2-grams of both; 0 if there are none."""
    x, y = F.array_distinct(grams(a)), F.array_distinct(grams(b))
    total = F.size(x) + F.size(y)
    return F.when(total > 0, 2.0 * F.size(F.array_intersect(x, y)) / total).otherwise(0.0)


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    matched, places = [], []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                matched.append(c)
                places.append(j)
                break
    if not matched:
        return 0.0
    swapped = sum(c != b[j] for c, j in zip(matched, sorted(places), strict=True)) // 2
    m = len(matched)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler_score(a: str, b: str) -> float:
    """Jaro similarity, raised if above 0.7 for up to four common first characters, a tenth of the rest each."""
    jaro, common = _jaro(a, b), 0
    if jaro <= 0.7:
        return jaro
    while common < min(4, len(a), len(b)) and a[common] == b[common]:
        common += 1
    return jaro + common * 0.1 * (1 - jaro)


def ngram_score(a: str, b: str, n: int = 2) -> float:
    """Kondrak's n-gram similarity: edits over n-grams with padded beginning and partial matches."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    x, y = "\0" * (n - 1) + a, "\0" * (n - 1) + b
    row = [float(j) for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        new = [float(i)]
        for j in range(1, len(b) + 1):
            apart = weight = 0
            for k in range(n):
                p, q = x[i - 1 + k], y[j - 1 + k]
                # Padding that meets padding tells nothing.
                if p == q == "\0":
                    continue
                weight += 1
                apart += p != q
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + apart / weight))
        row = new
    return 1 - row[-1] / max(len(a), len(b))


def common_substring_length(a: str, b: str) -> int:
    best, row = 0, [0] * (len(b) + 1)
    for c in a:
        row = [0, *(row[j] + 1 if c == d else 0 for j, d in enumerate(b))]
        best = max(best, *row)
    return best


def _tokens(text: str) -> list[str]:
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


def _edit_likeness(a: str, b: str) -> float:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return 1 - row[-1] / max(len(a), len(b), 1)


def monge_elkan_score(a: str, b: str) -> float:
    """Mean over a's tokens of the best Jaro-Winkler similarity with a token of b."""
    x, y = _tokens(a), _tokens(b)
    return sum(max(jaro_winkler_score(s, t) for t in y) for s in x) / len(x) if x and y else 0.0


def soft_tfidf_score(a: str, b: str, threshold: float = 0.8) -> float:
    """Cosine of token weights where tokens also match whose edit similarity is at least the threshold."""

    def weights(tokens: list[str]) -> dict[str, float]:
        raw = {t: math.log(1 + c) for t, c in Counter(tokens).items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()}

    x, y = weights(_tokens(a)), weights(_tokens(b))
    total = 0.0
    for s, w in x.items():
        near, like = max(((t, 1.0 if s == t else _edit_likeness(s, t)) for t in y), key=lambda p: p[1], default=("", 0.0))
        if like >= threshold:
            total += w * y[near] * like
    return min(1.0, total)


def _pairwise(score: Callable[[str, str], float], kind: T.DataType):
    @F.pandas_udf(kind)
    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple, float | None] = {}
        out = []
        for pair in zip(a, b, strict=True):
            if pair not in known:
                known[pair] = None if pair[0] is None or pair[1] is None else score(*pair)
            out.append(known[pair])
        return pd.Series(out)

    return over


jaro_winkler = _pairwise(jaro_winkler_score, T.DoubleType())
ngram_similarity = _pairwise(ngram_score, T.DoubleType())
monge_elkan = _pairwise(monge_elkan_score, T.DoubleType())
soft_tfidf = _pairwise(soft_tfidf_score, T.DoubleType())
common_substring = _pairwise(common_substring_length, T.LongType())


def matches_longer_name(short: Column, long: Column) -> Column:
    """Whether the short name, one word, is close (Jaro-Winkler above 0.9) to a word of the longer one."""
    return _short_in_long(short, long)


@F.pandas_udf(T.BooleanType())
def _short_in_long(short: pd.Series, long: pd.Series) -> pd.Series:
    def one(a, b):
        return a is not None and b is not None and len(b) > len(a) and " " not in a and any(jaro_winkler_score(a, t) > 0.9 for t in b.split(" "))

    return pd.Series([one(a, b) for a, b in zip(short, long, strict=True)])
