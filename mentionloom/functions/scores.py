"""Scores and vector measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tfidf(tf: Column, df: Column, n: Column) -> Column:
    """Square root of the frequency times 1 + ln(n / (df + 1))."""
    return F.sqrt(tf) * (1 + F.log(n / (df + 1)))


def cosine_dense(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def divergence_term(p: Column, q: Column, floor: float = 1e-6, penalty: float = 10.0) -> Column:
    """What one place adds to the divergence of p from q: p log2(p/q), or p times the penalty where q is about 0."""
    return F.when(p == 0, 0.0).when(q <= floor, p * penalty).otherwise(p * F.log2(p / q))


def divergence_dense(p: Column, q: Column) -> Column:
    """Kullback-Leibler divergence with a floor over two arrays; 0 for nulls and unequal lengths."""
    total = F.aggregate(F.zip_with(p, q, lambda x, y: divergence_term(x, y)), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(p) == F.size(q), total).otherwise(0.0)


def semantic_similarity(divergence: Column, least: float = 1e-9) -> Column:
    """1 over the divergence, which counts as ``least`` at least; a missing vector gives 0."""
    return F.coalesce(1 / F.greatest(divergence, F.lit(least)), F.lit(0.0))


def score(scheme: str, prior: Column, local: Column, semantic: Column, prior_weight: float = 0.08, local_weight: float = 0.1) -> Column:
    if scheme == "LINEAR":
        return prior_weight * prior + local_weight * local + (1 - prior_weight - local_weight) * semantic
    if scheme == "MULTIPLY":
        return prior_weight * prior * semantic + (1 - prior_weight) * local * semantic
    if scheme == "NOR":
        return 1 - (1 - prior) * (1 - local) * (1 - semantic)
    if scheme == "PRIOR_SEM":
        return prior * semantic
    if scheme == "LOCAL_SEM":
        return local * semantic
    if scheme == "SEMANTIC":
        return semantic
    raise ValueError(f"unknown rank scheme {scheme}")


def relatedness(larger: Column, smaller: Column, common: Column, total: Column) -> Column:
    """Link relatedness from sizes of the larger and smaller neighbourhood, their common part and the number of nodes.

    0 where nothing is common, or where the distance is below 0 or not below 1
    (compared after rounding to 12 digits, for logarithms come out a hair off).
    """
    distance = F.round((F.log(larger.cast("double")) - F.log(common.cast("double"))) / (F.log(total.cast("double")) - F.log(smaller.cast("double"))), 12)
    return F.when((common <= 0) | distance.isNull() | F.isnan(distance) | (distance < 0) | (distance >= 1), 0.0).otherwise(1 - distance)
