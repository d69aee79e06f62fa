"""Similarity of vectors and sets.

Lengths that differ raise an error; with ``strict=False`` they give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswork.core.jscompat import let


def _checked(a: Column, b: Column, value: Column, strict: bool) -> Column:
    odd = F.raise_error(F.lit("Vectors must have the same length")).cast("double") if strict else F.lit(None).cast("double")
    return F.when(F.size(a) != F.size(b), odd).otherwise(value)


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column, strict: bool = True) -> Column:
    a, b = a.cast("array<double>"), b.cast("array<double>")
    return _checked(a, b, _sum(F.zip_with(a, b, lambda x, y: x * y)), strict)


def cosine(a: Column, b: Column, strict: bool = True) -> Column:
    """0 where a vector has no length."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    norm = lambda v: F.sqrt(_sum(F.transform(v, lambda x: x * x)))
    both = norm(a) * norm(b)
    return _checked(a, b, F.when(both == 0, F.lit(0.0)).otherwise(_sum(F.zip_with(a, b, lambda x, y: x * y)) / both), strict)


def euclidean(a: Column, b: Column, strict: bool = True) -> Column:
    a, b = a.cast("array<double>"), b.cast("array<double>")
    return _checked(a, b, F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))), strict)


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of two arrays; two empty ones are equal."""
    return let(F.array_union(a, b), lambda either: F.when(F.size(either) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(either)))


def bag_of_words(tokens: Column, vocabulary: Column) -> Column:
    """How often each word of ``vocabulary``, in its order, occurs in ``tokens``.

    The tokens are bound first: inside the lambda they would be made once for every word.
    """
    return let(tokens, lambda found: F.transform(vocabulary, lambda v: F.size(F.filter(found, lambda t: t == v)).cast("bigint")))
