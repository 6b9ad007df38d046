"""Distances of float arrays in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _both(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, 1, n), F.slice(b, 1, n)


def l2(a: Column, b: Column) -> Column:
    a, b = _both(a, b)
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 when a norm is 0."""
    a, b = _both(a, b)
    dot = _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    na, nb = (_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))) for v in (a, b))
    return F.when((na == 0) | (nb == 0), 0.0).otherwise(dot / (F.sqrt(na) * F.sqrt(nb)))


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed counts of hashed words, unit length."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: _sum(F.transform(F.filter(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)) == i), lambda w: F.when(F.pmod(F.hash(w), F.lit(2)) == 0, 1.0).otherwise(-1.0))))
    norm = F.sqrt(_sum(F.transform(counts, lambda x: x * x)))
    return F.when(norm > 0, F.transform(counts, lambda x: (x / norm).cast("float")))
