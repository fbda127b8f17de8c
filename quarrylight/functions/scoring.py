"""Scoring, map and calibration functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def squash(x: Column) -> Column:
    """Scores over 1 go to s / (1 + s)."""
    return F.when(x > 1, x / (1 + x)).otherwise(x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed in the vectors' order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_score(distance: Column) -> Column:
    """A cosine distance as a score from 0 to 1; null gives 0."""
    return F.coalesce(clamp(1 - distance), F.lit(0.0))


def term_weight(term: Column) -> Column:
    """Longer terms, terms with a digit and terms of ten characters or more weigh more."""
    n = F.length(term)
    return 1.0 + F.least(F.lit(1.1), F.greatest(F.lit(0.0), (n - 4) * 0.12)) + F.when(term.rlike("[0-9]"), 0.35).otherwise(0.0) + F.when(n >= 10, 0.45).otherwise(0.0)


def total_weight(terms: Column) -> Column:
    return F.aggregate(F.transform(terms, term_weight), F.lit(0.0), lambda s, x: s + x)


def support_score(claim: Column, source: Column) -> Column:
    """How far a source's terms cover a claim's: 0.78 coverage and 0.22 density."""
    both, nc, ns = F.size(F.array_intersect(claim, source)), F.size(claim), F.size(source)
    density = both / F.greatest(F.lit(1), F.least(ns, nc * 4))
    return F.when((nc == 0) | (ns == 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), both / nc * 0.78 + density * 0.22))


def verdict(score: Column, supported: Column, cited: Column) -> Column:
    """``supported``: some source is over the floor; ``cited``: the claim names one."""
    return F.when((score >= 0.42) & supported, "supported").when((score >= 0.22) & supported, "weakly_supported").when(cited & supported, "weakly_supported").otherwise("unsupported")


def downgraded(v: Column) -> Column:
    return F.when(v == "supported", "weakly_supported").when(v == "weakly_supported", "unsupported").otherwise(v)


def mapped(x: Column, table: dict, default=None) -> Column:
    """A lookup in a small constant table."""
    pairs = F.create_map([F.lit(v) for kv in table.items() for v in kv])
    got = F.try_element_at(pairs, x)
    return got if default is None else F.coalesce(got, F.lit(default))
