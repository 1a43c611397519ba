"""Expressions over ``array<double>`` columns (action values, logits, states)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(values: Column) -> Column:
    """Zero-based index of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def pick(values: Column, index: Column) -> Column:
    """Element at a zero-based index."""
    return F.element_at(values, index.cast("int") + 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda a, b: a * b))


def logsumexp(values: Column) -> Column:
    peak = F.array_max(values)
    return peak + F.log(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - peak)))


def softmax(logits: Column) -> Column:
    norm = logsumexp(logits)
    return F.transform(logits, lambda x: F.exp(x - norm))


def log_softmax(logits: Column) -> Column:
    norm = logsumexp(logits)
    return F.transform(logits, lambda x: x - norm)


def entropy(probs: Column, floor: float = 1e-8) -> Column:
    terms = F.transform(probs, lambda p: p * F.log(F.greatest(p, F.lit(floor))))
    return -total(terms)
