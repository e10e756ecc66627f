"""Functions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle; null if a vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def signature_order_two(increments: Column, width: int) -> Column:
    """Signature of a path up to order two: struct(first array, second array of width x width, row by row).

    ``increments`` is an ordered array of arrays of ``width`` numbers; the fold adds S1 x increment + increment x increment / 2.
    """
    zero = F.struct(F.array_repeat(F.lit(0.0), width).alias("first"), F.array_repeat(F.lit(0.0), width * width).alias("second"))
    cells = F.sequence(F.lit(0), F.lit(width * width - 1))

    def step(s, x):
        at = lambda array, i: F.element_at(array, (i + 1).cast("int")).cast("double")
        second = F.transform(cells, lambda c: at(s["second"], c) + (at(s["first"], F.floor(c / width)) + 0.5 * at(x, F.floor(c / width))) * at(x, c % width))
        return F.struct(F.zip_with(s["first"], x, lambda a, b: a + b.cast("double")).alias("first"), second.alias("second"))

    return F.aggregate(increments, zero, step)


def softmax_pool(logits: Column, values: Column) -> Column:
    """Sum of values weighted by the softmax of their logits."""
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(x - top))
    return F.aggregate(F.zip_with(weights, values, lambda w, v: w * v), F.lit(0.0), lambda s, x: s + x) / F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
