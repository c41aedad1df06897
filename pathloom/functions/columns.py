"""Column functions: weights, entropies, padded fields, elementwise array arithmetic with missing values."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def gaussian(x: Column, mu: float = 0.0, sigma: float = 1.0) -> Column:
    z = (x - mu) / sigma
    return F.exp(-z * z / 2) / (sigma * math.sqrt(2 * math.pi))


def logistic(x: Column, beta: float) -> Column:
    return 1.0 / (1.0 + F.exp(F.lit(beta) * (x - 0.5)))


def power_weight(x: Column, alpha: float) -> Column:
    return F.pow(F.lit(alpha), -x)


def ceil_log2(x: Column) -> Column:
    return F.ceil(F.log2(x)).cast("int")


def entropy(shares: Column) -> Column:
    """-sum p log10 p over an array of shares; shares of nothing add nothing."""
    return F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log10(p)).otherwise(0.0))


def fixed(line: Column, start: int, end: int) -> Column:
    """The field at columns start..end (from 0, end exclusive), trimmed."""
    return F.trim(F.substring(line, start + 1, end - start))


def right_justified(value: Column, width: int) -> Column:
    return F.lpad(value.cast("string"), width, " ")


def symbol_of(atom: Column) -> Column:
    """An atom label without the detail after its dot."""
    return F.split_part(atom, F.lit("."), F.lit(1))


def bond_label(a: Column, b: Column, kind: Column) -> Column:
    return F.concat(F.least(a, b), kind.cast("string"), F.greatest(a, b))


def elementwise(a: Column, b: Column, how: str) -> Column:
    """min, max, add, sub or div of two arrays; min and max take the other where one is null, the rest give null."""
    pick = {
        "min": lambda x, y: F.least(x, y),
        "max": lambda x, y: F.greatest(x, y),
        "add": lambda x, y: x + y,
        "sub": lambda x, y: x - y,
        "div": lambda x, y: F.when(y != 0, x / y),
    }[how]
    return F.zip_with(a, b, pick)


def filled(value: Column, n: int) -> Column:
    return F.array_repeat(value, n)


def array_sum(a: Column) -> Column:
    return F.aggregate(F.transform(F.filter(a, lambda x: x.isNotNull()), lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x)


def multiset_common(a: Column, b: Column) -> Column:
    """How many elements two arrays share, counting repeats."""
    seen = F.array_distinct(a)
    times = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    return F.aggregate(F.transform(seen, lambda x: F.least(times(a, x), times(b, x))), F.lit(0), lambda s, x: s + x)


def merged_counts(a: Column, b: Column) -> Column:
    """Two maps of counts added."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
