"""Vector and scalar functions on Columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def dot3(a: Column, b: Column, c: Column) -> Column:
    return dot(multiply(a, b), c)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(v: Column, by: Column | float) -> Column:
    return F.transform(v, lambda x: x * by)


def power(v: Column, exponent: float) -> Column:
    return F.transform(v, lambda x: F.pow(x, F.lit(exponent)))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def abs_sum(v: Column) -> Column:
    return total(F.transform(v, F.abs))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def ones(n: int) -> Column:
    return F.array_repeat(F.lit(1.0), n)


def head(v: Column, n: int) -> Column:
    return F.slice(v, 1, n)


def middle(v: Column, start: int, n: int) -> Column:
    """n elements from start, counted from 0."""
    return F.slice(v, start + 1, n)


def tail(v: Column, n: int) -> Column:
    return F.slice(v, F.greatest(F.size(v) - n, F.lit(0)) + 1, F.lit(n))


def remove_at(v: Column, i: int) -> Column:
    return F.filter(v, lambda x, k: k != i)


def running_sum(v: Column) -> Column:
    step = lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x))
    return F.aggregate(v, F.array().cast("array<double>"), step)


def sort_index(v: Column, descending: bool = False) -> Column:
    """Places of the elements in sorted order, counted from 0; ties by place."""
    sign = -1 if descending else 1
    pairs = F.transform(v, lambda x, i: F.struct((x * sign).alias("x"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def outer(a: Column, b: Column) -> Column:
    return F.transform(a, lambda x: F.transform(b, lambda y: x * y))


def sparse_dot(a: Column, b: Column) -> Column:
    """Of maps from long to double."""
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def sigmoid_slope(x: Column) -> Column:
    return sigmoid(x) * (1 - sigmoid(x))


def safe_log(x: Column) -> Column:
    return F.when(x > 0, F.log(x)).otherwise(0.0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
