"""Growable arrays, small matrices, JSON fields and random draws, as Column expressions where Spark has the parts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def append(array: Column, value: Column) -> Column:
    return F.array_append(F.coalesce(array, F.array()), value)


def put(array: Column, i: int, value: Column, fill: Column) -> Column:
    """The array with value at place i (from 0), grown with fill up to there."""
    grown = F.concat(array, F.array_repeat(fill, F.greatest(F.lit(i + 1) - F.size(array), F.lit(0))))
    return F.transform(grown, lambda x, k: F.when(k == i, value).otherwise(x))


def drop_at(array: Column, i: int) -> Column:
    return F.filter(array, lambda x, k: k != i)


def mat_vec(matrix: Column, vector: Column) -> Column:
    """A matrix (array of rows) times a vector."""
    return F.transform(matrix, lambda row: F.aggregate(F.zip_with(row, vector, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))


def outer(a: Column, b: Column) -> Column:
    return F.transform(a, lambda x: F.transform(b, lambda y: x * y))


def transpose(matrix: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(matrix[0]) - 1), lambda j: F.transform(matrix, lambda row: F.get(row, j)))


def trace(matrix: Column) -> Column:
    return F.aggregate(F.transform(matrix, lambda row, i: F.get(row, i)), F.lit(0.0), lambda s, x: s + x)


def _stacked(values: pd.Series) -> np.ndarray:
    return np.array([[np.asarray(r, float) for r in m] for m in values])


@F.pandas_udf(DoubleType())
def determinant(matrix: pd.Series) -> pd.Series:
    return pd.Series(np.linalg.det(_stacked(matrix)) if len(matrix) else [])


@F.pandas_udf(ArrayType(DoubleType()))
def solve(matrix: pd.Series, vector: pd.Series) -> pd.Series:
    """x with matrix x = vector; all matrices of a batch at once."""
    if not len(matrix):
        return pd.Series([], dtype=object)
    return pd.Series(list(np.linalg.solve(_stacked(matrix), np.stack(vector)[..., None])[..., 0]))


def json_field(text: Column, path: str, kind: str = "string") -> Column:
    """The value at a path such as "$.a.b" of a JSON text; null where it isn't there."""
    return F.get_json_object(text, path).try_cast(kind)


def json_counts(values: Column) -> Column:
    """A map of counts as JSON text, keys sorted."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))


def uniform(seed: int, *columns) -> Column:
    """A draw from [0, 1) that depends on the seed and columns alone, so that a lost task draws the same again."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 53)) / float(1 << 53)


def normal(seed: int, *columns, mean: float = 0.0, deviation: float = 1.0) -> Column:
    u = 1 - uniform(seed, F.lit("r"), *columns)
    return mean + deviation * F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * uniform(seed, F.lit("a"), *columns))


def exponential(seed: int, *columns, rate: float = 1.0) -> Column:
    return -F.log(1 - uniform(seed, *columns)) / rate


def chi_square(seed: int, *columns, freedom: int) -> Column:
    """A sum of squares of `freedom` normal draws."""
    pairs = -2 * sum((F.log(1 - uniform(seed, F.lit(i), *columns)) for i in range(freedom // 2)), F.lit(0.0))
    return pairs + F.pow(normal(seed, F.lit("odd"), *columns), F.lit(2)) if freedom % 2 else pairs


def gamma(shape: Column, seed: Column, scale: float = 1.0) -> Column:
    """A draw of each row's own shape, from a generator seeded by the row."""

    @F.pandas_udf(DoubleType())
    def run(k: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng(int(i) % (1 << 63)).gamma(x) for x, i in zip(k, s)])

    return run(shape.cast("double"), seed.cast("long")) * scale


def wishart(rng: np.random.Generator, freedom: int, scale: np.ndarray) -> np.ndarray:
    """A draw of a precision matrix (Bartlett's decomposition)."""
    d = len(scale)
    root = np.linalg.cholesky(scale)
    a = np.tril(rng.standard_normal((d, d)), -1) + np.diag(np.sqrt(rng.chisquare(freedom - np.arange(d))))
    return root @ a @ a.T @ root.T


def multivariate_normal(rng: np.random.Generator, mean: np.ndarray, covariance: np.ndarray) -> np.ndarray:
    return mean + np.linalg.cholesky(covariance) @ rng.standard_normal(len(mean))
