"""Factor models of ratings, trained in supersteps.

Every model gathers additive statistics and applies them: a rating row joined
with both factors adds to its vertex's statistics within each batch, the
batches' sums are added for each vertex, and the vertex takes its new factor
from the total. So a user or item with any number of ratings is summed in
parts; no task holds all of them. Within a step all vertices of a side see the
factors of the step before. A batch's vertices are updated at once, by stacked
matrices.
"""

from __future__ import annotations

import copy
import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stored, collect, cut
from . import blocks


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(x / 2)


@dataclass
class Model:
    """gather(own, other, rows) -> statistics for each rating; apply(own, total, n) -> new factors.

    own and other: rating x size arrays; rows: the ratings' columns (rating,
    and time or weight if given). apply takes the factors, summed statistics
    and numbers of ratings of many vertices, a row each. After each iteration
    the rate is multiplied by decay.
    """

    size: int = 8
    regularization: float = 0.05
    rate: float = 0.02
    seed: int = 7
    decay: float = 1.0

    def start(self, ids: np.ndarray, side: int) -> np.ndarray:
        """A first factor for each id, from a seeded generator of its own."""
        out = [np.random.default_rng([self.seed, side, abs(int(i))]).random(self.width) for i in ids]
        return np.array(out) * self.scale if len(out) else np.empty((0, self.width))

    scale = 0.3

    @property
    def width(self) -> int:
        return self.size

    def predict(self, user: np.ndarray, item: np.ndarray, rows: pd.DataFrame, mean: float) -> np.ndarray:
        return np.einsum("ij,ij->i", user, item)

    def scores(self, users: np.ndarray, items: np.ndarray, mean: float) -> np.ndarray:
        """The prediction of every user (rows) for every item (columns)."""
        return users @ items.T

    def place(self, f: np.ndarray, side: int) -> np.ndarray:
        """Vectors of users (side 0) or items; a user's score never falls as the inner product with the item's rises."""
        return f

    def bounds(self, users: np.ndarray, products: np.ndarray, mean: float) -> np.ndarray:
        """The scores of users (rows) that inner products of place() stand for; infinite where nothing is known."""
        return products

    def gather(self, own, other, rows, mean, side) -> np.ndarray:
        raise NotImplementedError

    def apply(self, own, total, n, side) -> np.ndarray:
        raise NotImplementedError


class LeastSquares(Model):
    """Alternating least squares: (sum q q' + lambda I)^-1 sum r q; lambda may grow with the number of ratings."""

    scaled = False

    def neighbour(self, other, rows):
        return other

    def weight(self, rows):
        return np.ones(len(rows))

    def gather(self, own, other, rows, mean, side):
        q, w = self.neighbour(other, rows), self.weight(rows)
        square = np.einsum("ni,nj,n->nij", q, q, w).reshape(len(q), -1)
        return np.hstack([square, q * (w * rows["rating"].to_numpy(float))[:, None]])

    def solve(self, a, b, own):
        return np.linalg.solve(a, b[..., None])[..., 0]

    def apply(self, own, total, n, side):
        d = self.size
        weight = n if self.scaled else np.ones(len(n))
        a = total[:, : d * d].reshape(-1, d, d) + np.eye(d) * (self.regularization * weight)[:, None, None]
        return self.solve(a, total[:, d * d :], own)


class WeightedLeastSquares(LeastSquares):
    """Each rating counts by its weight column."""

    def weight(self, rows):
        return rows["weight"].to_numpy(float)


class TensorLeastSquares(LeastSquares):
    """A third side: every time value has a factor, fitted in turn; a prediction is the sum of the three's product."""

    def join(self, others, rows):
        return others[0] * others[1]

    def predict_of(self, sides, rows, mean):
        return np.einsum("ij,ij,ij->i", *sides)


class CoordinateDescent(LeastSquares):
    """One pass of exact coordinate steps on the normal equations instead of a solve."""

    def solve(self, a, b, own):
        x = own.copy()
        for t in range(x.shape[1]):
            x[:, t] += (b[:, t] - np.einsum("nj,nj->n", a[:, t], x)) / a[:, t, t]
        return x


def cosamp(a: np.ndarray, b: np.ndarray, sparsity: int, steps: int = 20, enough: float = 1e-4) -> np.ndarray:
    """Compressive sampling matching pursuit: x with at most `sparsity` entries and a x about b.

    Each step solves on the columns that correlate most with what is left and
    the support so far, and keeps the largest entries. It ends when the rest
    is small or no longer falls; the best x is returned.
    """
    x, rest = np.zeros(a.shape[1]), np.linalg.norm(b)
    for _ in range(steps):
        proxy = np.abs(a.T @ (b - a @ x))
        support = np.union1d(np.argsort(-proxy, kind="stable")[: 2 * sparsity], np.flatnonzero(x)).astype(int)
        z = np.linalg.lstsq(a[:, support], b, rcond=None)[0]
        best = np.argsort(-np.abs(z), kind="stable")[:sparsity]
        new = np.zeros_like(x)
        new[support[best]] = z[best]
        left = np.linalg.norm(b - a @ new)
        if left >= rest and x.any():
            break
        x, rest = new, left
        if rest < enough:
            break
    return x


class SparseLeastSquares(LeastSquares):
    """Factors with few entries, by matching pursuit on the normal equations."""

    sparsity = 4

    def solve(self, a, b, own):
        return np.stack([cosamp(x, y, self.sparsity) for x, y in zip(a, b)])


class Nonnegative(Model):
    """Multiplicative updates: x * sum r q / sum (x.q) q."""

    def gather(self, own, other, rows, mean, side):
        r, guess = rows["rating"].to_numpy(float), np.einsum("ij,ij->i", own, other)
        return np.hstack([other * r[:, None], other * guess[:, None]])

    def apply(self, own, total, n, side):
        d = self.size
        return np.maximum(own * total[:, :d] / np.maximum(total[:, d:], 1e-9), 1e-9)


class Gradient(Model):
    """Gradient steps on squared error; one step of a side takes its mean gradient, scaled by the square root of its ratings."""

    def error(self, own, other, rows, mean, side):
        user, item = (own, other) if side == 0 else (other, own)
        return rows["rating"].to_numpy(float) - self.predict(user, item, rows, mean)

    def slope(self, own, other, rows, side):
        return other

    def gather(self, own, other, rows, mean, side):
        return self.error(own, other, rows, mean, side)[:, None] * self.slope(own, other, rows, side)

    def apply(self, own, total, n, side):
        return own + self.rate * (total / np.sqrt(n)[:, None] - self.regularization * own)


class BiasedGradient(Gradient):
    """mean + both biases + p.q; the bias is the factor's last entry."""

    @property
    def width(self):
        return self.size + 1

    def predict(self, user, item, rows, mean):
        return mean + user[:, -1] + item[:, -1] + np.einsum("ij,ij->i", user[:, :-1], item[:, :-1])

    def scores(self, users, items, mean):
        return mean + users[:, -1:] + items[:, -1] + users[:, :-1] @ items[:, :-1].T

    def place(self, f, side):
        return np.hstack([f[:, :-1], np.ones((len(f), 1))]) if side == 0 else f

    def bounds(self, users, products, mean):
        return mean + users[:, -1:] + products

    def slope(self, own, other, rows, side):
        return np.hstack([other[:, :-1], np.ones((len(other), 1))])


class LogisticGradient(BiasedGradient):
    """Ratings scaled to 0..1 and squashed; loss square, logistic or abs."""

    loss = "logistic"
    low, high = 0.0, 60.0

    def predict(self, user, item, rows, mean):
        return self._open(super().predict(user, item, rows, 0.0))

    def _open(self, z):
        return self.low + (self.high - self.low) * _logistic(z)

    def scores(self, users, items, mean):
        return self._open(super().scores(users, items, 0.0))

    def bounds(self, users, products, mean):
        return self._open(super().bounds(users, products, 0.0))

    def error(self, own, other, rows, mean, side):
        e = super().error(own, other, rows, mean, side) / (self.high - self.low)
        return np.sign(e) if self.loss == "abs" else e


class ImplicitGradient(BiasedGradient):
    """SVD++: mean + both biases + q.(p + sum of y / sqrt(n)), with the y of each of the user's n rated items.

    A user is p, the weighted sum of y, the weighted sum of error * q that y's slope needs, n and bu; an item q, y and
    bi. As all y of a user move at once, an item's step of y is divided by the mean n of its users.
    """

    @property
    def width(self):
        return 3 * self.size + 2

    def start(self, ids, side):
        d, out = self.size, super().start(ids, side)
        if side == 1:
            out = out[:, : 2 * d + 1]
        else:
            out[:, d:] = 0.0
        out[:, -1] = 0.0
        return out

    def predict(self, user, item, rows, mean):
        d = self.size
        return mean + user[:, -1] + item[:, -1] + np.einsum("ij,ij->i", user[:, :d] + user[:, d : 2 * d], item[:, :d])

    def scores(self, users, items, mean):
        d = self.size
        return mean + users[:, -1:] + items[:, -1] + (users[:, :d] + users[:, d : 2 * d]) @ items[:, :d].T

    def place(self, f, side):
        d = self.size
        return np.hstack([f[:, :d] + f[:, d : 2 * d], np.ones((len(f), 1))]) if side == 0 else np.hstack([f[:, :d], f[:, -1:]])

    def gather(self, own, other, rows, mean, side):
        d, e = self.size, self.error(own, other, rows, mean, side)[:, None]
        if side == 0:
            return np.hstack([e * other[:, :d], other[:, d : 2 * d], e * other[:, :d], np.zeros_like(e), e])
        return np.hstack([e * (other[:, :d] + other[:, d : 2 * d]), other[:, 2 * d : 3 * d], e, other[:, -2:-1]])

    def apply(self, own, total, n, side):
        d, root = self.size, np.sqrt(n)[:, None]
        if side == 1:
            total, counts = total[:, :-1].copy(), total[:, -1]
            total[:, d : 2 * d] *= (n / np.maximum(counts, 1.0))[:, None]
        new = own + self.rate * (total / root - self.regularization * own)
        if side == 0:
            new[:, d : 3 * d] = total[:, d : 3 * d] / root
            new[:, -2] = n
        return new


class TimeGradient(Model):
    """timeSVD++: mean + bu + bi + q.(p + sum of y / sqrt(n + 10)) + x.z + q.(pu * pt), with z and pt of every time value.

    y is that of each of the user's n rated items. A user is p, pu, x, the weighted sum of y, the weighted sum of
    error * q that y's slope needs, n and bu; an item q, y and bi; a time value z and pt. As all y of a user move at
    once, an item's step of y is divided by the mean n of its users; a time value's step takes its mean gradient. (The
    reference adds up y over its entries too, and takes pu for p there.)
    """

    parts = (5, 2, 2)

    @property
    def width(self):
        return 5 * self.size + 2

    def start(self, ids, side):
        d, out = self.size, super().start(ids, side)[:, : self.parts[side] * self.size + 2 - side]
        out[:, -1 if side < 2 else out.shape[1] :] = 0.0
        if side == 0:
            out[:, 3 * d :] = 0.0
        return out

    def predict_of(self, sides, rows, mean):
        (p, pu, x, y, _), (q, _), (z, pt) = (np.split(f[:, : n * self.size], n, axis=1) for f, n in zip(sides, self.parts))
        return mean + sides[0][:, -1] + sides[1][:, -1] + ((p + y + pu * pt) * q + x * z).sum(axis=1)

    def gather_of(self, sides, rows, mean, side):
        (p, pu, x, y, s), (q, of), (z, pt) = (np.split(f[:, : n * self.size], n, axis=1) for f, n in zip(sides, self.parts))
        e = (rows["rating"].to_numpy(float) - self.predict_of(sides, rows, mean))[:, None]
        if side == 0:
            return np.hstack([e * q, e * q * pt, e * z, of, e * q, np.zeros_like(e), e])
        if side == 1:
            return np.hstack([e * (p + y + pu * pt), s, e, sides[0][:, -2:-1]])
        return np.hstack([e * x, e * q * pu])

    def apply(self, own, total, n, side):
        d = self.size
        if side == 1:
            total, counts = total[:, :-1].copy(), total[:, -1]
            total[:, d : 2 * d] *= (n / np.maximum(counts, 1.0))[:, None]
        new = own + self.rate * (total / (n if side == 2 else np.sqrt(n))[:, None] - self.regularization * own)
        if side == 0:
            new[:, 3 * d : 5 * d] = total[:, 3 * d : 5 * d] / np.sqrt(n + 10)[:, None]
            new[:, -2] = n
        return new

    def scores(self, users, items, mean):
        raise ValueError("a prediction needs a time; use predict")


class RankGradient(Model):
    """CLiMF: ascends the smoothed reciprocal rank of a user's relevant items (rating at or over a threshold).

    The objective of a user is the sum over relevant j of ln g(f_j) + sum over relevant k of ln g(f_j - f_k), with
    f = p.q and g logistic, less regularization / 2 of the squared factors. Its slope is c_j q_j for p and c_j p for
    q_j, with c_j = g(-f_j) - sum over k of tanh((f_j - f_k) / 2). (The reference leaves out p in the first term of
    q's slope; here it is the objective's own.) Each side divides its slope by a bound of the curvature, so no step
    lowers the objective. Items that aren't relevant and users with fewer than 2 relevant items are not trained on;
    their factors stay as they began. Trained by fit_rank.
    """

    threshold = 25.0

    def predict(self, user, item, rows, mean):
        """The predicted reciprocal rank, in 0..1."""
        return _logistic(np.einsum("ij,ij->i", user, item))

    def scores(self, users, items, mean):
        return _logistic(users @ items.T)

    def bounds(self, users, products, mean):
        return _logistic(products)

    def gather(self, own, other, rows, mean, side):
        bound = (0.25 + rows["relevant"].to_numpy(float) / 2) * np.einsum("ij,ij->i", other, other)
        return np.hstack([other * rows["slope"].to_numpy(float)[:, None], bound[:, None]])

    def apply(self, own, total, n, side):
        return own + (total[:, :-1] - self.regularization * own) / (total[:, -1:] + self.regularization)


class SampledFactors(LeastSquares):
    """Bayesian matrix factorization by Gibbs sampling, from a seeded generator for each sweep, side and id.

    A sweep draws the noise's precision (Wishart, 1 and 1), each side's mean and precision (normal and Wishart around 0
    and the identity), then the factors of users and of items. The first burn_in sweeps are discarded; a prediction is
    the mean of those of all later draws, which a fitted factor holds one after another.
    """

    burn_in = 10

    def predict(self, user, item, rows, mean):
        return np.einsum("ij,ij->i", user, item) / (user.shape[1] // self.size)

    def scores(self, users, items, mean):
        return users @ items.T / (users.shape[1] // self.size)

    def bounds(self, users, products, mean):
        return products / (users.shape[1] // self.size)

    def hyper(self, n: int, total: np.ndarray, square: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
        """A side's mean and precision given the count, sum and sum of outer products of its factors."""
        d = self.size
        spread = np.eye(d) + square - np.outer(total, total) / (n + 1)
        root = np.linalg.cholesky(np.linalg.inv((spread + spread.T) / 2))
        bartlett = np.tril(rng.standard_normal((d, d)), -1) + np.diag(np.sqrt(rng.chisquare(d + n - np.arange(d))))
        precision = root @ bartlett @ bartlett.T @ root.T
        return rng.multivariate_normal(total / (n + 1), np.linalg.inv((n + 1) * precision), method="eigh"), precision

    def gather(self, own, other, rows, mean, side):
        square = (other[:, :, None] * other[:, None, :]).reshape(len(other), -1)
        return np.hstack([square, other * rows["rating"].to_numpy(float)[:, None]])

    def draw(self, ids, a, b, alpha: float, mean: np.ndarray, precision: np.ndarray, sweep: int, side: int) -> np.ndarray:
        """A factor for each id from its posterior, given the sums a of q q' and b of r q."""
        root = np.linalg.cholesky(precision + alpha * a)
        z = np.array([np.random.default_rng([self.seed, sweep, side, int(i) % (1 << 64)]).standard_normal(self.size) for i in ids])
        half = np.linalg.solve(root, (precision @ mean + alpha * b)[..., None])
        return np.linalg.solve(root.transpose(0, 2, 1), half + z[..., None])[..., 0]


class Boltzmann(Model):
    """A restricted Boltzmann machine over binned ratings, by one step of mean-field contrastive divergence.

    A user's state is its hidden units' probabilities; an item's its weights,
    one row for each bin, flattened.
    """

    bins = 4
    low, high = 0.0, 60.0
    scale = 0.1

    @property
    def width(self):
        return self.size * self.bins

    def _visible(self, rows):
        b = (rows["rating"].to_numpy(float) - self.low) / (self.high - self.low) * self.bins
        return np.eye(self.bins)[np.clip(b.astype(int), 0, self.bins - 1)]

    def _expected(self, hidden, weights):
        z = np.einsum("nd,nbd->nb", hidden, weights)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, user, item, rows, mean):
        p = self._expected(user[:, : self.size], item.reshape(len(item), self.bins, self.size))
        return self.low + (p * (np.arange(self.bins) + 0.5)).sum(axis=1) * (self.high - self.low) / self.bins

    def scores(self, users, items, mean):
        return np.stack([self.predict(np.broadcast_to(u, (len(items), len(u))), items, None, mean) for u in users])

    def bounds(self, users, products, mean):
        return np.full(products.shape, np.inf)

    def gather(self, own, other, rows, mean, side):
        v, d = self._visible(rows), self.size
        if side == 0:
            out = np.zeros((len(own), self.width))
            out[:, :d] = np.einsum("nb,nbd->nd", v, other.reshape(len(other), self.bins, d))
            return out
        w = own.reshape(len(own), self.bins, d)
        return np.einsum("nb,nd->nbd", v - self._expected(other[:, :d], w), other[:, :d]).reshape(len(own), -1)

    def apply(self, own, total, n, side):
        if side == 0:
            return _logistic(total)
        return own + self.rate * (total / np.sqrt(n)[:, None] - self.regularization * own)


def _start(ids: DataFrame, model: Model, side: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "f": list(model.start(pdf["id"].to_numpy(), side))})

    return ids.mapInPandas(run, "id long, f array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x, float).ravel()), x.shape[1]).cast(pa.list_(pa.float64()))


def _scalars(batch: pa.RecordBatch) -> pd.DataFrame:
    return batch.select([f.name for f in batch.schema if not pa.types.is_list(f.type)]).to_pandas()


def _summed(ids: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    """id, s, n: the rows of s added up for each id."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    head = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    total = np.add.reduceat(s[order], head, axis=0)
    return pa.RecordBatch.from_arrays([pa.array(ids[head]), _lists(total), pa.array(np.diff(np.append(head, len(ids))))], names=["id", "s", "n"])


def _parts(ratings: DataFrame, own: DataFrame, other: DataFrame, model: Model, mean: float, side: int) -> DataFrame:
    """id, s, n: sums of statistics of one side within batches, from ratings (own, other, rating, ...).

    The last join sorts the ratings by own, so a batch has few vertices and a
    vertex few parts.
    """
    rows = ratings.join(other.select(F.col("id").alias("other"), F.col("f").alias("g")), "other").join(own.withColumnRenamed("id", "own").hint("merge"), "own")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = model.gather(_matrix(batch.column("f")), _matrix(batch.column("g")), _scalars(batch), mean, side)
                yield _summed(batch.column("own").to_numpy(), s)

    return rows.mapInArrow(gather, "id long, s array<double>, n long")


def _applied(parts: DataFrame, own: DataFrame, model: Model, side: int) -> DataFrame:
    """New factors (id, f) from the parts (id, s, n) of each vertex."""
    sums = parts.groupBy("id").agg(F.collect_list("s").alias("s"), F.sum("n").alias("n")).join(own, "id")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = batch.column("s")
                inner = s.flatten()
                head = np.concatenate([[0], np.cumsum(s.value_lengths().to_numpy())])[:-1]
                total = np.add.reduceat(_matrix(inner), head, axis=0)
                new = model.apply(_matrix(batch.column("f")), total, batch.column("n").to_numpy().astype(float), side)
                yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(new)], names=["id", "f"])

    return sums.mapInArrow(apply, "id long, f array<double>")


def _side_step(ratings: DataFrame, own: DataFrame, other: DataFrame, model: Model, mean: float, side: int) -> DataFrame:
    """New factors (id, f) of one side, from ratings (own, other, rating, ...)."""
    return _applied(_parts(ratings, own, other, model, mean, side), own, model, side)


#: Bytes of ratings with factors that are shuffled at once, about; more go in rounds, whose shuffle files are freed.
ROUND = 1 << 30


def _rounds(n: int, width: int) -> int:
    """Rounds for n ratings that carry width numbers through a shuffle."""
    return max(1, -(-n * (8 * width + 40) // ROUND))


def _dealt(rows: DataFrame, key: str, rounds: int, i: int) -> DataFrame:
    """The i-th of the rounds' rows; all rows of a key are in one round."""
    return rows.filter(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(rounds)) == i) if rounds > 1 else rows


def _whole(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.union, parts)


def _side_steps(ratings: DataFrame, own: DataFrame, other: DataFrame, model: Model, mean: float, side: int, rounds: int) -> DataFrame:
    """_side_step in rounds of own ids, written."""
    parts = []
    for i in range(rounds):
        parts.append(cut(_side_step(_dealt(ratings, "own", rounds, i), _dealt(own, "id", rounds, i), other, model, mean, side)))
        if rounds > 1:
            collect(ratings.sparkSession)
    return _whole(parts)


def predicted(fitted: "Fitted", ratings: DataFrame) -> DataFrame:
    """rating, prediction of a table of ratings; of many, in rounds of users, written one after another."""
    n = ratings.count()
    if isinstance(fitted.model, SampledFactors) or isinstance(fitted, FittedTimes) and fitted.near is not None:
        return _predicted_blocks(fitted, ratings, n)
    rounds = _rounds(n, fitted.model.width)
    if rounds == 1:
        return fitted.predict(ratings).select("rating", "prediction")
    parts = []
    for i in range(rounds):
        parts.append(Stored(fitted.predict(_dealt(ratings, "user", rounds, i)).select("rating", "prediction")).df)
        collect(ratings.sparkSession)
    return _whole(parts)


def _predicted_blocks(fitted: "Fitted", ratings: DataFrame, n: int) -> DataFrame:
    """rating, prediction of the ratings that the model was fitted on, by sending factors to blocks of them."""
    sides, model, mean = [fitted.users, fitted.items], fitted.model, fitted.mean
    widths = [(x.select(F.size("f")).first() or [1])[0] for x in sides]
    counts, places = _gridded(ratings, n, widths)
    near = getattr(fitted, "near", None)
    if near is not None:
        ratings = ratings.filter(F.col("time").isin([int(t) for t in near[0]]))
    grid = blocks.Grid(ratings, "user", "item", ["rating"] if near is None else ["rating", "time"], *places)
    packed = [Stored(blocks.factors(x, p)) for x, p in zip(sides, places)]
    rounds, done = _sent_rounds(packed, places, widths, 0, counts), []

    def predict(u, v, rows):
        return model.predict(u, v, rows, mean) if near is None else model.predict_of([u, v, near[1][np.searchsorted(near[0], rows["time"])]], rows, mean)

    for i in range(rounds):
        done.append(Stored(grid.predictions(*(x.df for x in packed), predict, (i, rounds))).df)
        if rounds > 1:
            collect(ratings.sparkSession)
    for x in (*packed, *counts, grid.stored):
        x.drop()
    return _whole(done)


def _sent_rounds(packed: list[Stored], places: list[blocks.Place], widths: list[int], side: int, counts: list[Stored]) -> int:
    """Rounds of home blocks in which both sides' factors go to the grid of one side."""
    n = [c.df.count() for c in counts]
    sent = 8 * (n[1 - side] * widths[1 - side] * places[side].homes + n[side] * widths[side] * places[1 - side].columns)
    return min(places[side].homes, -(-sent // ROUND))


@dataclass
class Fitted:
    model: Model
    users: DataFrame
    items: DataFrame
    mean: float
    #: The validation set's RMSE after each iteration, where there was one.
    history: list[float] = field(default_factory=list)

    def predict(self, ratings: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
        """ratings (user, item, ...) with prediction, clamped; users and items without a factor are dropped."""
        rows = ratings.join(self.users.select(F.col("id").alias("user"), F.col("f").alias("_u")), "user").join(self.items.select(F.col("id").alias("item"), F.col("f").alias("_v")), "item")
        model, mean = self.model, self.mean

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                p = model.predict(np.stack(pdf["_u"]), np.stack(pdf["_v"]), pdf, mean) if len(pdf) else []
                yield pdf.drop(columns=["_u", "_v"]).assign(prediction=np.clip(p, low, high))

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("_u", "_v")) + ", prediction double"
        return rows.mapInPandas(run, schema)


def _moments(side: DataFrame, size: int) -> tuple[int, np.ndarray, np.ndarray, float]:
    """Count, sum and sum of outer products of a side's factors, and the sum of its e; a row of each block comes to the driver."""
    total = np.sum([np.frombuffer(r.note) for r in side.filter("note IS NOT NULL").select("note").collect()], axis=0)
    return int(total[0]), total[2 : 2 + size], total[2 + size :].reshape(size, size), float(total[1])


def _noted(f: np.ndarray, e: float) -> bytes:
    return np.concatenate([[len(f), e], f.sum(axis=0), (f.T @ f).ravel()]).tobytes()


def _draw_step(grid: blocks.Grid, other: DataFrame, model: SampledFactors, alpha: float, prior: tuple, sweep: int, side: int) -> Stored:
    """A draw of one side, and the squared error of its ratings less their squares among what _moments adds up."""
    d = model.size

    def draw(ids, own, total, n):
        a, b = total[:, : d * d].reshape(-1, d, d), total[:, d * d :]
        f = model.draw(ids, a, b, alpha, *prior, sweep, side)
        return f, _noted(f, float((np.einsum("ni,nij,nj->n", f, a, f) - 2 * (f * b).sum(axis=1)).sum()))

    return Stored(blocks.applied(grid.sums(None, other, lambda own, g, rows: model.gather(own, g, rows, 0.0, side)), None, grid.place, draw))


def _kept(draws: list[Stored]) -> DataFrame:
    """id, f of one side: all draws of an id, one after another."""
    n, rows = len(draws), _whole([x.df.withColumn("draw", F.lit(i)) for i, x in enumerate(draws)])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        found = []
        for i in range(n):
            ids, f = blocks.unpacked(table.filter(pa.compute.equal(table.column("draw"), i)))
            order = np.argsort(ids, kind="stable")
            found.append(f[order])
        return pa.table({"id": pa.array(ids[order]), "f": _lists(np.hstack(found))})

    return rows.groupBy("home", "column").applyInArrow(run, "id long, f array<double>")


def _gridded(ratings: DataFrame, n: int, widths: list[int]) -> tuple[list[Stored], list[blocks.Place]]:
    """The ids (id, n) of both sides of ratings, and the places of their blocks."""
    counts = [Stored(ratings.filter("user IS NOT NULL AND item IS NOT NULL").groupBy(F.col(key).cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n"))) for key in ("user", "item")]
    return counts, blocks.places([c.df for c in counts], n, widths, ratings.sparkSession.sparkContext.defaultParallelism)


class _Freed:
    """Lets go of shuffle files whenever steps have sent about half a ROUND of bytes."""

    def __init__(self, spark):
        self.spark, self.sent = spark, 0

    def add(self, sent: int) -> None:
        self.sent += sent
        if self.sent > ROUND // 2:
            collect(self.spark)
            self.sent = 0


def _sampled(ratings: DataFrame, model: SampledFactors, iterations: int) -> Fitted:
    """burn_in sweeps, then as many as iterations, whose draws are kept."""
    stored = Stored(ratings)
    ratings, d, freed = stored.df, model.size, _Freed(stored.spark)
    n, squares, spread = ratings.agg(F.count("rating"), F.sum(F.col("rating").cast("double") * F.col("rating")), F.var_pop("rating")).first()
    alpha = 1 / (spread or 1.0)
    counts, places = _gridded(ratings, n, [d, d])
    grids = [blocks.Grid(ratings, *keys, ["rating"], places[i], places[1 - i]) for i, keys in enumerate((("user", "item"), ("item", "user")))]
    sides = [Stored(_noted_start(c.df, model, p, i)) for i, (c, p) in enumerate(zip(counts, places))]
    ids = [c.df.count() for c in counts]
    for x in (stored, *counts):
        x.drop()
    draws: list[list[Stored]] = [[], []]
    for sweep in range(model.burn_in + iterations):
        rng = np.random.default_rng([model.seed, sweep])
        (*u, _), (*v, e) = (_moments(x.df, d) for x in sides)
        if sweep:
            alpha = rng.chisquare(1 + n) / (1 + max(squares + e, 0.0))
        priors = model.hyper(*u, rng), model.hyper(*v, rng)
        for i in range(2):
            new = _draw_step(grids[i], sides[1 - i].df, model, alpha, priors[i], sweep, i)
            if sides[i] not in draws[i]:
                sides[i].drop()
            sides[i] = new
            if sweep >= model.burn_in:
                draws[i].append(new)
            freed.add(8 * d * (ids[1 - i] * places[i].homes + ids[i] * (d + 1) * places[1 - i].columns))
    users, items = (cut(_kept(kept) if iterations else blocks.listed(last.df)) for kept, last in zip(draws, sides))
    for x in (*draws[0], *draws[1], *(g.stored for g in grids)):
        x.drop()
    return Fitted(model, users, items, 0.0)


def _noted_start(ids: DataFrame, model: SampledFactors, place: blocks.Place, side: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = batch.column("id").to_numpy()
                f = model.start(found, side)
                yield from blocks.packed(place, found, f, _noted(f, 0.0)).to_batches()

    return ids.mapInArrow(run, blocks.PACKED)


KEYS = ("user", "item", "time")


#: Time values that are broadcast.
FEW = 4096


def _with_sides(ratings: DataFrame, sides: list[DataFrame], few: bool = False, last: int = 1) -> DataFrame:
    """ratings with the factors of their user, item and time as _0, _1 and _2; few time values are broadcast.

    The last shuffled join sorts the ratings by the side `last`.
    """
    side = lambda i: sides[i].select(F.col("id").alias(KEYS[i]), F.col("f").alias(f"_{i}"))
    if not few:
        ratings = ratings.join(side(2), "time")
    ratings = ratings.join(side(1 - last), KEYS[1 - last]).join(side(last).hint("merge"), KEYS[last])
    return ratings.join(F.broadcast(side(2)), "time") if few else ratings


@dataclass
class FittedTimes(Fitted):
    times: DataFrame = None  # set by _fit_timed
    few: bool = False
    near: tuple | None = None  # time values in order and their factors, where they went with the blocks

    def predict(self, ratings: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
        """ratings (user, item, time, ...) with prediction, clamped; users, items and times without a factor are dropped."""
        model, mean, rows = self.model, self.mean, _with_sides(ratings, [self.users, self.items, self.times], self.few)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                p = model.predict_of([np.stack(pdf[f"_{i}"]) for i in range(3)], pdf, mean) if len(pdf) else []
                yield pdf.drop(columns=["_0", "_1", "_2"]).assign(prediction=np.clip(p, low, high))[[*columns, "prediction"]]

        columns = [c for c in rows.columns if c not in ("_0", "_1", "_2")]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in columns) + ", prediction double"
        return rows.mapInPandas(run, schema)


def _timed_step(ratings: DataFrame, sides: list[DataFrame], model: Model, mean: float, side: int, few: bool, rounds: int) -> DataFrame:
    """New factors (id, f) of one of the three sides, written; statistics are summed in batches as for two.

    Users and items go in rounds of their own ids, time values in rounds of users whose sums are added at the end.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                f, rows = [_matrix(batch.column(f"_{i}")) for i in range(3)], _scalars(batch)
                if isinstance(model, TimeGradient):
                    s = model.gather_of(f, rows, mean, side)
                else:
                    s = model.gather(f[side], model.join(f[:side] + f[side + 1 :], rows), rows, mean, side)
                yield _summed(batch.column(KEYS[side]).to_numpy().astype(np.int64), s)

    done, key = [], side if side < 2 else 0
    for i in range(rounds):
        near = [_dealt(x, "id", rounds, i) if k == key else x for k, x in enumerate(sides)]
        parts = _with_sides(_dealt(ratings, KEYS[key], rounds, i), near, few, key).mapInArrow(gather, "id long, s array<double>, n long")
        done.append(cut(parts if side == 2 else _applied(parts, near[side], model, side)))
        if rounds > 1:
            collect(ratings.sparkSession)
    return cut(_applied(_whole(done), sides[2], model, 2)) if side == 2 else _whole(done)


def _fit_timed_blocks(ratings: DataFrame, model: TimeGradient, iterations: int, mean: float, n: int, times: np.ndarray) -> FittedTimes:
    """_fit_timed where time values are few: users' and items' factors go to blocks of ratings, time values' with the code."""
    ratings, near = ratings.filter("time IS NOT NULL"), model.start(times, 2)
    widths = [model.start(np.array([0]), i).shape[1] for i in range(2)]
    counts, places = _gridded(ratings, n, widths)
    grids = [blocks.Grid(ratings, *keys, ["rating", "time"], places[i], places[1 - i]) for i, keys in enumerate((("user", "item"), ("item", "user")))]
    sides = [Stored(blocks.factors(_start(c.df.select("id"), model, i), p)) for i, (c, p) in enumerate(zip(counts, places))]
    rounds = [_sent_rounds(sides, places, widths, i, counts) for i in range(2)]
    collect(ratings.sparkSession)
    for _ in range(iterations):
        for i in range(3):
            of, at = i % 2, near

            def gather(own, other, rows):
                f = [own, other] if of == 0 else [other, own]
                return model.gather_of([*f, at[np.searchsorted(times, rows["time"])]], rows, mean, i)

            parts = []
            for r in range(rounds[of]):
                parts.append(Stored(grids[of].sums(sides[of].df, sides[1 - of].df, gather, "time" if i == 2 else None, (r, rounds[of]))))
                collect(ratings.sparkSession)
            found = _whole([x.df for x in parts])
            if i == 2:
                total, size = 0.0, 0
                for row in found.toLocalIterator():
                    ids = np.searchsorted(times, np.frombuffer(row.ids, np.int64))
                    s, k = np.zeros((len(times), near.shape[1])), np.zeros(len(times))
                    s[ids], k[ids] = np.frombuffer(row.s).reshape(len(ids), -1), np.frombuffer(row.n, np.int64)
                    total, size = total + s, size + k
                near = model.apply(near, total, size, 2)
            else:
                new = Stored(blocks.applied(found, sides[of].df, places[of], lambda ids, own, s, k: (model.apply(own, s, k.astype(float), i), None)))
                sides[of].drop()
                sides[of] = new
                collect(ratings.sparkSession)
            for x in parts:
                x.drop()
    for x in (*counts, *(g.stored for g in grids)):
        x.drop()
    rows = ratings.sparkSession.createDataFrame([(int(t), f.tolist()) for t, f in zip(times, near)], "id long, f array<double>")
    return FittedTimes(model, *(blocks.listed(x.df) for x in sides), mean, [], rows, True, (times, near))


def _fit_timed(ratings: DataFrame, model: Model, iterations: int) -> FittedTimes:
    """Steps of users, items and time values in turn."""
    kept = Stored(ratings)
    ratings = kept.df
    mean, n = ratings.agg(F.avg("rating"), F.count(F.lit(1))).first()
    mean = float(mean or 0.0)
    if isinstance(model, TimeGradient):
        times = [r.id for r in ratings.select(F.col("time").cast("long").alias("id")).filter("id IS NOT NULL").distinct().limit(FEW + 1).collect()]
        if 0 < len(times) <= FEW and all(abs(t) < 1 << 53 for t in times):
            done = _fit_timed_blocks(ratings, model, iterations, mean, n, np.array(sorted(times), np.int64))
            kept.drop()
            return done
    sides = [cut(_start(ratings.select(F.col(key).alias("id")).filter("id IS NOT NULL").distinct(), model, i)) for i, key in enumerate(KEYS)]
    few = sides[2].count() <= FEW
    for _ in range(iterations):
        for i in range(3):
            sides[i] = _timed_step(ratings, sides, model, mean, i, few, _rounds(n, model.width))
    kept.drop()
    return FittedTimes(model, sides[0], sides[1], mean, [], sides[2], few)


def _rmse(fitted: Fitted, rows: DataFrame) -> float:
    e = F.col("rating") - F.col("prediction")
    return fitted.predict(rows).agg(F.sqrt(F.avg(e * e))).first()[0] or 0.0


def fit(ratings: DataFrame, model: Model, iterations: int = 4, validation: DataFrame | None = None, halt: bool = True) -> Fitted:
    """Alternates steps of users and items over ratings (user, item, rating, and weight or time if the model needs them).

    Of SampledFactors, iterations are those averaged, after the burn-in. With
    a validation set, its RMSE is taken after each iteration (of two-sided
    models); with halt, training ends when it rises, and the factors from
    before are kept. Nonnegative refuses negative ratings.
    """
    ratings.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    if isinstance(model, (TensorLeastSquares, TimeGradient)):
        return _fit_timed(ratings, model, iterations)
    if isinstance(model, SampledFactors):
        return _sampled(ratings, model, iterations)
    kept = Stored(ratings)
    ratings = kept.df
    collect(ratings.sparkSession)
    mean, least, n = ratings.agg(F.avg("rating"), F.min("rating"), F.count(F.lit(1))).first()
    rounds = _rounds(n, model.width)
    if isinstance(model, Nonnegative) and least is not None and least < 0:
        raise ValueError("nonnegative factors need ratings of 0 or more")
    users = cut(_start(ratings.select(F.col("user").alias("id")).distinct(), model, 0))
    items = cut(_start(ratings.select(F.col("item").alias("id")).distinct(), model, 1))
    done = Fitted(model, users, items, float(mean or 0.0))
    for i in range(iterations):
        now = copy.copy(model)
        now.rate = model.rate * model.decay**i
        users = _side_steps(ratings.withColumnsRenamed({"user": "own", "item": "other"}), done.users, done.items, now, done.mean, 0, rounds)
        items = _side_steps(ratings.withColumnsRenamed({"item": "own", "user": "other"}), done.items, users, now, done.mean, 1, rounds)
        new = Fitted(model, users, items, done.mean, done.history)
        if validation is not None:
            new.history.append(_rmse(new, validation))
            if halt and len(new.history) > 1 and new.history[-1] > new.history[-2]:
                break
        done = new
    kept.drop()
    return done


#: Relevant items in one part of a user, about; a user with n of them costs (n / PART)^2 rows.
PART = 256


def _rank_terms(relevant: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """user, item, relevant, slope, gain of relevant (user, item, relevant): c_j and the objective's terms of j.

    A user's items are dealt in parts of about PART, and each pair of parts is one row, so no task holds all pairs of a
    user.
    """
    score = F.aggregate(F.zip_with("f", "g", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rows = relevant.join(users.withColumnRenamed("id", "user"), "user").join(items.select(F.col("id").alias("item"), F.col("f").alias("g")), "item")
    rows = rows.select("user", "item", "relevant", score.alias("score"), F.ceil(F.col("relevant") / PART).alias("parts"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts")))
    blocks = cut(rows.groupBy("user", "part").agg(F.first("relevant").alias("relevant"), F.first("parts").alias("parts"), F.collect_list(F.struct("item", "score")).alias("j")))
    left = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts").withColumn("first", F.col("part") == 0)
    pairs = left.join(blocks.select("user", "part", F.col("j.score").alias("k")), ["user", "part"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                f = np.array([x["score"] for x in row.j])
                apart = f[:, None] - np.asarray(row.k)[None]
                slope, gain = -np.tanh(apart / 2).sum(axis=1), -np.logaddexp(0, -apart).sum(axis=1)
                if row.first:
                    slope, gain = slope + _logistic(-f), gain - np.logaddexp(0, -f)
                yield pd.DataFrame({"user": row.user, "item": [x["item"] for x in row.j], "relevant": row.relevant, "slope": slope, "gain": gain})

    terms = pairs.select("user", "relevant", "j", "k", "first").mapInPandas(run, "user long, item long, relevant long, slope double, gain double")
    return terms.groupBy("user", "item").agg(F.first("relevant").alias("relevant"), F.sum("slope").alias("slope"), F.sum("gain").alias("gain"))


def rank_rows(ratings: DataFrame, threshold: float) -> DataFrame:
    """user, item, relevant: each relevant pair once, of users with 2 at least, and the user's number of them."""
    pairs = ratings.filter(F.col("rating") >= threshold).select(F.col("user").cast("long").alias("user"), F.col("item").cast("long").alias("item")).distinct()
    return pairs.join(pairs.groupBy("user").agg(F.count(F.lit(1)).alias("relevant")).filter("relevant > 1"), "user")


def rank_objective(fitted: Fitted, relevant: DataFrame) -> float:
    """The smoothed reciprocal rank that RankGradient ascends, over trained users and all items."""
    square = F.aggregate("f", F.lit(0.0), lambda s, x: s + x * x)
    trained = fitted.users.join(relevant.select(F.col("user").alias("id")).distinct(), "id", "left_semi")
    squares = trained.union(fitted.items).agg(F.sum(square)).first()[0] or 0.0
    return (_rank_terms(relevant, fitted.users, fitted.items).agg(F.sum("gain")).first()[0] or 0.0) - fitted.model.regularization / 2 * squares


def fit_rank(ratings: DataFrame, model: RankGradient, iterations: int = 4) -> tuple[Fitted, DataFrame]:
    """The model fitted to ratings (user, item, rating), and the relevant rows it was trained on."""
    ratings = cut(ratings)
    relevant = cut(rank_rows(ratings, model.threshold))
    users = cut(_start(ratings.select(F.col("user").alias("id")).distinct(), model, 0))
    items = cut(_start(ratings.select(F.col("item").alias("id")).distinct(), model, 1))

    def stepped(own: DataFrame, other: DataFrame, names: dict[str, str], side: int) -> DataFrame:
        pair = (own, other) if side == 0 else (other, own)
        new = _side_step(_rank_terms(relevant, *pair).withColumnsRenamed(names), own, other, model, 0.0, side)
        return cut(own.join(new.select("id", F.col("f").alias("new")), "id", "left").select("id", F.coalesce("new", "f").alias("f")))

    for _ in range(iterations):
        users = stepped(users, items, {"user": "own", "item": "other"}, 0)
        items = stepped(items, users, {"item": "own", "user": "other"}, 1)
    return Fitted(model, users, items, 0.0), relevant


#: top_items: users of a block, items of a cell and of a chunk of cells, about; blocks and cells at most; items probed for a direction.
BLOCK, CELL, CHUNK, MOST, PROBES = 16384, 512, 1 << 18, 4096, 64


@dataclass
class _Tree:
    """2^depth leaves of points: a sample is halved again and again along the axis of its largest weighted spread."""

    axis: np.ndarray
    at: np.ndarray
    depth: int

    @classmethod
    def of(cls, points: np.ndarray, weight: np.ndarray, depth: int) -> "_Tree":
        axis, at, level = np.zeros(2**depth, int), np.zeros(2**depth), [points]
        for d in range(depth):
            halves = []
            for i, x in enumerate(level):
                node = 2**d - 1 + i
                if len(x):
                    axis[node] = np.argmax(x.std(axis=0) * weight)
                    at[node] = np.median(x[:, axis[node]])
                right = x[:, axis[node]] > at[node]
                halves += [x[~right], x[right]]
            level = halves
        return cls(axis, at, depth)

    def find(self, points: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Each point's leaf; points on a border are dealt to both sides by their ids, so equal points fill no leaf."""
        node, each = np.zeros(len(points), int), np.arange(len(points))
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        for d in range(self.depth):
            x, at = points[each, self.axis[node]], self.at[node]
            node = 2 * node + 1 + ((x > at) | ((x == at) & ((mixed >> np.uint64(d)) & np.uint64(1) == 1)))
        return node - (2**self.depth - 1)


def _some(side: DataFrame, rows: int, n: int) -> np.ndarray:
    """The factors of about so many of a side's n ids, chosen by a hash."""
    unit = 1 << 40
    table = side.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(unit)) < min(unit, unit * rows // n)).select("f").toArrow()
    return _matrix(table.column("f").combine_chunks()) if table.num_rows else _matrix(side.limit(1).toArrow().column("f").combine_chunks())


def _first(ids: np.ndarray, items: np.ndarray, scores: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Places of the most[i] best entries of each user i (an index), by score and then the smaller item."""
    order = np.lexsort((items, -scores, ids))
    head = np.flatnonzero(np.append(True, ids[order][1:] != ids[order][:-1])) if len(order) else np.empty(0, int)
    rank = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
    return order[rank < most[ids[order]]]


def top_items(fitted: Fitted, ratings: DataFrame, k: int) -> DataFrame:
    """user, item, score, rank: the k best items that a user hasn't rated, by the model's own prediction, biases and all.

    The result is that of comparing all pairs, but a pair is only scored where
    it may matter. Users and items are dealt to blocks and cells by trees over
    their factors (grown from a bounded sample; every row is dealt). The best
    items in each direction are probed first, which gives each user a score
    that k unrated items reach. A cell goes to a block of users only if the
    largest product with its box can reach that of one of them, and within the
    block is scored for such users only. Of models without such bounds every
    pair is scored. Rated items are taken out at the end, so each user keeps as
    many more candidates as they have ratings.
    """
    model, mean = fitted.model, fitted.mean
    if isinstance(model, TimeGradient):
        model.scores(None, None, mean)
    spark = ratings.sparkSession
    none = spark.createDataFrame([], "user long, item long, score double, rank int")
    kept = Stored(ratings.select(F.col("user").cast("long").alias("user"), F.col("item").cast("long").alias("item")).distinct())
    n_users, n_items = fitted.users.count(), fitted.items.count()
    if not n_users or not n_items:
        return none
    deep = lambda n, each: int(np.ceil(np.log2(min(MOST, max(1, n / each)))))
    users_depth, cells_depth = deep(n_users, BLOCK), deep(n_items, CELL)
    blocks, cells, chunks = 2**users_depth, 2**cells_depth, max(1, -(-n_items // CHUNK))
    x, y = model.place(_some(fitted.users, 16 * blocks + 256, n_users), 0), model.place(_some(fitted.items, 16 * cells, n_items), 1)
    spread, turn = np.linalg.eigh(x.T @ x / len(x))
    flat = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    by_user = _Tree.of(flat(x) @ turn, (y @ turn).std(axis=0), users_depth)
    by_item = _Tree.of(y @ turn, np.sqrt(np.maximum(spread, 0)), cells_depth)
    group = lambda block: block * min(256, blocks) // blocks
    groups = group(by_user.find(flat(x) @ turn, np.arange(len(x))))
    ways = np.stack([flat(x)[groups == g].mean(axis=0) if (groups == g).any() else flat(x).mean(axis=0) for g in range(min(256, blocks))])
    probes = max(PROBES, 4 * k)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                turned = model.place(_matrix(batch.column("f")), 1) @ turn
                cell = by_item.find(turned, batch.column("id").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *(batch.column(c) for c in ("id", "f")), _lists(turned)], names=["cell", "id", "f", "y"])

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = model.place(_matrix(batch.column("f")), 1) @ ways.T
                at = np.argsort(-s, axis=0, kind="stable")[:probes] if len(s) <= probes else np.argpartition(-s, probes, axis=0)[:probes]
                way = np.broadcast_to(np.arange(len(ways)), at.shape).ravel()
                picked = batch.take(pa.array(at.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(way.astype(np.int32)), picked.column("id"), picked.column("f"), pa.array(s[at.ravel(), way])], names=["way", "id", "f", "s"])

    from .etl import top_per_key

    placed = fitted.items.mapInArrow(dealt, "cell int, id long, f array<double>, y array<double>")
    width = len(turn)
    boxes = placed.groupBy("cell").agg(F.array(*[F.min(F.col("y")[i]) for i in range(width)]).alias("low"), F.array(*[F.max(F.col("y")[i]) for i in range(width)]).alias("high")).toArrow()
    low, high = np.full((cells, width), np.nan), np.full((cells, width), np.nan)
    used = boxes.column("cell").to_numpy()
    low[used], high[used] = (_matrix(boxes.column(c).combine_chunks()) for c in ("low", "high"))
    filled = np.sort(used)
    low, high = low[filled], high[filled]
    best = top_per_key(fitted.items.mapInArrow(ahead, "way int, id long, f array<double>, s double"), "way", probes, [F.desc("s"), "id"]).toArrow()
    best_way, best_id, best_f = best.column("way").to_numpy(), best.column("id").to_numpy(), _matrix(best.column("f").combine_chunks())
    probed = [(best_id[best_way == g], best_f[best_way == g]) for g in range(len(ways))]

    ids = spark.createDataFrame([(int(i),) for i in np.unique(best_id)], "item long")
    known = kept.df.join(F.broadcast(ids), "item").groupBy("user").agg(F.collect_set("item").alias("known"))
    n = kept.df.groupBy("user").agg(F.count(F.lit(1)).alias("n"))
    facts = fitted.users.join(n.withColumnRenamed("user", "id"), "id", "left").join(known.withColumnRenamed("user", "id"), "id", "left").select("id", "f", F.coalesce("n", F.lit(0)).alias("n"), "known")

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """a (the block) and least: a score that k unrated items reach, a little less for rounding."""
        for batch in batches:
            if batch.num_rows:
                f, rated = _matrix(batch.column("f")), batch.column("known").to_pylist()
                a = by_user.find(flat(model.place(f, 0)) @ turn, batch.column("id").to_numpy())
                least = np.full(len(f), -np.inf)
                for g in np.unique(group(a)):
                    at, (items, vectors) = np.flatnonzero(group(a) == g), probed[g]
                    if len(items) >= k:
                        s = model.scores(f[at], vectors, mean)
                        for j, i in enumerate(at):
                            if rated[i]:
                                s[j, np.isin(items, rated[i])] = -np.inf
                        least[at] = np.partition(s, len(items) - k, axis=1)[:, len(items) - k]
                least = np.where(np.isfinite(least), least - 1e-9 * (1 + np.abs(least)), -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), batch.column("id"), batch.column("f"), batch.column("n"), pa.array(least)], names=["a", "id", "f", "n", "least"])

    users = cut(facts.mapInArrow(reached, "a int, id long, f array<double>, n long, least double"))

    def largest(f: np.ndarray, cell: np.ndarray | slice) -> np.ndarray:
        """The largest score of each user in each of the cells (places in filled), and a little more for rounding."""
        x = model.place(f, 0) @ turn
        up = np.maximum(x, 0) @ high[cell].T + np.minimum(x, 0) @ low[cell].T
        up += 1e-9 * (1 + np.abs(x) @ np.maximum(np.abs(low[cell]), np.abs(high[cell])).T)
        most = model.bounds(f, up, mean)
        most[np.isnan(most)] = np.inf
        return most

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros((blocks, len(filled)), bool)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                hit = largest(_matrix(part.column("f")), slice(None)) >= part.column("least").to_numpy()[:, None]
                a = part.column("a").to_numpy()
                order = np.argsort(a, kind="stable")
                head = np.flatnonzero(np.append(True, np.diff(a[order]) != 0))
                met[a[order][head]] |= np.logical_or.reduceat(hit[order], head, axis=0)
        a, cell = np.nonzero(met)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(filled[cell].astype(np.int32))], names=["a", "cell"])

    pairs = cut(users.mapInArrow(wanted, "a int, cell int").distinct())
    chunk = (F.col("cell").cast("long") * chunks / cells).cast("int").alias("b")

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks().sort_by("id"), right.combine_chunks().sort_by([("cell", "ascending"), ("id", "ascending")])
        empty = pa.table({"user": pa.array([], pa.int64()), "item": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        f, g = (_matrix(x.column("f").combine_chunks()) for x in (left, right))
        ids, items, cell = left.column("id").to_numpy(), right.column("id").to_numpy(), right.column("cell").to_numpy()
        least, most = left.column("least").to_numpy().copy(), k + left.column("n").to_numpy()
        found, size = [], 0

        def trimmed() -> list[tuple]:
            u, i, s = (np.concatenate(x) for x in zip(*found))
            at = _first(u, items[i], s, most)
            u, i, s = u[at], i[at], s[at]
            full = np.flatnonzero(np.bincount(u, minlength=len(ids)) >= most)
            last = np.full(len(ids), np.inf)
            np.minimum.at(last, u, s)
            least[full] = np.maximum(least[full], last[full] - 1e-9 * (1 + np.abs(last[full])))
            return [(u, i, s)]

        head = np.flatnonzero(np.append(True, np.diff(cell) != 0))
        for start, end in zip(head, np.append(head[1:], len(cell))):
            there = np.flatnonzero(largest(f, np.searchsorted(filled, cell[start : start + 1]))[:, 0] >= least)
            for some in np.array_split(there, -(-len(there) // 4096)) if len(there) else []:
                for first in range(start, end, 1024):
                    u, i = np.nonzero(model.scores(f[some], g[first : min(end, first + 1024)], mean) >= least[some][:, None])
                    if len(u):
                        u, i = some[u], i + first
                        found.append((u, i, model.predict(f[u], g[i], None, mean)))
                        size += len(u)
                        if size > 1 << 22:
                            found = trimmed()
                            size = 0
        if not found:
            return empty
        u, i, s = trimmed()[0]
        return pa.table({"user": ids[u], "item": items[i], "score": s})

    left = users.join(pairs.select("a", chunk).distinct(), "a")
    right = placed.drop("y").join(pairs, "cell").select("a", chunk, "cell", "id", "f")
    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(scored, "user long, item long, score double")
    result = cut(top_per_key(found.join(kept.df, ["user", "item"], "left_anti"), "user", k, [F.desc("score"), "item"]))
    kept.drop()
    return result


def _product(entries: DataFrame, base: DataFrame, key: str, to: str, width: int) -> DataFrame:
    """The matrix (r, c, v), or its transpose, times the columns of base (id, f): a join and sums."""
    hit = entries.join(base.withColumnRenamed("id", key), key)
    return hit.groupBy(F.col(to).alias("id")).agg(F.array(*[F.sum(F.col("v") * F.col("f")[i]) for i in range(width)]).alias("f"))


def _gram(base: DataFrame, width: int) -> np.ndarray:
    """Inner products of the columns of base; width^2 numbers come to the driver."""
    cells = [F.sum(F.col("f")[i] * F.col("f")[j]) for i in range(width) for j in range(i, width)]
    g = np.zeros((width, width))
    g[np.triu_indices(width)] = [x or 0.0 for x in base.agg(*cells).first()]
    return g + np.triu(g, 1).T


def _times(base: DataFrame, m: np.ndarray) -> DataFrame:
    """The columns of base times a small matrix."""
    columns = [sum((F.col("f")[i] * float(m[i, j]) for i in range(m.shape[0])), F.lit(0.0)) for j in range(m.shape[1])]
    return base.select("id", F.array(*columns).alias("f"))


@dataclass
class Decomposition:
    """values, and the vectors as (id, f) of rows and columns; errors: |A v - value * u| for each value."""

    values: np.ndarray
    left: DataFrame
    right: DataFrame
    errors: np.ndarray


class _Base(Model):
    @property
    def width(self):
        return self.size


def svd(entries: DataFrame, k: int, extra: int = 6, iterations: int = 6, tolerance: float = 1e-10, seed: int = 3) -> Decomposition:
    """The k largest singular values and vectors of a sparse matrix (user, item, rating), by block iteration.

    The matrix is only multiplied; the bases of k + extra columns are made
    orthogonal by their inner products, which are all that comes to the
    driver. Only one base is kept from step to step (the other follows from
    it). Ends when the values no longer change by more than a tolerance.
    """
    width = k + extra
    a = cut(entries.select(F.col("user").alias("r"), F.col("item").alias("c"), F.col("rating").cast("double").alias("v")))
    right = _start(a.select(F.col("c").alias("id")).distinct(), _Base(size=width, seed=seed), 1)
    values = np.zeros(width)
    for _ in range(iterations):
        right = cut(right)
        w, u = np.linalg.eigh(_gram(right, width))
        right = cut(_times(right, u / np.sqrt(np.maximum(w, 1e-12 * w.max()))))
        left = cut(_product(a, right, "c", "r", width))
        square, turn = np.linalg.eigh(_gram(left, width))
        before, values = values, np.sqrt(np.maximum(square[::-1], 0))
        if np.abs(values[:k] - before[:k]).max() <= tolerance * values[0]:
            break
        right, last = _product(a, left, "r", "c", width), right
        last = (last, left, turn)
    else:
        right, left, turn = last
    turn = turn[:, ::-1][:, :k]
    scale = 1 / np.maximum(values[:k], 1e-300)
    vectors = cut(_times(right, turn))
    rows = cut(_times(left, turn * scale))
    image = _product(a, vectors, "c", "r", k).join(rows.withColumnRenamed("f", "u"), "id")
    apart = [F.sqrt(F.sum(F.pow(F.col("f")[i] - F.col("u")[i] * float(values[i]), F.lit(2)))) for i in range(k)]
    return Decomposition(values[:k], rows, vectors, np.array(image.agg(*apart).first(), float))


def svd_one_sided(entries: DataFrame, k: int, extra: int = 6, iterations: int = 6, seed: int = 3) -> Decomposition:
    """The same for tall matrices: the long side's vectors are never stored between steps, only made at the end.

    Each step multiplies by the matrix and its transpose at once, and only the short side is made orthogonal.
    """
    width = k + extra
    a = cut(entries.select(F.col("user").alias("r"), F.col("item").alias("c"), F.col("rating").cast("double").alias("v")))
    right = _start(a.select(F.col("c").alias("id")).distinct(), _Base(size=width, seed=seed), 1)
    for _ in range(iterations):
        right = cut(right)
        w, u = np.linalg.eigh(_gram(right, width))
        right = _times(right, u / np.sqrt(np.maximum(w, 1e-12 * w.max())))
        right = _product(a, _product(a, right, "c", "r", width), "r", "c", width)
    right = cut(right)
    w, u = np.linalg.eigh(_gram(right, width))
    right = cut(_times(right, u / np.sqrt(np.maximum(w, 1e-12 * w.max()))))
    square, turn = np.linalg.eigh(_gram(_product(a, right, "c", "r", width), width))
    values = np.sqrt(np.maximum(square[::-1][:k], 0))
    vectors = cut(_times(right, turn[:, ::-1][:, :k]))
    rows = _times(_product(a, vectors, "c", "r", k), np.diag(1 / np.maximum(values, 1e-300)))
    image = _product(a, rows, "r", "c", k).join(vectors.withColumnRenamed("f", "u"), "id")
    apart = [F.sqrt(F.sum(F.pow(F.col("f")[i] - F.col("u")[i] * float(values[i]), F.lit(2)))) for i in range(k)]
    return Decomposition(values, rows, vectors, np.array(image.agg(*apart).first(), float))


def multiply(entries: DataFrame, x: DataFrame, y: DataFrame | None = None, c: float = 1.0, d: float = 0.0, div: float = 1.0, transpose: bool = False) -> DataFrame:
    """id, f: (c * A x + d * y) / div of a sparse matrix (user, item, rating) and vectors (id, f); missing entries are 0."""
    key, to = ("user", "item") if transpose else ("item", "user")
    image = entries.join(x.select(F.col("id").alias(key), "f"), key).groupBy(F.col(to).alias("id")).agg(F.sum(F.col("rating") * F.col("f")).alias("_ax"))
    if y is None:
        return image.select("id", (c * F.col("_ax") / div).alias("f"))
    both = image.join(y.select("id", F.col("f").alias("_y")), "id", "full")
    return both.select("id", ((c * F.coalesce("_ax", F.lit(0.0)) + d * F.coalesce("_y", F.lit(0.0))) / div).alias("f"))
