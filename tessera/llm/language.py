"""Language identification by error-correcting output codes.

Every learned language gets a codeword; for each bit a binary classifier on
hashed byte trigrams is fitted. A text's bits are decoded to the language
with the least loss, each bit weighted by how well it was learned; a small
lead over the next language flags the text as ambiguous.

The classifiers are fitted by one task on a bounded sample. Prediction is one
pass over whole texts without a shuffle.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, held_out, joined, record, release, sample_by_class, session, slices, table

FEATURES = 4096
#: Training texts of each language, at most about.
PER_LANGUAGE = 1000
#: Training texts of all languages, about: where there are more than 20, each has fewer, but LEAST at least (or all it has).
MOST_ROWS, LEAST = 20_000, 20
#: A lead of the best over the next loss below this share of the bits' weight flags a text.
LEAD = 0.02

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"

_letter = regex.compile(r"\p{L}")
# A-Z to a-z, other ASCII to a space: only letters and word ends count
_fold = np.arange(256, dtype=np.uint8)
_fold[:128] = 32
_fold[97:123] = _fold[65:91] = np.arange(97, 123, dtype=np.uint8)


def trigrams(data: np.ndarray, bounds: np.ndarray, features: int = FEATURES) -> np.ndarray:
    """A row of hashed trigram weights for each document: square roots of shares, so of length 1."""
    n = len(bounds) - 1
    x = _fold[data].astype(np.uint32)
    counts = np.zeros((n, features), np.float32)
    if len(x) >= 3:
        code = ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)) >> np.uint32(32 - int(features).bit_length() + 1)
        doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(bounds))[: len(code)]
        inside = np.arange(2, len(x)) < bounds[doc + 1]
        inside &= (x[:-2] + x[1:-1] + x[2:]) != 96
        counts = np.bincount(doc[inside] * features + code[inside], minlength=n * features).reshape(n, features).astype(np.float32)
    total = counts.sum(axis=1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1))


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of +1 and -1 in which any two rows differ in many places.

    Up to 6 languages: every way to split them in two (exhaustive code);
    beyond: random splits, 20 for each doubling of the number of languages.
    """
    if n < 2:
        return np.ones((n, 1))
    if n <= 6:
        rest = np.array(list(itertools.product([-1, 1], repeat=n - 1))[:-1]).T
        return np.vstack([np.ones((1, rest.shape[1])), rest])
    rng = np.random.default_rng(seed)
    while True:
        code = rng.choice([-1.0, 1.0], (n, 20 * int(np.ceil(np.log2(n)))))
        if len(np.unique(code, axis=0)) == n and (abs(code.sum(axis=0)) < n).all():
            return code


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    bit_weight: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of every codeword for every row; the weights sum to 1."""
        margin = 4 * (x @ self.weights + self.bias)
        plus = np.logaddexp(0, -margin) * self.bit_weight  # of a bit +1; that of -1 is more by the margin
        return plus.sum(axis=1, keepdims=True) + (margin * self.bit_weight) @ ((1 - self.code) / 2).T

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, a score in 0..1, and whether another is about as near."""
        loss = self.losses(x)
        best = loss.argmin(axis=1)
        share = np.exp(-8 * (loss - loss.min(axis=1, keepdims=True)))
        score = 1 / share.sum(axis=1)
        if loss.shape[1] < 2:
            return best, score, np.zeros(len(best), bool)
        two = np.partition(loss, 1, axis=1)
        return best, score, two[:, 1] - two[:, 0] < LEAD


def fit(x: np.ndarray, labels: np.ndarray, languages: list[str], ridge: float = 0.3, steps: int = 300, enough: float = 1e-5) -> LanguageModel:
    """Regularized least squares for every bit, by conjugate gradients: besides x only vectors are held. x is centred in place."""
    code = codewords(len(languages))
    y = code[labels]
    mean, bias = x.mean(axis=0, dtype=np.float64), y.mean(axis=0)
    x -= mean.astype(x.dtype)
    target = (y - bias).astype(np.float32)
    weights = np.zeros((x.shape[1], y.shape[1]), np.float32)
    rest = x.T @ target
    move, left = rest.copy(), (rest.astype(np.float64) ** 2).sum(axis=0)
    goal = enough**2 * np.maximum(left, 1e-30)
    for _ in range(steps):
        if (left <= goal).all():
            break
        image = x.T @ (x @ move) + np.float32(ridge) * move
        rate = left / np.maximum((move.astype(np.float64) * image).sum(axis=0), 1e-30)
        weights += (move * rate).astype(np.float32)
        rest -= (image * rate).astype(np.float32)
        before, left = left, (rest.astype(np.float64) ** 2).sum(axis=0)
        move = rest + (move * (left / np.maximum(before, 1e-30))).astype(np.float32)
    hinge = np.clip(1 - y * (x @ weights + bias), 0, 2).mean(axis=0)
    bit = np.maximum(1e-3, 1 - hinge)
    return LanguageModel(languages, code, weights, bias - mean @ weights, bit / bit.sum())


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, features: int = FEATURES) -> LanguageModel | None:
    """Fits on a sample of docs (doc_id, text, lang); None if no row has both a text and a language.

    Every language that occurs is learned. Each is thinned by a hash of
    doc_id to about per_language rows on the executors, or fewer where all
    would be over MOST_ROWS; one task fits, and only the weights come to the
    driver.
    """
    known = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    n = known.select("lang").distinct().count()
    thin = sample_by_class(known, "lang", "doc_id", min(per_language, max(LEAST, MOST_ROWS // max(n, 1)))).select("text", "lang").repartition(1)

    def fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, names = [], []
        for batch in slices(batches):
            x.append(trigrams(*joined(batch.column("text")), features))
            names += batch.column("lang").to_pylist()
        if names:
            languages = sorted(set(names))
            index = {k: i for i, k in enumerate(languages)}
            table_ = np.concatenate(x)
            x.clear()
            m = fit(table_, np.array([index[n] for n in names]), languages)
            del table_
            release()
            yield record(
                languages=pa.array([languages]), weights=pa.array([m.weights.tobytes()]), bias=pa.array([m.bias.tobytes()]), bit=pa.array([m.bit_weight.tobytes()])
            )

    got = thin.mapInArrow(fit_task, "languages array<string>, weights binary, bias binary, bit binary").collect()
    if not got:
        return None
    names = list(got[0].languages)
    bias = np.frombuffer(got[0].bias, np.float64)
    weights = np.frombuffer(got[0].weights, np.float32).reshape(-1, len(bias))
    return LanguageModel(names, codewords(len(names)), weights, bias, np.frombuffer(got[0].bit, np.float64))


def identify(docs: DataFrame, model: LanguageModel | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, ambiguous.

    A null text and one without a letter are `und` with score 0, as is every
    text if there is no model. Only the text decides; doc_id only tells
    whether the row was held out. Repeated rows get equal answers. Other
    columns of docs are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=BATCH_BYTES // 4):
            texts = batch.column("text")
            readable = np.array([bool(t and _letter.search(t)) for t in texts.to_pylist()]) & (model is not None)
            if model is None:
                name, score, close = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts), bool)
            else:
                best, score, close = model.decode(trigrams(*joined(texts), len(model.weights)))
                name = np.where(readable, np.array(model.languages, object)[best], "und")
                score = np.where(readable, score, 0.0)
            yield record(
                doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), lang_pred=pa.array(name, pa.string()), score=score, ambiguous=close & readable
            )

    session(docs)
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return picked.mapInArrow(rows, SCHEMA)


def keep_identified(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The rows of docs (with text) whose language is clear, unchanged; without a model, all with a letter.

    Null texts, texts without a letter and ambiguous ones go.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=BATCH_BYTES // 4):
            texts = batch.column("text")
            keep = np.array([bool(t and _letter.search(t)) for t in texts.to_pylist()])
            if model is not None:
                keep &= ~model.decode(trigrams(*joined(texts), len(model.weights)))[2]
            yield batch.filter(pa.array(keep))

    session(docs)
    return docs.mapInArrow(rows, docs.schema)


def language_id(docs: DataFrame) -> DataFrame:
    """Learns from docs' own lang where it isn't held out, then predicts for every row."""
    session(docs)
    learn = docs.filter(~held_out(F.col("doc_id")))
    return identify(docs, train(learn))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
