"""Toxicity by multiple-instance learning: sentences scored, documents labelled.

A document is toxic if at least one of its sentences is: its probability is
the noisy-or of its sentences' probabilities. The sentence model (logistic,
on words and parts of words) is trained from document labels through that noisy-or, and then
tells which sentences offend. The fit runs in one task on a bounded sample;
scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import held_out, joined, record, release, sample_by_class, session, slices, table

#: Training documents of each label, at most about; the fit's only bound.
PER_LABEL = 3000
VOCABULARY = 60_000
#: Besides whole words, runs of so many bytes within words are features.
GRAM = 6
THRESHOLD = 0.3
SENTENCE_THRESHOLD = 0.3

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_sentences long, offending array<struct<start:long,end:long,score:double>>"

# words are runs of ASCII letters, digits and non-ASCII bytes
_gap = np.ones(256, bool)
_gap[128:] = False
_gap[48:58] = _gap[65:91] = _gap[97:123] = False
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_stop = np.zeros(256, bool)
_stop[list(b".!?\n")] = True


def sentences(data: np.ndarray, bounds: np.ndarray):
    """Words and sentences of documents joined in one buffer.

    Returns the hashes of the features (words, and GRAM bytes within longer
    words), the number of each one's sentence, and for every sentence its
    document and its bytes [start, end). Sentences end after . ! ? or a line
    end, and at a document's end.
    """
    data = _lower[data]
    n = len(data)
    gap = _gap[data]
    begin, stop = ~gap, ~gap
    begin[1:] &= gap[:-1]
    stop[:-1] &= gap[1:]
    edge = bounds[(bounds > 0) & (bounds < n)]
    begin[edge] = ~gap[edge]
    stop[edge - 1] = ~gap[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    cut = np.unique(np.concatenate([bounds, np.flatnonzero(_stop[data]) + 1]))
    pre = K.prefix(K.BYTE_VALUE[data])
    filled = np.zeros(n + 1, np.int32)
    np.cumsum(gap, out=filled[1:])
    inner = np.flatnonzero(filled[GRAM:] == filled[:-GRAM]) if n > GRAM else np.empty(0, np.int64)
    crossing = np.searchsorted(bounds, inner, side="right") != np.searchsorted(bounds, inner + GRAM - 1, side="right")
    inner = inner[~crossing]
    hashes = np.concatenate([K.span_hash(pre, starts, ends), K.span_hash(pre, inner, inner + GRAM) ^ np.uint64(1)])
    of = np.searchsorted(cut, np.concatenate([starts, inner]), side="right") - 1
    doc = np.searchsorted(bounds, cut[:-1], side="right") - 1
    return hashes, of, doc, cut[:-1], cut[1:]


@dataclass
class ToxicityModel:
    vocabulary: np.ndarray  # sorted word hashes
    weights: np.ndarray
    bias: float

    def sentence_logits(self, hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        if not len(self.vocabulary):
            return np.full(n, self.bias)
        maybe = np.zeros(1 << 20, bool)
        maybe[self.vocabulary >> np.uint64(44)] = True
        some = np.flatnonzero(maybe[hashes >> np.uint64(44)])
        hashes = hashes[some]
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        w = np.where(self.vocabulary[at] == hashes, self.weights[at], 0.0)
        return np.bincount(of[some], weights=w, minlength=n) + self.bias


def noisy_or(logits: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """1 - product of (1 - p) over each document's sentences; 0 without any."""
    return -np.expm1(-np.bincount(doc, weights=np.logaddexp(0, logits), minlength=n_docs))


def fit(hashes, of, doc, labels, vocabulary=VOCABULARY, steps=300, rate=0.3, l1=5e-4) -> ToxicityModel:
    """Maximum likelihood of the document labels under the noisy-or, by Adam.

    hashes, of, doc: as from sentences(), over all training documents. The
    vocabulary has the features that occur in most documents, at least three.
    """
    n_docs, n_sent = len(labels), len(doc)
    word, inverse = np.unique(hashes, return_inverse=True)
    pair = np.unique(inverse.astype(np.int64) * n_docs + doc[of])
    df = np.bincount(pair // n_docs, minlength=len(word))
    keep = np.flatnonzero(df >= 3)
    keep = np.sort(keep[np.argsort(-df[keep], kind="stable")[:vocabulary]])
    column = np.full(len(word), -1)
    column[keep] = np.arange(len(keep))
    col = column[inverse]
    col, row = col[col >= 0], of[col >= 0]
    y = labels.astype(float)
    balance = np.where(y > 0, n_docs / (2 * max(1, y.sum())), n_docs / (2 * max(1, (1 - y).sum())))
    w, b = np.zeros(len(keep)), -5.0
    m, v = np.zeros(len(keep) + 1), np.zeros(len(keep) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=w[col], minlength=n_sent) + b
        p = np.exp(-np.logaddexp(0, -z))
        doc_p = np.clip(noisy_or(z, doc, n_docs), 1e-9, 1 - 1e-9)
        g = p * (balance * (1 - y / doc_p))[doc] / n_docs
        grad = np.append(np.bincount(col, weights=g[row], minlength=len(keep)) + l1 * np.sign(w), g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) * min(1, 2 * (1 - step / (steps + 1)))
        w -= move[:-1]
        w[np.abs(w) < np.abs(move[:-1]) * 0.5] = 0  # what the penalty has brought to nothing
        b -= move[-1]
    some = np.abs(w) > 1e-6
    return ToxicityModel(word[keep][some], w[some], float(b))


def train(labelled: DataFrame, per_label: int = PER_LABEL) -> ToxicityModel | None:
    """Fits on a sample of rows (doc_id, text, toxic); None if there are none.

    Each label is thinned by a hash of doc_id to about per_label rows on the
    executors; one task fits, and only the weights come to the driver.
    """
    known = labelled.filter("text IS NOT NULL AND toxic IN (0, 1)").select("doc_id", "text", "toxic")
    thin = sample_by_class(known, "toxic", "doc_id", per_label).select("text", "toxic").repartition(1)

    def fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, labels, n_sent = [], [], 0
        for batch in slices(batches):
            h, of, doc, start, _ = sentences(*joined(batch.column("text")))
            parts.append((h, of + n_sent, doc + len(labels)))
            n_sent += len(start)
            labels += batch.column("toxic").to_pylist()
        if labels:
            hashes, of, doc = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            m = fit(hashes, of, doc, np.array(labels))
            del hashes, of, doc
            release()
            yield record(words=pa.array([m.vocabulary.tobytes()]), weights=pa.array([m.weights.tobytes()]), bias=[m.bias])

    got = thin.mapInArrow(fit_task, "words binary, weights binary, bias double").collect()
    if not got:
        return None
    return ToxicityModel(np.frombuffer(got[0].words, np.uint64), np.frombuffer(got[0].weights, np.float64), got[0].bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: its score, the prediction, and its offending sentences.

    Null and empty texts have no sentence and score 0, as does every text if
    there is no model. Sentences are byte spans of the UTF-8 text; those
    scored SENTENCE_THRESHOLD or more offend. Repeated rows get equal
    answers. Other columns of docs are ignored.
    """
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, bounds = joined(batch.column("text"))
            n = len(bounds) - 1
            hashes, of, doc, start, end = sentences(data, bounds)
            if model is None:
                z = np.full(len(start), -np.inf)
            else:
                z = model.sentence_logits(hashes, of, len(start))
            score = noisy_or(z, doc, n)
            p = np.exp(-np.logaddexp(0, -z))
            bad = np.flatnonzero(p >= SENTENCE_THRESHOLD)
            offsets = np.searchsorted(doc[bad], np.arange(n + 1))
            from_ = bounds[doc[bad]]
            parts = pa.StructArray.from_arrays([pa.array(start[bad] - from_), pa.array(end[bad] - from_), pa.array(p[bad])], fields=list(span))
            yield record(
                doc_id=batch.column("doc_id"),
                held_out=batch.column("held_out"),
                score=score,
                predicted=(score >= THRESHOLD).astype(np.int32),
                n_sentences=np.bincount(doc, minlength=n),
                offending=pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts),
            )

    session(docs)
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return picked.mapInArrow(rows, SCHEMA)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    # one label for a document: toxic if any row says so
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # thinned before the texts are read: about twice PER_LABEL rows, whatever the corpus
    labels = sample_by_class(labels, "toxic", "doc_id", PER_LABEL)
    return score_toxicity(docs, train(docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id")))
