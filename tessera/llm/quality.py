"""Repetition rules: rolling hashes of several n-gram lengths over whole texts.

A pass over each document: words are numbered by their bytes, n-grams of them
become 64-bit rolling hashes, and sorting (document, hash) keys of one batch
finds what a document repeats. Where hashes agree, the words are compared.
Lines are numbered by their bytes. Only windows whose shorter window repeats
are looked at for the next length. No shuffle: a lost task is just run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import WORDS_SQL, joined, per_document, record, session, slices, table

#: Largest share of a text's word characters that may stand in n-grams that occur twice or more, by n.
NGRAM_SHARE = {5: 0.20, 6: 0.20, 7: 0.20, 8: 0.20, 9: 0.20, 10: 0.20}
#: Largest share of word characters in lines that repeat an earlier line.
LINE_SHARE = 0.30
MIN_WORDS, BASE_NGRAM, BASE_PERCENT = 10, 5, 20

_symbol = np.zeros(256, bool)
_symbol[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, dup_line_share double, dup_ngram_shares array<double>, reasons array<string>"
)


def _repeats(key: np.ndarray, equal=None, exact=None) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur twice or more, does it occur earlier.

    Where keys are hashes, equal(i, j) tells of index pairs of one key whether
    what they stand for is equal; if any isn't, exact() gives keys to use instead.
    """
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if equal is not None and not equal(order[:-1][same], order[1:][same]).all():
        return _repeats(exact())
    later = np.zeros(len(key), bool)
    later[order[1:][same]] = True
    twice = later.copy()
    twice[order[:-1][same]] = True
    return twice, later


def _same_words(number: np.ndarray, doc: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    same = doc[a] == doc[b]
    for t in range(n):
        same &= number[a + t] == number[b + t]
    return same


def _exact(number: np.ndarray, doc: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Dense numbers of (document, n words), built up word by word."""
    key = doc[at].astype(np.int64)
    for t in range(n):
        key = np.unique(key * (int(number.max()) + 1) + number[at + t], return_inverse=True)[1]
    return key


def repetition(data: np.ndarray, bounds: np.ndarray, lengths=tuple(NGRAM_SHARE)) -> dict[str, np.ndarray]:
    """Counts and shares of every document in the buffer."""
    n_docs = len(bounds) - 1
    starts, ends, wb = K.words(data, bounds)
    solid = ~K._space[data]
    codepoint = (data & 0xC0) != 0x80
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(codepoint & solid, out=chars[1:])
    out = {"n_words": np.diff(wb), "word_chars": chars[bounds[1:]] - chars[bounds[:-1]], "n_symbols": per_document(_symbol[data], bounds)}

    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([bounds[:-1], breaks + 1]))
    line_doc = np.searchsorted(bounds[1:], line_start, side="right")
    line_start, line_doc = line_start[line_doc < n_docs], line_doc[line_doc < n_docs]
    # a line ends before its break, or where the document does
    following = np.append(breaks, len(data))[np.searchsorted(breaks, line_start)]
    line_end = np.minimum(following, bounds[line_doc + 1])
    line_chars = chars[line_end] - chars[line_start]
    worded = line_chars > 0
    line_start, line_end, line_doc, line_chars = line_start[worded], line_end[worded], line_doc[worded], line_chars[worded]
    later = _repeats(K.interned(data, line_start, line_end)[0].astype(np.int64) * n_docs + line_doc)[1]
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=n_docs)
    out["dup_line_chars"] = np.bincount(line_doc[later], weights=line_chars[later], minlength=n_docs).astype(np.int64)

    number = K.interned(data, starts, ends)[0]
    value = K.mix(number.astype(np.uint64) + np.uint64(1))
    doc_key = K.mix(np.arange(1, n_docs + 1, dtype=np.uint64))
    word_doc = np.repeat(np.arange(n_docs), np.diff(wb))
    length = chars[ends] - chars[starts]
    wpre = K.prefix(value)
    at = None
    out["dup_ngram_chars"] = np.zeros((n_docs, len(lengths)), np.int64)
    for j, n in enumerate(lengths):
        fits = np.flatnonzero(K.spans(wb, n)) if len(value) else np.empty(0, np.int64)
        at = fits if at is None else np.intersect1d(at, fits, assume_unique=True)
        key = K.mix(K.span_hash(wpre, at, at + n) ^ doc_key[word_doc[at]])
        at = at[_repeats(key, lambda a, b: _same_words(number, word_doc, at[a], at[b], n), lambda: _exact(number, word_doc, at, n))[0]]
        cover = np.zeros(len(value) + 1, np.int32)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + n, -1)
        covered = np.cumsum(cover[:-1]) > 0
        out["dup_ngram_chars"][:, j] = np.bincount(word_doc[covered], weights=length[covered], minlength=n_docs)
        if n == BASE_NGRAM:
            out["n_repeat_words"] = np.bincount(word_doc[covered], minlength=n_docs)
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lengths = tuple(NGRAM_SHARE)
    for batch in slices(batches):
        x = repetition(*joined(batch.column("text")), lengths)
        chars = np.maximum(x["word_chars"], 1)
        lines = x["dup_line_chars"] / chars
        shares = x["dup_ngram_chars"] / chars[:, None]
        base = (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > BASE_PERCENT * x["n_words"])
        bad = np.column_stack([lines > LINE_SHARE, shares > np.array(list(NGRAM_SHARE.values()))])
        names = np.array(["lines", *(f"{n}-grams" for n in lengths)])
        yield record(
            doc_id=batch.column("doc_id"),
            **{k: x[k].astype(np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")},
            base_failed=base,
            kept=~base & ~bad.any(axis=1),
            dup_line_share=lines,
            dup_ngram_shares=pa.array(list(shares), pa.list_(pa.float64())),
            reasons=pa.array([names[b].tolist() for b in bad], pa.list_(pa.string())),
        )


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs, with counts, shares of repeated text and the verdict.

    Null and empty texts have no words and fail the base rule. Repeated rows
    get equal answers; a null doc_id stays null. Lines are split at \\n only; a
    line counts as repeated if it has a word and equals an earlier line of the
    same text exactly. Other columns of docs are ignored. kept is false if the
    base rule fails or any share passes its bound (NGRAM_SHARE, LINE_SHARE);
    reasons names the bounds passed.
    """
    session(docs)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_rows, SCHEMA)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns; shares and reasons are the operator's."""
    done = quality_rules(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP1_SQL = rf"""
WITH {WORDS_SQL},
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, w FROM words),
chars AS (SELECT doc_id, sum(length(word)) AS word_chars FROM x GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
dup AS (SELECT doc_id, sum(n - 1) AS n_dup_lines, sum((n - 1) * c) AS dup_chars FROM (
  SELECT doc_id, line, count(*) AS n, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS c FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) AS l GROUP BY doc_id),
grams AS (SELECT doc_id, i, n, list_aggregate(w[i + 1 : i + n], 'string_agg', ' ') AS gram FROM x, (SELECT unnest([5, 6, 7, 8, 9, 10]) AS n) AS lengths WHERE i + n <= len(w)),
twice AS (SELECT doc_id, i, n FROM (SELECT doc_id, i, n, count(*) OVER (PARTITION BY doc_id, n, gram) AS k FROM grams) AS g WHERE k > 1),
hit AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS j FROM twice),
shares AS (SELECT h.doc_id, n, count(*) AS words, sum(length(word)) AS c FROM hit h JOIN x ON x.doc_id = h.doc_id AND x.i = h.j GROUP BY h.doc_id, n),
bad AS (SELECT doc_id, max(words) FILTER (WHERE n = 5) AS n_repeat_words, max(c) AS most FROM shares GROUP BY doc_id),
a AS (SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(len(coalesce(text, '')) - len(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(dup_chars, 0) AS dup_chars, coalesce(most, 0) AS most
  FROM documents d JOIN words USING (doc_id) LEFT JOIN chars USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN bad USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND dup_chars / greatest(word_chars, 1) <= 0.3 AND most / greatest(word_chars, 1) <= 0.2 AS kept FROM a
"""
