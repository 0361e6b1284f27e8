"""Substring deduplication of 100-byte strings by externally sorted suffixes.

repeats.py deals the contents that may hold a repeated string to shards. Each
shard's contents are joined to one text, whose suffixes are sorted by
induction with common prefixes (induced_sort.py: queues go to disk beyond a
bound). Neighbours with a common prefix of 100 bytes form a group of equal
strings; its least (document, place) is where the string starts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined, record, session, slices, table
from .induced_sort import sorted_suffixes
from .repeats import Windows, covered, with_spans

WINDOWS = Windows("bytes", width=100, k=24, shard_tokens=3_000_000)


def first_places(contents: pa.Array, route: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, width: int = WINDOWS.width):
    """For every window of every content: the document and byte where it starts first."""
    # UTF-8 has no byte over 0xF4: two symbols are free below the bytes, for the separators and the end
    size = n + width - 1
    begin = np.cumsum(size + 1) - size - 1
    text = np.ones(int(size.sum()) + len(size) + 1, np.uint8)
    symbols = np.ones(len(text), bool)
    symbols[begin + size] = symbols[-1] = False
    text[symbols] = joined(contents)[0] + np.uint8(2)
    text[-1] = 0
    order, common = sorted_suffixes(text, width)
    window = np.zeros(len(text), bool)
    window[np.repeat(begin, n) + _within(n)] = True
    group = np.cumsum(common < width)
    use = window[order]
    order, group = order[use], group[use]
    docs, rank = np.unique(doc, return_inverse=True)
    content = np.repeat(np.arange(len(size), dtype=np.int32), np.append(np.diff(begin), len(text) - begin[-1:]))[order]
    place = start[content] + order - begin[content]
    key = rank[content] << 40 | place
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    least = np.repeat(np.minimum.reduceat(key, head), np.diff(np.append(head, len(key))))
    out = np.empty(int(n.sum()), np.int64)
    out[(np.cumsum(n) - n)[content] + order - begin[content]] = least
    return docs[out >> 40], out & ((1 << 40) - 1)


def _within(n: np.ndarray) -> np.ndarray:
    """0 .. n[0]-1, 0 .. n[1]-1, ..."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data, bounds = joined(batch.column("text"))
        gone = covered(batch.column("spans"), bounds)
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        edge = bounds[:-1][bounds[:-1] < len(gone)]
        begin[edge] = gone[edge]
        lost, spans = (np.diff(np.concatenate([[0], np.cumsum(x)])[bounds]) for x in (gone, begin))
        kept = [data[x:y][~gone[x:y]].tobytes() for x, y in zip(bounds[:-1], bounds[1:])]
        yield record(doc_id=batch.column("doc_id"), n_bytes=np.diff(bounds), n_removed=lost, n_spans=spans, kept=pa.array(kept, pa.binary()))


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay).

    A byte goes if a 100-byte string that covers it also starts earlier: in a
    smaller doc_id, or before it in the same document; overlaps count, and all
    is judged on the input. doc_id is the key of docs: rows that repeat it
    with the same text get the same answer; with another text it counts as
    another document right behind. Rows with a null doc_id keep all bytes and
    take none from others. Null texts are empty; texts under 100
    bytes keep all. Other columns of docs are ignored.
    """
    session(docs)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return with_spans(rows, WINDOWS, first_places, strict=False).mapInArrow(_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(greatest(n - 99, 0))) AS i FROM bytes) AS s),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win) AS w WHERE r > 1),
marked AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM later),
runs AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM marked),
spans AS (SELECT doc_id, r, min(i) AS lo, max(i) + 100 AS hi FROM runs GROUP BY doc_id, r),
ends AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS from_ FROM spans),
parts AS (SELECT doc_id, from_ AS place, substr(h, 2 * from_ + 1, 2 * (lo - from_)) AS part FROM ends JOIN bytes USING (doc_id)
  UNION ALL SELECT doc_id, hi, substr(h, 2 * hi + 1) FROM (SELECT doc_id, max(hi) AS hi FROM spans GROUP BY doc_id) AS l JOIN bytes USING (doc_id)),
kept AS (SELECT doc_id, string_agg(part, '' ORDER BY place) AS k FROM parts GROUP BY doc_id),
total AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM bytes LEFT JOIN total USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
