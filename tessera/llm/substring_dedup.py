"""Substring deduplication of word windows by a compressed FM-index for each shard.

repeats.py deals the contents that may hold a repeated window to shards. Of
each key's contents all but the latest are indexed, as only they can come
before another, and all but the earliest are streamed through the index from
right to left, all at once. A backward step takes in the next word; where the
interval would be empty, the match falls back to the longest shorter one whose
interval is larger, until the word fits: these are matching statistics, cut off
at `width` words. Places where they reach it are reported, with the least
document in the interval.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import WORDS_SQL, joined, record, session, slices, table
from .fm_index import FMIndex
from .repeats import Windows, covered, with_spans

WINDOWS = Windows("words", width=50, k=16, shard_tokens=300_000)


def matching_statistics(index: FMIndex, stream: np.ndarray, bounds: np.ndarray, width: int):
    """Yields (places, lengths, low, high): how many symbols of a stream from a place on occur in the index, `width` at most.

    stream: the streams one after another (0: not in the index), from bounds.
    Streams go from right to left in step, the longest first, so that those
    still being read are the first ones.
    """
    size = np.diff(bounds)
    by_size = np.argsort(-size, kind="stable")
    low, high, match = np.zeros(len(size), np.int64), np.full(len(size), index.size, np.int64), np.zeros(len(size), np.int64)
    for step in range(int(size.max(initial=0))):
        live = by_size[: np.searchsorted(-size[by_size], -step, side="left")]
        at = bounds[live + 1] - 1 - step
        symbol, lo, hi, length = stream[at], low[live], high[live], match[live]
        full = np.flatnonzero(length == width)
        lo[full], hi[full] = index.widen(lo[full], hi[full], np.full(len(full), width - 1))
        length[full] = width - 1
        strange = symbol == 0
        lo[strange], hi[strange], length[strange] = 0, index.size, 0
        pending = np.flatnonzero(~strange)
        while len(pending):
            a, b = index.step(symbol[pending], lo[pending], hi[pending])
            ok = a < b
            done = pending[ok]
            lo[done], hi[done] = a[ok], b[ok]
            length[done] += 1
            pending = pending[~ok]
            pending = pending[length[pending] > 0]  # nothing shorter than nothing
            lo[pending], hi[pending], length[pending] = index.shorten(lo[pending], hi[pending])
        low[live], high[live], match[live] = lo, hi, length
        yield at, length, lo, hi


def least_documents(contents: pa.Array, route: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, width: int = WINDOWS.width):
    """For every window of every content: the least document it occurs in (its own one at most), and 0 for its place."""
    data, bounds = joined(contents)
    a, b, wb = K.words(data, bounds)
    number = K.interned(data, a, b)[0].astype(np.int64)
    size = np.diff(wb)  # words of each content: n + width - 1
    out = np.repeat(doc, n)
    out_at = np.cumsum(n) - n
    order = np.lexsort((doc, route))
    change = route[order][1:] != route[order][:-1]
    latest, earliest = order[np.append(change, True)], order[np.append(True, change)]
    indexed, streamed = np.ones(len(n), bool), np.ones(len(n), bool)
    indexed[latest] = False
    streamed[earliest] = False
    indexed, streamed = np.flatnonzero(indexed), np.flatnonzero(streamed)
    if not len(indexed):
        return out, np.zeros(len(out), np.int64)

    def laid(which: np.ndarray) -> np.ndarray:
        """The words' places of some contents, one content after another."""
        return np.repeat(wb[which] - (np.cumsum(size[which]) - size[which]), size[which]) + np.arange(int(size[which].sum()))

    # each indexed content, then a separator; symbols are numbered among the indexed words
    words = number[laid(indexed)]
    symbol = np.zeros(int(number.max()) + 1, np.int64)
    symbol[words] = 1
    alphabet = int(symbol.sum()) + 1
    symbol[symbol > 0] = np.arange(1, alphabet)
    line = np.zeros(len(words) + len(indexed), np.int64)
    line[np.arange(len(words)) + np.repeat(np.arange(len(indexed)), size[indexed])] = symbol[words]
    index = FMIndex(line, alphabet, width)
    # the least document of each block of suffixes that agree in `width` words
    owner = np.repeat(doc[indexed], size[indexed] + 1)[index.order]
    block = np.flatnonzero(index.common[0][:-1] < width)
    least = np.minimum.reduceat(owner, block)

    bounds = np.concatenate([[0], np.cumsum(size[streamed])])
    for at, length, low, _ in matching_statistics(index, symbol[number[laid(streamed)]], bounds, width):
        hit = np.flatnonzero(length >= width)
        which = np.searchsorted(bounds, at[hit], side="right") - 1
        place = out_at[streamed[which]] + at[hit] - bounds[which]
        out[place] = np.minimum(out[place], least[np.searchsorted(block, low[hit], side="right") - 1])
    return out, np.zeros(len(out), np.int64)


def _rows(batches: Iterator[pa.RecordBatch], with_row: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data, bounds = joined(batch.column("text"))
        a, b, wb = K.words(data, bounds)
        gone = covered(batch.column("spans"), wb)
        raw, texts, lost = data.tobytes(), [], []
        for i, (x, y) in enumerate(zip(wb[:-1].tolist(), wb[1:].tolist())):
            own = raw[bounds[i] : bounds[i + 1]].split()
            drop = gone[x:y]
            lost.append(int(drop.sum()))
            texts.append(b" ".join([w for w, d in zip(own, drop.tolist()) if not d] if lost[-1] else own))
        kept = pa.array([t.decode() for t in texts], pa.string())
        yield record(doc_id=batch.column("doc_id"), n_words=np.diff(wb), n_removed=pa.array(lost, pa.int64()), kept=kept, **({"row": batch.column("row")} if with_row else {}))


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_row: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept (the words that stay, joined by one space).

    A word goes if a window of 50 consecutive words that covers it also starts
    in a document of smaller doc_id, judged on the input. doc_id is the key of
    docs: rows that repeat it with the same text get the same answer; with
    another text it counts as another document right behind. Rows with a
    null doc_id keep all words and take none from others. Null and
    empty texts have no words; texts shorter than a window keep all. An empty
    table gives no rows. Other columns of docs are ignored; with_row adds the
    whole row of docs as one column `row`, whatever its columns' names.
    """
    session(docs)
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *([F.struct(*docs.columns).alias("row")] if with_row else []))
    schema = "doc_id long, n_words long, n_removed long, kept string" + (f", row {whole.schema['row'].dataType.simpleString()}" if with_row else "")
    return with_spans(whole, WINDOWS, least_documents, strict=True).mapInArrow(lambda x: _rows(x, with_row), schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = rf"""
WITH {WORDS_SQL},
x AS (SELECT doc_id, w, unnest(range(greatest(len(w) - 49, 0))) AS i FROM words),
win AS (SELECT doc_id, i, md5(list_aggregate(w[i + 1 : i + 50], 'string_agg', ' ')) AS g FROM x),
first AS (SELECT g, min(doc_id) AS least FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM win JOIN first USING (g) WHERE least < doc_id),
lost AS (SELECT doc_id, list(j) AS j FROM gone GROUP BY doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS j FROM words),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.j) AS t FROM each e ANTI JOIN gone ON gone.doc_id = e.doc_id AND gone.j = e.j GROUP BY e.doc_id)
SELECT doc_id, len(w) AS n_words, CAST(coalesce(len(j), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM words LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
