"""Passages that occur more than once in a corpus: what the two substring operators share.

Every window of `width` tokens is known by its least k-gram (kernels.anchors):
equal windows have equal ones. Consecutive windows of a document with one
least k-gram form a segment, keyed by the k-gram's hash. Only segments whose
key occurs twice go on. Segments of equal bytes (known by 96 bits of hash, besides their key's 64) are
one content with the earliest place it starts; contents are dealt to shards by
key, so that equal windows always meet, and each shard is searched on its own
(suffix array or FM-index), by the tokens themselves. A content whose key is
hot is cut again, at the windows' least longer gram, so that one frequent
k-gram with many surroundings is spread over shards too. The search tells for
every window of every content where it starts first; a segment then drops its
windows that start earlier elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import rank_by
from . import kernels as K
from .common import BATCH_BYTES, Written, cut, joined, record, slices

#: Where the windows off .. off + len - 1 of a content start first: document and token position of the window at off.
RUNS = "array<struct<off:int,len:int,doc:long,pos:long>>"


@dataclass(frozen=True)
class Windows:
    """What a token is ("bytes" or "words"), the windows' width, the k of their least k-gram, and the tokens of a shard."""

    unit: str
    width: int
    k: int
    shard_tokens: int

    @property
    def wide(self) -> int:
        """The longer gram by which the contents of a hot key are cut again."""
        return (self.k + self.width) // 2

    @property
    def hot(self) -> int:
        """A key that more segments than this have is hot."""
        return self.shard_tokens // (4 * self.width)

    @property
    def batch_bytes(self) -> int:
        """Text looked at once: bytes gain from arrays that stay in a core's cache, words from numbering many at a time."""
        return BATCH_BYTES // 2 if self.unit == "bytes" else BATCH_BYTES

    def tokens(self, data: np.ndarray, bounds: np.ndarray):
        """Token values, document bounds in tokens, and each token's first and last byte."""
        if self.unit == "bytes":
            at = K.places(len(data) + 1)
            return K.BYTE_VALUE[data], bounds, at[:-1], at[1:]
        starts, ends, wb = K.words(data, bounds)
        return K.word_hashes(data, starts, ends), wb, starts, ends


def _segments(rows: DataFrame, w: Windows, whole: bool) -> DataFrame:
    """(h) of every segment, or with whole=True (h, g, f, doc_id, start, n), where g and f are the hash of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=w.batch_bytes):
            data, bounds = joined(batch.column("text"))
            value, tb, first, last = w.tokens(data, bounds)
            doc, start, n, h = K.anchors(value, tb, w.width, w.k)
            h = h.view(np.int64)
            if whole:
                a = tb[doc] + start
                raw = memoryview(data.tobytes())
                digest = b"".join([xxhash.xxh3_128_digest(raw[x:y], K.SEED) for x, y in zip(first[a].tolist(), last[a + n + w.width - 2].tolist())])
                parts = np.frombuffer(digest, np.dtype([("g", "<i8"), ("f", "<i4"), ("rest", "<i4")]))
                g, f = parts["g"].copy(), parts["f"].copy()
                yield record(h=h, g=g, f=f, doc_id=batch.column("doc_id").to_numpy()[doc], start=start.astype(np.int32), n=n.astype(np.int32))
            else:
                yield record(h=h)

    return rows.mapInArrow(run, "h long, g long, f int, doc_id long, start int, n int" if whole else "h long")


def _contents(rows: DataFrame, firsts: DataFrame, w: Windows) -> DataFrame:
    """(route, h, g, f, doc_id, start, n, off, content): every content's bytes, cut out of the document where it starts first.

    A hot key's content comes in pieces; off is a piece's first window in the content.
    """
    by_doc = firsts.groupBy("doc_id").agg(F.collect_list(F.struct("h", "g", "f", "start", "n", "hot")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, bounds = joined(batch.column("text"))
            value, tb, first, last = w.tokens(data, bounds)
            parts = batch.column("parts")
            flat = parts.flatten()
            h, g, f, start, n = (flat.field(x).to_numpy() for x in ("h", "g", "f", "start", "n"))
            doc = np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy())
            a = tb[doc] + start
            hot = flat.field("hot").to_numpy(zero_copy_only=False).astype(bool)
            of, off, size, route = np.flatnonzero(~hot), np.zeros(int((~hot).sum()), np.int64), n[~hot].astype(np.int64), h[~hot]
            if hot.any():
                at = np.flatnonzero(hot)
                length = n[at].astype(np.int64) + w.width - 1
                cut_at = np.concatenate([[0], np.cumsum(length)])
                inner = np.arange(cut_at[-1]) - np.repeat(cut_at[:-1], length)
                owner, begin, count, gram = K.anchors(value[np.repeat(a[at], length) + inner], cut_at, w.width, w.wide)
                of, off, size = np.concatenate([of, at[owner]]), np.concatenate([off, begin]), np.concatenate([size, count])
                route = np.concatenate([route, K.mix(gram ^ h[at[owner]].view(np.uint64)).view(np.int64)])
            x, y = first[a[of] + off], last[a[of] + off + size + w.width - 2]
            raw = data.tobytes()
            text = [raw[i:j] for i, j in zip(x.tolist(), y.tolist())]
            ids = batch.column("doc_id").to_numpy()[doc[of]]
            columns = dict(route=route, h=h[of], g=g[of], f=f[of], doc_id=ids, start=(start[of] + off).astype(np.int32), n=size.astype(np.int32), off=off.astype(np.int32))
            for i in range(0, len(of), 4096):
                s = slice(i, i + 4096)
                yield record(**{k: v[s] for k, v in columns.items()}, content=pa.array(text[s], pa.binary()))

    joined_ = rows.join(by_doc, "doc_id").select("doc_id", "text", "parts")
    return joined_.mapInArrow(run, "route long, h long, g long, f int, doc_id long, start int, n int, off int, content binary")


#: Contents, their routes, first documents, first places and numbers of windows, to every window's first document and place.
Search = Callable[[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray], "tuple[np.ndarray, np.ndarray]"]


def runs_of(n: np.ndarray, doc: np.ndarray, pos: np.ndarray, offset: np.ndarray) -> pa.Array:
    """Per-window first places (of contents with n windows each, the first of number offset) as runs of consecutive places."""
    bounds = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(n)), n)
    head = np.ones(len(doc), bool)
    head[1:] = (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
    at = np.flatnonzero(head)
    length = np.diff(np.append(at, len(doc)))
    off = at - bounds[owner[at]] + offset[owner[at]]
    parts = [pa.array(off.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(doc[at]), pa.array(pos[at].astype(np.int64))]
    runs = pa.StructArray.from_arrays(parts, names=["off", "len", "doc", "pos"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, bounds).astype(np.int32)), runs)


def removed_spans(rows: DataFrame, w: Windows, search: Search, strict: bool) -> DataFrame:
    """(doc_id, spans): token spans [lo, hi) of each document that windows starting earlier cover.

    rows: doc_id (unique), text. Earlier means in a smaller doc_id, or (unless
    strict) in the same document at an earlier place. search gets a shard's
    contents and returns for every window the document and place where it
    starts first.
    """
    rows = rows.filter("doc_id IS NOT NULL")
    # cut here, so that the join below has nothing but an exchange on either side and a hot key can be split
    counted = _segments(rows, w, False).groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    repeated = cut(counted.select("h", (F.col("c") > w.hot).alias("hot")), release=True)
    kept = Written(_segments(rows, w, True).join(repeated, "h"))
    hits = kept.df
    firsts = hits.groupBy("h", "g", "f").agg(F.min(F.struct("doc_id", "start")).alias("p"), F.first("n").alias("n"), F.first("hot").alias("hot"))
    firsts = firsts.select("h", "g", "f", "p.doc_id", "p.start", "n", "hot")
    # about how many tokens the contents have; a scan, so that they aren't grouped twice
    many, mean = hits.agg(F.approx_count_distinct("g"), F.coalesce(F.avg("n"), F.lit(0.0))).first()
    shards = 1 + int(many * (mean + w.width)) // w.shard_tokens

    def find(found: pa.Table) -> pa.Table:
        route, doc, start, n, off = (found.column(x).to_numpy().astype(np.int64) for x in ("route", "doc_id", "start", "n", "off"))
        first = search(found.column("content").combine_chunks(), route, doc, start, n)
        return pa.table({"h": found.column("h"), "g": found.column("g"), "f": found.column("f"), "runs": runs_of(n, *first, off)})

    # written, so that the texts' shuffles are gone before the contents are dealt; neighbouring contents compress well
    contents = Written(_contents(rows, firsts, w))
    found = contents.df.withColumn("shard", F.pmod(F.col("route"), F.lit(shards))).groupBy("shard").applyInArrow(find, f"h long, g long, f int, runs {RUNS}")
    verdict = hits.join(found, ["h", "g", "f"]).select("doc_id", "start", F.explode("runs").alias("r"))
    earlier = F.col("r.doc") < F.col("doc_id")
    if not strict:
        earlier = earlier | ((F.col("r.doc") == F.col("doc_id")) & (F.col("r.pos") < F.col("start") + F.col("r.off")))
    lo = F.col("start") + F.col("r.off")
    gone = verdict.filter(earlier).select("doc_id", F.struct(lo.alias("lo"), (lo + F.col("r.len") + (w.width - 1)).alias("hi")).alias("span"))
    # cut, so that the contents' shuffles are gone before the texts are joined again
    spans = cut(gone.groupBy("doc_id").agg(F.collect_list("span").alias("spans")), release=True)
    kept.drop()
    contents.drop()
    return spans


def with_spans(rows: DataFrame, w: Windows, search: Search, strict: bool) -> DataFrame:
    """rows (doc_id, text, ...) with spans; null where nothing goes.

    A doc_id that stands with several texts counts as that many documents, one
    after another in the order of the texts' hashes.
    """
    keyed = rows.select("doc_id", "text").filter("doc_id IS NOT NULL")
    if keyed.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return rows.join(removed_spans(keyed, w, search, strict), "doc_id", "left")
    place, text = F.xxhash64("text").alias("_t"), F.col("text")
    texts = keyed.select("doc_id", place, "text").groupBy("doc_id", "_t", "text").agg(F.lit(1).alias("_")).select("doc_id", "_t", text)
    numbered = rank_by(texts, "_n", "doc_id", "_t", "text")
    spans = removed_spans(numbered.select(F.col("_n").alias("doc_id"), "text"), w, search, strict)
    spans = numbered.join(spans.withColumnRenamed("doc_id", "_n"), "_n").select("doc_id", "_t", text.alias("_text"), "spans")
    same = [F.col("r.doc_id") == F.col("s.doc_id"), F.xxhash64("r.text") == F.col("s._t"), F.col("r.text") == F.col("s._text")]
    return rows.alias("r").join(spans.alias("s"), same, "left").select("r.*", "s.spans")


def covered(spans: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """True for every token that a span of its document covers."""
    change = np.zeros(int(bounds[-1]) + 1, np.int32)
    flat = spans.flatten()
    doc = np.repeat(np.arange(len(spans)), np.nan_to_num(spans.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
    np.add.at(change, bounds[doc] + flat.field("lo").to_numpy(), 1)
    np.add.at(change, bounds[doc] + flat.field("hi").to_numpy(), -1)
    return np.cumsum(change[:-1]) > 0
