"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding.

Texts are cut by the vocabulary's pattern; each match is merged on its own. A
segment tree over the match's byte positions, with wide nodes, stores the
leftmost least pair rank, so each merge is found at the root and changes at
most three leaves, in logarithmic time: a match of any length costs n log n. A worker remembers the
ids of the matches it met; texts stream through without a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record, session, slices, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Matches and chunks whose ids a worker remembers (and as many again); longer ones are never kept.
CACHED_MATCHES, CACHED_CHUNKS, CACHED_CHARS = 450_000, 200_000, 64

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_NONE = 1 << 62
#: Children of a node of the segment tree; most matches fit into one node, whose minimum is one call.
FAN_OUT = 32


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match. Ties of rank go to the leftmost pair."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get = len(piece), ranks.get
    leaves = [_NONE if (r := get(piece[i : i + 2])) is None else r << 32 | i for i in range(n - 1)]
    leaves.append(_NONE)
    levels = [leaves]  # each has the minima of so many nodes of the one before
    while len(levels[-1]) > FAN_OUT:
        below = levels[-1]
        levels.append([min(below[i : i + FAN_OUT]) for i in range(0, len(below), FAN_OUT)])
    top, inner = levels[-1], levels[1:]
    end = list(range(1, n + 1))  # of the token that starts there; the next token starts at that place
    before = list(range(-1, n))  # start of the token before
    while (least := min(top)) != _NONE:
        i = h = least & 0xFFFFFFFF
        j = end[i]
        k = end[i] = end[j]
        leaves[j] = leaves[i] = _NONE
        if k < n:
            before[k] = i
            r = get(piece[i : end[k]])
            if r is not None:
                leaves[i] = r << 32 | i
        if i:
            h = before[i]
            r = get(piece[h:k])
            leaves[h] = _NONE if r is None else r << 32 | h
        if inner:
            for place in (j, i, h):
                below = leaves
                for level in inner:
                    place //= FAN_OUT
                    value = min(below[place * FAN_OUT : (place + 1) * FAN_OUT])
                    if level[place] == value:
                        break
                    level[place] = value
                    below = level
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class _Bounded(dict):
    """Remembers short keys: the last `limit` or more that were used, up to twice as many."""

    def __init__(self, make, limit):
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key, self)
        if value is self:
            value = self.make(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class ByteBPE:
    """Encodes and decodes by a file of ranks (base64 token and rank, one a line)."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        #: ids as decimal text, which is what the digests are made of
        self.match_text = _Bounded(lambda m: " ".join(map(str, merge(m.encode(), self.ranks))), CACHED_MATCHES)
        self.chunk_text = _Bounded(self._chunk, CACHED_CHUNKS)
        self.decoded = _Bounded(lambda ids: b"".join([self.tokens[int(i)] for i in ids.split(" ")]) if ids else b"", CACHED_CHUNKS)

    def encode(self, text: str) -> list[int]:
        return [i for m in self.find(text) for i in merge(m.encode(), self.ranks)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def _chunk(self, chunk: str) -> str | None:
        """Of " " + chunk, where that can be encoded alone: it has no white space at either end."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        return " ".join([self.match_text[m] for m in self.find(" " + chunk)])

    def encode_text(self, text: str) -> list[str]:
        """Parts of the ids in decimal, in order.

        A match never goes on across a single space between two other
        characters: the space opens the next match. So chunks between such
        spaces are encoded alone. A text with other white space at a chunk's
        end is matched as a whole.
        """
        first, *chunks = text.split(" ")
        if first and not first[-1].isspace():
            known = self.chunk_text
            parts = [known[c] for c in chunks]
            if None not in parts:
                return [self.match_text[m] for m in self.find(first)] + parts
        return [self.match_text[m] for m in self.find(text)]


@cache
def codec(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode_decode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, digests of the ids and of the decoded bytes.

    Null and empty texts have no ids. Repeated rows get equal answers; a null
    doc_id stays null. Other columns of docs are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in slices(batches):
            n, ids_digest, text_digest = [], [], []
            for t in batch.column("text").to_pylist():
                parts = bpe.encode_text(t or "")
                ids = " ".join(parts)
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_digest.append(hashlib.sha256(ids.encode()).hexdigest())
                text_digest.append(hashlib.sha256(b"".join([bpe.decoded[p] for p in parts])).hexdigest())
            yield record(doc_id=batch.column("doc_id"), n_tokens=n, ids_sha256=ids_digest, decoded_sha256=text_digest)

    session(docs)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, SCHEMA)


def token_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and the list of ids of every row of docs; null and empty texts have an empty list."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in slices(batches):
            ids = [[int(i) for p in bpe.encode_text(t or "") for i in p.split(" ") if i] for t in batch.column("text").to_pylist()]
            yield record(doc_id=batch.column("doc_id"), ids=pa.array(ids, pa.list_(pa.int32())))

    session(docs)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, "doc_id long, ids array<int>")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
