"""Packing token pieces into fixed windows by minimum bin slack.

Tokenizing is one pass over the texts. A document is cut at multiples of the
window; its full windows and its rest become pieces whose lengths lie in
1..capacity, so the multiset of all lengths is a table of at most `capacity`
counts, whatever the corpus. The plan is made from those counts alone: each
step opens a window with the longest length left and chooses, by a bitset
subset-sum over the remaining multiset, what fills it closest to capacity;
the pattern is then repeated as often as the counts allow, which uses up at
least one length. The pieces find their places by their rank among pieces of
equal length; ranks are counted within salts, then shifted.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import BATCH_BYTES, joined, merged, record, session, slices, table

CAPACITY = 4096
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
#: Ranks are counted in groups of about this many pieces of one length.
RANK_ROWS = 1000
#: Words whose ids a worker remembers (and as many again that it met before).
CACHED_WORDS = 400_000

#: Words whose ids are laid out at once.
CHUNK = 1 << 17

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: Marks that make one part of their own behind a word's letters.
MARKS = b".,;:!?*%$&#()-"
#: A longer run of marks stays with its word.
MOST_MARKS = 8
_mark = np.zeros(256, bool)
_mark[list(MARKS)] = True
_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
#: The characters by which the vocabulary spells bytes (read as Latin-1): those that don't print have others.
_spelled = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}


class WordIds(dict):
    """UTF-8 words to their ids as little-endian 32-bit bytes.

    The tokenizer never joins text across ASCII white space and drops it, so a
    text's ids are those of its words in order. Its special tokens have no
    white space either; where a text spells one, its id is taken.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.old: dict[bytes, bytes] = {}

    def of(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word."""
        if len(self) > CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        found = list(map(self.get, words))
        gaps = [i for i, x in enumerate(found) if x is None]
        self._learn({words[i] for i in gaps})
        for i in gaps:
            found[i] = self[words[i]]
        return found

    def _learn(self, words: set[bytes]) -> None:
        for word in words.intersection(self.old):
            self[word] = self.old[word]
        other, tokenize = [], self.model.tokenize
        for word in words.difference(self.old):
            # letters of Latin-1 are one part, which the merges see in lower case; all else takes the whole way
            if word.isalpha():
                text = word.lower().decode()
            elif (text := word.decode()).isalpha() and max(text) <= "\xff":
                text = text.lower().encode().decode("latin-1").translate(_spelled)
            else:
                other.append(word)
                continue
            ids = [x.id for x in tokenize(text)]
            self[word] = _packer(len(ids))(*ids)
        for i in range(0, len(other), 4096):
            part = other[i : i + 4096]
            for word, x in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                self[word] = struct.pack(f"<{len(x.ids)}I", *x.ids)


@lru_cache(256)
def _packer(n: int):
    return struct.Struct(f"<{n}I").pack


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def parts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The parts of all words: each part's number, the distinct parts by number, and the documents' bounds in parts.

    Letters with marks behind them are two parts, as the tokenizer splits
    there, and letters come in lower case: far fewer of them are distinct.
    Every other word is one part as it stands.
    """
    starts, ends, wb = K.words(data, bounds)
    letter = _letter[data]
    # Latin-1's letters of two bytes, but for a few signs that take the whole way
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    letter[lead] = letter[lead + 1] = True
    until = ends.copy()
    open_ = np.arange(len(ends))
    for _ in range(MOST_MARKS):
        open_ = open_[_mark[data[until[open_] - 1]]]
        until[open_] -= 1
        open_ = open_[until[open_] > starts[open_]]
    strange = np.zeros(len(data) + 1, np.int32)
    np.cumsum(~letter, out=strange[1:])
    plain = (strange[until] == strange[starts]) & (until > starts)
    until[~plain] = ends[~plain]
    behind = until < ends
    first = np.arange(len(starts)) + np.cumsum(behind) - behind
    number = np.empty(len(starts) + int(behind.sum()), np.int64)
    lettered, distinct = K.interned(_lower[data], starts[plain], until[plain])
    number[first[plain]] = lettered
    rest = np.ones(len(number), bool)
    rest[first[plain]] = False
    begin, end = np.empty(len(number), np.int64), np.empty(len(number), np.int64)
    begin[first], end[first] = starts, until
    begin[first[behind] + 1], end[first[behind] + 1] = until[behind], ends[behind]
    others, more = K.interned(data, begin[rest], end[rest])
    number[rest] = others + np.int64(len(distinct))
    return number, pa.concat_arrays([distinct, more]), np.append(first, len(number))[wb]


def document_ids(data: np.ndarray, bounds: np.ndarray, known: WordIds, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all documents one after another, each with end_id behind, and their bounds."""
    number, distinct, pb = parts(data, bounds)
    coded = known.of(distinct.to_pylist())
    size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    first = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(coded), "<u4")
    until = np.concatenate([[0], np.cumsum(size[number])])
    out_bounds = until[pb] + np.arange(len(pb))
    ids = np.full(int(out_bounds[-1]), end_id, "<u4")
    free = np.ones(len(ids), bool)
    free[out_bounds[1:] - 1] = False
    doc = np.searchsorted(pb, np.arange(0, len(number) + CHUNK, CHUNK).clip(max=len(number)), side="right") - 1
    for i, d, e in zip(range(0, len(number), CHUNK), doc[:-1].tolist(), doc[1:].tolist()):  # so that a very long text needs little besides its ids
        part = number[i : i + CHUNK]
        n = size[part]
        a, b = int(until[i]), int(until[i + len(part)])
        at = np.repeat(first[part] - (until[i : i + len(part)] - a), n) + np.arange(b - a)
        ids[a + d : b + e][free[a + d : b + e]] = flat[at]
    return ids, out_bounds


def token_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document (columns doc_id, text), with the CRC of their ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(vocabulary)
        for batch in slices(merged(batches), limit=2 * BATCH_BYTES):
            ids, bounds = document_ids(*joined(batch.column("text")), known, end_id)
            at, start, length, crc, total = [], [], [], [], []
            for i, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                for s in range(x, y, capacity):
                    piece = ids[s : min(s + capacity, y)]
                    at.append(i)
                    start.append(s - x)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece))
                    total.append(y - x)
            yield record(doc_id=batch.column("doc_id").take(pa.array(at, pa.int64())), start=start, length=length, ids_crc32=crc, doc_tokens=total)

    return docs.mapInArrow(rows, PIECES)


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length sum to the largest value of at most `room`.

    Bit t of a bitset tells whether t can be reached; counts are entered by
    binary splitting. Longest lengths come first; it ends as soon as the room
    can be filled. Walking back over the bitsets gives the counts.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        before, left, chunk = reach, min(counts[length], room // length), 1
        while left:
            chunk = min(chunk, left)
            reach |= (reach << (length * chunk)) & mask
            left -= chunk
            chunk *= 2
        steps.append((length, before))
        if reach >> room & 1:
            break
    t, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> t & 1:
            t -= length
            n += 1
        if n:
            used[length] = n
    return used


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of windows, {length: pieces in each}) until the counts are used up."""
    left, plan = {k: v for k, v in counts.items() if v}, []
    while left:
        seed = max(left)
        rest = dict(left)
        rest[seed] -= 1
        window = closest_fill(rest, capacity - seed)
        window[seed] = window.get(seed, 0) + 1
        times = min(left[k] // n for k, n in window.items())
        for k, n in window.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
        plan.append((times, window))
    return plan


def slots(plan: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces in each sequence, offset), sorted; a bounded table."""
    rows, taken, sequence = [], {}, 0
    for times, window in plan:
        offset = 0
        for length, n in sorted(window.items(), reverse=True):
            rows.append((length, taken.get(length, 0), sequence, n, offset))
            taken[length] = taken.get(length, 0) + times * n
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (a checkpointed table, read several times)."""
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    table_ = slots(minimum_bin_slack(histogram, capacity))
    # a salt count for each length: at most `capacity` rows
    lengths = pieces.sparkSession.createDataFrame([(k, 1 + n // RANK_ROWS) for k, n in histogram.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(lengths), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.col("salts")))
    shifts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = shifts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "doc_tokens", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(shifts, ["length", "salt"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("shift")).alias("rank"))
    key = (table_[:, 0] << 48) | table_[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(x).to_numpy() for x in ("length", "rank"))
            _, first, sequence, n, offset = table_[np.searchsorted(key, (length << 48) | rank, side="right") - 1].T
            i = rank - first
            columns = {x: batch.column(x) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            yield record(**columns, sequence_id=sequence + i // n, offset=offset + i % n * length)

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID, capacity: int = CAPACITY
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document's ids, then end_id; null and empty texts are the end id
    alone. Documents longer than the capacity are cut at its multiples; each
    id lies in one piece and no piece crosses a sequence. Repeated rows are
    packed as often as they stand there. An empty table gives no rows. Other
    columns of docs are ignored.
    """
    session(docs)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return pack_pieces(token_pieces(rows, vocabulary, end_id, capacity).checkpoint(), capacity)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
