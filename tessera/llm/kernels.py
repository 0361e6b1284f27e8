"""Numpy kernels shared by the text operators: rolling hashes, words, minimizers.

All kernels work on one concatenated buffer of many documents, so the cost of
a numpy call is paid per batch and not per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Multiplier of the rolling hash; odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C1B
BASE_INV = pow(BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random 64-bit value for each byte.
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Seed of the hashes of whole words and contents.
SEED = 0x5DEECE66D
_powers: dict[int, np.ndarray] = {}
_places = np.arange(0)

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; the table grows as needed."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16, 0 if have is None else 2 * len(have))
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[: n + 1]


def places(n: int) -> np.ndarray:
    """0 .. n - 1; not to be changed."""
    global _places
    if n > len(_places):
        if n > 1 << 22:  # not kept
            return np.arange(n)
        _places = np.arange(n)
    return _places[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE**i, from which span_hash reads any span."""
    out = np.empty(len(values) + 1, U64)
    out[0] = 0
    np.cumsum(values * powers(BASE, len(values))[: len(values)], dtype=U64, out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), the same wherever a span stands."""
    return mix((pre[end] - pre[start]) * powers(BASE_INV, len(pre))[start])


def rolling(pre: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive values."""
    n = len(pre) - k
    if n <= 0:
        return np.empty(0, U64)
    return mix((pre[k:] - pre[:-k]) * powers(BASE_INV, n)[:n])


def words(data: np.ndarray, bounds: np.ndarray):
    """Words (runs without ASCII white space) of documents joined in one buffer.

    data: bytes; bounds: document starts and the end. Returns the words'
    starts, ends, and the index of each document's first word (one more at the
    end). A word never crosses a document's bounds.
    """
    n = len(data)
    if n == 0:
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(bounds), np.int64)
    solid = ~_space[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    edge = bounds[(bounds > 0) & (bounds < n)]
    begin[edge] = solid[edge]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    stop[edge - 1] = solid[edge - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, bounds)


def interned(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each span, equal exactly where the spans' bytes are, and the distinct spans by number.

    Spans must be in order and not overlap.
    """
    size = ends - starts
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    whole = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    spans_ = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(whole)])
    coded = spans_.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every task."""
    number, distinct = interned(data, starts, ends)
    return np.fromiter((xxhash.xxh3_64_intdigest(w, SEED) for w in distinct.to_pylist()), U64, len(distinct))[number]


def spans(bounds: np.ndarray, width: int) -> np.ndarray:
    """True at every position where `width` values fit into the document."""
    n = int(bounds[-1])
    ok = np.zeros(n + 1, np.int8)  # one of the documents at most is open at a place
    length = np.diff(bounds)
    fit = length >= width
    np.add.at(ok, bounds[:-1][fit], 1)
    np.add.at(ok, bounds[1:][fit] - width + 1, -1)
    return np.cumsum(ok[:-1], dtype=np.int8) > 0


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for every i where the window fits."""
    if len(x) < w:
        return x[:0]
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - w + size], x[w - size :]) if size < w else x


#: Windows that anchors() looks at together, so that their arrays stay in a core's cache.
BLOCK = 1 << 15
_LOW = U64((1 << 20) - 1)
_place = np.arange(BLOCK, dtype=U64)


def anchors(values: np.ndarray, bounds: np.ndarray, width: int, k: int):
    """Groups every window of `width` values by its leftmost least k-gram.

    Two equal windows have the same least k-gram, so they get the same hash,
    wherever they stand. Consecutive windows of a document that share it form
    one segment. Returns arrays: document, first window's start in the
    document, number of windows, the k-gram's hash. A hash's last 20 bits
    don't count for which is least; width is at most 2**19.
    """
    global _place
    empty = np.empty(0, np.int64)
    none = empty, empty, empty, empty.astype(U64)
    ok = spans(bounds, width)
    if not ok.any():
        return none
    if len(_place) < BLOCK + width:
        _place = np.arange(BLOCK + width, dtype=U64)
    new = np.zeros(len(ok), bool)
    new[bounds[:-1][np.diff(bounds) >= width]] = True
    heads, grams, last = [], [], -1
    for a in range(0, len(values) - width + 1, BLOCK):
        b = min(a + BLOCK, len(values) - width + 1)
        gram = rolling(prefix(values[a : b + width - 1]), k)
        packed = gram & ~_LOW
        packed |= _place[: len(gram)]
        least = sliding_min(packed, width - k + 1)
        # a place's number is part of what is compared: where the least differs, it stands elsewhere
        moved = np.empty(b - a, bool)
        np.not_equal(least[1:], least[:-1], out=moved[1:])
        moved[0] = a + int(least[0] & _LOW) != last
        moved &= ok[a:b]
        moved |= new[a:b]
        at = np.flatnonzero(moved)
        heads.append(a + at)
        grams.append(gram[(least[at] & _LOW).astype(np.int64)])
        last = a + int(least[-1] & _LOW)
    head = np.concatenate(heads)
    doc = np.searchsorted(bounds, head, side="right") - 1
    count = np.minimum(np.append(head[1:], len(values)), bounds[doc + 1] - width + 1) - head
    return doc, head - bounds[doc], count, np.concatenate(grams)
