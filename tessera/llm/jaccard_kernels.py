"""Shingle sets and their partition signatures, for many documents at once."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import kernels as K
from .common import joined

#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 85
SHINGLE = 4
#: What one false candidate costs, in signature rows, in the choice of a band's scheme.
FALSE_COST = 200.0

#: Bits of a set's parity sketch; a power of two.
SKETCH_BITS = 2048

_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32


def digests(data: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """128 bits of a cryptographic hash of each document's lower-cased words; None where it has none."""
    whole = data.tobytes()
    texts = (b" ".join(whole[a:b].lower().split()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()))
    return [hashlib.blake2b(t, digest_size=16).digest() if t else None for t in texts]


def _shingles(wb: np.ndarray, width: int):
    """The shingles of all documents, whose words start at wb: document, first word, number of words."""
    n = np.diff(wb)
    full = np.flatnonzero(K.spans(wb, width)) if wb[-1] else np.empty(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < width))
    doc = np.concatenate([np.searchsorted(wb, full, side="right") - 1, short])
    return doc, np.concatenate([full, wb[short]]), np.concatenate([np.full(len(full), width), n[short]])


def _unequal(data, starts, ends, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether the words from places a and b differ."""
    differ = size_a != size_b
    if not len(a):
        return differ
    most = int(size_a.max())
    used = np.unique(np.concatenate([np.minimum(x + t, len(starts) - 1) for x in (a, b) for t in range(most)]))
    number = K.interned(data, starts[used], ends[used])[0]
    for t in range(most):
        inside = np.flatnonzero((t < size_a) & (t < size_b))
        x, y = (number[np.searchsorted(used, z[inside] + t)] for z in (a, b))
        differ[inside] |= x != y
    return differ


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's distinct shingles and the sets' bounds; the same in every task.

    Words are lower-cased (A-Z). A document of fewer than `width` words has
    its whole sequence as its only shingle; one without words has none.
    Distinct is decided by the words: if two differ and their hashes agree,
    both stay.
    """
    data = _fold[data]
    starts, ends, wb = K.words(data, bounds)
    doc, at, size = _shingles(wb, width)
    pre = K.prefix(K.span_hash(K.prefix(K.BYTE_VALUE[data]), starts, ends))
    token = K.span_hash(pre, at, at + size)
    # documents above the token's leading bits: one key to sort by
    bits = np.uint64(max(1, int(len(bounds)).bit_length()))
    key = doc.astype(np.uint64) << (np.uint64(64) - bits) | token >> bits
    order = np.argsort(key)
    key = key[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    i, j = order[same], order[same + 1]
    unequal = token[i] != token[j]
    unequal |= _unequal(data, starts, ends, at[i], at[j], size[i], size[j])
    first = np.ones(len(doc), bool)
    if unequal.any():  # by the words themselves
        numbers = _numbers(data, starts, ends, at, size, width)
        _, keep = np.unique(doc * (int(numbers.max()) + 1) + numbers, return_index=True)
        first = np.zeros(len(doc), bool)
        first[keep] = True
        row = order[first[order]]
    else:
        first[same + 1] = False
        row = order[first]
    return token[row], np.searchsorted(doc[row], np.arange(len(bounds)))


def _numbers(data, starts, ends, at: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Numbers of shingles, equal only for equal words; built up word by word."""
    token = np.zeros(len(at), np.int64)
    if not len(at):
        return token
    number = K.interned(data, starts, ends)[0]
    most = int(number.max()) + 2
    for t in range(width):
        word = np.where(t < size, number[np.minimum(at + t, len(number) - 1)] + 1, 0)
        token = np.unique(token * most + word, return_inverse=True)[1].astype(np.int64)
    return token


def exact_sets(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles as numbers that are equal only for equal words, sorted within it, and the bounds."""
    data, bounds = joined(texts)
    data = _fold[data]
    starts, ends, wb = K.words(data, bounds)
    doc, at, size = _shingles(wb, width)
    token = _numbers(data, starts, ends, at, size, width)
    kinds = int(token.max(initial=0)) + 1
    key = np.unique(doc * kinds + token)
    return key % kinds, np.searchsorted(key // kinds, np.arange(len(bounds)))


def sketches(token: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of SKETCH_BITS for each set: each bit is the parity of the items that hash to it.

    An item that only one of two sets has flips one bit, so the sketches
    differ in at most as many bits as the sets in items.
    """
    n = len(bounds) - 1
    place = (K.mix(token ^ np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    out = np.empty((n, SKETCH_BITS // 8), np.uint8)
    for i in range(0, n, 256):
        s = slice(*np.searchsorted(doc, [i, i + 256]))
        rows = min(256, n - i)
        odd = np.bincount((doc[s] - i) * SKETCH_BITS + place[s], minlength=rows * SKETCH_BITS) & 1
        out[i : i + rows] = np.packbits(odd.reshape(rows, -1).astype(bool), axis=1)
    return out.view(np.uint64)


def may_link(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """False where sketches differ in more bits than linked sets of these sizes can differ in items."""
    apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return (100 + percent) * apart <= (100 - percent) * (size_a + size_b)


@lru_cache
def bands(most: int, percent: int = PERCENT) -> np.ndarray:
    """Largest set size of each band, up to `most`.

    A set's partners of at most its own size lie in its band or the one below.
    """
    out, low = [], 1
    while low <= most:
        out.append(low * 100 // percent)
        low = out[-1] + 1
    return np.array(out, np.int64)


@lru_cache(maxsize=None)
def scheme(largest: int, percent: int = PERCENT) -> tuple[int, int, bool]:
    """(segments, signatures kept, one deletion?) for pairs whose larger set has at most `largest` items.

    Linked sets differ in at most H items. Exact segments: of H + 1 + c
    segments at least c + 1 are equal in both sets, so each set may leave out
    the c that come last in one order of all signatures, and they still share
    one. With one deletion: of H // 2 + 1 segments at least one differs by at
    most one item. The cheaper one is taken: signatures, and false candidates
    that grow as segments hold fewer items.
    """
    h = 2 * (100 - percent) * largest // (100 + percent)
    if h == 0:
        return 1, 1, False
    c = max(1, h // 7)
    exact, loose = h + 1 + c, h // 2 + 1
    cost_exact = (h + 1) * (1 + FALSE_COST * np.exp(-0.7 * largest / exact))
    cost_loose = loose + largest + FALSE_COST * loose * np.exp(-0.7 * (largest / loose - 1))
    return (exact, h + 1, False) if cost_exact <= cost_loose else (loose, loose, True)


def signatures(token: np.ndarray, bounds: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Document index and signature, for every signature of every set.

    Each set takes part in its own band's scheme (with sets of that size or
    below) and in the next one's (with larger sets).
    """
    size = np.diff(bounds)
    if not len(token):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    tops = bands(int(size.max()) * 100 // percent + 2, percent)
    docs, sigs = [], []
    for shift in (0, 1):
        band = np.searchsorted(tops, size) + shift
        rule = np.array([scheme(int(t), percent) for t in tops], np.int64)
        m, kept, loose = rule[np.minimum(band, len(rule) - 1)].T
        m = np.where(size > 0, m, 0)
        base = np.concatenate([[0], np.cumsum(m)])
        doc = np.repeat(np.arange(len(size)), size)
        seg = base[doc] + (K.mix(token) % m[doc].astype(np.uint64)).astype(np.int64)
        weight = K.mix(token ^ np.uint64(0xD6E8FEB86659FD93))
        total = np.zeros(base[-1], np.uint64)
        np.add.at(total, seg, weight)
        count = np.bincount(seg, minlength=base[-1])
        seg_doc = np.repeat(np.arange(len(size)), m)
        place = K.mix(band[seg_doc].astype(np.uint64) << np.uint64(32) | (np.arange(base[-1]) - base[seg_doc]).astype(np.uint64))
        sig = K.mix(total ^ place)
        order = np.lexsort((sig, -count, seg_doc))
        rank = np.arange(len(order)) - base[seg_doc[order]]
        keep = order[rank < kept[seg_doc[order]]]
        docs.append(seg_doc[keep])
        sigs.append(sig[keep])
        drop = np.flatnonzero(loose[doc] > 0)
        docs.append(doc[drop])
        sigs.append(K.mix((total[seg[drop]] - weight[drop]) ^ place[seg[drop]]))
    return np.concatenate(docs), np.concatenate(sigs)
