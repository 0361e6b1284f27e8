"""External induced sorting of suffixes with common-prefix values, in numpy.

The suffixes of a byte text are sorted by induction: those that start at a
local minimum (LMS) are named and sorted on the next level, and their order
induces all others in two sweeps over the alphabet. The sweeps run through
priority queues of tuples (suffix, common prefix with the one before). As a
sweep takes symbols in order, and what it finds for a symbol is already in
order, the queue is one run for each symbol, and runs beyond a memory bound
go to disk. All tuples of a symbol are handled at once; a symbol that repeats
makes one more round for each repetition. A common prefix is carried along by
a range minimum over the tuples between two induced ones, plus one.

Orders and common prefixes are exact up to `depth` symbols, which is all that
windows of that width need. On the next level, where names are many, names are
sorted by doubling up to that depth; each doubling sorts those still tied.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Tuples that a queue keeps in memory; the rest waits on disk.
QUEUE_TUPLES = 1 << 18
FAR = 250


class Queue:
    """Tuples (position, common prefix) for each first symbol, taken symbol by symbol in the order they came."""

    def __init__(self, room: int = QUEUE_TUPLES):
        self.room, self.held = room, 0
        self.runs: dict[int, list] = {}
        self.disk = None

    def push(self, symbol: int, position: np.ndarray, common: np.ndarray) -> None:
        self.runs.setdefault(symbol, []).append((position, common))
        self.held += len(position)
        if self.held > self.room:
            self._spill()

    def _spill(self) -> None:
        if self.disk is None:
            self.disk = tempfile.TemporaryFile(prefix="tessera-queue-")
        self.disk.seek(0, 2)
        for symbol, runs in self.runs.items():
            if any(isinstance(r[0], np.ndarray) for r in runs):
                out = [r for r in runs if not isinstance(r[0], np.ndarray)]
                kept = [r for r in runs if isinstance(r[0], np.ndarray)]
                p, c = np.concatenate([r[0] for r in kept]), np.concatenate([r[1] for r in kept])
                at = self.disk.tell()
                self.disk.write(p.tobytes())
                self.disk.write(c.tobytes())
                self.runs[symbol] = [*out, (at, len(p))]
        self.held = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        positions, commons = [np.empty(0, np.int32)], [np.empty(0, np.uint8)]
        for a, b in self.runs.pop(symbol, []):
            if isinstance(a, np.ndarray):
                self.held -= len(a)
                positions.append(a)
                commons.append(b)
            else:
                self.disk.seek(a)
                positions.append(np.frombuffer(self.disk.read(4 * b), np.int32))
                commons.append(np.frombuffer(self.disk.read(b), np.uint8))
        return np.concatenate(positions), np.concatenate(commons)

    def close(self) -> None:
        if self.disk is not None:
            self.disk.close()


def _range_min(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(x[low : high]) for nonempty ranges."""
    width = high - low
    level = np.frexp(width.astype(np.float64))[1] - 1
    rows = [x]
    for k in range(1, int(level.max(initial=0)) + 1):
        last, h = rows[-1], 1 << (k - 1)
        nxt = last.copy()
        nxt[: len(x) - h] = np.minimum(last[: len(x) - h], last[h:])
        rows.append(nxt)
    table, row = np.concatenate(rows), level * np.int64(len(x))
    return np.minimum(table[row + low], table[row + high - (np.int64(1) << level)])


class _Sweep:
    """One induction sweep: which suffixes the sources induce, with common prefixes."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, depth: int):
        self.depth = depth
        # a suffix's first symbol, or FAR where it isn't wanted; none has the last one behind it, so that stands for "no suffix" too
        self.first = np.where(wanted, text, np.uint8(FAR))
        self.first[-1] = FAR
        self.since = np.full(256, -1, np.int64)  # least common prefix since the last tuple of a symbol; -1: none yet
        self.queue = Queue()

    def induce(self, source: np.ndarray, common: np.ndarray, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """Queues what the sources induce; returns at once what starts with `symbol` itself."""
        none = np.empty(0, np.int32), np.empty(0, np.uint8)
        if not len(source):
            return none
        before = source - 1
        first = self.first[before]
        pick = np.flatnonzero(first != FAR)
        lead = np.minimum.accumulate(common)
        if not len(pick):
            self.since = np.where(self.since >= 0, np.minimum(self.since, lead[-1]), -1)
            return none
        first = first[pick]
        order = np.argsort(first, kind="stable")
        at, first = pick[order], first[order]
        head = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
        symbols = first[head]
        least = np.empty(len(at), np.int64)
        inner = np.ones(len(at), bool)
        inner[head] = False
        inner = np.flatnonzero(inner)
        least[inner] = _range_min(common, at[inner - 1] + 1, at[inner] + 1)
        carried = self.since[symbols]
        least[head] = np.where(carried < 0, -1, np.minimum(carried, lead[at[head]]))
        value = np.minimum(least + 1, self.depth).astype(np.uint8)
        tail = np.minimum.accumulate(common[::-1])[::-1]
        end = np.append(head[1:], len(at)) - 1
        after = at[end] + 1
        self.since = np.where(self.since >= 0, np.minimum(self.since, lead[-1]), -1)
        self.since[symbols] = np.where(after < len(common), tail[np.minimum(after, len(common) - 1)], FAR)
        position = before[at].astype(np.int32)
        now = none
        for s, a, b in zip(symbols.tolist(), head.tolist(), (end + 1).tolist()):
            if s == symbol:
                now = position[a:b], value[a:b]
            else:
                self.queue.push(s, position[a:b], value[a:b])
        return now

    def rounds(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """All queued tuples of a symbol, and those that they induce for the same symbol."""
        found = [self.queue.pop(symbol)]
        while len(found[-1][0]):
            found.append(self.induce(*found[-1], symbol))
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _words(text: np.ndarray) -> np.ndarray:
    """At each place the next 8 symbols as one big-endian number."""
    padded = np.concatenate([text, np.zeros(7, np.uint8)])
    two = padded[:-1].astype(np.uint16) << np.uint16(8) | padded[1:]
    four = two[:-2].astype(np.uint32) << np.uint32(16) | two[2:]
    return four[:-4].astype(np.uint64) << np.uint64(32) | four[4:]


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, head): the keys' stable order, and where in it another key begins. Keys are below 2**bits."""
    own = len(key).bit_length()
    if bits + own <= 64:  # place and key in one number: sorting numbers is several times as fast as sorting places
        packed = key.astype(np.uint64) << np.uint64(own)
        packed |= np.arange(len(key), dtype=np.uint64)
        packed.sort()
        order = (packed & np.uint64((1 << own) - 1)).astype(np.int64)
        packed >>= np.uint64(own)
    else:
        order = np.argsort(key, kind="stable")
        packed = key[order]
    head = np.ones(len(key), bool)
    np.not_equal(packed[1:], packed[:-1], out=head[1:])
    return order, head


def _dense(key: np.ndarray, bits: int) -> np.ndarray:
    """Ranks of the keys, equal for equal ones, without gaps."""
    order, head = _sorted(key, bits)
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(head) - 1
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers in the order of the pairs (a, b) of nonnegative numbers, and their bits."""
    low, high = int(b.max(initial=0)).bit_length(), int(a.max(initial=0)).bit_length()
    return a << low | b, low + high


def _names(word: np.ndarray, start: np.ndarray, length: np.ndarray, depth: int) -> tuple[np.ndarray, int]:
    """Numbers in the order of the LMS substrings, and their bits; equal ones (up to depth) get one name.

    What follows a substring's end counts as larger than any symbol: where
    one goes on longer, its next symbol is of the falling kind. Symbols are
    looked at by fives, from the last to the first.
    """
    length = np.minimum(length, depth + 8)
    blocks = int(length.max(initial=1) - 1) // 5 + 1

    def column(b: int, at: np.ndarray) -> np.ndarray:
        left = np.clip(length[at] - 5 * b, 0, 5)
        ones = (np.uint64(1) << ((5 - left) * 8).astype(np.uint64)) - np.uint64(1)
        return word[np.minimum(start[at] + 5 * b, len(word) - 1)] >> np.uint64(24) | ones

    rest = np.zeros(len(start), np.int64)
    for b in range(blocks - 1, 0, -1):
        at = np.flatnonzero(length >= 5 * b)
        rest[at] = 1 + _dense(*_pair(_dense(column(b, at), 40), rest[at]))
    return _pair(_dense(column(0, np.arange(len(start))), 40), rest)


def _order_names(name: np.ndarray, bits: int, start: np.ndarray, depth: int) -> np.ndarray:
    """Order of the name string's suffixes by their first `depth` symbols, by doubling.

    Only names that are still tied, and whose common names have fewer symbols
    than depth, go on. start: the place of each name's first symbol.
    """
    n, done = len(name), 1
    order, head = _sorted(name, bits)
    rank = np.empty(n, np.int64)
    at = np.arange(n)  # places in the order that are looked at; each group of ties has all its places here
    rank[order] = np.maximum.accumulate(np.where(head, at, 0))
    while True:
        tied = ~(head & np.append(head[1:], True))
        at, head = at[tied], head[tied]
        who = order[at]
        there = who + done
        short = np.append(start, start[-1:] + depth)[np.minimum(there, n)] - start[who] < depth
        at, head, who, there = at[short], head[short], who[short], there[short]
        if not len(at):
            return order
        after = np.append(rank + 1, 0)[np.minimum(there, n)]
        moved, new = _sorted(*_pair(np.cumsum(head) - 1, after))
        order[at] = who[moved]
        rank[order[at]] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        head, done = new, 2 * done


def _common(word: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of pairs of places, up to depth."""
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    for t in range(0, depth + 7, 8):
        inside = (a[live] + t < len(word)) & (b[live] + t < len(word))
        live = live[inside]
        x = word[a[live] + t] ^ word[b[live] + t]
        same = x == 0
        out[live[same]] = t + 8
        differ = live[~same]
        # equal leading bytes: the difference's top bit
        top = np.frexp((x[~same] >> np.uint64(8)).astype(np.float64))[1]
        lead = np.where(x[~same] >> np.uint64(8) == 0, 7, 6 - (top - 1) // 8)
        out[differ] = t + lead
        live = live[same]
    return np.minimum(out, depth)


def sorted_suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): suffixes in order of their first `depth` symbols, and common prefixes with the one before.

    text: uint8, its symbols below FAR and its last symbol smaller than all others.
    """
    n = len(text)
    step = np.sign(text[1:].astype(np.int16) - text[:-1])
    place = np.where(step != 0, np.arange(n - 1), n)
    place = np.minimum.accumulate(place[::-1])[::-1] if n > 1 else place
    rising = np.ones(n, bool)
    rising[:-1] = np.where(place < n, step[np.minimum(place, n - 2)] > 0, False)

    def run(i: int) -> int:
        """How often a suffix's first symbol repeats."""
        return min(int(place[i]) + 1 - i, n - i, depth) if i < n - 1 else 1

    low = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    word = _words(text)
    length = np.append(np.diff(low) + 1, 1) if len(low) else low
    order = low[_order_names(*_names(word, low, length, depth), low, depth)] if len(low) else low
    common = np.zeros(len(order), np.uint8)
    common[1:] = _common(word, order[:-1], order[1:], depth)
    symbols = np.flatnonzero(np.bincount(text, minlength=256))
    low_cut = np.searchsorted(text[order], np.arange(257))
    del word

    falls: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    sweep = _Sweep(text, ~rising, depth)
    for s in symbols.tolist():
        falls[s] = sweep.rounds(s)
        p, c = order[low_cut[s] : low_cut[s + 1]], common[low_cut[s] : low_cut[s + 1]].copy()
        if len(p):
            c[0] = min(run(int(falls[s][0][-1])), run(int(p[0]))) if len(falls[s][0]) else 0
            sweep.induce(p, c, s)
    sweep.queue.close()

    parts: list[tuple[np.ndarray, np.ndarray]] = []
    sweep = _Sweep(text, rising, depth)
    for s in symbols.tolist()[::-1]:
        up, up_common = sweep.rounds(s)
        if s == text[-1]:
            up, up_common = np.append(up, n - 1).astype(np.int32), np.append(up_common, 0).astype(np.uint8)
        p, c = falls.pop(s)
        border = min(run(int(up[-1])), run(int(p[-1]))) if len(up) and len(p) else 0
        if len(p):
            back = np.append(border, c[::-1][:-1]).astype(np.uint8)
            sweep.induce(p[::-1], back, s)
        here = np.append(border, up_common[::-1][:-1]).astype(np.uint8) if len(up) else up_common
        parts.append((np.concatenate([p, up[::-1]]), np.concatenate([c, here])))
    sweep.queue.close()
    return np.concatenate([x[0] for x in parts[::-1]]), np.concatenate([x[1] for x in parts[::-1]])
