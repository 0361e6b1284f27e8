"""Stateful flow operators: meters, early drop, reordering, fragments, affinity.

Order-dependent operators read each flow in order: rows are dealt by flow,
sorted within partitions (on disk where needed) and streamed, so only the
current flow's few counters are in memory, however long a flow is.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GREEN, YELLOW, RED = 0, 1, 2


@dataclass
class SingleRate:
    """Two buckets, both filled at the committed rate: green from C, yellow from E."""

    rate: int  # bytes a period
    period: int  # microseconds
    cbs: int
    ebs: int
    aware: bool = False

    def __post_init__(self):
        self.time = self.tc = self.te = None

    def reset(self, now: int) -> None:
        self.time, self.tc, self.te = now, self.cbs, self.ebs

    def colour(self, now: int, length: int, given: int) -> int:
        n = (now - self.time) // self.period
        self.time += n * self.period
        self.tc = min(self.cbs, self.tc + n * self.rate)
        self.te = min(self.ebs, self.te + n * self.rate)
        if self.tc >= length and (not self.aware or given == GREEN):
            self.tc -= length
            return GREEN
        if self.te >= length and (not self.aware or given != RED):
            self.te -= length
            return YELLOW
        return RED


@dataclass
class TwoRate:
    """A committed and a peak bucket: red if the peak lacks tokens, yellow if only the committed one does."""

    rate: int
    period: int
    peak_rate: int
    peak_period: int
    cbs: int
    pbs: int
    aware: bool = False

    def reset(self, now: int) -> None:
        self.time = self.peak_time = now
        self.tc, self.tp = self.cbs, self.pbs

    def colour(self, now: int, length: int, given: int) -> int:
        n, m = (now - self.time) // self.period, (now - self.peak_time) // self.peak_period
        self.time += n * self.period
        self.peak_time += m * self.peak_period
        self.tc = min(self.cbs, self.tc + n * self.rate)
        self.tp = min(self.pbs, self.tp + m * self.peak_rate)
        if self.tp < length or (self.aware and given == RED):
            return RED
        self.tp -= length
        if self.tc < length or (self.aware and given == YELLOW):
            return YELLOW
        self.tc -= length
        return GREEN


def _by_flow(packets: DataFrame, flow: str, order: list[str], columns: list[str], start: Callable[[], Callable], schema: str) -> DataFrame:
    """Streams each flow in order.

    start() gives a function from (first of its flow?, the row's columns) to
    an output row. Batches go from Arrow to lists and back, column by column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, current = start(), object()
        for batch in batches:
            out = []
            for key, *values in zip(*(batch.column(c).to_pylist() for c in [flow, *columns])):
                out.append(step(key != current, *values))
                current = key
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

    fields = [x.strip().split(" ") for x in schema.split(",")]
    names, types = [f[0] for f in fields], [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}[f[1]] for f in fields]
    return packets.repartition(flow).sortWithinPartitions(flow, *order).mapInArrow(run, schema)


def meter(packets: DataFrame, make: Callable[[], SingleRate | TwoRate]) -> DataFrame:
    """event_id, flow, len, new_colour of packets (event_id, flow, time in microseconds, len, colour)."""

    def start():
        m = make()

        def step(first, event_id, flow, time, length, colour):
            if first:
                m.reset(time)
            return event_id, flow, length, m.colour(time, length, colour)

        return step

    columns = ["event_id", "flow", "time", "len", "colour"]
    return _by_flow(packets, "flow", ["time", "event_id"], columns, start, "event_id long, flow long, len long, new_colour int")


@dataclass(frozen=True)
class DropProfile:
    """Below low nothing is dropped, from high on all; between them the chance grows to most."""

    low: float
    high: float
    most: float


def _draw(number: int, seed: int) -> float:
    """A number in [0, 1) from a multiplicative hash, the same whenever it is drawn."""
    x = (number * 2654435761 + seed * 40503) % 4294967296
    x = (x ^ x >> 15) * 2246822519 % 4294967296
    return (x ^ x >> 13) / 4294967296


def early_drop(
    packets: DataFrame, low: float, high: float, most: float, weight: float = 0.002, drain: float = 1.0, seed: int = 0, colours: dict[int, DropProfile] | None = None
) -> DataFrame:
    """event_id, flow, average, dropped: random early detection on a queue of packets for each flow.

    The queue drains `drain` packets a second; while it is empty, the average
    decays as if that many small packets had come by. Between low and high
    the drop chance grows to `most`, more so the more packets passed since the
    last drop. Chances are drawn by a hash of seed and event_id. colours gives
    packets of a colour (a column then) a profile of their own.
    """
    usual = DropProfile(low, high, most)

    def start():
        s = {}

        def step(first, event_id, flow, time, colour):
            if first:
                s.update(q=0.0, avg=0.0, count=-1, time=time)
            drained = drain * (time - s["time"]) / 1e6
            idle = max(0.0, drained - s["q"])
            s["q"] = max(0.0, s["q"] - drained)
            s["time"] = time
            s["avg"] *= (1 - weight) ** idle
            s["avg"] += weight * (s["q"] - s["avg"])
            p = colours.get(colour, usual) if colours else usual
            drop = False
            if s["avg"] >= p.high:
                drop, s["count"] = True, 0
            elif s["avg"] > p.low:
                s["count"] += 1
                pb = p.most * (s["avg"] - p.low) / (p.high - p.low)
                pa_ = pb / max(1e-9, 1 - s["count"] * pb)
                if _draw(event_id, seed) < pa_:
                    drop, s["count"] = True, 0
            else:
                s["count"] = -1
            if not drop:
                s["q"] += 1
            return event_id, flow, s["avg"], drop

        return step

    if "colour" not in packets.columns:
        packets = packets.withColumn("colour", F.lit(0))
    return _by_flow(packets, "flow", ["time", "event_id"], ["event_id", "flow", "time", "colour"], start, "event_id long, flow long, average double, dropped boolean")


def lru_lookup(packets: DataFrame, buckets: int, size: int) -> DataFrame:
    """event_id, flow, hit: an exact table whose buckets hold `size` keys and evict the least recently used.

    A key that misses is entered. Keys are dealt to buckets by their number,
    and each bucket sees its packets in order of event_id.
    """

    def start():
        held: dict = {}

        def step(first, event_id, flow):
            if first:
                held.clear()
            hit = held.pop(flow, False)
            held[flow] = True  # the newest stands last
            if len(held) > size:
                del held[next(iter(held))]
            return event_id, flow, hit

        return step

    dealt = packets.withColumn("bucket", F.pmod(F.col("flow"), F.lit(buckets)))
    return _by_flow(dealt, "bucket", ["event_id"], ["event_id", "flow"], start, "event_id long, flow long, hit boolean")


def reorder(packets: DataFrame, size: int) -> DataFrame:
    """event_id, flow, seq, outcome of packets (event_id, flow, seq) in order of arrival (event_id).

    The first packet anchors a window of `size` numbers. Inside it a packet
    is kept; up to another `size` beyond, the window moves on; anything else
    (too early or late) is out of range.
    """

    def start():
        s = {}

        def step(first, event_id, flow, seq):
            if first:
                s["low"] = seq
            ahead = seq - s["low"]
            if 0 <= ahead < size:
                outcome = "kept"
            elif size <= ahead < 2 * size:
                s["low"] += ahead + 1 - size
                outcome = "moved"
            else:
                outcome = "range"
            return event_id, flow, seq, outcome

        return step

    return _by_flow(packets, "flow", ["event_id"], ["event_id", "flow", "seq"], start, "event_id long, flow long, seq long, outcome string")


def reorder_drain(packets: DataFrame) -> DataFrame:
    """event_id, flow, seq, place: packets of each flow in order of seq; the batch form."""
    return packets.withColumn("place", F.row_number().over(Window.partitionBy("flow").orderBy("seq", "event_id")).cast("long"))


def fragment(packets: DataFrame, mtu: int) -> DataFrame:
    """event_id, offset, size, more: pieces of at most mtu bytes (a multiple of 8)."""
    if mtu % 8:
        raise ValueError("fragments start at multiples of 8 bytes")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("len") - 1, F.lit(0)), F.lit(mtu).cast("long"))).alias("offset")
    out = packets.filter("len >= 0").select("event_id", "len", starts)
    return out.select("event_id", "offset", F.least(F.lit(mtu).cast("long"), F.col("len") - F.col("offset")).alias("size"), (F.col("offset") + mtu < F.col("len")).alias("more"))


def reassemble(fragments: DataFrame, key: str | list[str] = "event_id", timeout: int | None = None) -> DataFrame:
    """key, len, complete: whether the pieces (offset, size, more) cover the packet without a gap.

    key may be several columns, such as source, target and identification.
    With a timeout, pieces that come (column time) later than that after the
    packet's first piece don't count. Repeated pieces count once.
    """
    keys = [key] if isinstance(key, str) else list(key)
    pieces = fragments
    if timeout is not None:
        began = F.min("time").over(Window.partitionBy(*keys))
        pieces = pieces.withColumn("_late", F.col("time") - began > timeout).filter("NOT _late")
    pieces = pieces.select(*keys, "offset", "size", "more").distinct()
    before = F.coalesce(F.lag(F.col("offset") + F.col("size")).over(Window.partitionBy(*keys).orderBy("offset")), F.lit(0))
    joined = pieces.withColumn("fits", F.col("offset") == before)
    ends = F.max(F.when(~F.col("more"), F.col("offset") + F.col("size")))
    return joined.groupBy(*keys).agg(F.coalesce(ends, F.lit(-1)).alias("len"), (F.bool_and("fits") & ends.isNotNull()).alias("complete"))


@dataclass(frozen=True)
class Shaping:
    """Rates in bytes a second and bucket sizes in bytes: of the port, a subport, a pipe; and of a pipe's classes a period."""

    port_rate: float
    subport_rate: float
    subport_size: float
    pipe_rate: float
    pipe_size: float
    class_bytes: tuple[float, float, float, float]
    period: float = 0.04
    weights: tuple[int, int, int, int] = (1, 1, 1, 1)
    queue_limit: int = 64


class _Bucket:
    __slots__ = ("rate", "size", "tokens", "time")

    def __init__(self, rate: float, size: float):
        self.rate, self.size, self.tokens, self.time = rate, size, size, 0.0

    def fill(self, now: float) -> float:
        self.tokens = min(self.size, self.tokens + self.rate * (now - self.time))
        self.time = now
        return self.tokens


class _Least:
    """Numbers by place, infinite at first; next() finds the first place in turn whose number is small enough."""

    def __init__(self, n: int):
        self.half = 1 << max(n - 1, 0).bit_length()
        self.tree = [math.inf] * (2 * self.half)

    def put(self, i: int, x: float) -> None:
        tree, i = self.tree, i + self.half
        tree[i] = x
        while i > 1:
            i >>= 1
            least = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == least:
                return
            tree[i] = least

    def next(self, start: int, most: float) -> int | None:
        """The first place at or after start with a number up to most, else the first of all."""
        tree = self.tree
        if tree[1] > most:
            return None
        i = start + self.half
        if start < self.half and tree[i] > most:
            while i > 1 and (i & 1 or tree[i + 1] > most):  # up, until a right neighbour has one
                i >>= 1
            i = i + 1 if i > 1 else 1
        elif start >= self.half:
            i = 1
        while i < self.half:
            i = 2 * i if tree[2 * i] <= most else 2 * i + 1
        return i - self.half


class _Pipe:
    __slots__ = ("place", "sub", "local", "bucket", "period", "used", "version", "ready")

    def __init__(self, place: int, sub: int, local: int, shaping: Shaping):
        self.place, self.sub, self.local, self.bucket = place, sub, local, _Bucket(shaping.pipe_rate, shaping.pipe_size)
        self.period, self.used, self.version, self.ready = 0, [0.0] * 4, 0, [math.inf] * 4


def _port(shaping: Shaping, column: dict) -> np.ndarray:
    """When each packet of a port is sent, in seconds; not a number where the queue was full. Packets come in order of time.

    No pipe that can't send is asked: pipes whose own bucket and period allow a packet stand in their subport's tree by
    that packet's length; the others wait in a heap for the time from which they may. A step asks each subport once.
    Queues are chained lists, as most pipes have few packets.
    """
    lengths, times, lines = column["len"].tolist(), (column["time"] / 1e6).tolist(), (column["class"] * 4 + column["queue"]).tolist()
    n, sent = len(times), np.full(len(times), np.nan)
    pipes: list[_Pipe] = []
    numbers: dict = {}
    subs: dict = {}
    of: list[list[int]] = []  # the subports' pipes
    places = []
    for x in zip(column["subport"], column["pipe"]):  # pipes take turns in order of their first packets
        if x not in numbers:
            sub = subs.setdefault(x[0], len(subs))
            if sub == len(of):
                of.append([])
            numbers[x] = len(pipes)
            pipes.append(_Pipe(len(pipes), sub, len(of[sub]), shaping))
            of[sub].append(numbers[x])
        places.append(numbers[x])
    del numbers
    buckets, trees = [_Bucket(shaping.subport_rate, shaping.subport_size) for _ in of], [_Least(len(x)) for x in of]
    first, last, count, served, after = [-1] * (16 * len(pipes)), [-1] * (16 * len(pipes)), [0] * (16 * len(pipes)), [0.0] * (16 * len(pipes)), [-1] * n
    later: list[tuple] = []

    def head(p: _Pipe, tc: int) -> int | None:
        """The line of the queue of the class whose turn it is."""
        a = 16 * p.place + 4 * tc
        found = [(served[a + q] / shaping.weights[q], a + q) for q in range(4) if count[a + q]]
        return min(found)[1] if found else None

    def renew(p: _Pipe, now: float) -> None:
        period = int(now / shaping.period)
        if period != p.period:
            p.period, p.used = period, [0.0] * 4

    def look(p: _Pipe, now: float) -> None:
        """Where the pipe stands: in its tree if it may send but for its subport, and in the heap for what it may send later."""
        renew(p, now)
        room, p.version, p.ready = p.bucket.fill(now), p.version + 1, [math.inf] * 4
        for tc in range(4):
            line = head(p, tc)
            if line is None:
                continue
            length = lengths[first[line]]
            if p.used[tc] + length <= shaping.class_bytes[tc] and length <= room:
                p.ready[tc] = length
                continue
            if p.used[tc] + length > shaping.class_bytes[tc]:
                at = (p.period + 1) * shaping.period
            else:
                at = now + (length - room) / shaping.pipe_rate if shaping.pipe_rate else math.inf
            # rather a little early, so that rounding can't make it late
            heapq.heappush(later, (max(at - 1e-9 * at if at < math.inf else at, math.nextafter(now, math.inf)), p.place, p.version))
        trees[p.sub].put(p.local, min(p.ready))

    now, i, turn, waiting, known = 0.0, 0, 0, 0, 0
    while i < n or waiting:
        if not waiting:
            now = max(now, times[i])
        changed = set()
        while i < n and times[i] <= now:
            place = places[i]
            line = 16 * place + lines[i]
            known = max(known, place + 1)
            if count[line] < shaping.queue_limit:
                if count[line]:
                    after[last[line]] = i
                else:
                    first[line] = i
                    changed.add(place)
                last[line] = i
                count[line] += 1
                waiting += 1
            i += 1
        while later and later[0][0] <= now:
            _, place, version = heapq.heappop(later)
            if pipes[place].version == version:
                changed.add(place)
        for place in changed:
            look(pipes[place], now)
        found = None
        for own, tree, bucket in zip(of, trees, buckets):
            at = tree.next(bisect.bisect_left(own, turn), bucket.fill(now))
            if at is not None and (found is None or (own[at] - turn) % known < (found - turn) % known):
                found = own[at]
        if found is not None:
            p = pipes[found]
            renew(p, now)
            p.bucket.fill(now)
            tc = next(c for c in range(4) if p.ready[c] <= buckets[p.sub].tokens)
            line = head(p, tc)
            event = first[line]
            first[line], length = after[event], lengths[event]
            count[line] -= 1
            waiting -= 1
            served[line] += length
            p.used[tc] += length
            p.bucket.tokens -= length
            buckets[p.sub].tokens -= length
            turn = (found + 1) % known
            sent[event] = now
            look(p, now)
            now += length / shaping.port_rate
        elif waiting:
            # nothing may go: on to the next arrival, or a little later
            soon = now + shaping.period / 16
            now = min(soon, times[i]) if i < n else soon
    return sent


def hierarchical_schedule(packets: DataFrame, shaping: Shaping) -> DataFrame:
    """event_id, port, sent (seconds; null: dropped at the queue's limit) of packets (event_id, port, subport, pipe, class 0..3, queue 0..3, time in microseconds, len).

    A port sends one packet at a time at its rate. Pipes take turns; within a
    pipe the class of the smallest number goes first, and within a class the
    queues take turns by weight. A packet is sent only while its subport's and
    pipe's token buckets and its class's bytes of the period cover it; else
    the port looks further, and waits if nothing may go. A packet that no
    bucket can ever hold is dropped. Ports are
    independent; one port's packets stay in one task, as it is sequential.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("time", "ascending"), ("event_id", "ascending"), *((c, "ascending") for c in ("subport", "pipe", "class", "queue", "len"))])
        column = {c: table.column(c).to_numpy() if c not in ("subport", "pipe") else table.column(c).to_pylist() for c in table.column_names}
        sent = _port(shaping, column)
        return pa.table({"event_id": pa.array(column["event_id"], pa.int64()), "port": pa.array(np.full(len(sent), key[0].as_py()), pa.int64()), "sent": pa.array(sent, mask=np.isnan(sent))})

    room = F.least(F.lit(shaping.subport_size), F.lit(shaping.pipe_size), F.element_at(F.array(*map(F.lit, shaping.class_bytes)), F.col("class").cast("int") + 1))
    never = packets.filter(F.col("len") > room).select("event_id", "port", F.lit(None).cast("double").alias("sent"))
    return packets.filter(F.col("len") <= room).select("event_id", "port", "subport", "pipe", "class", "queue", "time", "len").groupBy("port").applyInArrow(run, "event_id long, port long, sent double").union(never)


def timer_expiries(timers: DataFrame, until: int) -> DataFrame:
    """timer, at: when timers (timer, start, period; null: once) go off, up to a time."""
    at = F.when(F.col("period").isNull(), F.array("start")).otherwise(F.sequence("start", F.greatest("start", F.lit(until)), "period"))
    return timers.select("timer", F.explode(at).alias("at")).filter(F.col("at") <= until)


def job_stats(runs: DataFrame, target: float | None = None) -> DataFrame:
    """job, runs, total, least, mean, most of runs (job, seconds); with a target, next_period.

    The next period is the mean time between runs (column period) scaled by
    how far the mean lies from the target, by a factor of at most 2 either way.
    """
    stats = [F.count(F.lit(1)).alias("runs"), F.sum("seconds").alias("total"), F.min("seconds").alias("least"), F.avg("seconds").alias("mean"), F.max("seconds").alias("most")]
    if target is not None:
        scale = F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.lit(float(target)) / F.nullif(F.avg("seconds"), F.lit(0.0))))
        stats.append((F.avg("period") * F.coalesce(scale, F.lit(2.0))).alias("next_period"))
    return runs.groupBy("job").agg(*stats)


def flow_affinity(packets: DataFrame, workers: int) -> DataFrame:
    """packets with the worker that all packets of a flow go to."""
    return packets.withColumn("worker", F.pmod(F.col("flow"), F.lit(workers)))


def approximate(alpha: float, error: float) -> tuple[int, int]:
    """p, q with the least q such that abs(alpha - p / q) < error, by walking the tree of fractions."""
    if not 0 <= alpha <= 1 or error <= 0:
        raise ValueError("alpha in 0..1 and a positive error are asked for")
    a, b, c, d = 0, 1, 1, 1
    for p, q in ((a, b), (c, d)):
        if abs(alpha - p / q) < error:
            return p, q
    while True:
        p, q = a + c, b + d
        if abs(alpha - p / q) < error:
            return p, q
        if p / q < alpha:
            a, b = p, q
        else:
            c, d = p, q
