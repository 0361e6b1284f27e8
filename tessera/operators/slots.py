"""Factorization machines whose weights stay on the executors, a slot for every value of every categorical column.

Rows are packed once into tasks, as arrays with places in the task's own list
of values. Values live in home blocks by hash, with their weights and moments.
In a step homes send each task the weights of its values, and tasks send back
sums of gradients; both are packed as bytes (float32, weights themselves stay
doubles), so nothing is shuffled for each row. The driver holds a row for each block, and the weights
of numeric columns. Learning is Spark's FMRegressor's: all rows in each step,
squared loss, AdamW.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import rank_by
from ..session import Stored
from .blocks import mixed

#: Rows of a task, rows packed into one record, and values of a home block; about.
TASK, CHUNK, HOME = 1 << 18, 1 << 17, 1 << 16

SEALED = "block int, home int, at binary, x binary, y binary, codes binary, keys binary, sums binary, counts binary"
HOMES = "home int, block int, n int, places binary, codes binary, keys binary, means binary"
MOVED = "home int, block int, state binary, w binary"
SENT = "home int, block int, w binary"
MODEL = "home int, codes binary, keys binary, w binary"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = [(c.split()[0], {"int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[name for name, _ in kinds])


def _array(cell, kind=np.int64) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def _together(column: pa.ChunkedArray, kind=np.int64) -> np.ndarray:
    return np.concatenate([_array(x, kind) for x in column]) if len(column) else np.array([], kind)


def _hashed(codes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return mixed(keys ^ mixed(codes).view(np.int64))


def _values(t: pa.Table, width: int, homes: int):
    """Of a task's rows: each column's places in its list of values, the lists' codes, keys and bounds, an order by home, and the homes' bounds in it.

    A value's code is its column's number, or where it is null that and the number of columns.
    """
    places, codes, keys = [], [], []
    for c in range(width):
        column = t.column(f"_k{c}")
        null = column.is_null().to_numpy()
        found, at = np.unique(column.fill_null(0).to_numpy()[~null], return_inverse=True)
        place = np.full(len(null), len(found))
        place[~null] = at
        code = np.full(len(found), c)
        if null.any():
            found, code = np.append(found, 0), np.append(code, c + width)
        places.append(place.astype(np.int32))
        codes.append(code)
        keys.append(found.astype(np.int64))
    bounds = np.cumsum([0, *map(len, keys)])
    codes, keys = np.concatenate(codes).astype(np.int64), np.concatenate(keys)
    home = (_hashed(codes, keys) % np.uint64(homes)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    return places, codes, keys, bounds, order, np.searchsorted(home[order], np.arange(homes + 1))


def _drawn(codes: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
    """Weights to begin with: none, and factors from a normal draw (deviation 0.01) that depends on the value alone."""
    base, out = _hashed(codes, keys).view(np.int64), np.zeros((len(keys), size + 1))
    unit = lambda j: ((mixed(base ^ np.int64(j)) >> np.uint64(11)) + np.uint64(1)) / 2.0**53
    for j in range(size):
        out[:, j + 1] = 0.01 * np.sqrt(-2 * np.log(unit(2 * j + 5))) * np.cos(2 * np.pi * unit(2 * j + 6))
    return out


def _adam(w, m, v, g, step: int, rate: float, regularization: float):
    """A step of AdamW."""
    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
    return w - rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + regularization * w), m, v


def _scores(gathered: list[np.ndarray], x: np.ndarray, free: np.ndarray):
    """Predictions and the factors' sums; gathered: weights of each row's value, for each column; free: the constant, then numeric columns' weights."""
    total = x @ free[1:] if len(x.T) else np.zeros((len(x), free.shape[1]))
    squares = (x * x) @ (free[1:, 1:] ** 2).sum(1) if len(x.T) else np.zeros(len(x))
    for g in gathered:
        total += g
        squares += (g[:, 1:] ** 2).sum(1)
    s = total[:, 1:]
    return free[0, 0] + total[:, 0] + ((s * s).sum(1) - squares) / 2, s


class Linear:
    """How many weights there are, one for each value and numeric column."""

    def __init__(self, size: int):
        self.size = size


class SlotMachine:
    """Fitted by fit(rows, label); predicted(rows) adds prediction (of the label), known (the value of a column seen in fit) and mean."""

    def __init__(self, categorical: list[str], numeric: list[str], size: int, steps: int, regularization: float, rate: float = 0.05):
        self.categorical, self.numeric, self.size, self.steps, self.regularization, self.rate = categorical, numeric, size, steps, regularization, rate

    def keyed(self, rows: DataFrame) -> DataFrame:
        """rows with a number for each categorical value (-1: a text not seen in fit) and numbers as doubles."""
        for i, c in enumerate(self.categorical):
            if c in self.names:
                text = F.coalesce(F.col(c).cast("string"), F.lit(""))
                rows = rows.withColumn(f"_t{i}", text).join(self.names[c].df.select(F.col("_text").alias(f"_t{i}"), F.col("_n").cast("long").alias(f"_k{i}")), f"_t{i}", "left").drop(f"_t{i}").withColumn(f"_k{i}", F.coalesce(f"_k{i}", F.lit(-1).cast("long")))
            else:
                rows = rows.withColumn(f"_k{i}", F.col(c).cast("long"))
        return rows.withColumns({f"_x{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(self.numeric)})

    def _name(self, rows: DataFrame) -> None:
        """Columns of other types than whole numbers get a dictionary."""
        self.names = {}
        for c in self.categorical:
            if not isinstance(rows.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
                texts = rows.select(F.coalesce(F.col(c).cast("string"), F.lit("")).alias("_text")).distinct()
                self.names[c] = Stored(rank_by(texts, "_n", "_text"))

    def _dealt(self, keyed: DataFrame, n: int) -> DataFrame:
        """With _block: tasks by the first column's value, so that they share few of its values; common ones are dealt out."""
        blocks = max(1, min(2 * self.cores, -(-n // 1000)), -(-n // TASK))
        first = F.coalesce("_k0", F.lit(0).cast("long"))
        own = F.xxhash64(first)
        hot = [] if n < TASK else [r[0] for r in keyed.groupBy(first.alias("_f")).count().filter(F.col("count") > TASK // 8).select("_f").collect()]
        if hot:
            own = F.when(first.isin(hot), F.xxhash64(*(f"_k{i}" for i in range(len(self.categorical))))).otherwise(own)
        return keyed.withColumn("_block", F.pmod(own, F.lit(blocks)).cast("int"))

    def fit(self, rows: DataFrame, label: str) -> "SlotMachine":
        self.cores = rows.sparkSession.sparkContext.defaultParallelism
        self._name(rows)
        keyed = self.keyed(rows)
        steps, rate, regularization = self.steps, self.rate, self.regularization
        wide, numbers, size, width = len(self.categorical), len(self.numeric), self.size, self.size + 1
        n, labelled, *distinct = keyed.agg(F.count(F.lit(1)), F.count(label), *(F.approx_count_distinct(f"_k{i}") for i in range(wide))).first()
        if not n or labelled < n:
            raise ValueError("fit needs rows, and a label in each of them")
        homes = self.homes = max(1, min(2 * self.cores, -(-sum(distinct) // 1000)), -(-sum(distinct) // HOME))

        def seal(key: tuple, t: pa.Table) -> pa.Table:
            places, codes, keys, bounds, order, ends = _values(t, wide, homes)
            y = t.column("_y").to_numpy()
            x = np.stack([t.column(f"_x{i}").to_numpy() for i in range(numbers)]) if numbers else np.empty((0, len(y)))
            out, block = [], key[0].as_py()
            for a in range(0, len(y), CHUNK):
                cut = slice(a, a + CHUNK)
                out.append((block, -1, np.stack([p[cut] for p in places]).tobytes(), np.ascontiguousarray(x[:, cut]).tobytes(), y[cut].tobytes(), None, None, None, None))
            count = np.concatenate([np.bincount(p, minlength=b - a) for p, a, b in zip(places, bounds, bounds[1:])]).astype(np.int64)
            total = np.concatenate([np.bincount(p, y, minlength=b - a) for p, a, b in zip(places, bounds, bounds[1:])])
            for h in range(homes):
                o = order[ends[h] : ends[h + 1]]
                if len(o):
                    out.append((block, h, None, None, None, codes[o].tobytes(), keys[o].tobytes(), total[o].tobytes(), count[o].tobytes()))
            # the order by home, which the task needs to read what homes send
            out.append((block, -2, order.astype(np.int32).tobytes(), bounds.astype(np.int64).tobytes(), None, None, None, None, None))
            return _freed(_table(SEALED, out))

        columns = [f"_k{i}" for i in range(wide)] + [f"_x{i}" for i in range(numbers)]
        packed = self._dealt(keyed, n).select("_block", *columns, F.col(label).cast("double").alias("_y")).groupBy("_block").applyInArrow(seal, SEALED)
        sealed = Stored(packed)

        def settle(key: tuple, t: pa.Table) -> pa.Table:
            codes, keys = _together(t.column("codes")), _together(t.column("keys"))
            order = np.lexsort((keys, codes))
            a, b = codes[order], keys[order]
            head = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            place = np.empty(len(order), np.int32)
            place[order] = np.cumsum(head) - 1
            mean = np.bincount(place, _together(t.column("sums"), float)) / np.bincount(place, _together(t.column("counts")))
            home, at = key[0].as_py(), 0
            out = [(home, -1, int(head.sum()), None, a[head].tobytes(), b[head].tobytes(), mean.tobytes())]
            for block, cell in zip(t.column("block").to_pylist(), t.column("keys")):
                m = len(cell.as_buffer()) // 8
                out.append((home, block, m, place[at : at + m].tobytes(), None, None, None))
                at += m
            return _table(HOMES, out)

        settled = Stored(sealed.df.filter("home >= 0").select("home", "block", "codes", "keys", "sums", "counts").groupBy("home").applyInArrow(settle, HOMES))
        self.sizes = {r.home: r.n for r in settled.df.filter("block = -1").select("home", "n").collect()}
        routes = settled.df.filter("block >= 0").select("home", "block", "places")

        def sent(home: int, state: np.ndarray, routes: pa.Table) -> list[tuple]:
            w = state[0].astype(np.float32)
            return [(home, -1, state.tobytes(), None)] + [(home, b, None, w[_array(p, np.int32)].tobytes()) for b, p in zip(routes.column("block").to_pylist(), routes.column("places"))]

        def begin(key: tuple, t: pa.Table) -> pa.Table:
            mine = t.filter(pa.compute.equal(t.column("block"), -1))
            w = _drawn(_array(mine.column("codes")[0]), _array(mine.column("keys")[0]), size)
            routes = t.filter(pa.compute.greater_equal(t.column("block"), 0))
            return _table(MOVED, sent(key[0].as_py(), np.stack([w, np.zeros_like(w), np.zeros_like(w)]), routes))

        moved = Stored(settled.df.select("home", "block", "places", "codes", "keys").groupBy("home").applyInArrow(begin, MOVED))
        free = np.zeros((1 + numbers, width))  # the constant (its factors aren't used), then numeric columns
        free[1:] = _drawn(np.full(numbers, -1), np.arange(numbers), size)
        first, second = np.zeros_like(free), np.zeros_like(free)
        data = sealed.df.filter("home < 0").select("block", "home", "at", "x", "y")
        for step in range(1, steps + 1):  # each step's functions are run before the next begins

            def gradients(key: tuple, t: pa.Table, got: pa.Table) -> pa.Table:
                homes_, ends, w = _received(got, width)
                about = t.filter(pa.compute.equal(t.column("home"), -2))
                order, bounds = _array(about.column("at")[0], np.int32), _array(about.column("x")[0])
                mine = np.empty((len(order), width))
                mine[order] = w
                del w
                lists = [mine[a:b] for a, b in zip(bounds, bounds[1:])]
                sums, own = np.zeros_like(mine), np.zeros_like(free)
                rest = t.filter(pa.compute.equal(t.column("home"), -1))
                for at_, x_, y_ in zip(rest.column("at"), rest.column("x"), rest.column("y")):
                    y = _array(y_, float)
                    at, x = _array(at_, np.int32).reshape(wide, -1), _array(x_, float).reshape(numbers, len(y)).T
                    p, s = _scores([l[a] for l, a in zip(lists, at)], x, free)
                    e = 2 * (p - y)
                    parts = [e, *(e[:, None] * s).T]
                    for a, lo, hi in zip(at, bounds, bounds[1:]):
                        for j, part in enumerate(parts):
                            sums[lo:hi, j] += np.bincount(a, part, minlength=hi - lo)
                    own[0, 0] += e.sum()
                    for i in range(numbers):
                        xe = x[:, i] * e
                        own[i + 1, 0] += xe.sum()
                        own[i + 1, 1:] += xe @ s - (x[:, i] @ xe) * free[i + 1, 1:]
                sums[:, 1:] -= sums[:, :1] * mine[:, 1:]  # a value's factors are in its rows' sums
                g = sums[order].astype(np.float32)
                block = key[0].as_py()
                return _freed(_table(SENT, [(-1, block, own.tobytes())] + [(h, block, g[a:b].tobytes()) for h, a, b in zip(homes_, ends, ends[1:])]))

            back = Stored(data.groupBy("block").cogroup(moved.df.filter("block >= 0").select("block", "home", "w").groupBy("block")).applyInArrow(gradients, SENT))
            g = sum(np.frombuffer(bytes(r.w), float).reshape(free.shape) for r in back.df.filter("home = -1").select("w").collect()) / n

            def turn(key: tuple, t: pa.Table, came: pa.Table) -> pa.Table:
                w, m, v = _array(t.filter(t.column("state").is_valid()).column("state")[0], float).reshape(3, -1, width)
                routes = t.filter(t.column("places").is_valid()).sort_by("block")
                came = came.sort_by("block")
                total = np.zeros_like(w)
                for p, c in zip(routes.column("places"), came.column("w")):
                    total[_array(p, np.int32)] += _array(c, np.float32).reshape(-1, width)
                state = np.stack(_adam(w, m, v, total / n, step, rate, regularization))
                return _table(MOVED, sent(key[0].as_py(), state, routes if step < steps else routes.slice(0, 0)))

            kept = moved.df.filter("block = -1").select("home", F.lit(-1).alias("block"), F.lit(None).cast("binary").alias("places"), "state").unionByName(routes.withColumn("state", F.lit(None).cast("binary")))
            after = Stored(kept.groupBy("home").cogroup(back.df.filter("home >= 0").groupBy("home")).applyInArrow(turn, MOVED))
            free, first, second = _adam(free, first, second, g, step, rate, regularization)
            moved.drop()
            back.drop()
            moved = after
        sealed.drop()

        def close(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
            w = _array(b.column("state")[0], float).reshape(3, -1, width)[0]
            mean = _array(a.column("means")[0], float)
            return _table(MODEL, [(key[0].as_py(), a.column("codes")[0].as_py(), a.column("keys")[0].as_py(), np.column_stack([w, mean]).tobytes())])

        values = settled.df.filter("block = -1").select("home", "codes", "keys", "means")
        self.free, self.weights = free, Stored(values.groupBy("home").cogroup(moved.df.filter("block = -1").select("home", "state").groupBy("home")).applyInArrow(close, MODEL))
        moved.drop()
        settled.drop()
        self.linear = Linear(sum(self.sizes.values()) + numbers)
        return self

    def predicted(self, rows: DataFrame, known: str | None = None, mean: str | None = None) -> DataFrame:
        """rows with _p; with the names of two categorical columns also _known (seen in fit, not null) and _mean (the label's, of that column's value; null where not seen)."""
        wide, numbers, width, homes, free = len(self.categorical), len(self.numeric), self.size + 1, self.homes, self.free
        keyed = self.keyed(rows)
        dealt = self._dealt(keyed, keyed.count())
        columns = rows.columns
        user, item = (None if c is None else self.categorical.index(c) for c in (known, mean))

        def need(key: tuple, t: pa.Table) -> pa.Table:
            _, codes, keys, _, order, ends = _values(t, wide, homes)
            cuts = [(h, order[a:b]) for h, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
            return _table("home int, block int, codes binary, keys binary", [(h, key[0].as_py(), codes[o].tobytes(), keys[o].tobytes()) for h, o in cuts])

        def answer(key: tuple, t: pa.Table, asked: pa.Table) -> pa.Table:
            out = []
            if t.num_rows:
                codes, keys = _array(t.column("codes")[0]), _array(t.column("keys")[0])
                w = _array(t.column("w")[0], float).reshape(-1, width + 1)
            for b, c, k in zip(asked.column("block").to_pylist(), asked.column("codes"), asked.column("keys")):
                c, k = _array(c), _array(k)
                f = np.full((len(k), width + 1), np.nan)
                if t.num_rows:
                    for code in np.unique(c):
                        lo, hi = np.searchsorted(codes, code), np.searchsorted(codes, code, "right")
                        of = np.flatnonzero(c == code)
                        if hi > lo:
                            at = lo + np.minimum(np.searchsorted(keys[lo:hi], k[of]), hi - lo - 1)
                            hit = keys[at] == k[of]
                            f[of[hit]] = w[at[hit]]
                out.append((key[0].as_py(), b, f.tobytes()))
            return _table(SENT, out)

        def score(key: tuple, t: pa.Table, got: pa.Table) -> pa.Table:
            places, codes, _, bounds, order, _ = _values(t, wide, homes)
            f = np.empty((len(order), width + 1))
            f[order] = _received(got, width + 1, float)[2]
            absent = np.isnan(f[:, 0])
            f[absent, :width] = 0
            w = f[:, :width]
            x = np.stack([t.column(f"_x{i}").to_numpy() for i in range(numbers)], axis=1) if numbers else np.empty((t.num_rows, 0))
            p = np.empty(t.num_rows)
            for a in range(0, len(p), CHUNK):
                cut = slice(a, a + CHUNK)
                p[cut] = _scores([w[lo:hi][q[cut]] for q, lo, hi in zip(places, bounds, bounds[1:])], x[cut], free)[0]
            out = t.select(columns).append_column("_p", pa.array(p))
            if user is not None:
                seen = (~absent & (codes < wide))[bounds[user] : bounds[user + 1]][places[user]]
                means = np.where(codes < wide, f[:, width], np.nan)[bounds[item] : bounds[item + 1]][places[item]]
                out = out.append_column("_known", pa.array(seen)).append_column("_mean", pa.array(means, from_pandas=True))
            return _freed(out)

        schema = T.StructType([*rows.schema.fields, T.StructField("_p", T.DoubleType())])
        if user is not None:
            schema = schema.add("_known", "boolean").add("_mean", "double")
        needs = dealt.select("_block", *(f"_k{i}" for i in range(wide))).groupBy("_block").applyInArrow(need, "home int, block int, codes binary, keys binary")
        answers = self.weights.df.groupBy("home").cogroup(needs.groupBy("home")).applyInArrow(answer, SENT)
        return dealt.groupBy("_block").cogroup(answers.withColumnRenamed("block", "_block").groupBy("_block")).applyInArrow(score, schema)

    def places(self) -> DataFrame:
        """code, key, place of every value."""
        start, at = {}, 0
        for h in sorted(self.sizes):
            start[h], at = at, at + self.sizes[h]

        def run(batches):
            for batch in batches:
                for h, c, k in zip(batch.column("home").to_pylist(), batch.column("codes"), batch.column("keys")):
                    c, k = _array(c), _array(k)
                    for a in range(0, len(k), 10_000):
                        s = slice(a, a + 10_000)
                        yield pa.RecordBatch.from_arrays([pa.array(c[s]), pa.array(k[s]), pa.array(np.arange(len(k))[s] + start[h])], names=["code", "key", "place"])

        return self.weights.df.select("home", "codes", "keys").mapInArrow(run, "code long, key long, place long")


def _freed(made: pa.Table) -> pa.Table:
    """made, once memory that its task has no more use for is given back; the worker goes on to other tasks."""
    pa.default_memory_pool().release_unused()
    return made


def _received(got: pa.Table, width: int, kind=np.float32):
    """Homes in order, their bounds, and what they sent."""
    got = got.sort_by("home")
    parts = [_array(x, kind).reshape(-1, width) for x in got.column("w")]
    return got.column("home").to_pylist(), np.cumsum([0, *map(len, parts)]), np.concatenate(parts)
