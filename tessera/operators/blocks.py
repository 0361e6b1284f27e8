"""Ratings packed into a grid of tasks, to which factors are sent.

A task has the ratings of one block of own ids with one block of other ids, as
arrays. In a step the factors go to the tasks that need them, packed as bytes,
so nothing is shuffled for each rating; a task adds up its ratings' statistics
for each own id, and what several tasks found is added by the ids' home block.
An own id with more than HOT ratings is dealt over all blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stored

#: Ratings of a task, bytes of the other side's factors that it holds, and ratings beyond which an id's are dealt out; about.
TASK, HELD, HOT = 1 << 20, 32 << 20, 1 << 18
#: Ratings whose statistics are in memory at once.
CHUNK = 8192

PACKED = "home int, hot boolean, column int, ids binary, f binary, note binary"
PARTS = "home int, ids binary, s binary, n binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64 of each number."""
    x = np.asarray(x).astype(np.int64, copy=False).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Place:
    """Where a side's ids are: home blocks in the grid of its own, columns in the other side's grid; hot ids are in all blocks."""

    homes: int
    columns: int
    hot: np.ndarray

    def home(self, ids: np.ndarray) -> np.ndarray:
        return (mixed(ids) % np.uint64(self.homes)).astype(np.int32)

    def column(self, ids: np.ndarray) -> np.ndarray:
        return (mixed(ids) % np.uint64(self.columns)).astype(np.int32)


def places(counts: list[DataFrame], n: int, widths: list[int], cores: int) -> list[Place]:
    """Of both sides, given their numbers of ratings (id, n) and the widths of their factors."""
    columns = [max(1, -(-c.count() * 8 * w // HELD)) for c, w in zip(counts, widths)]
    hot = [np.array(sorted(r.id for r in c.filter(F.col("n") > HOT).select("id").collect()), np.int64) for c in counts]
    return [Place(max(1, -(-max(2 * cores, -(-n // TASK)) // columns[1 - i])), columns[i], hot[i]) for i in range(2)]


def _split(keys: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order by key, and each key's slice of it."""
    order = np.argsort(keys, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0)) if len(keys) else np.array([], int)
    ends = np.append(heads[1:], len(keys))
    return order, [(int(keys[order[a]]), slice(a, b)) for a, b in zip(heads, ends)]


def packed(place: Place, ids: np.ndarray, f: np.ndarray, note: bytes | None = None) -> pa.Table:
    """Rows PACKED of factors."""
    hot, home, column = np.isin(ids, place.hot), place.home(ids), place.column(ids)
    order, slices = _split((home.astype(np.int64) * 2 + hot) * place.columns + column)
    ids, f, rows = ids[order], np.ascontiguousarray(f[order], float), []
    for i, (key, s) in enumerate(slices):
        rows.append((key // place.columns // 2, bool(key // place.columns % 2), key % place.columns, ids[s].tobytes(), f[s].tobytes(), note if i == 0 else None))
    kinds = [pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in PACKED.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _joined(column: pa.ChunkedArray, kind=np.int64) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column]) if len(column) else np.array([], kind)


def unpacked(table: pa.Table, ids: str = "ids", f: str = "f") -> tuple[np.ndarray, np.ndarray]:
    found = _joined(table.column(ids))
    return found, _joined(table.column(f), float).reshape(len(found), -1)


def _at(wanted: np.ndarray, ids: np.ndarray, f: np.ndarray) -> np.ndarray:
    """f of the wanted ids."""
    order = np.argsort(ids, kind="stable")
    return f[order[np.searchsorted(ids, wanted, sorter=order)]]


def _filled(wanted: np.ndarray, rows: pa.Table) -> np.ndarray:
    """Factors of the wanted ids, which are in order, from rows of ids and f, without a copy of all."""
    out = None
    for ids, f in zip(rows.column("ids"), rows.column("f")):
        ids = np.frombuffer(ids.as_buffer(), np.int64)
        f = np.frombuffer(f.as_buffer(), float).reshape(len(ids), -1)
        out = np.empty((len(wanted), f.shape[1])) if out is None else out
        at = np.minimum(np.searchsorted(wanted, ids), len(wanted) - 1)
        of = np.flatnonzero(wanted[at] == ids)
        out[at[of]] = f[of]
    return out


def factors(rows: DataFrame, place: Place) -> DataFrame:
    """Rows PACKED of id, f."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                f = batch.column("f").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield from packed(place, batch.column("id").to_numpy().astype(np.int64), f).to_batches()

    return rows.select("id", "f").mapInArrow(run, PACKED)


def listed(rows: DataFrame) -> DataFrame:
    """id, f of rows PACKED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, f = unpacked(pa.Table.from_batches([batch.slice(i, 1)]))
                for a in range(0, len(ids), 10_000):
                    x = f[a : a + 10_000]
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 10_000]), lists], names=["id", "f"])

    return rows.mapInArrow(run, "id long, f array<double>")


class Grid:
    """ratings (own, other, rating, ...) as a table of tasks; columns: the other columns that statistics need, as doubles."""

    def __init__(self, ratings: DataFrame, own: str, other: str, columns: list[str], place: Place, across: Place):
        self.place, self.across, self.columns = place, across, columns
        k = across.columns

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = (batch.column(c).to_numpy().astype(np.int64) for c in ("_own", "_other"))
                row, hot = place.home(a), np.isin(a, place.hot)
                row[hot] = place.home((mixed(a[hot]) ^ mixed(b[hot]) << np.uint64(1)).view(np.int64))
                order, slices = _split(row.astype(np.int64) * k + across.column(b))
                x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], axis=1)[order]
                a, b = a[order], b[order]
                if slices:
                    yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in slices], pa.int32()), *(pa.array([y[s].tobytes() for _, s in slices], pa.binary()) for y in (a, b, x))], names=["task", "own", "other", "x"])

        def seal(key: tuple, table: pa.Table) -> pa.Table:
            a, b, x = _joined(table.column("own")), _joined(table.column("other")), _joined(table.column("x"), float).reshape(-1, len(columns))
            order = np.argsort(a, kind="stable")
            ids, n = np.unique(a, return_counts=True)
            others, at = np.unique(b[order], return_inverse=True)
            parts = ids, n.astype(np.int64), others, at.astype(np.int32), np.ascontiguousarray(x[order].T)
            return pa.table([pa.array([key[0].as_py()], pa.int32()), *(pa.array([y.tobytes()], pa.binary()) for y in parts)], names=["task", "ids", "n", "others", "at", "x"])

        rows = ratings.select(F.col(own).cast("long").alias("_own"), F.col(other).cast("long").alias("_other"), *(F.col(c).cast("double").alias(c) for c in columns)).filter("_own IS NOT NULL AND _other IS NOT NULL")
        dealt = rows.mapInArrow(deal, "task int, own binary, other binary, x binary")
        self.stored = Stored(dealt.groupBy("task").applyInArrow(seal, "task int, ids binary, n binary, others binary, at binary, x binary"))

    def run(self, own: DataFrame | None, other: DataFrame, work: Callable, schema: str, part: tuple[int, int] = (0, 1)) -> DataFrame:
        """Of the part-th of so many parts of the home blocks, work(ids, numbers of ratings, own factors or None, other factors, place of each rating's other, columns) -> a table, of each task."""
        g, k, columns, both = self.place.homes, self.across.columns, self.columns, own is not None
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        sent = other.withColumn("_g", every(g)).select((F.col("_g") * k + F.col("column")).cast("int").alias("task"), F.lit(True).alias("across"), "ids", "f")
        if own is not None:
            home = own.filter("NOT hot").withColumn("_k", every(k)).select((F.col("home") * k + F.col("_k")).cast("int").alias("task"), F.lit(False).alias("across"), "ids", "f")
            sent = sent.union(home)
            if len(self.place.hot):
                sent = sent.union(own.filter("hot").withColumn("task", every(g * k)).select("task", F.lit(False).alias("across"), "ids", "f"))
        mine = F.floor(F.col("task") / k) % part[1] == part[0]

        def one(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return None
            (ids, n, others), at = (_joined(left.column(c)) for c in ("ids", "n", "others")), _joined(left.column("at"), np.int32)
            x = _joined(left.column("x"), float).reshape(len(columns), -1)
            across = right.column("across")
            f = _filled(ids, right.filter(pa.compute.invert(across)).select(["ids", "f"])) if both else None
            return work(ids, n, f, _filled(others, right.filter(across).select(["ids", "f"])), at, dict(zip(columns, x)))

        empty = pa.schema([(c.split()[0], {"int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}[c.split()[1]]) for c in schema.split(", ")]).empty_table()
        return self.stored.df.filter(mine).groupBy("task").cogroup(sent.filter(mine).groupBy("task")).applyInArrow(lambda key, left, right: x if (x := one(key, left, right)) is not None else empty, schema)

    def sums(self, own: DataFrame | None, other: DataFrame, gather: Callable, key: str | None = None, part: tuple[int, int] = (0, 1)) -> DataFrame:
        """Rows PARTS: gather(own, other, rows) added up for each own id within each task, or for each value of the column key."""
        place = self.place

        def work(ids, n, f, g, at, x):
            of = np.repeat(np.arange(len(ids)), n)
            if key is not None:
                to, by = np.unique(x[key].astype(np.int64), return_inverse=True)
            else:
                to, by = ids, of
            total, size = None, np.bincount(by, minlength=len(to))
            for a in range(0, len(at), CHUNK):
                cut = slice(a, a + CHUNK)
                s = gather(f[of[cut]] if f is not None else None, g[at[cut]], pd.DataFrame({c: y[cut] for c, y in x.items()}, copy=False))
                total = np.zeros((len(to), s.shape[1])) if total is None else total
                b = by[cut]
                if key is not None:
                    order = np.argsort(b, kind="stable")
                    b, s = b[order], s[order]
                head = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
                total[b[head]] += np.add.reduceat(s, head, axis=0)
            order, slices = _split(place.home(to) if key is None else np.zeros(len(to), np.int32))
            if len(slices) > 1:
                to, total, size = to[order], total[order], size[order]
            size = size.astype(np.int64)
            return pa.table([pa.array([h for h, _ in slices], pa.int32()), *(pa.array([y[s].tobytes() for _, s in slices], pa.binary()) for y in (to, total, size))], names=["home", "ids", "s", "n"])

        return self.run(own, other, work, PARTS, part)

    def predictions(self, own: DataFrame, other: DataFrame, predict: Callable, part: tuple[int, int] = (0, 1)) -> DataFrame:
        """rating, prediction of each rating; predict(own, other, rows)."""

        def work(ids, n, f, g, at, x):
            of, out = np.repeat(np.arange(len(ids)), n), np.empty(len(at))
            for a in range(0, len(at), CHUNK):
                cut = slice(a, a + CHUNK)
                out[cut] = predict(f[of[cut]], g[at[cut]], pd.DataFrame({c: y[cut] for c, y in x.items()}, copy=False))
            return pa.table({"rating": pa.array(x["rating"]), "prediction": pa.array(out)})

        return self.run(own, other, work, "rating double, prediction double", part)


def applied(parts: DataFrame, own: DataFrame | None, place: Place, apply: Callable) -> DataFrame:
    """Rows PACKED of new factors: apply(ids, own factors or None, sums, numbers of ratings) -> factors, note."""

    def one(parts: pa.Table, right: pa.Table | None) -> pa.Table:
        if not parts.num_rows:
            return packed(place, np.array([], np.int64), np.empty((0, 0)))
        (ids, s), n = unpacked(parts, "ids", "s"), _joined(parts.column("n"))
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        head = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        ids, s, n = ids[head], np.add.reduceat(s[order], head, axis=0), np.add.reduceat(n[order], head)
        f, note = apply(ids, None if right is None else _at(ids, *unpacked(right)), s, n)
        return packed(place, ids, f, note)

    if own is None:
        return parts.groupBy("home").applyInArrow(lambda key, t: one(t, None), PACKED)
    return parts.groupBy("home").cogroup(own.groupBy("home")).applyInArrow(lambda key, left, right: one(left, right), PACKED)
