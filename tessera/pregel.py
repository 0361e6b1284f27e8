"""Bulk-synchronous vertex programs on DataFrames.

A superstep joins edges with the senders' state, combines the messages for
each receiver (partial aggregates before the shuffle) and applies them. The
state of step t is a table that step t + 1 only reads, so a step sees exactly
the values of the step before.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import Graph
from .metrics import Metrics
from .session import cut


@dataclass
class IterationContext:
    """What a program's hooks are told, and the schedule they may change."""

    iteration: int
    num_iterations: int | None
    num_vertices: int | None = None
    last_iteration: int | None = None
    metrics: list[dict] = field(default_factory=list)
    #: The state after the last superstep.
    state: DataFrame | None = None
    #: Scheduled vertices (id) of this superstep and of the next; None is all.
    now: DataFrame | None = None
    coming: DataFrame | None = None

    def set_last_iteration(self, i: int) -> None:
        self.last_iteration = i

    def add_task(self, ids: DataFrame, also_this_iteration: bool = False) -> None:
        """Schedules vertices (id) for the next superstep, and for this one if asked before it starts."""
        ids = ids.select("id")
        self.coming = ids if self.coming is None else self.coming.union(ids)
        if also_this_iteration and self.now is not None:
            self.now = self.now.union(ids).distinct()

    def add_task_to_all(self) -> None:
        self.now = None

    def remove_tasks(self, low: int, high: int, vertices: DataFrame | None = None) -> None:
        """Takes vertices low <= id < high off this superstep; vertices tells who they all are where all are scheduled."""
        now = vertices.select("id") if self.now is None and vertices is not None else self.now
        if now is not None:
            self.now = now.filter((F.col("id") < low) | (F.col("id") >= high))

    def is_scheduled(self, vertex: int) -> bool:
        return self.now is None or not self.now.filter(F.col("id") == vertex).isEmpty()

    def num_tasks(self) -> int | None:
        """How many are scheduled; None is all."""
        return None if self.now is None else self.now.distinct().count()


class VertexProgram:
    """Override what the program needs; all but the hooks return Columns.

    State columns are those of init(). message() is over the sender's state
    and the edge; combine() is an aggregate over `message`; apply() gives new
    state columns from the old ones and `combined` (null without a message).
    """

    #: Messages go along out-edges; True sends them against edges as well.
    both_ways = False
    #: Only vertices that a hook has scheduled with add_task are updated after the first superstep.
    selective = False

    def init(self) -> dict[str, Column]:
        raise NotImplementedError

    def message(self) -> Column:
        raise NotImplementedError

    def sends(self) -> Column | None:
        """Which senders are scheduled; None is all."""
        return None

    def combine(self, message: Column) -> Column:
        return F.sum(message)

    def apply(self) -> dict[str, Column]:
        raise NotImplementedError

    def changed(self) -> Column | None:
        """Over state columns and old_<state> columns; None turns early stopping off."""
        return None

    def delta(self) -> Column | None:
        """How much a vertex has changed, over state and old_<state> columns; its sum goes to the log of each superstep."""
        return None

    def repeat_updates(self, context: IterationContext) -> bool:
        """True to run the superstep again before the iteration counts as done."""
        return False

    def before_iteration(self, iteration: int, context: IterationContext) -> None: ...

    def after_iteration(self, iteration: int, context: IterationContext) -> None: ...

    def before_exec_interval(self, low: int | None, high: int | None, context: IterationContext) -> None:
        """Before the updates of ids low..high; a superstep is one interval of all ids (None: no bound)."""

    def after_exec_interval(self, low: int | None, high: int | None, context: IterationContext) -> None: ...


def run(
    graph: Graph, program: VertexProgram, iterations: int | None, cut_every: int = 4, state: DataFrame | None = None, metrics: Metrics | None = None
) -> tuple[DataFrame, IterationContext]:
    """The state (id, ...) after `iterations` supersteps, or earlier when nothing changes; None goes on until then.

    Lineage is cut every few supersteps. Counting changes and deltas costs a
    pass, so it is only done where the program says what they are. A selective
    program ends when no vertex is scheduled. metrics, if given, gets the
    supersteps' times, changes and deltas.
    """
    if iterations is None and program.changed() is None and not program.selective:
        raise ValueError("without a number of iterations the program must say what has changed")
    context = IterationContext(0, iterations)
    edges = graph.edges
    if program.both_ways:
        edges = graph.both_ways()
    if state is None:
        state = graph.vertices.select("id", *[c.alias(k) for k, c in program.init().items()])
    columns = [c for c in state.columns if c != "id"]
    metrics = metrics if metrics is not None else Metrics("engine")
    for i in itertools.count() if iterations is None else range(iterations):
        context.iteration = i
        while True:
            program.before_iteration(i, context)
            program.before_exec_interval(None, None, context)
            with metrics.timed("superstep"):
                state, entry = _superstep(edges, state, columns, program, context, (i + 1) % cut_every == 0)
            context.metrics.append({"iteration": i, **entry})
            for key, value in entry.items():
                metrics.set_entry(key, len(context.metrics) - 1, value)
            program.after_exec_interval(None, None, context)
            if not program.repeat_updates(context):
                break
        if entry.get("changed") == 0:
            context.set_last_iteration(i)
        context.state = state
        program.after_iteration(i, context)
        if program.selective:
            context.now, context.coming = context.coming, None
            if context.now is None:
                break
            context.now = cut(context.now.distinct())
            if context.now.isEmpty():
                break
        if context.last_iteration is not None and i >= context.last_iteration:
            break
    metrics.set("iterations", context.iteration + 1)
    return state, context


def _superstep(edges: DataFrame, state: DataFrame, columns: list[str], program: VertexProgram, context: IterationContext, write: bool) -> tuple[DataFrame, dict]:
    """The new state, and what the program counts."""
    sender = state.withColumnRenamed("id", "src")
    active = program.sends()
    if active is not None:
        sender = sender.filter(active)
    sent = edges.join(sender, "src").select(F.col("dst").alias("id"), program.message().alias("message"))
    if program.selective and context.now is not None:
        sent = sent.join(context.now, "id", "left_semi")
    got = sent.groupBy("id").agg(program.combine(F.col("message")).alias("combined"))
    new, test, delta = program.apply(), program.changed(), program.delta()
    joined = state.join(got, "id", "left")
    watched = test is not None or delta is not None
    update = {c: new.get(c, F.col(c)) for c in columns}
    if program.selective and context.now is not None:
        joined = joined.join(context.now.withColumn("_due", F.lit(True)), "id", "left")
        update = {c: F.when(F.col("_due"), x).otherwise(F.col(c)) for c, x in update.items()}
    kept = [F.col(c).alias(f"old_{c}") for c in columns] if watched else []
    state = joined.select("id", *[x.alias(c) for c, x in update.items()], *kept)
    if watched or write:
        state = cut(state)
    entry = {}
    if watched:
        counts = [F.count_if(test).alias("changed")] if test is not None else []
        counts += [F.sum(delta).alias("delta"), F.count(F.lit(1)).alias("updates")] if delta is not None else []
        entry = state.agg(*counts).first().asDict()
        state = state.select("id", *columns)
    return state, entry


@dataclass
class GasProgram:
    """Gather, apply, scatter, over expressions.

    init: state columns. gather is over the edge's columns and the neighbour's
    state (named n_<state>) and own state; it is combined by plus. apply gives
    new state columns from the old ones and `combined`. scatter, over an edge
    and both ends' new state (s_<state>, d_<state>), gives new edge columns.
    signal, over a vertex's new and old_ state, tells whether its neighbours
    are updated next. Directions are "in", "out" or "all".
    """

    init: dict[str, Column]
    gather: Column
    apply: dict[str, Column]
    plus: Callable[[Column], Column] = F.sum
    gather_edges: str = "in"
    scatter: dict[str, Column] = field(default_factory=dict)
    scatter_edges: str = "out"
    signal: Column | None = None


def run_gas(graph: Graph, program: GasProgram, iterations: int) -> Graph:
    """The graph with the program's state on vertices and scattered values on edges; ends early when nobody is signalled."""
    edges = graph.edges
    state = cut(graph.vertices.select("id", *[c.alias(k) for k, c in program.init.items()]))
    names, due = list(program.init), None

    def towards(direction: str) -> DataFrame:
        """Edges with id (who is told) and other (who tells)."""
        ways = {"in": [("dst", "src")], "out": [("src", "dst")], "all": [("dst", "src"), ("src", "dst")]}[direction]
        parts = [edges.withColumns({"id": F.col(a), "other": F.col(b)}) for a, b in ways]
        return parts[0] if len(parts) == 1 else parts[0].union(parts[1])

    for _ in range(iterations):
        told = towards(program.gather_edges)
        if due is not None:
            told = told.join(due, "id", "left_semi")
        met = told.join(state.select(F.col("id").alias("other"), *[F.col(c).alias(f"n_{c}") for c in names]), "other").join(state, "id")
        total = met.groupBy("id").agg(program.plus(program.gather).alias("combined"))
        joined = state.join(total, "id", "left")
        update = {c: program.apply.get(c, F.col(c)) for c in names}
        if due is not None:
            joined = joined.join(due.withColumn("_due", F.lit(True)), "id", "left")
            update = {c: F.when(F.col("_due"), x).otherwise(F.col(c)) for c, x in update.items()}
        new = cut(joined.select("id", *[x.alias(c) for c, x in update.items()], *[F.col(c).alias(f"old_{c}") for c in names]))
        state = new.select("id", *names)
        if program.scatter:
            ends = edges.join(state.select(F.col("id").alias("src"), *[F.col(c).alias(f"s_{c}") for c in names]), "src")
            ends = ends.join(state.select(F.col("id").alias("dst"), *[F.col(c).alias(f"d_{c}") for c in names]), "dst")
            edges = cut(ends.withColumns(program.scatter).select(*edges.columns, *[c for c in program.scatter if c not in edges.columns]))
        if program.signal is not None:
            fresh = new.filter(program.signal).select(F.col("id").alias("other"))
            due = cut(towards({"in": "out", "out": "in", "all": "all"}[program.scatter_edges]).join(fresh, "other", "left_semi").select("id").distinct())
            if due.isEmpty():
                break
    return Graph(edges, state)


def aggregate_edges(graph: Graph, each: Column, total: Callable[[Column], Column] = F.sum, finalize: Callable | None = None):
    """One value over all edges with their ends' state (s_<column>, d_<column>): each is mapped, then combined, then finalized."""
    names = [c for c in graph.vertices.columns if c != "id"]
    ends = graph.edges.join(graph.vertices.select(F.col("id").alias("src"), *[F.col(c).alias(f"s_{c}") for c in names]), "src")
    ends = ends.join(graph.vertices.select(F.col("id").alias("dst"), *[F.col(c).alias(f"d_{c}") for c in names]), "dst")
    value = ends.agg(total(each)).first()[0]
    return finalize(value) if finalize else value


@dataclass
class Kernel:
    """The functional form: gather neighbours' values, combine, compute, scatter."""

    initial: Column
    op_neighbour: Callable[[Column], Column]
    plus: Callable[[Column], Column]
    compute: Callable[[Column, Column], Column]
    to_neighbour: Callable[[Column], Column] = lambda value: value


class _KernelProgram(VertexProgram):
    def __init__(self, kernel: Kernel):
        self.kernel = kernel

    def init(self):
        return {"value": self.kernel.initial}

    def message(self):
        return self.kernel.op_neighbour(self.kernel.to_neighbour(F.col("value")))

    def combine(self, message):
        return self.kernel.plus(message)

    def apply(self):
        return {"value": self.kernel.compute(F.col("value"), F.col("combined"))}


def run_kernel(graph: Graph, kernel: Kernel, iterations: int) -> DataFrame:
    """Synchronous run of a kernel; id, value."""
    return run(graph, _KernelProgram(kernel), iterations)[0]
