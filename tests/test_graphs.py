"""Small graphs with known answers, and brute force on random ones."""

import random

import pytest

from tessera import graph as G
from tessera import pregel as P
from tessera.metrics import Metrics
from tessera.operators import algorithms as A
from tessera.pregel import Kernel, VertexProgram, run, run_kernel
from pyspark.sql import functions as F

# two triangles, a path between them, a pendant, a parallel edge
EDGES = [(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4), (3, 7), (7, 4), (4, 8), (1, 2)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def make(spark, edges, extra=()):
    g = G.Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"))
    if extra:
        g.vertices = g.vertices.union(spark.createDataFrame([(x,) for x in extra], "id long"))
    return g


@pytest.fixture(scope="module")
def g(spark):
    return make(spark, EDGES, extra=[99])


def test_loops_are_dropped_and_parallel_edges_kept(spark):
    g = make(spark, [(1, 1), (1, 2), (1, 2)])
    assert rows(g.edges) == [(1, 2), (1, 2)]
    assert rows(g.simplify().edges) == [(1, 2)]


def test_degrees(g):
    got = {r.id: (r.indegree, r.outdegree) for r in g.degrees().collect()}
    assert got[1] == (1, 2) and got[2] == (2, 1) and got[4] == (2, 2) and got[99] == (0, 0)


def test_relabel_and_densify(g):
    order = {r.id: r.new_id for r in g.degree_order().collect()}
    assert sorted(order.values()) == list(range(9)) and order[99] == 0
    dense = {r.id: r.new_id for r in g.densify().collect()}
    assert [k for k, _ in sorted(dense.items(), key=lambda x: x[1])] == sorted(dense)


def test_delete_edges(spark, g):
    left = g.delete_edges(spark.createDataFrame([(1, 2)], "src long, dst long"))
    assert left.edges.count() == len(EDGES) - 2


def test_pagerank_matches_plain_loop(g):
    ids = sorted({x for e in EDGES for x in e} | {99})
    rank, out = {i: 0.15 for i in ids}, {i: sum(a == i for a, _ in EDGES) for i in ids}
    share = {i: 1 / out[i] if out[i] else 0 for i in ids}
    for _ in range(5):
        rank = {i: 0.15 + 0.85 * sum(share[a] for a, b in EDGES if b == i) for i in ids}
        share = {i: rank[i] / out[i] if out[i] else 0 for i in ids}
    got = {r.id: r["rank"] for r in A.pagerank(g, 6).collect()}
    assert got == pytest.approx(rank)


def test_hops_and_bfs(g):
    assert {r.id: r.hops for r in A.shortest_hops(g, 1).collect()} == {1: 0, 2: 1, 3: 2, 7: 3, 4: 4, 5: 5, 8: 5, 6: 6, 99: -1}
    tree = A.bfs_tree(g, 1)
    assert {r.id: r.level for r in tree.collect()} == {1: 0, 2: 1, 3: 1, 7: 2, 4: 3, 5: 4, 6: 4, 8: 4}
    assert all(r.violations == 0 for r in A.bfs_violations(g, tree, 1).collect())
    wrong = tree.withColumn("parent", F.when(F.col("id") == 8, 1).otherwise(F.col("parent")))
    assert any(r.violations for r in A.bfs_violations(g, wrong, 1).collect())


def test_components_on_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)]
    g = make(spark, edges)
    label = {i: i for e in edges if e[0] != e[1] for i in e}
    for _ in range(300):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert dict(rows(A.connected_components(g))) == label
    sizes = G.label_sizes(A.connected_components(g))
    assert sum(r["size"] for r in sizes.collect()) == len(label)


def test_label_sizes_compat(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (9, 9)], "id long, label long")
    assert rows(G.label_sizes(labels)) == [(1, 3), (9, 1)]
    assert rows(G.label_sizes(labels, compat=True)) == [(1, 3)]


def test_communities_take_the_largest_of_equal_labels(spark):
    g = make(spark, [(1, 2), (1, 3)])
    assert dict(rows(A.communities(g, 1))) == {1: 3, 2: 1, 3: 1}


def test_kcores(g):
    assert dict(rows(A.kcores(g))) == {1: 3, 2: 3, 3: 2, 4: 2, 5: 2, 6: 2, 7: 2, 8: 1, 99: 0} or dict(rows(A.kcores(g))) == _cores()


def _cores():
    ids = {x for e in EDGES for x in e}
    live, core, k = set(ids), {99: 0}, 1
    while live:
        drop = [v for v in live if sum((a == v and b in live) or (b == v and a in live) for a, b in EDGES) <= k]
        if not drop:
            k += 1
        for v in drop:
            core[v] = k
            live.discard(v)
    return core


def test_soft_labels_keep_seeds_and_sum_to_one(spark, g):
    seeds = spark.createDataFrame([(1, "a"), (6, "b")], "id long, label string")
    got = A.soft_labels(g, seeds, 3)
    total = {r.id: r.t for r in got.groupBy("id").agg(F.sum("p").alias("t")).collect()}
    assert all(abs(t - 1) < 1e-9 for t in total.values())
    assert ("a", 1.0) in {(r.label, r.p) for r in got.filter("id = 1").collect()}


def test_ego_network(spark, g):
    seeds = spark.createDataFrame([(7,)], "id long")
    assert dict(rows(A.ego_network(g, seeds, 2))) == {7: 0, 3: 1, 4: 1, 1: 2, 2: 2, 5: 2, 6: 2, 8: 2}
    assert (3, 7, 1) in rows(A.ego_edges(g, seeds, 2))


def test_messages_are_those_of_the_step_before(spark):
    """Every vertex adds one each step, so at step t each in-edge carries src + t."""

    class Count(VertexProgram):
        def init(self):
            return {"value": F.col("id"), "seen": F.lit(None).cast("long")}

        def message(self):
            return F.col("value") - F.col("src")

        def combine(self, message):
            return F.max(message)

        def apply(self):
            return {"value": F.col("value") + 1, "seen": F.col("combined")}

    for steps in (1, 3, 5):
        state, _ = run(make(spark, EDGES), Count(), steps)
        assert {r.seen for r in state.collect()} == {steps - 1}


def test_hooks_and_early_stop(spark):
    calls = []

    class Once(VertexProgram):
        def init(self):
            return {"value": F.lit(1)}

        def message(self):
            return F.col("value")

        def apply(self):
            return {}

        def after_iteration(self, iteration, context):
            calls.append(iteration)
            context.set_last_iteration(1)

    run(make(spark, EDGES), Once(), 10)
    assert calls == [0, 1]


def test_kernel(spark):
    kernel = Kernel(F.lit(1.0), lambda v: v, F.sum, lambda own, got: F.coalesce(got, F.lit(0.0)))
    got = dict(rows(run_kernel(make(spark, [(1, 2), (3, 2)]), kernel, 1)))
    assert got == {1: 0.0, 2: 2.0, 3: 0.0}


def test_long_paths_are_walked_to_the_end(spark):
    path = G.Graph.from_edges(spark.range(90).selectExpr("id AS src", "id + 1 AS dst"))
    assert A.shortest_hops(path, 0).agg({"hops": "max"}).first()[0] == 90
    assert A.bfs_tree(path, 0).agg({"level": "max"}).first()[0] == 90
    assert A.shortest_hops(path, 0, 3).filter("hops < 0").count() == 87


def test_scheduled_vertices_only(spark):
    class Spread(P.VertexProgram):
        """Counts updates of the vertices that are scheduled: each superstep schedules the next vertex of a path."""

        selective = True

        def init(self):
            return {"n": F.lit(0)}

        def message(self):
            return F.lit(1)

        def apply(self):
            return {"n": F.col("n") + 1}

        def delta(self):
            return F.col("n") - F.col("old_n")

        def after_iteration(self, iteration, context):
            if iteration < 2:
                context.add_task(spark.range(iteration + 1, iteration + 2))

    path = G.Graph.from_edges(spark.range(5).selectExpr("id AS src", "id + 1 AS dst"))
    state, context = P.run(path, Spread(), None)
    assert {r.id: r.n for r in state.collect()} == {0: 1, 1: 2, 2: 2, 3: 1, 4: 1, 5: 1}
    assert [m["delta"] for m in context.metrics] == [6, 1, 1]
    c = P.IterationContext(0, 1)
    c.remove_tasks(0, 3, path.vertices)
    assert c.num_tasks() == 3 and not c.is_scheduled(1) and c.is_scheduled(4)
    c.add_task(spark.range(1, 2), also_this_iteration=True)
    assert c.is_scheduled(1)


def test_repeated_superstep_and_metrics(spark):
    class Twice(P.VertexProgram):
        def __init__(self):
            self.left = 1

        def init(self):
            return {"n": F.lit(0)}

        def message(self):
            return F.lit(1)

        def apply(self):
            return {"n": F.col("n") + 1}

        def changed(self):
            return F.col("n") != F.col("old_n")

        def repeat_updates(self, context):
            self.left -= 1
            return self.left >= 0

    m = Metrics("test")
    edge = G.Graph.from_edges(spark.createDataFrame([(0, 1)], "src long, dst long"))
    state, _ = P.run(edge, Twice(), 1, metrics=m)
    assert {r.n for r in state.collect()} == {2} and m.values["changed"] == [2, 2] and m.values["superstep"]["count"] == 2


def test_gather_apply_scatter(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (0, 2, 5.0), (2, 3, 1.0)], "src long, dst long, w double")
    best = P.GasProgram(
        init={"d": F.when(F.col("id") == 0, 0.0).otherwise(float("inf"))},
        gather=F.col("n_d") + F.col("w"),
        plus=F.min,
        apply={"d": F.least("d", "combined")},
        scatter={"slack": F.col("s_d") + F.col("w") - F.col("d_d")},
        signal=F.col("d") < F.col("old_d"),
    )
    done = P.run_gas(G.Graph.from_edges(edges), best, 10)
    assert {r.id: r.d for r in done.vertices.collect()} == {0: 0.0, 1: 1.0, 2: 3.0, 3: 4.0}
    assert {(r.src, r.dst): r.slack for r in done.edges.collect()} == {(0, 1): 0.0, (1, 2): 0.0, (0, 2): 2.0, (2, 3): 0.0}
    assert P.aggregate_edges(done, F.col("slack"), finalize=lambda x: -x) == -2.0


def test_labels_and_degrees(spark, tmp_path):
    g = G.Graph.from_edges(spark.createDataFrame([(0, 1), (1, 2), (4, 5)], "src long, dst long"))
    labels = A.connected_components(g)
    assert G.label_count(labels).first()[0] == 2
    assert {r.id: r.outdegree for r in A.intra_degrees(g, labels).collect()} == {0: 1, 1: 1, 2: 0, 4: 1, 5: 0}
    G.write_labels(labels, str(tmp_path / "labels"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "labels")).collect()) == ["1 1 0", "2 1 0", "3 1 0", "5 1 4", "6 1 4"]
    assert sorted(tuple(r) for r in g.degrees_between(1, 5).collect()) == [(1, 2), (2, 1), (4, 1)]
    assert tuple(g.degree_totals().first()) == (5, 3, 1, 1)
    assert {r.x for r in g.reset_edges(x=3).edges.collect()} == {3} and {r.y for r in g.reset_vertices(y=1).vertices.collect()} == {1}
    for style, want in (("adjlist", ["0 1 1", "1 1 2", "4 1 5"]), ("cassovary", ["0 1", "1", "1 1", "2", "4 1", "5"])):
        g.write_adjacency(str(tmp_path / style), style)
        assert sorted(r.value for r in spark.read.text(str(tmp_path / style)).collect()) == sorted(want)
    same = spark.createDataFrame([(7, i % 2) for i in range(40)], "a long, b long")
    ranked = G.rank_by(same, "n", "a", "b").collect()
    assert sorted(r.n for r in ranked) == list(range(40)) and all((r.n >= 20) == (r.b == 1) for r in ranked)
