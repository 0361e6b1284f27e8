"""Graph algorithms as supersteps of joins and aggregates."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..pregel import VertexProgram, run
from ..session import cut


def pagerank(graph: Graph, iterations: int = 4, damping: float = 0.85) -> DataFrame:
    """id, rank. `iterations` includes the first, which only spreads the start value, so one update less is made.

    Unnormalised: rank = (1 - damping) + damping * sum of shares; parallel
    edges each carry a share, the mass of vertices without out-edges is lost.
    Edges with their sender's share are laid out once and reused.
    """
    out = graph.edges.groupBy("src").agg(F.count(F.lit(1)).alias("outdegree"))
    edges = graph.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times"))
    edges = edges.join(out, "src").select("src", "dst", (F.col("times") / F.col("outdegree")).alias("share"))
    if iterations > 3:
        edges = cut(edges)
    start = 1 - damping
    rank = None
    for step in range(1, iterations):
        if rank is None:
            # shares of the first spread are 1/outdegree, whatever the start value
            got = edges.groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("s"))
        else:
            got = edges.join(rank.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("s"))
        rank = graph.vertices.select("id").join(got, "id", "left").select("id", (start + damping * F.coalesce("s", F.lit(0.0))).alias("rank"))
        if step % 4 == 0:
            rank = cut(rank)
    return rank if rank is not None else graph.vertices.select("id", F.lit(start).alias("rank"))


class _Hops(VertexProgram):
    def __init__(self, source: int):
        self.source = source

    def init(self):
        return {"hops": F.when(F.col("id") == self.source, 0).otherwise(-1), "fresh": F.col("id") == self.source}

    def sends(self):
        return F.col("fresh")

    def message(self):
        return F.col("hops") + 1

    def combine(self, message):
        return F.min(message)

    def apply(self):
        better = F.col("combined").isNotNull() & ((F.col("hops") < 0) | (F.col("combined") < F.col("hops")))
        return {"hops": F.when(better, F.col("combined")).otherwise(F.col("hops")), "fresh": better}

    def changed(self):
        return F.col("fresh")


def shortest_hops(graph: Graph, source: int, iterations: int | None = None) -> DataFrame:
    """id, hops along directed edges; -1 where unreached. Only the frontier sends; ends when it is empty (or after `iterations`)."""
    return run(graph, _Hops(source), iterations)[0].select("id", "hops")


def connected_components(graph: Graph) -> DataFrame:
    """id, label: the least id of the weakly connected component.

    Alternating large-star and small-star steps: the number of rounds grows
    with the logarithm of the diameter, and edges never grow in number.
    """
    edges = graph.edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).filter("a <> b").distinct()
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = cut(small.filter("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label"))
    return graph.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def component_edges(graph: Graph, labels: DataFrame) -> DataFrame:
    """label, edges: edges with both ends in the label, each direction pair of a pair of vertices counted by multiplicity."""
    a = labels.select(F.col("id").alias("src"), F.col("label"))
    b = labels.select(F.col("id").alias("dst"), F.col("label").alias("other"))
    inside = graph.edges.join(a, "src").join(b, "dst").filter("label = other")
    return inside.groupBy("label").agg(F.count(F.lit(1)).alias("edges"))


def intra_degrees(graph: Graph, labels: DataFrame) -> DataFrame:
    """id, label, outdegree: each vertex's out-edges that stay within its label."""
    a = labels.select(F.col("id").alias("src"), "label")
    b = labels.select(F.col("id").alias("dst"), F.col("label").alias("other"))
    inside = graph.edges.join(a, "src").join(b, "dst").filter("label = other").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("outdegree"))
    return labels.join(inside, "id", "left").select("id", "label", F.coalesce("outdegree", F.lit(0)).alias("outdegree"))


def isolated_share(sizes: DataFrame, size: str = "size") -> DataFrame:
    """isolated, share: components of one vertex, and their share of all vertices."""
    alone = F.count_if(F.col(size) == 1)
    return sizes.agg(alone.alias("isolated"), (alone / F.sum(size)).alias("share"))


def component_stats(graph: Graph, labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """label, nodes, edges, seeds of every component."""
    marked = labels.join(seeds.select("id", F.lit(1).alias("seed")).distinct(), "id", "left")
    nodes = marked.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("seed"), F.lit(0)).alias("seeds"))
    return nodes.join(component_edges(graph, labels), "label", "left").na.fill(0, ["edges"])


def size_histogram(sizes: DataFrame, size: str = "size") -> DataFrame:
    """size, components: how many components have each size (site percolation; of edges: bond percolation)."""
    return sizes.groupBy(F.col(size).alias("size")).agg(F.count(F.lit(1)).alias("components"))


def communities(graph: Graph, iterations: int = 10) -> DataFrame:
    """id, label after synchronous label propagation over edges of both directions, with multiplicity.

    Each step takes the most frequent label among the neighbours, the largest
    of equally frequent ones.
    """
    edges = graph.both_ways().groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times"))
    state = graph.vertices.select("id", F.col("id").alias("label"))
    for step in range(iterations):
        votes = edges.join(state.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id"), "label").agg(F.sum("times").alias("n"))
        won = votes.groupBy("id").agg(F.max_by("label", F.struct("n", "label")).alias("new"))
        state = state.join(won, "id", "left").select("id", F.coalesce("new", "label").alias("label"))
        if step % 3 == 2:
            state = cut(state)
    return state


def kcores(graph: Graph, most: int = 1 << 30, compat: bool = False) -> DataFrame:
    """id, kcore: the k at which a vertex is peeled off, counting parallel edges and both directions.

    For k = 1, 2, ...: vertices with at most k live neighbours go until none
    does. Isolated vertices get 0 (with compat 1). Vertices that outlive
    `most` have kcore null.
    """
    edges = cut(graph.both_ways().groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times")))
    linked = edges.select(F.col("src").alias("id")).distinct()
    alone = graph.vertices.select("id").join(linked, "id", "left_anti").select("id", F.lit(1 if compat else 0).alias("kcore"))
    done, k = alone, 1
    while k <= most:
        degree = edges.groupBy(F.col("src").alias("id")).agg(F.sum("times").alias("n"))
        gone = degree.filter(F.col("n") <= k).select("id")
        drop = cut(gone)
        if drop.isEmpty():
            least = degree.agg(F.min("n")).first()[0]
            if least is None:
                break
            k = max(k + 1, int(least))
            continue
        done = cut(done.union(drop.select("id", F.lit(k).alias("kcore"))))
        left = edges.join(drop.withColumnRenamed("id", "src"), "src", "left_anti").join(drop.withColumnRenamed("id", "dst"), "dst", "left_anti")
        ends = edges.join(drop.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        left = cut(left)
        # neighbours that lost all their edges in this step go with it
        bare = ends.join(drop, "id", "left_anti").join(left.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
        done = cut(done.union(bare.select("id", F.lit(k).alias("kcore"))))
        edges = left
    return graph.vertices.select("id").join(done, "id", "left")


def kcore_table(graph: Graph, cores: DataFrame) -> DataFrame:
    """k, removed, links: vertices and links (an edge goes with its first end to go) peeled off at each k."""
    a = cores.select(F.col("id").alias("src"), F.col("kcore").alias("a"))
    b = cores.select(F.col("id").alias("dst"), F.col("kcore").alias("b"))
    links = graph.edges.join(a, "src").join(b, "dst").groupBy(F.least("a", "b").alias("k")).agg(F.count(F.lit(1)).alias("links"))
    nodes = cores.groupBy(F.col("kcore").alias("k")).agg(F.count(F.lit(1)).alias("removed"))
    return nodes.join(links, "k", "left").na.fill(0, ["links"])


def soft_labels(graph: Graph, seeds: DataFrame, iterations: int = 2, alpha: float = 0.15, weight: str | None = None) -> DataFrame:
    """id, label, p: class probabilities spread from seeds (id, label).

    Seeds stay fixed; others take alpha of their own p and 1 - alpha of the
    weighted sum of their out-neighbours' p, scaled to sum 1. Kept exploded:
    a vertex without any mass has no row.
    """
    fixed = seeds.select("id").distinct()
    state = seeds.groupBy("id", "label").agg(F.count(F.lit(1)).cast("double").alias("p"))
    total = state.groupBy("id").agg(F.sum("p").alias("t"))
    base = cut(state.join(total, "id").select("id", "label", (F.col("p") / F.col("t")).alias("p")))
    state = base
    w = F.col(weight) if weight else F.lit(1.0)
    edges = graph.edges.groupBy("src", "dst").agg(F.sum(w).cast("double").alias("w"))
    for step in range(iterations):
        seen = edges.join(state.select(F.col("id").alias("dst"), "label", "p"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum(F.col("w") * F.col("p")).alias("s"))
        mass = seen.groupBy("id").agg(F.sum("s").alias("m"))
        spread = seen.join(mass, "id").select("id", "label", ((1 - alpha) * F.col("s") / F.col("m")).alias("p"))
        mixed = spread.union(state.select("id", "label", alpha * F.col("p"))).join(fixed, "id", "left_anti").groupBy("id", "label").agg(F.sum("p").alias("p"))
        norm = mixed.groupBy("id").agg(F.sum("p").alias("t"))
        state = mixed.join(norm, "id").select("id", "label", (F.col("p") / F.col("t")).alias("p")).union(base)
        if step % 3 == 2:
            state = cut(state)
    return state


def coem(pairs: DataFrame, seeds: DataFrame, iterations: int = 2, tf_idf: bool = True) -> DataFrame:
    """side, id, p of bipartite co-training: phrases and contexts take the weighted mean of each other's probabilities.

    pairs: phrase, context, count; seeds: phrase, p (1 for positive, 0 for
    negative ones), which stay fixed. tf_idf weighs a pair by
    log(1 + count) * log(contexts / the phrase's contexts + 1), else by count.
    Others start at 0.5 and are 0.5 where nothing reaches them.
    """
    rows = pairs.groupBy("phrase", "context").agg(F.sum("count").alias("count"))
    if tf_idf:
        wide = rows.groupBy("phrase").agg(F.count(F.lit(1)).alias("_d"))
        total = rows.agg(F.countDistinct("context").alias("_t"))
        rows = rows.join(wide, "phrase").crossJoin(F.broadcast(total)).select("phrase", "context", (F.log1p("count") * F.log1p(F.col("_t") / F.col("_d"))).alias("w"))
    else:
        rows = rows.select("phrase", "context", F.col("count").cast("double").alias("w"))
    rows = cut(rows)
    fixed = seeds.select("phrase", F.col("p").cast("double").alias("fixed"))
    phrases = rows.select("phrase").distinct().join(fixed, "phrase", "left").select("phrase", "fixed", F.coalesce("fixed", F.lit(0.5)).alias("p"))
    mean = F.sum(F.col("w") * F.col("p")) / F.sum("w")
    for step in range(iterations):
        contexts = rows.join(phrases.select("phrase", "p"), "phrase").groupBy("context").agg(mean.alias("p"))
        new = rows.join(contexts, "context").groupBy("phrase").agg(mean.alias("new"))
        phrases = phrases.join(new, "phrase").select("phrase", "fixed", F.coalesce("fixed", "new").alias("p"))
        if step % 3 == 2:
            phrases = cut(phrases)
    contexts = rows.join(phrases.select("phrase", "p"), "phrase").groupBy("context").agg(mean.alias("p"))
    return phrases.select(F.lit("phrase").alias("side"), F.col("phrase").alias("id"), "p").union(contexts.select(F.lit("context"), "context", "p"))


def ego_network(graph: Graph, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """id, hop: vertices within `hops` undirected steps of the seeds."""
    edges = graph.undirected()
    frontier = seeds.select("id").distinct()
    done = frontier.select("id", F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        near = edges.join(frontier.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct()
        frontier = near.join(done, "id", "left_anti")
        if hop > 1:
            frontier = cut(frontier)
        done = done.union(frontier.select("id", F.lit(hop).alias("hop")))
    return done


def ego_edges(graph: Graph, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """u, v, hop: undirected edges (u < v) met when a vertex of distance hop - 1 is expanded."""
    reach = ego_network(graph, seeds, hops - 1)
    out = graph.undirected().join(reach.select(F.col("id").alias("src"), "hop"), "src")
    return out.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg((F.min("hop") + 1).alias("hop"))


def bfs_tree(graph: Graph, root: int, levels: int | None = None) -> DataFrame:
    """id, parent, level of a breadth-first tree over undirected edges; the least parent; root is its own.

    Goes on until no vertex is new, or for `levels` levels.
    """
    edges = cut(graph.undirected())
    tree = graph.vertices.filter(F.col("id") == root).select("id", F.col("id").alias("parent"), F.lit(0).alias("level"))
    frontier = tree
    for level in itertools.count(1) if levels is None else range(1, levels + 1):
        near = edges.join(frontier.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        frontier = cut(near.join(tree, "id", "left_anti").select("id", "parent", F.lit(level).alias("level")))
        if frontier.isEmpty():
            break
        tree = tree.union(frontier)
        if level % 16 == 0:
            tree = cut(tree)
    return tree


def bfs_violations(graph: Graph, tree: DataFrame, root: int) -> DataFrame:
    """check, violations: the rules that a breadth-first tree must keep."""
    edges = graph.undirected()
    a = tree.select(F.col("id").alias("src"), F.col("level").alias("a"))
    b = tree.select(F.col("id").alias("dst"), F.col("level").alias("b"))
    ends = edges.join(a, "src", "left").join(b, "dst", "left")
    above = tree.select(F.col("id").alias("parent"), F.col("level").alias("above"))
    links = tree.filter(F.col("id") != root).join(above, "parent", "left")
    real = links.join(edges.select(F.col("src").alias("parent"), F.col("dst").alias("id")), ["parent", "id"], "left_anti")
    counts = [
        ("root", tree.filter((F.col("id") == root) & (F.col("parent") != root))),
        ("levels", ends.filter(F.abs(F.col("a") - F.col("b")) > 1)),
        ("reached", ends.filter(F.col("a").isNull() != F.col("b").isNull())),
        ("parent level", links.filter(F.col("above").isNull() | (F.col("level") != F.col("above") + 1))),
        ("parent edge", real),
    ]
    out = None
    for name, rows in counts:
        one = rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = one if out is None else out.union(one)
    return out


def traversal_stats(samples: DataFrame, value: str) -> DataFrame:
    """Minimum, quartiles, maximum, mean, deviation and harmonic mean of a sample."""
    v = F.col(value)
    quartile = lambda p: F.percentile(v, F.lit(p))
    return samples.agg(
        F.min(v).alias("least"), quartile(0.25).alias("first_quartile"), quartile(0.5).alias("median"), quartile(0.75).alias("third_quartile"), F.max(v).alias("largest"),
        F.avg(v).alias("mean"), F.stddev(v).alias("deviation"), (F.count(v) / F.sum(1 / v)).alias("harmonic_mean"),
    )
