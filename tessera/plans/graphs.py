"""Graph queries over the copurchase graph and the page links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import graph as G
from ..operators import algorithms as A
from .views import BOTH, COPURCHASE, LINKS, copurchase, links, read

QUERIES, SQL = {}, {}
SOURCE = 0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def bought(spark: SparkSession, sf_dir: str) -> G.Graph:
    return G.Graph.from_edges(copurchase(spark, sf_dir))


def linked(spark: SparkSession, sf_dir: str) -> G.Graph:
    return G.Graph.from_edges(links(spark, sf_dir))


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(p.strip() for p in parts)


DEGREES = """degrees AS (SELECT id, count(*) FILTER (WHERE i) AS indegree, count(*) FILTER (WHERE NOT i) AS outdegree
  FROM (SELECT dst AS id, true AS i FROM copurchase UNION ALL SELECT src, false FROM copurchase) AS e GROUP BY id)"""


@query(with_(COPURCHASE, DEGREES) + " SELECT * FROM degrees")
def degrees(spark, sf_dir):
    return bought(spark, sf_dir).degrees()


@query(with_(COPURCHASE) + " SELECT src, dst, count(*) AS times FROM copurchase GROUP BY src, dst")
def simplify_edges(spark, sf_dir):
    return bought(spark, sf_dir).simplify(times=F.count(F.lit(1))).edges


@query(with_(COPURCHASE, BOTH) + " SELECT DISTINCT src, dst FROM both_ways")
def symmetrize(spark, sf_dir):
    return bought(spark, sf_dir).undirected()


@query(with_(COPURCHASE, DEGREES) + " SELECT id, indegree + outdegree AS degree, row_number() OVER (ORDER BY indegree + outdegree, id) - 1 AS new_id FROM degrees")
def relabel_by_degree(spark, sf_dir):
    return bought(spark, sf_dir).degree_order().select("id", "degree", "new_id")


@query(with_(COPURCHASE) + " SELECT src AS id, count(*) AS degree, string_agg(dst, ',' ORDER BY dst) AS neighbours FROM copurchase GROUP BY src")
def adjacency(spark, sf_dir):
    return bought(spark, sf_dir).adjacency().withColumn("neighbours", F.concat_ws(",", F.col("neighbours").cast("array<string>")))


@query(with_(COPURCHASE, DEGREES) + " SELECT id, indegree + outdegree AS value FROM degrees ORDER BY value DESC, id LIMIT 20")
def topk_vertices(spark, sf_dir):
    return G.top_vertices(bought(spark, sf_dir).degrees().select("id", (F.col("indegree") + F.col("outdegree")).alias("value")), 20)


@query("SELECT CAST(sum(p_size) AS BIGINT) AS total FROM part")
def vertex_sum(spark, sf_dir):
    return G.sum_vertices(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("value")))


@query(with_(COPURCHASE) + " SELECT dst AS id, count(*) AS indegree FROM copurchase WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = src AND p_size > 25) GROUP BY dst")
def delete_edges(spark, sf_dir):
    """In-degrees after the out-edges of large parts are deleted."""
    g = bought(spark, sf_dir)
    large = read(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("src"))
    gone = g.edges.join(large, "src", "left_semi")
    return g.delete_edges(gone).edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("indegree"))


@query(with_(COPURCHASE) + " SELECT src AS id, dst AS first, n FROM (SELECT src, dst, count(*) OVER (PARTITION BY src) AS n, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM copurchase) AS e WHERE r = 1")
def first_neighbour(spark, sf_dir):
    return bought(spark, sf_dir).edges.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("first"), F.count(F.lit(1)).alias("n"))


def pagerank_sql(updates: int) -> str:
    steps = ["r0 AS (SELECT id, 1.0e0 AS p FROM vertices)", "od AS (SELECT src, count(*) AS n FROM copurchase GROUP BY src)"]
    for i in range(1, updates + 1):
        share = "1.0e0 / n" if i == 1 else "p / n"
        steps.append(f"m{i} AS (SELECT dst, sum({share}) AS s FROM copurchase JOIN r{i - 1} ON src = id JOIN od USING (src) GROUP BY dst)")
        steps.append(f"r{i} AS (SELECT id, 0.15e0 + 0.85e0 * coalesce(s, 0) AS p FROM vertices LEFT JOIN m{i} ON id = dst)")
    return with_(COPURCHASE, *steps)


@query(pagerank_sql(3) + " SELECT id, round(p, 6) AS rank FROM r3")
def pagerank3(spark, sf_dir):
    return A.pagerank(bought(spark, sf_dir), 4).withColumn("rank", F.round("rank", 6))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pagerank(bought(spark, sf_dir), 4).orderBy(F.desc("rank"), "id").limit(20)


def hops_sql(edges: str, steps: int) -> str:
    parts = [f"h0 AS (SELECT id, CASE WHEN id = {SOURCE} THEN 0 END AS h FROM vertices)"]
    for i in range(1, steps + 1):
        parts.append(f"h{i} AS (SELECT v.id, least(any_value(v.h), min(u.h) + 1) AS h FROM h{i - 1} v LEFT JOIN {edges} e ON e.dst = v.id LEFT JOIN h{i - 1} u ON u.id = e.src GROUP BY v.id)")
    return ", ".join(parts)


@query(with_(COPURCHASE, hops_sql("copurchase", 10)) + " SELECT id, coalesce(h, -1) AS hops FROM h10")
def sssp_hops(spark, sf_dir):
    return A.shortest_hops(bought(spark, sf_dir), SOURCE)


BFS = with_(COPURCHASE, BOTH, hops_sql("both_ways", 10))


@query(BFS + " SELECT id, h AS level FROM h10 WHERE h IS NOT NULL")
def bfs_levels(spark, sf_dir):
    return A.bfs_tree(bought(spark, sf_dir), SOURCE).select("id", "level")


@query(BFS + f" SELECT v.id, CASE WHEN v.id = {SOURCE} THEN v.id ELSE min(u.id) END AS parent FROM h10 v LEFT JOIN both_ways e ON e.dst = v.id LEFT JOIN h10 u ON u.id = e.src AND u.h = v.h - 1 WHERE v.h IS NOT NULL GROUP BY v.id")
def bfs_parents(spark, sf_dir):
    return A.bfs_tree(bought(spark, sf_dir), SOURCE).select("id", "parent")


def bfs_checks_sql(tree: str) -> str:
    """The five rules counted by SQL over a tree made from t (id, parent, level)."""
    return f"""{BFS}, t AS (SELECT v.id, CASE WHEN v.id = {SOURCE} THEN v.id ELSE min(u.id) END AS parent, any_value(v.h) AS level
  FROM h10 v LEFT JOIN both_ways e ON e.dst = v.id LEFT JOIN h10 u ON u.id = e.src AND u.h = v.h - 1 WHERE v.h IS NOT NULL GROUP BY v.id),
a AS ({tree}), und AS (SELECT DISTINCT src, dst FROM both_ways),
ends AS (SELECT x.level AS x, y.level AS y FROM und LEFT JOIN a x ON x.id = src LEFT JOIN a y ON y.id = dst)
SELECT 'root' AS "check", count(*) AS violations FROM a WHERE id = {SOURCE} AND parent <> {SOURCE}
UNION ALL SELECT 'levels', count(*) FROM ends WHERE abs(x - y) > 1
UNION ALL SELECT 'reached', count(*) FROM ends WHERE (x IS NULL) <> (y IS NULL)
UNION ALL SELECT 'parent level', count(*) FROM a LEFT JOIN a p ON p.id = a.parent WHERE a.id <> {SOURCE} AND (p.level IS NULL OR a.level <> p.level + 1)
UNION ALL SELECT 'parent edge', count(*) FROM a WHERE id <> {SOURCE} AND NOT EXISTS (SELECT 1 FROM und WHERE src = a.parent AND dst = a.id)"""


@query(bfs_checks_sql("SELECT * FROM t"))
def bfs_valid(spark, sf_dir):
    g = bought(spark, sf_dir)
    return A.bfs_violations(g, A.bfs_tree(g, SOURCE), SOURCE)


@query(bfs_checks_sql("SELECT id, CASE WHEN id % 50 = 11 THEN id + 1 ELSE parent END AS parent, CASE WHEN id % 50 = 7 THEN level + 2 ELSE level END AS level FROM t WHERE id % 50 <> 9"))
def bfs_broken(spark, sf_dir):
    """The same counts for a tree of which some levels and parents are wrong and some vertices are missing."""
    g = bought(spark, sf_dir)
    wrong = A.bfs_tree(g, SOURCE).filter("id % 50 <> 9").withColumns(
        {"parent": F.when(F.col("id") % 50 == 11, F.col("id") + 1).otherwise(F.col("parent")), "level": F.when(F.col("id") % 50 == 7, F.col("level") + 2).otherwise(F.col("level"))}
    )
    return A.bfs_violations(g, wrong, SOURCE)


@query(BFS + " SELECT CAST(min(h) AS DOUBLE) AS least, round(quantile_cont(h, 0.25), 6) AS first_quartile, round(median(h), 6) AS median, round(quantile_cont(h, 0.75), 6) AS third_quartile, CAST(max(h) AS DOUBLE) AS largest, round(avg(h), 6) AS mean, round(stddev(h), 6) AS deviation, round(count(*) / sum(1.0 / h), 6) AS harmonic_mean FROM h10 WHERE h > 0")
def bfs_statistics(spark, sf_dir):
    levels = A.bfs_tree(bought(spark, sf_dir), SOURCE).filter("level > 0").select(F.col("level").cast("double").alias("level"))
    stats = A.traversal_stats(levels, "level")
    return stats.select(*[F.round(c, 6).alias(c) for c in stats.columns])


def labels_sql(steps: int = 14) -> str:
    parts = ["l0 AS (SELECT src AS id, src AS label FROM links UNION SELECT dst, dst FROM links)", "both_ways AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links)"]
    for i in range(1, steps + 1):
        parts.append(f"l{i} AS MATERIALIZED (SELECT v.id, least(any_value(v.label), min(u.label)) AS label FROM l{i - 1} v LEFT JOIN both_ways e ON e.dst = v.id LEFT JOIN l{i - 1} u ON u.id = e.src GROUP BY v.id)")
    parts.append(f"labels AS (SELECT * FROM l{steps})")
    return with_(LINKS, *parts)


@query(labels_sql() + " SELECT id, label FROM labels")
def components(spark, sf_dir):
    return A.connected_components(linked(spark, sf_dir))


@query(labels_sql() + " SELECT label, count(*) AS size FROM labels GROUP BY label")
def label_sizes(spark, sf_dir):
    return G.label_sizes(A.connected_components(linked(spark, sf_dir)))


@query(labels_sql() + " SELECT label, count(*) AS edges FROM links JOIN labels ON id = src GROUP BY label")
def component_edges(spark, sf_dir):
    g = linked(spark, sf_dir)
    return A.component_edges(g, A.connected_components(g))


@query(labels_sql() + " SELECT size, count(*) AS components FROM (SELECT count(*) AS size FROM labels GROUP BY label) AS s GROUP BY size")
def component_hist(spark, sf_dir):
    return A.size_histogram(G.label_sizes(A.connected_components(linked(spark, sf_dir))))


@query(labels_sql() + " SELECT edges AS size, count(*) AS components FROM (SELECT count(*) AS edges FROM links JOIN labels ON id = src GROUP BY label) AS s GROUP BY edges")
def bond_hist(spark, sf_dir):
    g = linked(spark, sf_dir)
    return A.size_histogram(A.component_edges(g, A.connected_components(g)), "edges")


@query(labels_sql() + " SELECT l.label, count(*) AS nodes, count(*) FILTER (WHERE id < 1000000000) AS seeds, any_value(edges) AS edges FROM labels l JOIN (SELECT label, count(*) AS edges FROM links JOIN labels ON id = src GROUP BY label) AS e ON e.label = l.label GROUP BY l.label")
def component_stats(spark, sf_dir):
    g = linked(spark, sf_dir)
    return A.component_stats(g, A.connected_components(g), read(spark, sf_dir, "pages").select(F.col("page_id").alias("id")))


def lpa_sql(steps: int) -> str:
    parts = ["l0 AS (SELECT id, id AS label FROM vertices)"]
    for i in range(1, steps + 1):
        parts.append(f"c{i} AS (SELECT dst AS id, label, count(*) AS n FROM both_ways JOIN l{i - 1} ON id = src GROUP BY dst, label)")
        parts.append(f"l{i} AS MATERIALIZED (SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY n DESC, label DESC) AS r FROM c{i}) AS w WHERE r = 1)")
    return with_(COPURCHASE, BOTH, *parts)


@query(lpa_sql(2) + " SELECT id, label FROM l2")
def lpa2(spark, sf_dir):
    return A.communities(bought(spark, sf_dir), 2)


CORE_K = 3


def kcore_sql(steps: int) -> str:
    """Vertices of both directions' degree over CORE_K after so many rounds of peeling."""
    parts = ["k0 AS (SELECT src AS id FROM both_ways GROUP BY src)"]
    for i in range(1, steps + 1):
        parts.append(f"k{i} AS MATERIALIZED (SELECT src AS id FROM both_ways WHERE src IN (SELECT id FROM k{i - 1}) AND dst IN (SELECT id FROM k{i - 1}) GROUP BY src HAVING count(*) > {CORE_K})")
    return with_(LINKS, "both_ways AS (SELECT src, dst FROM links UNION ALL SELECT dst, src FROM links)", *parts)


@query(kcore_sql(20) + " SELECT id, id IN (SELECT id FROM k20) AS inner_core FROM k0")
def kcore_k3(spark, sf_dir):
    return A.kcores(linked(spark, sf_dir), CORE_K).select("id", F.col("kcore").isNull().alias("inner_core"))


SOFT = """seeds AS (SELECT p_partkey AS id, p_brand AS label FROM part WHERE p_size <= 10 AND p_partkey IN (SELECT id FROM vertices)),
e AS (SELECT src, dst, count(*) * 1.0e0 AS w FROM copurchase GROUP BY src, dst), s0 AS (SELECT id, label, 1.0e0 AS p FROM seeds)"""


def soft_sql(steps: int) -> str:
    parts = []
    for i in range(1, steps + 1):
        parts.append(f"g{i} AS (SELECT src AS id, label, sum(w * p) AS s FROM e JOIN s{i - 1} ON id = dst GROUP BY src, label)")
        parts.append(f"n{i} AS (SELECT id, label, 0.85e0 * s / sum(s) OVER (PARTITION BY id) AS p FROM g{i} UNION ALL SELECT id, label, 0.15e0 * p FROM s{i - 1})")
        parts.append(f"x{i} AS (SELECT id, label, sum(p) AS p FROM n{i} WHERE id NOT IN (SELECT id FROM seeds) GROUP BY id, label)")
        parts.append(f"s{i} AS (SELECT id, label, p / sum(p) OVER (PARTITION BY id) AS p FROM x{i} UNION ALL SELECT id, label, 1.0e0 FROM seeds)")
    return with_(COPURCHASE, SOFT, *parts)


@query(soft_sql(2) + " SELECT id, label, round(p + 1e-9, 6) AS p FROM s2")
def softlabels2(spark, sf_dir):
    g = bought(spark, sf_dir)
    seeds = read(spark, sf_dir, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"))
    seeds = seeds.join(g.vertices.select("id"), "id", "left_semi")
    return A.soft_labels(g, seeds, 2).withColumn("p", F.round(F.col("p") + 1e-9, 6))


@query(with_(COPURCHASE, BOTH) + " SELECT id, min(hop) AS hop FROM (SELECT 0 AS id, 0 AS hop UNION ALL SELECT dst, 1 FROM both_ways WHERE src = 0 UNION ALL SELECT b.dst, 2 FROM both_ways a JOIN both_ways b ON a.dst = b.src WHERE a.src = 0) AS r GROUP BY id")
def ego_2hop(spark, sf_dir):
    g = bought(spark, sf_dir)
    return A.ego_network(g, g.vertices.filter(F.col("id") == SOURCE), 2)


@query(with_(COPURCHASE) + " SELECT src, dst, count(*) AS times FROM copurchase WHERE src IN (SELECT p_partkey FROM part WHERE p_size > 40) AND dst IN (SELECT p_partkey FROM part WHERE p_size > 40) GROUP BY src, dst")
def induced_subgraph(spark, sf_dir):
    large = read(spark, sf_dir, "part").filter("p_size > 40").select(F.col("p_partkey").alias("id"))
    return bought(spark, sf_dir).induced(large).simplify(times=F.count(F.lit(1))).edges
