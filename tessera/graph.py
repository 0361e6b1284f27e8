"""The property graph: a table of vertices and a table of directed edges."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut


@dataclass
class Graph:
    """edges: src, dst and any value columns; vertices: id and any value columns.

    Parallel edges are kept; loops are dropped by from_edges. Ids are longs
    and need not be dense (see densify).
    """

    edges: DataFrame
    vertices: DataFrame = field(default=None)

    def __post_init__(self):
        if self.vertices is None:
            ends = self.edges.select(F.col("src").alias("id")).union(self.edges.select(F.col("dst").alias("id")))
            self.vertices = ends.distinct()

    @classmethod
    def from_edges(cls, edges: DataFrame, src: str = "src", dst: str = "dst") -> "Graph":
        named = edges.withColumnsRenamed({src: "src", dst: "dst"})
        return cls(named.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst"))

    def degrees(self) -> DataFrame:
        """id, indegree, outdegree for every vertex; one shuffle of the edges, combined before it."""
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
        counted = ends.groupBy("e.id").agg(F.sum("e.i").alias("indegree"), F.sum("e.o").alias("outdegree"))
        return self.vertices.select("id").join(counted, "id", "left").na.fill(0, ["indegree", "outdegree"])

    def degrees_between(self, low: int, high: int) -> DataFrame:
        """id, degree (in + out) of the vertices with low <= id < high."""
        return vertices_between(self.degrees(), low, high).select("id", (F.col("indegree") + F.col("outdegree")).alias("degree"))

    def degree_totals(self) -> DataFrame:
        """vertices, edges, and the largest in- and outdegree."""
        return self.degrees().agg(F.count(F.lit(1)).alias("vertices"), F.sum("outdegree").alias("edges"), F.max("indegree").alias("most_in"), F.max("outdegree").alias("most_out"))

    def reset_edges(self, **values) -> "Graph":
        """Every edge with these values in its columns."""
        return Graph(self.edges.withColumns({k: F.lit(v) for k, v in values.items()}), self.vertices)

    def reset_vertices(self, **values) -> "Graph":
        """Every vertex with these values in its columns."""
        return Graph(self.edges, self.vertices.withColumns({k: F.lit(v) for k, v in values.items()}))

    def write_adjacency(self, path: str, style: str = "adjlist") -> None:
        """Text: a line `id degree n1 n2 ..` for each vertex with out-edges, or (cassovary) `id degree` and a line for each neighbour."""
        head = F.concat_ws(" ", F.col("id").cast("string"), F.col("degree").cast("string"))
        mark = {"adjlist": " ", "cassovary": "\n"}[style]
        self.adjacency().select(F.concat_ws(mark, head, F.col("neighbours").cast("array<string>")).alias("value")).write.mode("overwrite").text(path)

    def reverse(self) -> "Graph":
        return Graph(self.edges.withColumnsRenamed({"src": "dst", "dst": "src"}), self.vertices)

    def both_ways(self) -> DataFrame:
        """Every edge in both directions, with multiplicity: a vertex's in-edges, then its out-edges."""
        return self.edges.select("src", "dst").union(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    def simplify(self, **choose: Column) -> "Graph":
        """One edge for each (src, dst); choose names an aggregate for each value column that survives."""
        grouped = self.edges.groupBy("src", "dst")
        edges = grouped.agg(*[c.alias(k) for k, c in choose.items()]) if choose else self.edges.select("src", "dst").distinct()
        return Graph(edges, self.vertices)

    def undirected(self) -> DataFrame:
        """Loops dropped, both directions, distinct."""
        return self.both_ways().filter("src <> dst").distinct()

    def delete_edges(self, gone: DataFrame) -> "Graph":
        """Without the edges whose (src, dst) stands in gone."""
        return Graph(self.edges.join(gone.select("src", "dst").distinct(), ["src", "dst"], "left_anti"), self.vertices)

    def induced(self, seeds: DataFrame) -> "Graph":
        """Edges with both ends among seeds (id)."""
        ids = seeds.select("id").distinct()
        edges = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Graph(edges, ids)

    def relabel(self, mapping: DataFrame) -> "Graph":
        """Ids replaced by mapping (id, new_id)."""
        a = mapping.select(F.col("id").alias("src"), F.col("new_id").alias("a"))
        b = mapping.select(F.col("id").alias("dst"), F.col("new_id").alias("b"))
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        edges = self.edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), *rest)
        return Graph(edges, self.vertices.join(mapping, "id").drop("id").withColumnRenamed("new_id", "id"))

    def degree_order(self) -> DataFrame:
        """id, new_id: ids ranked from 0 by (in + out degree, id)."""
        return rank_by(self.degrees().select("id", (F.col("indegree") + F.col("outdegree")).alias("degree")), "new_id", "degree", "id")

    def densify(self) -> DataFrame:
        """id, new_id: ids renumbered from 0 in their order."""
        return rank_by(self.vertices.select("id"), "new_id", "id")

    def adjacency(self) -> DataFrame:
        """id, degree, neighbours (out-edges' ends, sorted)."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.sort_array(F.collect_list("dst")).alias("neighbours"))

    def random_out_edge(self, seed: int = 0) -> DataFrame:
        """id, dst: an out-edge of every vertex that has one, drawn by a seeded hash."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.max_by("dst", F.struct(F.xxhash64(F.lit(seed), "src", "dst"), "dst")).alias("dst"))


def rank_by(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """Adds `name`: the row's number from 0 in an order.

    Rows are dealt in ranges of the order and written; a row's number is its
    place within its range plus the sizes of the ranges before, so that no
    value, however common, fills one task. The only window without a key runs
    over the ranges.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    placed = cut(placed)
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("_part", (before - F.col("_first")).alias("_start"))
    return placed.join(starts, "_part").withColumn(name, F.col("_at") + F.col("_start")).drop("_part", "_at", "_start")


def top_vertices(values: DataFrame, k: int, value: str = "value") -> DataFrame:
    """The k largest values, ties by the smaller id; taken from each partition first."""
    return values.orderBy(F.desc(value), "id").limit(k)


def sum_vertices(values: DataFrame, low: int | None = None, high: int | None = None, value: str = "value") -> DataFrame:
    """Sum of a value over ids in [low, high)."""
    return vertices_between(values, low, high).agg(F.sum(value).alias("total"))


def vertices_between(values: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    if low is not None:
        values = values.filter(F.col("id") >= low)
    if high is not None:
        values = values.filter(F.col("id") < high)
    return values


def label_count(labels: DataFrame) -> DataFrame:
    """labels: how many different labels there are."""
    return labels.agg(F.countDistinct("label").alias("labels"))


def write_labels(labels: DataFrame, path: str) -> None:
    """A line `id 1 label` for each vertex, ids counted from 1: a matrix with one column."""
    labels.select(F.concat_ws(" ", (F.col("id") + 1).cast("string"), F.lit("1"), F.col("label").cast("string"))).write.mode("overwrite").text(path)


def label_sizes(labels: DataFrame, compat: bool = False) -> DataFrame:
    """label, size. compat: vertices whose label is their own id are skipped and one is added to the rest."""
    if compat:
        return labels.filter("label <> id").groupBy("label").agg((F.count(F.lit(1)) + 1).alias("size"))
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
