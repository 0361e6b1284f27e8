"""Evolving graphs and windows by Structured Streaming.

Edges arrive as a stream; each micro-batch is committed to a table of deltas
that readers see at once, next to the base, and that compaction folds in. The
window queries are an addition: the graph layer itself knows no event time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_to_end(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Runs a streaming aggregate over all that is there now; its result as a table in the folder, which all executors share.

    In complete mode each batch replaces the table; else it is added, under
    the batch's number, so that a batch that is run again replaces itself.
    """
    table = f"{folder}/table"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(table if mode == "complete" else f"{table}/batch={number}")

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(table).select(*stream.columns)


def degree_stream(edges: DataFrame) -> DataFrame:
    """id, degree of a stream of src, dst: each edge counts once for either end; loops don't."""
    ends = edges.filter("src <> dst").select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


class EvolvingGraph:
    """A base of edges, and the additions and deletions since, in one folder; exactly once for each micro-batch.

    Additions and deletions lie under their batch's number. The base's folder
    carries the last batch it holds; readers take the newest complete base
    and the batches after it, so compaction swaps both at once.
    """

    def __init__(self, spark: SparkSession, path: str, buffer_edges: int = 1_000_000, compact_share: float = 0.8, delete_share: float = 0.1):
        self.spark, self.path, self.buffer_edges = spark, path, buffer_edges
        self.compact_share, self.delete_share = compact_share, delete_share

    def _files(self, folder: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, folder: str) -> list[int]:
        """The numbers of a folder's complete parts."""
        path, system = self._files(folder)
        if not system.exists(path):
            return []
        parts = [x.getPath() for x in system.listStatus(path)]
        path_of = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName().split("=")[1]) for p in parts if "=" in p.getName() and system.exists(path_of(p, "_SUCCESS")))

    def _since(self, folder: str) -> DataFrame:
        base = max(self._numbers("base"), default=-1)
        parts = [f"{self.path}/{folder}/batch={n}" for n in self._numbers(folder) if n > base]
        rows = self.spark.read.schema("src long, dst long, batch long").option("basePath", f"{self.path}/{folder}")
        return rows.parquet(*parts) if parts else self.spark.createDataFrame([], "src long, dst long, batch long")

    def _commit(self, batch: DataFrame, number: int) -> None:
        # a batch that is run again overwrites its own files
        rows = batch.filter("src <> dst")
        gone = F.coalesce(F.col("op") == "delete", F.lit(False)) if "op" in batch.columns else F.lit(False)
        rows.filter(~gone).select("src", "dst").write.mode("overwrite").parquet(f"{self.path}/delta/batch={number}")
        if "op" in batch.columns:
            rows.filter(gone).select("src", "dst").distinct().write.mode("overwrite").parquet(f"{self.path}/deleted/batch={number}")

    def follow(self, edges: DataFrame, on_batch: Callable[[DataFrame, int], None] | None = None) -> None:
        """Commits all that the stream (src, dst, and op "add" or "delete" if any) has now.

        A deletion takes away the edge as it stood before its batch. on_batch
        sees each batch's edges (to schedule their ends).
        """

        def commit(batch: DataFrame, number: int) -> None:
            self._commit(batch, number)
            if on_batch is not None:
                on_batch(batch, number)
            if self.due():
                self.compact()

        query = edges.writeStream.foreachBatch(commit).option("checkpointLocation", f"{self.path}/progress").trigger(availableNow=True).start()
        query.awaitTermination()

    def edges(self) -> DataFrame:
        """Base and additions together, without what was deleted after it came; buffered edges are seen at once."""
        base = max(self._numbers("base"), default=None)
        rows = self._since("delta")
        if base is not None:
            rows = rows.union(self.spark.read.schema("src long, dst long").parquet(f"{self.path}/base/upto={base}").withColumn("batch", F.lit(base).cast("long")))
        gone = self._since("deleted").groupBy("src", "dst").agg(F.max("batch").alias("_gone"))
        left = rows.join(gone, ["src", "dst"], "left").filter(F.col("_gone").isNull() | (F.col("batch") >= F.col("_gone")))
        return left.select("src", "dst")

    def degrees(self) -> DataFrame:
        """id, degree after additions and deletions: each edge counts once for either end."""
        return degree_stream(self.edges())

    def due(self) -> bool:
        """Whether the buffer is filled to compact_share, or deletions are delete_share of the base and buffer."""
        added, gone = self._since("delta").count(), self._since("deleted").count()
        if added >= self.compact_share * self.buffer_edges:
            return True
        return gone > 0 and gone >= self.delete_share * (added + self._base_size())

    def _base_size(self) -> int:
        base = max(self._numbers("base"), default=None)
        return 0 if base is None else self.spark.read.parquet(f"{self.path}/base/upto={base}").count()

    def compact(self) -> DataFrame:
        """Folds all batches into a new base, in ranges of dst sorted by src, and removes what it replaces."""
        batches = self._numbers("delta")
        old = self._numbers("base")
        if batches and batches[-1] > max(old, default=-1):
            last = batches[-1]
            self.edges().repartitionByRange("dst").sortWithinPartitions("src").write.mode("overwrite").parquet(f"{self.path}/base/upto={last}")
            for folder, numbers, name in (("delta", batches, "batch"), ("deleted", self._numbers("deleted"), "batch"), ("base", old, "upto")):
                for n in numbers:
                    if n <= last and (folder != "base" or n < last):
                        path, system = self._files(f"{folder}/{name}={n}")
                        system.delete(path, True)
        return self.edges()


def tumbling_counts(events: DataFrame, width: str, lateness: str = "1 day") -> DataFrame:
    """start, event_type, n in windows of a width."""
    window = F.window("ts", width)
    return events.withWatermark("ts", lateness).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def session_counts(events: DataFrame, gap: str, lateness: str = "1 day") -> DataFrame:
    """user_id, start, n of sessions that end after a gap."""
    window = F.session_window("ts", gap)
    return events.withWatermark("ts", lateness).groupBy(window, "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")
