"""Streaming queries over the events, each run until it has read all there is."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import cut
from ..streaming import edges as S
from .views import read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark) -> str:
    """A new folder next to the checkpoints, which all executors share."""
    cut(spark.range(1))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"


def _events(spark, sf_dir):
    schema = read(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*events*" if sf_dir.endswith(".parquet") else "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


EDGES = "e AS (SELECT user_id AS src, event_id % 97 AS dst FROM events WHERE user_id <> event_id % 97)"


def _edges(spark, sf_dir):
    return _events(spark, sf_dir).select(F.col("user_id").alias("src"), (F.col("event_id") % 97).alias("dst"))


@query(f"WITH {EDGES} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) AS x GROUP BY id")
def stream_degrees(spark, sf_dir):
    return S.run_to_end(S.degree_stream(_edges(spark, sf_dir)), "complete", _folder(spark))


@query(f"WITH {EDGES} SELECT src, dst, count(*) AS times FROM e GROUP BY src, dst")
def stream_edges_commit(spark, sf_dir):
    graph = S.EvolvingGraph(spark, _folder(spark))
    graph.follow(_edges(spark, sf_dir))
    return graph.compact().groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times"))


@query("SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    out = S.run_to_end(S.tumbling_counts(_events(spark, sf_dir), "1 day"), "complete", _folder(spark))
    return out.select(F.floor(F.unix_timestamp("start") / 86400).alias("day"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_counts(spark, sf_dir):
    out = S.run_to_end(S.session_counts(_events(spark, sf_dir), "6 hours"), "complete", _folder(spark))
    return out.select("user_id", F.unix_timestamp("start").alias("start"), "n")
