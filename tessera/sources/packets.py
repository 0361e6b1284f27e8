"""Where packets come from and go to: synthetic and stored packets, fragmenting readers, and sinks.

Packets are rows (event_id, flow, time in microseconds, len, ...). The same
functions serve tables and streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.flows import fragment, reassemble
from .generators import _uniform


def synthetic(spark: SparkSession, n: int, flows: int, seed: int = 0, longest: int = 1500) -> DataFrame:
    """n packets of random flows and lengths, a microsecond apart."""
    rows = spark.range(n)
    return rows.select(
        F.col("id").alias("event_id"), (_uniform(seed, "id") * flows).cast("long").alias("flow"), F.col("id").alias("time"), (1 + _uniform(seed + 1, "id") * longest).cast("long").alias("len")
    )


def synthetic_stream(spark: SparkSession, per_second: int, flows: int, seed: int = 0) -> DataFrame:
    """An endless stream of the same kind, at a rate."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return rows.select(
        F.col("value").alias("event_id"), (_uniform(seed, "value") * flows).cast("long").alias("flow"), F.unix_micros("timestamp").alias("time"), (1 + _uniform(seed + 1, "value") * 1500).cast("long").alias("len")
    )


def stored(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    """Packets of Parquet files, at once or as files appear."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).parquet(path)


def ring(*ports: DataFrame) -> DataFrame:
    """Several ports' packets as one input."""
    out = ports[0]
    for port in ports[1:]:
        out = out.unionByName(port)
    return out


def fragmented(packets: DataFrame, mtu: int) -> DataFrame:
    """A reading port that cuts packets to fragments on their way in."""
    return fragment(packets, mtu)


def to_table(packets: DataFrame, path: str) -> None:
    """A sink that keeps all packets as Parquet."""
    packets.write.mode("overwrite").parquet(path)


def drop(packets: DataFrame) -> None:
    """A sink that takes packets and keeps none."""
    packets.write.format("noop").mode("overwrite").save()


def reassembled_to_table(fragments: DataFrame, path: str, key: str = "event_id") -> None:
    """A sink that keeps whole packets only."""
    reassemble(fragments, key).filter("complete").select(key, "len").write.mode("overwrite").parquet(path)


def stream_to_table(packets: DataFrame, path: str, checkpoint: str) -> None:
    """A stream's packets appended to a table, each once, up to what is there now."""
    packets.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
