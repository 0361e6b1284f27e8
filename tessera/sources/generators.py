"""Random graphs, drawn by hashes of ids so that a lost partition comes out the same again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(seed: int, *columns) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 53)) / float(1 << 53)


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = 0) -> DataFrame:
    """src, dst: each pair i < j with probability p, in a random direction. Pairs are numbered, not joined."""
    pairs = spark.range(n * (n - 1) // 2).filter(_uniform(seed, "id") < p)
    j = F.floor((1 + F.sqrt(1 + 8 * F.col("id").cast("double"))) / 2).cast("long")
    j = F.when(j * (j - 1) / 2 > F.col("id"), j - 1).when(j * (j + 1) / 2 <= F.col("id"), j + 1).otherwise(j)
    i = F.col("id") - (j * (j - 1) / 2).cast("long")
    swap = _uniform(seed + 1, "id") < 0.5
    return pairs.select(F.when(swap, j).otherwise(i).alias("src"), F.when(swap, i).otherwise(j).alias("dst"))


def kronecker(spark: SparkSession, scale: int = 14, edge_factor: int = 16, a: float = 0.57, b: float = 0.19, c: float = 0.19, seed: int = 0) -> DataFrame:
    """src, dst of edge_factor * 2**scale edges of an R-MAT graph; labels are scrambled by a bijection."""
    edges = spark.range(edge_factor << scale)
    src = dst = F.lit(0).cast("long")
    for bit in range(scale):
        u = _uniform(seed + bit, "id")
        down = u >= a + b
        right = ((u >= a) & ~down) | (u >= a + b + c)
        src, dst = src * 2 + down.cast("long"), dst * 2 + right.cast("long")
    mask = (1 << scale) - 1
    scramble = lambda x: (x * F.lit(0x9E3779B1 | 1) + F.lit(seed * 2 + 12345)).bitwiseAND(F.lit(mask))
    return edges.select(scramble(src).alias("src"), scramble(dst).alias("dst"))


def implicit_edges(spark: SparkSession, users: int, items: int, share: float, value: float = 1.0, seed: int = 0) -> DataFrame:
    """user, item, rating: share * users * items random entries of one value."""
    rows = spark.range(int(share * users * items))
    return rows.select((_uniform(seed, "id") * users).cast("long").alias("user"), (_uniform(seed + 1, "id") * items).cast("long").alias("item"), F.lit(value).alias("rating")).distinct()


def stream_split(edges: DataFrame, share: float, most: int, seed: int = 0) -> DataFrame:
    """edges with base: true for about `share` of those between ids up to most; the rest is for the stream."""
    small = (F.col("src") <= most) & (F.col("dst") <= most)
    return edges.withColumn("base", small & (_uniform(seed, "src", "dst") < share))


def with_random_values(edges: DataFrame, most: int = 5, seed: int = 0) -> DataFrame:
    """src, dst, value: 1 to `most` random values on each edge between different, nonnegative ids."""
    kept = edges.filter("src >= 0 AND dst >= 0 AND src <> dst")
    n = 1 + (_uniform(seed, "src", "dst") * most).cast("int")
    draw = F.transform(F.sequence(F.lit(1), n), lambda i: F.pmod(F.xxhash64(F.lit(seed), "src", "dst", i), F.lit(1000)).cast("float") / 1000)
    return kept.select("src", "dst", draw.cast("array<float>").alias("value"))
