"""The inputs that the queries derive from the tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COPURCHASE = """
copurchase AS (
  SELECT src, dst FROM (
    SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem
  ) AS pairs WHERE dst IS NOT NULL AND src <> dst
), vertices AS (SELECT src AS id FROM copurchase UNION SELECT dst FROM copurchase)
"""
BOTH = "both_ways AS (SELECT src, dst FROM copurchase UNION ALL SELECT dst, src FROM copurchase)"
RATINGS = """
ratings AS (
  SELECT o_custkey AS "user", l_partkey AS item, sum(l_quantity) AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey
)
"""
LINKS = """
hrefs AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS url FROM pages),
urls AS (SELECT url, row_number() OVER (ORDER BY url) - 1 + 1000000000 AS url_id FROM (SELECT DISTINCT url FROM hrefs) AS u),
links AS (SELECT page_id AS src, url_id AS dst FROM hrefs JOIN urls USING (url))
"""
PACKETS = """
packets AS (
  SELECT event_id, ts, user_id AS flow, CAST(floor(value) AS BIGINT) AS len,
         CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS colour
  FROM events
)
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def copurchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: parts that follow each other in an order; parallel edges are kept."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst")).filter("dst IS NOT NULL AND src <> dst")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user, item, rating: quantity of each part that a customer bought."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    sold = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return sold.groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).agg(F.sum("l_quantity").alias("rating"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: page to URL; URLs are numbered from 10**9 in their order."""
    from ..operators.etl import dictionary

    found = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("url"))
    ids = dictionary(found.select("url"), "url").select("url", (F.col("id") + 1_000_000_000).alias("url_id"))
    return found.join(ids, "url").select(F.col("page_id").alias("src"), F.col("url_id").alias("dst"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    colour = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return read(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("flow"), F.floor("value").cast("long").alias("len"), colour.alias("colour"))
