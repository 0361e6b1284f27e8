"""Exact deduplication that no large group of copies can slow down.

DataFrame functions only. Rows whose digest occurs once have no copy, so only
rows with a repeated digest carry their text on. Those are combined three
times, each time by digest and full content: within a task (the partial
aggregate), within a salt, and over the at most `salts` winners of a group.
The answer goes back to the rows by (digest, content, salt). Digests that
hold over a thousandth of all rows (fewer than a thousand can) are salted in
the joins too, so even a group with a third of all rows is spread out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, session, table

SALTS = 64
#: A digest with more than one in so many rows is hot; there are fewer hot ones than this.
HOT_SHARE = 1000


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical byte for byte; null counts as the empty
    text. Of equal texts the row with the largest doc_id stays. Rows that
    repeat both doc_id and text get the same answer (all are kept or none). A
    null doc_id is smaller than any other. Other columns of docs are ignored.
    """
    session(docs)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    rows = rows.withColumn("digest", F.xxhash64("content"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")

    repeated = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").checkpoint()
    copied = repeated.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in repeated.filter(F.col("n") * HOT_SHARE > copied).select("digest").collect()]
    spread = F.when(F.col("digest").isin(hot), salt).otherwise(0) if hot else F.lit(0)
    targets = F.when(F.col("digest").isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0))
    repeated = repeated.select("digest", F.explode(targets).alias("spread"))

    alone = rows.select("doc_id", "digest", spread.alias("spread"), F.sha2("content", 256).alias("text_sha256"))
    alone = alone.join(repeated, ["digest", "spread"], "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256"
    )

    copies = rows.withColumn("spread", spread).join(repeated, ["digest", "spread"], "left_semi")
    copies = copies.select("doc_id", F.sha2("content", 256).alias("text_sha256"), "content", salt.alias("salt")).checkpoint()
    by_salt = copies.groupBy("text_sha256", "content", "salt").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("text_sha256", "content")
    winners = by_salt.select(
        "text_sha256", "content", "salt", F.max("top").over(group).alias("keep_id"), F.sum("n").over(group).alias("group_size")
    )
    grouped = copies.join(winners, ["text_sha256", "content", "salt"]).select("doc_id", "keep_id", "group_size", "text_sha256")
    return alone.unionByName(grouped).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs (with doc_id, text) that exact_dedup keeps, unchanged.

    Of equal texts the largest doc_id stays; rows that repeat it with its text
    stay with it. Rows without a doc_id stay only where no row of their text
    has one.
    """
    digest = free_name(docs.columns, "digest")
    gone = exact_dedup(docs).filter("NOT kept").select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_sha")).distinct()
    keyed = docs.withColumn(digest, F.sha2(F.coalesce("text", F.lit("")), 256))
    return keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")) & (F.col(digest) == F.col("_sha")), "left_anti").drop(digest)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
