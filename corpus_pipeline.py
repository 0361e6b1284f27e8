"""A corpus pipeline of five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and is written as Parquet and read
again before the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import held_out, session
from tessera.llm.exact_dedup import keep_one
from tessera.llm.jaccard_join import keep_representatives
from tessera.llm.language import keep_identified, train
from tessera.llm.packing import pack_documents
from tessera.llm.substring_dedup import substring_dedup

#: Packing has no SQL form (tokenizer, bin slack), so the rows of run() have none; tests hold the stages against brute force.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null texts too) and those whose language is ambiguous.

    Each row is judged by its text alone, so rows without a doc_id and
    repeated rows are as good as any. No row in, no row out.
    """
    return keep_identified(docs, train(docs.filter(~held_out(F.col("doc_id")))))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the largest doc_id of equal texts (see keep_one for null and repeated ids)."""
    return keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of every component of near duplicates (see keep_representatives for null and repeated ids)."""
    return keep_representatives(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes 50-word passages that an earlier document has.

    A document that loses words keeps the others, joined by single spaces;
    one that loses all of them goes; any other stays as it is. Rows without a
    doc_id lose nothing; repeated rows lose the same.
    """
    done = substring_dedup(docs, with_row=True).filter("n_removed = 0 OR n_removed < n_words")
    cleaned = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    columns = [F.when(F.col("n_removed") > 0, cleaned[c]).otherwise(F.col("row")[c]).alias(c) if c in cleaned else F.col("row")[c].alias(c) for c in docs.columns]
    return done.select(*columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left, every row of it, into sequences of 4096 tokens; null texts are the end mark alone."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("jaccard_join", near_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on sf_dir's documents; what each returns is written to the checkpoint folder and read again."""
    session(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:  # what the stage read isn't needed again
            system.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before), True)
        before = f"{folder}/{name}"
    return docs
