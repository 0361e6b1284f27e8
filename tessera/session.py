"""Session helpers: where lineage is cut."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame


def checkpoint_folder(context) -> str:
    """The folder that spark.checkpoint.dir names; on one machine, where it is unset, one of our own.

    On a cluster a folder of one machine would be out of the others' reach, so there an unset folder is an error.
    """
    folder = context._jsc.sc().getCheckpointDir()
    if folder.isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
        folder = context._jsc.sc().getCheckpointDir()
    return folder.get()


def cut(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder; executors may be lost afterwards."""
    checkpoint_folder(df.sparkSession.sparkContext)
    return df.checkpoint()


def collect(spark) -> None:
    """Python lets go of plans, the JVM of what they held, and Spark removes their shuffle files; each tells the next with a delay."""
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.6)


class Stored:
    """df as a compressed Parquet table in the session's checkpoint folder, until drop()."""

    def __init__(self, df: DataFrame):
        spark, schema = df.sparkSession, df.schema
        self.spark, self.path = spark, f"{checkpoint_folder(spark.sparkContext)}/table-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        del df
        self.df = spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        """Only once nothing that is still to be computed reads the table."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
