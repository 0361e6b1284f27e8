"""What the text operators share: reading, batches, checkpoints, training samples."""

from __future__ import annotations

import ctypes
import functools
import gc
import operator
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder

#: Rows of one Arrow batch; keeps a Python worker's memory small.
BATCH_ROWS = 512
#: Bytes of text that a kernel works on at once; a longer document goes alone.
BATCH_BYTES = 2 << 20


#: The words of each document, as SQL.
WORDS_SQL = r"""words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
)"""


def session(df_or_spark) -> SparkSession:
    """The session, with small Arrow batches and a checkpoint folder (that of spark.checkpoint.dir, see checkpoint_folder)."""
    spark = df_or_spark if isinstance(df_or_spark, SparkSession) else df_or_spark.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    checkpoint_folder(spark.sparkContext)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the rows no classifier may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one buffer, and the bounds; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches between rows so that each has at most about `limit` bytes of text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end
    release()


def release() -> None:
    """Gives memory that a Python worker has no use for back to the system; the worker stays for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


def merged(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 2 * BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Joins batches until they have about `limit` bytes of text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(text)).nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def free_name(columns: list[str], name: str) -> str:
    """name, with as many underscores before it as it needs to be none of the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def per_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values of each document."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, dtype=np.int64, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def sample_by_class(rows: DataFrame, label: str, key: str, per_class: int) -> DataFrame:
    """About `per_class` rows of each label, chosen by a hash of the key.

    Only the class sizes come to the driver. Each class is thinned on the
    executors to at most a quarter over the bound in expectation, so the
    sample's size doesn't depend on the corpus.
    """
    sizes = {r[0]: r["count"] for r in rows.groupBy(label).count().collect() if r[0] is not None}
    if not sizes:
        return rows.limit(0)
    unit = 1 << 40
    chosen = []
    for name, n in sizes.items():
        share = min(unit, int(unit * per_class / n))
        chosen.append((F.col(label) == F.lit(name)) & (F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(unit)) < share))
    while len(chosen) > 1:  # a flat tree, however many labels there are
        chosen = [functools.reduce(operator.or_, chosen[i : i + 2]) for i in range(0, len(chosen), 2)]
    return rows.filter(chosen[0])


def cut(df: DataFrame, release: bool = False) -> DataFrame:
    """Writes df to the checkpoint folder, so that nothing before it is needed again.

    The shuffle files behind it are then garbage once df itself is (give it
    as an expression, not by a name that lives on). release asks for the
    collections that let Spark remove them now, and not when memory happens
    to run short; worth a second where gigabytes were shuffled.
    """
    spark, kept = df.sparkSession, df.checkpoint()
    del df
    if release:
        _collect(spark)
    return kept


def _collect(spark: SparkSession) -> None:
    """Python lets go of plans, the JVM of what they held, and Spark removes the files; each tells the next with a delay."""
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.6)


class Written:
    """df as a Parquet table in the checkpoint folder, compressed, until drop()."""

    def __init__(self, df: DataFrame):
        self.spark, schema = df.sparkSession, df.schema
        self.path = f"{session(df).sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        del df
        self.df = self.spark.read.schema(schema).parquet(self.path)
        _collect(self.spark)

    def drop(self) -> None:
        """Only once nothing that is still to be computed reads the table."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
