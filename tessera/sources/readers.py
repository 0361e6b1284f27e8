"""Readers of graph and matrix text formats. All give DataFrames; none infers a schema."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VALUE_TYPES = {"int": "int", "unsigned": "long", "uint": "long", "float": "float", "long": "long", "char": "string", "bool": "boolean", "boolean": "boolean", "double": "double", "short": "short"}
#: Lines of one chunk when lines are numbered.
CHUNK = 100_000


def _tokens(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"[\t, ]+", " ")), " ")


def _long(tokens: Column, i: int) -> Column:
    return F.try_element_at(tokens, F.lit(i)).try_cast("long")


def edge_list(spark: SparkSession, path: str, value_type: str | None = None) -> DataFrame:
    """src, dst[, value] of lines `src dst [value]`, split at tabs, commas or spaces.

    Lines that start with # or % and loops are dropped; a missing value is 0.
    """
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*([#%]|$)"))
    x = _tokens(F.col("value"))
    out = [_long(x, 1).alias("src"), _long(x, 2).alias("dst")]
    if value_type is not None:
        kind = VALUE_TYPES[value_type]
        value = F.try_element_at(x, F.lit(3)).try_cast(kind)
        out.append((value if kind in ("string", "boolean") else F.coalesce(value, F.lit(0).cast(kind))).alias("value"))
    return lines.select(*out).filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")


def multi_value_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, value (array of float) of lines `src dst a:b:c`."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*([#%]|$)"))
    x = _tokens(F.col("value"))
    values = F.coalesce(F.split(F.try_element_at(x, F.lit(3)), ":"), F.array().cast("array<string>")).cast("array<float>")
    return lines.select(_long(x, 1).alias("src"), _long(x, 2).alias("dst"), values.alias("value")).filter("src <> dst")


def adjacency_list(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of lines `src n d1 .. dn`; edges are kept where the count is wrong."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*([#%]|$)"))
    x = _tokens(F.col("value"))
    rest = lines.select(_long(x, 1).alias("src"), F.explode(F.slice(x, 3, F.greatest(F.size(x) - 2, F.lit(0)))).alias("_d"))
    return rest.select("src", F.col("_d").try_cast("long").alias("dst")).filter("src <> dst")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """n, value: lines of one text in their order, numbered from 0; of a folder, file by file in order of name.

    Spark keeps a file's lines in order within its splits; splits are ordered
    by file and offset, and ranks are taken within splits.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"))
    sizes = lines.groupBy("_file", "_split").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    shift = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_file", "_split", (shift - F.col("_first")).alias("_shift"))
    return lines.join(sizes, ["_file", "_split"]).select((F.col("_id") + F.col("_shift")).alias("n"), "value")


def metis(spark: SparkSession, path: str, base: int = 1) -> DataFrame:
    """src, dst: header `n m`, then a row of neighbours for each vertex from base; each edge once (src <= dst)."""
    lines = numbered_lines(spark, path).filter(~F.col("value").startswith("%") & (F.col("n") > 0))
    x = F.filter(_tokens(F.col("value")), lambda t: F.length(t) > 0)
    return lines.select((F.col("n") - 1 + base).alias("src"), F.explode(x).alias("_d")).select("src", F.col("_d").try_cast("long").alias("dst")).filter("src < dst")


def cassovary(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of blocks: a line `id n`, then n lines with a neighbour each."""
    lines = numbered_lines(spark, path)
    x = _tokens(F.col("value"))
    tagged = lines.select("n", F.when(F.size(x) > 1, x[0].cast("long")).alias("head"), x[0].cast("long").alias("id"), F.floor(F.col("n") / CHUNK).alias("chunk"))
    # the last head so far: within a chunk, or else the last one of the chunks before
    own = F.last("head", ignorenulls=True).over(Window.partitionBy("chunk").orderBy("n"))
    heads = tagged.groupBy("chunk").agg(F.max_by("head", F.when(F.col("head").isNotNull(), F.col("n"))).alias("h"))
    carried = heads.select("chunk", F.last("h", ignorenulls=True).over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    rows = tagged.withColumn("own", own).join(carried, "chunk")
    return rows.filter("head IS NULL").select(F.coalesce("own", "carried").alias("src"), F.col("id").alias("dst")).filter("src <> dst")


def binary_edge_list(spark: SparkSession, path: str, value: str | None = None) -> DataFrame:
    """src, dst[, value] of files of little-endian records u32, u32[, value]; value: a numpy type such as "<f4".

    Files are read in splits at record bounds, whatever their size.
    """
    kind = np.dtype([("src", "<u4"), ("dst", "<u4")] + ([("value", value)] if value else []))

    def run(records: Iterator[bytes]) -> Iterator[tuple]:
        while part := b"".join(islice(records, 1 << 16)):
            x = np.frombuffer(part, kind)
            yield from zip(*(x[n].astype(float if n == "value" else np.int64).tolist() for n in kind.names))

    schema = "src long, dst long" + (", value double" if value else "")
    records = spark.sparkContext.binaryRecords(path, kind.itemsize).mapPartitions(lambda x: run(iter(x)))
    return spark.createDataFrame(records, schema).filter("src <> dst")


def long_pairs(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of files of little-endian pairs of 64-bit numbers; negative ids and loops are dropped."""
    records = spark.sparkContext.binaryRecords(path, 16).map(lambda x: struct.unpack("<qq", x))
    return spark.createDataFrame(records, "src long, dst long").filter("src >= 0 AND dst >= 0 AND src <> dst")


@dataclass(frozen=True)
class MatrixHeader:
    """What a Matrix Market file says of itself; size: rows, columns and, of a coordinate file, entries."""

    format: str
    field: str
    symmetry: str
    size: tuple[int, ...]


def matrix_header(lines: DataFrame) -> MatrixHeader:
    """The header of numbered lines (n, value). A file without a banner is a general coordinate file of reals."""
    first = lines.orderBy("n").filter("value LIKE '!%!%MatrixMarket%' ESCAPE '!'").select("value").first()
    words = first[0].lower().split() if first else []
    _, thing, format_, kind, symmetry = words[:5] if len(words) >= 5 else ["", "matrix", "coordinate", "real", "general"]
    if thing != "matrix" or format_ not in ("coordinate", "array") or kind not in ("real", "double", "integer", "pattern") or symmetry not in ("general", "symmetric", "skew-symmetric"):
        raise ValueError(f"not a Matrix Market type that can be read: {' '.join(words)}")
    many = 3 if format_ == "coordinate" else 2
    data = lines.filter(~F.col("value").startswith("%") & (F.trim("value") != "")).orderBy("n").limit(many).collect()
    size = [int(float(t)) for row in data for t in row["value"].split()][:many]
    return MatrixHeader(format_, kind, symmetry, tuple(size))


def _token_rows(lines: DataFrame, skip: int, width: int) -> DataFrame:
    """k, x: tokens of numbered lines in order without the first `skip`, in arrays of `width`, wherever lines break.

    Tokens are counted within chunks of lines, then shifted.
    """
    x = F.filter(_tokens(F.col("value")), lambda t: F.length(t) > 0)
    counted = lines.select("n", x.alias("x"), F.floor(F.col("n") / CHUNK).alias("chunk"))
    before = Window.partitionBy("chunk").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    local = counted.withColumn("at", F.coalesce(F.sum(F.size("x")).over(before), F.lit(0)))
    sums = counted.groupBy("chunk").agg(F.sum(F.size("x")).alias("t"))
    shift = sums.select("chunk", F.coalesce(F.sum("t").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    token = local.join(shift, "chunk").select((F.col("at") + F.col("shift") - skip).alias("at"), F.posexplode("x").alias("i", "t"))
    token = token.select((F.col("at") + F.col("i")).alias("at"), "t").filter("at >= 0")
    rows = token.groupBy(F.floor(F.col("at") / width).alias("k")).agg(F.sort_array(F.collect_list(F.struct("at", "t"))).alias("x"))
    return rows.select("k", F.col("x.t").alias("x"))


def matrix_market(spark: SparkSession, path: str, columns: tuple[str, ...] = ("user", "item", "rating"), check: bool = True) -> DataFrame:
    """Coordinates of a Matrix Market file or folder, ids from 1 as they stand; the size line is dropped.

    columns: user, item, rating, and of four-column files the names in the
    file's order. A pattern matrix has rating 1; a symmetric one gets the
    mirrored entries, a skew-symmetric one their negatives. Tokens may also
    stand one to a line. With check, ids outside the header's size raise an
    error.
    """
    lines = numbered_lines(spark, path)
    header = matrix_header(lines)
    body = lines.filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    first = body.agg(F.min_by("value", "n").alias("v"), F.min("n").alias("n")).first()
    if first["v"] is None or len(first["v"].split()) >= len(header.size):
        rows = body.filter(F.col("n") > (first["n"] if first["n"] is not None else -1)).select(_tokens(F.trim("value")).alias("x"))
    else:
        rows = _token_rows(body, len(header.size), 2 if header.field == "pattern" else len(columns)).select("x")
    x = F.col("x")
    out = [_long(x, i + 1).alias(c) if i < 2 else F.coalesce(F.try_element_at(x, F.lit(i + 1)).try_cast("double"), F.lit(1.0)).alias(c) for i, c in enumerate(columns)]
    entries = rows.select(*out).filter(F.col(columns[0]).isNotNull() & F.col(columns[1]).isNotNull())
    if check and len(header.size) >= 2:
        a, b = F.col(columns[0]), F.col(columns[1])
        wrong = entries.filter(~(a.between(1, header.size[0]) & b.between(1, header.size[1]))).limit(1).collect()
        if wrong:
            raise ValueError(f"{tuple(wrong[0])} lies outside the matrix of {header.size[0]} x {header.size[1]}")
    if header.symmetry != "general":
        sign = -1 if header.symmetry == "skew-symmetric" else 1
        other = [F.col(columns[1]).alias(columns[0]), F.col(columns[0]).alias(columns[1]), *[(sign * F.col(c)).alias(c) if c == "rating" else F.col(c) for c in columns[2:]]]
        entries = entries.union(entries.filter(F.col(columns[0]) != F.col(columns[1])).select(*other))
    return entries


def matrix_market_array(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """id (from 1), f: the rows of a dense Matrix Market array, as arrays; stored column by column as the format has it."""
    lines = numbered_lines(spark, path)
    rows, columns = matrix_header(lines).size
    body = lines.filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    value = _token_rows(body, 2, 1).select("k", F.element_at("x", 1).cast("double").alias("v"))
    cells = value.select((F.pmod("k", F.lit(rows)) + 1).alias("id"), F.struct(F.floor(F.col("k") / rows).alias("j"), "v").alias("c"))
    return cells.groupBy("id").agg(F.sort_array(F.collect_list("c")).alias("c")).select("id", F.slice("c.v", 1, size or columns).alias("f"))


def with_item_similarity(ratings: DataFrame, similar: DataFrame) -> DataFrame:
    """src, dst, value, kind: ratings (user, item, rating) and item pairs (item, other, sim) as edges of one graph.

    Items are told from users by their kind of edge: rating edges go from a user, similarity edges from an item; loops go.
    """
    rated = ratings.select(F.col("user").alias("src"), F.col("item").alias("dst"), F.col("rating").cast("double").alias("value"), F.lit("rating").alias("kind"))
    pairs = similar.filter("item <> other").select(F.col("item").alias("src"), F.col("other").alias("dst"), F.col("sim").cast("double").alias("value"), F.lit("similar").alias("kind"))
    return rated.unionByName(pairs)


FORMATS = {"edgelist": edge_list, "multivalueedgelist": multi_value_edge_list, "adjlist": adjacency_list, "metis": metis, "cassovary": cassovary, "binedgelist": binary_edge_list, "matrixmarket": matrix_market}


def read_graph(spark: SparkSession, path: str, format: str, **options) -> DataFrame:
    """Edges in any of FORMATS."""
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}; known: {', '.join(FORMATS)}")
    return FORMATS[format](spark, path, **options)


def without_values(edges: DataFrame) -> DataFrame:
    """src, dst alone: the conversion to a graph without edge values."""
    return edges.select("src", "dst")


def up_to(edges: DataFrame, most: int) -> DataFrame:
    """The edges whose ends are at most the largest id allowed."""
    return edges.filter((F.col("src") <= most) & (F.col("dst") <= most))


def converted(spark: SparkSession, path: str, format: str, cache: str, **options) -> DataFrame:
    """Edges of a text graph, kept as Parquet in the folder `cache`; converted again only if the source is newer."""
    system = lambda p: p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    source, done = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{cache}/_SUCCESS"))
    fresh = system(done).exists(done) and system(done).getFileStatus(done).getModificationTime() >= system(source).getFileStatus(source).getModificationTime()
    if not fresh:
        read_graph(spark, path, format, **options).write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def write_pairs(edges: DataFrame, path: str, *columns: str) -> None:
    """Tab-separated text of the columns."""
    edges.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in columns or edges.columns])).write.mode("overwrite").text(path)


def write_matrix_market(entries: DataFrame, path: str, rows: int, columns: int) -> None:
    """A folder of text parts that matrix_market reads: the first has the banner and size, the others the entries."""
    n = entries.count()
    body = entries.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in entries.columns]).alias("value"))
    head = entries.sparkSession.createDataFrame([(f"%%MatrixMarket matrix coordinate real general\n{rows} {columns} {n}",)], "value string")
    head.coalesce(1).union(body).write.mode("overwrite").text(path)


def write_vectors(vectors: DataFrame, path: str, rows: int) -> None:
    """Vectors (id from 1, f) as a Matrix Market coordinate folder: `id column value` lines."""
    width = vectors.select(F.max(F.size("f"))).first()[0] or 0
    cells = vectors.select("id", F.posexplode("f").alias("j", "v")).select("id", (F.col("j") + 1).alias("j"), "v")
    write_matrix_market(cells, path, rows, width)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """id, f: vectors written by write_vectors; absent columns are 0."""
    width = matrix_header(numbered_lines(spark, path)).size[1]
    cells = matrix_market(spark, path, ("id", "j", "v"))
    filled = cells.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("j").cast("int"), "v"))).alias("m"))
    return filled.select("id", F.transform(F.sequence(F.lit(1), F.lit(width)), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0))).alias("f"))


def write_predictions(predicted: DataFrame, path: str, rows: int, columns: int) -> None:
    """`user item prediction` lines, as a Matrix Market folder."""
    write_matrix_market(predicted.select("user", "item", "prediction"), path, rows, columns)


def range_partitioned(edges: DataFrame, parts: int) -> DataFrame:
    """Edges in contiguous ranges of dst, each sorted by src: the sharded layout."""
    return edges.repartitionByRange(parts, "dst").sortWithinPartitions("src", "dst")
