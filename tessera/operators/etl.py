"""Parsers and aggregations of logs, tables and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import rank_by


def sum_by_pair(rows: DataFrame, left: str, right: str, value: str) -> DataFrame:
    """Sum of a value for each pair of keys."""
    return rows.groupBy(left, right).agg(F.sum(value).alias("total"))


def top_per_key(rows: DataFrame, key: str, k: int, order: list) -> DataFrame:
    """The first k rows of each key in an order, with their rank from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def first_per_key(lines: DataFrame, k: int, column: str = "value") -> DataFrame:
    """key, ids, values: the first k entries of each key in the lines' own order, from numbered lines (n, value) `key id value`."""
    x = F.split(F.trim(F.col(column)), r"[\t ]+")
    rows = lines.select("n", F.try_element_at(x, F.lit(1)).try_cast("long").alias("key"), F.try_element_at(x, F.lit(2)).try_cast("long").alias("id"), F.try_element_at(x, F.lit(3)).try_cast("double").alias("v"))
    kept = top_per_key(rows.filter("key IS NOT NULL AND id IS NOT NULL"), "key", k, ["n"])
    lists = kept.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "v"))).alias("x"))
    return lists.select("key", F.col("x.id").alias("ids"), F.col("x.v").alias("values"))


def merge_sorted(*outputs: DataFrame, order: list) -> DataFrame:
    """Several outputs of the same columns as one, in a global order."""
    out = outputs[0]
    for more in outputs[1:]:
        out = out.unionByName(more)
    return out.orderBy(*order)


def count_by_key(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def token_list(text: Column) -> Column:
    """Tokens of a line: runs without space or punctuation; those after the first need two characters."""
    parts = F.filter(F.split(F.lower(text), r"[\s\p{Punct}]+"), lambda t: F.length(t) > 0)
    return F.filter(parts, lambda t, i: (i == 0) | (F.length(t) > 1))


def bag_of_words(docs: DataFrame, doc_id: str, text: str, least: int = 1, most: int | None = None) -> DataFrame:
    """doc_id, token, n for tokens counted between least and most."""
    counted = docs.select(doc_id, F.explode(token_list(F.col(text))).alias("token")).groupBy(doc_id, "token").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.filter(F.col("n") >= least)
    return counted if most is None else counted.filter(F.col("n") <= most)


def dictionary(rows: DataFrame, column: str) -> DataFrame:
    """column, id: distinct values numbered from 0 in their order."""
    return rank_by(rows.select(column).filter(F.col(column).isNotNull()).distinct(), "id", column).select(column, "id")


def first_seen_ids(lines: DataFrame, columns: list[str], single_domain: bool = False) -> tuple[DataFrame, dict[str, DataFrame]]:
    """lines (n, columns) with ids counted from 1 in order of first sight, and the dictionaries (value, id) by column.

    Each column has its own ids; with single_domain all share one dictionary
    (named "all"), in which a line's columns come from left to right.
    """
    out, found = lines, {}
    for i, group in enumerate([columns] if single_domain else [[c] for c in columns]):
        seen = lines.select("n", F.posexplode(F.array(*group)).alias("at", "value")).filter("value IS NOT NULL")
        first = seen.groupBy("value").agg(F.min(F.struct("n", "at")).alias("f")).select("value", "f.n", "f.at")
        ids = rank_by(first, "id", "n", "at").select("value", (F.col("id") + 1).alias("id"))
        found["all" if single_domain else group[0]] = ids
        for c in group:
            out = out.join(ids.select(F.col("value").alias(c), F.col("id").alias("_id")), c, "left").drop(c).withColumnRenamed("_id", c)
    return out.select(*lines.columns), found


def save_dictionary(ids: DataFrame, path: str) -> None:
    """Text lines `value <tab> id`."""
    ids.select(F.concat_ws("\t", F.col("value").cast("string"), F.col("id").cast("string"))).write.mode("overwrite").text(path)


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """value, id of lines `value <tab> id`; a line of one field gets its number, counted from 1."""
    from ..sources.readers import numbered_lines

    x = F.split("value", "\t")
    lines = numbered_lines(spark, path).filter("value <> ''")
    return lines.select(x[0].alias("value"), F.coalesce(F.try_element_at(x, F.lit(2)).try_cast("long"), F.col("n") + 1).alias("id"))


def adjacency_ids(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Edges (src, dst) by id, the dictionary (value, id from 1), and the sizes, of lines `name k n1 .. nk`."""
    named = adjacency_strings(lines, column)
    names = named.select(F.explode(F.array("src", "dst")).alias("value")).distinct()
    ids = rank_by(names, "id", "value").select("value", (F.col("id") + 1).alias("id"))
    edges = named.join(ids.select(F.col("value").alias("src"), F.col("id").alias("a")), "src").join(ids.select(F.col("value").alias("dst"), F.col("id").alias("b")), "dst")
    edges = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    n = ids.count()
    return edges, ids, {"rows": n, "columns": n, "entries": edges.count()}


def ip_pairs(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(src, dst, attribute) by id, and the dictionary (ip, id from 0), of lines `ip ip attribute`; lines with a bad address are skipped."""
    x = F.split(F.trim(F.col(column)), r"[\t, ]+")
    pick = lambda i: F.try_element_at(x, F.lit(i))
    rows = lines.select(ip_to_long(pick(1)).alias("a"), ip_to_long(pick(2)).alias("b"), pick(3).alias("attribute")).filter("a IS NOT NULL AND b IS NOT NULL")
    ids = rank_by(rows.select(F.explode(F.array("a", "b")).alias("ip")).distinct(), "id", "ip").select("ip", "id")
    side = lambda k, name: ids.select(F.col("ip").alias(k), F.col("id").alias(name))
    return rows.join(side("a", "src"), "a").join(side("b", "dst"), "b").select("src", "dst", "attribute"), ids


def tweets_per_user(lines: DataFrame) -> DataFrame:
    """user, tweets of the user lines (U) of (n, value)."""
    user = F.lower(F.regexp_extract(F.trim(F.expr("substring(value, 2)")), r"([^/]+)/?$", 1))
    return lines.filter(F.col("value").startswith("U")).groupBy(user.alias("user")).agg(F.count(F.lit(1)).alias("tweets"))


def trust_split(trusts: DataFrame, popular: int, least: int, train: int, seed: int = 0) -> DataFrame:
    """user, item, part: trust pairs without the most popular items, of users with `least` left, `train` of each for training.

    Which of a user's pairs train is drawn by a seeded hash; the rest test.
    """
    pairs = trusts.select("user", "item").distinct()
    top = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item").limit(popular).select("item")
    left = pairs.join(F.broadcast(top), "item", "left_anti")
    many = left.groupBy("user").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("user")
    order = Window.partitionBy("user").orderBy(F.xxhash64(F.lit(seed), "user", "item"), "item")
    drawn = left.join(many, "user", "left_semi").withColumn("_r", F.row_number().over(order))
    return drawn.select("user", "item", F.when(F.col("_r") <= train, "train").otherwise("test").alias("part"))


def parse_ini(lines: DataFrame) -> DataFrame:
    """section, key, value of numbered lines (n, value): `[section]`, `key = value`; what follows ; or # is a comment."""
    text = F.trim(F.regexp_replace("value", r"[;#].*$", ""))
    marked = lines.select("n", text.alias("t"), F.when(text.rlike(r"^\[.*\]$"), F.regexp_extract(text, r"^\[(.*)\]$", 1)).alias("s"), F.floor(F.col("n") / 100_000).alias("c"))
    own = F.last("s", ignorenulls=True).over(Window.partitionBy("c").orderBy("n"))
    heads = marked.groupBy("c").agg(F.max_by("s", F.when(F.col("s").isNotNull(), F.col("n"))).alias("h"))
    carried = heads.select("c", F.last("h", ignorenulls=True).over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    rows = marked.withColumn("own", own).join(carried, "c").filter(F.col("s").isNull() & F.col("t").contains("="))
    pair = F.split("t", "=", 2)
    return rows.select(F.coalesce("own", "carried").alias("section"), F.trim(pair[0]).alias("key"), F.trim(pair[1]).alias("value"))


def key_values(text: Column) -> Column:
    """A map of `k=v,k=v`; a key without a value has null."""
    return F.str_to_map(text, F.lit(","), F.lit("="))


def encode(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Replaces a column's values by their ids."""
    return rows.join(ids.withColumnRenamed("id", "_id"), column).drop(column).withColumnRenamed("_id", column)


def ip_to_long(ip: Column) -> Column:
    """Dotted IPv4 to a number; null where it isn't one."""
    parts = F.split(ip, r"\.")
    octet = lambda i: F.element_at(parts, i).cast("long")
    value = octet(1) * 16777216 + octet(2) * 65536 + octet(3) * 256 + octet(4)
    valid = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (F.greatest(*[octet(i) for i in (1, 2, 3, 4)]) <= 255)
    return F.when(valid, value)


def call_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """from, to, epoch, seconds of lines `yyyy-mm-dd hh:mm:ss <tab> from to first second`; others are dropped."""
    x = F.split(F.col(column), r"[\t ]+")
    rows = lines.select(
        F.try_element_at(x, F.lit(3)).cast("long").alias("from"), F.try_element_at(x, F.lit(4)).cast("long").alias("to"),
        F.unix_timestamp(F.try_to_timestamp(F.concat_ws(" ", x[0], F.try_element_at(x, F.lit(2))))).alias("epoch"), F.try_element_at(x, F.lit(6)).cast("long").alias("seconds"),
    )
    return rows.dropna()


def tweets(lines: DataFrame) -> DataFrame:
    """user, other, kind (1 mention, 2 retweet), epoch of (n, value) lines in triples T, U, W; n is the line's number.

    Lines of a triple share the number of T lines so far, which is taken
    within chunks of lines and shifted.
    """
    tagged = lines.select("n", F.substring("value", 1, 1).alias("tag"), F.trim(F.expr("substring(value, 2)")).alias("rest"))
    before = Window.partitionBy(F.floor(F.col("n") / 300_000)).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumn("chunk", F.floor(F.col("n") / 300_000)).withColumn("k", F.sum((F.col("tag") == "T").cast("long")).over(before))
    totals = local.groupBy("chunk").agg(F.max("k").alias("t"))
    shift = totals.select("chunk", F.coalesce(F.sum("t").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    triple = local.join(shift, "chunk").withColumn("k", F.col("k") + F.col("shift")).groupBy("k").agg(*[F.max(F.when(F.col("tag") == t, F.col("rest"))).alias(t) for t in "TUW"])
    user = F.lower(F.regexp_extract("U", r"([^/]+)/?$", 1))
    said = triple.select(F.unix_timestamp(F.try_to_timestamp("T")).alias("epoch"), user.alias("user"), F.col("W").alias("text"))
    names = F.explode(F.regexp_extract_all("text", F.lit(r"@(\w{1,15})"), 1)).alias("other")
    kind = F.when(F.col("text").rlike(r"(?i)\bRT\b"), 2).otherwise(1).alias("kind")
    return said.select("user", names, kind, "epoch").withColumn("other", F.lower("other"))


def adjacency_strings(lines: DataFrame, column: str = "value") -> DataFrame:
    """src, dst names of lines `name k n1 .. nk`."""
    x = F.split(F.trim(F.col(column)), r"\s+")
    return lines.select(x[0].alias("src"), F.explode(F.slice(x, 3, F.try_element_at(x, F.lit(2)).cast("int"))).alias("dst"))


def mutual_information(rows: DataFrame, x: str, y: str) -> DataFrame:
    """mi, hx, hy of two columns, in bits, from counts."""
    joint = rows.groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("t"))
    cx = joint.groupBy(x).agg(F.sum("n").alias("nx"))
    cy = joint.groupBy(y).agg(F.sum("n").alias("ny"))
    cells = joint.join(cx, x).join(cy, y).crossJoin(F.broadcast(total))
    mi = F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny"))))
    hx = -F.sum(F.col("n") / F.col("t") * F.log2(F.col("nx") / F.col("t")))
    hy = -F.sum(F.col("n") / F.col("t") * F.log2(F.col("ny") / F.col("t")))
    return cells.agg(mi.alias("mi"), hx.alias("hx"), hy.alias("hy"))


def joint_counts(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
