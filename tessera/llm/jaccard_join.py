"""Set-similarity join on word shingles by partition signatures, verified exactly.

Candidates: each distinct text's shingles are hashed into segments by its size
band; linked sets share a segment, or one that differs by one item
(jaccard_kernels). So all that links shares a signature.

Verification compares shingles as words:
1. each text with the least text of all that it shares a signature with;
2. in signatures whose texts those links haven't joined to one component yet,
   texts whose parity sketches allow a link form clusters, and each cluster's
   texts are compared, laid out in blocks, each pair of blocks in one task.
Two texts that share a signature are thus compared themselves, or were joined
by verified links before, or their sketches differ in more bits than linked
sets can differ in items. Step 1 looks at sketches first too. No step hands on
more rows than it takes in texts: links and clusters travel as spanning
forests. Equal texts are one text from the start, known by 128 bits of a
cryptographic hash of their words; candidates then get a number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import Graph
from ..operators.algorithms import connected_components
from . import jaccard_kernels as J
from .common import Written, cut, free_name, joined, record, session, slices, table

#: A block holds about so many texts, or so many shingles, whichever comes first.
BLOCK_SETS, BLOCK_ITEMS = 256, 400_000
#: A text that is compared with more others than this is dealt to several tasks.
SPREAD = 512
#: Pairs whose sketches are compared at once.
PAIRS = 1 << 15
#: Columns of the matrices that are multiplied at once.
COLUMNS = 4096


def shingle_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and the text's key (null where it has no word)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, bounds = joined(batch.column("text"))
            _, sets = J.shingle_sets(data, bounds)
            yield record(doc_id=batch.column("doc_id"), n_shingles=np.diff(sets), whole=pa.array(J.digests(data, bounds), pa.binary()))

    return docs.mapInArrow(rows, "doc_id long, n_shingles long, whole binary")


def set_signatures(docs: DataFrame, percent: int) -> DataFrame:
    """(sig, whole): the signatures of every text, once for each task that meets the text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes | None] = {None}
        for batch in slices(batches):
            data, bounds = joined(batch.column("text"))
            key = J.digests(data, bounds)
            new = np.array([k not in seen and not seen.add(k) for k in key], bool)
            if not new.any():
                continue
            token, sets = J.shingle_sets(data, bounds)
            size = np.diff(sets)
            token, sets = token[np.repeat(new, size)], np.concatenate([[0], np.cumsum(size[new])])
            doc, sig = J.signatures(token, sets, percent)
            whole = pa.array([k for k, n in zip(key, new) if n], pa.binary())
            sig = sig.view(np.int64)
            for i in range(0, len(sig), 1 << 16):
                yield record(sig=sig[i : i + (1 << 16)], whole=whole.take(pa.array(doc[i : i + (1 << 16)])))

    return docs.mapInArrow(rows, "sig long, whole binary")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, n, sketch, text) of the wanted (id, whole, lead), each read from a document with doc_id lead."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            key = pa.array(J.digests(*joined(batch.column("text"))), pa.binary())
            yield record(doc_id=batch.column("doc_id"), key=key, text=batch.column("text"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            token, bounds = J.shingle_sets(*joined(batch.column("text")))
            sketch = pa.array([x.tobytes() for x in J.sketches(token, bounds)], pa.binary())
            yield record(id=batch.column("id"), n=np.diff(bounds), sketch=sketch, text=batch.column("text"))

    keyed = docs.mapInArrow(keys, "doc_id long, key binary, text string")
    # dealt by key at every size: candidates are no bounded table
    found = keyed.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("lead")) & (F.col("key") == F.col("whole")))
    found = found.select("lead", "whole", "id", "text").dropDuplicates(["lead", "whole"]).select("id", "text")
    return found.mapInArrow(sketched, "id long, n long, sketch binary, text string")


def _words64(column: pa.Array) -> np.ndarray:
    return joined(column)[0].view(np.uint64).reshape(len(column), -1) if len(column) else np.empty((0, J.SKETCH_BITS // 64), np.uint64)


def likely(edges: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose sketches don't rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_words64(batch.column(c)) for c in ("sa", "sb"))
            ok = J.may_link(x, y, batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    side = lambda k: texts.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    return edges.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def compared(edges: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose texts link.

    b's text comes first in its partition, then a's stream past it, so a task
    holds one batch; a b with many a is dealt to several tasks.
    """
    hub = edges.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("parts"))
    text = texts.select(F.col("id").alias("_k"), "text")
    hubs = hub.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    head = hubs.join(text, F.col("b") == F.col("_k")).select("b", "part", F.lit(None).cast("long").alias("a"), "text")
    rest = edges.join(hub, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    rest = rest.join(text, F.col("a") == F.col("_k")).select("b", "part", "a", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub_text, hub_key = None, None
        for batch in slices(batches):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            # row 0 is the hub that the batch before ended with
            text, a, b = [hub_text or "", *batch.column("text").to_pylist()], [None, *a], [hub_key, *b]
            is_hub = np.array([x is None for x in a])
            own = np.maximum.accumulate(np.where(is_hub, np.arange(len(a)), 0))
            token, bounds = J.exact_sets(pa.array(text, pa.string()))
            size = np.diff(bounds)
            kinds = int(token.max(initial=0)) + 1
            row = np.repeat(np.arange(len(a)), size)
            hubs = np.sort(row[is_hub[row]] * kinds + token[is_hub[row]])
            key = own[row] * kinds + token
            at = np.minimum(np.searchsorted(hubs, key), max(len(hubs) - 1, 0))
            both = np.bincount(row[hubs[at] == key] if len(hubs) else row[:0], minlength=len(a))
            linked = ~is_hub & (100 * both >= percent * (size + size[own] - both))
            at = np.flatnonzero(linked).tolist()
            yield record(a=pa.array([a[i] for i in at], pa.int64()), b=pa.array([b[i] for i in at], pa.int64()))
            hub_text, hub_key = text[own[-1]], b[own[-1]]

    dealt = head.unionByName(rest).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return dealt.mapInArrow(compare, "a long, b long")


def links_of(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of left, j of right) of linked sets; right None: pairs i < j of left.

    Intersections are counted exactly, by products of 0/1 matrices over the
    items that occur in two sets or more.
    """
    sets = left if right is None else left + right
    size = np.array([len(x) for x in sets])
    item, inverse, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    column = np.cumsum(often > 1) - 1
    use = often[inverse] > 1
    col, row = column[inverse[use]], owner[use]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    n, m = len(left), len(sets) - len(left) if right is not None else len(left)
    both = np.zeros((n, m), np.float32)
    last = int(col[-1]) + 1 if len(col) else 0
    for c in range(0, last, COLUMNS):
        s, e = np.searchsorted(col, [c, c + COLUMNS])
        x = np.zeros((len(sets), min(COLUMNS, last - c)), np.float32)
        x[row[s:e], col[s:e] - c] = 1
        both += x[:n] @ (x[:n] if right is None else x[n:]).T
    a, b = size[:n], size[:n] if right is None else size[n:]
    both = both.astype(np.int64)
    linked = 100 * both >= percent * (a[:, None] + b[None, :] - both)
    if right is None:
        linked = np.triu(linked, 1)
    return np.nonzero(linked)


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    """Indices of edges that connect what all edges (i, j) connect."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            kept.append(k)
    return kept


def likely_forest(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect all members (sig, id, part) of one signature and different parts whose sketches allow a link.

    Signatures with the same members are looked at once; those that hang
    together are looked at as one group where that takes fewer rows. A group's
    texts are laid out in blocks by a hash; the rows of blocks (i, j) lie
    together in one partition, so no task holds more than two blocks of
    sketches at once, whatever a group's size, and hands on fewer edges than
    rows.
    """
    members = cut(members)
    least = members.groupBy("sig").agg(F.min("id").alias("b"))
    hung = _components(members.join(least, "sig").select(F.col("id").alias("a"), "b").filter("a <> b")).withColumnRenamed("part", "whole_group")
    placed = cut(members.join(hung, "id"))
    costs = placed.groupBy("whole_group").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("id").alias("texts"))
    one = F.col("texts") * F.ceil(F.col("texts") / BLOCK_SETS) < F.col("rows")
    # a table, so that Spark knows its size: joined without dealing the members by group, some of which are large
    costs = Written(costs.select("whole_group", one.alias("one")))
    placed = placed.join(costs.df, "whole_group")
    together = placed.filter("one").select(F.col("whole_group").alias("sig"), "id", "part").distinct()
    members = cut(placed.filter("NOT one").select("sig", "id", "part").withColumn("kind", F.lit(0)).union(together.withColumn("kind", F.lit(1))))
    costs.drop()
    groups = members.groupBy("kind", "sig").agg(F.count(F.lit(1)).alias("sets"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"))
    groups = groups.groupBy("sets", "x", "y").agg(F.min(F.struct("kind", "sig")).alias("g")).select("g.kind", "g.sig", F.ceil(F.col("sets") / BLOCK_SETS).cast("int").alias("blocks"))
    laid = members.join(groups, ["kind", "sig"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    laid = laid.select("kind", "sig", "block", "id", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    laid = laid.select("kind", "sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "part")
    laid = laid.join(texts.select("id", "n", "sketch"), "id").repartition("kind", "sig", "i", "j").sortWithinPartitions("kind", "sig", "i", "j")

    def forest(rows: pa.RecordBatch, head: np.ndarray) -> pa.RecordBatch:
        """Of the pairs of rows of the same group (groups start at head), a spanning forest of those that may link."""
        size = np.diff(np.append(head, rows.num_rows))
        end = np.repeat(head + size, size)
        later = end - 1 - np.arange(rows.num_rows)  # rows of the group after each row
        until = np.concatenate([[0], np.cumsum(later)])
        sketch = _words64(rows.column("sketch"))
        id_, n, part, block, i, j = (rows.column(c).to_numpy() for c in ("id", "n", "part", "block", "i", "j"))
        across = i != j
        left, right = [], []
        for start in range(0, int(until[-1]), PAIRS):
            k = np.arange(start, min(start + PAIRS, int(until[-1])))
            x = np.searchsorted(until, k, side="right") - 1
            y = x + 1 + k - until[x]
            ok = (part[x] != part[y]) & (~across[x] | (block[x] != block[y]))
            x, y = x[ok], y[ok]
            ok = J.may_link(sketch[x], sketch[y], n[x], n[y], percent)
            x, y = np.concatenate([*left, x[ok]]), np.concatenate([*right, y[ok]])
            kept = spanning(rows.num_rows, x, y)
            left, right = [x[kept]], [y[kept]]
        x, y = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (left, right))
        return record(a=id_[x], b=id_[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.concat_batches([*held, batch])
            key = np.column_stack([rows.column(c).to_numpy() for c in ("kind", "sig", "i", "j")])
            head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            if len(head) > 1:  # the last group may go on in the next batch
                yield forest(rows.slice(0, head[-1]), head[:-1])
            held = [rows.slice(head[-1])]
        for rows in held:
            yield forest(rows, np.zeros(1, np.int64))

    return laid.mapInArrow(run, "a long, b long").distinct()


def cluster_links(clusters: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect all that is linked within each cluster (id, part: the cluster).

    A cluster's texts are laid out in blocks by a hash; the task of blocks
    (i, j) compares the texts of i with those of j, so no task holds more than
    two blocks, whatever a cluster's size.
    """
    sized = clusters.join(texts.select("id", "n"), "id")
    sizes = sized.groupBy("part").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_ITEMS)).cast("int").alias("blocks"))
    laid = clusters.join(sizes, "part").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    laid = laid.select("part", "block", "id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    laid = laid.select("part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id")
    laid = laid.join(texts.select("id", "text"), "id").repartition("part", "i", "j")

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key[1:])
        id_, block = rows.column("id").to_numpy(), rows.column("block").to_numpy()
        token, bounds = J.exact_sets(rows.column("text"))
        items = np.split(token, bounds[1:-1])
        a = np.flatnonzero(block == i)
        if i == j:
            x, y = links_of(items, None, percent)
        else:
            b = np.flatnonzero(block == j)
            x, y = links_of([items[k] for k in a], [items[k] for k in b], percent) if len(a) and len(b) else (a[:0], b[:0])
            x, y = a[x], b[y]
        kept = spanning(len(items), x, y)
        return pa.table({"a": id_[x[kept]], "b": id_[y[kept]]})

    return laid.groupBy("part", "i", "j").applyInArrow(compare, "a long, b long")


def _components(links: DataFrame) -> DataFrame:
    """(id, part): the component of every text that has a link."""
    found = connected_components(Graph(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    return found.select("id", F.col("label").alias("part"))


def _open(members: DataFrame, parts: DataFrame, one: DataFrame) -> DataFrame:
    """(sig, id, part): the members (sig, id, centre) of signatures in several components, unless one (a, b) has their only pair."""
    placed = members.join(parts, "id", "left").join(one.select(F.col("a").alias("id"), F.col("b").alias("_b")), "id", "left")
    placed = placed.select("sig", "id", F.coalesce("part", "id").alias("part"), (F.col("id") != F.col("centre")) & (F.col("_b") != F.col("centre")))
    placed = placed.toDF("sig", "id", "part", "fresh")
    several = placed.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("low"), F.max("part").alias("high"), F.max("fresh").alias("fresh"))
    several = several.filter((F.col("low") != F.col("high")) & ((F.col("n") > 2) | F.col("fresh"))).select("sig")
    return placed.select("sig", "id", "part").join(several, "sig", "left_semi")


def keep_representatives(docs: DataFrame, percent: int = J.PERCENT) -> DataFrame:
    """The rows of docs (with doc_id, text) whose own doc_id is their component's, unchanged.

    So of each group of near duplicates the least doc_id stays; a row that
    links with nothing stays. Rows that repeat the one that stays, doc_id and
    text, stay with it; rows without a doc_id stay only where no linked row
    has one.
    """
    key = free_name(docs.columns, "key")
    answer = _answers(docs, "doc_id", "text", percent)
    gone = answer.filter(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("_gone"), F.col("whole").alias("_whole")).distinct()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.append_column(key, pa.array(J.digests(*joined(batch.column("text"))), pa.binary()))

    keyed = docs.mapInArrow(rows, T.StructType([*docs.schema.fields, T.StructField(key, T.BinaryType())]))
    return keyed.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("_gone")) & (F.col(key) == F.col("_whole")), "left_anti").select(*docs.columns)


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = J.PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    component_id is the least doc_id that a chain of links reaches, itself
    included; two texts link when 100 * intersection >= percent * union of
    their sets of 4-word shingles (A-Z lower-cased). Null and empty texts and
    those without words have an empty set, link with nothing and keep their
    own doc_id. Rows count by their texts: repeated rows have one component,
    and a doc_id that stands with two texts has an answer for each. A null
    doc_id is larger than any other and links like any other. An empty table
    gives no rows; other columns of docs are ignored.
    """
    return _answers(docs, doc_id, text, percent).select("doc_id", "n_shingles", "component_id")


def _answers(docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """doc_id, whole (the text's key), n_shingles, component_id."""
    session(docs)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counted = cut(shingle_counts(rows))
    worded = counted.filter("whole IS NOT NULL")
    first = worded.groupBy("whole").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("copies"))

    signed = set_signatures(rows, percent)
    shared = cut(signed.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("sig"), release=True)
    met = Written(signed.join(shared, "sig", "left_semi").distinct())
    # tables, so that Spark knows their sizes when it chooses how to join; candidates are numbered
    ids = Written(met.df.select("whole").distinct().join(first.select("whole", "lead"), "whole").withColumn("id", F.monotonically_increasing_id()))
    numbered = Written(met.df.join(ids.df.select("whole", "id"), "whole").select("sig", "id"))
    met.drop()
    # a signature of copies of one text decides nothing
    several = numbered.df.groupBy("sig").agg(F.min("id").alias("centre"), F.max("id").alias("last")).filter("centre <> last").select("sig", "centre")
    members = Written(numbered.df.join(several, "sig"))
    numbered.drop()
    wanted = Written(ids.df.join(members.df.select("id").distinct(), "id", "left_semi"))
    texts = Written(texts_of(rows, wanted.df))

    one = cut(members.df.filter("id <> centre").groupBy(F.col("id").alias("a")).agg(F.min("centre").alias("b")))
    links = cut(compared(likely(one, texts.df, percent), texts.df, percent), release=True)
    rest = cut(likely_forest(_open(members.df, _components(links), one), texts.df, percent), release=True)
    links = cut(links.union(cluster_links(_components(rest), texts.df, percent)), release=True)
    parts = cut(_components(links).join(ids.df.select("id", "whole"), "id").select("whole", "part"))
    for written in (members, wanted, texts, ids):
        written.drop()

    # a component's least doc_id, by way of each text's least doc_id
    lead = first.join(parts, "whole", "left").select("whole", "lead", "copies", "part")
    least = lead.filter("part IS NOT NULL").groupBy("part").agg(F.min("lead").alias("least"))
    answer = lead.join(least, "part", "left").withColumn("component_id", F.when(F.col("part").isNull(), F.col("lead")).otherwise(F.col("least")))
    # only texts whose answer isn't each document's own id need a join
    moved = answer.filter((F.col("copies") > 1) | ~F.col("component_id").eqNullSafe(F.col("lead"))).select("whole", "component_id", F.lit(True).alias("moved"))
    return counted.join(moved, "whole", "left").select("doc_id", "whole", "n_shingles", F.when(F.col("moved"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 3, 1) END)) AS i FROM words),
sets AS (SELECT DISTINCT doc_id, md5(list_aggregate(w[i + 1 : i + 4], 'string_agg', ' ')) AS g FROM x),
size AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
content AS (SELECT doc_id, n, (SELECT 1) AS one FROM size),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b WHERE 100 * k >= 85 * (s.n + t.n - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, w.b FROM reach r JOIN ways w ON w.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM documents LEFT JOIN size USING (doc_id) JOIN least ON a = doc_id
"""
