"""Queries of the engine's further parts: programs, tables, flows, formats and parsers that the other modules don't show."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import graph as G
from .. import pregel as P
from ..functions import arrays as V
from ..functions import hashes as H
from ..operators import algorithms as A
from ..operators import etl as E
from ..operators import factors as M
from ..operators import flows as W
from ..operators import similarity as S
from ..operators import tables as T
from ..session import cut
from ..sources import packets as K
from ..sources import readers as R
from ..streaming import edges as X
from .graphs import bought, with_
from .views import COPURCHASE, PACKETS, RATINGS, packets, ratings, read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark, name: str) -> str:
    cut(spark.range(1))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


# programs


def steps_sql(aggregate: str, update: str, steps: int) -> str:
    parts = ["v0 AS (SELECT id, id AS v FROM vertices)"]
    for i in range(1, steps + 1):
        parts.append(f"v{i} AS (SELECT v.id, {update} AS v FROM v{i - 1} v LEFT JOIN (SELECT dst, {aggregate} AS m FROM copurchase JOIN v{i - 1} u ON u.id = src GROUP BY dst) ON dst = v.id)")
    return ", ".join(parts)


@query(with_(COPURCHASE, "w0 AS (SELECT id, 1 AS v FROM vertices)", *[f"w{i} AS (SELECT id, coalesce(m, 0) AS v FROM vertices LEFT JOIN (SELECT dst, sum(v) AS m FROM copurchase JOIN w{i - 1} ON id = src GROUP BY dst) ON dst = id)" for i in (1, 2)]) + " SELECT id, CAST(v AS BIGINT) AS value FROM w2")
def kernel_walks(spark, sf_dir):
    """How many walks of two edges end in each vertex: a functional kernel."""
    kernel = P.Kernel(F.lit(1).cast("long"), lambda x: x, F.sum, lambda old, total: F.coalesce(total, F.lit(0)).cast("long"))
    return P.run_kernel(bought(spark, sf_dir), kernel, 2)


@query(with_(COPURCHASE, steps_sql("max(u.v)", "greatest(v.v, coalesce(m, v.v))", 3)) + " SELECT id, v AS most FROM v3")
def gas_largest(spark, sf_dir):
    """The largest id within three steps against the edges; only signalled vertices gather again."""
    program = P.GasProgram(init={"most": F.col("id")}, gather=F.col("n_most"), plus=F.max, apply={"most": F.greatest("most", "combined")}, signal=F.col("most") != F.col("old_most"))
    return P.run_gas(bought(spark, sf_dir), program, 3).vertices


class _Due(P.VertexProgram):
    """Adds up senders' values; only vertices of even id are updated after the first superstep."""

    selective = True

    def __init__(self, ids):
        self.ids = ids

    def init(self):
        return {"v": F.lit(1).cast("long")}

    def message(self):
        return F.col("v")

    def apply(self):
        return {"v": F.coalesce("combined", F.lit(0)).cast("long")}

    def after_iteration(self, iteration, context):
        if iteration == 0:
            context.add_task(self.ids)


@query(
    with_(COPURCHASE, "s1 AS (SELECT id, coalesce(m, 0) AS v FROM vertices LEFT JOIN (SELECT dst, count(*) AS m FROM copurchase GROUP BY dst) ON dst = id)")
    + " SELECT id, CAST(CASE WHEN id % 2 = 0 THEN coalesce(m, 0) ELSE v END AS BIGINT) AS value FROM s1 LEFT JOIN (SELECT dst, sum(v) AS m FROM copurchase JOIN s1 ON id = src GROUP BY dst) ON dst = id"
)
def scheduled_updates(spark, sf_dir):
    g = bought(spark, sf_dir)
    return P.run(g, _Due(g.vertices.filter("id % 2 = 0")), None)[0].withColumnRenamed("v", "value")


@query(with_(COPURCHASE) + " SELECT count(*) AS edges, CAST(sum(src + dst) AS BIGINT) AS total FROM copurchase")
def edge_aggregate(spark, sf_dir):
    """A map and sum over all edges with their ends' state."""
    g = bought(spark, sf_dir)
    state = G.Graph(g.edges, g.vertices.withColumn("v", F.col("id")))
    total = P.aggregate_edges(state, F.col("s_v") + F.col("d_v"))
    return g.edges.agg(F.count(F.lit(1)).alias("edges")).withColumn("total", F.lit(total))


@query(with_(COPURCHASE) + " SELECT id, count(*) AS degree FROM (SELECT src AS id FROM copurchase UNION ALL SELECT dst FROM copurchase) AS e WHERE id >= 10 AND id < 60 GROUP BY id")
def degree_dump(spark, sf_dir):
    return bought(spark, sf_dir).degrees_between(10, 60)


@query(with_(COPURCHASE, "d AS (SELECT id, count(*) FILTER (WHERE i) AS a, count(*) FILTER (WHERE NOT i) AS b FROM (SELECT dst AS id, true AS i FROM copurchase UNION ALL SELECT src, false FROM copurchase) AS e GROUP BY id)") + " SELECT count(*) AS vertices, CAST(sum(b) AS BIGINT) AS edges, max(a) AS most_in, max(b) AS most_out FROM d")
def degree_totals(spark, sf_dir):
    return bought(spark, sf_dir).degree_totals()


PARITY = "p AS (SELECT id, id % 7 AS label FROM vertices)"


@query(with_(COPURCHASE, PARITY) + " SELECT p.id, p.label, count(dst) FILTER (WHERE q.label = p.label) AS outdegree FROM p LEFT JOIN copurchase ON src = p.id LEFT JOIN p q ON q.id = dst GROUP BY p.id, p.label")
def intra_degrees(spark, sf_dir):
    g = bought(spark, sf_dir)
    return A.intra_degrees(g, g.vertices.select("id", (F.col("id") % 7).alias("label")))


@query(with_(COPURCHASE, PARITY) + " SELECT count(DISTINCT label) AS labels FROM p")
def label_count(spark, sf_dir):
    return G.label_count(bought(spark, sf_dir).vertices.select((F.col("id") % 7).alias("label")))


# ratings


@query(f"""WITH {RATINGS}, n AS (SELECT item, count(*) AS n FROM ratings WHERE "user" % 8 = 0 GROUP BY item), r AS (SELECT * FROM ratings WHERE "user" % 8 = 0),
c AS (SELECT a.item AS i, b.item AS j, count(*) AS k FROM r a JOIN r b ON a."user" = b."user" AND a.item <> b.item GROUP BY 1, 2)
SELECT i, j, round(k / (pow(x.n, 0.3) * pow(y.n, 0.7)), 9) AS sim FROM c JOIN n x ON x.item = i JOIN n y ON y.item = j""")
def sim_directed_cosine(spark, sf_dir):
    rated = ratings(spark, sf_dir).filter("user % 8 = 0")
    return S.directed_cosine(rated, alpha=0.3).withColumn("sim", F.round("sim", 9))


@query(f"""WITH {RATINGS}, x AS (SELECT DISTINCT item AS id, 1.0e0 + item % 3 AS f FROM ratings)
SELECT "user" AS id, round((2 * sum(rating * f) + 3 * ("user" % 5)) / 4, 6) AS f FROM ratings JOIN x ON item = id GROUP BY "user" """)
def matrix_times_vector(spark, sf_dir):
    """(2 A x + 3 y) / 4 of the ratings as a matrix."""
    rated = ratings(spark, sf_dir)
    x = rated.select(F.col("item").alias("id"), (1.0 + F.col("item") % 3).alias("f")).distinct()
    y = rated.select(F.col("user").alias("id"), (F.col("user") % 5).cast("double").alias("f")).distinct()
    return M.multiply(rated, x, y, c=2.0, d=3.0, div=4.0).withColumn("f", F.round("f", 6))


@query("""WITH w AS (SELECT l_returnflag || l_linestatus || l_linenumber AS phrase, 'm' || month(l_shipdate) AS context, count(*) AS n FROM lineitem GROUP BY 1, 2),
p0 AS (SELECT phrase, CASE WHEN phrase LIKE 'A%1' THEN 1.0e0 WHEN phrase LIKE 'N%1' THEN 0.0e0 ELSE 0.5e0 END AS p, phrase LIKE 'A%1' OR phrase LIKE 'N%1' AS fixed FROM (SELECT DISTINCT phrase FROM w) AS d),
c0 AS (SELECT context, sum(n * p) / sum(n) AS p FROM w JOIN p0 USING (phrase) GROUP BY context),
p1 AS (SELECT p0.phrase, CASE WHEN any_value(fixed) THEN any_value(p0.p) ELSE sum(n * c0.p) / sum(n) END AS p FROM w JOIN p0 USING (phrase) JOIN c0 USING (context) GROUP BY p0.phrase)
SELECT 'phrase' AS side, phrase AS id, round(p, 9) AS p FROM p1 UNION ALL SELECT 'context', context, round(sum(n * p) / sum(n), 9) FROM w JOIN p1 USING (phrase) GROUP BY context""")
def coem(spark, sf_dir):
    """Flags and months of lines as phrases and contexts, with positive and negative seeds."""
    lines = read(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("phrase"), F.concat(F.lit("m"), F.month("l_shipdate").cast("string")).alias("context"))
    pairs = lines.groupBy("phrase", "context").agg(F.count(F.lit(1)).alias("count"))
    p = F.when(F.col("phrase").rlike("^A.*1$"), 1.0).when(F.col("phrase").rlike("^N.*1$"), 0.0)
    seeds = pairs.select("phrase").distinct().withColumn("p", p).filter("p IS NOT NULL")
    return A.coem(pairs, seeds, 1, tf_idf=False).withColumn("p", F.round("p", 9))


# tables and flows


@query("""WITH b AS (SELECT event_id, user_id AS flow, user_id % 64 AS bucket FROM events),
o AS (SELECT *, lag(event_id) OVER (PARTITION BY flow ORDER BY event_id) AS prev FROM b)
SELECT o.event_id, o.flow, o.prev IS NOT NULL AND (SELECT count(DISTINCT x.flow) FROM b x WHERE x.bucket = o.bucket AND x.event_id > o.prev AND x.event_id < o.event_id) < 3 AS hit FROM o""")
def lru_lookup(spark, sf_dir):
    return W.lru_lookup(packets(spark, sf_dir).select("event_id", "flow"), 64, 3)


SIX = "lpad(bin(user_id * 1000003 + event_id % 4096), 128, '01')"
ROUTES6 = "substr(lpad(bin(s_suppkey * 1000003), 128, '01'), 1, CAST(100 + s_suppkey % 24 AS INT))"


@query(f"""WITH r AS (SELECT p, length(p) AS depth, max(s_suppkey) AS next_hop FROM (SELECT {ROUTES6} AS p, s_suppkey FROM supplier) AS s GROUP BY p),
x AS (SELECT event_id, {SIX} AS a FROM events),
h AS (SELECT event_id, next_hop, depth, row_number() OVER (PARTITION BY event_id ORDER BY depth DESC) AS k FROM x JOIN r ON substr(a, 1, depth) = p)
SELECT x.event_id, next_hop, CAST(depth AS INT) AS depth FROM x LEFT JOIN h ON h.event_id = x.event_id AND k = 1""")
def lpm6_lookup(spark, sf_dir):
    """Addresses of 128 bits, spelled as strings."""
    rules = read(spark, sf_dir, "supplier").selectExpr(f"rpad({ROUTES6}, 128, '0') AS prefix", "CAST(100 + s_suppkey % 24 AS INT) AS depth", "s_suppkey AS next_hop")
    return T.lpm6_lookup(read(spark, sf_dir, "events").selectExpr("event_id", f"{SIX} AS bits"), rules, "bits").select("event_id", "next_hop", "depth")


RULES = "SELECT c_custkey AS k, c_mktsegment AS segment FROM customer"


@query(f"""WITH r AS ({RULES} WHERE c_custkey % 10 <> 3 AND c_custkey % 10 <> 4 UNION ALL SELECT c_custkey, 'NEW' FROM customer WHERE c_custkey % 10 = 4)
SELECT o_orderkey, segment, segment IS NOT NULL AS hit FROM orders LEFT JOIN r ON k = o_custkey""")
def changed_rules(spark, sf_dir):
    """An exact table after entries were deleted, and others replaced."""
    rules = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    rules = T.delete_rules(rules, ["o_custkey"], rules.filter("o_custkey % 10 = 3"))
    rules = T.add_rules(rules, ["o_custkey"], rules.filter("o_custkey % 10 = 4").withColumn("segment", F.lit("NEW")))
    return T.exact_lookup(read(spark, sf_dir, "orders"), rules, ["o_custkey"]).select("o_orderkey", "segment", "hit")


@query(f"""WITH {PACKETS} SELECT event_id, CASE WHEN colour = 2 THEN NULL WHEN flow % 3 = 0 THEN CAST(flow % 5 AS BIGINT) ELSE 7 END AS port,
CASE WHEN colour = 2 THEN 'firewall' ELSE 'flows' END AS "table" FROM packets""")
def firewall_flows(spark, sf_dir):
    """A firewall before a flow classification."""
    p = packets(spark, sf_dir)
    known = p.select("flow").distinct().filter("flow % 3 = 0").withColumn("port", (F.col("flow") % 5).cast("int"))
    allowed = [T.AclRule({"colour": ("range", 0, 1)}, 1, 1)]
    stages = [T.Stage("firewall", T.firewall(allowed)("flows")), T.Stage("flows", T.flow_classifier(known, ["flow"], 7))]
    return T.pipeline_route(p, stages).select("event_id", F.col("port").cast("long").alias("port"), "table")


def _timed(spark, sf_dir):
    return packets(spark, sf_dir).select("event_id", "flow", F.unix_micros(F.col("ts").cast("timestamp")).alias("time"), "len", "colour")


DAY = 86_400_000_000
ORDERED = f"{PACKETS.strip()}, o AS (SELECT event_id, flow, epoch_us(ts) AS t, len, colour, row_number() OVER (PARTITION BY flow ORDER BY epoch_us(ts), event_id) AS r FROM packets)"


def single_rate_sql(rate: int, period: int, cbs: int, ebs: int, aware: bool) -> str:
    green = "tc >= len" + (" AND colour = 0" if aware else "")
    yellow = "te >= len" + (" AND colour <> 2" if aware else "")
    step = f"""SELECT event_id, flow, r, len, base, CASE WHEN {green} THEN tc - len ELSE tc END AS tc, CASE WHEN NOT ({green}) AND {yellow} THEN te - len ELSE te END AS te,
      CASE WHEN {green} THEN 0 WHEN {yellow} THEN 1 ELSE 2 END AS new_colour FROM"""
    return f"""WITH RECURSIVE {ORDERED}, m AS (
    {step} (SELECT event_id, flow, r, len, colour, t AS base, CAST({cbs} AS BIGINT) AS tc, CAST({ebs} AS BIGINT) AS te FROM o WHERE r = 1) AS f
    UNION ALL {step} (SELECT o.event_id, o.flow, o.r, o.len, o.colour, base + (t - base) // {period} * {period} AS base,
      least({cbs}, tc + (t - base) // {period} * {rate}) AS tc, least({ebs}, te + (t - base) // {period} * {rate}) AS te FROM m JOIN o ON o.flow = m.flow AND o.r = m.r + 1) AS n)
    SELECT event_id, flow, len, CAST(new_colour AS INT) AS new_colour FROM m"""


def two_rate_sql(rate: int, period: int, peak_rate: int, peak_period: int, cbs: int, pbs: int, aware: bool) -> str:
    red = "tp < len" + (" OR colour = 2" if aware else "")
    yellow = "tc < len" + (" OR colour = 1" if aware else "")
    step = f"""SELECT event_id, flow, r, len, a, b, CASE WHEN {red} OR {yellow} THEN tc ELSE tc - len END AS tc, CASE WHEN {red} THEN tp ELSE tp - len END AS tp,
      CASE WHEN {red} THEN 2 WHEN {yellow} THEN 1 ELSE 0 END AS new_colour FROM"""
    return f"""WITH RECURSIVE {ORDERED}, m AS (
    {step} (SELECT event_id, flow, r, len, colour, t AS a, t AS b, CAST({cbs} AS BIGINT) AS tc, CAST({pbs} AS BIGINT) AS tp FROM o WHERE r = 1) AS f
    UNION ALL {step} (SELECT o.event_id, o.flow, o.r, o.len, o.colour, a + (t - a) // {period} * {period} AS a, b + (t - b) // {peak_period} * {peak_period} AS b,
      least({cbs}, tc + (t - a) // {period} * {rate}) AS tc, least({pbs}, tp + (t - b) // {peak_period} * {peak_rate}) AS tp FROM m JOIN o ON o.flow = m.flow AND o.r = m.r + 1) AS n)
    SELECT event_id, flow, len, CAST(new_colour AS INT) AS new_colour FROM m"""


SQL |= {
    "srtcm_blind": single_rate_sql(40, DAY, 120, 80, False),
    "srtcm_aware": single_rate_sql(40, DAY, 120, 80, True),
    "trtcm_blind": two_rate_sql(40, DAY, 60, DAY, 120, 150, False),
    "trtcm_aware": two_rate_sql(40, DAY, 60, DAY, 120, 150, True),
}


@query(f"""WITH RECURSIVE {ORDERED}, s AS (SELECT event_id, flow, t, r, event_id % 7 + event_id // 7 * 7 AS seq, row_number() OVER (PARTITION BY flow ORDER BY event_id) AS k FROM o),
m AS (SELECT event_id, flow, seq, k, seq AS low, 'kept' AS outcome FROM s WHERE k = 1
  UNION ALL SELECT s.event_id, s.flow, s.seq, s.k, CASE WHEN s.seq - low BETWEEN 500 AND 999 THEN s.seq - 499 ELSE low END,
    CASE WHEN s.seq - low BETWEEN 0 AND 499 THEN 'kept' WHEN s.seq - low BETWEEN 500 AND 999 THEN 'moved' ELSE 'range' END FROM m JOIN s ON s.flow = m.flow AND s.k = m.k + 1)
SELECT event_id, flow, seq, outcome FROM m""")
def reorder_window(spark, sf_dir):
    return W.reorder(packets(spark, sf_dir).selectExpr("event_id", "flow", "event_id % 7 + event_id DIV 7 * 7 AS seq"), 500)


@query(f"""WITH {PACKETS}, f AS (SELECT event_id, flow % 4 AS source, len, unnest(range(0, greatest(len, 1), 16)) AS "offset" FROM packets WHERE len >= 0),
k AS (SELECT *, event_id * 100 + CASE WHEN event_id % 5 = 0 AND "offset" = 16 THEN 1000 ELSE "offset" END AS time FROM f WHERE NOT (event_id % 3 = 0 AND "offset" = 0)),
l AS (SELECT *, time - min(time) OVER (PARTITION BY event_id, source) <= 500 AS fresh FROM k),
n AS (SELECT event_id, source, sum(least(16, len - "offset")) AS have, any_value(len) AS len, max("offset") + 16 >= any_value(len) AS ended FROM l WHERE fresh GROUP BY event_id, source)
SELECT event_id, source, CASE WHEN ended THEN len ELSE -1 END AS len, ended AND have = len AS complete FROM n""")
def reassemble_keyed(spark, sf_dir):
    """Fragments by source and number, of which some are missing and some come too late."""
    pieces = K.fragmented(packets(spark, sf_dir), 16).join(packets(spark, sf_dir).select("event_id", (F.col("flow") % 4).alias("source")), "event_id")
    late = F.when((F.col("event_id") % 5 == 0) & (F.col("offset") == 16), 1000).otherwise(F.col("offset"))
    pieces = pieces.withColumn("time", F.col("event_id") * 100 + late).filter("NOT (event_id % 3 = 0 AND offset = 0)")
    return W.reassemble(pieces, ["event_id", "source"], timeout=500)


@query()
def hierarchical_schedule(spark, sf_dir):
    """Events as packets of two ports, by subport, pipe, class and queue."""
    p = _timed(spark, sf_dir).selectExpr("event_id", "flow % 2 AS port", "flow % 4 AS subport", "flow AS pipe", "colour % 4 AS class", "event_id % 4 AS queue", "time", "len + 1 AS len")
    shaping = W.Shaping(port_rate=2e-3, subport_rate=1e-3, subport_size=2000.0, pipe_rate=5e-4, pipe_size=1000.0, class_bytes=(800.0, 800.0, 800.0, 800.0), period=1e6)
    return W.hierarchical_schedule(p, shaping).withColumn("sent", F.round("sent", 3))


@query("SELECT s_suppkey AS timer, unnest(range(s_suppkey, 1000, 10 + s_suppkey)) AS at FROM supplier WHERE s_suppkey < 1000")
def timer_expiries(spark, sf_dir):
    timers = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS timer", "s_suppkey AS start", "10 + s_suppkey AS period").filter("start < 1000")
    return W.timer_expiries(timers, 999)


@query("SELECT event_type AS job, count(*) AS runs, round(sum(value), 6) AS total, min(value) AS least, round(avg(value), 9) AS mean, max(value) AS most FROM events GROUP BY 1")
def job_stats(spark, sf_dir):
    runs = read(spark, sf_dir, "events").select(F.col("event_type").alias("job"), F.col("value").alias("seconds"))
    return W.job_stats(runs).withColumns({"total": F.round("total", 6), "mean": F.round("mean", 9)})


# parsers and formats


@query("""WITH t AS (SELECT event_id AS k, ts, lower('User' || user_id) AS "user", user_id % 3 AS m, event_id % 2 AS rt FROM events)
SELECT "user", 'friend' || j AS other, CASE WHEN rt = 1 THEN 2 ELSE 1 END AS kind, CAST(floor(epoch(ts)) AS BIGINT) AS epoch FROM t, range(3) AS x(j) WHERE j < m""")
def tweets(spark, sf_dir):
    """Mentions and retweets of lines in triples, made from the events."""
    e = read(spark, sf_dir, "events").withColumn("m", (F.col("user_id") % 3).cast("int"))
    names = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: F.when(j < F.col("m"), F.concat(F.lit("@Friend"), j.cast("string")))))
    lines = F.array(
        F.concat(F.lit("T\t"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), F.concat(F.lit("U\thttp://site/User"), F.col("user_id").cast("string")), F.concat(F.lit("W\t"), F.when(F.col("event_id") % 2 == 1, "RT ").otherwise("so "), names)
    )
    numbered = e.select("event_id", F.posexplode(lines).alias("i", "value")).select((F.col("event_id") * 3 + F.col("i")).alias("n"), "value")
    return E.tweets(numbered)


@query("""SELECT lower('User' || user_id) AS "user", count(*) AS tweets FROM events GROUP BY 1""")
def tweets_per_user(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return E.tweets_per_user(e.select(F.col("event_id").alias("n"), F.concat(F.lit("U\thttp://site/User"), F.col("user_id").cast("string")).alias("value")))


@query("SELECT o_custkey AS key, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) AS o WHERE r <= 3 GROUP BY 1")
def first_in_order(spark, sf_dir):
    """The first three entries of each key in the lines' own order."""
    lines = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), F.concat_ws("\t", "o_custkey", "o_orderkey", F.lit("1")).alias("value"))
    return E.first_per_key(lines, 3).select("key", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"))


@query("""WITH l AS (SELECT o_orderkey AS n, 'c' || o_custkey AS a, o_orderpriority AS b FROM orders),
x AS (SELECT a AS v, min(n) AS f FROM l GROUP BY 1), y AS (SELECT b AS v, min(n) AS f FROM l GROUP BY 1),
i AS (SELECT v, row_number() OVER (ORDER BY f) AS id FROM x), j AS (SELECT v, row_number() OVER (ORDER BY f) AS id FROM y)
SELECT n, i.id AS a, j.id AS b FROM l JOIN i ON i.v = a JOIN j ON j.v = b""")
def first_seen_ids(spark, sf_dir):
    lines = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("a"), F.col("o_orderpriority").alias("b"))
    return E.first_seen_ids(lines, ["a", "b"])[0]


IPS = "concat_ws('.', 10, user_id % 256, event_id % 7, {0}) || ' ' || concat_ws('.', 10, event_id % 256, 3, user_id % 300) || ' ' || event_type"


@query("""WITH l AS (SELECT event_id, 167772160 + user_id % 256 * 65536 + event_id % 7 * 256 + 1 AS a, 167772160 + event_id % 256 * 65536 + 768 + user_id % 300 AS b, event_type AS attribute FROM events WHERE user_id % 300 < 256),
d AS (SELECT ip, row_number() OVER (ORDER BY ip) - 1 AS id FROM (SELECT a AS ip FROM l UNION SELECT b FROM l) AS u)
SELECT x.id AS src, y.id AS dst, attribute FROM l JOIN d x ON x.ip = a JOIN d y ON y.ip = b""")
def ip_pairs(spark, sf_dir):
    return E.ip_pairs(read(spark, sf_dir, "events").selectExpr(IPS.format(1) + " AS value"))[0]


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", V.json_field(F.col("props"), "$.k", "bigint").alias("k"))


@query(with_(COPURCHASE) + " SELECT src, dst, 'adjlist' AS format FROM copurchase UNION ALL SELECT src, dst, 'cassovary' FROM copurchase UNION ALL SELECT src, dst, 'edgelist' FROM copurchase UNION ALL SELECT src, dst, 'matrixmarket' FROM copurchase")
def written_and_read(spark, sf_dir):
    """The graph written and read again in four text formats."""
    g, folder = bought(spark, sf_dir), _folder(spark, "formats")
    edges = cut(g.edges.select("src", "dst"))
    g = G.Graph(edges)
    most = edges.agg(F.max(F.greatest("src", "dst"))).first()[0] or 0
    g.write_adjacency(f"{folder}/adjlist")
    g.adjacency().select(F.concat_ws("\n", F.concat_ws(" ", "id", "degree"), F.concat_ws("\n", F.col("neighbours").cast("array<string>"))).alias("value")).write.text(f"{folder}/cassovary")
    R.write_pairs(edges, f"{folder}/edgelist", "src", "dst")
    R.write_matrix_market(edges.select((F.col("src") + 1).alias("user"), (F.col("dst") + 1).alias("item"), F.lit(1.0).alias("rating")), f"{folder}/mm", most + 1, most + 1)
    out = R.matrix_market(spark, f"{folder}/mm").select((F.col("user") - 1).alias("src"), (F.col("item") - 1).alias("dst"), F.lit("matrixmarket").alias("format"))
    for name in ("adjlist", "cassovary", "edgelist"):
        out = out.union(R.read_graph(spark, f"{folder}/{name}", name).select("src", "dst", F.lit(name)))
    return out


# functions


def jenkins_sql(a: str, b: str, c: str) -> str:
    """Each line of the final mixing as a subquery over 32-bit numbers."""
    start = (0xDEADBEEF + 12) & 0xFFFFFFFF
    m = 4294967296
    sql = f"SELECT event_id, ({a} + {start}) % {m} AS a, ({b} + {start}) % {m} AS b, ({c} + {start}) % {m} AS c FROM events"
    for x, y, k in (("c", "b", 14), ("a", "c", 11), ("b", "a", 25), ("c", "b", 16), ("a", "c", 4), ("b", "a", 14), ("c", "b", 24)):
        turned = f"(({y} * {1 << k}) % {m} + {y} // {1 << (32 - k)})"
        columns = ", ".join(f"(xor({x}, {y}) - {turned} + {m}) % {m} AS {x}" if z == x else z for z in "abc")
        sql = f"SELECT event_id, {columns} FROM ({sql}) AS t"
    return f"SELECT event_id, CAST(c AS BIGINT) AS hash FROM ({sql}) AS t"


@query(jenkins_sql("user_id", "event_id", "CAST(floor(value) AS BIGINT)"))
def jenkins_hash(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", H.jenkins(F.col("user_id"), F.col("event_id"), F.floor("value")).alias("hash"))


RSS_KEY = bytes((i * 37 + 11) % 256 for i in range(40))


def toeplitz_sql() -> str:
    bits = int.from_bytes(RSS_KEY, "big")
    window = ", ".join(f"({i}, {(bits >> (320 - 32 - i)) & 0xFFFFFFFF})" for i in range(96))
    return f"""WITH w(i, k) AS (VALUES {window}), x AS (SELECT event_id, user_id * 65537 % 4294967296 AS a, event_id * 257 % 4294967296 AS b, user_id % 65536 AS c, event_id % 65536 AS d FROM events),
    s AS (SELECT event_id, CASE WHEN i < 32 THEN a >> (31 - i) WHEN i < 64 THEN b >> (63 - i) WHEN i < 80 THEN c >> (79 - i) ELSE d >> (95 - i) END & 1 AS on_, k FROM x, w)
    SELECT event_id, CAST(coalesce(bit_xor(k) FILTER (WHERE on_ = 1), 0) AS BIGINT) AS hash FROM s GROUP BY event_id"""


@query(toeplitz_sql())
def toeplitz_hash(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    user, event = F.col("user_id"), F.col("event_id")
    return e.select("event_id", H.toeplitz(RSS_KEY, user * 65537 % 4294967296, event * 257 % 4294967296, user % 65536, event % 65536).alias("hash"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * l_quantity + l_tax * l_discount AS x, l_discount * l_quantity + l_tax AS y, round(l_quantity - l_tax * l_discount, 9) AS det FROM lineitem")
def small_matrices(spark, sf_dir):
    """A 2 x 2 matrix of each line times a vector, and its determinant."""
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    m = F.array(F.array(q, t), F.array(d, F.lit(1.0)))
    v = V.mat_vec(m, F.array(q, d))
    w = V.mat_vec(m, F.array(q, t))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", v[0].alias("x"), w[1].alias("y"), F.round(V.determinant(m), 9).alias("det"))


# the evolving graph


@query("""WITH e AS (SELECT user_id AS src, event_id % 97 AS dst, event_id FROM events WHERE user_id <> event_id % 97),
gone AS (SELECT DISTINCT src, dst FROM e WHERE event_id % 11 = 0)
SELECT id, count(*) AS degree FROM (SELECT unnest([src, dst]) AS id FROM e ANTI JOIN gone USING (src, dst)) AS x GROUP BY id""")
def degrees_after_deletion(spark, sf_dir):
    """A stream of additions, then one of deletions, compacted: the degrees that are left."""
    folder = _folder(spark, "evolving")
    edges = read(spark, sf_dir, "events").selectExpr("user_id AS src", "event_id % 97 AS dst", "event_id")
    edges.select("src", "dst", F.lit("add").alias("op")).write.parquet(f"{folder}/in/part=0")
    graph = X.EvolvingGraph(spark, f"{folder}/graph")
    stream = lambda: spark.readStream.schema("src long, dst long, op string").parquet(f"{folder}/in/*")
    graph.follow(stream())
    edges.filter("event_id % 11 = 0").select("src", "dst", F.lit("delete").alias("op")).write.parquet(f"{folder}/in/part=1")
    graph.follow(stream())
    graph.compact()
    return graph.degrees()
