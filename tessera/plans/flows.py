"""Queries of logs, texts, rule tables and flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import etl as E
from ..operators import flows as W
from ..operators import tables as T
from .views import PACKETS, packets, read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT l_orderkey, l_suppkey, sum(l_quantity) AS total FROM lineitem GROUP BY l_orderkey, l_suppkey")
def sum_by_pair(spark, sf_dir):
    return E.sum_by_pair(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", "l_quantity")


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) AS t WHERE rank <= 3")
def topk_per_key(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return E.top_per_key(rows, "o_custkey", 3, [F.desc("o_totalprice"), "o_orderkey"]).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey")
def count_by_key(spark, sf_dir):
    return E.count_by_key(read(spark, sf_dir, "lineitem"), "l_partkey")


@query("""WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[\\s!-/:-@\\[-`{-~]+'), lambda x: length(x) > 0) AS w FROM conversations),
x AS (SELECT conv_id, turn, unnest(w) AS token, unnest(range(len(w))) AS i FROM t)
SELECT conv_id, token, count(*) AS n FROM x WHERE i = 0 OR length(token) > 1 GROUP BY conv_id, token""")
def bag_of_words(spark, sf_dir):
    return E.bag_of_words(read(spark, sf_dir, "conversations"), "conv_id", "text")


@query("SELECT url, row_number() OVER (ORDER BY url) - 1 AS id FROM (SELECT DISTINCT unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS url FROM pages) AS u")
def dictionary_ids(spark, sf_dir):
    found = read(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("url"))
    return E.dictionary(found, "url")


IP = "concat_ws('.', 10 + user_id % 200, event_id % 256, user_id % 256, CAST(floor(value) AS BIGINT) % 300)"


@query(f"""SELECT event_id, CASE WHEN CAST(floor(value) AS BIGINT) % 300 <= 255
  THEN (10 + user_id % 200) * 16777216 + event_id % 256 * 65536 + user_id % 256 * 256 + CAST(floor(value) AS BIGINT) % 300 END AS ip FROM events""")
def ip_to_int(spark, sf_dir):
    """Addresses spelled from the events' numbers; those with an octet over 255 are none."""
    return read(spark, sf_dir, "events").select("event_id", E.ip_to_long(F.expr(IP)).alias("ip"))


@query("SELECT user_id AS \"from\", event_id AS \"to\", CAST(floor(epoch(ts)) AS BIGINT) AS epoch, CAST(floor(value) AS BIGINT) AS seconds FROM events")
def epoch_seconds(spark, sf_dir):
    """Call records written as text lines and parsed again."""
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("\t"), F.concat_ws(" ", "user_id", "event_id", F.lit("0"), F.floor("value")))
    return E.call_records(read(spark, sf_dir, "events").select(line.alias("value")))


@query("""WITH j AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) * 1.0e0 AS n FROM lineitem GROUP BY 1, 2),
t AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY x) / sum(n) OVER () AS px, sum(n) OVER (PARTITION BY y) / sum(n) OVER () AS py FROM j)
SELECT round(sum(p * log2(p / (px * py))), 6) + 0 AS mi, round(-sum(p * log2(px)), 6) AS hx, round(-sum(p * log2(py)), 6) AS hy FROM t""")
def mutual_information(spark, sf_dir):
    out = E.mutual_information(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")
    return out.select((F.round("mi", 6) + 0).alias("mi"), F.round("hx", 6).alias("hx"), F.round("hy", 6).alias("hy"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL")
def joint_counts(spark, sf_dir):
    return E.joint_counts(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_linenumber")


@query("SELECT o_orderkey, coalesce(c_mktsegment, 'NONE') AS segment, c_custkey IS NOT NULL AS hit FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def exact_lookup(spark, sf_dir):
    rules = read(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return T.exact_lookup(read(spark, sf_dir, "orders"), rules, ["o_custkey"], {"segment": "NONE"}).select("o_orderkey", "segment", "hit")


@query("SELECT event_id, n_name FROM events LEFT JOIN nation ON n_nationkey = user_id & 15")
def array_lookup(spark, sf_dir):
    entries = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("index"), "n_name")
    return T.array_lookup(read(spark, sf_dir, "events"), entries, F.col("user_id"), 16).select("event_id", "n_name")


@query("SELECT event_id, 'DROP' AS action, false AS hit FROM events")
def default_action(spark, sf_dir):
    return T.default_action(read(spark, sf_dir, "events").select("event_id"), action="DROP")


# prefixes from suppliers and nations: depth 16 + key % 16, address from the key
ROUTES = "SELECT CAST(l AS BIGINT) AS prefix, d AS depth, max(h) AS next_hop FROM (SELECT s_suppkey * 655360 AS l, CAST(8 + s_suppkey % 12 AS INT) AS d, s_suppkey AS h FROM supplier) AS r GROUP BY 1, 2"
ADDRESS = "user_id * 655360 % 4294967296 + event_id % 65536"


@query(f"""WITH routes AS ({ROUTES}), packets AS (SELECT event_id, {ADDRESS} AS ip FROM events),
hits AS (SELECT event_id, next_hop, depth, row_number() OVER (PARTITION BY event_id ORDER BY depth DESC, next_hop DESC) AS r FROM packets JOIN routes ON ip >> (32 - depth) = prefix >> (32 - depth))
SELECT p.event_id, next_hop, depth FROM packets p LEFT JOIN hits h ON h.event_id = p.event_id AND r = 1""")
def lpm_lookup(spark, sf_dir):
    routes = read(spark, sf_dir, "supplier").selectExpr("s_suppkey * 655360 AS prefix", "CAST(8 + s_suppkey % 12 AS INT) AS depth", "s_suppkey AS next_hop")
    return T.lpm_lookup(read(spark, sf_dir, "events").selectExpr("event_id", f"{ADDRESS} AS ip"), routes, "ip").select("event_id", "next_hop", "depth")


ACL = [
    T.AclRule({"flow": ("range", 0, 49)}, 10, 1),
    T.AclRule({"len": ("range", 20, 60)}, 20, 2, (0, 1)),
    T.AclRule({"flow": ("bitmask", 1, 1), "colour": ("range", 0, 0)}, 30, 3),
    T.AclRule({"flow": ("mask", 64, 26)}, 5, 4, (1,)),
]


@query(f"""WITH {PACKETS}
SELECT event_id, CASE WHEN flow & 1 = 1 AND colour = 0 THEN 3 WHEN len BETWEEN 20 AND 60 THEN 2 WHEN flow BETWEEN 0 AND 49 THEN 1 ELSE 0 END AS class_0,
       CASE WHEN len BETWEEN 20 AND 60 THEN 2 WHEN flow >> 6 = 1 THEN 4 ELSE 0 END AS class_1 FROM packets""")
def acl_classify(spark, sf_dir):
    return T.acl_classify(packets(spark, sf_dir), ACL, 2).select("event_id", "class_0", "class_1")


@query(f"""WITH {PACKETS}
SELECT event_id, CASE WHEN flow & 1 = 1 AND colour = 0 THEN NULL WHEN len > 60 THEN flow % 4 ELSE 9 END AS port,
       CASE WHEN flow & 1 = 1 AND colour = 0 THEN 'acl' WHEN len > 60 THEN 'route' ELSE 'acl' END AS "table" FROM packets""")
def pipeline_route(spark, sf_dir):
    """An access-control table that drops, sends or passes on to a routing table."""

    def acl(rows):
        drop = (F.col("flow").bitwiseAND(F.lit(1)) == 1) & (F.col("colour") == 0)
        action = F.when(drop, "DROP").when(F.col("len") > 60, "TABLE").otherwise("PORT")
        return rows.withColumns({"action": action, "target": F.when(F.col("len") > 60, "route").otherwise("9")})

    def route(rows):
        return rows.withColumns({"action": F.lit("PORT"), "target": (F.col("flow") % 4).cast("string")})

    out = T.pipeline_route(packets(spark, sf_dir), [T.Stage("acl", acl), T.Stage("route", route)])
    return out.select("event_id", F.col("port").cast("long").alias("port"), "table")


@query("SELECT count(*) AS packets, count(c_custkey) AS hits, count(*) - count(c_custkey) AS misses FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def table_stats(spark, sf_dir):
    return T.table_stats(exact_lookup(spark, sf_dir))


def _timed(spark, sf_dir):
    return packets(spark, sf_dir).select("event_id", "flow", F.unix_micros(F.col("ts").cast("timestamp")).alias("time"), "len", "colour")


def _meter(make):
    return lambda spark, sf_dir: W.meter(_timed(spark, sf_dir), make)


DAY = 86_400_000_000
for _name, _make in {
    "srtcm_blind": lambda: W.SingleRate(40, DAY, 120, 80),
    "srtcm_aware": lambda: W.SingleRate(40, DAY, 120, 80, True),
    "trtcm_blind": lambda: W.TwoRate(40, DAY, 60, DAY, 120, 150),
    "trtcm_aware": lambda: W.TwoRate(40, DAY, 60, DAY, 120, 150, True),
}.items():
    QUERIES[_name] = _meter(_make)


RED_SQL = f"""WITH RECURSIVE {PACKETS.strip()}, o AS (SELECT event_id, flow, epoch_us(ts) AS t, row_number() OVER (PARTITION BY flow ORDER BY epoch_us(ts), event_id) AS r FROM packets),
d AS (SELECT *, (event_id * 2654435761) % 4294967296 AS h FROM o), e AS (SELECT *, CAST(CAST(xor(h, h >> 15) AS HUGEINT) * 2246822519 % 4294967296 AS BIGINT) AS g FROM d), u AS (SELECT *, xor(g, g >> 13) / 4294967296.0e0 AS u FROM e),
m AS (SELECT event_id, flow, r, t, 0.0e0 AS average, false AS dropped, 1.0e0 AS q, CAST(-1 AS BIGINT) AS k FROM u WHERE r = 1
  UNION ALL SELECT event_id, flow, r, t, average, dropped, CASE WHEN dropped THEN q ELSE q + 1 END, CASE WHEN dropped THEN 0 WHEN average > 1.0 THEN k + 1 ELSE -1 END FROM (
    SELECT *, average >= 8.0 OR (average > 1.0 AND u < pb / greatest(1e-9, 1 - (k + 1) * pb)) AS dropped FROM (
      SELECT *, 0.5e0 * (average - 1.0e0) / 7.0e0 AS pb FROM (
        SELECT event_id, flow, r, t, u, q, k, a + 0.2e0 * (q - a) AS average FROM (
          SELECT n.event_id, n.flow, n.r, n.t, n.u, greatest(0.0e0, m.q - (n.t - m.t) / 1e6 * 1e-6) AS q, m.average * pow(0.8e0, greatest(0.0e0, (n.t - m.t) / 1e6 * 1e-6 - m.q)) AS a, m.k FROM m JOIN u n ON n.flow = m.flow AND n.r = m.r + 1
        ) AS s1) AS s2) AS s3) AS s4)
SELECT event_id, flow, round(average, 6) AS average, dropped FROM m"""


@query(RED_SQL)
def red_drop(spark, sf_dir):
    return W.early_drop(_timed(spark, sf_dir).drop("colour"), 1.0, 8.0, 0.5, weight=0.2, drain=1e-6).withColumn("average", F.round("average", 6))


@query()
def wred_drop(spark, sf_dir):
    """Packets of colour 2 are dropped sooner, those of colour 0 later."""
    colours = {0: W.DropProfile(2.0, 10.0, 0.3), 2: W.DropProfile(0.5, 4.0, 0.9)}
    return W.early_drop(_timed(spark, sf_dir), 1.0, 8.0, 0.5, weight=0.2, drain=1e-6, colours=colours).withColumn("average", F.round("average", 6))


@query("SELECT event_id, user_id AS flow, event_id % 7 + event_id // 7 * 7 AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 7 + event_id // 7 * 7, event_id) AS place FROM events")
def reorder_drain(spark, sf_dir):
    return W.reorder_drain(packets(spark, sf_dir).selectExpr("event_id", "flow", "event_id % 7 + event_id DIV 7 * 7 AS seq"))


@query(f"""WITH {PACKETS}, f AS (SELECT event_id, len, unnest(range(0, greatest(len, 1), 16)) AS "offset" FROM packets WHERE len >= 0)
SELECT event_id, "offset", least(16, len - "offset") AS size, "offset" + 16 < len AS more FROM f""")
def fragment(spark, sf_dir):
    return W.fragment(packets(spark, sf_dir), 16)


@query(f"WITH {PACKETS} SELECT event_id, len, true AS complete FROM packets WHERE len >= 0")
def reassemble(spark, sf_dir):
    return W.reassemble(W.fragment(packets(spark, sf_dir), 16))


@query(f"WITH {PACKETS} SELECT flow, count(DISTINCT flow % 4) AS workers, count(*) AS n FROM packets GROUP BY flow")
def flow_affinity(spark, sf_dir):
    return W.flow_affinity(packets(spark, sf_dir), 4).groupBy("flow").agg(F.countDistinct("worker").alias("workers"), F.count(F.lit(1)).alias("n"))
