"""Queries of the recommender toolkit over customers' purchases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import similarity as S
from .views import COPURCHASE, RATINGS, copurchase, ratings

QUERIES, SQL = {}, {}
#: Pairs need so many users in common.
COMMON = 4

PAIRS = f"""
deg AS (SELECT "user", count(*) AS degree FROM ratings GROUP BY "user"),
items AS (SELECT item, count(*) AS n, sum(rating) AS s, sum(rating * rating) AS q FROM ratings GROUP BY item HAVING count(*) >= {COMMON}),
kept AS (SELECT * FROM ratings WHERE item IN (SELECT item FROM items)),
raw AS (
  SELECT a.item AS i, b.item AS j, count(*) AS n, sum(a.rating * b.rating) AS xy, sum(a.rating) AS x, sum(b.rating) AS y,
         sum(a.rating * a.rating) AS xx, sum(b.rating * b.rating) AS yy, sum(abs(a.rating - b.rating)) AS d1,
         sum(CASE WHEN degree > 1 THEN 1 / ln(degree) END) AS aa, sum(1.0e0 / degree) AS ra
  FROM kept a JOIN kept b ON a."user" = b."user" AND a.item < b.item JOIN deg ON deg."user" = a."user"
  GROUP BY a.item, b.item HAVING count(*) >= {COMMON}
),
pairs AS (SELECT raw.*, u.n AS ni, v.n AS nj, u.s AS si, v.s AS sj, u.q AS qi, v.q AS qj FROM raw JOIN items u ON u.item = i JOIN items v ON v.item = j)
"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(p.strip() for p in parts)


def safe_log(p: str, k: str) -> str:
    return f"(CASE WHEN {p} > 0 THEN {k} * ln({p}) ELSE 0 END)"


def log_l(p: str, k: str, n: str) -> str:
    return f"({safe_log(p, k)} + {safe_log(f'(1 - {p})', f'({n} - {k})')})"


USERS = "(SELECT count(*) FROM deg)"
P1, P2, P = "(n / (ni * 1.0e0))", f"((nj - n) / ({USERS} - ni * 1.0e0))", f"(nj / ({USERS} * 1.0e0))"
TWO_LOG = f"2 * ({log_l(P1, 'n', 'ni')} + {log_l(P2, '(nj - n)', f'({USERS} - ni)')} - {log_l(P, 'n', 'ni')} - {log_l(P, '(nj - n)', f'({USERS} - ni)')})"
METRICS = {
    "sim_jaccard": ("jaccard", "n / (ni + nj - n * 1.0e0)"),
    "sim_aa": ("adamic_adar", "aa"),
    "sim_ra": ("resource_allocation", "ra"),
    "sim_asymcos": ("asymmetric_cosine", "n / (pow(ni, 0.5) * pow(nj, 0.5))"),
    "sim_pearson": ("pearson", "(n * xy - x * y) / nullif(sqrt((n * xx - x * x) * (n * yy - y * y)), 0)"),
    "sim_cosine": ("cosine_distance", "1 - xy / (sqrt(qi) * sqrt(qj))"),
    "sim_manhattan": ("manhattan", "d1 + si - x + sj - y"),
    "sim_euclidean": ("euclidean", "sqrt(qi + qj - 2 * xy)"),
    "sim_dot": ("dot", "xy"),
    "sim_tanimoto": ("tanimoto_distance", "1 - xy / (qi + qj - xy)"),
    "sim_slopeone": ("slope_one", "(si - sj) / n"),
    "sim_loglik": ("log_likelihood", f"1 - 1 / (1 + {TWO_LOG})"),
}


def _metric_query(name: str):
    def run(spark, sf_dir):
        r = ratings(spark, sf_dir)
        options = {"users": r.select("user").distinct().count()} if name == "log_likelihood" else {}
        return S.similarity(r, name, COMMON, **options).withColumn("sim", F.round("sim", 6))

    return run


for key, (name, expression) in METRICS.items():
    QUERIES[key] = _metric_query(name)
    SQL[key] = with_(RATINGS, PAIRS) + f" SELECT i, j, round({expression}, 6) AS sim FROM pairs"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(with_(RATINGS, PAIRS) + """, sides AS (SELECT i, j, "user", rating AS x FROM pairs JOIN ratings ON item = i UNION ALL SELECT i, j, "user", -rating FROM pairs JOIN ratings ON item = j)
SELECT i, j, max(d) AS sim FROM (SELECT i, j, abs(sum(x)) AS d FROM sides GROUP BY i, j, "user") AS s GROUP BY i, j""")
def sim_chebyshev(spark, sf_dir):
    return S.chebyshev(ratings(spark, sf_dir), COMMON)


WEIGHTED = """w AS (SELECT least(src, dst) AS i, greatest(src, dst) AS j, count(*) AS w FROM copurchase GROUP BY 1, 2),
strength AS (SELECT id, sum(w) AS s FROM (SELECT i AS id, w FROM w UNION ALL SELECT j, w FROM w) AS e GROUP BY id)"""


@query(with_(COPURCHASE, WEIGHTED) + " SELECT i, j, round(w / (a.s + b.s - w * 1.0e0), 6) AS sim FROM w JOIN strength a ON a.id = i JOIN strength b ON b.id = j")
def sim_wjaccard(spark, sf_dir):
    edges = copurchase(spark, sf_dir).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    return S.weighted_jaccard(edges).withColumn("sim", F.round("sim", 6))


TOP = with_(RATINGS, PAIRS) + """, s AS (SELECT i, j, n / (ni + nj - n * 1.0e0) AS sim FROM pairs),
b AS (SELECT i AS item, j AS other, sim FROM s UNION ALL SELECT j, i, sim FROM s),
t AS (SELECT item, other, sim, row_number() OVER (PARTITION BY item ORDER BY sim DESC, other) AS rank FROM b)"""


@query(TOP + " SELECT item, other, round(sim, 6) AS sim, rank FROM t WHERE rank <= 5")
def sim_topk(spark, sf_dir):
    top = S.top_similar(S.similarity(ratings(spark, sf_dir), "jaccard", COMMON), 5)
    return top.withColumns({"sim": F.round("sim", 6), "rank": F.col("rank").cast("long")})


@query(TOP + """, c AS (SELECT r."user", other AS item, sum(pow(round(sim, 9), 3)) AS score FROM ratings r JOIN b ON b.item = r.item GROUP BY 1, 2),
f AS (SELECT c.* FROM c LEFT JOIN ratings r ON r."user" = c."user" AND r.item = c.item WHERE r.item IS NULL),
k AS (SELECT "user", item, round(score, 6) AS score, row_number() OVER (PARTITION BY "user" ORDER BY round(score, 6) DESC, item) AS rank FROM f)
SELECT * FROM k WHERE rank <= 5""")
def rec_from_sim(spark, sf_dir):
    r = ratings(spark, sf_dir)
    sims = S.similarity(r, "jaccard", COMMON).withColumn("sim", F.round("sim", 9))
    # ranked by the rounded score, so that sums in another order make no difference
    from pyspark.sql import Window

    every = S.recommend_from_similar(r, sims, 1 << 30).drop("rank").withColumn("score", F.round("score", 6))
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("score"), "item")).cast("long")).filter("rank <= 5")


def _baseline(by, sql_by):
    def run(spark, sf_dir):
        out = S.losses(S.baseline(ratings(spark, sf_dir), by))
        return out.select(F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"), "n")

    over = f'OVER (PARTITION BY {sql_by})' if sql_by else "OVER ()"
    sql = with_(RATINGS) + f", p AS (SELECT rating, avg(rating) {over} AS m FROM ratings) SELECT round(sqrt(avg((rating - m) * (rating - m))), 6) AS rmse, round(avg(abs(rating - m)), 6) AS mae, count(*) AS n FROM p"
    return run, sql


for key, by, sql_by in (("baseline_global", None, None), ("baseline_user", "user", '"user"'), ("baseline_item", "item", "item")):
    QUERIES[key], SQL[key] = _baseline(by, sql_by)

# what a customer bought most of, against popularity
RANKED = """pop AS (SELECT item, count(*) AS c FROM ratings GROUP BY item),
ranked AS (SELECT "user", r.item, row_number() OVER (PARTITION BY "user" ORDER BY c DESC, r.item) AS rank FROM ratings r JOIN pop ON pop.item = r.item),
relevant AS (SELECT "user", item FROM ratings WHERE rating > 30)"""


def _ranked(spark, sf_dir):
    from pyspark.sql import Window

    r = ratings(spark, sf_dir)
    popular = r.groupBy("item").agg(F.count(F.lit(1)).alias("c"))
    ranked = r.join(popular, "item").select("user", "item", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("c"), "item")).alias("rank"))
    return ranked, r.filter("rating > 30").select("user", "item")


@query(with_(RATINGS, RANKED) + """, h AS (SELECT "user", rank, item IN (SELECT item FROM relevant v WHERE v."user" = ranked."user") AS hit FROM ranked WHERE rank <= 3),
g AS (SELECT "user", CASE WHEN hit THEN sum(hit::INT) OVER (PARTITION BY "user" ORDER BY rank) / (rank * 1.0e0) ELSE 0 END AS g FROM h),
t AS (SELECT "user", count(*) AS n FROM relevant GROUP BY "user"), s AS (SELECT "user", sum(g) AS g FROM g GROUP BY "user")
SELECT round(avg(coalesce(g, 0) / least(n, 3)), 6) AS map, count(*) AS users FROM t LEFT JOIN s USING ("user")""")
def map_at_3(spark, sf_dir):
    ranked, relevant = _ranked(spark, sf_dir)
    return S.average_precision(ranked, relevant, 3).agg(F.round(F.avg("ap"), 6).alias("map"), F.count(F.lit(1)).alias("users"))


@query(with_(RATINGS, RANKED) + """, f AS (SELECT r."user", min(rank) AS r FROM ranked r JOIN relevant v ON v."user" = r."user" AND v.item = r.item GROUP BY 1)
SELECT round(avg(coalesce(1.0e0 / r, 0)), 6) AS mrr, count(*) AS users FROM (SELECT DISTINCT "user" FROM ranked) AS u LEFT JOIN f USING ("user")""")
def mrr(spark, sf_dir):
    ranked, relevant = _ranked(spark, sf_dir)
    return S.reciprocal_rank(ranked, relevant).agg(F.round(F.avg("rr"), 6).alias("mrr"), F.count(F.lit(1)).alias("users"))


@query(with_(RATINGS) + """, o AS (SELECT *, (row_number() OVER (ORDER BY "user", item) - 1) % 5 AS fold FROM ratings)
SELECT fold, count(*) AS n, sum(rating) AS rating FROM o GROUP BY fold""")
def kfold_counts(spark, sf_dir):
    return S.kfold(ratings(spark, sf_dir), 5, "user", "item").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("rating"))
