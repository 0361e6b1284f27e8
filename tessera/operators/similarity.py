"""Item similarity, recommendation from similarity, and ranking metrics."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Stored, collect

#: Ratings of one part of a user, about.
PART = 1024
#: Pairs of a user's ratings that are counted at once, about; more go in rounds by item, whose shuffle files are freed.
ROUND = 1 << 26


def pair_stats(ratings: DataFrame, least_common: int = 1) -> DataFrame:
    """One row for each pair of items i < j with users in common, with every sum the metrics need.

    Items with fewer than least_common users are dropped before the join on
    users; the pair sums are combined before their shuffle. A user of n
    ratings costs n^2 pairs, spread over (n / PART)^2 keys. Where that is more
    than ROUND pairs, they are first only counted, in rounds, and the sums are
    made for those with enough users in common.
    """
    r = whole = Stored(ratings.select("user", "item", F.col("rating").cast("double").alias("x"))).df
    items = r.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.sum(F.abs("x")).alias("a"))
    items = items.filter(F.col("n") >= least_common)
    users = r.groupBy("user").agg(F.count(F.lit(1)).alias("degree"))
    r = r.join(items.select("item"), "item", "left_semi").join(users, "user").withColumn("parts", F.ceil(F.col("degree") / PART).cast("int"))
    # a user of many ratings is dealt in parts, and each pair of parts is joined on its own
    part, others = F.pmod(F.xxhash64("item"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = r.select("user", F.col("item").alias("i"), "x", "degree", part.alias("p"), others.alias("q"))
    right = r.select("user", F.col("item").alias("j"), F.col("x").alias("y"), part.alias("q"), others.alias("p"))
    x, y, d = F.col("x"), F.col("y"), F.col("degree")

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("i", "j").agg(
            F.count(F.lit(1)).alias("n"), F.sum(x * y).alias("xy"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"),
            F.sum(F.abs(x - y)).alias("d1"), F.sum(F.abs(x)).alias("ax"), F.sum(F.abs(y)).alias("ay"), F.sum(x - y).alias("dxy"),
            F.sum(F.when(d > 1, 1 / F.log(d))).alias("aa"), F.sum(1 / d).alias("ra"),
        ).filter(F.col("n") >= least_common)

    rounds = -(-int(users.agg(F.sum(F.col("degree") * (F.col("degree") - 1) / 2)).first()[0] or 0) // ROUND)
    if rounds <= 1:
        pairs = summed(left.join(right, ["user", "p", "q"]).filter("i < j"))
    else:
        spark, done = ratings.sparkSession, []
        for k in range(rounds):
            some = left.filter(F.pmod(F.xxhash64("i"), F.lit(rounds)) == k).drop("x", "degree")
            enough = some.join(right.drop("y"), ["user", "p", "q"]).filter("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_common)
            enough = Stored(enough.select("i", "j"))
            collect(spark)
            own = enough.df.join(whole.select(F.col("item").alias("i"), "user", "x"), "i").join(users, "user")
            done.append(Stored(summed(own.join(whole.select(F.col("item").alias("j"), "user", F.col("x").alias("y")), ["user", "j"]))).df)
            enough.drop()
            collect(spark)
        pairs = functools.reduce(DataFrame.union, done)
    named = lambda side: items.select(F.col("item").alias(side), *[F.col(c).alias(f"{c}{side}") for c in ("n", "s", "q", "a")])
    return pairs.join(named("i"), "i").join(named("j"), "j")


def _x_log(p: Column, k: Column) -> Column:
    return F.when(p > 0, k * F.log(p)).otherwise(0.0)


def _log_l(p: Column, k: Column, n: Column) -> Column:
    return _x_log(p, k) + _x_log(1 - p, n - k)


def _log_likelihood(n: Column, ni: Column, nj: Column, users: Column) -> Column:
    """1 - 1 / (1 + 2 log lambda), of sets: how often j's users are among i's, and among the others."""
    k1, k2, n1, n2 = n, nj - n, ni, users - ni
    p = (k1 + k2) / (n1 + n2)
    two = 2 * (_log_l(k1 / n1, k1, n1) + _log_l(k2 / n2, k2, n2) - _log_l(p, k1, n1) - _log_l(p, k2, n2))
    return 1 - 1 / (1 + two)


def metric(name: str, alpha: float = 0.5, users: int = 0) -> Column:
    """A similarity or distance over pair_stats columns."""
    c = F.col
    n, ni, nj = c("n"), c("ni"), c("nj")
    norm = F.sqrt(c("qi")) * F.sqrt(c("qj"))
    table = {
        "jaccard": lambda: n / (ni + nj - n),
        "adamic_adar": lambda: c("aa"),
        "resource_allocation": lambda: c("ra"),
        "asymmetric_cosine": lambda: n / (F.pow(ni, F.lit(alpha)) * F.pow(nj, F.lit(1 - alpha))),
        "pearson": lambda: (n * c("xy") - c("x") * c("y")) / F.nullif(F.sqrt((n * c("xx") - c("x") * c("x")) * (n * c("yy") - c("y") * c("y"))), F.lit(0.0)),
        "cosine_distance": lambda: 1 - c("xy") / norm,
        "manhattan": lambda: c("d1") + c("ai") - c("ax") + c("aj") - c("ay"),
        "euclidean": lambda: F.sqrt(c("qi") + c("qj") - 2 * c("xy")),
        "tanimoto_distance": lambda: 1 - c("xy") / (c("qi") + c("qj") - c("xy")),
        "slope_one": lambda: (c("si") - c("sj")) / n,
        "dot": lambda: c("xy"),
        "log_likelihood": lambda: _log_likelihood(n.cast("double"), ni.cast("double"), nj.cast("double"), F.lit(float(users))),
    }
    return table[name]()


def directed_cosine(ratings: DataFrame, alpha: float = 0.5, least_common: int = 1) -> DataFrame:
    """i, j, sim of ordered pairs: common users over |i| ** alpha * |j| ** (1 - alpha)."""
    stats = pair_stats(ratings, least_common)
    back = stats.select(F.col("j").alias("i"), F.col("i").alias("j"), "n", F.col("nj").alias("ni"), F.col("ni").alias("nj"))
    both = stats.select("i", "j", "n", "ni", "nj").unionByName(back)
    return both.select("i", "j", metric("asymmetric_cosine", alpha=alpha).alias("sim"))


def similarity(ratings: DataFrame, name: str, least_common: int = 1, **options) -> DataFrame:
    """i, j, sim for pairs i < j."""
    return pair_stats(ratings, least_common).select("i", "j", metric(name, **options).alias("sim"))


def chebyshev(ratings: DataFrame, least_common: int = 1) -> DataFrame:
    """i, j, sim: largest absolute difference over the union of users, absent ratings being 0."""
    r = ratings.select("user", "item", F.col("rating").cast("double").alias("x"))
    pairs = pair_stats(ratings, least_common).select("i", "j")
    a = pairs.join(r.select(F.col("item").alias("i"), "user", "x"), "i").select("i", "j", "user", "x")
    b = pairs.join(r.select(F.col("item").alias("j"), "user", (-F.col("x")).alias("x")), "j").select("i", "j", "user", "x")
    return a.union(b).groupBy("i", "j", "user").agg(F.abs(F.sum("x")).alias("d")).groupBy("i", "j").agg(F.max("d").alias("sim"))


def weighted_jaccard(edges: DataFrame) -> DataFrame:
    """i, j, sim: w / (strength i + strength j - w) of connected pairs, from src, dst, weight."""
    w = edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).agg(F.sum("weight").alias("w"))
    ends = w.select(F.explode(F.array("i", "j")).alias("id"), "w").groupBy("id").agg(F.sum("w").alias("strength"))
    a = ends.select(F.col("id").alias("i"), F.col("strength").alias("a"))
    b = ends.select(F.col("id").alias("j"), F.col("strength").alias("b"))
    return w.join(a, "i").join(b, "j").select("i", "j", (F.col("w") / (F.col("a") + F.col("b") - F.col("w"))).alias("sim"))


def top_similar(sims: DataFrame, k: int) -> DataFrame:
    """item, other, sim, rank: each item's k most similar ones; ties by the smaller id."""
    both = sims.select(F.col("i").alias("item"), F.col("j").alias("other"), "sim").union(sims.select("j", "i", "sim")).filter("sim <> 0")
    order = Window.partitionBy("item").orderBy(F.desc("sim"), "other")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def recommend_from_similar(ratings: DataFrame, sims: DataFrame, k: int, power: float = 3.0, directed: bool = False) -> DataFrame:
    """user, item, score, rank: sum of sim ** power over the user's items, without those they have.

    directed: a pair (i, j) recommends j to those who have i, but not the other way round.
    """
    both = sims.filter("i <> j").select(F.col("i").alias("item"), F.col("j").alias("other"), "sim")
    if not directed:
        both = both.union(sims.filter("i <> j").select("j", "i", "sim"))
    seen = ratings.select("user", "item").distinct()
    scored = seen.join(both, "item").groupBy("user", F.col("other").alias("item")).agg(F.sum(F.pow("sim", F.lit(power))).alias("score"))
    fresh = scored.join(seen, ["user", "item"], "left_anti")
    order = Window.partitionBy("user").orderBy(F.desc("score"), "item")
    return fresh.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def baseline(ratings: DataFrame, by: str | None = None) -> DataFrame:
    """ratings with prediction: the global mean, or the mean by user or item."""
    if by is None:
        return ratings.crossJoin(F.broadcast(ratings.agg(F.avg("rating").alias("prediction"))))
    return ratings.join(ratings.groupBy(by).agg(F.avg("rating").alias("prediction")), by)


def logistic_loss(predicted: DataFrame) -> DataFrame:
    """loss, n: the mean log loss of predictions in 0..1 against ratings in 0..1."""
    p = F.least(F.greatest(F.col("prediction"), F.lit(1e-12)), F.lit(1 - 1e-12))
    return predicted.agg(F.avg(-(F.col("rating") * F.log(p) + (1 - F.col("rating")) * F.log(1 - p))).alias("loss"), F.count(F.lit(1)).alias("n"))


def losses(predicted: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """rmse, mae, n of rating against prediction, clamped to [low, high]."""
    p = F.col("prediction")
    p = F.greatest(p, F.lit(low)) if low is not None else p
    p = F.least(p, F.lit(high)) if high is not None else p
    e = F.col("rating") - p
    return predicted.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count(F.lit(1)).alias("n"))


def average_precision(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """user, ap: ranked (user, item, rank from 1) against relevant (user, item), the first k of each counted."""
    truth = relevant.groupBy("user").agg(F.countDistinct("item").alias("n"))
    hit = ranked.filter(F.col("rank") <= k).join(relevant.select("user", "item").distinct().withColumn("hit", F.lit(1)), ["user", "item"], "left").na.fill(0, ["hit"])
    so_far = F.sum("hit").over(Window.partitionBy("user").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    gained = hit.withColumn("g", F.when(F.col("hit") == 1, so_far / F.col("rank")).otherwise(0.0)).groupBy("user").agg(F.sum("g").alias("g"))
    return truth.join(gained, "user", "left").select("user", (F.coalesce("g", F.lit(0.0)) / F.least(F.col("n"), F.lit(k))).alias("ap"))


def reciprocal_rank(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """user, rr: 1 / rank of the first relevant item, 0 without one."""
    users = ranked.select("user").distinct()
    first = ranked.join(relevant.select("user", "item").distinct(), ["user", "item"], "left_semi").groupBy("user").agg(F.min("rank").alias("r"))
    return users.join(first, "user", "left").select("user", F.coalesce(1 / F.col("r"), F.lit(0.0)).alias("rr"))


def kfold(rows: DataFrame, folds: int, *order: str) -> DataFrame:
    """Adds fold: the row's number (in an order) modulo the number of folds."""
    from ..graph import rank_by

    return rank_by(rows, "_row", *order).withColumn("fold", F.col("_row") % folds).drop("_row")
