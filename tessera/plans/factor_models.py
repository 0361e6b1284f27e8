"""Factor-model queries.

At production size they have no SQL, as they start from random draws; tests
hold their losses against the baselines. At size 2 SQL follows every step.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import factors as M
from ..operators import similarity as S
from ..operators.machines import Machine, fit_sparse, sparse_rows, sparse_vectors, with_last_item
from ..session import Stored
from .views import RATINGS, ratings, read

QUERIES, SQL = {}, {}


def _ratings(spark, sf_dir):
    """Ratings with a weight and a time bin, so that every model finds its columns."""
    r = ratings(spark, sf_dir)
    return r.withColumn("weight", 1 + F.col("item") % 3).withColumn("time", F.col("user") % 4)


def _losses(model, iterations=2):
    def run(spark, sf_dir):
        r = Stored(_ratings(spark, sf_dir)).df
        out = S.losses(M.predicted(M.fit(r, model(), iterations), r), 0.0, 200.0)
        return out.select(F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), "n")

    return run


def _scaled(cls, **attributes):
    def make():
        m = cls()
        for k, v in attributes.items():
            setattr(m, k, v)
        return m

    return make


QUERIES |= {
    "als_rmse": _losses(M.LeastSquares),
    "wals": _losses(M.WeightedLeastSquares),
    "als_coord": _losses(M.CoordinateDescent),
    "sparse_als": _losses(M.SparseLeastSquares),
    "als_tensor": _losses(M.TensorLeastSquares),
    "nmf": _losses(M.Nonnegative),
    "sgd": _losses(M.Gradient),
    "bias_sgd": _losses(M.BiasedGradient),
    "bias_sgd2": _losses(M.LogisticGradient),
    "svdpp": _losses(M.ImplicitGradient),
    "time_svdpp": _losses(M.TimeGradient),
    "rbm": _losses(M.Boltzmann),
    "bpmf": _losses(M.SampledFactors, 10),
}


def climf(spark, sf_dir):
    """The smoothed reciprocal rank reached, in all and for each user, with the numbers of users and pairs trained on."""
    fitted, relevant = M.fit_rank(_ratings(spark, sf_dir), M.RankGradient(), 2)
    reached = M.rank_objective(fitted, relevant)
    n = relevant.agg(F.countDistinct("user").alias("users"), F.count(F.lit(1)).alias("n"))
    objective = F.lit(reached)
    return n.select(F.round(objective, 4).alias("objective"), F.round(objective / F.nullif("users", F.lit(0)), 4).alias("for_each_user"), "users", "n")


def als_topn(spark, sf_dir):
    r = Stored(ratings(spark, sf_dir)).df
    return M.top_items(M.fit(r, M.LeastSquares(), 2), r, 5).withColumn("score", F.round("score", 4))


def svd(spark, sf_dir):
    values = M.svd(ratings(spark, sf_dir), 4).values
    return spark.createDataFrame([(i, round(float(v), 4)) for i, v in enumerate(values)], "rank int, value double")


def _machine(make):
    def run(spark, sf_dir):
        r = Stored(with_last_item(Stored(_ratings(spark, sf_dir)).df)).df
        out = S.losses(make().fit(r).predict(r), 0.0, 200.0)
        return out.select(F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), "n")

    return run


def sparse_machine(spark, sf_dir):
    """A machine on sparse rows `label id:value ..` of parts: brand, size and price."""
    from .engine import _folder

    part = read(spark, sf_dir, "part")
    brand = F.regexp_extract("p_brand", r"(\d+)", 1)
    line = F.concat_ws(" ", (F.col("p_retailprice") / 1000).cast("string"), F.concat(brand, F.lit(":1")), F.concat(F.lit("100:"), (F.col("p_size") / 50).cast("string")))
    vectors = sparse_vectors(sparse_rows(part.select(line.alias("value"))), _folder(spark, "sparse"))
    fitted = fit_sparse(vectors, steps=5).transform(vectors).withColumnRenamed("label", "rating")
    return S.losses(fitted).select(F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), "n")


QUERIES |= {
    "sparse_machine": sparse_machine,
    "climf": climf,
    "als_topn": als_topn,
    "svd": svd,
    "fm": _machine(lambda: Machine(["user", "item", "time", "last_item"], [], steps=5)),
    "gensgd": _machine(lambda: Machine(["user", "item", "time"], ["weight"], steps=5, cold_start="item")),
}


# The same models at size 2 from a start that SQL can spell, so that SQL can follow them step by step.


def _plain(cls):
    """cls with first factors from the ids by arithmetic."""

    class Plain(cls):
        def start(self, ids, side):
            width = super().start(ids[:1], side).shape[1]
            draw = ((ids[:, None] * 31 + np.arange(width) * 17 + side * 7) % 97 + 1) / 97 * 0.3
            return draw * self.filled(side, width)

        def filled(self, side, width):
            """Which entries don't start at 0."""
            if cls is M.ImplicitGradient:
                return np.arange(width) < (2 if side == 0 else 4)
            return np.ones(width, bool)

    return Plain


def _start_sql(side: int, width: int, filled: int) -> str:
    return ", ".join(f"((id * 31 + {17 * j + 7 * side}) % 97 + 1) / 97.0e0 * 0.3e0 AS f{j}" if j < filled else f"0.0e0 AS f{j}" for j in range(width))


def _fit_sql(gather, apply, widths=(2, 2), filled=(2, 2), steps=2) -> str:
    """CTEs u<steps>, v<steps>. gather(side) and apply(side): expressions over o (own), p (other), r, m; and o, s<i>, n."""
    keys = ('"user"', "item")
    parts = ["r AS (SELECT *, 1 + item % 3 AS weight FROM ratings)", "m AS (SELECT avg(rating) AS mean FROM r)"]
    for side, name in enumerate("uv"):
        parts.append(f"{name}0 AS (SELECT id, {_start_sql(side, widths[side], filled[side])} FROM (SELECT DISTINCT {keys[side]} AS id FROM r) AS d)")
    for i in range(1, steps + 1):
        for side, name, other in ((0, f"u{i - 1}", f"v{i - 1}"), (1, f"v{i - 1}", f"u{i}")):
            sums = ", ".join(f"sum({x}) AS s{j}" for j, x in enumerate(gather(side)))
            parts.append(f"s{'uv'[side]}{i} AS (SELECT o.id, {sums}, count(*) AS n FROM r JOIN {name} o ON o.id = r.{keys[side]} JOIN {other} p ON p.id = r.{keys[1 - side]}, m GROUP BY o.id)")
            new = ", ".join(f"{x} AS f{j}" for j, x in enumerate(apply(side)))
            parts.append(f"{'uv'[side]}{i} AS (SELECT o.id, {new} FROM s{'uv'[side]}{i} s JOIN {name} o ON o.id = s.id)")
    return f"WITH {RATINGS.strip()}, " + ",\n".join(parts)


def _loss_sql(predict: str) -> str:
    p = predict.format(u="u", v="v")
    return f""" , e AS (SELECT rating - greatest(least({p}, 200.0), 0.0) AS e FROM r JOIN u2 u ON u.id = r."user" JOIN v2 v ON v.id = item, m)
    SELECT round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, count(*) AS n FROM e"""


def _top_sql(predict: str) -> str:
    p = predict.format(u="u", v="v")
    return f""" , t AS (SELECT u.id AS "user", v.id AS item, {p} AS score FROM u2 u, v2 v, m ANTI JOIN ratings x ON x."user" = u.id AND x.item = v.id)
    SELECT "user", item, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS rank FROM t) AS k WHERE rank <= 5"""


def _least_squares(weight: str):
    w = f" * {weight}" if weight else ""
    gather = lambda side: [f"p.f0 * p.f0{w}", f"p.f0 * p.f1{w}", f"p.f1 * p.f1{w}", f"rating * p.f0{w}", f"rating * p.f1{w}"]
    a, c, det = "(s0 + 0.05e0)", "(s2 + 0.05e0)", "((s0 + 0.05e0) * (s2 + 0.05e0) - s1 * s1)"
    return gather, lambda side: [f"({c} * s3 - s1 * s4) / {det}", f"({a} * s4 - s1 * s3) / {det}"]


def _coordinate():
    gather, _ = _least_squares("")
    x0 = "(o.f0 + (s3 - ((s0 + 0.05e0) * o.f0 + s1 * o.f1)) / (s0 + 0.05e0))"
    return gather, lambda side: [x0, f"o.f1 + (s4 - (s1 * {x0} + (s2 + 0.05e0) * o.f1)) / (s2 + 0.05e0)"]


def _gradient(predict: str, width: int, scale: str = ""):
    def gather(side):
        p = predict.format(u="o" if side == 0 else "p", v="p" if side == 0 else "o")
        e = f"(rating - ({p})){scale}"
        return [f"{e} * p.f{j}" for j in range(2)] + ([e] if width > 2 else [])

    return gather, lambda side: [f"o.f{j} + 0.02e0 * (s{j} / sqrt(n) - 0.05e0 * o.f{j})" for j in range(width)]


DOT = "{u}.f0 * {v}.f0 + {u}.f1 * {v}.f1"
BIASED = "mean + {u}.f2 + {v}.f2 + " + DOT
LOGISTIC = "60 / (1 + exp(-({u}.f2 + {v}.f2 + " + DOT + ")))"
IMPLICIT = "mean + {u}.f7 + {v}.f4 + ({u}.f0 + {u}.f2) * {v}.f0 + ({u}.f1 + {u}.f3) * {v}.f1"


def _nonnegative():
    gather = lambda side: ["p.f0 * rating", "p.f1 * rating", "p.f0 * (o.f0 * p.f0 + o.f1 * p.f1)", "p.f1 * (o.f0 * p.f0 + o.f1 * p.f1)"]
    return gather, lambda side: [f"greatest(o.f{j} * s{j} / greatest(s{j + 2}, 1e-9), 1e-9)" for j in range(2)]


def _implicit():
    def gather(side):
        if side == 0:
            e = f"(rating - ({IMPLICIT.format(u='o', v='p')}))"
            return [f"{e} * p.f0", f"{e} * p.f1", "p.f2", "p.f3", e]
        e = f"(rating - ({IMPLICIT.format(u='p', v='o')}))"
        return [f"{e} * (p.f0 + p.f2)", f"{e} * (p.f1 + p.f3)", "p.f4", "p.f5", e, "p.f6"]

    def apply(side):
        step = lambda j, s: f"o.f{j} + 0.02e0 * (({s}) / sqrt(n) - 0.05e0 * o.f{j})"
        if side == 0:
            return [step(0, "s0"), step(1, "s1"), "s2 / sqrt(n)", "s3 / sqrt(n)", "s0 / sqrt(n)", "s1 / sqrt(n)", "CAST(n AS DOUBLE)", step(7, "s4")]
        return [step(0, "s0"), step(1, "s1"), step(2, "s2 * n / greatest(s5, 1)"), step(3, "s3 * n / greatest(s5, 1)"), step(4, "s4")]

    return gather, apply


SMALL = {
    "als": (M.LeastSquares, _least_squares(""), DOT, (2, 2), (2, 2)),
    "wals": (M.WeightedLeastSquares, _least_squares("weight"), DOT, (2, 2), (2, 2)),
    "als_coord": (M.CoordinateDescent, _coordinate(), DOT, (2, 2), (2, 2)),
    "nmf": (M.Nonnegative, _nonnegative(), DOT, (2, 2), (2, 2)),
    "sgd": (M.Gradient, _gradient(DOT, 2), DOT, (2, 2), (2, 2)),
    "bias_sgd": (M.BiasedGradient, _gradient(BIASED, 3), BIASED, (3, 3), (3, 3)),
    "bias_sgd2": (M.LogisticGradient, _gradient(LOGISTIC, 3, " / 60"), LOGISTIC, (3, 3), (3, 3)),
    "svdpp": (M.ImplicitGradient, _implicit(), IMPLICIT, (8, 5), (2, 4)),
}


def _small_losses(cls):
    return _losses(lambda: _plain(cls)(size=2))


def _small_top(cls):
    def run(spark, sf_dir):
        r = Stored(_ratings(spark, sf_dir)).df
        return M.top_items(M.fit(r, _plain(cls)(size=2), 2), r, 5).withColumn("score", F.round("score", 4))

    return run


for _name, (_cls, _steps, _predict, _widths, _filled) in SMALL.items():
    QUERIES[f"{_name}_size2"] = _small_losses(_cls)
    SQL[f"{_name}_size2"] = _fit_sql(*_steps, _widths, _filled) + _loss_sql(_predict)
for _name in ("als", "bias_sgd", "svdpp"):
    _cls, _steps, _predict, _widths, _filled = SMALL[_name]
    QUERIES[f"{_name}_size2_top"] = _small_top(_cls)
    SQL[f"{_name}_size2_top"] = _fit_sql(*_steps, _widths, _filled) + _top_sql(_predict)


def _tensor_sql(steps: int = 2) -> str:
    """ALS with a third side: each side's normal equations over the product of the other two factors."""
    keys = ('"user"', "item", "time")
    parts = ['r AS (SELECT *, "user" % 4 AS time FROM ratings)']
    for side, name in enumerate("uvt"):
        parts.append(f"{name}0 AS (SELECT id, {_start_sql(side, 2, 2)} FROM (SELECT DISTINCT {keys[side]} AS id FROM r) AS d)")
    now = [f"{name}0" for name in "uvt"]
    x = [f"(p.f{j} * q.f{j})" for j in range(2)]
    gather = [f"{x[0]} * {x[0]}", f"{x[0]} * {x[1]}", f"{x[1]} * {x[1]}", f"rating * {x[0]}", f"rating * {x[1]}"]
    apply = _least_squares("")[1](0)
    for i in range(1, steps + 1):
        for side, name in enumerate("uvt"):
            a, b = (k for k in range(3) if k != side)
            sums = ", ".join(f"sum({e}) AS s{j}" for j, e in enumerate(gather))
            parts.append(f"s{name}{i} AS (SELECT r.{keys[side]} AS id, {sums} FROM r JOIN {now[a]} p ON p.id = r.{keys[a]} JOIN {now[b]} q ON q.id = r.{keys[b]} GROUP BY 1)")
            now[side] = f"{name}{i}"
            parts.append(f"{now[side]} AS (SELECT id, {', '.join(f'{e} AS f{j}' for j, e in enumerate(apply))} FROM s{name}{i})")
    predict = " + ".join(f"u.f{j} * v.f{j} * t.f{j}" for j in range(2))
    return f"""WITH {RATINGS.strip()}, {", ".join(parts)}, e AS (SELECT rating - greatest(least({predict}, 200.0), 0.0) AS e FROM r JOIN {now[0]} u ON u.id = r."user" JOIN {now[1]} v ON v.id = item JOIN {now[2]} t ON t.id = r.time)
    SELECT round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, count(*) AS n FROM e"""


QUERIES["als_tensor_size2"] = _small_losses(M.TensorLeastSquares)
SQL["als_tensor_size2"] = _tensor_sql()
