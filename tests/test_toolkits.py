"""Similarity, factor models, parsers, tables, flows, formats and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import hashes as H
from tessera.operators import algorithms as L
from tessera.operators import etl as E
from tessera.operators import factors as M
from tessera.operators import flows as W
from tessera.operators import machines as Z
from tessera.operators import similarity as S
from tessera.operators import tables as T
from tessera.sources import generators as N
from tessera.sources import packets as K
from tessera.sources import readers as R
from tessera.streaming import edges as X


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_weighted_jaccard_golden(spark):
    edges = spark.createDataFrame([(2, 1, 2.0), (3, 1, 1.0), (5, 4, 3.0), (7, 6, 1.0)], "src long, dst long, weight double")
    assert {(i, j): round(s, 4) for i, j, s in rows(S.weighted_jaccard(edges))} == {(1, 2): 0.6667, (1, 3): 0.3333, (4, 5): 1.0, (6, 7): 1.0}


def test_average_precision_and_reciprocal_rank(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "user long, item long, rank int")
    relevant = spark.createDataFrame([(1, 10), (1, 12), (2, 99)], "user long, item long")
    assert dict(rows(S.average_precision(ranked, relevant, 3))) == pytest.approx({1: (1 + 2 / 3) / 2, 2: 0.0})
    assert dict(rows(S.reciprocal_rank(ranked, relevant))) == {1: 1.0, 2: 0.0}


def test_jaccard_and_log_likelihood_by_hand(spark):
    r = spark.createDataFrame([(u, i, 1.0) for u, i in [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 3), (1, 3)]], "user long, item long, rating double")
    assert {(i, j): s for i, j, s in rows(S.similarity(r, "jaccard"))} == pytest.approx({(1, 2): 2 / 3, (1, 3): 1 / 4, (2, 3): 1 / 3})
    assert all(0 <= s < 1 for _, _, s in rows(S.similarity(r, "log_likelihood", users=4)))


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(1)
    u, v = rng.random((30, 3)) + 0.2, rng.random((25, 3)) + 0.2
    data = [(i, j, float(20 * u[i] @ v[j]), 1.0 + i % 2, i % 4) for i in range(30) for j in range(25) if rng.random() < 0.6]
    return spark.createDataFrame(data, "user long, item long, rating double, weight double, time long").cache()


MODELS = [M.LeastSquares, M.WeightedLeastSquares, M.CoordinateDescent, M.SparseLeastSquares, M.TensorLeastSquares, M.Nonnegative, M.SampledFactors]


@pytest.mark.parametrize("model", MODELS)
def test_solvers_beat_the_mean(planted, model):
    m = model(size=5 if model is not M.SparseLeastSquares else 6)
    got = S.losses(M.fit(planted, m, 3).predict(planted)).first()
    mean = S.losses(S.baseline(planted)).first()
    assert got["n"] == planted.count() and got["rmse"] < 0.8 * mean["rmse"]


@pytest.mark.parametrize("model", [M.BiasedGradient, M.ImplicitGradient, M.TimeGradient])
def test_gradient_models_improve(planted, model):
    early, late = (S.losses(M.fit(planted, model(size=3, rate=0.03), k).predict(planted)).first()["rmse"] for k in (1, 4))
    assert late < early


def test_top_items_skip_what_was_rated(spark, planted):
    fitted = M.fit(planted, M.LeastSquares(size=4), 2)
    top = M.top_items(fitted, planted, 3)
    assert top.join(planted, ["user", "item"]).count() == 0
    assert top.groupBy("user").count().filter("count > 3").count() == 0


def test_singular_values_match_numpy(spark, planted):
    p = planted.toPandas()
    a = np.zeros((30, 25))
    a[p.user, p.item] = p.rating
    assert M.svd(planted, 3, iterations=8).values == pytest.approx(np.linalg.svd(a)[1][:3], rel=1e-4)


def test_cosamp_golden():
    a = np.array([[0.9528, 0.5982, 0.8368], [0.7041, 0.8407, 0.5187], [0.9539, 0.4428, 0.0222]])
    x = M.cosamp(a, np.array([0.3759, 0.8986, 0.4290]), 1)
    assert np.flatnonzero(x).tolist() == [1] and x[1] == pytest.approx(1.2032, abs=1e-4)


def test_tokens_and_dictionary(spark):
    docs = spark.createDataFrame([(1, "A bb, c DD! bb"), (2, None), (3, "")], "id long, text string")
    assert rows(E.bag_of_words(docs, "id", "text")) == [(1, "a", 1), (1, "bb", 2), (1, "dd", 1)]
    assert rows(E.dictionary(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "v string"), "v")) == [("a", 0), ("b", 1)]


def test_ips_calls_and_tweets(spark):
    ips = spark.createDataFrame([("1.2.3.4",), ("1.2.3.999",), ("x",), (None,)], "ip string")
    assert [r[0] for r in ips.select(E.ip_to_long(F.col("ip"))).collect()] == [16909060, None, None, None]
    lines = spark.createDataFrame([("2012-01-02 03:04:05\t7 8 0 60",), ("bad",)], "value string")
    assert rows(E.call_records(lines)) == [(7, 8, 1325473445, 60)]
    text = ["T 2009-06-01 21:43:59", "U http://twitter.com/Ann", "W hello @Bob and @carl", "T 2009-06-01 21:44:00", "U http://twitter.com/bob", "W RT @ann hi"]
    got = rows(E.tweets(spark.createDataFrame(list(enumerate(text)), "n long, value string")).select("user", "other", "kind"))
    assert got == [("ann", "bob", 1), ("ann", "carl", 1), ("bob", "ann", 2)]


def test_longest_prefix_wins(spark):
    rules = spark.createDataFrame([(0x0A000000, 8, 1), (0x0A010000, 16, 2), (0x0A010203, 32, 3)], "prefix long, depth int, next_hop int")
    ips = spark.createDataFrame([(0x0A020000,), (0x0A010000,), (0x0A010203,), (0x0B000000,)], "ip long")
    assert {r.ip: r.next_hop for r in T.lpm_lookup(ips, rules, "ip").collect()} == {0x0A020000: 1, 0x0A010000: 2, 0x0A010203: 3, 0x0B000000: None}
    six = spark.createDataFrame([("1" * 8 + "0" * 120, 8, 1), ("1" * 16 + "0" * 112, 12, 2)], "prefix string, depth int, next_hop int")
    assert [r.next_hop for r in T.lpm6_lookup(spark.createDataFrame([("1" * 128,)], "bits string"), six, "bits").collect()] == [2]


def test_acl_priority_and_many_rules(spark):
    x = spark.createDataFrame([(5,), (50,), (500,)], "v long")
    rules = [T.AclRule({"v": ("range", 0, 100)}, 1, 7), T.AclRule({"v": ("range", 40, 60)}, 2, 8)]
    assert [r.class_0 for r in T.acl_classify(x, rules).collect()] == [7, 8, 0]
    many = [T.AclRule({"v": ("range", 1000 + i, 1000 + i)}, 1, 9) for i in range(T.RULES + 5)] + [T.AclRule({"v": ("range", 0, 1000)}, 3, 4)]
    assert [r.class_0 for r in T.acl_classify(x, [*rules, *many]).collect()] == [4, 4, 4]


def test_meters_by_hand(spark):
    p = spark.createDataFrame([(1, 1, 0, 60, 0), (2, 1, 10, 60, 0), (3, 1, 20, 60, 0), (4, 1, 100, 50, 0), (5, 2, 0, 60, 2)], "event_id long, flow long, time long, len long, colour int")
    blind = {r.event_id: r.new_colour for r in W.meter(p, lambda: W.SingleRate(50, 100, 100, 70)).collect()}
    # 60 of 100 green; then 40 left: 60 of 70 yellow; then red; 50 more at 100: green
    assert blind == {1: 0, 2: 1, 3: 2, 4: 0, 5: 0}
    aware = {r.event_id: r.new_colour for r in W.meter(p, lambda: W.SingleRate(50, 100, 100, 70, True)).collect()}
    assert aware[5] == 2
    two = {r.event_id: r.new_colour for r in W.meter(p, lambda: W.TwoRate(50, 100, 50, 100, 100, 130)).collect()}
    assert two == {1: 0, 2: 1, 3: 2, 4: 0, 5: 0}


def test_reorder_window(spark):
    p = spark.createDataFrame([(1, 1, 10), (2, 1, 12), (3, 1, 17), (4, 1, 9), (5, 1, 100)], "event_id long, flow long, seq long")
    assert {r.event_id: r.outcome for r in W.reorder(p, 4).collect()} == {1: "kept", 2: "kept", 3: "moved", 4: "range", 5: "range"}


def test_fragments_round_trip_and_gaps(spark):
    p = spark.createDataFrame([(1, 100), (2, 0), (3, 16)], "event_id long, len long")
    pieces = W.fragment(p, 16)
    assert rows(W.reassemble(pieces)) == [(1, 100, True), (2, 0, True), (3, 16, True)]
    assert dict((r.event_id, r.complete) for r in W.reassemble(pieces.filter("not (event_id = 1 and offset = 16)")).collect())[1] is False


def test_rational_approximation():
    assert W.approximate(0.5, 1e-3) == (1, 2)
    p, q = W.approximate(0.3183098, 1e-5)
    assert abs(0.3183098 - p / q) < 1e-5


def test_hashes(spark):
    key = bytes.fromhex("6d5a56da255b0ec24167253d43a38fb0d0ca2bcbae7b30b477cb2da38030f20c6a42b73bbeac01fa")
    flow = spark.createDataFrame([(0x420995BB, 0xA18E6450, 2794, 1766)], "a long, b long, c long, d long")
    assert flow.select(H.toeplitz(key, *[F.col(x) for x in "abcd"])).first()[0] == 0x51CCC178
    assert spark.createDataFrame([("123456789",)], "s string").select(H.crc32c(F.col("s"))).first()[0] == 0xE3069283


def test_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    assert rows(R.read_graph(spark, put("e", "# c\n1 2 0.5\n2\t3\n4,4,1\n"), "edgelist", value_type="double")) == [(1, 2, 0.5), (2, 3, 0.0)]
    assert rows(R.multi_value_edge_list(spark, put("m", "1 2 1:2:3\n"))) == [(1, 2, [1.0, 2.0, 3.0])]
    assert rows(R.adjacency_list(spark, put("a", "1 2 5 6\n2 0\n"))) == [(1, 5), (1, 6)]
    assert rows(R.metis(spark, put("t", "3 2\n2 3\n1\n1\n"))) == [(1, 2), (1, 3)]
    assert rows(R.cassovary(spark, put("v", "1 2\n2\n3\n2 1\n1\n"))) == [(1, 2), (1, 3), (2, 1)]
    assert rows(R.matrix_market(spark, put("x", "%%MatrixMarket\n% c\n2 2 2\n1 1 3.5\n2 1 4\n"))) == [(1, 1, 3.5), (2, 1, 4.0)]
    four = "%%MatrixMarket matrix coordinate real general\n2\n2\n3\n1\n1\n7\n3.5\n1\n2\n8\n2\n2\n2\n9\n5\n"
    assert rows(R.matrix_market(spark, put("w", four), ("user", "item", "time", "rating"))) == [(1, 1, 7.0, 3.5), (1, 2, 8.0, 2.0), (2, 2, 9.0, 5.0)]
    symmetric = "%%MatrixMarket matrix coordinate pattern symmetric\n3 3 2\n1 1\n3 1\n"
    assert rows(R.matrix_market(spark, put("y", symmetric))) == [(1, 1, 1.0), (1, 3, 1.0), (3, 1, 1.0)]
    with pytest.raises(ValueError):
        R.matrix_market(spark, put("z", "%%MatrixMarket matrix coordinate real general\n2 2 1\n3 1 1\n"))
    with pytest.raises(ValueError):
        R.matrix_market(spark, put("u", "%%MatrixMarket matrix coordinate complex general\n2 2 1\n1 1 1 0\n"))
    dense = "%%MatrixMarket matrix array real general\n3 2\n1\n2\n3\n4\n5\n6\n"
    assert rows(R.matrix_market_array(spark, put("d", dense))) == [(1, [1.0, 4.0]), (2, [2.0, 5.0]), (3, [3.0, 6.0])]
    written = spark.createDataFrame([(1, 2, 0.5), (3, 1, 2.0)], "user long, item long, rating double").repartition(3)
    R.write_matrix_market(written, str(tmp_path / "mm"), 3, 2)
    assert rows(R.matrix_market(spark, str(tmp_path / "mm"))) == [(1, 2, 0.5), (3, 1, 2.0)]
    R.write_vectors(spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 4.0])], "id long, f array<double>"), str(tmp_path / "vec"), 2)
    assert rows(R.read_vectors(spark, str(tmp_path / "vec"))) == [(1, [1.0, 0.0]), (2, [3.0, 4.0])]
    for _ in range(2):
        assert rows(R.converted(spark, str(tmp_path / "a"), "adjlist", str(tmp_path / "cache"))) == [(1, 5), (1, 6)]
    assert rows(R.up_to(spark.read.parquet(str(tmp_path / "cache")), 5)) == [(1, 5)]
    np.array([(1, 2, 0.5), (3, 3, 1)], [("s", "<u4"), ("d", "<u4"), ("v", "<f4")]).tofile(tmp_path / "b")
    assert rows(R.binary_edge_list(spark, str(tmp_path / "b"), "<f4")) == [(1, 2, 0.5)]
    with pytest.raises(ValueError):
        R.read_graph(spark, "x", "nothing")


def test_generators(spark):
    g = N.erdos_renyi(spark, 60, 0.2, 3)
    assert 250 < g.count() < 460 and g.filter("src = dst or src >= 60 or dst >= 60 or src < 0 or dst < 0").count() == 0
    assert N.erdos_renyi(spark, 20, 1.1).select(F.least("src", "dst"), F.greatest("src", "dst")).distinct().count() == 190
    k = N.kronecker(spark, 6, 4)
    assert k.count() == 256 and k.filter("src >= 64 or dst >= 64").count() == 0 and rows(k) == rows(N.kronecker(spark, 6, 4))


def test_streamed_edges_are_committed_once(spark, tmp_path):
    spark.createDataFrame([(1, 2), (2, 2), (2, 3)], "src long, dst long").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("src long, dst long").parquet(str(tmp_path / "in"))
    graph, seen = X.EvolvingGraph(spark, str(tmp_path / "g")), []
    graph.follow(stream(), lambda batch, n: seen.append(n))
    graph.follow(stream())
    assert rows(graph.compact()) == [(1, 2), (2, 3)] and seen == [0]
    assert rows(X.run_to_end(X.degree_stream(stream()), "complete", str(tmp_path / "c"))) == [(1, 1), (2, 2), (3, 1)]


def test_deletions_and_compaction(spark, tmp_path):
    schema = "src long, dst long, op string"
    feed = lambda *edges: spark.createDataFrame(list(edges), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    graph = X.EvolvingGraph(spark, str(tmp_path / "g"), buffer_edges=100, delete_share=0.9)
    feed((1, 2, "add"), (2, 3, "add"), (3, 4, "add"))
    graph.follow(stream())
    feed((2, 3, "delete"), (4, 5, "add"))
    graph.follow(stream())
    left = [(1, 2), (3, 4), (4, 5)]
    assert rows(graph.edges()) == left and not graph.due()
    assert rows(graph.degrees()) == [(1, 1), (2, 1), (3, 1), (4, 2), (5, 1)]
    assert rows(graph.compact()) == left and graph._numbers("delta") == [] and graph._numbers("deleted") == [] and len(graph._numbers("base")) == 1
    feed((2, 3, "add"), (1, 2, "delete"))
    graph.follow(stream())
    assert rows(graph.edges()) == [(2, 3), (3, 4), (4, 5)]
    graph.delete_share = 0.2
    assert graph.due()
    assert rows(graph.compact()) == [(2, 3), (3, 4), (4, 5)] and len(graph._numbers("base")) == 1


def test_machine_and_cold_start(spark, planted):
    from tessera.operators.machines import Machine, sparse_rows

    m = Machine(["user", "item"], ["weight"], features=256, steps=60, cold_start="item").fit(planted)
    assert S.losses(m.predict(planted)).first()["rmse"] < S.losses(S.baseline(planted)).first()["rmse"]
    new = spark.createDataFrame([(999, 3, 1.0), (999, 777, 1.0)], "user long, item long, weight double")
    got = {r.item: r.prediction for r in m.predict(new).collect()}
    assert got[3] == pytest.approx(planted.filter("item = 3").agg(F.avg("rating")).first()[0]) and got[777] == pytest.approx(m.mean)
    assert rows(sparse_rows(spark.createDataFrame([("1 3:0.5 7:2",)], "value string")).selectExpr("label", "features[7]")) == [(1.0, 2.0)]


def test_lru_bucket_evicts_the_oldest(spark):
    p = spark.createDataFrame([(i, f) for i, f in enumerate([1, 2, 1, 3, 2, 1])], "event_id long, flow long")
    got = {r.event_id: r.hit for r in W.lru_lookup(p, 1, 2).collect()}
    assert got == {0: False, 1: False, 2: True, 3: False, 4: False, 5: False}


def test_vector_functions(spark):
    from tessera.functions import vectors as V

    df = spark.createDataFrame([([3.0, 1.0, 2.0], [1.0, 0.5, 2.0], {1: 2.0, 5: 1.0}, {5: 4.0})], "a array<double>, b array<double>, m map<long,double>, n map<long,double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(V.dot(a, b), V.norm(a), V.abs_sum(V.subtract(a, b)), V.running_sum(a), V.sort_index(a), V.sort_index(a, True), V.head(a, 2), V.tail(a, 2), V.middle(a, 1, 1),
                    V.remove_at(a, 0), V.sparse_dot(F.col("m"), F.col("n")), V.clamp(F.lit(9.0), 0, 5), V.safe_log(F.lit(0.0)), V.dot3(a, b, b), V.outer(a, b)[0]).first()
    assert list(got) == [7.5, pytest.approx(14**0.5), 2.5, [3.0, 4.0, 6.0], [1, 2, 0], [0, 2, 1], [3.0, 1.0], [1.0, 2.0], [1.0], [1.0, 2.0], 4.0, 5.0, 0.0, 11.25, [3.0, 1.5, 6.0]]


def test_metrics():
    from tessera.metrics import Metrics

    m = Metrics("run")
    m.add("n")
    m.add("n", 2)
    m.set_entry("v", 2, 5)
    with m.timed("t"):
        pass
    assert m.values["n"] == 3 and m.values["v"] == [0, 0, 5] and m.values["t"]["count"] == 1
    assert "n = 3" in m.as_text() and "<table>" in m.as_html() and '"n": 3' in m.as_json()


def test_rank_model_ascends_the_pairwise_objective(spark, planted, monkeypatch):
    model = M.RankGradient(size=3)
    model.threshold = 9.0
    few = planted.filter("user <> 1").union(planted.filter("user = 1").orderBy("item").limit(3).withColumn("rating", F.when(F.col("item") < 0, 20.0).otherwise(1.0)))
    (start, relevant), (end, _) = M.fit_rank(few, model, 0), M.fit_rank(few, model, 2)
    p = few.toPandas().query("rating >= 9")
    want = p.groupby("user").filter(lambda x: len(x) > 1)
    assert rows(relevant.select("user", "item")) == sorted(zip(want.user, want.item)) and M.rank_objective(end, relevant) > M.rank_objective(start, relevant)
    u, v = ({r.id: np.array(r.f) for r in side.collect()} for side in (start.users, start.items))
    assert dict((r.id, r.f) for r in end.users.collect())[1] == u[1].tolist()

    def objective(u, v):
        total = 0.0
        for user, of in want.groupby("user"):
            f = np.array([u[user] @ v[i] for i in of.item])
            total += -np.logaddexp(0, -f).sum() - np.logaddexp(0, f[None] - f[:, None]).sum() - model.regularization / 2 * u[user] @ u[user]
        return total - model.regularization / 2 * sum(x @ x for x in v.values())

    assert M.rank_objective(start, relevant) == pytest.approx(objective(u, v))
    whole = {(r.user, r.item): r.slope for r in M._rank_terms(relevant, start.users, start.items).collect()}
    monkeypatch.setattr(M, "PART", 4)
    parts = {(r.user, r.item): r.slope for r in M._rank_terms(relevant, start.users, start.items).collect()}
    assert parts == pytest.approx(whole)
    user, item = next(iter(whole))
    for side, key, slope in ((u, user, sum(c * v[i] for (x, i), c in whole.items() if x == user)), (v, item, sum(c * u[x] for (x, i), c in whole.items() if i == item))):
        for d in range(3):
            step = 1e-5 * np.eye(3)[d]
            up, down = ({**side, key: side[key] + s} for s in (step, -step))
            found = (objective(up, v) - objective(down, v) if side is u else objective(u, up) - objective(u, down)) / 2e-5
            assert found == pytest.approx(slope[d] - model.regularization * side[key][d], rel=1e-4, abs=1e-6)


def test_sampled_factors_discard_and_average(planted):
    model = M.SampledFactors(size=2)
    model.burn_in = 2
    fitted = M.fit(planted, model, 3)
    assert {len(r.f) for side in (fitted.users, fitted.items) for r in side.collect()} == {3 * 2}
    assert model.predict(np.array([[1.0, 0, 0, 2]]), np.array([[3.0, 0, 0, 4]]), None, 0.0).tolist() == [(3 + 8) / 2]
    draws = [model.hyper(4000, np.full(2, 8000.0), 4000 * (np.full((2, 2), 4.0) + np.diag([0.25, 1.0])), np.random.default_rng(i)) for i in range(30)]
    assert np.mean([m for m, _ in draws], axis=0) == pytest.approx([2, 2], abs=0.02)
    assert np.mean([p for _, p in draws], axis=0) == pytest.approx(np.diag([4.0, 1.0]), abs=0.1) and np.std([p[0, 0] for _, p in draws]) > 0


@pytest.mark.parametrize("model", [M.TensorLeastSquares(size=2), M.TimeGradient(size=2)])
def test_every_time_value_is_fitted(spark, model):
    rng = np.random.default_rng(4)
    u, v, w = rng.random(20) + 0.5, rng.random(15) + 0.5, [1.0, 4.0]
    data = [(i, j, float(u[i] * v[j] * w[t]), 8 * t) for i in range(20) for j in range(15) for t in (0, 1)]
    df = spark.createDataFrame(data, "user long, item long, rating double, time long")
    fitted = M.fit(df, model, 4)
    got = fitted.predict(df).toPandas().groupby("time").prediction.mean()
    assert got[8] > (3 if isinstance(model, M.TensorLeastSquares) else 1) * got[0] and [r.id for r in fitted.times.orderBy("id").collect()] == [0, 8]


def test_time_gradient_is_the_slope_of_the_error():
    model, rng = M.TimeGradient(size=2), np.random.default_rng(2)
    sides = [rng.random((1, n)) for n in (12, 5, 4)]
    import pandas as pd

    row = pd.DataFrame({"rating": [3.0]})
    for side, entries in ((0, [0, 1, 2, 3, 4, 5, 11]), (1, [0, 1, 4]), (2, [0, 1, 2, 3])):
        slope = model.gather_of(sides, row, 0.5, side)[0]
        for k in entries:
            loss = []
            for step in (1e-5, -1e-5):
                near = [f.copy() for f in sides]
                near[side][0, k] += step
                loss.append(-((3.0 - model.predict_of(near, row, 0.5)[0]) ** 2) / 2)
            assert (loss[0] - loss[1]) / 2e-5 == pytest.approx(slope[k], rel=1e-4)


def test_machine_has_a_slot_for_every_value_and_the_last_item(spark):
    from tessera.operators.machines import Machine, with_last_item

    df = spark.createDataFrame([(i, i % 7, float(i % 7), i % 3) for i in range(6000)], "user long, item long, rating double, time long")
    m = Machine(["user", "item", "time"], [], steps=1).fit(df)
    assert m.model.linear.size == 6000 + 7 + 3
    unseen = spark.createDataFrame([(-1, 3, 1)], "user long, item long, time long")
    assert m._encoded(unseen).first()["_features"].numNonzeros() == 2 and m.predict(unseen).count() == 1
    few = spark.createDataFrame([(1, 5, 1), (1, 4, 2), (1, 3, 2), (2, 9, 0)], "user long, item long, time long")
    assert rows(with_last_item(few).select("user", "last_item").distinct()) == [(1, 4), (2, 9)]


def test_machine_keeps_weights_off_the_driver(spark, monkeypatch):
    import numpy as np
    from pyspark.ml.feature import StringIndexer
    from tessera.operators import slots
    from tessera.operators.machines import Machine

    def never(*_):
        raise AssertionError("every value would come to the driver")

    monkeypatch.setattr(StringIndexer, "_fit", never)
    monkeypatch.setattr(slots, "TASK", 400), monkeypatch.setattr(slots, "HOME", 20)
    rng = np.random.default_rng(3)
    data = [(int(rng.integers(90)) if i % 50 else None, f"i{rng.integers(40)}", float(rng.normal()), float(rng.normal())) for i in range(3000)]
    df = spark.createDataFrame([(u, v, (u or 0) % 5 + int(v[1:]) % 3 + y, x) for u, v, x, y in data], "user long, item string, rating double, weight double")
    m = Machine(["user", "item"], ["weight"], steps=3).fit(df)
    values = [sorted({(c, r[c]) for r in data}, key=str) for c in range(2)]
    assert m.model.linear.size == sum(map(len, values)) + 1
    # the same steps on dense rows
    at = {v: i for i, v in enumerate(values[0] + values[1])}
    x = np.zeros((len(data), len(at) + 1))
    for i, r in enumerate(data):
        x[i, [at[0, r[0]], at[1, r[1]]]] = 1
        x[i, -1] = r[2]
    y = np.array([r.rating for r in df.collect()])
    x[:, -1] = [r.weight for r in df.collect()]
    mean, deviation = y.mean(), y.std(ddof=1)
    names = sorted({r[1] for r in data})
    codes = np.array([c + 2 * (v is None) for c, v in at])
    keys = np.array([0 if v is None else v if c == 0 else names.index(v) for c, v in at])
    w = np.vstack([slots._drawn(codes, keys, 4), slots._drawn(np.array([-1]), np.array([0]), 4)])
    w0, state, state0 = np.zeros(1), (np.zeros_like(w),) * 2, (np.zeros(1),) * 2

    def predict():
        s = x @ w[:, 1:]
        return w0 + x @ w[:, 0] + ((s * s).sum(1) - (x * x) @ (w[:, 1:] ** 2).sum(1)) / 2, s

    for step in range(1, 4):
        p, s = predict()
        e = 2 * (p - (y - mean) / deviation)
        g = np.column_stack([x.T @ e, x.T @ (e[:, None] * s) - ((x * x).T @ e)[:, None] * w[:, 1:]]) / len(y)
        w, *state = slots._adam(w, *state, g, step, 0.05, 0.01)
        w0, *state0 = slots._adam(w0, *state0, np.array([e.mean()]), step, 0.05, 0.01)
    got = m.predict(df).orderBy("weight").collect()
    want = (predict()[0] * deviation + mean)[np.argsort(x[:, -1])]
    assert np.allclose([r.prediction for r in got], want, atol=1e-4)
    m.cold_start = "item"
    new = spark.createDataFrame([(1, "i3", 0.0), (-5, "i3", 0.0), (-5, "none", 0.0), (None, "i3", 0.0)], "user long, item string, weight double")
    got = [r.prediction for r in m.predict(new.coalesce(1)).orderBy(F.col("user").desc_nulls_last(), "item").collect()]
    known = df.filter("item = 'i3'").agg(F.avg("rating")).first()[0]
    assert got[1:] == pytest.approx([known, m.mean, known]) and got[0] != pytest.approx(known)


def test_validation_halts_and_blocks_rank_alike(spark, planted):
    train, test = planted, planted.limit(40)
    fitted = M.fit(train, M.BiasedGradient(size=2, rate=0.05), 3, validation=test)
    assert 1 <= len(fitted.history) <= 3
    mad = M.fit(train, M.Gradient(size=2, rate=50.0), 4, validation=test)
    assert len(mad.history) < 4 or mad.history == sorted(mad.history, reverse=True)
    with pytest.raises(ValueError):
        M.fit(train.withColumn("rating", -F.col("rating") - 1), M.Nonnegative(size=2), 1)
    for model in (M.LeastSquares(size=2), M.BiasedGradient(size=2), M.ImplicitGradient(size=2), M.LogisticGradient(size=2), M.Boltzmann(size=2)):
        fitted = M.fit(train, model, 1)
        rated = train.limit(30)
        got = {(r.user, r.rank): (r.item, round(r.score, 6)) for r in M.top_items(fitted, rated, 3).collect()}
        seen = {(r.user, r.item) for r in rated.collect()}
        pairs = fitted.users.select(F.col("id").alias("user")).crossJoin(fitted.items.select(F.col("id").alias("item"))).withColumn("rating", F.lit(0.0))
        each = {}
        for r in fitted.predict(pairs).collect():
            if (r.user, r.item) not in seen:
                each.setdefault(r.user, []).append((-round(r.prediction, 6), r.item))
        assert got == {(u, k + 1): (i, -p) for u, x in each.items() for k, (p, i) in enumerate(sorted(x)[:3])}


def test_singular_vectors(spark, planted):
    a = np.zeros((200, 200))
    for r in planted.collect():
        a[r.user, r.item] = r.rating
    want = np.linalg.svd(a)[1][:2]
    for found in (M.svd(planted, 2, iterations=12), M.svd_one_sided(planted, 2, iterations=12)):
        assert found.values == pytest.approx(want, rel=1e-4) and (found.errors < 1e-2 * want[0]).all()
        u = {r.id: r.f for r in found.left.collect()}
        assert sum(f[0] ** 2 for f in u.values()) == pytest.approx(1, rel=1e-3)
    x = spark.createDataFrame([(i, 1.0) for i in range(200)], "id long, f double")
    got = {r.id: r.f for r in M.multiply(planted, x, x, c=2.0, d=1.0, div=4.0).collect()}
    assert got[0] == pytest.approx((2 * a[0].sum() + 1) / 4)


def test_reading_of_lists_and_pairs(spark, tmp_path):
    numbered = lambda *lines: spark.createDataFrame(list(enumerate(lines)), "n long, value string")
    assert rows(E.first_per_key(numbered("1 5 9", "1 2 8", "1 7 1", "2 3 4"), 2)) == [(1, [5, 2], [9.0, 8.0]), (2, [3], [4.0])]
    lines = spark.createDataFrame([(0, "x", "y"), (1, "y", "x"), (2, "z", "y")], "n long, a string, b string")
    out, found = E.first_seen_ids(lines, ["a", "b"])
    assert rows(out) == [(0, 1, 1), (1, 2, 2), (2, 3, 1)]
    out, found = E.first_seen_ids(lines, ["a", "b"], single_domain=True)
    assert rows(out) == [(0, 1, 2), (1, 2, 1), (2, 3, 2)]
    E.save_dictionary(found["all"], str(tmp_path / "ids"))
    assert rows(E.load_dictionary(spark, str(tmp_path / "ids"))) == [("x", 1), ("y", 2), ("z", 3)]
    edges, ids, size = E.adjacency_ids(numbered("b 2 a c", "a 1 c"))
    assert rows(edges) == [(1, 3), (2, 1), (2, 3)] and size == {"rows": 3, "columns": 3, "entries": 3}
    pairs, ids = E.ip_pairs(numbered("10.0.0.2 10.0.0.1 x", "10.0.0.1 10.0.0.1 y", "1.2.3 4 z"))
    assert rows(pairs) == [(0, 0, "y"), (1, 0, "x")]
    assert rows(E.tweets_per_user(numbered("T 1", "U http://t/Ann", "W a", "U http://t/ann", "U http://t/bob"))) == [("ann", 2), ("bob", 1)]
    trusts = spark.createDataFrame([(u, i) for u in range(5) for i in range(6)], "user long, item long")
    split = E.trust_split(trusts, popular=2, least=4, train=3)
    assert split.filter("item < 2").count() == 0 and rows(split.groupBy("user", "part").count().filter("part = 'train'").select("count").distinct()) == [(3,)]
    ini = numbered("[a]", "x = 1 ; one", "# no", "[b]", "x=2=3")
    assert rows(E.parse_ini(ini)) == [("a", "x", "1"), ("b", "x", "2=3")]
    assert spark.range(1).select(E.key_values(F.lit("a=1,b=2,c")).alias("m")).first().m == {"a": "1", "b": "2", "c": None}
    assert rows(E.merge_sorted(spark.createDataFrame([(1, 5)], "a int, b int"), spark.createDataFrame([(2, 7)], "a int, b int"), order=[F.desc("b")])) == [(1, 5), (2, 7)]
    np.array([[1, 2], [3, 3], [-1, 4]], "<i8").tofile(tmp_path / "pairs")
    assert rows(R.long_pairs(spark, str(tmp_path / "pairs"))) == [(1, 2)]


def test_packets_in_and_out(spark, tmp_path):
    p = K.synthetic(spark, 50, 5)
    assert p.count() == 50 and p.filter("len < 1 OR len > 1500 OR flow >= 5").count() == 0
    pieces = K.fragmented(K.ring(p.filter("flow < 2"), p.filter("flow >= 2")), 256)
    K.reassembled_to_table(pieces.filter("NOT (event_id = 3 AND offset = 0)"), str(tmp_path / "whole"))
    assert rows(K.stored(spark, str(tmp_path / "whole"), "event_id long, len long")) == [(r.event_id, r.len) for r in p.orderBy("event_id").collect() if r.event_id != 3]
    K.drop(p)
    K.to_table(p, str(tmp_path / "in"))
    K.stream_to_table(K.stored(spark, str(tmp_path / "in"), "event_id long, flow long, time long, len long", stream=True), str(tmp_path / "out"), str(tmp_path / "progress"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
    timed = spark.createDataFrame([("a", "b", 1, 0, 8, True, 0), ("a", "b", 1, 8, 4, False, 90), ("a", "c", 1, 0, 8, True, 0), ("a", "c", 1, 8, 4, False, 200)], "source string, target string, id int, offset long, size long, more boolean, time long")
    assert [r.complete for r in W.reassemble(timed, ["source", "target", "id"], timeout=100).orderBy("target").collect()] == [True, False]


def test_hierarchical_schedule(spark):
    shaping = W.Shaping(port_rate=1000.0, subport_rate=1000.0, subport_size=400.0, pipe_rate=500.0, pipe_size=200.0, class_bytes=(200.0, 200.0, 200.0, 200.0), period=1.0, queue_limit=3)
    made = [(i, 0, 0, i % 2, 3 - i % 4, 0, 0, 100) for i in range(8)] + [(8, 0, 0, 0, 0, 0, 0, 1000), *[(20 + i, 1, 0, 0, 0, 0, 0, 10) for i in range(5)]]
    p = spark.createDataFrame(made, "event_id long, port long, subport long, pipe long, class long, queue long, time long, len long")
    got = {r.event_id: r.sent for r in W.hierarchical_schedule(p, shaping).collect()}
    assert set(got) == {m[0] for m in made} and got[8] is None
    assert sum(got[20 + i] is None for i in range(5)) == 2  # beyond the queue's limit
    first = min(x for e, x in got.items() if x is not None and e < 8)
    assert first == 0.0
    for pipe in (0, 1):  # smaller classes of a pipe go first
        of = sorted((got[m[0]], m[4]) for m in made[:8] if m[3] == pipe)
        assert [c for _, c in of] == sorted(c for _, c in of)
    times = sorted(x for e, x in got.items() if x is not None and e < 8)
    assert all(b - a >= 0.1 - 1e-9 for a, b in zip(times, times[1:]))  # the port's rate
    assert times[-1] >= (400 - 200) / 500 - 0.1  # the pipes' rate


def test_timers_and_jobs(spark):
    t = spark.createDataFrame([("a", 0, 10), ("b", 5, None)], "timer string, start long, period long")
    assert rows(W.timer_expiries(t, 25)) == [("a", 0), ("a", 10), ("a", 20), ("b", 5)]
    runs = spark.createDataFrame([("j", 1.0, 10.0), ("j", 3.0, 10.0)], "job string, seconds double, period double")
    assert rows(W.job_stats(runs, target=1.0)) == [("j", 2, 4.0, 1.0, 2.0, 3.0, 5.0)]


def test_array_functions_and_draws(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    a = F.array(F.lit(1.0), F.lit(2.0))
    assert value(A.append(a, F.lit(3.0))) == [1, 2, 3] and value(A.put(a, 3, F.lit(9.0), F.lit(0.0))) == [1, 2, 0, 9] and value(A.drop_at(a, 0)) == [2]
    m = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))
    assert value(A.mat_vec(m, a)) == [5, 11] and value(A.transpose(m)) == [[1, 3], [2, 4]] and value(A.trace(m)) == 5
    assert value(A.outer(a, a)) == [[1, 2], [2, 4]] and value(A.determinant(m)) == pytest.approx(-2) and value(A.solve(m, a)) == pytest.approx([0, 0.5])
    assert value(A.json_field(F.lit('{"a":{"b":7}}'), "$.a.b", "int")) == 7
    draws = spark.range(20000).select(A.normal(1, "id").alias("n"), A.exponential(2, "id").alias("e"), A.chi_square(3, "id", freedom=3).alias("c"), A.gamma(F.lit(2.0), F.col("id")).alias("g"))
    r = draws.agg(F.avg("n"), F.stddev("n"), F.avg("e"), F.avg("c"), F.avg("g")).first()
    assert list(r) == pytest.approx([0, 1, 1, 3, 2], abs=0.08)
    rng = np.random.default_rng(0)
    assert np.mean([A.wishart(rng, 5, np.eye(2)) for _ in range(2000)], axis=0) == pytest.approx(5 * np.eye(2), abs=0.3)
    assert np.mean([A.multivariate_normal(rng, np.array([1.0, 2.0]), np.eye(2)) for _ in range(4000)], axis=0) == pytest.approx([1, 2], abs=0.1)


def test_jenkins(spark):
    def slow(a, b, c):
        m = 0xFFFFFFFF
        a, b, c = ((x + 0xDEADBEEF + 12) & m for x in (a, b, c))
        rot = lambda x, k: (x << k | x >> (32 - k)) & m
        c = ((c ^ b) - rot(b, 14)) & m
        a = ((a ^ c) - rot(c, 11)) & m
        b = ((b ^ a) - rot(a, 25)) & m
        c = ((c ^ b) - rot(b, 16)) & m
        a = ((a ^ c) - rot(c, 4)) & m
        b = ((b ^ a) - rot(a, 14)) & m
        return ((c ^ b) - rot(b, 24)) & m

    x = [(1, 2, 3), (0, 0, 0), (0xFFFFFFFF, 5, 77)]
    got = spark.createDataFrame(x, "a long, b long, c long").select(H.jenkins(F.col("a"), F.col("b"), F.col("c")).alias("h")).collect()
    assert [r.h for r in got] == [slow(*y) for y in x]


def test_coem(spark):
    pairs = spark.createDataFrame([("p", "c1", 2), ("q", "c1", 1), ("q", "c2", 1), ("n", "c2", 3)], "phrase string, context string, count long")
    seeds = spark.createDataFrame([("p", 1.0), ("n", 0.0)], "phrase string, p double")
    got = {(r.side, r.id): r.p for r in L.coem(pairs, seeds, 1, tf_idf=False).collect()}
    c1, c2 = (2 + 0.5) / 3, 0.5 / 4
    q = (c1 + c2) / 2
    assert got["phrase", "q"] == pytest.approx(q) and got["phrase", "p"] == 1 and got["context", "c1"] == pytest.approx((2 + q) / 3)


def test_features_links_and_sparse_vectors(spark, tmp_path):
    r = spark.createDataFrame([(1, 5, 2.0), (2, 5, 4.0), (2, 6, 6.0)], "user long, item long, rating double")
    out = Z.with_features(r, spark.createDataFrame([(1, 30)], "user long, age int"), spark.createDataFrame([(5, "a")], "item long, kind string"))
    assert sorted((x.user, x.item, x.age or 0, x.kind or "") for x in out.collect()) == [(1, 5, 30, "a"), (2, 5, 0, "a"), (2, 6, 0, "")]
    linked = Z.with_links(r, spark.createDataFrame([(1, 2), (1, 2), (1, 9)], "src long, dst long"))
    assert {(x.user, x.links, x.linked_mean) for x in linked.collect()} == {(1, 2, 5.0), (2, 0, None)}
    assert [x.rating for x in Z.cut_off(r, 4.0).orderBy("rating").collect()] == [0, 1, 1]
    lines = spark.createDataFrame([("1.5 0:2 7:0.5",), ("2.0 3:1",), ("0.5 1:1",)], "value string")
    vectors = Z.sparse_vectors(Z.sparse_rows(lines), str(tmp_path / "v"))
    assert sorted((x.label, x.features.size, x.features.toArray().nonzero()[0].tolist()) for x in vectors.collect()) == [(0.5, 8, [1]), (1.5, 8, [0, 7]), (2.0, 8, [3])]
    assert Z.fit_sparse(vectors, steps=2).transform(vectors).filter("prediction IS NOT NULL").count() == 3


def test_top_items_score_only_what_may_matter(spark, tmp_path, monkeypatch):
    """Against all pairs, with equal items among them; before, every pair was scored."""

    class Counting(M.LeastSquares):
        def scores(self, users, items, mean):
            with open(tmp_path / "pairs", "ab") as f:
                f.write(b"%d\n" % (len(users) * len(items)))
            return super().scores(users, items, mean)

    monkeypatch.setattr(M, "BLOCK", 100)
    monkeypatch.setattr(M, "CELL", 20)
    monkeypatch.setattr(M, "CHUNK", 1500)
    monkeypatch.setattr(M, "PROBES", 16)
    rng = np.random.default_rng(1)
    users, items = rng.normal(1, 0.3, (400, 3)), rng.normal(1, 0.3, (3000, 3))
    items[::7] = items[3]
    frame = lambda x: spark.createDataFrame([(i, f.tolist()) for i, f in enumerate(x)], "id long, f array<double>").repartition(4)
    rated = [(u, int(i)) for u in range(0, 400, 3) for i in np.argsort(-(items @ users[u]))[:40]]
    fitted = M.Fitted(Counting(size=3), frame(users), frame(items), 0.0)
    got = {(r.user, r["rank"]): (r.item, round(r.score, 9)) for r in M.top_items(fitted, spark.createDataFrame(rated, "user long, item long"), 5).collect()}
    score = np.einsum("uj,ij->uij", users, items).sum(axis=2)
    score[tuple(np.array(rated).T)] = -np.inf
    order = np.lexsort((np.broadcast_to(np.arange(3000), score.shape), -np.round(score, 12)), axis=1)[:, :5]
    assert got == {(u, k + 1): (int(i), round(float(score[u, i]), 9)) for u in range(400) for k, i in enumerate(order[u])}
    assert sum(map(int, (tmp_path / "pairs").read_text().split())) < 400 * 3000 / 2


def test_rounds_give_the_same_factors(spark, planted, monkeypatch):
    """In rounds of few bytes; before, all ratings went with their factors at once."""
    r = planted.withColumn("time", F.col("user") % 3)
    for model in (M.LeastSquares(size=2), M.TensorLeastSquares(size=2), M.TimeGradient(size=2)):
        whole = {x.id: x.f for x in M.fit(r, model, 1).items.collect()}
        with monkeypatch.context() as m:
            m.setattr(M, "ROUND", -(-r.count() * (8 * model.width + 40) // 2))
            fitted = M.fit(r, model, 1)
            parts = {x.id: x.f for x in fitted.items.collect()}
            assert M.predicted(fitted, r).count() == r.count()
        assert whole.keys() == parts.keys() and all(parts[i] == pytest.approx(f, rel=1e-9) for i, f in whole.items())


def test_pairs_in_rounds_are_the_same(spark, planted, monkeypatch):
    """Counted in rounds, then summed; before, all pairs went with all their sums at once."""
    want = {(r.i, r.j): r.asDict() for r in S.pair_stats(planted, 3).collect()}
    degrees = [r["count"] for r in planted.groupBy("user").count().collect()]
    monkeypatch.setattr(S, "ROUND", sum(n * (n - 1) for n in degrees) // 5)
    got = {(r.i, r.j): r.asDict() for r in S.pair_stats(planted, 3).collect()}
    assert got.keys() == want.keys() and len(got) > 0
    assert all(got[k][c] == pytest.approx(want[k][c], rel=1e-9, abs=1e-9) for k in want for c in want[k])


def test_blocks_add_up_all_ratings(planted, monkeypatch):
    from tessera.operators import blocks

    for name, small in (("HOT", 16), ("HELD", 150), ("TASK", 60)):  # ids dealt over all blocks, several columns and homes
        monkeypatch.setattr(blocks, name, small)
    model, data = M.SampledFactors(size=2), planted.toPandas()
    _, places = M._gridded(planted, len(data), [2, 2])
    assert all(p.columns > 1 and p.homes > 1 and len(p.hot) for p in places)
    rng = np.random.default_rng(0)
    f = [{i: rng.random(2) for i in range(n)} for n in (30, 25)]
    spark = planted.sparkSession
    sides = [blocks.factors(spark.createDataFrame([(i, x.tolist()) for i, x in g.items()], "id long, f array<double>"), p) for g, p in zip(f, places)]
    grid = blocks.Grid(planted, "user", "item", ["rating"], *places)
    got = {r.id: r.f for r in blocks.listed(blocks.applied(grid.sums(sides[0], sides[1], lambda u, v, rows: np.hstack([u, v * rows["rating"].to_numpy()[:, None]])), sides[0], places[0], lambda ids, own, s, n: (np.hstack([own, s, n[:, None]]), None))).collect()}
    assert len(got) == data.user.nunique()
    for i, of in data.groupby("user"):
        assert got[i] == pytest.approx([*f[0][i], *f[0][i] * len(of), *sum(f[1][j] * r for j, r in zip(of.item, of.rating)), len(of)])
    fitted = M.fit(planted, model, 2)
    assert S.losses(M.predicted(fitted, planted)).first() == pytest.approx(S.losses(fitted.predict(planted)).first())


def test_schedule_asks_no_pipe_that_cannot_send():
    import time

    def column(packets):
        out = dict(zip(("time", "event_id", "subport", "pipe", "class", "queue", "len"), zip(*sorted(packets))))
        return {c: list(x) if c in ("subport", "pipe") else np.array(x) for c, x in out.items()}

    shaping = W.Shaping(port_rate=64.0, subport_rate=32.0, subport_size=64.0, pipe_rate=8.0, pipe_size=32.0, class_bytes=(32.0, 32.0, 32.0, 32.0), period=16.0)
    few = [(0, 0, 0, 0, 1, 0, 32), (0, 1, 0, 0, 0, 0, 32), (0, 2, 0, 1, 0, 0, 32), (0, 3, 1, 2, 0, 0, 32), (0, 4, 0, 0, 0, 0, 32)]
    # pipes in turn, the small class first; the first pipe's bucket has 32 again after 4 s, its class 0 in the next period
    assert W._port(shaping, column(few)).tolist() == [4.5, 0.0, 0.5, 1.0, 16.0]
    many = [(0, i, i % 2, i % 20_000, i % 3, i % 4, 16) for i in range(40_000)]
    began = time.time()
    sent = np.sort(W._port(shaping, column(many)))
    assert not np.isnan(sent).any() and (np.diff(sent) >= 16 / 64 - 1e-9).all() and time.time() - began < 60


def test_few_time_values_go_with_blocks_of_ratings(planted, monkeypatch):
    from tessera.operators import blocks

    model = M.TimeGradient(size=2)
    monkeypatch.setattr(M, "FEW", 0)
    plain = M.fit(planted, model, 2)
    monkeypatch.setattr(M, "FEW", 4096)
    for name, small in (("HOT", 16), ("HELD", 1000), ("TASK", 200)):
        monkeypatch.setattr(blocks, name, small)
    fitted = M.fit(planted, model, 2)
    assert plain.near is None and fitted.near is not None
    for a, b in ((plain.users, fitted.users), (plain.items, fitted.items), (plain.times, fitted.times)):
        want = {r.id: r.f for r in a.collect()}
        got = {r.id: r.f for r in b.collect()}
        assert set(want) == set(got) and all(got[i] == pytest.approx(want[i]) for i in want)
    assert S.losses(M.predicted(fitted, planted)).first() == pytest.approx(S.losses(plain.predict(planted)).first())
