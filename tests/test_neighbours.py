import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vicinal.functions import kernels
from vicinal.functions.kernels import nearest
from vicinal.operators import graph as G
from vicinal.operators import knn as K
from vicinal.operators import quality as Q
from vicinal.plans import queries as P

FIVE = [(0, 0), (1, 0), (0, 1), (10, 10), (11, 10)]


def listed(edges):
    out = {}
    for r in edges.orderBy("src", "rank").collect():
        out.setdefault(r.src, []).append(r.dst)
    return out


def test_five_points(make_points):
    got = listed(K.knn(make_points(FIVE), 2))
    assert got[3][0] == 4 and all(len(v) == 2 for v in got.values())


def test_two_quads_stay_apart(make_points):
    quads = [(a + x, a + y) for a in (0, 10) for x in (0, 0.1) for y in (0, 0.1)]
    got = listed(K.knn(make_points(quads), 3))
    assert all((i < 4) == (j < 4) for i, js in got.items() for j in js)


def test_points_on_a_line_in_order(make_points):
    assert listed(K.knn(make_points([(0, 0), (3, 0), (1, 0), (2, 0), (4, 0)]), 2))[0] == [2, 3]


def test_k_beyond_the_points_is_cut(make_points):
    got = listed(K.knn(make_points([(1.0,) * 5] * 10), 10))
    assert all(len(v) == 9 and i not in v for i, v in got.items())
    assert got[9] == list(range(9))


def test_one_point_and_none(make_points):
    assert K.knn(make_points([(1, 2)]), 3).count() == 0
    assert K.knn(make_points([(1, 2)]).where("false"), 3).count() == 0


def test_block_and_expression_forms_agree(spark):
    p = P.points(spark, "/root/testdata/sf0.001").where("id < 120")
    a, b = K.knn_exact(p, 5).collect(), K.knn_expression(p, 5).collect()
    assert {(r.src, r.dst, r["rank"], r.dist) for r in a} == {(r.src, r.dst, r["rank"], r.dist) for r in b}


@pytest.mark.parametrize("width", [3, 64, 70])
def test_expression_form_by_bit_planes_is_exact(make_points, monkeypatch, width):
    # with copies, ties and a far point that makes the steps of the others coarse
    monkeypatch.setattr(K, "PLAIN_POINTS", 10)
    x = np.random.default_rng(width).normal(size=(90, width)).round(1)
    x[40:48] = x[0]
    x[89] = 30
    p = make_points(x, start=-20)
    a, b = K.knn_exact(p, 5).collect(), K.knn_expression(p, 5).collect()
    assert len(a) == 450 and sorted(a) == sorted(b)


def test_distributed_product_agrees_with_broadcast(spark, monkeypatch):
    p = P.points(spark, "/root/testdata/sf0.001").where("id < 200").repartition(3)
    want = listed(K.knn_exact(p, 4))
    monkeypatch.setattr(K, "BROADCAST_BYTES", 0)
    assert listed(K.knn_exact(p, 4)) == want


def test_a_transform_holds_no_whole_distance_matrix():
    # 1,024 queries against 20,000 rows are 160 MB of distances; the pieces are 16 MB
    rng = np.random.default_rng(8)
    x, q, ids = rng.normal(size=(20_000, 8)), rng.normal(size=(1_024, 8)), np.arange(20_000) * 2
    x[10_000:10_040] = x[0]  # ties across pieces
    q[0] = x[0]
    tracemalloc.start()
    got = K.nearest_in_blocks(q, x, ids, 15)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = nearest(q, np.arange(len(q)), x, ids, 15, False)
    assert all(np.array_equal(a, b) for a, b in zip(got, want)) and peak < 100 << 20


def test_blocks_beyond_the_first_measure_few_rows(monkeypatch, make_points):
    # 20 blocks meet one of queries: once each query has k neighbours, only rows within the k-th distance are measured
    x = np.random.default_rng(11).normal(size=(2_000, 4))
    x[1_500:1_520] = x[3]
    measured = []
    monkeypatch.setattr(kernels, "exact_distances", lambda a, b, real=kernels.exact_distances: measured.append(len(a)) or real(a, b))
    ids = np.random.default_rng(12).permutation(2_000)
    table = pa.RecordBatch.from_arrays([pa.array([ids[:100].tobytes()] * 20), pa.array([x[:100].tobytes()] * 20), pa.array([ids[i : i + 100].tobytes() for i in range(0, 2_000, 100)]), pa.array([x[i : i + 100].tobytes() for i in range(0, 2_000, 100)])], ["qi", "qx", "xi", "xx"])
    got = pa.Table.from_batches(list(K._compare(10, True)(iter([table]))))
    assert sum(measured) < 20 * 100 * 10 / 2
    row, dst, dist = nearest(x[:100], ids[:100], x, ids, 10, True)
    assert sorted(zip(*(c.to_pylist() for c in got.columns))) == sorted(zip(ids[row].tolist(), dst.tolist(), dist.tolist()))


def test_neighbours_are_a_prefix_of_more_neighbours(spark):
    p = P.points(spark, "/root/testdata/sf0.001").where("id < 100")
    five, six = listed(K.knn_exact(p, 5)), listed(K.knn_exact(p, 6))
    assert all(six[i][:5] == five[i] for i in five)


def test_approximate_neighbours_recall(spark):
    p = P.points(spark, "/root/testdata/sf0.001")
    assert Q.recall(K.knn_approximate(p, 10), K.knn_exact(p, 10)) >= 0.9


def test_neighbours_by_codes(spark):
    p = P.points(spark, "/root/testdata/sf0.001").where("id < 200")
    assert Q.recall(K.knn(p, 10, "tq8"), K.knn(p, 10)) >= 0.95


def test_gpu_and_unknown_methods_are_refused(make_points):
    with pytest.raises(NotImplementedError):
        K.knn(make_points(FIVE), 2, "gpu")
    with pytest.raises(ValueError):
        K.knn(make_points(FIVE), 2, "other")


def test_fuzzy_graph_is_symmetric_with_weights_up_to_one(make_points):
    e = K.knn(make_points(FIVE), 2)
    g = {(r.src, r.dst): r.weight for r in G.fuzzy_graph(e, G.smooth_knn(e)).collect()}
    assert all(abs(g[j, i] - w) < 1e-10 and 0 < w <= 1 for (i, j), w in g.items())


def test_zero_distances_give_weight_one(make_points):
    e = K.knn(make_points([(1.0, 1.0)] * 6), 3)
    assert all(r.weight == 1.0 for r in G.fuzzy_graph(e, G.smooth_knn(e)).collect())


def test_path_laplacian(spark):
    ids = spark.range(3)
    g = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0)], "src long, dst long, weight double")
    m = G.to_dense(G.laplacian(g, ids), 3)
    assert np.allclose(np.diag(m), [1, 2, 1]) and np.allclose(m.sum(axis=1), 0)
    assert np.allclose(np.linalg.eigvalsh(G.to_dense(G.normalized_laplacian(g, ids), 3))[0], 0)


def test_row_entries(spark):
    g = spark.createDataFrame([(2, 0, 0.3), (0, 2, 0.3), (1, 0, 0.5), (0, 1, 0.5)], "src long, dst long, weight double")
    assert [(r.dst, r.weight) for r in G.row_entries(g, 0).collect()] == [(1, 0.5), (2, 0.3)]
    assert G.describe(g)["nnz"] == 4


def test_schedule_fires_the_heaviest_edge_first(spark):
    g = spark.createDataFrame([(0, 1, 1.0), (1, 2, 0.5), (2, 3, 0.25)], "src long, dst long, weight double")
    s = G.edge_schedule(g, 9)
    assert {r.src: r.n_firings for r in s.collect()} == {0: 8, 1: 4, 2: 2}
    assert sorted(r.epoch for r in G.firings(s).where("src = 2").collect()) == [4, 8]


def test_affinities_sum_to_one(spark):
    p = P.points(spark, "/root/testdata/sf0.001").where("id < 150")
    a = G.tsne_affinities(K.knn_exact(p, 15), 5.0, 150)
    assert abs(a.agg(F.sum("p")).first()[0] - 1) < 1e-6


def test_separation_and_coherence(make_points, spark):
    y = make_points([(0, 0), (0, 1), (9, 9), (9, 8)]).withColumnRenamed("features", "y")
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 2)], "id long, label int")
    r = Q.separation(y, labels).first()
    assert r.ratio > 10 and abs(r.within - 1) < 1e-12
    assert Q.nn_coherence(y, labels, 1).first().coherence == 1.0
    assert [x.n for x in Q.group_counts(labels).collect()] == [2, 2]
