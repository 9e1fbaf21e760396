import numpy as np
import pytest

from vicinal.operators import initial as I
from vicinal.operators import knn as K
from vicinal.operators import layout as L
from vicinal.operators import tsne as T
from vicinal.plans.estimator import Tsne, Umap, UmapModel
from vicinal.streaming.transform import transform_stream


def coordinates(embedding):
    return np.array([r.y for r in embedding.orderBy("id").collect()])


@pytest.fixture
def two_clusters(make_points):
    return make_points([[0.1 * i + 0.05 * j + (100 if i >= 10 else 0) for j in range(5)] for i in range(20)])


def test_two_clusters_come_apart(two_clusters):
    y = coordinates(Umap(n_neighbors=5, n_epochs=100).fit_transform(two_clusters))
    assert y.shape == (20, 2) and np.isfinite(y).all() and np.abs(y[:10].mean(axis=0) - y[10:].mean(axis=0)).max() > 0.1


@pytest.mark.parametrize("m", [1, 3])
def test_other_numbers_of_components(make_points, m):
    ramp = make_points(np.arange(150).reshape(15, 10))
    y = coordinates(Umap(n_neighbors=5, n_components=m, n_epochs=50).fit_transform(ramp))
    assert y.shape == (15, m) and np.isfinite(y).all()


def test_equal_seeds_give_equal_layouts_whatever_the_partitions(make_points):
    ramp = make_points(np.arange(120).reshape(15, 8))
    u = Umap(n_neighbors=5, random_state=123, n_epochs=60, init="pca")
    assert np.abs(coordinates(u.fit_transform(ramp)) - coordinates(u.fit_transform(ramp.repartition(3)))).max() < 1e-10


def test_constant_points(make_points):
    y = coordinates(Umap(n_neighbors=10, n_epochs=20).fit_transform(make_points([[1.0] * 5] * 10)))
    assert y.shape == (10, 2) and np.isfinite(y).all()


def test_chain_is_centred():
    y = L.optimize(np.random.default_rng(0).normal(size=(5, 2)), np.arange(4), np.arange(1, 5), np.ones(4), 10, 1.577, 0.8951)
    assert np.abs(y.mean(axis=0)).max() < 1e-6


def test_distributed_layout_pulls_neighbours_together(spark, two_clusters):
    graph = spark.createDataFrame([(i, j, 1.0) for i in range(20) for j in range(20) if i != j and (i < 10) == (j < 10)], "src long, dst long, weight double")
    start = I.random_init(two_clusters)
    y = coordinates(L.layout(start, graph, 6, most=0))
    s = coordinates(start)

    def spread(v):
        return np.linalg.norm(v[:10] - v[:10].mean(axis=0)) / np.linalg.norm(v - v.mean(axis=0))

    assert y.shape == (20, 2) and np.abs(y.mean(axis=0)).max() < 1e-6 and spread(y) < spread(s)


def test_blocks_keep_neighbours_together(spark, monkeypatch):
    # the same graph in one block and in several gives layouts of like quality
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8)) + np.repeat(np.eye(8)[:4] * 8, 100, axis=0)
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    ratios = []
    for block in (6400, 60):
        monkeypatch.setattr(L, "BLOCK", block)
        y = coordinates(Umap(n_neighbors=10, n_epochs=120).fit_transform(points))
        centre = np.stack([y[i * 100 : i * 100 + 100].mean(axis=0) for i in range(4)])
        within = np.linalg.norm(y - np.repeat(centre, 100, axis=0), axis=1).mean()
        ratios.append(np.linalg.norm(centre[:, None] - centre[None], axis=2).sum() / 12 / within)
        assert np.isfinite(y).all() and np.abs(y.mean(axis=0)).max() < 1e-6
    assert min(ratios) > 2 and ratios[1] > 0.5 * ratios[0]


def test_epochs():
    assert (L.epochs_for(9_999), L.epochs_for(10_000), L.epochs_for(5, 7)) == (500, 200, 7)


def test_initial_coordinates(spark, make_points):
    points = make_points(np.random.default_rng(1).normal(size=(40, 6)))
    y = coordinates(I.pca_init(points))
    assert np.allclose(y.std(axis=0, ddof=1), 1, atol=0.01)
    assert np.isclose(np.abs(coordinates(I.random_init(points))).max(), 10)
    empty = spark.createDataFrame([], "src long, dst long, weight double")
    assert coordinates(I.spectral_init(empty, spark.range(5))).shape == (5, 2)
    reduced, projection = I.pca_reduce(points, 3)
    assert coordinates(reduced.withColumnRenamed("features", "y")).shape == (40, 3) and (np.diff(projection.explained) <= 0).all()
    assert I.pca_reduce(points, 6)[1] is None


def test_repulsion_by_pyramid_is_close_to_exact():
    y = np.random.default_rng(2).normal(size=(600, 2)) * 5
    a, za = T.exact_repulsion(y)
    b, zb = T.pyramid_repulsion(y, 0.3)
    assert abs(za - zb) / za < 0.02 and np.linalg.norm(a - b) / np.linalg.norm(a) < 0.05
    pair = T.exact_repulsion(np.array([[-1.0, 0.0], [1.0, 0.0]]))[0]
    assert pair[0, 0] < 0 < pair[1, 0] and np.isclose(pair[0, 0], -pair[1, 0])


@pytest.mark.parametrize("size", [0.001, 3, 20])
def test_repulsion_by_grid_is_closer_to_exact_than_the_pyramid(size):
    y = np.random.default_rng(2).normal(size=(1500, 2)) * size
    a, za = T.exact_repulsion(y)
    (b, zb), (c, _) = T.grid_repulsion(y, 0.5), T.pyramid_repulsion(y, 0.5)
    assert abs(za - zb) / za < 0.002 and np.linalg.norm(a - b) < np.linalg.norm(a - c) and np.linalg.norm(a - b) < 0.03 * np.linalg.norm(a)
    assert T.grid_repulsion(y * 1000 / size, 0.5) is None


def test_descent_of_many_points_follows_the_exact_one(monkeypatch):
    rng = np.random.default_rng(3)
    src, dst = np.triu_indices(400, 1)
    near = (src % 4 == dst % 4) & (rng.random(len(src)) < 0.2)
    src, dst, start = src[near], dst[near], rng.normal(size=(400, 2)) * 0.01
    p = np.full(len(src), 0.5 / len(src))
    found = []
    for least in (5_000, 10):
        monkeypatch.setattr(T, "EXACT_POINTS", least)
        found.append(T.descend(start, src, dst, p, 30, 20.0, 4.0, 20, 0.5))
    assert np.linalg.norm(found[0] - found[1]) < 0.01 * np.linalg.norm(found[0])


def test_tsne_runs(make_points):
    points = make_points(np.random.default_rng(3).normal(size=(30, 4)) + np.repeat([0, 20], 15)[:, None])
    y = coordinates(Tsne(perplexity=5, n_iter=120).run(points, K.knn(points, 10)))
    assert y.shape == (30, 2) and np.isfinite(y).all()
    assert coordinates(Tsne(perplexity=5, n_iter=50).run_compressed(points, 8)).shape == (30, 2)


def test_model_round_trips(spark, two_clusters, tmp_path):
    embedding, model = Umap(n_neighbors=5, n_epochs=50).fit(two_clusters)
    model.save(f"file://{tmp_path}/model")
    model.export_triples(f"file://{tmp_path}/triples")
    new = two_clusters.where("id % 3 = 0")
    want = coordinates(model.transform(new))
    assert np.allclose(coordinates(UmapModel.load(spark, f"file://{tmp_path}/model").transform(new)), want)
    loaded = UmapModel.load_triples(spark, f"file://{tmp_path}/triples")
    assert model.triples().count() == 6 + 5 + 20 * (2 + 2 + 5)
    assert np.allclose(coordinates(loaded.transform(new)), want)
    assert np.abs(want - coordinates(embedding.join(new, "id", "left_semi"))).max() < 5


def test_model_with_projection_takes_raw_rows(make_points):
    points = make_points(np.random.default_rng(5).normal(size=(30, 8)))
    model = Umap(n_neighbors=5, pca=3, n_epochs=20).fit(points)[1]
    assert coordinates(model.transform(points)).shape == (30, 2)


def test_width_mismatch_is_an_error(make_points):
    model = Umap(n_neighbors=2, n_epochs=5).fit(make_points(np.eye(5)[:, :3]))[1]
    with pytest.raises(Exception, match="features"):
        model.transform(make_points([[1] * 5, [2] * 5])).collect()


def test_train_size_keeps_every_row(make_points):
    points = make_points(np.random.default_rng(6).normal(size=(50, 4)))
    assert coordinates(Umap(n_neighbors=5, n_epochs=30, train_size=0.4).fit_transform(points)).shape == (50, 2)


def test_own_neighbours_and_codes(two_clusters):
    u = Umap(n_neighbors=4, n_epochs=30)
    assert coordinates(u.fit_transform_with_knn(two_clusters, K.knn(two_clusters, 4))).shape == (20, 2)
    for bits in (4, 8, 12):
        assert coordinates(u.fit_transform_compressed(two_clusters, bits)).shape == (20, 2)


def test_parameters_are_checked(make_points):
    for bad in ({"metric": "cosine"}, {"sampling": "grid"}, {"n_components": 0}):
        with pytest.raises(ValueError):
            Umap(**bad)
    with pytest.raises(ValueError):
        Umap(feature_names=("sigma", "b")).fit(make_points([[1, 2], [3, 4]]))


def test_streams_are_transformed(spark, two_clusters, tmp_path):
    model = Umap(n_neighbors=5, n_epochs=20).fit(two_clusters)[1]
    two_clusters.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(two_clusters.schema).parquet(f"file://{tmp_path}/in")
    run = transform_stream(model, stream).writeStream.format("memory").queryName("placed").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("placed").count() == 20
    with pytest.raises(ValueError):
        transform_stream(model, two_clusters)
