import pytest

from vicinal.operators import sampling as S
from vicinal.sources import points as P
from vicinal.sources import triples as T


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_text('"FL","RW"\n8.1, 6.7\n19,7\n')
    points = P.read_numeric_csv(spark, f"file://{tmp_path}/in.csv")
    assert [(r.id, r.features) for r in points.orderBy("id").collect()] == [(0, [8.1, 6.7]), (1, [19.0, 7.0])]
    P.write_embedding_csv(points.withColumnRenamed("features", "y"), f"file://{tmp_path}/out")
    assert [tuple(r) for r in spark.read.csv(f"file://{tmp_path}/out", header=True, inferSchema=True).collect()] == [(8.1, 6.7), (19.0, 7.0)]
    (tmp_path / "bad.csv").write_text("a,b\n1,x\n")
    with pytest.raises(Exception):
        P.read_numeric_csv(spark, f"file://{tmp_path}/bad.csv").collect()
    assert P.read_if(spark, f"file://{tmp_path}/none.csv", P.read_numeric_csv) is None


@pytest.mark.parametrize("rows", [[(0, [1.0]), (0, [2.0])], [(0, [1.0]), (1, [1.0, 2.0])], [(0, [float("nan")])], [(0, [None])], [(0, None)], [(None, [1.0])], [(0, [float("inf")])]])
def test_bad_points_are_refused(spark, rows):
    with pytest.raises(ValueError):
        P.validate(spark.createDataFrame(rows, "id long, features array<double>"))


def test_wide_columns_and_vectors(spark):
    wide = spark.createDataFrame([(7, 1, 2.5)], "k long, a int, b double")
    points = P.to_points(wide, "k", ["a", "b"])
    assert points.first().features == [1.0, 2.5] and P.validate(points) == (1, 2)
    assert P.to_points(P.to_vectors(points), "id", "features").first().features == [1.0, 2.5]


def test_positions_have_no_gaps(spark):
    df = spark.range(100).repartition(7)
    assert sorted(r.at for r in P.with_position(df, "at").collect()) == list(range(100))


def test_triples_keep_commas_in_objects(spark, tmp_path):
    t = spark.createDataFrame([("point_3", "umap1", "1.5"), ("point_3", "note", "a,b"), ("model", "a", "2")], T.SCHEMA)
    T.write_triples(t, f"file://{tmp_path}/t")
    back = T.read_triples(spark, f"file://{tmp_path}/t")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in t.collect()}
    assert tuple(T.pivot_points(back, ["umap1", "umap2"]).first()) == (3, 1.5, 0.0)


def test_samples_are_exact_and_stable(spark):
    df = spark.range(100)
    a = {r.id for r in S.sample(df, 0.1).collect()}
    assert len(a) == 10 and a == {r.id for r in S.sample(df.repartition(5), 0.1).collect()}
    assert {r.id for r in S.complement(df, S.sample(df, 0.1)).collect()} == set(range(100)) - a
    assert S.sample_size(3, 0.0) == 1 and S.sample_size(3, 9.0) == 3 and S.sample_size(0, 0.5) == 0
    assert S.random_pairs(df, 50).where("i = j").count() == 0
