"""The registered queries of the neighbour-graph engine: one for each operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import codec as C
from ..operators import graph as G
from ..operators import initial as I
from ..operators import knn as K
from ..operators import moments as M
from ..operators import quality as Q
from ..operators import sampling as S
from ..sources import points as P
from ..sources import triples as T
from ..sources.shared import scratch, settled, spread
from ..streaming.transform import drain, transform_stream
from .estimator import Tsne, Umap

NEIGHBOURS = 15
#: Numeric columns of a wide table.
WIDE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
#: Boundaries of a small scalar quantizer.
BOUNDARIES = [-0.2, -0.1, -0.05, 0.0, 0.05, 0.1, 0.2]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.to_points(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vec_id", "embedding")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label")


def edges(spark: SparkSession, sf_dir: str, k: int = NEIGHBOURS) -> DataFrame:
    return K.knn_exact(points(spark, sf_dir), k)


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = settled(edges(spark, sf_dir), "edges")
    return G.fuzzy_graph(found, G.smooth_knn(found))


def stand_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two coordinates as an embedding."""
    return points(spark, sf_dir).select("id", F.slice("features", 1, 2).alias("y"))


def flat(embedding: DataFrame, name: str = "y") -> DataFrame:
    return embedding.select("id", F.col(name)[0].alias("y1"), F.col(name)[1].alias("y2"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def knn_exact(spark, d):
    return rounded(edges(spark, d), "dist")


def knn_expression(spark, d):
    return rounded(K.knn_expression(points(spark, d), NEIGHBOURS), "dist")


def knn_external(spark, d):
    p = points(spark, d)
    found = K.knn_external(p.where("id % 2 = 0"), p.where("id % 2 = 1"), NEIGHBOURS)
    return rounded(found.withColumnRenamed("src", "qid"), "dist")


def knn_rerank(spark, d):
    """Candidates are twice as many neighbours in single precision."""
    single = points(spark, d).select("id", V.to_float32(F.col("features")).cast("array<double>").alias("features"))
    return rounded(K.rerank(K.knn_exact(single, 2 * NEIGHBOURS), points(spark, d), NEIGHBOURS), "dist")


def knn_label_purity(spark, d):
    return rounded(Q.label_purity(edges(spark, d), labels(spark, d)), "purity")


def smooth_knn(spark, d):
    return rounded(G.smooth_knn(edges(spark, d)), "rho", "sigma")


def smooth_knn_nearest(spark, d):
    return rounded(G.smooth_knn(edges(spark, d), "nearest"), "rho", "sigma")


def fuzzy_graph(spark, d):
    return rounded(graph(spark, d), "weight")


def graph_degree(spark, d):
    return rounded(G.degrees(graph(spark, d), points(spark, d)), "degree")


def normalized_laplacian(spark, d):
    return rounded(G.normalized_laplacian(graph(spark, d), points(spark, d)), "value")


def laplacian(spark, d):
    return rounded(G.laplacian(graph(spark, d), points(spark, d)), "value")


def edge_schedule(spark, d):
    """The schedule over distances as weights, which are exact on both sides."""
    near = edges(spark, d).select("src", "dst", (F.lit(1.0) / F.col("dist")).alias("weight"))
    return rounded(G.edge_schedule(near, 500), "eps", "eps_negative")


def edge_firings(spark, d):
    near = edges(spark, d).select("src", "dst", (F.lit(1.0) / F.col("dist")).alias("weight"))
    return G.firings(G.edge_schedule(near, 100)).groupBy("epoch").agg(F.count(F.lit(1)).alias("n"))


def tsne_affinity(spark, d):
    n = points(spark, d).count()
    return rounded(G.tsne_affinities(edges(spark, d), 5.0, n), "p", digits=9)


def column_means(spark, d):
    wide = P.to_points(spark.read.parquet(f"{d}/lineitem.parquet"), "l_orderkey", WIDE)
    return rounded(M.column_means(wide), "mean", digits=4)


def covariance(spark, d):
    wide = P.to_points(spark.read.parquet(f"{d}/lineitem.parquet"), "l_orderkey", WIDE)
    return rounded(M.covariance(wide), "cov", digits=3)


def row_norms(spark, d):
    return rounded(points(spark, d).select("id", V.norm(F.col("features")).alias("norm")), "norm")


def asinh_points(spark, d):
    events = P.to_points(spark.read.parquet(f"{d}/events.parquet"), "event_id", ["value"])
    return rounded(events.select("id", V.asinh(F.col("features"))[0].alias("value")), "value")


def sample_train(spark, d):
    return S.sample(points(spark, d), 0.1).select("id")


def sample_rest(spark, d):
    p = points(spark, d)
    return S.complement(p, S.sample(p, 0.1)).select("id")


def sample_scatter(spark, d):
    """Sample and rest, each marked, as one table again."""
    p = points(spark, d).select("id")
    train = S.sample(p, 0.1)
    return S.scatter(train.withColumn("part", F.lit("train")), S.complement(p, train).withColumn("part", F.lit("rest")))


def head_slice(spark, d):
    return S.head(points(spark, d), 100).select("id")


def random_pairs(spark, d):
    return S.random_pairs(points(spark, d), 1000)


def equal_width_bins(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    r = part.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi")).collect()[0]
    return part.select("p_partkey", V.equal_width_bin(F.col("p_retailprice"), r.lo, r.hi).alias("bin"))


def model_rows(spark, d):
    """A stand-in model: coordinates are the first two features; sigma grows with the label."""
    return points(spark, d).join(labels(spark, d), "id").select("id", F.slice("features", 1, 4).alias("features"), F.slice("features", 1, 2).alias("y"), (F.lit(0.1) + F.col("label") / F.lit(10.0)).alias("sigma"), F.lit(0.0).alias("rho"))


def triples_export(spark, d):
    rows = T.point_triples(model_rows(spark, d), T.feature_names(None, 4), 2)
    return rows.select("subject", "predicate", F.round(F.col("object").cast("double"), 6).alias("object"))


def triples_pivot(spark, d):
    rows = T.point_triples(model_rows(spark, d), T.feature_names(None, 4), 2)
    names = ["umap1", "umap2", "sigma", "rho", *T.feature_names(None, 4)]
    return rounded(T.pivot_points(rows, names), *names)


def transform_init(spark, d):
    """Weighted means of the neighbours' coordinates, before refinement; even ids against odd ones."""
    m = points(spark, d).join(labels(spark, d), "id").select("id", "features", F.slice("features", 1, 2).alias("y"), (F.lit(0.1) + F.col("label") / F.lit(10.0)).alias("sigma"))
    near = K.knn_external(m.where("id % 2 = 0"), m.where("id % 2 = 1"), NEIGHBOURS)
    near = near.join(m.select(F.col("id").alias("dst"), "y", "sigma"), "dst")
    local = near.groupBy("src").agg(F.min("dist").alias("rho"), F.avg("sigma").alias("s"))
    w = near.join(local, "src").select("src", "y", V.membership(F.col("dist"), F.col("rho"), F.col("s")).alias("w"))
    total = F.greatest(F.sum("w"), F.lit(1e-10))
    out = w.groupBy(F.col("src").alias("id")).agg(*[(F.sum(F.col("w") * F.col("y")[j]) / total).alias(f"y{j + 1}") for j in (0, 1)])
    return rounded(out, "y1", "y2")


def separation_exact(spark, d):
    return rounded(Q.separation(stand_in(spark, d), labels(spark, d)), "within", "between", "within_sd", "between_sd", "ratio")


def separation_sampled(spark, d):
    return rounded(Q.separation(stand_in(spark, d), labels(spark, d), 5000), "within", "between", "within_sd", "between_sd", "ratio")


def group_stats(spark, d):
    out = Q.group_stats(stand_in(spark, d), labels(spark, d))
    return rounded(out, *[c for c in out.columns if c not in ("label", "n")])


def group_counts(spark, d):
    return Q.group_counts(labels(spark, d))


def nn_coherence(spark, d):
    return rounded(Q.nn_coherence(stand_in(spark, d), labels(spark, d), 1), "coherence")


def conditional_labels(spark, d):
    return S.conditional_label(labels(spark, d), F.col("label") == 1, "rare", "other", "kind").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def label_concat(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet")
    return rows.select("o_orderkey", V.label(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("label"))


def quantize_scalar(spark, d):
    rows = points(spark, d).select("id", F.posexplode("features").alias("pos", "x"))
    return rows.select("id", "pos", V.quantize_scalar(F.col("x"), BOUNDARIES).alias("code"))


def synthetic_ramp(spark, d):
    return rounded(P.ramp(spark, 200, 5).select("id", F.posexplode("features").alias("pos", "x")), "x")


def pca_reduce(spark, d):
    return flat(I.pca_reduce(points(spark, d), 2)[0], "features")


def pca_init(spark, d):
    return flat(I.pca_init(points(spark, d)))


def spectral_init(spark, d):
    return flat(I.spectral_init(graph(spark, d), points(spark, d)))


def random_init(spark, d):
    return flat(I.random_init(points(spark, d)))


def umap(spark, d):
    return flat(Umap().fit_transform(points(spark, d)))


def umap_train_size(spark, d):
    return flat(Umap(train_size=0.5).fit_transform(points(spark, d)))


def umap_transform(spark, d):
    p = points(spark, d)
    return flat(Umap(n_epochs=200).fit(p.where("id % 2 = 1"))[1].transform(p.where("id % 2 = 0")))


def umap_stream(spark, d):
    """Even ids as a stream through a model of the odd ones."""
    p = points(spark, d)
    model = Umap(n_epochs=200).fit(p.where("id % 2 = 1"))[1]
    at = scratch(spark, "stream")
    p.where("id % 2 = 0").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(p.schema).parquet(f"{at}/in")
    return flat(drain(transform_stream(model, stream), at))


def umap_with_knn(spark, d):
    return flat(Umap(n_epochs=200).fit_transform_with_knn(points(spark, d), edges(spark, d)))


def umap_pca(spark, d):
    return flat(Umap(pca=16, n_epochs=200).fit_transform(points(spark, d)))


def _compressed(bits: int):
    def umap_compressed(spark, d):
        return flat(Umap(n_epochs=200).fit_transform_compressed(points(spark, d), bits))

    return umap_compressed


def tsne(spark, d):
    return flat(Tsne(n_iter=300).run(points(spark, d), edges(spark, d, 90)))


def tsne_compressed(spark, d):
    return flat(Tsne(n_iter=300).run_compressed(points(spark, d)))


CODEC = C.Codec(8, 64)


def codes(spark, d):
    return C.encode(points(spark, d), CODEC)


def codec_encode(spark, d):
    return codes(spark, d).select("id", "norm", "residual_norm", F.hex("packed").alias("packed"))


def codec_decode(spark, d):
    return rounded(C.decode(codes(spark, d), CODEC).select("id", F.posexplode("features").alias("pos", "x")), "x")


def codec_memory(spark, d):
    """Bytes by the plain formula, and the mean squared residual of a coordinate."""
    held = settled(codes(spark, d), "codes")
    return spark.createDataFrame([(C.memory(held, CODEC)["formula"], round(C.mean_squared_residual(held, CODEC), 6))], "bytes long, residual double")


def knn_compressed(spark, d):
    return rounded(C.knn_compressed(codes(spark, d), CODEC, NEIGHBOURS), "dist")


def knn_codes_reranked(spark, d):
    return C.knn_reranked(points(spark, d), C.Codec(4, 64), NEIGHBOURS)


def fuzzy_compressed(spark, d):
    return rounded(C.fuzzy_compressed(settled(C.knn_compressed(codes(spark, d), CODEC, NEIGHBOURS), "edges")), "weight")


def knn_approx(spark, d):
    return K.knn_approximate(points(spark, d), NEIGHBOURS)


def knn_dispatch(spark, d):
    """By the name of another engine's index, with more neighbours asked for than there are in a tenth of the points."""
    return rounded(K.knn(S.sample(points(spark, d), 0.02), 200, "kd_tree"), "dist")


def csv_points(spark, d):
    """Points out to a numeric CSV file and in again."""
    at = scratch(spark, "csv")
    spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(*[F.sum(c).alias(c) for c in WIDE]).write.option("header", True).csv(at)
    return rounded(P.read_numeric_csv(spark, at, WIDE, "l_orderkey").select("id", F.posexplode("features").alias("pos", "x")), "x", digits=3)


def embedding_csv(spark, d):
    """An embedding out to the CSV file for plots, with labels, and its numbers in again by line."""
    at = scratch(spark, "embedding")
    P.write_embedding_csv(stand_in(spark, d), f"{at}/e", labels(spark, d))
    back = spark.read.option("header", True).csv(f"{at}/e").select(*[F.col(c).cast("double").alias(c) for c in ("V1", "V2", "label")])
    back.write.csv(f"{at}/plain")
    return rounded(P.read_headerless_csv(spark, f"{at}/plain", 3).select(F.col("features")[0].alias("v1"), F.col("features")[1].alias("v2"), F.col("features")[2].cast("int").alias("label")), "v1", "v2")


def optional_source(spark, d):
    """Rows of a table that is there, and of one that is not."""
    found = {name: P.read_if(spark, f"{d}/{name}.parquet", lambda s, at: s.read.parquet(at)) for name in ("nation", "no_such_table")}
    return spark.createDataFrame([(name, df.count() if df is not None else -1) for name, df in found.items()], "name string, n long")


def timings_ranked(spark, d):
    """Priorities as methods, mean prices as scores; timings for all but one go through their CSV file."""
    at = scratch(spark, "timings")
    scores = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderpriority").alias("method")).agg(F.avg("o_totalprice").alias("ratio"))
    P.write_timings_csv(spark, {"1-URGENT": 1.5, "2-HIGH": 2.5, "3-MEDIUM": 3.5, "5-LOW": 5.5}, at)
    return rounded(Q.rank_methods(scores, spark.read.option("header", True).schema("method string, time double").csv(at)), "ratio", digits=3).fillna(-1.0, "time")


def housekeeping(spark, d):
    """Counts of the columns that are left."""
    table = spark.read.parquet(f"{d}/events.parquet").withColumnsRenamed({"ts": "Time", "props": "DNA"})
    left = S.drop_housekeeping(table)
    return left.agg(*[F.count(c).alias(c) for c in left.columns])


def gathered(spark, d):
    p = points(spark, d)
    return S.gather(p, S.sample(p, 0.1)).select("id")


def vector_kernels(spark, d):
    """Scaled, clamped and decoded coordinates, and the heavy-tailed kernel of the squared norm."""
    x = points(spark, d).select("id", "features", V.student_t(V.norm(F.col("features")) * V.norm(F.col("features"))).alias("kernel"), V.scale(F.col("features"), 0.01).alias("scaled"))
    flat_ = x.select("id", "kernel", F.posexplode(F.arrays_zip("features", "scaled")).alias("pos", "v")).select("id", "pos", "kernel", F.col("v.features").alias("x"), F.col("v.scaled").alias("scaled"))
    middles = [-0.25, -0.15, -0.075, -0.025, 0.025, 0.075, 0.15, 0.25]
    out = flat_.select("id", "pos", "kernel", "scaled", V.clamp(F.col("x"), 0.1).alias("clamped"), V.dequantize_scalar(V.quantize_scalar(F.col("x"), BOUNDARIES), middles).alias("decoded"))
    return rounded(out, "kernel", "scaled", "clamped", digits=8)


def graph_facts(spark, d):
    facts = G.describe(graph(spark, d))
    return spark.createDataFrame([(facts["nnz"], facts["nodes"], round(facts["top"], 6))], "nnz long, nodes long, top double")


def umap_facts(spark, d):
    """What holds for any layout: a row each, centred, finite."""
    y = flat(Umap(n_epochs=50).fit_transform(points(spark, d)))
    return y.agg(F.count(F.lit(1)).alias("n"), F.abs(F.round(F.avg("y1"), 6)).alias("y1"), F.abs(F.round(F.avg("y2"), 6)).alias("y2"), F.count_if(F.isnan("y1") | F.isnan("y2") | (F.abs("y1") > 1e6)).alias("bad"))


def triples_roundtrip(spark, d):
    """The exported model of a fit, through its file: what the reader finds of each kind of cell."""
    at = scratch(spark, "triples")
    Umap(n_epochs=20, model_format=at).fit(points(spark, d))
    rows = T.read_triples(spark, at)
    return rows.where("subject != 'model'").groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.when(F.col("predicate").startswith("feature_"), F.col("object").cast("double")).otherwise(0.0)), 4).alias("total"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    knn_exact, knn_expression, knn_external, knn_rerank, knn_label_purity, smooth_knn, smooth_knn_nearest, fuzzy_graph, graph_degree, normalized_laplacian, laplacian,
    edge_schedule, edge_firings, tsne_affinity, column_means, covariance, row_norms, asinh_points, sample_train, sample_rest, sample_scatter, head_slice, random_pairs, equal_width_bins,
    triples_export, triples_pivot, transform_init, separation_exact, separation_sampled, group_stats, group_counts, nn_coherence, conditional_labels, label_concat,
    quantize_scalar, synthetic_ramp, pca_reduce, pca_init, spectral_init, random_init, umap, umap_train_size, umap_transform, umap_stream, umap_with_knn, umap_pca, tsne, tsne_compressed,
    codec_encode, codec_decode, codec_memory, knn_compressed, knn_dispatch, csv_points, embedding_csv, optional_source, timings_ranked, housekeeping, gathered, vector_kernels, graph_facts, umap_facts, triples_roundtrip, knn_codes_reranked, fuzzy_compressed, knn_approx,
)} | {f"umap_compressed_{b}": _compressed(b) for b in (4, 8, 12)}
