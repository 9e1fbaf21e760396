"""Weighted neighbour graphs: local bandwidths, fuzzy union, Laplacian, edge schedules, perplexity affinities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import conditional_p, fuzzy_or, membership, perplexity_sigma, smooth_sigma

#: Edges of less weight go.
LEAST_WEIGHT, LEAST_P = 1e-8, 1e-12


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, nb array of (rank, dst, dist)) in rank order."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "dst", "dist"))).alias("nb"))


def smooth_knn(edges: DataFrame, rho_mode: str = "zero") -> DataFrame:
    """(id, rho, sigma); rho is 0, or with ``rho_mode`` "nearest" the distance to the nearest neighbour."""
    if rho_mode not in ("zero", "nearest"):
        raise ValueError("rho_mode must be zero or nearest")
    dists = F.transform("nb", lambda x: x["dist"])
    rho = F.greatest(F.col("nb")[0]["dist"], F.lit(0.0)) if rho_mode == "nearest" else F.lit(0.0)
    local = neighbours(edges).select("id", dists.alias("d"), rho.alias("rho"))
    return local.select("id", "rho", smooth_sigma(F.col("d"), F.size("d"), F.col("rho")).alias("sigma"))


def symmetrized(directed: DataFrame, weight: str = "w") -> DataFrame:
    """(src, dst, a, b): each unordered pair in both directions, with its weight there and back, 0 where there is none.

    One aggregation by the unordered pair replaces a full outer self-join.
    """
    lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
    pairs = directed.groupBy(lo.alias("lo"), hi.alias("hi")).agg(
        F.coalesce(F.max(F.when(F.col("src") == lo, F.col(weight))), F.lit(0.0)).alias("f"), F.coalesce(F.max(F.when(F.col("src") == hi, F.col(weight))), F.lit(0.0)).alias("r"))
    both = F.explode(F.array(F.struct(F.col("lo").alias("src"), F.col("hi").alias("dst"), F.col("f").alias("a"), F.col("r").alias("b")), F.struct(F.col("hi").alias("src"), F.col("lo").alias("dst"), F.col("r").alias("a"), F.col("f").alias("b"))))
    return pairs.select(both.alias("e")).select("e.*")


def fuzzy_graph(edges: DataFrame, local: DataFrame) -> DataFrame:
    """(src, dst, weight): memberships of both directions joined by a + b - ab; both directions are given."""
    directed = edges.join(local.withColumnRenamed("id", "src"), "src").select("src", "dst", membership(F.col("dist"), F.col("rho"), F.col("sigma")).alias("w"))
    return symmetrized(directed).select("src", "dst", fuzzy_or(F.col("a"), F.col("b")).alias("weight")).where(F.col("weight") > LEAST_WEIGHT)


def degrees(graph: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, degree) of all ids; a degree below 1e-10 counts as 1."""
    found = graph.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("d"))
    d = F.coalesce("d", F.lit(0.0))
    return ids.select("id").join(found, "id", "left").select("id", F.when(d < 1e-10, 1.0).otherwise(d).alias("degree"))


def normalized_laplacian(graph: DataFrame, ids: DataFrame) -> DataFrame:
    """(src, dst, value) of I - D^-1/2 A D^-1/2, diagonal included."""
    d = degrees(graph, ids)
    off = graph.join(d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    off = off.select("src", "dst", (-F.col("weight") / F.sqrt(F.col("ds") * F.col("dd"))).alias("v"))
    one = ids.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("v"))
    return off.union(one).groupBy("src", "dst").agg(F.sum("v").alias("value"))


def laplacian(graph: DataFrame, ids: DataFrame) -> DataFrame:
    """(src, dst, value) of D - A."""
    found = graph.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("d"))
    one = ids.select("id").join(found, "id", "left").select(F.col("id").alias("src"), F.col("id").alias("dst"), F.coalesce("d", F.lit(0.0)).alias("v"))
    return graph.select("src", "dst", (-F.col("weight")).alias("v")).union(one).groupBy("src", "dst").agg(F.sum("v").alias("value"))


def edge_schedule(graph: DataFrame, n_epochs: int, negative_rate: float = 5.0) -> DataFrame:
    """(src, dst, eps, n_firings, eps_negative): an edge fires every max weight / weight epochs, at ceil(m * eps)."""
    top = graph.agg(F.max("weight").alias("top"))
    eps = F.col("top") / F.col("weight")
    out = graph.crossJoin(F.broadcast(top)).select("src", "dst", eps.alias("eps"))  # one row
    return out.select("src", "dst", "eps", F.floor(F.lit(float(n_epochs - 1)) / F.col("eps")).cast("long").alias("n_firings"), (F.col("eps") / F.lit(negative_rate)).alias("eps_negative"))


def firings(schedule: DataFrame) -> DataFrame:
    """(src, dst, epoch) of every firing."""
    return schedule.where("n_firings > 0").select("src", "dst", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("n_firings")), lambda m: F.ceil(m * F.col("eps")))).alias("epoch"))


def tsne_affinities(edges: DataFrame, perplexity: float, n: int) -> DataFrame:
    """(src, dst, p) with p = (p(j|i) + p(i|j)) / 2n, at least 1e-12; both directions are given."""
    local = neighbours(edges).select("id", "nb", F.transform("nb", lambda x: x["dist"]).alias("d"))
    local = local.withColumn("sigma", perplexity_sigma(F.col("d"), perplexity))
    p = F.explode(F.zip_with("nb", conditional_p(F.col("d"), F.col("sigma")), lambda x, y: F.struct(x["dst"].alias("dst"), y.alias("w")))).alias("e")
    directed = local.select(F.col("id").alias("src"), p).select("src", "e.*").where(F.col("w") > LEAST_P)
    return symmetrized(directed).select("src", "dst", F.greatest((F.col("a") + F.col("b")) * F.lit(1.0 / (2.0 * n)) if n else F.lit(0.0), F.lit(LEAST_P)).alias("p"))


def describe(graph: DataFrame, weight: str = "weight") -> dict[str, float]:
    """Edges, nodes with an edge, largest weight."""
    r = graph.agg(F.count(F.lit(1)).alias("nnz"), F.countDistinct("src").alias("nodes"), F.max(weight).alias("top")).collect()[0]
    return r.asDict()


def row_entries(graph: DataFrame, node: int) -> DataFrame:
    """The row of one node, by column."""
    return graph.where(F.col("src") == node).orderBy("dst")


def to_dense(graph: DataFrame, n: int, most: int = 4096):
    """The matrix of a graph over ids 0 to n - 1, for n up to ``most``."""
    import numpy as np

    if n > most:
        raise ValueError(f"a dense matrix is for {most} nodes at most")
    out = np.zeros((n, n))
    got = graph.toArrow()
    out[got.column(0).to_numpy(), got.column(1).to_numpy()] = got.column(2).to_numpy()
    return out
