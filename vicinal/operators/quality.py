"""How good an embedding or a neighbour table is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import distance
from .knn import knn_external
from .sampling import random_pairs


def pair_distances(embedding: DataFrame, labels: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(same, dist) of all unordered pairs, or of the given (i, j)."""
    rows = embedding.join(labels, "id").select("id", "y", "label")
    a, b = rows.alias("a"), rows.alias("b")
    if pairs is None:
        both = a.join(b, F.col("a.id") < F.col("b.id"))
    else:
        both = pairs.join(a, F.col("i") == F.col("a.id")).join(b, F.col("j") == F.col("b.id"))
    return both.select((F.col("a.label") == F.col("b.label")).alias("same"), distance(F.col("a.y"), F.col("b.y")).alias("dist"))


def separation(embedding: DataFrame, labels: DataFrame, sample: int | None = None, seed: int = 42) -> DataFrame:
    """One row: within, between, their deviations, and ratio = between / within; over all pairs, or ``sample`` drawn."""
    d = pair_distances(embedding, labels, random_pairs(embedding, sample, seed) if sample else None)
    return d.agg(
        F.avg(F.when(F.col("same"), F.col("dist"))).alias("within"), F.avg(F.when(~F.col("same"), F.col("dist"))).alias("between"),
        F.stddev_samp(F.when(F.col("same"), F.col("dist"))).alias("within_sd"), F.stddev_samp(F.when(~F.col("same"), F.col("dist"))).alias("between_sd"),
    ).withColumn("ratio", F.col("between") / F.col("within"))


def percent_of(value: float, baseline: float) -> float:
    return 100.0 * value / baseline


def group_stats(embedding: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, n, and range, mean and deviation of each of the first two coordinates), largest groups first."""
    rows = embedding.join(labels, "id").select("label", F.col("y")[0].alias("y1"), F.col("y")[1].alias("y2"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{name}") for c in ("y1", "y2") for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("sd", F.stddev_samp))])


def group_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


def nn_coherence(embedding: DataFrame, labels: DataFrame, rare) -> DataFrame:
    """One row: share of the rare label's rows whose nearest other row has it too."""
    points = embedding.select("id", F.col("y").alias("features"))
    asked = points.join(labels.where(F.col("label") == rare), "id", "left_semi")
    near = knn_external(asked, points, 1, skip_same=True).join(labels.withColumnRenamed("id", "dst"), "dst")
    return near.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == rare).cast("double")).alias("coherence"))


def label_purity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, n, purity): share of each label's neighbours that carry it."""
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("la")), labels.select(F.col("id").alias("dst"), F.col("label").alias("lb"))
    return edges.join(a, "src").join(b, "dst").groupBy(F.col("la").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("la") == F.col("lb")).cast("double")).alias("purity"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact edges that were found."""
    hit = exact.select("src", "dst").join(found.select("src", "dst"), ["src", "dst"], "left_semi").count()
    total = exact.count()
    return hit / total if total else 1.0


def summary(df: DataFrame) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of each column."""
    return df.summary()


def rank_methods(scores: DataFrame, timings: DataFrame | None = None) -> DataFrame:
    """``scores(method, ratio)`` from best to worst, with each method's time where there is one."""
    out = scores.join(timings.dropDuplicates(["method"]), "method", "left") if timings is not None else scores
    return out.orderBy(F.desc("ratio"), "method")
