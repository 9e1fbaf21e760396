"""Models as subject-predicate-object rows: all text, one subject for the model and one for each point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The format's columns; subjects are "model" and "point_<id>"; a point's predicates are umap1, umap2, ...,
# sigma, rho and the feature names; the model's are its parameters and feature_0, feature_1, ...
SCHEMA = "subject string, predicate string, object string"
#: Predicates of a point that no feature may be called.
RESERVED = {"sigma", "rho"}


def feature_names(names: list[str] | None, d: int) -> list[str]:
    """The names, or feature_0 and so on. Raises where they would clash with a point's other predicates, or break a line."""
    names = list(names) if names else [f"feature_{j}" for j in range(d)]
    if len(names) != d or len(set(names)) != d:
        raise ValueError("feature names must be distinct, one for each column")
    for x in names:
        if x in RESERVED or x.startswith("umap") and x[4:].isdigit() or any(c in x for c in ",\n\r"):
            raise ValueError(f"feature name {x!r} is reserved or breaks the format")
    return names


def point_triples(points: DataFrame, names: list[str], m: int) -> DataFrame:
    """Triples of ``points(id, features, y, sigma, rho)``: m + 2 + d rows a point."""
    cells: list[tuple[str, Column]] = [(f"umap{j + 1}", F.col("y")[j]) for j in range(m)] + [("sigma", F.col("sigma")), ("rho", F.col("rho"))] + [(x, F.col("features")[j]) for j, x in enumerate(names)]
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("predicate"), o.cast("string").alias("object")) for p, o in cells]))
    return points.select(F.concat(F.lit("point_"), F.col("id").cast("string")).alias("subject"), rows.alias("t")).select("subject", "t.*")


def model_triples(spark: SparkSession, params: dict[str, float], names: list[str]) -> DataFrame:
    rows = [("model", k, str(v)) for k, v in params.items()] + [("model", f"feature_{j}", x) for j, x in enumerate(names)]
    return spark.createDataFrame(rows, SCHEMA)


def write_triples(triples: DataFrame, path: str) -> None:
    """Plain comma-separated lines under a header; nothing is quoted, so objects may hold commas."""
    triples.select(F.concat_ws(",", "subject", "predicate", "object").alias("value")).write.mode("overwrite").option("header", True).option("quote", "").option("escape", "").option("sep", "\x01").csv(path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Lines with at least three parts; the object keeps its commas. Header lines are left out."""
    parts = F.split("value", ",", 3)
    return spark.read.text(path).where(F.size(parts) >= 3).select(parts[0].alias("subject"), parts[1].alias("predicate"), parts[2].alias("object")).where("not (subject = 'subject' and predicate = 'predicate')")


def pivot_points(triples: DataFrame, predicates: list[str]) -> DataFrame:
    """(id, one column for each predicate) of the points; missing and unreadable cells are 0."""
    own = triples.where(F.col("subject").startswith("point_")).select(F.expr("try_cast(substring(subject, 7) as long)").alias("id"), "predicate", F.expr("try_cast(object as double)").alias("x"))
    wide = own.where("id is not null").groupBy("id").pivot("predicate", predicates).agg(F.first("x"))
    return wide.select("id", *[F.coalesce(F.col(f"`{p}`"), F.lit(0.0)).alias(p) for p in predicates])
