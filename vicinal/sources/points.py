"""The points table (id, features), its validation, and numeric CSV in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_points(df: DataFrame, id_col: str, features: str | list[str]) -> DataFrame:
    """(id, features) from an array or vector column, or from numeric columns in the given order."""
    if isinstance(features, str):
        kind = df.schema[features].dataType
        if not isinstance(kind, T.ArrayType):
            from pyspark.ml.functions import vector_to_array

            return df.select(F.col(id_col).cast("long").alias("id"), vector_to_array(features).alias("features"))
        vector = F.col(features).cast("array<double>")
    else:
        vector = F.array(*[F.col(c).cast("double") for c in features])
    return df.select(F.col(id_col).cast("long").alias("id"), vector.alias("features"))


def to_vectors(points: DataFrame) -> DataFrame:
    """(id, features) with features as an ml vector."""
    from pyspark.ml.functions import array_to_vector

    return points.select("id", array_to_vector("features").alias("features"))


def validate(points: DataFrame) -> tuple[int, int]:
    """(number of points, width). Raises for null or repeated ids, null arrays, null, NaN or infinite values, ragged widths."""
    bad = F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    r = points.agg(
        F.count(F.lit(1)).alias("n"), F.count("id").alias("ids"), F.countDistinct("id").alias("distinct"), F.min(F.size("features")).alias("lo"), F.max(F.size("features")).alias("hi"),
        F.sum(F.coalesce(bad, F.lit(True)).cast("long")).alias("bad"),
    ).collect()[0]
    if not r.n:
        return 0, 0
    if r.ids != r.n or r.distinct != r.n:
        raise ValueError("ids must be present and unique")
    if r.bad:
        raise ValueError(f"{r.bad} points have a null, NaN or infinite value")
    if r.lo != r.hi or r.lo < 1:
        raise ValueError(f"points must have one width, found {r.lo} to {r.hi}")
    return r.n, r.lo


def read_numeric_csv(spark: SparkSession, path: str, columns: list[str] | None = None, id_col: str | None = None) -> DataFrame:
    """Points from a CSV file with a header line and numeric cells; anything else in a cell fails the read.

    Without ``id_col`` a point's id is its line's position, counted from 0 in file order.
    """
    head = spark.read.option("header", True).csv(path).columns
    names = columns or [c for c in head if c != id_col]
    rows = spark.read.schema(T.StructType([T.StructField(c, T.LongType() if c == id_col else T.DoubleType()) for c in head])).option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("header", True).csv(path)
    return to_points(rows if id_col else with_position(rows, "id"), id_col or "id", names)


def read_headerless_csv(spark: SparkSession, path: str, width: int) -> DataFrame:
    rows = spark.read.schema(T.StructType([T.StructField(f"V{i + 1}", T.DoubleType()) for i in range(width)])).option("mode", "FAILFAST").csv(path)
    return to_points(with_position(rows, "id"), "id", [f"V{i + 1}" for i in range(width)])


def with_position(df: DataFrame, name: str) -> DataFrame:
    """A gapless position column in partition order: partition sizes first, then offsets within."""
    part = df.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    sizes = {r["_p"]: r["n"] for r in part.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    base, at = {}, 0
    for p in sorted(sizes):
        base[p] = at
        at += sizes[p]
    offset = F.element_at(F.create_map(*[x for p, b in base.items() for x in (F.lit(p), F.lit(b))]), F.col("_p")) if base else F.lit(0)
    return part.withColumn(name, (offset + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_p", "_m")


def read_if(spark: SparkSession, path: str, read):
    """``read(spark, path)``, or None where the path does not exist."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return read(spark, path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def write_embedding_csv(embedding: DataFrame, path: str, labels: DataFrame | None = None) -> None:
    """Columns V1, V2, ... in id order in one file; with ``labels(id, label)`` a label column for plots."""
    width = embedding.agg(F.max(F.size("y"))).collect()[0][0] or 2
    rows = embedding.join(labels, "id", "left") if labels is not None else embedding
    columns = [F.col("y")[i].alias(f"V{i + 1}") for i in range(width)] + (["label"] if labels is not None else [])
    rows.orderBy("id").select(*columns).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_timings_csv(spark: SparkSession, timings: dict[str, float], path: str) -> None:
    spark.createDataFrame(list(timings.items()), "method string, time double").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def ramp(spark: SparkSession, n: int, d: int) -> DataFrame:
    """Synthetic points i * j / n + sin(0.1 i)."""
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: F.col("id") * j / F.lit(float(n)) + F.sin(F.col("id") * 0.1)).alias("features"))


def waves(spark: SparkSession, n: int, d: int) -> DataFrame:
    """Synthetic points i * j + sin(i)."""
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: (F.col("id") * j).cast("double") + F.sin(F.col("id").cast("double"))).alias("features"))
