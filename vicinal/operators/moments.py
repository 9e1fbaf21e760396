"""Column means and covariances of points. Each task sends one partial sum; rows do not travel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import matrix


def column_means(points: DataFrame) -> DataFrame:
    """(pos, mean)."""
    return points.select(F.posexplode("features").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"))


def mean_vector(points: DataFrame) -> tuple[int, np.ndarray]:
    """Number of points and their mean, from one partial sum a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                n, total = n + len(x), x.sum(axis=0) + (0 if total is None else total)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array([n] * len(total), pa.int64()), pa.array(total)], ["pos", "n", "s"])

    sums = points.select(F.col("features").cast("array<double>")).mapInArrow(run, "pos long, n long, s double")
    got = sorted((r.pos, r.n, r.s) for r in sums.groupBy("pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect())  # one row a column
    return (got[0][1] if got else 0), np.array([s / n for _, n, s in got])


def covariance(points: DataFrame) -> DataFrame:
    """(p, q, cov) of the sample covariance, both triangles."""
    n, mean = mean_vector(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean), len(mean)))
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0)) - mean
                total += x.T @ x
        p, q = np.divmod(np.arange(total.size), max(1, len(mean)))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(q.astype(np.int32)), pa.array(total.ravel())], ["p", "q", "s"])

    sums = points.select(F.col("features").cast("array<double>")).mapInArrow(run, "p int, q int, s double")
    return sums.groupBy("p", "q").agg((F.sum("s") / F.lit(float(max(1, n - 1)))).alias("cov"))


def moments(points: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance, d * d numbers on the driver."""
    n, mean = mean_vector(points)
    cov = np.zeros((len(mean), len(mean)))
    for r in covariance(points).collect() if n else []:
        cov[r.p, r.q] = r["cov"]
    return n, mean, cov
