"""Starting coordinates (id, y): principal components, Laplacian eigenvectors, random; and projection to fewer columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import by_id, normal_by_id
from .knn import matrix
from .moments import moments

#: Largest graph whose Laplacian is solved on the driver, and the largest one solved densely.
SPECTRAL_NODES = 2000
DENSE_NODES, KRYLOV_STEPS = 300, 60
NOISE, RADIUS = 1e-4, 10.0
COORDINATES = "id long, y array<double>"


def rows(ids: np.ndarray | pa.Array, y: np.ndarray) -> pa.RecordBatch:
    flat = pa.array(np.ascontiguousarray(y, dtype=np.float64).ravel())
    cuts = pa.array(np.arange(len(y) + 1, dtype=np.int32) * (y.shape[1] if y.ndim == 2 else 0))
    return pa.RecordBatch.from_arrays([ids if isinstance(ids, (pa.Array, pa.ChunkedArray)) else pa.array(ids, pa.int64()), pa.ListArray.from_arrays(cuts, flat)], ["id", "y"])


@dataclass
class Projection:
    """Centred linear map to principal components, largest variance first."""

    mean: np.ndarray
    components: np.ndarray  # columns
    explained: np.ndarray  # shares of the variance

    def apply(self, points: DataFrame, name: str = "features") -> DataFrame:
        mean, v = self.mean, self.components

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield rows(b.column(0), (matrix(b.column(1)) - mean) @ v)

        out = points.select("id", F.col("features").cast("array<double>").alias("features")).mapInArrow(run, COORDINATES)
        return out.withColumnRenamed("y", name)


def signed(v: np.ndarray) -> np.ndarray:
    """Columns turned so that their largest entry by size is positive."""
    if not v.size:
        return v
    top = np.abs(v).argmax(axis=0)
    return v * np.where(v[top, np.arange(v.shape[1])] < 0, -1.0, 1.0)


def principal(points: DataFrame, m: int) -> Projection:
    """The projection on m components; columns beyond the width are 0."""
    _, mean, cov = moments(points)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:m]
    v = signed(vectors[:, order])
    v = np.pad(v, ((0, 0), (0, m - v.shape[1])))
    total = values.sum()
    share = np.pad(values[order], (0, m - len(order))) / total if total > 0 else np.zeros(m)
    return Projection(mean, v, share)


def pca_reduce(points: DataFrame, m: int) -> tuple[DataFrame, Projection | None]:
    """Points in m principal columns, if m is less than both their width and number; else as they are."""
    r = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("d")).collect()[0]
    if not (r.n and m < r.d and m < r.n):
        return points, None
    p = principal(points, m)
    return p.apply(points), p


def pca_init(points: DataFrame, m: int = 2, seed: int = 42) -> DataFrame:
    """Scores of unit deviation with a little noise by id."""
    p = principal(points, m)
    scores = p.apply(points, "y")
    spread = scores.agg(*[F.stddev_samp(F.col("y")[j]).alias(f"s{j}") for j in range(m)]).collect()[0]
    by = np.array([max(s or 0.0, 1e-10) for s in spread])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids = b.column(0).to_numpy()
                yield rows(ids, matrix(b.column(1)) / by + NOISE * normal_by_id(ids, seed, 2, m))

    return scores.mapInArrow(run, COORDINATES)


def random_init(ids: DataFrame, m: int = 2, seed: int = 42) -> DataFrame:
    """Uniform coordinates by id, scaled so that the largest is 10 in size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = b.column(0).to_numpy()
                yield rows(at, (by_id(at, seed, 3, m) * 2 - 1) * RADIUS)

    drawn = ids.select("id").mapInArrow(run, COORDINATES)
    return rescaled(drawn)


def rescaled(embedding: DataFrame) -> DataFrame:
    top = embedding.agg(F.max(F.array_max(F.transform("y", F.abs))).alias("top")).collect()[0][0] or 0.0
    return embedding.select("id", F.transform("y", lambda v: v * F.lit(RADIUS / top if top > 0 else 1.0)).alias("y"))


def smallest(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int, k: int, seed: int = 42) -> np.ndarray:
    """Eigenvectors of the k smallest eigenvalues of the normalized Laplacian.

    Small graphs are solved densely. Others by a block Krylov space of 2I - L with full orthogonalization, whose largest
    Ritz vectors these are; the block is wider than k, so repeated eigenvalues are found as often as they occur.
    """
    d = np.bincount(src, w, n)
    d = 1 / np.sqrt(np.where(d < 1e-10, 1.0, d))
    v = d[src] * w * d[dst]
    if n <= DENSE_NODES:
        a = np.eye(n)
        np.subtract.at(a, (src, dst), v)
        return np.linalg.eigh(a)[1][:, :k]
    width = k + 3
    block = np.linalg.qr(np.random.Generator(np.random.Philox(seed)).normal(size=(n, width)))[0]
    space, images = [], []
    for _ in range(KRYLOV_STEPS):
        image = block + np.stack([np.bincount(src, v * block[dst, c], n) for c in range(width)], axis=1)
        space.append(block)
        images.append(image)
        basis = np.concatenate(space, axis=1)
        rest = image
        for _ in range(2):
            rest = rest - basis @ (basis.T @ rest)
        block, r = np.linalg.qr(rest)
        if np.abs(np.diag(r)).min() < 1e-12:
            break
    basis, images = np.concatenate(space, axis=1), np.concatenate(images, axis=1)
    _, ritz = np.linalg.eigh((lambda h: (h + h.T) / 2)(basis.T @ images))
    return (basis @ ritz[:, ::-1])[:, :k]


def spectral_init(graph: DataFrame, ids: DataFrame, m: int = 2, seed: int = 42) -> DataFrame:
    """Eigenvectors 2 to m + 1 of the normalized Laplacian, for at most SPECTRAL_NODES ids; else random coordinates."""
    at = np.array(sorted(r[0] for r in ids.select("id").limit(SPECTRAL_NODES + 1).collect()), np.int64)
    if len(at) > SPECTRAL_NODES:
        return random_init(ids, m, seed)
    edges = graph.select("src", "dst", "weight").toArrow()
    src, dst, w = np.searchsorted(at, edges["src"].to_numpy()), np.searchsorted(at, edges["dst"].to_numpy()), edges["weight"].to_numpy()
    vectors = smallest(src, dst, w, len(at), m + 1, seed)
    y = signed(vectors[:, 1 : m + 1])
    y = np.pad(y, ((0, 0), (0, m - y.shape[1]))) + NOISE * normal_by_id(at, seed, 4, m)
    top = np.abs(y).max(initial=0.0)
    y = y * (RADIUS / top) if top > 0 else y
    return ids.sparkSession.createDataFrame(pa.Table.from_batches([rows(at, y)]))


def initial(method: str, points: DataFrame, graph: DataFrame, m: int, seed: int) -> DataFrame:
    """``auto`` is spectral up to SPECTRAL_NODES points and principal components beyond; ``spectral`` is random beyond."""
    if method not in ("auto", "spectral", "pca", "random"):
        raise ValueError("init must be auto, spectral, pca or random")
    if method == "auto":
        method = "spectral" if points.count() <= SPECTRAL_NODES else "pca"
    if method == "spectral":
        return spectral_init(graph, points.select("id"), m, seed)
    return pca_init(points, m, seed) if method == "pca" else random_init(points.select("id"), m, seed)
