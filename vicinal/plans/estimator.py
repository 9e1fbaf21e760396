"""Fitted layouts: ``Umap`` is configured, ``fit`` gives an embedding and a ``UmapModel`` that transforms new rows."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import curve_parameters
from ..operators import codec as codes
from ..operators.graph import fuzzy_graph, smooth_knn
from ..operators.initial import COORDINATES, Projection, initial, pca_reduce, rows
from ..operators.knn import knn, matrix, nearest_in_blocks
from ..operators.layout import CLAMP, attraction, epochs_for, layout
from ..operators.sampling import scatter, split
from ..operators.tsne import tsne
from ..sources import triples
from ..sources.points import validate
from ..sources.shared import settled

log = logging.getLogger(__name__)
#: A transform refines each new row so many times.
REFINEMENTS = 30
#: A model's training rows are broadcast; more than this many bytes of them are refused, so fit on a sample.
MODEL_BYTES = 512 << 20
SAMPLINGS = ("random",)


@dataclass(frozen=True)
class Umap:
    """n_epochs 0 is automatic; a seed of None means 42; train_size under 1 fits a sample and transforms the rest."""

    n_neighbors: int = 15
    n_components: int = 2
    min_dist: float = 0.1
    spread: float = 1.0
    learning_rate: float = 1.0
    n_epochs: int = 0
    negative_sample_rate: float = 5.0
    repulsion_strength: float = 1.0
    init: str = "auto"
    metric: str = "euclidean"
    knn_method: str = "auto"
    pca: int | None = None
    random_state: int | None = None
    model_format: str | None = None
    feature_names: tuple[str, ...] | None = None
    train_size: float | None = None
    sampling: str = "random"
    rho_mode: str = "zero"

    def __post_init__(self):
        if self.metric != "euclidean":
            raise ValueError("metric must be euclidean")
        if self.sampling not in SAMPLINGS:
            raise ValueError(f"sampling must be one of {SAMPLINGS}")
        if self.n_components < 1 or self.n_neighbors < 1:
            raise ValueError("n_components and n_neighbors must be at least 1")

    def with_(self, **changes) -> Umap:
        return replace(self, **changes)

    @property
    def seed(self) -> int:
        return 42 if self.random_state is None else self.random_state

    def prepare(self, points: DataFrame) -> tuple[DataFrame, Projection | None]:
        return pca_reduce(points, self.pca) if self.pca else (points, None)

    def _arranged(self, points: DataFrame, graph: DataFrame) -> DataFrame:
        start = initial(self.init, points, graph, self.n_components, self.seed)
        n = points.count()
        return layout(start, graph, epochs_for(n, self.n_epochs), self.min_dist, self.spread, self.learning_rate, self.negative_sample_rate, self.repulsion_strength, self.seed)

    def fit(self, points: DataFrame, edges: DataFrame | None = None) -> tuple[DataFrame, UmapModel]:
        """(embedding, model) of ``points(id, features)``; ``edges(src, dst, rank, dist)`` are found unless given."""
        n, d = validate(points)
        if not n:
            raise ValueError("there are no points")
        names = triples.feature_names(list(self.feature_names) if self.feature_names else None, d)
        used, projection = self.prepare(points)
        used = settled(used, "points")
        found = settled(edges if edges is not None else knn(used, self.n_neighbors, self.knn_method, self.seed), "edges")
        if n <= self.n_neighbors:
            log.warning("only %d neighbours a point are there, %d were asked for", n - 1, self.n_neighbors)
        local = settled(smooth_knn(found, self.rho_mode), "local")
        embedding = self._arranged(used, settled(fuzzy_graph(found, local), "graph"))
        if embedding.agg(F.max(F.size("y"))).collect()[0][0] != self.n_components:
            raise ValueError("the layout lost a component")
        local = used.select("id").join(local, "id", "left").select("id", F.coalesce("sigma", F.lit(1.0)).alias("sigma"), F.coalesce("rho", F.lit(0.0)).alias("rho"))
        rows_ = settled(points.select("id", F.col("features").cast("array<double>").alias("features")).join(embedding, "id").join(local, "id"), "model")
        a, b = curve_parameters(self.min_dist, self.spread)
        params = {"a": a, "b": b, "n_neighbors": self.n_neighbors, "n_components": self.n_components, "min_dist": self.min_dist, "spread": self.spread}
        model = UmapModel(rows_, params, names, projection, {"n": n, "width": d, "explained": projection.explained.tolist() if projection else None})
        if self.model_format:
            model.export_triples(self.model_format)
        return embedding, model

    def fit_transform(self, points: DataFrame) -> DataFrame:
        """(id, y) of all points."""
        if self.train_size is None or self.train_size >= 1:
            return self.with_(model_format=None).fit(points)[0]
        train, rest = split(points, self.train_size, self.seed)
        embedding, model = self.fit(settled(train, "train"))
        return scatter(embedding, model.transform(rest))

    def fit_transform_with_knn(self, points: DataFrame, edges: DataFrame) -> DataFrame:
        return self.fit(points, edges)[0]

    def fit_transform_compressed(self, points: DataFrame, bits: int = 4) -> DataFrame:
        """The layout from low-bit codes alone; init, knn_method and train_size play no part."""
        used, _ = self.prepare(points)
        n, d = validate(used)
        if not n:
            return used.select("id", F.col("features").alias("y"))
        c = codes.Codec(bits, d, self.seed)
        held = settled(codes.encode(used, c), "codes")
        edges = settled(codes.knn_compressed(held, c, max(0, min(self.n_neighbors, n - 1))), "edges")
        graph = settled(codes.fuzzy_compressed(edges), "graph")
        start = codes.pca_compressed(held, c, self.n_components, self.seed)
        return layout(start, graph, epochs_for(n, self.n_epochs), self.min_dist, self.spread, self.learning_rate, self.negative_sample_rate, self.repulsion_strength, self.seed)


@dataclass
class UmapModel:
    """Training rows (id, features, y, sigma, rho) and parameters. With a projection, new rows have the raw width."""

    points: DataFrame
    params: dict
    feature_names: list[str]
    projection: Projection | None = None
    summary: dict = field(default_factory=dict)

    def _arrays(self) -> tuple[np.ndarray, ...]:
        """The training rows for broadcast, after a check of their size."""
        size = self.points.agg(F.coalesce(F.sum(8 * (F.size("features") + F.size("y") + 2)), F.lit(0))).collect()[0][0]
        if size > MODEL_BYTES:
            raise ValueError(f"the model holds {size} bytes of training rows, more than {MODEL_BYTES}; fit it with train_size")
        got = self.points.orderBy("id").select("id", "features", "y", "sigma").toArrow()
        x = matrix(got["features"].combine_chunks())
        if self.projection is not None:
            x = (x - self.projection.mean) @ self.projection.components
        return got["id"].to_numpy(), x, matrix(got["y"].combine_chunks()), got["sigma"].to_numpy()

    def transform(self, points: DataFrame) -> DataFrame:
        """(id, y) of new points. Each row stands alone: no shuffle, no state, so streams work too."""
        ids, x, y, sigma = self._arrays()
        held = points.sparkSession.sparkContext.broadcast((ids, x, y, sigma))
        width, projection = len(self.feature_names), self.projection
        k, a, b = max(1, min(self.params["n_neighbors"], len(ids))), self.params["a"], self.params["b"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tid, tx, ty, ts = held.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = matrix(batch.column(1))
                if q.shape[1] != width:
                    raise ValueError(f"points have {q.shape[1]} features, the model {width}")
                if projection is not None:
                    q = (q - projection.mean) @ projection.components
                for at in range(0, len(q), 4096):
                    part = q[at : at + 4096]
                    _, near, dist = nearest_in_blocks(part, tx, tid, k)
                    place = np.searchsorted(tid, near).reshape(len(part), k)
                    yield rows(batch.column(0).slice(at, len(part)), placed(dist.reshape(len(part), k), ty[place], ts[place], a, b))

        return points.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features")).mapInArrow(run, COORDINATES)

    def triples(self) -> DataFrame:
        spark = self.points.sparkSession
        return triples.model_triples(spark, self.params, self.feature_names).union(triples.point_triples(self.points, self.feature_names, self.params["n_components"]))

    def export_triples(self, path: str) -> None:
        triples.write_triples(self.triples(), path)

    def save(self, path: str) -> None:
        """The whole model: rows as Parquet, parameters and projection as one JSON row."""
        self.points.write.mode("overwrite").parquet(f"{path}/points")
        p = self.projection
        about = {"params": self.params, "names": self.feature_names, "summary": self.summary, "projection": p and {k: v.tolist() for k, v in asdict(p).items()}}
        self.points.sparkSession.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> UmapModel:
        about = json.loads(spark.read.parquet(f"{path}/about").collect()[0][0])
        p = about["projection"]
        return UmapModel(spark.read.parquet(f"{path}/points"), about["params"], about["names"], p and Projection(**{k: np.array(v) for k, v in p.items()}), about["summary"])

    @staticmethod
    def load_triples(spark: SparkSession, path: str) -> UmapModel:
        """A model from its triples; cells that are missing or unreadable are 0. A projection is not part of the format."""
        return UmapModel.from_triples(triples.read_triples(spark, path))

    @staticmethod
    def from_triples(rows_: DataFrame) -> UmapModel:
        about = {r.predicate: r.object for r in rows_.where("subject = 'model'").collect()}
        names = [about[f"feature_{j}"] for j in range(sum(k.startswith("feature_") for k in about))]

        def number(key: str, default: float) -> float:
            try:
                return float(about.get(key, default))
            except ValueError:
                return default

        m = int(number("n_components", 2))
        params = {"a": number("a", 0.0), "b": number("b", 0.0), "n_neighbors": int(number("n_neighbors", 0)), "n_components": m, "min_dist": number("min_dist", 0.0), "spread": number("spread", 0.0)}
        coordinates = [f"umap{j + 1}" for j in range(m)]
        wide = triples.pivot_points(rows_, [*coordinates, "sigma", "rho", *names])
        columns = [F.col("id"), F.array(*[F.col(f"`{n}`") for n in names]).alias("features"), F.array(*[F.col(c) for c in coordinates]).alias("y"), F.col("sigma"), F.col("rho")]
        return UmapModel(settled(wide.select(*columns), "model"), params, names)


def placed(dist: np.ndarray, y: np.ndarray, sigma: np.ndarray, a: float, b: float) -> np.ndarray:
    """Coordinates of new rows from their neighbours' (rows x k x m): a weighted mean, then attraction in turn."""
    rho = dist[:, :1]
    w = np.exp(-np.maximum(dist - rho, 0) / np.maximum(sigma.mean(axis=1, keepdims=True), 1e-10))
    out = (w[:, :, None] * y).sum(axis=1) / np.maximum(w.sum(axis=1), 1e-10)[:, None]
    for step in range(REFINEMENTS):
        rate = 1 - step / REFINEMENTS
        for j in range(dist.shape[1]):
            diff = out - y[:, j]
            g = np.clip(attraction((diff * diff).sum(axis=1), a, b)[:, None] * diff, -CLAMP, CLAMP)
            out = out + rate * w[:, j : j + 1] * g
    return out


@dataclass(frozen=True)
class Tsne:
    perplexity: float = 30.0
    n_iter: int = 1000
    learning_rate: float = 200.0
    early_exaggeration: float = 12.0
    early_exaggeration_iter: int = 250
    theta: float = 0.5
    random_state: int | None = None

    def run(self, points: DataFrame, edges: DataFrame) -> DataFrame:
        """(id, y) for points and their neighbour edges."""
        seed = 42 if self.random_state is None else self.random_state
        return tsne(points, edges, self.perplexity, self.n_iter, self.learning_rate, self.early_exaggeration, self.early_exaggeration_iter, self.theta, 2, seed)

    def run_compressed(self, points: DataFrame, bits: int = 8) -> DataFrame:
        """From codes: 3 * perplexity + 1 neighbours by estimated distance, and decoded vectors for the start."""
        n, d = validate(points)
        c = codes.Codec(bits, d, 42 if self.random_state is None else self.random_state)
        held = settled(codes.encode(points, c), "codes")
        edges = settled(codes.knn_compressed(held, c, min(n - 1, int(3 * self.perplexity) + 1)), "edges")
        return self.run(settled(codes.decode(held, c), "decoded"), edges)
