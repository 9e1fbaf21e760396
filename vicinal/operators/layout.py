"""Layout by stochastic gradient descent on a weighted graph.

Points are put in places along a curve through their starting coordinates and cut into blocks of ``BLOCK`` places. A block
owns the moves of its points: the edges at them, as heads and as tails, in one row of arrays. Coordinates are broadcast
after a check of their size; each job runs ``ROUND`` epochs of all blocks, which see their own moves at once and other
blocks' from the next job on, and returns n rows. One block needs one job. Beyond ``COORDINATE_BYTES`` coordinates are a
table, and each epoch a join (``distributed``).

Within a block updates are synchronous within ``BATCHES`` batches of an epoch's firing edges. Firings follow
``graph.edge_schedule``, and draws depend on (seed, epoch, batch, block) only, so a layout is the same for any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import curve_parameters
from ..sources.shared import dropped, settled
from .graph import edge_schedule
from .initial import COORDINATES, rows
from .sampling import positions

BLOCK, ROUND, BATCHES = 6_400, 16, 4
COORDINATE_BYTES = 256 << 20
CLAMP, LEAST = 4.0, 2.0**-23
ARRAYS, KINDS = ["block", "src", "dst", "eps", "eps_negative", "pull"], (np.int64, np.int64, np.float64, np.float64, np.float32)
EDGES = "block int, src binary, dst binary, eps binary, eps_negative binary, pull binary"


def epochs_for(n: int, asked: int = 0) -> int:
    """The asked number, or 500 under 10,000 points and 200 from there."""
    return asked or (500 if n < 10_000 else 200)


def power(x: np.ndarray, b: float) -> np.ndarray:
    """x ** b of positive numbers; in single precision several times faster than np.power."""
    return np.exp(x.dtype.type(b) * np.log(x))


def attraction(d2: np.ndarray, a: float, b: float) -> np.ndarray:
    d2 = np.maximum(d2, d2.dtype.type(LEAST))
    p = power(d2, b)
    return -2 * a * b * p / (d2 * (a * p + 1))


def repulsion(d2: np.ndarray, a: float, b: float, strength: float) -> np.ndarray:
    return 2 * strength * b / ((0.001 + d2) * (a * power(np.maximum(d2, d2.dtype.type(1e-30)), b) + 1))


@dataclass(frozen=True)
class Descent:
    """What all epochs have in common."""

    n: int
    epochs: int
    a: float
    b: float
    rate: float = 1.0
    strength: float = 1.0
    seed: int = 42

    def run(self, columns: list[np.ndarray], lo: int, hi: int, edges: tuple[np.ndarray, ...], first: int, last: int) -> list[np.ndarray]:
        """The coordinates of places lo to hi after epochs ``first`` to ``last``; ``columns`` are single precision, and
        their part from lo to hi is written. ``edges``: place, other place, period, period of draws, pull; by place."""
        src, dst, eps, neg, pull = edges
        own = [x[lo:hi] for x in columns]
        count = np.floor((first - 1) / eps).astype(np.int64) + 1  # the next firing's number
        due = count * eps

        def drawn(t: np.ndarray | int, period: np.ndarray) -> np.ndarray:
            return np.maximum(np.floor(t / period) - 1, 0)

        for t in range(max(first, 1), last):
            alpha = np.float32(self.rate * (1 - t / self.epochs))
            most = np.float32(CLAMP) * alpha
            on = np.flatnonzero(due <= t)
            before = np.ceil((count[on] - 1) * eps[on])
            times_on = (drawn(t, neg[on]) - drawn(before, neg[on])).astype(np.int64)
            rng = np.random.Generator(np.random.Philox(key=[self.seed & (2**64 - 1), t << 40 | lo]))
            others = rng.permutation(self.n)  # draws are a stretch of a permutation, from a place of its own
            for k in range(BATCHES):
                part, times = on[k::BATCHES], times_on[k::BATCHES]
                if not len(part):
                    continue
                i, j = src[part], dst[part]
                here = [x.take(i) for x in columns]
                diff = [x - y.take(j) for x, y in zip(here, columns)]
                g = attraction(sum(d * d for d in diff), self.a, self.b) * alpha
                moves = []
                for d in diff:
                    d *= g
                    np.clip(d, -most, most, out=d)
                    d *= pull[part]
                    moves.append(d)
                draws = int(times.sum())
                if draws:
                    drawing = np.flatnonzero(times)
                    starts = np.cumsum(times[drawing]) - times[drawing]
                    stretch = np.arange(draws) + int(rng.integers(self.n))
                    away = [np.repeat(x, times) - y.take(others).take(stretch, mode="wrap") for x, y in zip(here, columns)]
                    r = repulsion(sum(e * e for e in away), self.a, self.b, self.strength) * alpha
                    for d, e in zip(moves, away):  # a point drawn for itself is at no distance, and does not move
                        e *= r
                        np.clip(e, -most, most, out=e)
                        d[drawing] += np.add.reduceat(e, starts)
                for x, d in zip(own, moves):
                    x += np.bincount(i - lo, d, hi - lo).astype(np.float32)
            count[on] += 1
            due[on] = count[on] * eps[on]
        return own


def incident(src: np.ndarray, dst: np.ndarray, eps: np.ndarray, neg: np.ndarray, pull: np.ndarray) -> tuple[np.ndarray, ...]:
    """Edges by place, with the rows of one (place, other place, period) as one row that pulls as often."""
    by = np.argsort(neg, kind="stable")
    by = by[np.argsort((src.astype(np.int64) << 32 | dst)[by], kind="stable")]
    src, dst, eps, neg, pull = src[by], dst[by], eps[by], neg[by], pull[by]
    new = np.ones(len(src), bool)
    new[1:] = (src[1:] != src[:-1]) | (dst[1:] != dst[:-1]) | (eps[1:] != eps[:-1])
    at = np.flatnonzero(new)
    total = np.add.reduceat(pull, at) if len(at) else pull
    return src[at].astype(np.int64), dst[at].astype(np.int64), eps[at], neg[at], total.astype(np.float32)


def optimize(y: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, epochs: int, a: float, b: float, rate: float = 1.0, negative_rate: float = 5.0, strength: float = 1.0, seed: int = 42) -> np.ndarray:
    """Coordinates after all epochs, centred, with all points in one block."""
    n = len(y)
    if not len(src) or n < 2:
        return y - y.mean(axis=0) if n else y
    eps = weight.max() / weight
    neg = eps / negative_rate if negative_rate > 0 else np.full(len(eps), np.inf)
    edges = incident(np.append(src, dst), np.append(dst, src), np.append(eps, eps), np.append(neg, np.full(len(neg), np.inf)), np.ones(2 * len(src)))
    columns = [np.ascontiguousarray(y[:, c], dtype=np.float32) for c in range(y.shape[1])]
    own = Descent(n, epochs, a, b, rate, strength, seed).run(columns, 0, n, edges, 0, epochs)
    out = np.stack(own, axis=1).astype(np.float64)
    return out - out.mean(axis=0)


def curve(y: np.ndarray) -> np.ndarray:
    """An order of points in which near ones are mostly near: by the interleaved bits of the first two coordinates."""
    low = y.min(axis=0)
    unit = ((y - low) / np.maximum(y.max(axis=0) - low, 1e-300) * 65535).astype(np.uint64)[:, :2]
    key = np.zeros(len(y), np.uint64)
    for bit in range(16):
        for c in range(unit.shape[1]):
            key |= (unit[:, c] >> np.uint64(bit) & np.uint64(1)) << np.uint64(2 * bit + c)
    return np.argsort(key, kind="stable")


def layout(embedding: DataFrame, graph: DataFrame, epochs: int, min_dist: float = 0.1, spread: float = 1.0, rate: float = 1.0, negative_rate: float = 5.0, strength: float = 1.0, seed: int = 42, most: int = COORDINATE_BYTES) -> DataFrame:
    """``embedding(id, y)`` moved along ``graph(src, dst, weight)``; ids without an edge are moved by centring only."""
    a, b = curve_parameters(min_dist, spread)
    spark = embedding.sparkSession
    embedding = settled(embedding, "start")
    r = embedding.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("y")).alias("m")).collect()[0]
    n, m = r.n, r.m or 2
    if not n:
        return embedding
    schedule = settled(edge_schedule(graph, epochs, negative_rate), "schedule")
    if 8 * n * (m + 2) > most:
        return distributed(embedding, schedule, n, m, epochs, a, b, rate, negative_rate, strength, seed)
    got = embedding.orderBy("id").toArrow()
    ids, y = got["id"].to_numpy(), got["y"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
    order = curve(y)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    columns = [np.ascontiguousarray(y[order, c], dtype=np.float32) for c in range(m)]
    block = -(-n // max(1, round(n / BLOCK)))
    held = spark.sparkContext.broadcast((ids, place))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Both ends' rows of each edge: for each block of a batch's edges one row of arrays."""
        ids, place = held.value
        for batch in batches:
            s, d = (place[np.searchsorted(ids, batch.column(c).to_numpy())].astype(np.int64) for c in (0, 1))
            eps, neg = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            both = np.append(s, d), np.append(d, s), np.append(eps, eps), np.append(neg, np.full(len(neg), np.inf)), np.ones(2 * len(s), np.float32)
            by = np.argsort(both[0] // block, kind="stable")
            cuts = np.append(0, np.cumsum(np.bincount(both[0] // block)))
            full = [k for k in range(len(cuts) - 1) if cuts[k] < cuts[k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array([x[by[cuts[k] : cuts[k + 1]]].tobytes() for k in full], pa.binary()) for x in both)], ARRAYS)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[bytes]]] = {}
        for batch in batches:
            for k, *raw in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(k, []).append(raw)
        for k, parts in held.items():
            found = incident(*(np.frombuffer(b"".join(x), t) for x, t in zip(zip(*parts), KINDS)))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in found)], ARRAYS)

    blocks = -(-n // block)
    ends = schedule.select("src", "dst", "eps", "eps_negative").mapInArrow(placed, EDGES)
    edges = settled(ends.repartitionById(blocks, "block").mapInArrow(packed, EDGES), "blocks").repartitionById(blocks, "block").persist()
    descent = Descent(n, epochs, a, b, rate, strength, seed)
    turns = [(0, epochs)] if blocks == 1 else [(t, min(t + ROUND, epochs)) for t in range(0, epochs, ROUND)]
    try:
        for first, last in turns:
            here = spark.sparkContext.broadcast(columns)

            def moved(batches: Iterator[pa.RecordBatch], here=here, first=first, last=last) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for k, *arrays in zip(*batch.columns):
                        lo = k.as_py() * block
                        hi = min(n, lo + block)
                        now = descent.run([x.copy() for x in here.value], lo, hi, tuple(np.frombuffer(x.as_py(), t) for x, t in zip(arrays, KINDS)), first, last)
                        yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int64()), pa.array([np.stack(now).tobytes()], pa.binary())], ["lo", "y"])

            found = edges.mapInArrow(moved, "lo long, y binary").toArrow()  # a row for each block, the coordinates in all
            columns = [x.copy() for x in columns]
            for lo, raw in zip(found["lo"].to_pylist(), found["y"].to_pylist()):
                now = np.frombuffer(raw, np.float32).reshape(m, -1)
                for x, part in zip(columns, now):
                    x[lo : lo + len(part)] = part
            here.destroy()
    finally:
        edges.unpersist()
        held.destroy()
    out = np.stack(columns, axis=1).astype(np.float64)
    out -= out.mean(axis=0)
    return settled(spark.createDataFrame(pa.Table.from_batches([rows(ids, out[place])])), "layout")


def distributed(embedding: DataFrame, schedule: DataFrame, n: int, width: int, epochs: int, a: float, b: float, rate: float = 1.0, negative_rate: float = 5.0, strength: float = 1.0, seed: int = 42) -> DataFrame:
    """The same descent over tables: one batch an epoch, firings by closed form, draws by hash of (epoch, edge)."""
    y = settled(embedding.join(positions(embedding), "id"), "coordinates")
    edges = settled(schedule.repartition("src").select("src", "dst", "eps"), "edges")

    def pull(g: str, x: str, z: str) -> str:
        return f"transform({x}, (v, c) -> greatest(least({g} * (v - {z}[c]), {CLAMP}D), -{CLAMP}D))"

    for t in range(1, epochs):
        alpha = rate * (1 - t / epochs)
        # the m-th firing is at epoch ceil(m * eps): some m has m * eps in (t - 1, t]
        on = edges.where(F.floor(F.lit(float(t)) / F.col("eps")) > F.floor(F.lit(float(t - 1)) / F.col("eps")))
        k = max(0, round(negative_rate))
        on = on.join(y.select(F.col("id").alias("src"), F.col("y").alias("yi")), "src").join(y.select(F.col("id").alias("dst"), F.col("y").alias("yj")), "dst")
        d2 = "aggregate(zip_with(yi, yj, (p, q) -> (p - q) * (p - q)), 0D, (s, v) -> s + v)"
        on = on.withColumn("d", F.expr(f"greatest({d2}, {LEAST}D)")).withColumn("g", F.expr(f"-2D * {a}D * {b}D * power(d, {b}D) / (d * ({a}D * power(d, {b}D) + 1D)) "))
        move = on.withColumn("v", F.expr(pull("g", "yi", "yj")))
        moves = move.select(F.col("src").alias("id"), "v").union(move.select("dst", F.transform("v", lambda v: -v)))
        if k:
            drawn = on.select("src", "dst", "yi", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("c")).withColumn("at", F.pmod(F.xxhash64("src", "dst", "c", F.lit(t), F.lit(seed)), F.lit(n)))
            away = drawn.join(y.select("at", F.col("id").alias("other"), F.col("y").alias("yj")), "at").where("other != src")
            away = away.withColumn("d", F.expr(d2)).withColumn("g", F.expr(f"{2 * strength * b}D / ((0.001D + d) * ({a}D * power(d, {b}D) + 1D))"))
            moves = moves.union(away.select(F.col("src").alias("id"), F.expr(pull("g", "yi", "yj")).alias("v")))
        total = moves.groupBy("id").agg(*[F.sum(F.col("v")[c]).alias(f"v{c}") for c in range(width)])
        step = [(F.col("y")[c] + F.lit(alpha) * F.coalesce(F.col(f"v{c}"), F.lit(0.0))) for c in range(width)]
        old, y = y, settled(y.join(total, "id", "left").select("id", F.array(*step).alias("y"), "at"), "coordinates")
        dropped(old)
    mean = y.agg(*[F.avg(F.col("y")[c]) for c in range(width)]).collect()[0]
    return y.select("id", F.array(*[F.col("y")[c] - F.lit(mean[c]) for c in range(width)]).alias("y"))
