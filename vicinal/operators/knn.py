"""k nearest neighbours: exact by expressions or by blocks, approximate by cells, for own rows or for queries.

Edges are (src, dst, rank, dist); ties go to the smaller id. The exact operators measure every pair, as they must. They
do it for blocks of rows, whose pairs are compared by a matrix product in Arrow batches; only k rows a query leave a task.
The data side is broadcast if its counted size is within ``BROADCAST_BYTES``; else blocks meet in a distributed product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import by_id, nearest
from ..functions.vectors import distance
from ..sources.shared import settled

BLOCK = 1024
BROADCAST_BYTES = 64 << 20
#: Up to this many points "auto" is exact.
EXACT_POINTS = 50_000
EDGES = "src long, dst long, dist double"


def ranked(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each src, with ranks from 1."""
    w = Window.partitionBy("src").orderBy("dist", "dst")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("src", "dst", "rank", "dist")


def _pairs(points: DataFrame, k: int) -> DataFrame:
    a, b = points.alias("a"), points.alias("b")
    pairs = a.join(b, F.col("a.id") != F.col("b.id")).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"), distance(F.col("a.features"), F.col("b.features")).alias("dist"))
    return ranked(pairs, k)


#: Up to this many points the expression form measures all pairs; bit planes of rounded coordinates, and of a first look.
PLAIN_POINTS, PLANES, FIRST_PLANES = 2_000, 6, 3
#: Products of planes a pair, so wider points get fewer planes: the join's generated method must stay under 8,000 bytes of
#: bytecode, as the JVM does not compile longer ones (5,740 with 36 and 9 products; 9,002 with 64 and 16 took 20 times as long).
PRODUCTS = 36


def knn_expression(points: DataFrame, k: int) -> DataFrame:
    """The exact self-join in Column expressions: they look at every pair and measure what they rank.

    Pairs are looked at on coordinates that are rounded to 2^6 steps, whose distance is a sum of bit counts; by the triangle
    inequality it differs from the true one by both rounding errors at most. Pairs that are surely beyond a point's bound are
    not measured. The bounds are the block form's k-th distances; any k distances of a point would do, only slower.
    """
    odd = F.exists("features", lambda x: x.isNull() | F.isnan(x))
    r = points.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("features")).alias("lo"), F.max(F.size("features")).alias("d"), F.count_if(F.coalesce(odd, F.lit(True)) | F.col("id").isNull()).alias("odd"), F.max(F.array_max(F.transform("features", F.abs))).alias("top")).collect()[0]
    if r.n <= PLAIN_POINTS or r.odd or r.lo != r.d or not r.d or k < 1 or not 1e-100 < r.top < 1e100:
        return _pairs(points, k)
    words = -(-r.d // 64)
    planes = max(1, min(PLANES, int((PRODUCTS / words) ** 0.5)))
    first = min(FIRST_PLANES, planes)
    held = settled(_planes(points, r.top, words, planes, first), "planes")
    small = r.n * (8 * r.d + 100) <= BROADCAST_BYTES
    steps = [2 * r.top / 2**p for p in (first, planes)]
    found = knn_exact(points, k).groupBy(F.col("src").alias("id")).agg(F.max("dist").alias("bound"))
    bound = settled(found, "bounds")
    return ranked(_looked_at(held, held, bound, words, planes, first, steps, small), k)


def _planes(points: DataFrame, top: float, words: int, planes: int, first: int) -> DataFrame:
    """(id, features, w*, n*, e*): bit planes of the coordinates' steps as 64-bit words, the steps' squared norms, rounding errors."""
    out = points.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features"))
    for name, p in (("f", first), ("p", planes)):
        step = 2 * top / 2**p
        out = out.withColumn(name, F.transform("features", lambda x: F.least(F.greatest(F.floor((x + F.lit(top)) / F.lit(step)), F.lit(0)), F.lit(2**p - 1)).cast("long")))
        error = F.aggregate(F.zip_with("features", name, lambda x, u: (x - (u + F.lit(0.5)) * F.lit(step) + F.lit(top)) * (x - (u + F.lit(0.5)) * F.lit(step) + F.lit(top))), F.lit(0.0), lambda s, v: s + v)
        out = out.withColumn(f"n{name}", F.aggregate(name, F.lit(0.0), lambda s, u: s + u * u)).withColumn(f"e{name}", F.sqrt(error) * (1 + 1e-9) + F.lit(1e-9 * top))
    # the first look's steps are the upper bits of the others
    words_ = [F.expr(f"aggregate(transform(slice(p, {64 * w + 1}, 64), (u, i) -> shiftleft(shiftright(u, {b}) & 1L, i)), 0L, (s, v) -> s | v)").alias(f"w{w}_{b}") for w in range(words) for b in range(planes)]
    return out.select("id", "features", "nf", "ef", "np", "ep", *words_)


def _looked_at(a: DataFrame, b: DataFrame, bound: DataFrame, words: int, planes: int, first: int, steps: list[float], small: bool) -> DataFrame:
    """(src, dst, dist) of the pairs that may be within the bound of src."""

    def side(t: DataFrame, mark: str) -> DataFrame:  # no value is null, which Spark cannot know of a file
        return t.select("id", "features", *[F.coalesce(c, F.lit(0).cast(k)).alias(c) for c, k in t.dtypes if c not in ("id", "features")]).select([F.col(c).alias(f"{mark}_{c}") for c in t.columns])

    q = side(a.join(bound, "id"), "a")

    def within(name: str, step: float, lowest: int) -> str:
        size = planes - lowest
        dot = " + ".join(f"cast(bit_count(a_w{w}_{i + lowest} & b_w{w}_{j + lowest}) as double) * {2.0 ** (i + j)}D" for w in range(words) for i in range(size) for j in range(size))
        far = f"(a_bound + a_e{name} + b_e{name})"
        return f"(a_n{name} + b_n{name} - 2D * ({dot})) * {step * step!r}D <= {far} * {far} * {1 + 1e-9!r}D"

    other = side(b, "b")
    looks = " and ".join(within(n, s, planes - p) for n, s, p in (("f", steps[0], first), ("p", steps[1], planes)))
    pairs = q.join(F.broadcast(other) if small else other, F.expr(f"a_id != b_id and {looks}"))
    return pairs.select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), distance(F.col("a_features"), F.col("b_features")).alias("dist"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def blocks(points: DataFrame, by: str | None = None) -> DataFrame:
    """(block, ids, data) with up to BLOCK points in a row; with ``by``, points of one value of that column each."""

    def pack(ids: np.ndarray, x: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(group, kind="stable")
        ids, x, group = ids[order], x[order], group[order]
        cuts = [c for a, b in zip(*_edges(group)) for c in range(a, b, BLOCK)]
        ends = [min(c + BLOCK, e) for a, e in zip(*_edges(group)) for c in range(a, e, BLOCK)]
        return pa.RecordBatch.from_arrays(
            [pa.array([int(group[c]) for c in cuts], pa.int64()), pa.array([ids[c:e].tobytes() for c, e in zip(cuts, ends)], pa.binary()), pa.array([x[c:e].tobytes() for c, e in zip(cuts, ends)], pa.binary())],
            ["block", "ids", "data"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), matrix(b.column(1)), b.column(2).to_numpy()))
                n += b.num_rows
            if n >= 16 * BLOCK:
                yield pack(*(np.concatenate([h[i] for h in held]) for i in range(3)))
                held, n = [], 0
        if held:
            yield pack(*(np.concatenate([h[i] for h in held]) for i in range(3)))

    group = F.col(by).cast("long") if by else F.lit(0).cast("long")
    return points.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features"), group.alias("g")).mapInArrow(run, "block long, ids binary, data binary")


def _edges(group: np.ndarray) -> tuple[list[int], list[int]]:
    cut = (np.flatnonzero(np.diff(group)) + 1).tolist()
    return [0, *cut], [*cut, len(group)]


def _compare(k: int, skip_same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the best of one query block so far
        last = None
        for b in batches:
            for qi, qx, xi, xx in zip(*(b.column(i) for i in range(4))):
                key = qi.as_py()
                if key != last:
                    if held is not None:
                        yield _batch(held)
                    held, last = None, key
                    qid = np.frombuffer(key, np.int64)
                    q = np.frombuffer(qx.as_py(), np.float64).reshape(len(qid), -1)
                xid = np.frombuffer(xi.as_py(), np.int64)
                row, dst, dist = nearest(q, qid, np.frombuffer(xx.as_py(), np.float64).reshape(len(xid), -1), xid, k, skip_same, _bound(held, qid, k))
                found = (qid[row], dst, dist)
                held = _best(found if held is None else tuple(np.concatenate(p) for p in zip(held, found)), k)
        if held is not None:
            yield _batch(held)

    return run


def _best(edges: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    src, dst, dist = edges
    by = np.lexsort((dst, dist, src))
    src, dst, dist = src[by], dst[by], dist[by]
    same = np.zeros(len(src), bool)
    same[1:] = (src[1:] == src[:-1]) & (dst[1:] == dst[:-1])  # a neighbour met in two blocks
    src, dst, dist = src[~same], dst[~same], dist[~same]
    keep = np.arange(len(src)) - np.searchsorted(src, src) < k
    return src[keep], dst[keep], dist[keep]


def _bound(held: tuple[np.ndarray, ...] | None, ids: np.ndarray, k: int) -> np.ndarray | None:
    """The k-th distance so far of each id, once all have k; ``held`` is by id, as ``_best`` gives it."""
    if held is None or len(held[0]) != k * len(ids):
        return None
    out = np.empty(len(ids))
    out[np.argsort(ids)] = held[2].reshape(-1, k)[:, -1]
    return out


def nearest_in_blocks(q: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``nearest`` of all rows of ``x``, in pieces of both sides: what is held grows with k rows a query, not with x."""
    found, wide = [], 8 * BLOCK
    for at in range(0, len(q), BLOCK // 4):
        part, held = q[at : at + BLOCK // 4], None
        for b in range(0, len(x), wide):
            now = nearest(part, np.arange(len(part)), x[b : b + wide], xid[b : b + wide], k, False, _bound(held, np.arange(len(part)), k))
            held = now if held is None else _best(tuple(np.concatenate(p) for p in zip(held, now)), k)
        if held is not None:
            found.append((held[0] + at, *held[1:]))
    return tuple(np.concatenate(p) for p in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _batch(edges: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in edges], ["src", "dst", "dist"])


def _small(points: DataFrame) -> bool:
    r = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("d")).collect()[0]
    return r.n * (r.d or 0) * 8 <= BROADCAST_BYTES


def knn_external(queries: DataFrame, points: DataFrame, k: int, skip_same: bool = False) -> DataFrame:
    """The exact k nearest ``points`` of each query; with ``skip_same``, a point of the query's id is left out."""
    small = _small(points)
    data = blocks(points).select(F.col("ids").alias("xi"), F.col("data").alias("xx"))
    data = F.broadcast(data) if small else settled(data, "blocks")
    asked = blocks(queries).select(F.col("ids").alias("qi"), F.col("data").alias("qx"))
    pairs = (asked if small else settled(asked, "queries")).crossJoin(data)
    return ranked(pairs.mapInArrow(_compare(k, skip_same), EDGES), k)


def knn_exact(points: DataFrame, k: int) -> DataFrame:
    """The exact self-join; fewer than k neighbours are given where there are no more."""
    return knn_external(points, points, k, skip_same=True)


def rerank(candidates: DataFrame, points: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """The k nearest of given (src, dst) candidates, by exact distance."""
    a = (queries if queries is not None else points).select(F.col("id").alias("src"), F.col("features").alias("x"))
    b = points.select(F.col("id").alias("dst"), F.col("features").alias("y"))
    return ranked(candidates.select("src", "dst").distinct().join(a, "src").join(b, "dst").select("src", "dst", distance(F.col("x"), F.col("y")).alias("dist")), k)


def centres(points: DataFrame, cells: int, seed: int = 42, sample: int = 20_000, rounds: int = 10) -> np.ndarray:
    """Cell centres by Lloyd's rounds over at most ``sample`` points."""
    n = points.count()
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    x = matrix(points.where(draw < min(1.0, sample / max(1, n))).select("id", F.col("features").cast("array<double>").alias("features")).orderBy("id").limit(2 * sample).toArrow()["features"].combine_chunks())
    if not len(x):
        return x
    c = x[np.argsort(by_id(np.arange(len(x)), seed, 1, 1)[:, 0], kind="stable")[:cells]]
    for _ in range(rounds):
        own = ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        n_own = np.bincount(own, minlength=len(c))[:, None]
        c = np.where(n_own > 0, total / np.maximum(n_own, 1), c)
    return c


def assign(points: DataFrame, c: np.ndarray, probes: int) -> DataFrame:
    """(id, features, cell): each point with its ``probes`` nearest cells."""
    probes = min(probes, len(c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1))
            near = np.argsort((c * c).sum(axis=1)[None, :] - 2 * x @ c.T, axis=1, kind="stable")[:, :probes]
            at = pa.array(np.repeat(np.arange(len(x)), probes))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(near.ravel().astype(np.int64))], ["id", "features", "cell"])

    return points.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features")).mapInArrow(run, "id long, features array<double>, cell long")


def knn_approximate(points: DataFrame, k: int, cells: int | None = None, probes: int = 8, seed: int = 42) -> DataFrame:
    """Nearest neighbours among the points of each point's ``probes`` nearest cells.

    Centres are fitted on a bounded sample; every point is filed. Cells meet as blocks, so a large cell is many rows, and
    no task holds one whole. The result has at most k edges a point; recall is what is measured, see ``quality.recall``.
    """
    n = points.count()
    cells = cells or int(min(4096, max(1, round(n**0.5 / 2))))
    c = centres(points, cells, seed)
    if not len(c):
        return knn_exact(points, k)
    filed = settled(blocks(assign(points, c, 1).repartition("cell"), "cell"), "cells")
    asked = blocks(assign(points, c, probes).repartition("cell"), "cell")
    x = filed.select("block", F.col("ids").alias("xi"), F.col("data").alias("xx"))
    pairs = asked.select("block", F.col("ids").alias("qi"), F.col("data").alias("qx")).join(x, "block").select("qi", "qx", "xi", "xx")
    found = pairs.mapInArrow(_compare(k, True), EDGES)
    return ranked(found.distinct(), k)


METHODS = ("auto", "exact", "brute_force", "kd_tree", "approximate", "hnsw", "tq4", "tq8", "tq12", "gpu")


def knn(points: DataFrame, k: int, method: str = "auto", seed: int = 42) -> DataFrame:
    """k is cut to n - 1, so no neighbour is ever made up. Index names of other engines are accepted for what they give.

    ``tq4``, ``tq8`` and ``tq12`` find candidates on codes of so many bits and rerank them exactly.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if method == "gpu":
        raise NotImplementedError("this engine has no GPU path")
    r = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("d")).collect()[0]
    n = r.n
    k = max(0, min(k, n - 1))
    if method.startswith("tq") and k:
        from .codec import Codec, knn_reranked  # it builds on this module

        return knn_reranked(points, Codec(int(method[2:]), r.d, seed), k)
    if method in ("approximate", "hnsw") or method == "auto" and n > EXACT_POINTS:
        return knn_approximate(points, k, seed=seed)
    return knn_exact(points, k)
