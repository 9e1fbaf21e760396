"""Column expressions over ``array<double>`` vectors and over distances. All of them stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, though inner lambdas use it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, summed from the first coordinate on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def to_float32(a: Column) -> Column:
    """The vector rounded to single precision."""
    return a.cast("array<float>")


def asinh(a: Column, cofactor: float = 5.0) -> Column:
    """The cytometry transform asinh(x / cofactor) of each coordinate."""
    return F.transform(a, lambda x: F.asinh(x / F.lit(cofactor)))


def membership(dist: Column, rho: Column, sigma: Column) -> Column:
    """exp(-max(d - rho, 0) / max(sigma, 1e-10))."""
    return F.exp(-F.greatest(dist - rho, F.lit(0.0)) / F.greatest(sigma, F.lit(1e-10)))


def fuzzy_or(a: Column, b: Column) -> Column:
    """Probabilistic t-conorm a + b - ab."""
    return a + b - a * b


def student_t(squared: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + squared)


def clamp(x: Column, limit: float = 4.0) -> Column:
    return F.greatest(F.least(x, F.lit(limit)), F.lit(-limit))


def scale(a: Column, by: float) -> Column:
    return F.transform(a, lambda x: x * F.lit(by))


def quantize_scalar(x: Column, boundaries: list[float]) -> Column:
    """How many boundaries lie strictly below x."""
    edges = F.array(*[F.lit(float(b)) for b in boundaries])
    return F.size(F.filter(edges, lambda b: b < x))


def dequantize_scalar(code: Column, centroids: list[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(c)) for c in centroids]), code + 1)


def equal_width_bin(x: Column, low: float, high: float, bins: int = 5) -> Column:
    """Bin 1 to ``bins`` of equal width; each holds its upper edge, and the first its lower one too."""
    width = (high - low) / bins
    return F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((x - F.lit(low)) / F.lit(width)).cast("int")))


def label(*parts: Column) -> Column:
    return F.concat_ws("_", *parts)


def smooth_sigma(dists: Column, k: Column | int, rho: Column) -> Column:
    """The bandwidth s with sum(exp(-max(d - rho, 0) / s)) = ln k, by bisection of [0, 1e10].

    At most 64 halvings; it ends once the sum is within 1e-5. The last midpoint counts.
    """
    target = F.log(F.lit(k).cast("double") if isinstance(k, int) else k.cast("double"))

    def total(mid: Column) -> Column:
        return F.aggregate(dists, F.lit(0.0), lambda s, d: s + F.exp(-F.greatest(d - rho, F.lit(0.0)) / mid))

    return _bisect(total, target, 0.0, 1e10)


def perplexity_sigma(dists: Column, perplexity: float) -> Column:
    """The bandwidth at which p_j ~ exp(-d_j^2 / (2 s^2)) has entropy ln(perplexity), by bisection of [1e-10, 1e4]."""

    def entropy(sigma: Column) -> Column:
        beta = F.lit(1.0) / (F.lit(2.0) * sigma * sigma)
        return let(F.transform(dists, lambda d: F.exp(-beta * d * d)), lambda w: let(F.aggregate(w, F.lit(0.0), lambda s, x: s + x), lambda t: rest(w, t)))

    def rest(w: Column, t: Column) -> Column:
        # a vanishing sum means that sigma is too small, as does a low entropy
        h = F.aggregate(w, F.lit(0.0), lambda s, x: s - F.when(x / t > 1e-20, x / t * F.log(x / t)).otherwise(0.0))
        return F.when(t < 1e-20, F.lit(-1.0)).otherwise(h)

    return _bisect(entropy, F.lit(math.log(perplexity)), 1e-10, 1e4)


def _bisect(value, target: Column, low: float, high: float) -> Column:
    start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"), F.lit(1.0).alias("mid"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / F.lit(2.0)
        return F.when(s["done"], s).otherwise(
            let(value(mid), lambda v: F.struct(
                F.when(F.abs(v - target) < 1e-5, s["lo"]).when(v > target, s["lo"]).otherwise(mid).alias("lo"),
                F.when(F.abs(v - target) < 1e-5, s["hi"]).when(v > target, mid).otherwise(s["hi"]).alias("hi"),
                mid.alias("mid"), (F.abs(v - target) < 1e-5).alias("done"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step, lambda s: s["mid"])


def conditional_p(dists: Column, sigma: Column) -> Column:
    """p(j | i) of all neighbours at the bandwidth."""
    w = F.transform(dists, lambda d: F.exp(-(F.lit(1.0) / (F.lit(2.0) * sigma * sigma)) * d * d))
    total = F.aggregate(w, F.lit(0.0), lambda s, y: s + y)
    return let(F.greatest(total, F.lit(1e-20)), lambda t: F.transform(w, lambda x: x / t))
