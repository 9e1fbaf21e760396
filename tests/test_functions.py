import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vicinal.functions import kernels as K
from vicinal.functions import vectors as V


def test_distance_of_the_unit_diagonal(spark):
    row = spark.range(1).select(V.distance(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)))).first()
    assert abs(row[0] - math.sqrt(3)) < 1e-12


def test_smooth_sigma_reaches_its_target(spark):
    d = F.array(*[F.lit(float(x)) for x in (1, 2, 3, 4)])
    sigma = spark.range(1).select(V.smooth_sigma(d, 5, F.lit(0.0))).first()[0]
    assert sigma > 0 and abs(sum(math.exp(-x / sigma) for x in (1, 2, 3, 4)) - math.log(5)) < 1e-4


def test_perplexity_sigma_reaches_its_entropy(spark):
    values = [0.5, 0.7, 1.0, 1.4, 2.0, 2.5, 3.0]
    sigma = spark.range(1).select(V.perplexity_sigma(F.array(*[F.lit(x) for x in values]), 3.0)).first()[0]
    w = np.exp(-np.square(values) / (2 * sigma * sigma))
    p = w / w.sum()
    assert abs(-(p * np.log(p)).sum() - math.log(3)) < 1e-4


def test_walsh_hadamard_of_an_impulse():
    assert np.allclose(K.walsh_hadamard(np.array([[1.0, 0, 0, 0]])), 0.5)


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 6), st.integers(0, 2**31))
def test_walsh_hadamard_is_its_own_inverse(bits, seed):
    x = np.random.default_rng(seed).normal(size=(3, 2**bits))
    y = K.walsh_hadamard(x)
    assert np.allclose(K.walsh_hadamard(y), x) and np.allclose((y * y).sum(), (x * x).sum())


def test_curve_parameters():
    assert K.curve_parameters(0.1, 1.0) == (1.577, 0.8951)
    assert K.curve_parameters(0.3, 2.0) == (1.5 / 2.0**1.8, 0.9)
    assert K.curve_parameters(0.0, 2.0) == (1.577, 0.9)


def test_density_integrates_to_one():
    for d in (4, 32, 128):
        assert abs(K.integrate(lambda x, d=d: K.sphere_density(x, d), np.array([-1.0]), np.array([1.0]), 128)[0] - 1) < 1e-3


def test_scalar_quantizer_counts_lower_boundaries(spark):
    got = spark.createDataFrame([(-2.0,), (0.0,), (0.5,)], "x double").select(V.quantize_scalar(F.col("x"), [-1.0, 0.0, 0.4])).collect()
    assert [r[0] for r in got] == [0, 1, 3]


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 30), st.integers(1, 5), st.integers(1, 8), st.integers(0, 2**31))
def test_nearest_is_exact_with_ties_by_id(n, d, k, seed):
    x = np.random.default_rng(seed).integers(0, 3, (n, d)).astype(float)
    ids = np.arange(n) * 7 + 3
    row, dst, dist = K.nearest(x, ids, x, ids, k, True)
    for i in range(n):
        want = sorted((math.dist(x[i], x[j]), ids[j]) for j in range(n) if j != i)[:k]
        got = [(dd, j) for r, j, dd in zip(row, dst, dist) if r == i]
        assert [j for _, j in got] == [j for _, j in want] and np.allclose([a for a, _ in got], [a for a, _ in want])
