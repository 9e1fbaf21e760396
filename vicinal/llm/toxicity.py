"""Toxicity severity: cumulative-link (proportional-odds) ordinal regression on sparse hashed words.

A text's score s is the weighted sum of log2(1 + count) over hash buckets of its words and words' beginnings; one weight vector serves all ordered
thresholds, P(grade <= k) = logistic(theta_k - s). Weights and thresholds are trained by AdaGrad with a proximal L1 step
in numpy on the driver, over a bounded sample of labelled texts (``sample`` rows). The expected severity is the sum of
P(grade > k).

Grades come from a ``severity`` column of the labels if there is one. Otherwise toxic texts have grades 1 to 3, by thirds
of how many distinct indicators they hold, where indicators are the words (and beginnings) whose presence raises the odds
of the toxic label most; other texts have grade 0.

Defined results: a null text, or one without words, has severity 0 and grade 0. Without labels of both kinds everything
has severity 0. A document labelled more than once has its highest grade. Texts are used whole. Rows are independent:
repeated rows get equal results, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, word_hashes

BITS = 18
#: Besides whole words, features are the words' first so many bytes.
HEADS = (4, 5, 6, 7)
#: A feature is used if this many training texts have it, and its presence depends on the label (chi-squared).
LEAST_TEXTS, LEAST_CHI2, MOST = 10, 60.0, 4096
#: Training: texts in a step, and least number of steps.
BATCH, STEPS = 64, 8000
#: Labelled texts that training may use.
SAMPLE = 10_000
#: The cut-off lets this share of clean texts, set aside from training, through at most; it stays within 0.05 to 0.5. Of
#: the sampled texts every so many is set aside.
FALSE_ALARMS, ASIDE = 0.004, 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def _damped(n: np.ndarray) -> np.ndarray:
    """A feature's value for its count."""
    return np.log2(1 + n)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text of a block, the distinct buckets of its words and words' heads, and their counts."""
    data = _LOWER[data]
    found, cut = word_hashes(data, offsets, _LETTER[data], HEADS)
    h = np.stack([(f >> np.uint64(64 - BITS)).astype(np.int32) for f in found], axis=1)
    for a, b in zip(cut[:-1], cut[1:]):
        buckets, n = np.unique(h[a:b], return_counts=True)
        drop = int(len(buckets) > 0 and buckets[0] == 0)  # bucket 0 is that of words shorter than a head
        yield buckets[drop:], n[drop:]


@dataclass
class Model:
    weights: np.ndarray
    theta: np.ndarray  # ascending thresholds; empty without training data
    cutoff: float = 0.5  # a text is called toxic from this probability of a grade above 0

    def grade(self, buckets: np.ndarray, n: np.ndarray) -> tuple[float, int, float]:
        """Expected severity, most likely grade, and the probability of any."""
        if not len(buckets) or not len(self.theta):
            return 0.0, 0, 0.0
        s = float(self.weights[buckets] @ _damped(n))
        above = 1 / (1 + np.exp(np.clip(self.theta - s, -50, 50)))
        p = -np.diff(np.concatenate([[1.0], above, [0.0]]))
        return float(above.sum()), int(p.argmax()), float(above[0])


def indicators(rows: list[tuple[int, np.ndarray, np.ndarray]], least: int = 5, odds: float = 3.0) -> np.ndarray:
    """Buckets present in at least ``least`` texts whose smoothed log odds ratio of the label is ``odds`` or more."""
    size = 1 << BITS
    hit = [np.bincount(np.concatenate([b for y, b, _ in rows if (y > 0) == toxic] or [np.zeros(0, int)]), minlength=size) for toxic in (False, True)]
    n = [sum((y > 0) == toxic for y, *_ in rows) for toxic in (False, True)]
    ratio = np.log((hit[1] + 0.5) / (n[1] - hit[1] + 0.5)) - np.log((hit[0] + 0.5) / (n[0] - hit[0] + 0.5))
    return (hit[0] + hit[1] >= least) & (ratio >= odds)


def telling(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Buckets, ascending, whose presence depends on whether the grade is above 0 by a chi-squared test; MOST at most."""
    n = [sum((y > 0) == toxic for y, *_ in rows) for toxic in (False, True)]
    a, b = (np.bincount(np.concatenate([b for y, b, _ in rows if (y > 0) == toxic] or [np.zeros(0, int)]), minlength=1 << BITS).astype(float) for toxic in (False, True))
    both, total = a + b, sum(n)
    chi2 = total * (a * (n[1] - b) - b * (n[0] - a)) ** 2 / np.maximum(n[0] * n[1] * both * (total - both), 1)
    chi2[both < LEAST_TEXTS] = 0
    best = np.argsort(-chi2, kind="stable")[:MOST]
    return np.sort(best[chi2[best] >= LEAST_CHI2])


def graded(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Labels 0 and 1 made into grades 0 to 3: toxic texts by thirds of their number of distinct indicators."""
    known = indicators(rows)
    found = [int(known[b].sum()) for y, b, _ in rows if y]
    cuts = np.quantile(found, [1 / 3, 2 / 3]) if found else []
    return [(y and 1 + int(np.searchsorted(cuts, known[b].sum(), "left")), b, c) for y, b, c in rows]


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 40, rate: float = 1.5, l1: float = 1e-6, seed: int = 5) -> Model:
    """``rows``: grade, buckets and their counts."""
    top = max((r[0] for r in rows), default=0)
    w = np.zeros(1 << BITS)
    if not top or all(r[0] for r in rows):
        return Model(w, np.zeros(0))
    check = rows[::ASIDE] if len(rows) >= 40 * ASIDE else rows
    rows = [r for i, r in enumerate(rows) if i % ASIDE] if check is not rows else rows
    theta = np.linspace(1.0, 3.0, top)
    used = telling(rows)
    x = np.zeros((len(rows), len(used)), np.float32)
    for i, (_, b, c) in enumerate(rows):
        at = np.searchsorted(used, b)
        ok = (at < len(used)) & (used[np.minimum(at, len(used) - 1)] == b) if len(used) else np.zeros(len(b), bool)
        x[i, at[ok]] = _damped(c[ok])
    y = np.array([r[0] for r in rows])
    v = np.zeros(len(used))
    gv, gt = np.full(len(used), 1e-6), np.full(top, 1e-6)
    rng = np.random.default_rng(seed)

    def cdf(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for _ in range(max(epochs, -(-STEPS * BATCH // len(rows)))):
        for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // BATCH)):
            s, k = x[at] @ v, y[at]
            hi = np.where(k < top, cdf(theta[np.minimum(k, top - 1)] - s), 1.0)
            lo = np.where(k > 0, cdf(theta[np.maximum(k - 1, 0)] - s), 0.0)
            p = np.maximum(hi - lo, 1e-9) * len(at)
            fh, fl = hi * (1 - hi) / p, lo * (1 - lo) / p  # 0 at the open ends
            d = x[at].T @ (fh - fl)
            gv += d * d
            step = rate / np.sqrt(gv)
            v -= step * d
            v = np.sign(v) * np.maximum(np.abs(v) - l1 * step, 0)
            d = np.bincount(np.maximum(k - 1, 0), fl, top) - np.bincount(np.minimum(k, top - 1), fh, top)
            gt += d * d
            theta = np.maximum.accumulate(theta - rate * d / np.sqrt(gt))
    w[used] = v
    model = Model(w, theta)
    clean = np.sort([model.grade(b, c)[2] for y, b, c in check if not y])[::-1]
    if len(clean):
        model.cutoff = float(np.clip(clean[int(FALSE_ALARMS * len(clean))] + 1e-9, 0.05, 0.5))
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from documents that ``labels(doc_id, toxic or severity)`` covers."""
    given = "severity" in labels.columns
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("severity" if given else "toxic").cast("int").alias("y")).where("y is not null")
    total = known.count()
    if not total:
        return train([])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(draw < min(1.0, sample / total)).limit(2 * sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in blocks(batch.column(1)):
                found = list(features(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(found)), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.int32()))], ["y", "b", "n"])

    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * sample rows
    got = texts.select("y", "text").mapInArrow(run, "y int, b array<int>, n array<int>").toArrow()
    rows = [(y, b.values.to_numpy(), n.values.to_numpy()) for y, b, n in zip(got["y"].to_pylist(), got["b"], got["n"])]
    once = {(y, b.tobytes(), n.tobytes()): (y, b, n) for y, b, n in rows}  # copies once, in an order of their own
    rows = [once[k] for k in sorted(once, key=lambda k: hashlib.md5(k[1] + k[2] + bytes([k[0]])).digest())]
    return train(rows if given else graded(rows))


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, severity (expected grade), grade, p_toxic, toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in blocks(batch.column(1)):
                found = [model.grade(b, n) for b, n in features(data, offsets)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(found)), *(pa.array([f[i] for f in found], t) for i, t in enumerate((pa.float64(), pa.int32(), pa.float64()))), pa.array([f[2] >= model.cutoff for f in found], pa.bool_())],
                    ["doc_id", "severity", "grade", "p_toxic", "toxic"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")
