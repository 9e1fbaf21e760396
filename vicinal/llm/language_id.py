"""Language identification: averaged hashed subword embeddings with a linear softmax, and calibrated rejection.

Features are the letter 1- to 3-grams of each word, with word boundaries, hashed into ``BUCKETS`` rows of an embedding.
A text is the mean of its grams' rows; a linear softmax gives class probabilities. Both are trained together by
stochastic gradient descent in numpy in one task, over a bounded sample of labelled texts (``per_lang`` a language) in an
order of its own, so a task that is run again gives the same model; the model alone reaches the driver.
Beside the languages there is a class of strangers: each sampled text also gives one text that is in no language, by a hash
of it with its letters shuffled, as words of random letters, as a few keys repeated, or as program code. A text's score is
its language's probability with strangers among the classes. A second part of the labelled texts, and of their strangers,
sets the softmax temperature; the rejection threshold is the score below which ``max_rejected`` of its languages' texts lie.

Defined results: a null text, or one without letters, is ``und`` with score 0 and rejected. Without labelled texts all
texts are ``und``. Texts are used whole, in training too. Rows are independent: repeated rows get equal results, and an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, DIM = 1 << 14, 16
UNKNOWN = "und"
#: Training: texts in a step, least number of steps, and the rate, which each weight divides by its gradients' root sum of squares.
BATCH, STEPS, RATE = 32, 1200, 0.1
#: Labelled texts that training may use, for each language.
PER_LANG = 800
#: Pieces of program code, of which strangers are made.
CODE = ["if (x == 0) {", "return self.value", "for (int i = 0; i < n; i++)", "import os, sys", "} else {", "def run(a, b=None):", "std::vector<double> v;", "SELECT id FROM t WHERE k = 1;", "x += y[i] * 2", "public static void main(String[] args)",
    "<div class=\"row\">", "const f = (a) => a.b;", "print(len(x))", "#include <stdio.h>", "while (p != NULL)", "try: pass", "fn main() -> u32 {", "0x3f00ff", "assert x is not None", "while read -r f; do"]
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SHIFT = np.uint64(64 - 14)


@lru_cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all grams of all texts, in order of the texts, and where each text's begin and end."""
    codes = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    starts = np.cumsum([0, *(len(c) + 2 for c in codes)])
    x = np.zeros(starts[-1] + 2, np.uint32)
    for at, c in zip(starts, codes):
        x[at + 1 : at + 1 + len(c)] = c
    x[~_letters()[x]] = 0
    solid = x != 0
    u = x.astype(np.uint64)
    found, where = [], []
    for n in (1, 2, 3):
        m = len(x) - n + 1
        ok = solid[:m] if n == 1 else (solid[:m] | solid[1 : m + 1]) if n == 2 else solid[1 : m + 1]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = (h + u[at + i]) * _K[i]
            h ^= h >> np.uint64(29)
        found.append(((h * _K[0]) >> _SHIFT).astype(np.int64))
        where.append(at)
    cuts = [np.searchsorted(w, starts) for w in where]
    order = [np.concatenate([f[c[i] : c[i + 1]] for f, c in zip(found, cuts)]) for i in range(len(texts))]
    ends = np.cumsum([0, *map(len, order)])
    return (np.concatenate(order) if order else np.zeros(0, np.int64)), ends


def _groups(texts: list[str | None], most: int = 1 << 19) -> Iterator[list[str | None]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def stranger(text: str) -> str:
    """A text in no language, made from ``text`` and always the same."""
    seed = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    rng = np.random.default_rng(seed)
    words = min(100, max(3, text.count(" ")))
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    kind = seed % 4
    if kind == 0:
        held = np.array([c for c in text.lower() if c.isalpha()] or ["x"])
        return " ".join("".join(rng.choice(held, n)) for n in rng.integers(1, 11, words))
    if kind == 1:
        return " ".join("".join(rng.choice(letters, n)) for n in rng.integers(1, 11, words))
    if kind == 2:
        return (" " * int(rng.integers(2))).join(["".join(rng.choice(letters, int(rng.integers(2, 8))))] * words)
    return "\n".join(rng.choice(CODE, max(1, words // 4)))


def counts(texts: list[str | None]) -> Iterator[np.ndarray]:
    for group in _groups(texts):
        b, ends = grams(group)
        for i in range(len(group)):
            yield np.bincount(b[ends[i] : ends[i + 1]], minlength=BUCKETS)


def packed(c: np.ndarray) -> tuple[bytes, bytes]:
    """The buckets that occur and their counts, in two bytes each; larger counts are scaled down together."""
    at = np.flatnonzero(c)
    n = c[at]
    top = int(n.max(initial=0))
    n = np.maximum(1, n * 65535 // top) if top > 65535 else n
    return at.astype(np.uint16).tobytes(), n.astype(np.uint16).tobytes()


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # a row of class scores for each bucket, divided by the temperature; strangers are the last class
    bias: np.ndarray
    reject_below: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for c in counts(texts):
            total = c.sum()
            if not total or not self.langs:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            z = (c / total) @ self.table + self.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            best = int(p[: len(self.langs)].argmax())
            names.append(self.langs[best])
            scores.append(float(p[best]))
        return names, scores


def train(rows: list[tuple[str | None, bool, np.ndarray, np.ndarray]], max_rejected: float, epochs: int = 12, seed: int = 7) -> Model:
    """``rows``: language (None for a stranger), whether it calibrates, its buckets and their counts."""
    langs = sorted({r[0] for r in rows if r[0] is not None})
    if not langs:
        return Model([], np.zeros((BUCKETS, 1)), np.zeros(1), 0.0)
    at = {lang: i for i, lang in enumerate([*langs, None])}
    classes = len(at)
    y = np.array([at[r[0]] for r in rows])
    held = np.array([r[1] for r in rows])
    if held.all() or not held.any():  # too few to set any aside
        held[:] = False

    def dense(of: np.ndarray) -> np.ndarray:
        out = np.zeros((len(of), BUCKETS), np.float32)
        for i, j in enumerate(of):
            out[i, rows[j][2]] = rows[j][3] / max(1, rows[j][3].sum())
        return out

    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.1, (DIM, classes)).astype(np.float32)
    c = np.zeros(classes, np.float32)
    fit = np.flatnonzero(~held)
    weight = len(fit) / (classes * np.maximum(1, np.bincount(y[fit], minlength=classes)))  # languages count alike
    squares = [np.full(v.shape, 1e-6, np.float32) for v in (e, w, c)]
    for _ in range(max(epochs, -(-STEPS * BATCH // max(1, len(fit))))):
        for at in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
            x = dense(at)
            used = np.flatnonzero(x.any(axis=0))
            x = x[:, used]
            h = x @ e[used]
            z = h @ w + c
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            p *= weight[y[at]][:, None] / len(at)
            steps = [x.T @ (p @ w.T), h.T @ p, p.sum(axis=0)]
            for v, q, g, of in zip((e, w, c), squares, steps, (used, slice(None), slice(None))):
                q[of] += g * g
                v[of] -= RATE * g / np.sqrt(q[of])
    scores = e @ w
    check = np.flatnonzero(held) if held.any() else fit
    z = np.concatenate([dense(a) @ scores + c for a in np.array_split(check, max(1, len(check) // 256))])

    def probabilities(t: float) -> np.ndarray:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    loss = {t: -np.log(np.maximum(probabilities(t)[np.arange(len(check)), y[check]], 1e-12)).mean() for t in np.geomspace(0.25, 8, 21)}
    t = min(loss, key=loss.get)
    best = np.sort(probabilities(t)[y[check] < len(langs), : len(langs)].max(axis=1))
    below = float(best[min(len(best) - 1, int(max_rejected * len(best)))]) if len(best) else 0.0
    return Model(langs, (scores / t).astype(np.float64), (c / t).astype(np.float64), below)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 3; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def fit(docs: DataFrame, per_lang: int = PER_LANG, max_rejected: float = 0.002) -> Model:
    """Learns from ``docs(doc_id, text, lang)`` whose remainder is 0 (training) or 2 (calibration)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).withColumn("part", remainder(F.col("doc_id"))).where("part != 1")
    sizes = known.groupBy("lang").count().collect()  # one row a language
    if not sizes:
        return train([], max_rejected)
    share = F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_lang / r["count"]))]), F.col("lang"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(draw < share).select("lang", "part", "text").limit(2 * per_lang * len(sizes))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            texts, langs, parts = b.column(2).to_pylist(), b.column(0).to_pylist(), b.column(1).to_pylist()
            for names, of in ((langs, texts), ([None] * len(texts), [stranger(t) for t in texts])):
                rows += [(lang, part, *packed(c)) for lang, part, c in zip(names, parts, counts(of))]
        rows.sort(key=lambda r: (r[0] is None, r[0] or "", *r[1:]))  # rows come in any order; the model is the same
        model = train([(lang, part == 2, np.frombuffer(at, np.uint16), np.frombuffer(n, np.uint16)) for lang, part, at, n in rows if at], max_rejected)
        yield pa.RecordBatch.from_pylist([{"langs": model.langs, "table": model.table.tobytes(), "bias": model.bias.tobytes(), "below": model.reject_below}], schema=pa.schema([("langs", pa.list_(pa.string())), ("table", pa.binary()), ("bias", pa.binary()), ("below", pa.float64())]))

    found = sample.coalesce(1).mapInArrow(learn, "langs array<string>, table binary, bias binary, below double").collect()  # one row
    if not found or not found[0]["langs"]:
        return train([], max_rejected)
    langs, scores, bias, below = found[0]
    return Model(list(langs), np.frombuffer(bytes(scores)).reshape(BUCKETS, -1), np.frombuffer(bytes(bias)), below)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, lang_pred, score, rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = model.predict(b.column(1).to_pylist())
            out = [n == UNKNOWN or s < model.reject_below for n, s in zip(names, scores)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns, in one pass."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = model.predict(b.column(at).to_pylist())
            yield b.filter(pa.array([n != UNKNOWN and s >= model.reject_below for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
