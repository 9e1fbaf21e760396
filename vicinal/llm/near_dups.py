"""MinHash near-duplicate documents with sequential Bayesian verification.

1. Each document becomes its set of distinct word shingles, hashed to 64 bits, and a signature of 96 least values.
2. Documents with equal sets collapse into their least id.
3. Signatures are cut into 24 bands of 4; documents that agree in a band share a bucket. Two documents of similarity
   0.8 miss all buckets with probability (1 - 0.8**4)**24 < 4e-6.
4. Pairs of a bucket are compared on batches of 32 signature values. With m of n equal and a uniform prior, the
   similarity's posterior is Beta(m + 1, n - m + 1); a pair goes as soon as P(similarity >= threshold) is below ``miss``.
5. Survivors are confirmed on the full sets, then components are closed over the links.

No large bucket is expanded into its pairs. Its members are first tested against a pivot, the member that meets most
others over all buckets, then against a second one, the same among those that the first one's component left out; members
that fall into one component need no test among themselves. What stays apart is bounded exactly: x and y have at most
those of a pivot's shingles in common that both have, by their bitmaps, plus the lesser of their numbers of other shingles
that some other candidate document has too. Only pairs that both pivots' bounds allow are tried, so no link is given up,
and a group of near copies that hang together through few documents is not paired with itself.

Defined results: null and empty texts have the empty set and link with nothing; fewer words than the shingle length make
one shingle; equal rows and ties collapse to the least id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix, semi, table, word_hashes
from .graph import components

BANDS, ROWS, BATCH = 24, 4, 32
SIZE = BANDS * ROWS
#: Buckets up to this size are paired in full at once.
SMALL = 6
_rng = np.random.default_rng(20240817)
_A = (_rng.integers(0, 2**32, SIZE, np.uint32) | np.uint32(1))
_B = _rng.integers(0, 2**32, SIZE, np.uint32)
_BAND = _rng.integers(0, 2**63, (BANDS, ROWS), np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """For each text in a block, its sorted distinct shingle hashes."""
    data = _LOWER[data]
    (h,), cut = word_hashes(data, offsets, ~_SPACE[data])
    for a, b in zip(cut[:-1], cut[1:]):
        w = h[a:b]
        k = min(words, len(w))
        if not k:
            yield w
            continue
        s = np.zeros(len(w) - k + 1, np.uint64)
        for i in range(k):
            s = s * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i]
        yield np.unique(mix(s + np.uint64(k)))


def signature(s: np.ndarray) -> np.ndarray:
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(SIZE, 2**32 - 1, np.uint32)
    for i in range(0, len(low), 1024):
        grid = np.multiply.outer(low[i : i + 1024], _A)
        grid += _B
        np.minimum(out, grid.min(axis=0), out=out)
    return out


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, data, offsets in blocks(batch.column(1)):
                n, f1, f2, bands, sigs = [], [], [], [], []
                for s in shingle_sets(data, offsets, words):
                    n.append(len(s))
                    f1.append(int(s.sum(dtype=np.uint64)) - 2**63)
                    f2.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) - 2**63)
                    if len(s):
                        sig = signature(s)
                        keys = mix((sig.reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                        bands.append(keys.view(np.int64))
                        sigs.append(sig.tobytes())
                    else:
                        bands.append(np.zeros(0, np.int64))
                        sigs.append(b"")
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(n)), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                    ["doc_id", "n_shingles", "f1", "f2", "bands", "sig"],
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in blocks(batch.column(1)):
                sets = [s.tobytes() for s in shingle_sets(data, offsets, words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    return run


@lru_cache
def least_matches(threshold: float, miss: float) -> dict[int, int]:
    """For n compared values, the least m whose posterior P(similarity >= threshold) reaches ``miss``.

    For a uniform prior that probability is the binomial tail P(Bin(n + 1, threshold) <= m).
    """
    out = {}
    for n in range(BATCH, SIZE + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def _prune(threshold: float, miss: float):
    need = least_matches(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, SIZE) for c in (2, 3))
            live = np.arange(len(x))
            m = np.zeros(len(x), np.int64)
            for n in range(BATCH, SIZE + 1, BATCH):
                m[live] += (x[live, n - BATCH : n] == y[live, n - BATCH : n]).sum(axis=1)
                live = live[m[live] >= need[n]]
            keep = pa.array(live)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(m[live], pa.int64())], ["a", "b", "m"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    return run


def _against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, pivot, shared shingles, the pivot's shingles): a bitmap of the pivot's shingles that id has, their
    number, and how many others of the shared ones there are."""
    for batch in batches:
        maps, p, t = [], [], []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            has = np.isin(y, x, assume_unique=True)
            maps.append(np.packbits(np.pad(has, (0, -len(has) % 64))).view(np.int64))
            p.append(int(has.sum()))
            t.append(len(x) - p[-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.list_(pa.int64())), pa.array(p, pa.int64()), pa.array(t, pa.int64())], ["id", "pivot", "bits", "p", "t"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shingle of each set."""
    for batch in batches:
        sets = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(1)]
        ids = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))], ["id", "h"])


def _pick() -> list:
    return [F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")]


def _near(percent: int):
    """Components that differ, and sizes that allow the similarity."""
    return (F.col("x.component") != F.col("y.component")) & (F.col("x.n") * 100 >= F.col("y.n") * percent) & (F.col("y.n") * 100 >= F.col("x.n") * percent)


def _small_pairs(members: DataFrame, percent: int) -> DataFrame:
    x, y = members.where(F.col("size") <= SMALL).alias("x"), members.where(F.col("size") <= SMALL).alias("y")
    return x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & _near(percent)).select(_pick())


def _star_pairs(members: DataFrame, percent: int, pivot: str) -> DataFrame:
    """Each member of a large bucket against the bucket's pivot."""
    pivots = members.select(F.col("id").alias(pivot), F.struct("id", "n", "component").alias("y")).dropDuplicates([pivot])
    large = members.where(F.col("size") > SMALL).join(pivots, pivot)
    return large.select(F.struct("id", "n", "component").alias("x"), "y").where(_near(percent)).select(_pick())


def _mixed(members: DataFrame) -> DataFrame:
    """Members of buckets that hold two components."""
    span = members.withColumn("lo", F.expr("min(component) over (partition by key)")).withColumn("hi", F.expr("max(component) over (partition by key)"))
    return span.where("lo < hi").drop("lo", "hi")


def _rest_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs across components of large buckets that may have a link by what they share with the two pivots."""
    ids = members.select(F.col("id").alias("doc_id")).distinct()
    hashes = sets.join(ids, "doc_id", "left_semi").select("doc_id", "shingles").mapInArrow(_hashes, "id long, h long")
    often = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h")
    shared = hashes.join(often, "h").groupBy("id").agg(F.collect_list("h").alias("hs"))
    shared = shared.select("id", "hs").mapInArrow(_packed, "id long, shared binary")
    pivots = members.select("id", F.explode(F.array_distinct(F.array("pivot", "pivot2"))).alias("pivot")).distinct()
    own = pivots.join(shared, "id").join(sets.select(F.col("doc_id").alias("pivot"), "shingles"), "pivot").select("id", "pivot", "shared", "shingles")
    against = table(own.mapInArrow(_against, "id long, pivot long, bits array<long>, p long, t long"), "against")
    known = members.select("key", "id", "n", "component", "pivot", "pivot2")
    for i, pivot in (("1", "pivot"), ("2", "pivot2")):
        known = known.join(against.select("id", F.col("pivot").alias(pivot), F.col("bits").alias(f"bits{i}"), F.col("p").alias(f"p{i}"), F.col("t").alias(f"t{i}")), ["id", pivot])

    def enough(common: str, sizes: str) -> str:  # 100 * i >= percent * (sizes - i)
        return f"{100 + percent} * ({common}) >= {percent} * ({sizes})"

    known = known.withColumn("least", F.expr("min(n) over (partition by key)"))
    able = table(_mixed(known.where(f"{enough('p1 + t1', 'n + least')} and {enough('p2 + t2', 'n + least')}")), "able")
    x, y = able.alias("x"), able.alias("y")
    allowed = (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & _near(percent)
    for i in "12":
        both = f"aggregate(zip_with(x.bits{i}, y.bits{i}, (a, b) -> bit_count(a & b)), 0, (s, c) -> s + c)"
        allowed = allowed & F.expr(enough(f"least(x.p{i}, y.p{i}) + least(x.t{i}, y.t{i})", "x.n + y.n")) & F.expr(enough(f"{both} + least(x.t{i}, y.t{i})", "x.n + y.n"))
    return x.join(y, allowed).select(_pick())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.array(x.values.to_numpy()).tobytes() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "shared"])


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = 1e-7) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept.

    Links join documents whose shingle sets have 100 * intersection >= percent * union. component_id is the least
    doc_id reachable over links, kept says that it is the document's own. ``miss`` bounds the posterior probability of a
    link among the pairs that the signature comparison drops. Rows that share a doc_id count as one more copy each.
    """
    texts = docs.select("doc_id", "text")
    signed = table(texts.mapInArrow(_sign(words), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sig binary"), "signed")
    equal = signed.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    reps = equal.select(F.col("rep").alias("doc_id")).where("doc_id is not null")
    heads = signed.join(reps, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    keyed = heads.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"))
    sized = table(keyed.withColumn("size", F.expr("count(1) over (partition by key)")).where("size > 1"), "sized")
    central = sized.where(F.col("size") > SMALL).groupBy("id").agg(F.sum("size").alias("met"))
    ranked = sized.join(central, "id", "left").withColumn("pivot", F.expr("max_by(id, struct(met, -id)) over (partition by key)"))
    buckets = table(ranked.select("key", "id", "n", "size", "met", "pivot"), "buckets")
    ids = table(buckets.select(F.col("id").alias("doc_id")).distinct(), "members")
    sigs = table(semi(heads.select("doc_id", "sig"), ids, "doc_id"), "signatures")
    sets = table(semi(texts, ids, "doc_id").dropDuplicates(["doc_id"]).mapInArrow(_sets(words), "doc_id long, shingles binary"), "sets")

    def with_both(pairs: DataFrame, side: DataFrame, value: str) -> DataFrame:
        x = side.select(F.col("doc_id").alias("a"), F.col(value).alias("x"))
        y = side.select(F.col("doc_id").alias("b"), F.col(value).alias("y"))
        return pairs.join(x, "a").join(y, "b")

    def confirm(pairs: DataFrame) -> DataFrame:
        return with_both(pairs, sets, "shingles").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long")

    tested = links = None
    labels = ids.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("component"))
    for turn in range(3):
        members = buckets.join(labels, "id")
        if turn:  # only large buckets that still hold two components; the small ones are done
            members = _mixed(members.where(F.col("size") > SMALL))
            main = F.expr("max_by(component, id = pivot) over (partition by key)")
            left = members.withColumn("main", main)
            members = table(left.withColumn("pivot2", F.expr("max_by(id, struct(component != main, met, -id)) over (partition by key)")).drop("main"), "mixed")
            if not members.limit(1).count():
                break
        if turn == 0:
            pairs = _small_pairs(members, percent).union(_star_pairs(members, percent, "pivot"))
        elif turn == 1:
            pairs = _star_pairs(members, percent, "pivot2")
        else:
            pairs = _rest_pairs(members, sets, percent)
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = table(pairs, "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        scored = with_both(pairs, sigs, "sig").select("a", "b", "x", "y").mapInArrow(_prune(percent / 100, miss), "a long, b long, m long")
        found = table(confirm(scored.select("a", "b")), "links")
        links = found if links is None else links.union(found)
        labels = table(ids.select(F.col("doc_id").alias("id")).join(components(links), "id", "left").select("id", F.coalesce("component", "id").alias("component")), "labels")
    merged = equal.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("f1", "f2", "n_shingles", F.coalesce("component", "rep").alias("found"))
    out = signed.select("doc_id", "n_shingles", "f1", "f2").join(merged, ["f1", "f2", "n_shingles"], "left")
    component = F.coalesce("found", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
