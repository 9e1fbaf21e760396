"""What several operators share: tables in the shared folder, native text helpers, numpy views of Arrow text.

Text conventions: a null text has no words, lines or bytes. A null ``doc_id`` is an ordinary value that sorts last.
Operators read only the columns they name, so extra columns never clash with their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import let  # noqa: F401  operators take these two from here
from ..sources.shared import settled as table  # noqa: F401
from ..sources.shared import spread

#: Words of the near-duplicate and quality operators: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of the decontamination operator, after A-Z became a-z.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A broadcast set of keys holds this many rows at most; beyond it the join is shuffled.
BROADCAST_KEYS = 1_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def semi(df: DataFrame, keys: DataFrame, on: str, limit: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``keys`` (distinct): broadcast if counted small, else shuffled."""
    return df.join(F.broadcast(keys) if keys.count() <= limit else keys, on, "left_semi")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; the fast built-in serves texts without other characters."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def covered(spans: Column) -> Column:
    """Number of positions in a sorted array of ``struct(b, e)`` half-open spans, overlaps once."""
    zero = F.struct(F.lit(0).cast("int").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        spans, zero,
        lambda a, s: F.struct(
            F.greatest(a["end"], s["e"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["e"] - F.greatest(a["end"], s["b"])).cast("long")).alias("n"),
        ),
        lambda a: a["n"],
    )


def running(values: Column, zero: Column, op, kind: str = "int", chunk: int = 64) -> Column:
    """Array of the running results of ``op`` over an array, ``zero`` first put in and not given back.

    Results are gathered by chunks, so an array of n values costs n * chunk + (n / chunk) ** 2 steps of copying at most.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")

    def whole(x: Column) -> Column:
        chunks = F.when(F.size(x) > 0, F.sequence(F.lit(0), F.floor((F.size(x) - 1) / chunk).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))

        def part(c: Column) -> Column:
            return F.slice(x, c * chunk + 1, F.lit(chunk))

        def added(a: Column, v: Column) -> Column:
            return let(op(a["s"], v), lambda s: F.struct(s.alias("s"), F.concat(a["out"], F.array(s)).alias("out")))

        starts = F.aggregate(chunks, F.struct(zero.alias("s"), none.alias("out")), lambda a, c: F.struct(F.aggregate(part(c), a["s"], op).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")), lambda a: a["out"])
        return F.flatten(F.transform(starts, lambda s, c: F.aggregate(part(c), F.struct(s.alias("s"), none.alias("out")), added, lambda a: a["out"])))

    return let(values, whole)


def before(n: Column, smaller) -> Column:
    """How many of 0 to n - 1 fulfil ``smaller``, which holds up to some number and not from there, by bisection."""
    def halved(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        return F.when(a["lo"] >= a["hi"], a).otherwise(let(mid, lambda m: let(smaller(m), lambda y: F.struct(F.when(y, m + 1).otherwise(a["lo"]).alias("lo"), F.when(y, a["hi"]).otherwise(m).alias("hi")))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.struct(F.lit(0).alias("lo"), n.alias("hi")), halved, lambda a: a["lo"])


# ---------------------------------------------------------------- numpy side

#: Odd base of the polynomial hash modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {"pow": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POWERS["pow"]) < n:
        size = max(n, 1 << 20)
        for key, base in (("pow", BASE), ("inv", INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["pow"][:n], _POWERS["inv"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with (P[e] - P[s]) * BASE**-s the hash of data[s:e], whatever s is."""
    pw, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[: len(data)], out=out[1:])
    return out


def blocks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about ``most`` bytes; null texts are empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, heads: tuple[int, ...] = ()) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the words of a block's texts, and where each text's words begin. ``inside`` marks the words' bytes.

    For each size of ``heads`` a further array has the hashes of the words' first so many bytes, 0 for shorter words.
    """
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
    starts = np.flatnonzero(inside & (before | edge[:n]))
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    p = prefix_hash(data)
    _, inv = powers(n + 1)
    out = [mix((p[ends] - p[starts]) * inv[starts] + (ends - starts).astype(np.uint64))]
    for size in heads:
        long = ends - starts >= size
        at = starts[long]
        h = np.zeros(len(starts), np.uint64)
        h[long] = mix((p[at + size] - p[at]) * inv[at] + np.uint64(size << 32))
        out.append(h)
    return out, np.searchsorted(starts, offsets)
